"""Language ID, quality, chat formatting, packing and byte-level BPE on small and odd inputs."""

import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import bpe, chat, common, langid, packing, quality

DOCS = "doc_id long, text string, lang string, lang_pred string, score double"
WORD = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "123 !!!", "a", "word " * 30_000, "naïve café", "日本語 テスト", "tab\there  two\n\n\nlines ", "nul\x00 x", "I'll 'S don't", "<|endoftext|> [INST] <s>"]


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else None, "x", 0.5) for i, t in enumerate(texts)], DOCS)


# ---- language ID


def test_language_is_learned_and_odd_texts_are_und(spark):
    en, de = ["the cat and the dog that was there with them"] * 30, ["der hund und die katze sind nicht hier gewesen"] * 30
    d = docs(spark, [*en, *de, *ODD, "the dog was there"], ["en"] * 30 + ["de"] * 30 + [None] * (len(ODD) + 1))
    p = langid.learn(d, F.col("lang").isNull())
    rows = {r["doc_id"]: r for r in langid.predict(d, p).collect()}
    assert all(rows[i]["lang_pred"] == ("en" if i < 30 else "de") for i in range(60))
    assert rows[60 + len(ODD)]["lang_pred"] == "en"
    assert [rows[60 + i]["lang_pred"] for i in range(5)] == ["und"] * 5
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert set(langid.predict(d, p).columns) == set(d.columns)  # clashing names are replaced


def test_language_distance_by_hand():
    p = langid.Profiles({"a": [1 << 40, 5, 7], "b": [7, 5]}, 3)
    keys, counts = np.array([5, 7]), np.array([1, 2])
    top = langid._top(keys, counts, 3)
    assert top.tolist() == [7, 5]
    k, n = langid.ngrams("Ab ab")
    assert dict(zip(k.tolist(), n.tolist()))[ord("a")] == 2
    assert p.languages == ["a", "b"]


def test_language_distances_match_brute_force():
    from collections import Counter

    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"_{w}_"
            out.update(w)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    code = lambda g: sum((1 if c == "_" else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    ranked = lambda t, k: [g for g, _ in sorted(grams(t).items(), key=lambda x: (-x[1], code(x[0])))[:k]]
    texts = {"en": "the cat and the dog that was there with them", "de": "der hund und die katze sind nicht hier"}
    p = langid.Profiles({k: [code(g) for g in ranked(t, 30)] for k, t in texts.items()}, 30)
    for t in ("the dog is not here", "der hund ist da", "x1y zz", "Äpfel und Öl"):
        own = ranked(t, 30)
        want = [sum(abs(prof.index(g) - i) if g in prof else 30 for i, g in enumerate(own)) / (len(own) * 30) for prof in (ranked(texts["de"], 30), ranked(texts["en"], 30))]
        assert p.distances(t) == pytest.approx(want)


def test_many_languages_are_all_learned(spark):
    rng = np.random.default_rng(3)
    word = lambda k: "".join(chr(0x4E00 + k * 7 + int(x)) for x in rng.integers(0, 7, 6))
    rows = [(k * 3 + j, word(k), f"l{k:04}", "x", 0.5) for k in range(1100) for j in range(3)]
    p = langid.learn(spark.createDataFrame(rows, DOCS), F.lit(False))
    assert len(p.languages) == 1100


def test_language_without_labels_or_rows(spark):
    d = docs(spark, ["the cat", None])
    p = langid.learn(d, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(d, p).collect()} == {"und"}
    assert langid.predict(d.limit(0), p).count() == 0


# ---- quality


def test_quality_learns_symbols_and_scores_odd_texts(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "house"]
    good = [" ".join(rng.choice(words, 40)) + "." for _ in range(60)]
    bad = ["*** ".join(rng.choice(words, 40)) + "%%%" for _ in range(60)]
    d = docs(spark, [*good, *bad, *ODD])
    labels = spark.createDataFrame([(i, 1 if i < 60 else 0) for i in range(120)] + [(5, None), (999, 1)], "doc_id long, quality int")
    m = quality.learn(d, labels, F.col("doc_id") % 5 == 0)
    s = {r["doc_id"]: r["score"] for r in quality.score(d, m).collect()}
    assert all(s[i] > 0.5 for i in range(0, 60, 5)) and all(s[i] < 0.5 for i in range(60, 120, 5))
    assert len(s) == 120 + len(ODD) and all(0 <= v <= 1 for v in s.values())
    empty = quality.learn(d.limit(0), labels.limit(0), F.lit(False))
    assert quality.score(d.limit(3), empty).count() == 3


def test_quality_scores_are_table_additions():
    rng = np.random.default_rng(2)
    x = rng.random((300, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.Additive(x, y)
    assert ((m.scores(x) > 0.5) == y).mean() > 0.9  # an interaction that no single feature shows
    f = m.intercept + sum(t[np.searchsorted(e, x[0, i], side="right")] for i, (e, t) in enumerate(zip(m.edges, m.tables, strict=True)))
    f += sum(t[np.searchsorted(a, x[0, i], side="right"), np.searchsorted(b, x[0, j], side="right")] for i, j, a, b, t in m.pairs)
    assert m.scores(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-f)))


# ---- chat


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<|im_start|>user<|im_sep|>x<|im_end|>", "", "<<SYS>>", "<<s>\n\\", "[[INST]", "plain"]
    rows = [(i, t, r, x, "y") for i in range(3) for t, x in enumerate(texts) for r in [["user", "assistant"][(i + t) % 2]]]
    d = spark.createDataFrame([*rows, (None, 0, None, None, "y"), (7, None, "assistant", None, "y"), (7, None, "assistant", None, "y")], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.read_back(chat.format_turns(chat.canonical_turns(chat.conversations_to_records(d), "record"))).collect()
    assert len(out) == 5
    for r in out:
        assert [tuple(t) for t in r["turns"]] == [tuple(t) for t in r["read_turns"]]
        assert r["loss_texts"] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        body = r["formatted"].replace("<|im_start|>", "").replace("<|im_sep|>", "").replace("<|im_end|>", "")
        assert r["formatted"].count("<|im_start|>") == len(r["turns"])
        assert not any(c in body for c in chat.CONTROLS)
    assert chat.conversations_to_records(d.limit(0)).count() == 0


def test_chat_layouts_are_recognised_by_their_fields(spark):
    records = [
        {"prompt": "a", "response": "b"}, {"instruction": "a", "output": "b"}, {"instruction": "a", "input": "c", "output": "b", "source": "z"},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"question": "a", "answer": "b"}, {"system": "s", "prompt": "a", "response": "b"},
    ]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "{bad"), (91, None), (92, '{"other": 1}')], "id int, payload string")
    got = {r["id"]: r for r in chat.canonical_turns(d, "payload").collect()}
    flat = {k: [(t["role"], t["text"]) for t in v["turns"]] if v["turns"] is not None else None for k, v in got.items()}
    pair = [("user", "a"), ("assistant", "b")]
    assert [flat[i] for i in (0, 1, 3, 4, 5)] == [pair] * 5
    assert flat[2] == [("user", "a\n\nc"), ("assistant", "b")]
    assert flat[6] == [("system", "s"), *pair]
    assert [flat[i] for i in (90, 91, 92)] == [None] * 3


# ---- packing


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_packing_is_whole_and_gapless(spark):
    d = docs(spark, [*ODD, *ODD]).repartition(3)
    want = dict(enumerate(whole_ids([*ODD, *ODD])))
    rows = packing.piece_rows(d, WORD).collect()
    seen = {}
    for r in rows:
        ids = want[r["doc_id"]]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids) and r["length"] > 0
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or s == max(by)
    assert packing.piece_rows(d.limit(0), WORD).count() == 0


def test_words_match_the_library():
    texts = [*ODD, "e\u0301 \u0301x Σας İx ǅ", "A\u3000b\u2028c", "x'll's 42ab"]
    got = packing.WordTokenizer(WORD).encode(pa.array(texts, pa.string())).to_pylist()
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w[:-1] for w in whole_ids(texts)]


@pytest.mark.parametrize("bits", [24, 6])
def test_sifted_rows_are_those_of_a_semi_join(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "BITMAP", bits)
    rng = np.random.default_rng(2)
    ids = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 3000)] + [None, -1, 0, 63, 64, -64]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "k long, n int")
    keys = spark.createDataFrame([(x,) for x in ids[::3] + [5, None]], "k long")
    want = {r["n"] for r in rows.join(keys, "k", "left_semi").collect()}
    assert {r["n"] for r in common.sifted(rows, keys, "k").collect()} == want
    assert common.sifted(rows, keys.limit(0), "k").count() == 0


def test_batches_are_regrouped_without_loss():
    b = [pa.RecordBatch.from_pydict({"text": ["a" * (i % 7) if i % 5 else None for i in range(s, s + 13)], "n": list(range(s, s + 13))}) for s in (0, 13, 26)]
    out = list(common.regrouped(iter(b), "text", 10))
    assert [n for x in out for n in x.column("n").to_pylist()] == list(range(39))
    assert all(sum(len(t or "") for t in x.column("text").to_pylist()) <= 10 for x in out)


# ---- byte-level BPE


def reference_coder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_digests_match_the_library(spark):
    texts = [*ODD, "\u00a0 a\u00a0 b", "e\u0301 \u2028 x", "a\x1c b\x85 c", "supercalifragilistic antidisestablishment 12345 !!! *** "]
    e = reference_coder()
    got = {r["doc_id"]: r for r in bpe.digests(docs(spark, texts), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs(spark, texts).limit(0), RANKS, P.PATTERN).count() == 0


def test_very_long_words_are_coded_as_the_library_does():
    import random
    import time

    rng, e, c = random.Random(5), reference_coder(), bpe.Coder(RANKS, P.PATTERN)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["the", "and", "ing", "information", "of", "Europe", "language", "zq", "xx", "tion"]
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (257, 300, 511, 512, 513, 2000)]
    words += ["".join(rng.choice(names) for _ in range(900)), "a" * 5000, "b" + "a" * 4999, "ab" * 2500, "=" * 4100, "\u4e00\u00e9" * 900, "".join(rng.choice("ab") for _ in range(4000))]
    words += ["".join(rng.choice(letters + letters.upper()) for _ in range(200_000))]
    for w in words:
        began = time.time()
        assert c.contract_long(w.encode()) == e.encode_ordinary(w), w[:40]
        assert time.time() - began < 60


def test_bpe_encode_and_decode_are_inverse(spark):
    texts = [t for t in ODD if t is None or len(t) < 100]
    out = bpe.decode(bpe.encode(docs(spark, texts), RANKS, P.PATTERN), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in out] == [t or "" for t in texts]
    e = reference_coder()
    assert [r["ids"] for r in out] == [e.encode_ordinary(t or "") for t in texts]
