"""The registered queries under their own names, on the smallest tables, against libraries and brute force."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lumenfold.llm import queries

from .test_dedup_operators import slow_print, union

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    return [r.asDict(recursive=True) for r in queries.QUERIES[name](spark, DATA).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cursor = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = rows(spark, name)
    assert got and set(got[0]) == set(names)
    assert sorted(repr([r[n] for n in names]) for r in got) == sorted(repr(list(r)) for r in cursor.fetchall())


def test_op1_language_id(spark, docs):
    got = rows(spark, "op1_language_id")
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] is not None and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in known]) > 0.95
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")) for r in got)


def test_op4_line_dedup(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op4_line_dedup")}
    assert set(got) == set(docs)
    for i, r in got.items():
        old = docs[i]["text"]
        if old is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        before, after = old.split("\n"), r["text"].split("\n") if r["text"] or r["n_dropped"] < r["n_lines"] else []
        assert len(before) == r["n_lines"] and len(after) == r["n_lines"] - r["n_dropped"]
        rest = iter(before)
        assert all(line in rest for line in after)  # what stays keeps its order
    # a line that many texts have as it is goes, but for one place
    held = {}
    for d in docs.values():
        for line in set((d["text"] or "").split("\n")) - {""}:
            held.setdefault(line, set()).add(d["text"])
    common = [x for x, t in held.items() if len(t) >= 20 and x.strip()]
    assert all(sum(x in (r["text"] or "").split("\n") for r in got.values()) <= 1 for x in common)


def test_op6_packing(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    used = {}
    for r in rows(spark, "op6_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for i, ps in pieces.items():
        ids = np.array([*whole.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_op7_byte_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: r for r in rows(spark, "op7_byte_bpe")}
    assert set(got) == set(docs)
    for i, r in got.items():
        ids = coder.encode_ordinary(docs[i]["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((docs[i]["text"] or "").encode()))


def test_op8_simhash_dedup(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op8_simhash_dedup")}
    prints = {i: slow_print(d["text"]) for i, d in docs.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == union(pairs, ids)


def test_op10_quality_classifier(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in rows(spark, "op10_quality_classifier")}
    assert set(got) == set(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    good, bad = ([got[i]["score"] for i, q in labels.items() if i in got and q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9
