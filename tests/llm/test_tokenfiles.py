"""Token files: the coder's round trip, damage, and ids against the tokenizers library."""

import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenfold.llm import queries, tokenfiles
from lumenfold.llm.common import work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


def coded(ids, **more):
    ids = np.array(ids, "<u4")
    table = tokenfiles.frequencies(Counter(ids.tolist()))
    return ids, table, tokenfiles.encode_block(ids, 17, table, **more)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.integers(0, 3), max_size=900), st.integers(1, 40))
def test_round_trip(ids, stride):
    ids, table, block = coded(ids, stride=stride)
    d = tokenfiles.Decoder(table)
    start, got = d.decode(block)
    assert start == 17 and (got == ids).all() and len(got) == len(ids)
    for a, b in ((0, 1), (len(ids) // 2, len(ids) // 2 + 1), (len(ids) // 3, len(ids))):
        at, got = d.decode(block, a, b)
        assert (got == ids[at - 17 : at - 17 + len(got)]).all() and at - 17 <= a and at - 17 + len(got) >= min(b, len(ids))


def test_coded_size_is_near_the_entropy():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 300_000) % 50_000
    n = np.bincount(ids)
    bits = -(n[n > 0] * np.log2(n[n > 0] / n.sum())).sum()
    _, table, block = coded(ids)
    assert int(table.freq.sum()) == 1 << tokenfiles.PRECISION and (table.freq > 0).all()
    assert len(block) < 1.06 * bits / 8 and tokenfiles.lanes_of(300_000) == tokenfiles.LANES
    # fewer ids are decoded where few are asked for
    at, got = tokenfiles.Decoder(table).decode(block, 100_000, 100_001)
    assert len(got) == tokenfiles.STRIDE * tokenfiles.LANES and 17 <= at <= 17 + 100_000


@pytest.mark.parametrize("at", [0, 5, 9, 30, 60, -1])
def test_damage_is_told(at):
    ids, table, block = coded(range(5000))
    bad = bytearray(block)
    bad[at] ^= 4
    with pytest.raises(ValueError):
        tokenfiles.Decoder(table).decode(bytes(bad))
    with pytest.raises(ValueError):
        tokenfiles.Decoder(table).decode(block[:-4])
    with pytest.raises(ValueError, match="another table"):
        tokenfiles.Decoder(tokenfiles.frequencies({1: 5, 2: 7})).decode(block)
    with pytest.raises(ValueError, match="doesn't have"):
        tokenfiles.encode_block(np.array([4, 9000]), 0, table)


def test_tables_of_few_and_many_ids():
    assert tokenfiles.frequencies({7: 3}).freq.tolist() == [1 << tokenfiles.PRECISION]
    many = tokenfiles.frequencies({i: 1 for i in range(1 << (tokenfiles.PRECISION - 1))})
    assert int(many.freq.sum()) == 1 << tokenfiles.PRECISION
    one_big = tokenfiles.frequencies({0: 10**9} | {i: 1 for i in range(1, 50_000)})
    assert int(one_big.freq.sum()) == 1 << tokenfiles.PRECISION and one_big.freq.min() == 1
    with pytest.raises(ValueError, match="too many"):
        tokenfiles.frequencies({i: 1 for i in range((1 << (tokenfiles.PRECISION - 1)) + 1)})


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b ", "a\n b", "a \nb", "\n\n  x", "I'll 've it's", "x  y", "x\x1c y", "x᠎ y", "x\x0b y\x85 z",
    "<|endoftext|>", "a <|endoftext|> b", "日本 語 é́ ß", "a" * 3000 + " " + "=" * 500, "1 22 333,4 ..!! ? \t\tq", "  　 z", "'s 't' re",
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tab'sé1. \x0b\x1c　"), max_size=25), max_size=5))
def test_ids_are_the_librarys(texts):
    tok, whole = tokenfiles._tokenizer(PATH), Tokenizer.from_file(PATH)
    for some in (texts, TEXTS):
        got = tok.encode(pa.array([*some, None], pa.string())).to_pylist()
        assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in [*some, ""]]


def expected(rows, eos=2):
    whole, out, at = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, eos]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_every_id(spark):
    rows = [(i * 7 % 61, f"text {i} " * (i % 9) + TEXTS[i % len(TEXTS)]) for i in range(61)] + [(None, "null id"), (99, None), (100, "w " * 20_000)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(7)
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    tokenfiles.write_documents(d, PATH, path, block_ids=100)
    got = tokenfiles.read_tokens(spark, path).collect()
    want = expected(rows)
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    every = b"".join(bytes(r["ids"]) for r in sorted(got, key=lambda r: r["start"]))
    for a, b in ((0, 10), (700, 5000), (want[-1][1] + 50, 10**9)):
        pieces = sorted(tokenfiles.read_range(spark, path, a, b).collect())
        assert b"".join(bytes(p["ids"]) for p in pieces) == every[4 * a : 4 * b] and pieces[0]["start"] == a
    assert spark.read.parquet(f"{path}/blocks").count() > 5


def test_repeated_rows_and_ids(spark):
    d = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other"), (0, "x")], "doc_id long, text string")
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    tokenfiles.write_documents(d, PATH, path)
    got = sorted(map(tuple, tokenfiles.read_tokens(spark, path, keep_ids=False).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [0, 1, 1, 1] and [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    assert Counter(r[3] for r in got) == Counter(r[3] for r in expected([(1, "same"), (1, "same"), (1, "other"), (0, "x")]))


def test_an_empty_table(spark):
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    tokenfiles.write_documents(spark.createDataFrame([], "doc_id string, text string"), PATH, path)
    assert tokenfiles.read_tokens(spark, path).count() == 0 and tokenfiles.read_range(spark, path, 0, 9).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.QUERIES["op13_token_files"](spark, DATA)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected(rows)
