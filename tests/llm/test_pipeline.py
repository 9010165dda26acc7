"""The pipeline's stages on a small folder."""

import corpus_pipeline
import numpy as np
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(8)
    en, de = "the of and to in that was there with from".split(), "der die und nicht ist ein zu den mit von".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else de, 60)) + ".", "en" if i % 2 else "de", "s", 0) for i in range(80)]
    rows += [(100 + i, rows[1][1], "en", "s", 0) for i in range(5)]
    rows += [(200 + i, "*** ".join(rng.choice(en, 60)) + " %%%", "en", "s", 0) for i in range(30)]
    rows += [(300, None, None, "s", None), (301, "12345 !!", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int(r[0] < 200), 0) for r in rows if r[0] < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_keep_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {300, 301}.isdisjoint(seen["language_id"]) and set(range(80)) <= seen["language_id"]
    assert not {i for i in seen["quality_classifier"] if i >= 200} and set(range(80)) <= seen["quality_classifier"]
    assert seen["simhash_dedup"] & {1, *range(100, 105)} == {1}
    pieces = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == seen["simhash_dedup"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The columns of documents and some whose names the operators use, a very long text, nulls, repeated rows."""
    at = str(tmp_path_factory.mktemp("odd"))
    rng = np.random.default_rng(9)
    en = "the of and to in that was there with from".split()
    rows = [(i, " ".join(rng.choice(en, 40)) + f" number w{i}", "en", "s", 0, f"l{i}", 1.5, i, "k") for i in range(40)]
    rows += [(50, " ".join(rng.choice(en, 60_000)), "en", "s", 0, "l", 1.5, 1, "k"), (51, "x" * 300_000, None, "s", 0, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[3], rows[3], (60, "", "en", "s", 0, "l", 0.0, 0, "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score double, th long, __key string")
    d.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(1, 1, 0), (2, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_take_odd_rows_and_clashing_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    schema = docs.schema
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.schema.names == schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
        kept = {r["doc_id"]: r for r in docs.collect()}
        assert set(range(40)) <= set(kept)  # clean documents stay, with their own columns
        assert all((kept[i]["n_lines"], kept[i]["score"], kept[i]["th"], kept[i]["__key"]) == (f"l{i}", 1.5, i, "k") for i in range(40))
    assert docs.where("doc_id = 3").count() == 1
    pieces = corpus_pipeline.run(spark, odd)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept)


def test_stages_take_empty_tables(spark, odd, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_takes_simhash_links_and_verifies_them(spark, monkeypatch):
    """Fingerprints alone find edited copies (no list of min-hashes is there), and no link goes unverified."""
    from lumenfold.llm import jaccard

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choice(words, 400).tolist()
    edited = [*base[:395], *rng.choice(words, 5).tolist()]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(rng.choice(words, 400)))]
    texts = spark.createDataFrame(rows, "th long, text string")
    sets = {k: jaccard.shingles(t) for k, t in rows}
    far = [bin((jaccard.set_fingerprint(sets[1]) ^ jaccard.set_fingerprint(sets[k])) & (1 << 64) - 1).count("1") for k in (2, 3)]
    assert far[0] <= 4 < far[1]
    found = jaccard.fingerprint_pairs(jaccard.band_rows(texts))
    assert {frozenset(map(int, r)) for r in found.collect()} == {frozenset((1, 2))}
    monkeypatch.setattr(jaccard, "bands", lambda members: np.array([hash(members.tobytes())], np.int64))
    grouped = lambda: {(r["th"], r["component"]) for r in jaccard.near_texts(texts).collect()}
    assert grouped() - {(1, 1)} == {(2, 1)}
    monkeypatch.setattr(jaccard, "set_fingerprint", lambda members: 0)  # all are linked, and the third is near none
    assert grouped() - {(1, 1)} == {(2, 1)}
