"""Near duplicates, lines, URLs and search against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import components, jaccard, lines, simhash, topk, urls, vectors


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("pairs", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, i) for i in range(101, 120)], [(9, 3), (3, 9), (9, 7), (5, 6)]])
def test_components(spark, pairs):
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    want = {n: c for n, c in union(real, {x for p in real for x in p}).items() if n != c}
    assert {r["node"]: r["component"] for r in got} == want


# ---- SimHash


def slow_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64(" ".join(ws[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_match_the_definition():
    for t in [None, "", " \n", "one", "One TWO three", "É É É É é", "a b c d e f g h " * 9, "x\x0by\x0cz w\u00a0v u"]:
        assert simhash.fingerprint(t) % (1 << 64) == slow_print(t)


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flip = lambda x, k: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    fp = [int(x) for x in base] + [int(flip(base[i % 5], int(rng.integers(0, 5)))) for i in range(400)] + [0, 0]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fp]
    d = spark.createDataFrame([(i, s, 1) for i, s in enumerate(signed)], "doc_id long, fingerprint long, component_id int")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(d).collect()}
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    assert got == union(pairs, range(len(fp)))
    # the same when every run is cut into tiles
    classes = d.select("fingerprint").distinct()
    split = components.connected_components(simhash.near_edges(classes, run=7), "a", "b").count()
    assert split == components.connected_components(simhash.near_edges(classes), "a", "b").count()


@pytest.mark.parametrize("blocks,distance", [(6, 4), (7, 4), (8, 4), (8, 2), (6, 1)])
def test_blocks_of_any_number_cover_the_distance(spark, blocks, distance):
    assert sum(w for _, w in simhash.cut_points(blocks)) == 64 and simhash.cut_points(6)[-1] == (54, 10)
    rng = np.random.default_rng(blocks + distance)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    # pairs at every distance up to two more, bits drawn anywhere
    fp = sorted({*base, *(b ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in range(1, distance + 3))})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fp]
    d = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_edges(d, distance, blocks=blocks).distinct().collect()]
    want = [(a, b) for i, a in enumerate(fp) for b in fp[:i] if (a ^ b).bit_count() <= distance]
    assert union(got, fp) == union(want, fp) and all((a ^ b).bit_count() <= distance for a, b in got)
    assert simhash.near_edges(d.limit(0), distance).count() == 0


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False))) for c in centre for _ in range(150)])
    l, r = simhash.forest(fp, 4)
    want = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4]
    assert union(zip(l.tolist(), r.tolist(), strict=True), range(len(fp))) == union(want, range(len(fp)))
    assert all(int(fp[a] ^ fp[b]).bit_count() <= 4 for a, b in zip(l, r, strict=True))
    assert len(l) < len(fp)  # a forest, however many groups a run holds


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (None, "quite another text here", "d"), (8, None, "e"), (9, "", "f")]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"] or -1, r["source"]) for r in out) == [(-1, "d"), (3, "b"), (8, "e")]


def word_shingles(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def planted_copies(rng):
    """Texts and copies with similarities from about 0.7 to 1, half of them behind one common passage."""
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, texts = draw(40), []
    for i in range(60):
        base = (passage if i % 2 else []) + draw(int(rng.integers(20, 300)))
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for at in rng.choice(len(base), max(1, int(len(base) * rng.choice([0.005, 0.01, 0.02, 0.03]))), replace=False):
                copy[at] = f"new{int(rng.integers(0, 10**6))}"
            texts.append(copy)
    hub = draw(200)
    for i in range(150):
        texts.append([*hub[:i], f"own{i}", *hub[i + 1 :]])
    return [" ".join(t) for t in texts] + ["a b", "A  b", "a b c", "", None]


def test_planted_copies_are_grouped_as_by_brute_force(spark):
    texts = planted_copies(np.random.default_rng(9))
    sets = [word_shingles(t) for t in texts]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]
    shares = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs if sets[i]]
    assert all(any(lo <= s < lo + 0.05 for s in shares) for lo in (0.8, 0.85, 0.9, 0.95))
    want = union(pairs, range(len(texts)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.one_of_each(d).collect()}
    assert got == set(want.values())  # recall 1, and no clean text lost
    # the same when families are cut into tiles
    rows = jaccard.keyed(d).cache()
    parts = {r["th"]: r["component"] for r in jaccard.near_texts(rows, elements=2000).collect()}
    names = {r["doc_id"]: r["th"] for r in rows.select("doc_id", "th").collect()}
    assert len({parts.get(s, s) for s in names.values()}) == len(got)


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    rows = [(i, f"some text of its own {'abcdefghij'[i]} and more words" if i < 10 else "some text of its own c and more words") for i in range(12)] + [(20, ""), (21, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r["doc_id"] for r in simhash.one_of_each(d).collect())
    monkeypatch.setattr(jaccard, "_name", lambda text: F.pmod(F.length(text), F.lit(2)).cast("long"))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(d).collect()) == want
    assert 2 in want and 10 not in want and len(want) == 11


def test_what_near_sets_join_matches_brute_force():
    rng = np.random.default_rng(13)
    base = [rng.choice(4000, 60, replace=False) for _ in range(3)]
    sets = []
    for i in range(120):
        s = base[i % 3].copy()
        s[: int(rng.integers(0, 16))] = rng.choice(100_000, 16, replace=False)[: int(rng.integers(0, 16))].sum() + 5000
        sets.append(np.unique(s))
    near = [(i, j) for i in range(120) for j in range(i) if jaccard.similar(sets[i], sets[j])]
    l, r = jaccard.joined(sets, np.arange(120), np.arange(120))
    assert union(zip(l, r, strict=True), range(120)) == union(near, range(120)) and len(l) < 120
    assert all(jaccard.similar(sets[a], sets[b]) for a, b in zip(l, r, strict=True))


def test_bands_of_near_sets_meet():
    rng = np.random.default_rng(12)
    for n in (1, 4, 9, 40, 3000):
        x = np.unique(rng.integers(0, 1 << 62, n))
        y = x.copy()
        y[: n // 10] += 1  # a tenth differs: similarity 0.8 or more
        assert (jaccard.bands(x) == jaccard.bands(np.unique(y))).any()
    a, b = rng.integers(0, 1 << 62, 500), rng.integers(0, 1 << 62, 500)
    assert not (jaccard.bands(a) == jaccard.bands(b)).any()


def test_a_distance_beyond_the_blocks_is_refused(spark):
    with pytest.raises(ValueError, match="blocks cover 4 bits"):
        simhash.near_edges(spark.createDataFrame([(1,)], "fingerprint long"), 5)


# ---- line dedup


def similarity_parser(rows, recurs):
    """Line dedup by another parser: a line joins the known template of its leaf that it is most
    similar to, if three quarters of the places agree, and makes it more general; else it founds
    one. rows: (doc_id, text), distinct ids. Where a field's values are rare, both agree."""
    masked = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in re.split(r"[\x20\x09-\x0d]+", line) if w)
    floor = lambda n: min(recurs, 2 if n >= 50 else 3 if n >= 8 else recurs)
    leaves, texts, first, of = {}, {}, {}, {}
    for i, text in sorted(rows):
        for pos, line in enumerate((text or "").split("\n")):
            words = masked(line)
            if not words:
                continue
            known = leaves.setdefault((len(words), words[:3]), [])
            alike = [sum(a == b for a, b in zip(t, words, strict=True)) / len(words) for t in known]
            best = max(range(len(known)), key=alike.__getitem__, default=None)
            if best is None or alike[best] < 0.75:
                best = len(known)
                known.append(list(words))
            known[best] = [a if a == b else None for a, b in zip(known[best], words, strict=True)]
            name = (len(words), words[:3], best)
            texts.setdefault(name, set()).add(text)
            first.setdefault(name, (i, pos))
            of[i, pos] = name
    kept = lambda at: at not in of or len(texts[of[at]]) < floor(of[at][0]) or first[of[at]] == at
    return {i: None if text is None else "\n".join(x for pos, x in enumerate(text.split("\n")) if kept((i, pos))) for i, text in rows}


def letters(k, n=4):
    """A word for a number, without digits."""
    return "".join(chr(97 + k // 26**j % 26) for j in range(n))


def test_line_dedup_matches_a_similarity_parser(spark):
    rng = np.random.default_rng(14)
    word = lambda: letters(int(rng.integers(0, 26**4)))
    shapes = ["user {} logged in from here at the gate", "the file {} was not found on this disk {}", "page 7 of {} books", "a b c d e f g h i {} {} k {}", "the file was {} lost"]
    rows = []
    for i in range(90):
        out = []
        for _ in range(int(rng.integers(0, 7))):
            shape = shapes[int(rng.integers(0, len(shapes)))]
            out.append(shape.format(*[word() for _ in range(shape.count("{}"))]))
        out += [" ".join(word() for _ in range(int(rng.integers(1, 12)))), "", "x  y\t1"]
        rows.append((i, "\n".join(out)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " ".join(["long"] * 20_000)), (104, " ".join(["long"] * 20_000) + "\nand more")]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), recurs=6).collect()}
    assert out == similarity_parser(rows, 6)
    assert sum(len(t or "") for t in out.values()) < sum(len(t or "") for _, t in rows) * 0.9


@pytest.mark.parametrize("count,values", [(1, 10**6), (12, 10**6), (12, 7), (100, 50), (10_000, 50)])
def test_templates_of_one_leaf_are_told_apart(spark, count, values):
    """Four texts of each template, with a field whose values other templates have as well: the
    same verdict for each template, however many share the leaf."""
    rows = []
    for t in range(count):
        for d in range(4):
            value = letters((t + d) % values, 5)
            own = " ".join(letters(k, 3) + c for k, c in zip((t // 100, t % 100) * 4, "stuvwxyz", strict=True))
            rows.append((4 * t + d, f"the log says {value} {own}\n{letters(t, 6)} {letters(d, 3)} own"))
    out = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert out == {i: 0 if i % 4 == 0 else 1 for i, _ in rows}


def test_frequent_values_of_a_field_go_too(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"the user named {('alice', 'bob')[int(rng.integers(0, 2))] if i % 3 else letters(i)} has now logged in from {letters(i * 7 % 400)}") for i in range(300)]
    out = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(n == 0 for n in out.values()) <= 3 and out[0] == 0  # the first of a variant at most


def test_templates_generalise_and_keep_apart(spark):
    rows = [(f"user logged in as {n} from {c}", 1) for n in ("alice", "bob", "carol", "dave") for c in ("paris", "rome")] + [("user logged in with a new name", 1)]
    d = spark.createDataFrame([(hash((len(t.split()), tuple(t.split()[:1]))), 4, i, t, w) for i, (t, w) in enumerate(rows)], "leaf long, floor int, mh long, masked string, w long")
    found = {r["mh"]: r["template"] for r in lines.templates(d, 0.6).collect()}
    assert len({found[i] for i in range(0, 8, 2)}) == 1 and len({found[i] for i in range(1, 8, 2)}) == 1 and 8 not in found


def test_recurring_lines_go_but_for_the_first(spark):
    shared = "Printed from page 17 of our site"
    rows = [(i, f"{chr(97 + i) * 2} own {chr(97 + i) * 4} text\nPrinted from page {i} of our site\n\nend {chr(97 + i) * 3} here", "keep") for i in range(9)]
    rows += [(20, None, "keep"), (21, "", "keep"), (22, shared, "keep"), (22, shared, "keep")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string")
    out = {(r["doc_id"], i): r for i, r in enumerate(lines.dedup_lines(d, recurs=4).orderBy("doc_id").collect())}
    by = {k[0]: r for k, r in out.items()}
    assert len(out) == len(rows)
    assert by[0]["text"] == rows[0][1] and by[0]["n_dropped"] == 0
    assert all(by[i]["text"] == rows[i][1].replace(f"Printed from page {i} of our site\n", "") for i in range(1, 9))
    assert by[20]["text"] is None and by[21]["text"] == "" and by[22]["text"] == ""
    assert lines.dedup_lines(d.limit(0)).count() == 0


def test_longer_lines_recur_in_fewer_texts(spark):
    rng = np.random.default_rng(10)
    prose = lambda n: " ".join(f"w{chr(97 + int(a))}{chr(97 + int(b))}" for a, b in rng.integers(0, 26, (n, 2)))
    long, licence, short = [prose(60) for _ in range(4)], [prose(12) for _ in range(4)], "All rights reserved now"
    texts = []
    for i in range(30):
        # passage and licence k stand in 2, 3, 5 and 10 texts
        body = [prose(30)] + [x[k] for k, n in enumerate((2, 3, 5, 10)) if i < n for x in (long, licence)]
        texts.append("\n".join([*body, short] if i < 19 else body))
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    held = lambda x: sum(x in t.split("\n") for t in out.values())
    assert [held(x) for x in long] == [1, 1, 1, 1]
    assert [held(x) for x in licence] == [2, 1, 1, 1]
    assert held(short) == 19 and all(out[i].split("\n")[0] == t.split("\n")[0] for i, t in enumerate(texts))


def test_copies_count_once(spark):
    d = spark.createDataFrame([(i, "the very same text in all of them", 0) for i in range(50)], "doc_id long, text string, x int")
    assert {r["n_dropped"] for r in lines.dedup_lines(d, recurs=2).collect()} == {0}


# ---- URL filter


def test_hosts_paths_and_rules(spark):
    cases = [
        ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/de", "example.net", "/de", "net/", "block"),
        ("http://notexample.net", "notexample.net", "", None, "allow"), ("x://b.example.com/de/1", "b.example.com", "/de/1", "example.com/de/", "block"),
        ("http://h.org/fr/", "h.org", "/fr/", "org/fr/", "allow"), ("http://forg/fr/", "forg", "/fr/", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"),
        ("http://x.net?a/b", "x.net", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("https://É.example.com#/de/", "É.example.com", "", None, "allow"),
    ]
    d = spark.createDataFrame([(i, c[0], None, "y") for i, c in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(d).collect()}
    for i, c in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == c[1:], c
    assert urls.judge_urls(d.limit(0)).count() == 0


def test_distrust_runs_against_the_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [
        (1, "http://good.org/fr/", link("near.info", "near.info")), (2, "http://bad.net/", link("sink.info")), (3, "http://spam.info/", link("bad.net", "bad.net", "near.info")),
        (4, "http://near.info/", link("far.info")), (5, "http://far.info/", None), (6, "http://sink.info/", None), (7, "http://farm.info/", link("spam.info")),
    ]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge_urls(d).collect()}
    assert {k for k, r in got.items() if r["verdict"] == "block"} == {2, 3, 7}
    # brute force over a dense matrix
    hosts = ["good.org", "bad.net", "spam.info", "near.info", "far.info", "sink.info", "farm.info"]
    w = np.zeros((7, 7))
    for a, b, n in ((0, 3, 2), (1, 5, 1), (2, 1, 2), (2, 3, 1), (3, 4, 1), (6, 2, 1)):
        w[a, b] = n
    for m, seed, column in ((w, 0, "trust"), (w.T, 1, "distrust")):
        share = np.divide(m, m.sum(0, keepdims=True), where=m.sum(0, keepdims=True) > 0, out=np.zeros_like(m))
        s0 = np.eye(7)[seed]
        s = s0.copy()
        for _ in range(urls.ROUNDS):
            s = s0 + 0.85 * s @ share
        for p, u, _ in pages:
            assert got[p][column] == pytest.approx(s[hosts.index(u.split("/")[2])], abs=1e-12)


def test_copies_of_a_graph_give_the_same_verdicts(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    graph = lambda c: [(f"http://bad{c}.net/", ""), (f"http://spam{c}.info/", link(f"bad{c}.net")), (f"http://far{c}.info/", link(f"spam{c}.info")), (f"http://own{c}.info/", "")]
    verdicts = {}
    for copies in (1, 60):
        rows = [(i, *p) for i, p in enumerate(p for c in range(copies) for p in graph(c))]
        out = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        verdicts[copies] = [r["verdict"] for r in sorted(out, key=lambda r: r["page_id"])]
    assert verdicts[60] == verdicts[1] * 60 and verdicts[1] == ["block", "block", "block", "allow"]


def test_verdicts_depend_neither_on_degree_nor_on_unrelated_seeds(spark, monkeypatch):
    """Blocked hosts with 10 to 300,000 hosts that link to them, half of these to a clean one as
    often and nine of ten links of a tenth going there, beside 20,000 blocked hosts of no concern."""
    monkeypatch.setattr(urls, "HUB", 5000)
    link = lambda h: F.concat(F.lit('<a href="http://'), h, F.lit('/">x</a>'))
    parts = []
    for n, k in enumerate((10, 1000, 300_000)):
        bad, clean = F.lit(f"bad{n}.net"), F.lit(f"clean{n}.info")
        html = F.when(F.col("id") % 10 == 0, F.concat(link(bad), F.repeat(link(clean), 9))).when(F.col("id") % 2 == 0, F.concat(link(bad), link(clean))).otherwise(link(bad))
        parts.append(spark.range(k).select((F.lit(n * 10**7) + F.col("id")).alias("page_id"), F.concat(F.lit(f"http://l{n}-"), F.col("id"), F.lit(".info/")).alias("url"), html.alias("html")))
        parts.append(spark.range(1).select((F.lit(n * 10**7 + 10**6)).alias("page_id"), F.lit(f"http://bad{n}.net/").alias("url"), F.lit("").alias("html")))
    parts.append(spark.range(20_000).select((F.lit(9 * 10**7) + F.col("id")).alias("page_id"), F.concat(F.lit("http://other"), F.col("id"), F.lit(".net/")).alias("url"), F.lit("").alias("html")))
    pages = parts[0]
    for p in parts[1:]:
        pages = pages.unionAll(p)
    out = urls.judge_urls(pages, rounds=3)
    got = out.where("host like 'l%'").groupBy(F.substring("host", 1, 2).alias("g"), F.pmod("page_id", F.lit(10)).isin(0).alias("tenth"), "verdict").agg(F.count("*").alias("n"), F.min("distrust").alias("lo"), F.max("distrust").alias("hi")).collect()
    assert {(r["g"], r["tenth"], r["verdict"]) for r in got} == {(f"l{n}", t, "allow" if t else "block") for n in range(3) for t in (True, False)}
    assert {(r["lo"], r["hi"]) for r in got if not r["tenth"]} == {(0.425, 0.85)} and {round(r["hi"], 9) for r in got if r["tenth"]} == {0.085}


# ---- embeddings


def embedding_rows(spark, rows):
    return spark.createDataFrame([(i, [float(v) if v is not None else None for v in r] if r is not None else None, 1) for i, r in rows], "vec_id long, embedding array<float>, n_links int")


def brute_links(rows, threshold=0.9):
    ok = [(i, np.array(r, np.float32).astype(float)) for i, r in rows if r is not None and len(r) and None not in r and np.isfinite(np.array(r, float)).all() and any(r)]
    return [(a, b) for k, (a, x) in enumerate(ok) for b, y in ok[:k] if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold]


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.6])).tolist()) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(40)] + [(800, [v * 3 for v in rows[0][1]])]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 24)]
    got = {r["vec_id"]: r for r in vectors.near_links(embedding_rows(spark, rows), tile=100).collect()}
    pairs = brute_links(rows)
    comp, n = union(pairs, [i for i, _ in rows]), {i: 0 for i, _ in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], comp[i], comp[i] == i)


def test_vector_tiles_of_one_leaf(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAVES", 2)  # so that leaves have many tiles
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + rng.normal(size=6) * 0.4).tolist()) for i in range(900)]
    got = {r["vec_id"]: r for r in vectors.near_links(embedding_rows(spark, rows), tile=64).collect()}
    pairs = brute_links(rows)
    comp, n = union(pairs, [i for i, _ in rows]), {i: 0 for i, _ in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert all((got[i]["n_links"], got[i]["component_id"]) == (n[i], comp[i]) for i, _ in rows)


def test_vectors_without_any_valid_row(spark):
    out = vectors.near_links(embedding_rows(spark, [(1, None), (2, [0.0])])).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in sorted(out)] == [(0, 1, True), (0, 2, True)]
    assert vectors.near_links(embedding_rows(spark, [(1, None)]).limit(0)).count() == 0


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8)).round(1)
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1100, x[3].tolist()), (1200, [0.0] * 8)]
    got = topk.top_k(embedding_rows(spark, rows), F.col("vec_id") % 100 == 0, block=200, queries=3).collect()
    q = {i: [int(np.floor(1024 * float(np.float32(v)))) for v in r] for i, r in rows if r is not None and None not in r and np.isfinite(r).all()}
    want = []
    for a in q:
        if a % 100 == 0:
            s = sorted((-sum(u * v for u, v in zip(q[a], q[b], strict=True)), b) for b in q if b != a)
            want += [(a, k + 1, b, -v) for k, (v, b) in enumerate(s[:10])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.top_k(embedding_rows(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_sorted_lists_never_lose_a_winner():
    rng = np.random.default_rng(7)
    for peaked in (0.1, 5.0):
        x = np.floor(rng.normal(size=(400, 6)) * 100)
        x[:5] *= peaked
        s = topk.SortedLists(x)
        for q in rng.integers(-50, 50, (20, 6)):
            best = np.sort(x @ q)[-10:].min()
            assert set(np.flatnonzero(x @ q >= best)) <= set(s.search(q, 10))


def test_top_k_of_repeated_queries_ties_and_large_values(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 5) / 2]) for i in range(40)] + [(100, [1.0, 0.5, -1.0, 2.0, 0.0])] * 2 + [(100, [2.0, 0.5, -1.0, 2.0, 0.0]), (200, [1.0, 2.0])]
    big = [(300 + i, [1.0e6 - i, 0.9e6, -1.0e6 - i, 1.0, 2.0]) for i in range(15)]  # products beyond 2^53
    for name, found in (("a", rows), ("b", rows + big)):
        at = str(tmp_path / name)
        embedding_rows(spark, found).select("vec_id", "embedding").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
        got = sorted(tuple(r) for r in topk.op9_exact_topk(spark, at).collect())
        c = duckdb.connect()
        c.execute(f"create view embeddings as select * from '{at}/embeddings.parquet/*.parquet'")
        assert got == sorted(c.execute(topk.OP9_SQL).fetchall())
        assert sum(r[0] == 100 for r in got) == 10 and (name == "a" or max(r[3] for r in got) > 2**53)
    with pytest.raises(Exception, match="range of a long"):
        topk.top_k(embedding_rows(spark, [(i, [3.0e15] * 5) for i in range(4)]), F.col("vec_id") == 0).collect()


def test_url_query_matches_its_sql(spark, tmp_path):
    import duckdb

    link = lambda *hosts: "".join(f"<a HREF = 'http://{h}/p'>x</a>" for h in hosts)
    pages = [(i, f"http://h{i % 7}.{'org' if i % 3 else 'net'}/{'fr' if i % 2 else 'x'}/", link(*[f"h{(i * k) % 9}.{'net' if k % 2 else 'info'}" for k in range(1, 4)])) for i in range(40)]
    pages += [(50 + i, f"http://h{i}.info/", link(f"h{i % 3}.net", "deep.info")) for i in range(9)] + [(90, None, None), (91, "http://deep.info", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rows = [tuple(r) for r in urls.op5_url_filter(spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = c.execute(urls.OP5_SQL).fetchall()
    key = lambda r: r[0]
    assert [r[:5] for r in sorted(rows, key=key)] == [r[:5] for r in sorted(want, key=key)]
    assert [v for r in sorted(rows, key=key) for v in r[5:]] == pytest.approx([v for r in sorted(want, key=key) for v in r[5:]])
    assert any(r[3] is None and r[6] > 0 for r in rows)
