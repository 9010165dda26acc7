"""Words one edit apart against brute force over all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 65):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        l, r, lo, hi = rng.integers(0, n + 1, (4, 300))
        got = sorted(zip(*map(np.ndarray.tolist, tree.report(l, r, lo, hi)), strict=True))
        assert got == sorted((k, int(v)) for k in range(300) for v in values[l[k] : r[k]] if lo[k] <= v < hi[k])


def vocabulary(seed, n, letters="abÿ", longest=9):
    rng = np.random.default_rng(seed)
    return sorted({"".join(rng.choice(list(letters), int(rng.integers(1, longest)))) for _ in range(n)})


@pytest.mark.parametrize("ranges,hot,task", [(3, 20_000, 200_000), (1, 20_000, 50), (2, 3, 40), (9, 1, 1000)])
def test_near_pairs_match_brute_force(spark, ranges, hot, task):
    words = vocabulary(ranges, 220) + ["aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaa", "𝔞bc", "𝔞bd", "bc"]
    n = {w: i + 1 for i, w in enumerate(words)}
    d = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = spelling.near_pairs(d, ranges, hot, task).collect()
    want = sorted((a, b, n[b]) for a in words for b in words if one_edit(a, b))
    assert sorted(map(tuple, got)) == want  # each pair once


def slow(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            counts[low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    out, forms = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            forms[w] = best
        out[w] = len(near)

    def root(w):
        return root(forms[w]) if w in forms else w

    return sorted((w, forms.get(w), root(w), n[w], out[w], n.get(forms.get(w))) for w in n)


def by_word(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def test_variants_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = vocabulary(7, 150, "aBéÀ", 8) + ["K" * 6, "aaaaaaa" * 400]
    rows = [(i if i % 9 else None, " ".join(rng.choice(words, 60)) + "-" + "×÷ İstanbul Kelvin") for i in range(120)]
    rows += [(1, None), (2, ""), (3, "12 34 _"), (4, "Wörter Wörter wörter"), (4, "Wörter Wörter wörter"), (5, "Wörterb" * 3000)]
    rows += [(6, "chain " * 3 + "chains " * 6 + "chainsx " * 12 + "chainsxy " * 24)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(6)
    want = slow(rows)
    assert by_word(spelling.variants(d).collect()) == want
    assert ("chain", "chains", "chainsxy") in [w[:3] for w in want]


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "a b c")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
