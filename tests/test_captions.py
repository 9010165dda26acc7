"""Caption scores against plain counting."""

import math
import re
from collections import Counter

import pytest

from lumenfold.operators import captions

PAIRS = [
    (1, "A dog runs on the green grass", "a dog runs on grass"), (1, "A dog runs on the green grass", "The dog, the dog!"), (1, "A dog runs on the green grass", "The dog, the dog!"),
    (2, "the dog the dog the dog", "the dog sat"), (2, "the dog the dog the dog", ""), (3, "", "nothing is here"), (4, "only words", None), (5, None, "the dog sat"), (6, "un état", "Un état, un état"),
]


def plain(pairs, n=4):
    grams = lambda t: [Counter((k, " ".join(w[i : i + k])) for w in [[x for x in re.split(r"[\W_]+", (t or "").lower()) if x]] for i in range(len(w) - k + 1)) for k in range(1, n + 1)]
    refs: dict = {}
    for image, _, r in pairs:
        refs.setdefault(image, {}).setdefault(r, []).append(grams(r))
    df = Counter(g for v in refs.values() for g in {g for many in v.values() for c in many[0] for g in c})
    out = {}
    for image, c, _ in pairs:
        weigh = lambda t, m: {g: v * m * (math.log(len(refs)) - math.log(max(1, df[g]))) for g, v in t.items()}
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        scores = []
        for many in refs[image].values():
            if not many[0][0]:
                continue
            s = 0
            for a, b in zip(grams(c), many[0], strict=True):
                a, b = weigh(a, 1), weigh(b, len(many))
                s += sum(min(a[g], b[g]) * b[g] for g in a.keys() & b.keys()) / (norm(a) * norm(b)) if norm(a) * norm(b) else 0
            scores.append(s / n)
        if scores:
            out[image] = 10 * sum(scores) / len(scores)
    return out


@pytest.mark.parametrize("each", [1, 1000])
def test_cider_by_plain_counting(spark, monkeypatch, each):
    monkeypatch.setattr(captions, "TEXTS", each, raising=False)
    got = {r["image"]: r["cider"] for r in captions.cider(spark.createDataFrame(PAIRS, "image long, candidate string, reference string")).collect()}
    assert got == pytest.approx(plain(PAIRS)) and len(got) == 5


def test_grams_are_made_once_and_written(spark):
    """Not once for each of the steps that read them, in tasks as large as the texts' bytes allow."""
    plan = captions.cider(spark.createDataFrame(PAIRS, "image long, candidate string, reference string"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan
