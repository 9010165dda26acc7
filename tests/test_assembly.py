"""Segments out of colours and captions."""

import pytest

from lumenfold.operators import assembly

CAPTIONS = [
    (1, "<p>dog-2<color>(10,0,0)</color></p> by <p> a <b>cat</b><color>( 0, 200 , 0)</color></p>, <p>dog<color>(0,200,0)</color></p>", "<p>a bird</p>"), (2, None, None), (3, "none", "<p>x<color>(1,2,3)</color></p>"),
    (4, "<p>a,b-1<color>(5,5,5)</color></p>", None), (5, "<p>far<color>(200,200,200)</color></p>", "<p>Cat</p>"),
]
COLOURS = [(1, 12, 0, 0, 5), (1, 10, 1, 0, 2), (1, 0, 201, 0, 7), (1, 0, 0, 0, 90), (1, 4, 0, 0, 50), (2, 9, 9, 9, 3), (4, 5, 5, 5, 4), (4, 255, 255, 255, 1), (5, 3, 3, 3, 8)]


@pytest.fixture()
def given(spark):
    return spark.createDataFrame(CAPTIONS, "image long, caption string, question string"), spark.createDataFrame(COLOURS, "image long, r int, g int, b int, n long")


def test_pixels_of_the_nearest_colour(given):
    got = sorted(tuple(r) for r in assembly.grounded_segments(*given).select("image", "place", "phrase", "r", "g", "b", "n").collect())
    assert got == [(1, 0, "dog-2", 10, 0, 0, 7), (1, 1, "a cat", 0, 200, 0, 7), (4, 0, "a,b-1", 5, 5, 5, 5)]


@pytest.mark.parametrize("strict", [False, True])
def test_segments_and_categories(spark, given, strict):
    known = spark.createDataFrame([(3, "Dog"), (7, "a-cat")], "id long, name string")
    segments, registry = assembly.panoptic_segments(*given, known, strict)
    new = {} if strict else {"a bird": 8, "a,b": 9, "cat": 10, "far": 11}
    assert {r["key"]: r["id"] for r in registry.collect()} == {"dog": 3, "a cat": 7, **new}
    want = [(1, 0, "dog-2", 3, 3002, 2, 7), (1, 1, "a cat", 7, 7000, 0, 7)] + ([] if strict else [(4, 0, "a,b-1", 9, 9001, 1, 5)])
    assert sorted(tuple(r) for r in segments.select("image", "place", "phrase", "category_id", "id", "local", "n").collect()) == want


def test_the_nearest_colour_is_looked_for_once(spark, given):
    """And the texts are searched once, not for each step that reads their phrases."""
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(assembly.grounded_segments(*given)).count("array_min") == 1
    known = spark.createDataFrame([(3, "Dog")], "id long, name string")
    assert "regexp_extract_all" not in plan(assembly.panoptic_segments(*given, known)[0])


def test_no_table_that_grows_goes_through_the_driver(spark, monkeypatch):
    from lumenfold.plans import assembly as plans

    monkeypatch.setattr(plans, "staged", lambda t, label: t, raising=False)
    captions, colours, _ = plans._inputs(spark, "/root/testdata/sf0.001")
    for t in (captions, colours):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("p_partkey") and plan.count("SortMergeJoin") >= 1


def test_many_categories_are_shuffled(spark, given, monkeypatch):
    known = spark.createDataFrame([(3, "Dog")], "id long, name string")
    few = sorted(map(tuple, assembly.panoptic_segments(*given, known)[0].collect()))
    monkeypatch.setattr(assembly, "NAMES", 2, raising=False)
    many = assembly.panoptic_segments(*given, known)[0]
    assert "SortMergeJoin [key#" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == few and few
