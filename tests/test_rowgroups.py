"""The row-group stream: stopped within a row group and restarted, every row once."""

import pyarrow as pa
import pyarrow.parquet as pq

from lumenfold.streaming import rowgroups


def write(path, first, n, group):
    pq.write_table(pa.table({"id": list(range(first, first + n)), "x": [f"t{i}" for i in range(first, first + n)]}), path, row_group_size=group)


def run(spark, source, out, batches=None, batch=70):
    """All that is there, or so many batches."""
    schema = spark.createDataFrame([], "id long, x string, lacking double").schema
    rows = rowgroups.row_stream(spark, source, schema, batch, 25)
    seen = []
    q = None

    def keep(df, number):
        df.write.mode("overwrite").parquet(f"{out}/rows/{number}")
        seen.append(number)
        if batches and len(seen) >= batches:
            raise RuntimeError("stop here")

    q = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").start()
    try:
        q.processAllAvailable()
    except Exception as e:  # noqa: BLE001
        assert "stop here" in str(e)
    finally:
        q.stop()
    return seen


def ids(spark, out):
    return sorted(r["id"] for r in spark.read.parquet(f"{out}/rows/*").collect())


def test_every_row_once_over_restarts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write(source / "a.parquet", 0, 200, 60)
    write(source / "b.parquet", 200, 1, 60)
    first = run(spark, str(source), out, batches=2)  # stops within the second row group, its batch not committed
    assert first == [0, 1] and ids(spark, out) == list(range(140))
    assert run(spark, str(source), out)[0] == 1  # the open batch is made again
    assert ids(spark, out) == list(range(201))
    write(source / "c.parquet", 201, 150, 40)  # a later file
    more = run(spark, str(source), out)
    assert ids(spark, out) == list(range(351)) and len(more) >= 3
    assert {r["lacking"] for r in spark.read.parquet(f"{out}/rows/*").collect()} == {None}
    assert run(spark, str(source), out) == []


def test_slices_are_bounded_and_replayed(tmp_path):
    write(tmp_path / "a.parquet", 0, 100, 30)
    for source in (str(tmp_path), f"file://{tmp_path}", str(tmp_path / "a.parquet")):
        c = rowgroups._Cursor({"path": source, "batch": "45", "slice": "20"})
        at, got = c.initialOffset(), []
        while True:
            part, end = c.read(at)
            part = list(part)
            if not part:
                break
            assert sum(s[3] - s[2] for s in part) <= 45 and all(s[3] - s[2] <= 20 for s in part)
            assert [(s[1], r) for s in c.readBetweenOffsets(at, end) for r in range(s[2], s[3])] == [(s[1], r) for s in part for r in range(s[2], s[3])]
            got += [(s[1], r) for s in part for r in range(s[2], s[3])]
            at = end
        assert got == [(g, r) for g, n in enumerate((30, 30, 30, 10)) for r in range(n)]


def test_the_query_takes_few_batches(spark, tmp_path, monkeypatch):
    """One batch that stops within a row group; the rest isn't cut into batches of that size."""
    from lumenfold.plans import streams

    n = 40_000
    source = tmp_path / "events.parquet"
    pq.write_table(pa.table({"event_id": list(range(n)), "user_id": [i % 7 for i in range(n)], "event_type": ["t"] * n}), source, row_group_size=15_000)
    monkeypatch.setattr(streams, "folder", lambda _: str(tmp_path / "out"))
    got = streams.row_group_stream(spark, str(tmp_path))
    assert sorted(r["event_id"] for r in got.collect()) == list(range(n))
    commits = [p.name for p in tmp_path.glob("out/*/cursor/commits/*") if p.name.isdigit()]
    assert sorted(commits) == ["0", "1"]
