"""Tables by deltas and views kept from their changes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchlens.sources import deltas

SCHEMA = "id long, team string, points double, version int, odds map<string,int>"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return deltas.KeyedTable(spark, str(tmp_path / "games"), schema, ["id"], ["version"])


def rows_of(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA)


def read(table):
    return sorted((r.id if r.id is not None else -1, r.team, r.points, r.version) for r in table.read().collect())


def files(table, part):
    return {(p, p.stat().st_mtime_ns) for p in Path(table.path).glob(f"{part}/**/*.parquet")}


def test_newest_row_counts_whatever_the_batch(spark, table):
    assert read(table) == []
    table.append(rows_of(spark, (1, "a", 1.0, 2), (2, "b", None, 1), (None, "n", 0.0, 1)), 0)
    table.append(rows_of(spark, (1, "late", 9.0, 1), (2, "c", 5.0, 2)), 1)
    want = [(-1, "n", 0.0, 1), (1, "a", 1.0, 2), (2, "c", 5.0, 2)]
    assert read(table) == want
    table.append(rows_of(spark, (1, "late", 9.0, 1), (2, "c", 5.0, 2)), 1)  # run again
    assert read(table) == want
    assert table.compact() and read(table) == want
    assert not table.compact()


def test_a_batch_reads_and_rewrites_nothing(spark, table):
    table.append(rows_of(spark, *[(i, "a", 1.0, 1) for i in range(50)]), 0)
    table.compact()
    base, first = files(table, "base-0"), files(table, "deltas/delta_seq=0")
    for path, _ in base:
        path.write_bytes(b"unreadable")
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    broken = files(table, "base-0")
    table.append(rows_of(spark, (7, "b", 2.0, 2)), 1)
    assert files(table, "base-0") == broken and files(table, "deltas/delta_seq=0") == first
    assert [r.team for r in spark.read.parquet(f"{table.path}/deltas/delta_seq=1").collect()] == ["b"]


def test_deltas_before_the_base_are_not_scanned(spark, table, plan_of):
    for seq in range(3):
        table.append(rows_of(spark, (seq, "a", 1.0, 1)), seq)
    table.compact()
    table.append(rows_of(spark, (9, "z", 1.0, 1)), 3)
    scans = [line for line in plan_of(table.read(), "simple").splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("PartitionFilters: [isnotnull(delta_seq" in line and "> 2" in line for line in scans) == 1
    assert [r[0] for r in read(table)] == [0, 1, 2, 9]


def test_a_base_counts_once_it_is_in_the_log(spark, table):
    table.append(rows_of(spark, (1, "a", 1.0, 1)), 0)
    rows_of(spark, (1, "half written", 0.0, 5)).write.parquet(f"{table.path}/base-0")
    assert read(table) == [(1, "a", 1.0, 1)]
    assert table.compact() and read(table) == [(1, "a", 1.0, 1)]


def test_compaction_waits_for_its_share(spark, table):
    table.append(rows_of(spark, *[(i, "a", 1.0, 1) for i in range(10)]), 0)
    assert table.compact(0.5)
    table.append(rows_of(spark, *[(i, "b", 1.0, 2) for i in range(5)]), 1)
    assert not table.compact(0.5)
    table.append(rows_of(spark, (5, "b", 1.0, 2)), 2)
    assert table.compact(0.5)
    assert [r[1] for r in read(table)] == ["b"] * 6 + ["a"] * 4


def test_views_follow_moves_corrections_and_late_rows(spark, table, tmp_path):
    groups = spark.createDataFrame([], "team string").schema
    view = deltas.AdditiveView(spark, str(tmp_path / "view"), groups, ["points"])
    batches = [
        [(1, "a", 1.5, 1), (2, "a", None, 1), (3, None, 4.0, 1), (4, "c", 7.0, 1)],
        [(1, "b", 1.5, 2), (2, "a", 3.0, 2), (2, "a", 9.0, 1), (4, "c", 100.0, 0), (4, "c", 8.0, 1)],
        [(3, "a", None, 2), (5, "d", 1.0, 1)],
    ]
    for seq, batch in enumerate(batches):
        updates = rows_of(spark, *batch)
        for _ in range(2):  # a batch that is run again
            view.apply(table.changes(updates), seq)
        table.append(updates, seq)
        want = table.read().groupBy("team").agg(
            F.count("*").alias("n"), F.sum("points").alias("points_sum"), F.count("points").alias("points_n")
        )
        got = view.read().withColumn("points_sum", F.col("points_sum").cast("double"))
        key = lambda r: str(r.team)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
        if seq == 1:
            assert view.compact(0.1)


def test_a_stream_appends_its_batches(spark, table, tmp_path):
    feed = str(tmp_path / "feed")
    for v in (1, 2, 3):
        rows_of(spark, (1, f"v{v}", 1.0, v), (v + 1, "x", 1.0, 1)).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    query = stream.writeStream.foreachBatch(table.batches()).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert [(r[0], r[1]) for r in read(table)] == [(1, "v3"), (2, "x"), (3, "x"), (4, "x")]
    assert len(list(Path(table.path).glob("deltas/delta_seq=*"))) == 3
