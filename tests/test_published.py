"""Tables published by manifest: replacing, merging, backups, left-overs of dead writers."""

import os

import pytest
from pyspark.sql import functions as F

from vacancy_spark.plans import published as P
from vacancy_spark.plans import tables as TB
from vacancy_spark.session import local_path


def files(path):
    return {os.path.join(d, n).removeprefix(local_path(path) + "/") for d, _, names in os.walk(local_path(path))
            for n in names if n.endswith(".parquet")}


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_reader_sees_one_whole_version(spark, scratch):
    P.replace(numbers(spark, 1, 2, 3), scratch)
    before = P.open_table(spark, scratch)
    P.replace(numbers(spark, 7), scratch)
    assert rows(before) == [(1,), (2,), (3,)]  # resolved before: still whole
    assert rows(P.open_table(spark, scratch)) == [(7,)]
    assert rows(P.open_table(spark, scratch, version=1)) == [(1,), (2,), (3,)]
    with pytest.raises(LookupError):
        P.open_table(spark, scratch, version=9)


def test_a_dead_writer_leaves_nothing_that_is_read(spark, scratch):
    P.replace(numbers(spark, 1), scratch, backup="b_backup_2024-01-01_0000")
    numbers(spark, 5).write.parquet(f"{scratch}/data-dead")  # rows written, manifest not
    os.makedirs(local_path(f"{scratch}/_manifests"), exist_ok=True)
    with open(local_path(f"{scratch}/_manifests/v0000000009.json"), "w") as f:
        f.write('{"version": 9, "parts"')  # and a manifest that broke off
    assert rows(P.open_table(spark, scratch)) == [(1,)]
    assert list(P.current(spark, scratch).backups) == ["b_backup_2024-01-01_0000"]
    assert P.vacuum(spark, scratch) == []  # too young: it may be a writer at work
    assert "data-dead" in P.vacuum(spark, scratch, grace_hours=-1)
    assert rows(P.open_table(spark, scratch)) == [(1,)]


def test_two_writers_of_one_version(spark, scratch):
    P.replace(numbers(spark, 1), scratch)
    base = P.current(spark, scratch)
    P.append(numbers(spark, 2), scratch)
    with pytest.raises(P.Conflict):  # based on the version before
        P._next(spark, scratch, base, base.parts)
    assert rows(P.open_table(spark, scratch)) == [(1,), (2,)]


def test_plain_folder_is_taken_over(spark, scratch):
    df = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "k int, d string, v int")
    df.write.partitionBy("d").parquet(scratch)
    assert rows(P.open_table(spark, scratch)) == [(1, 10, "x"), (2, 20, "y")]
    P.replace(spark.createDataFrame([(3, 5.5)], "k int, w double"), scratch, keep_columns=True)
    assert rows(P.open_table(spark, scratch)) == [(3, None, None, 5.5)]
    old = P.open_table(spark, scratch, version=1)
    assert old.columns == ["k", "v", "d"] and rows(old) == [(1, 10, "x"), (2, 20, "y")]
    assert P.current(spark, scratch).version == 2


def test_merge_rewrites_the_partitions_that_match(spark, scratch):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).cast("int").alias("day"),
                                 F.lit("old").alias("v"))
    P.replace(df, scratch, partition_by=["day"])
    before = files(scratch)
    source = spark.createDataFrame([("17", "new"), ("none", "new"), (None, "new")], "k string, v string")
    m, touched = P.merge_into(spark, scratch, source, "k", ["v"])
    assert touched == ["day=7"] and before < files(scratch)
    assert {f.split("/")[1] for f in files(scratch) - before} == {"day=7"}
    got = P.open_table(spark, scratch)
    assert rows(got) == sorted([(str(i), i % 10, "new" if i == 17 else "old") for i in range(300)], key=str)
    live = {f.removeprefix(f"{scratch}/") for f in P.part_paths(scratch, m.parts)}
    assert {x.split("/")[1] for x in live if "/" in x} == {f"day={i}" for i in range(10) if i != 7}
    same, none = P.merge_into(spark, scratch, source.where("k = 'none'"), "k", ["v"])
    assert none == [] and same.version == m.version
    twice = spark.createDataFrame([("3", "a"), ("3", "b")], "k string, v string")
    with pytest.raises(Exception, match="several source rows"):
        P.merge_into(spark, scratch, twice, "k", ["v"])
    for bad in ("day", "k"):
        with pytest.raises(ValueError):
            P.merge_into(spark, scratch, source.withColumn("day", F.lit(1)), "k", [bad])
    assert got.where("day = 3").count() == 30


def test_merge_without_partitions_rewrites_files(spark, scratch):
    df = spark.range(0, 100, 1, 4).select("id", F.lit(0).alias("v"))
    P.replace(df, scratch)
    before = files(scratch)
    m, touched = P.merge_into(spark, scratch, spark.createDataFrame([(3, 1)], "id long, v int"), "id", ["v"])
    assert len(touched) == 1 and len(before) == 4
    assert len([x for p in m.parts if p.only for x in p.only]) == 3
    assert rows(P.open_table(spark, scratch)) == sorted([(i, int(i == 3)) for i in range(100)], key=str)
    m2, again = P.merge_into(spark, scratch, spark.createDataFrame([(3, 2), (90, 2)], "id long, v int"), "id", ["v"])
    assert len(again) == 2
    assert rows(P.open_table(spark, scratch)) == sorted([(i, 2 * (i in (3, 90))) for i in range(100)], key=str)


def test_partitions_are_replaced_and_added(spark, scratch):
    frame = lambda *r: spark.createDataFrame(r, "v int, d string, e int")
    P.replace(frame((1, "a b", 1), (2, "a b", 2), (3, "ü+%", 1), (4, None, 1)), scratch, partition_by=["d", "e"])
    P.replace_partitions(frame((20, "a b", 2), (5, "new", 9)), scratch)
    want = [(1, "a b", 1), (20, "a b", 2), (3, "ü+%", 1), (4, None, 1), (5, "new", 9)]
    assert rows(P.open_table(spark, scratch)) == sorted(want, key=str)
    P.merge_into(spark, scratch, spark.createDataFrame([(3, 1)], "v int, x int").select("v", F.lit(1).alias("x")), "v", [])
    assert rows(P.open_table(spark, scratch)) == sorted(want, key=str)
    for i in range(P.MAX_PARTS + 2):
        P.append(frame((100 + i, "x", i % 2)), scratch)
    assert len(P.current(spark, scratch).parts) <= P.MAX_PARTS
    more = [(100 + i, "x", i % 2) for i in range(P.MAX_PARTS + 2)]
    assert rows(P.open_table(spark, scratch)) == sorted(want + more, key=str)


def test_backups_go_by_manifest(spark, scratch):
    spark.range(1).write.parquet(f"{scratch}/report_backup_2024-01-01_0600._staged-abc")  # of an earlier library
    spark.range(1).write.parquet(f"{scratch}/report_backup_2024-01-01_0600")
    for h in range(1, 4):
        out = TB.snapshot_table(spark, spark.range(h), scratch, "report", f"2024-01-31 0{h}:00", keep=3)
    assert TB.list_backups(spark, scratch, "report") == [f"report_backup_2024-01-31_0{h}00" for h in (3, 2, 1)]
    assert out["removed"] == ["report_backup_2024-01-01_0600"]
    assert TB.open_backup(spark, scratch, "report", "report_backup_2024-01-31_0100").count() == 1
    wide = TB.snapshot_table(spark, spark.range(2).withColumn("x", F.lit(1)), scratch, "report", "2024-01-31 04:00", keep=2)
    assert wide["removed"] == ["report_backup_2024-01-31_0200", "report_backup_2024-01-31_0100"]
    assert TB.open_backup(spark, scratch, "report", "report_backup_2024-01-31_0300").columns == ["id"]
    again = TB.snapshot_table(spark, spark.range(9), scratch, "report", "2024-01-31 04:00", keep=2)
    assert spark.read.parquet(again["current"]).count() == 9 == P.open_table(spark, f"{scratch}/report").count()
    assert os.path.exists(local_path(f"{scratch}/report_backup_2024-01-01_0600._staged-abc"))
