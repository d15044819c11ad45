"""The block-wise CSV reader against Python's csv module and the whole-file reader, cut at every place."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from vacancy_spark.schema import CSV_READ
from vacancy_spark.session import local_path
from vacancy_spark.sources import csv_ranges as C
from vacancy_spark.sources import files
from vacancy_spark.sources.infer import infer_schema, typed

ALPHABET = ["a", "bc", ",", '"', "\n", "\r\n", " ", "é", '""', ",,", "x,y", "\\"]


@pytest.fixture()
def blocks(spark):
    """Sets the size that files are cut at."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], str(size))
    yield cut
    for n, v in old.items():
        spark.conf.set(n, v)


def write(folder, **texts):
    os.makedirs(local_path(folder), exist_ok=True)
    for name, text in texts.items():
        with open(f"{local_path(folder)}/{name}.csv", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return folder


def quoted(value, always):
    if value is None:
        return ""
    return '"' + value.replace('"', '""') + '"' if always or any(c in value for c in ',"\n\r') or not value else value


def table(rng, n, width=3, **options):
    rows = [[None if rng.random() < .1 else "".join(rng.choices(ALPHABET, k=rng.randint(1, 6))) for _ in range(width)]
            for _ in range(n)]
    rows = [[f"{i}", *r[1:]] for i, r in enumerate(rows)]
    end = options.get("end", "\n")
    lines = [",".join(quoted(v, rng.random() < .3) for v in r) + end for r in [options["names"], *rows]]
    return rows, "".join(lines)


@pytest.mark.parametrize("size", [11, 40, 100_000])
def test_every_cut_gives_the_same_records(spark, scratch, blocks, size):
    rng = random.Random(size)
    rows, text = table(rng, 60, names=["id", "second", "third"])
    long = [["60", "v" * 300 + '"' + "\n" * 50, ","], ["61", "last\n", None]]
    text += "".join(",".join(quoted(v, False) for v in r) + "\n" for r in long)
    assert [[v or None for v in r] for r in csv.reader(io.StringIO(text, newline=""))][1:] == [
        [v or None for v in r] for r in rows + long]
    path = write(scratch, one=text.removesuffix("\n"))
    blocks(size)
    got = C.read_csv(spark, path, position="at")
    assert got.rdd.getNumPartitions() >= min(8, len(text) // size)
    got = got.collect()
    assert [list(r)[:3] for r in sorted(got, key=lambda r: r["at"])] == rows + long


def test_agrees_with_the_whole_file_reader(spark, scratch, blocks):
    rng = random.Random(1)
    texts = {f"f{i}": table(rng, 50, names=["id", "b", "c"])[1] + 'e,"",\n' for i in range(4)}
    path = write(scratch, **texts, empty="", header="id,b,c\n")
    whole = sorted(map(tuple, spark.read.options(**CSV_READ).csv(path).collect()), key=str)
    blocks(64)
    assert sorted(map(tuple, C.read_csv(spark, path).collect()), key=str) == whole


def test_carriage_returns(spark, scratch, blocks):
    """Those of line ends go, those inside values stay (Spark's own reader would turn them into line feeds)."""
    rows, text = table(random.Random(2), 80, names=["id", "b", "c"], end="\r\n")
    path = write(scratch, a=text)
    for size in (50, 100_000):
        blocks(size)
        assert sorted(map(list, C.read_csv(spark, path).collect()), key=str) == sorted(rows, key=str)


def test_columns_are_bound_by_name(spark, scratch, blocks):
    path = write(scratch, a="job_id,title\n1,one\n", b="title,extra,job_id\r\n2,x,two\r\n\r\n\"3\n\",y,three\r\n",
                 c=b"\xef\xbb\xbftitle\n4\n")
    want = [("1", "one", None), ("two", "2", "x"), ("three", "3\n", "y"), (None, "4", None)]
    for size in (5, 1000):
        blocks(size)
        df = C.read_csv(spark, path)
        assert df.columns == ["job_id", "title", "extra"]
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    got = files.read_job_export(spark, path).collect()
    assert {(r.job_id, r.title, r.extra) for r in got} == set(want)


@pytest.mark.parametrize("size", [12, 1000])
def test_records_of_a_wrong_length(spark, scratch, blocks, size):
    path = write(scratch, a='k,v\none,two,three\nshort\n"q,\n",w\n"p\n",1,2\nlast,"never closed\nx,y\n')
    blocks(size)
    with pytest.raises(Exception, match="fields instead of"):
        C.read_csv(spark, path).collect()
    with pytest.raises(Exception, match="fields instead of"):  # also where only some columns are read
        C.read_csv(spark, path).select("k").collect()
    with pytest.raises(Exception, match="fields instead of"):
        files.read_job_export(spark, path).count()
    kept = C.read_csv(spark, path, bad_rows="reject")
    assert sorted(map(tuple, kept.collect())) == [("q,\n", "w"), ("short", None)]
    bad = sorted((r.n_fields, r.expected, r.record) for r in C.csv_rejects(spark, path).collect())
    assert bad == [(-1, 2, 'last,"never closed\nx,y\n'), (3, 2, '"p\n",1,2'), (3, 2, "one,two,three")] or \
        bad == [(-1, 2, 'last,"never closed\nx,y'), (3, 2, '"p\n",1,2'), (3, 2, "one,two,three")]
    strict = C.csv_rejects(spark, path, short_rows="bad").collect()
    assert len(strict) == 4 and C.read_csv(spark, path, "reject", "bad").count() == 1


def test_stray_quotes_and_bad_text(spark, scratch, blocks):
    path = write(scratch, a=b'k,v\n5" pipe,a "b" c\n"x"y,z\nbad\xff,\n,""\n')
    for size in (4, 1000):
        blocks(size)
        got = sorted(map(tuple, C.read_csv(spark, path).collect()), key=str)
        assert got == sorted([('5" pipe', 'a "b" c'), ("xy", "z"), ("bad�", None), (None, None)], key=str)


def test_one_large_file_is_read_by_many_tasks(spark, scratch, blocks):
    line = '{0},"two\nlines, ""{0}""",tail\n'
    path = write(scratch, big="id,text,end\n" + "".join(line.format(i) for i in range(60_000)))
    blocks(1 << 18)
    df = C.read_csv(spark, path)
    assert df.rdd.getNumPartitions() > 4
    r = df.agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("s"),
               F.count_if(F.col("text") == F.concat(F.lit('two\nlines, "'), "id", F.lit('"'))).alias("same")).first()
    assert (r.n, r.s, r.same) == (60_000, 60_000 * 59_999 // 2, 60_000)


def test_other_blocks_than_in_the_layout_fail(spark, scratch, blocks):
    path = write(scratch, big="id,text\n" + '1,"a\nb"\n' * 500)
    blocks(300)
    df = C.read_csv(spark, path)
    blocks(501)
    with pytest.raises(Exception, match="other blocks"):
        C._records(spark, path, C.Layout(["id", "text"], ["id", "text"], 300, {}, {})).count()
    blocks(300)
    assert df.count() == 500


def test_types_by_one_aggregate(spark, scratch):
    rows = [("1", "007", "1.5", "2024-01-31", "2024-01-31 10:00:00", "true", None, "12345678901", "x", "1" * 25),
            ("-2", "5", "1e3", "2024-02-01", "2024-02-01", "False", None, "7", "1", "2"), (None,) * 10]
    names = ["int", "id", "double", "date", "time", "flag", "none", "long", "text", "huge"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    kinds = [f.dataType.simpleString() for f in infer_schema(df).fields]
    assert kinds == ["int", "string", "double", "date", "timestamp", "boolean", "string", "bigint", "string", "string"]
    got = typed(df, infer_schema(df)).collect()
    assert got[0].int == 1 and got[0].id == "007" and got[1].double == 1000.0 and got[2] == (None,) * 10
    path = write(scratch, a="id,n\n007,1\n008,2\n")
    loaded, stats = files.load_csv_replace(spark, path, scratch + "-table")
    assert loaded.dtypes == [("id", "string"), ("n", "int")] and stats["rows"] == 2
    again, _ = files.load_csv_replace(spark, path, scratch + "-table", schema=loaded.select("n").schema)
    assert again.dtypes == [("n", "int")]
    with pytest.raises(Exception):  # a value that does not fit: the table stays
        files.load_csv_replace(spark, write(scratch + "-bad", a="n\nx\n"), scratch + "-table", schema=again.schema)
    assert again.count() == 2
    with pytest.raises(ValueError):
        files.load_csv_replace(spark, write(scratch + "-none", a="n\n"), scratch + "-table")
