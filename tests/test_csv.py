"""CSV text with quotes, commas, line feeds, more columns and another order; file order; dates."""

import pytest

from vacancy_spark.operators import clean
from vacancy_spark.plans import tables
from vacancy_spark.schema import JOB_EXPORT_COLUMNS
from vacancy_spark.sources import files

ODD = ["plain", 'Senior ""Lead"", officer'.replace('""', '"'), "two\nlines", "two\r\nlines", ' spaced ', '"', 'a""b',
       "back\\slash", 'end\\', None]


def raw(path, text):
    import os
    os.makedirs(path)
    with open(f"{path}/part-0.csv", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def quoted(x):
    return "" if x is None else '"' + x.replace('"', '""') + '"'


@pytest.fixture()
def export_file(scratch):
    names = ["extra", *reversed(JOB_EXPORT_COLUMNS), "organization_id"]
    lines = [",".join(names)]
    for i, t in enumerate(ODD):
        row = {"job_id": str(i), "title": t, "extra": "e,1", "organization_id": f"o{i}"}
        lines.append(",".join(quoted(row.get(n)) for n in names))
    return raw(scratch.removeprefix("file://").removeprefix("file:"), "\n".join(lines) + "\n")


def test_readers_keep_every_row_and_value(spark, export_file):
    rows = files.read_job_export(spark, export_file).orderBy(files.F.col("job_id").cast("int")).collect()
    assert [r.title for r in rows] == ODD
    assert rows[0].asDict().keys() == {*JOB_EXPORT_COLUMNS, "extra", "organization_id"}
    assert {r.extra for r in rows} == {"e,1"} and rows[3].organization_id == "o3"
    assert rows[0].workflow_state is None
    assert files.read_job_export(spark, export_file, columns=["title", "job_id"]).columns == ["title", "job_id"]
    assert sorted(r.title or "" for r in files.read_all_string(spark, export_file).collect()) == sorted(
        t or "" for t in ODD)
    ext = files.register_external_csv(spark, "odd_external", export_file)
    assert ext.count() == len(ODD)
    loaded, stats = files.load_csv_replace(spark, export_file, export_file + "-loaded")
    assert stats["rows"] == len(ODD) and {r.title for r in loaded.collect()} == set(ODD)
    meta = clean.normalise_metadata(files.read_job_export(spark, export_file), "2024-01-31")
    assert {r.organization_id for r in meta.collect()} == {f"o{i}" for i in range(len(ODD))}


def test_importer_mapping_dialect(spark, scratch):
    path = raw(scratch.removeprefix("file://").removeprefix("file:"),
               'importer_name,importer_id\n"A ""b"", c",1\n"two\nlines",2\n')
    got = {r.importer_id: r.importer_name for r in files.read_importer_mapping(spark, path).collect()}
    assert got == {"1": 'A "b", c', "2": "two\nlines"}


@pytest.mark.parametrize("single", [False, True])
def test_export_reads_back(spark, scratch, single):
    df = spark.createDataFrame(list(enumerate(ODD)), "n int, text string")
    tables.export_csv(df, scratch, single_file=single)
    assert sorted(tables.read_csv_like(spark, scratch, df.schema).collect()) == sorted(df.collect())


def test_last_row_of_the_file_wins(spark, scratch):
    path = scratch.removeprefix("file://").removeprefix("file:")
    text = "job_id,title\n" + "".join(f"{i % 40},v{i}\n" for i in range(4000))
    raw(path, text)
    with open(f"{path}/part-1.csv", "w") as f:
        f.write("job_id,title\n7,late\n")
    got = {r.entity_id: r.title for r in files.load_metadata(spark, path, "2024-01-31").collect()}
    assert got == {str(i): "late" if i == 7 else f"v{3960 + i}" for i in range(40)}


def test_iso_dates_are_read_strictly(spark):
    df = spark.createDataFrame([("1", "2024-01-05 09:30:00", "2024-02-01"), ("2", None, "")],
                               "job_id string, publishing_date string, expiration_date string")
    for c in JOB_EXPORT_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, files.F.lit(None).cast("string"))
    rows = clean.normalise_metadata(df, "2024-01-31", None, "iso").orderBy("entity_id").collect()
    assert [str(rows[0].publishing_date), str(rows[0].expiration_date)] == ["2024-01-05 09:30:00", "2024-02-01 00:00:00"]
    assert rows[1].publishing_date is None and rows[1].expiration_date is None
    bad = df.withColumn("publishing_date", files.F.lit("5/1/2024 9:30"))
    with pytest.raises(Exception):
        clean.normalise_metadata(bad, "2024-01-31", None, "iso").collect()
