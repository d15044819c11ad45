"""Registered queries: one per SURVEY section 2 key, each ``(spark, sf_dir) -> DataFrame``,
with the matching DuckDB statement in ``ORACLE``.

Every query reads the driver tables (through the fixture bindings) so its work grows with
the data; parameters (filter values, dimensions, dates) are fixed here so results are
comparable. Queries that exercise a writer write to a fresh folder under the shared
``spark.checkpoint.dir`` and return what they read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle_sql as O
from ..functions import dates as D
from ..functions import regions as R
from ..operators import clean as C
from ..operators import compare as H
from ..operators import cross as X
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import regions as RG
from ..operators import trends as T
from ..operators import vacancy as V
from ..session import fresh_path
from ..sources import events as EV
from ..sources import files as FS
from ..sources import fixtures as FX
from . import tables as TB
from .enrich import enrich, enriched_events, legacy_events
from .materialize import job_events_table, job_export_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = FX.AS_OF


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def W(body: str, *ctes: str) -> str:
    return O.with_base(body, ",\n".join(c for c in ctes if c))


# Fixed parameters of the registered queries -------------------------------------------------
DATE_RANGE = ("2024-01-08", "2024-01-21")
IMPORTERS = ("ATS feed", "ID: 0", "ID: <NA>")
COMPANIES = ("Org 1", "Org 5", "Org 7")
REGIONS = ("EUROPE", "ASIA")
OCCUPATIONS = ("BUILDING", "MACHINERY", "Unknown")
UPGRADES = ("Featured job", "Export job")
TITLE_TERM = "  Red|BLUE b"
HEATMAP_IMPORTERS = ["ATS feed", "Backfill", "Civil Service", "ID: 0", "ID: 3", "ID: 4",
                     "ID: <NA>", "Scrape", "Unknown/Other"]

FILTER_COLS = ("entity_id", "event_date", "event_name", "importer_name", "organization_name",
               "uk_region", "occupation", "title")
FILTER_COLS_SQL = ", ".join(FILTER_COLS)


def _in(values) -> str:
    return "(" + ", ".join(O._q(v) for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(O._q(v) for v in values) + "]"


DATE_SQL = f"CAST(event_date AS DATE) BETWEEN DATE '{DATE_RANGE[0]}' AND DATE '{DATE_RANGE[1]}'"
TITLE_SQL = f"coalesce(regexp_matches(lower(title), {O._q(TITLE_TERM.strip().lower())}), false)"
UPGRADES_SQL = f"coalesce(list_has_any(upgrades_list, {_list(UPGRADES)}), false)"


def _mapping_csv(spark: SparkSession) -> DataFrame:
    """The importer mapping, written as a header CSV and read back through the CSV source."""
    path = fresh_path(spark, "importer_mapping_csv")
    FX.importer_mapping_rows(spark).coalesce(1).write.option("header", True).csv(path)
    return FS.read_importer_mapping(spark, path)


def _metadata(spark: SparkSession, sf_dir: str, null_fill: str | None = "") -> DataFrame:
    return C.normalise_metadata(job_export_table(spark, sf_dir), AS_OF, null_fill)


_LEGACY: dict[tuple, DataFrame] = {}


def _legacy_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy events merged with the job export, regions derived (the previous app's frame).
    The lazy plan is built once per event table and shared by the queries that use it."""
    key = (spark.sparkContext.applicationId, id(job_events_table(spark, sf_dir)))
    if key not in _LEGACY:
        legacy = legacy_events(spark, sf_dir)
        merged = J.merge_job_export(legacy, job_export_table(spark, sf_dir), regions=True)
        _LEGACY[key] = merged
    return _LEGACY[key]


# =============================================================================================
# 2.A sources and sinks
# =============================================================================================

@register("scan_events", W("""SELECT entity_id_str, event_date_parsed, event_name, title_export,
  organization_name, location_region_matched, occupational_fields_export, importer_ID,
  publishing_date, expiration_date, workflow_state, upgrades
FROM job_events WHERE event_date_parsed >= DATE '2024-01-11'
  AND event_name IN ('job_visit', 'job_apply_start')"""))
def q_scan_events(spark, sf_dir):
    return EV.scan_events(job_events_table(spark, sf_dir), AS_OF, days_back=20)


@register("scan_events_legacy", W("SELECT * FROM legacy WHERE event_date >= '20240117'", O.LEGACY_CTE))
def q_scan_events_legacy(spark, sf_dir):
    return EV.scan_events_legacy(legacy_events(spark, sf_dir, with_day=True), AS_OF, days_back=14,
                                 day_col="event_date_parsed")


@register("scan_events_range", W("""SELECT *,
  CAST(floor((CAST(event_date AS BIGINT) - 20200101) / 10000) AS INTEGER) AS event_date_bucket
FROM legacy WHERE event_date >= '20240117'""", O.LEGACY_CTE))
def q_scan_events_range(spark, sf_dir):
    table = TB.rebuild_range_partitioned(legacy_events(spark, sf_dir), fresh_path(spark, "range_events"))
    return EV.scan_events_legacy(table, AS_OF, days_back=14)


@register("read_job_export", W("SELECT * FROM job_export"))
def q_read_job_export(spark, sf_dir):
    path = fresh_path(spark, "job_export_csv")
    TB.export_csv(job_export_table(spark, sf_dir), path)
    return FS.read_job_export(spark, path)


# text that a careless CSV dialect splits, shifts or cuts, plus a column more, in another order
ODD_TITLE_SQL = """title || ' "Lead", officer' || chr(10) || 'a "" b ' AS title"""


@register("read_job_export_quoted", W(f"""SELECT job_id, {ODD_TITLE_SQL}, workflow_state, occupational_fields, locations,
  publishing_date, expiration_date, organization_profile_name, 'full,"time"' AS employment_type,
  CAST(length(title) AS VARCHAR) AS extra FROM job_export"""))
def q_read_job_export_quoted(spark, sf_dir):
    path = fresh_path(spark, "job_export_odd_csv")
    rows = job_export_table(spark, sf_dir).withColumns({
        "extra": F.length("title").cast("string"), "employment_type": F.lit('full,"time"'),
        "title": F.concat("title", F.lit(' "Lead", officer\na "" b '))})
    TB.export_csv(rows.select("employment_type", *reversed(rows.drop("employment_type").columns)), path)
    return FS.read_job_export(spark, path)


@register("export_csv_quoted", W(f"""SELECT entity_id, {ODD_TITLE_SQL}, count(*) AS events FROM
  (SELECT entity_id, title FROM enriched) GROUP BY entity_id, title"""))
def q_export_csv_quoted(spark, sf_dir):
    path = fresh_path(spark, "report_odd_csv")
    rows = (enriched_events(spark, sf_dir).groupBy("entity_id", "title").agg(F.count("*").alias("events"))
            .withColumn("title", F.concat("title", F.lit(' "Lead", officer\na "" b '))))
    TB.export_csv(rows, path)
    return TB.read_csv_like(spark, path, rows.schema)


@register("importer_mapping", W("""SELECT importer_id, importer_name FROM importer_mapping
WHERE importer_id IN (SELECT trim(CAST(importer_ID AS VARCHAR)) FROM job_events WHERE importer_ID IS NOT NULL)"""))
def q_importer_mapping(spark, sf_dir):
    return X.importer_names_in_use(job_events_table(spark, sf_dir), _mapping_csv(spark))


SHEET_SQL = f"""SELECT event_date AS event_data, event_name, organization_name,
  CASE WHEN {O._blank('occupational_fields_export')} THEN 'Unknown'
       ELSE trim(string_split(occupational_fields_export, '|')[1]) END AS occupation,
  locations AS regions, CAST(importer_ID AS VARCHAR) AS importer_id
FROM job_events"""


def _sheet_frame(spark, sf_dir):
    e = C.add_occupation(job_events_table(spark, sf_dir), "occupational_fields_export")
    return e.select(F.col("event_date").alias("event_data"), "event_name", "organization_name",
                    "occupation", F.col("locations").alias("regions"),
                    F.col("importer_ID").cast("string").alias("importer_id"))


@register("read_all_string", W(SHEET_SQL))
def q_read_all_string(spark, sf_dir):
    path = fresh_path(spark, "sheet_csv")
    TB.export_csv(_sheet_frame(spark, sf_dir), path)
    return FS.read_all_string(spark, path)


@register("external_metadata", W("SELECT * FROM metadata", O.metadata_cte(null_fill=None)))
def q_external_metadata(spark, sf_dir):
    path = fresh_path(spark, "metadata_sheet_csv")
    TB.export_csv(job_export_table(spark, sf_dir), path)
    name = "job_metadata_external_" + path.rsplit("-", 1)[-1]
    ext = FS.register_external_csv(spark, name, path)
    return C.normalise_metadata(ext, AS_OF, null_fill=None)


@register("load_csv_replace", W("""SELECT CAST(job_id AS INTEGER) AS job_id, title, workflow_state,
  occupational_fields, locations, publishing_date, expiration_date, organization_profile_name
FROM job_export"""))
def q_load_csv_replace(spark, sf_dir):
    src = fresh_path(spark, "job_export_upload_csv")
    TB.export_csv(job_export_table(spark, sf_dir), src)
    loaded, _stats = FS.load_csv_replace(spark, src, fresh_path(spark, "job_export_table"))
    return loaded


@register("create_metadata_table", W("SELECT * FROM metadata", O.metadata_cte()))
def q_create_metadata_table(spark, sf_dir):
    loc = fresh_path(spark, "job_metadata_table")
    name = "job_metadata_" + loc.rsplit("-", 1)[-1]
    FS.create_metadata_table(spark, name, loc)
    meta = C.dedup_latest(_metadata(spark, sf_dir), "entity_id", "last_updated")
    FS.write_metadata(meta, name)
    return spark.table(name)


@register("metadata_file_order", W("""SELECT * REPLACE (
  CASE WHEN CAST(entity_id AS INTEGER) % 3 = 0 THEN title || ' "new", ' || chr(10) || '2' ELSE title END AS title)
FROM metadata""", O.metadata_cte()))
def q_metadata_file_order(spark, sf_dir):
    """Ids that a later line of the file repeats: the last line wins."""
    path = fresh_path(spark, "job_export_repeated_csv")
    first = job_export_table(spark, sf_dir).withColumn("part", F.lit(0))
    later = (first.where(F.col("job_id").cast("int") % 3 == 0).withColumn("part", F.lit(1))
             .withColumn("title", F.concat("title", F.lit(' "new", \n2'))))
    TB.export_csv(first.unionByName(later).orderBy("part", "job_id").drop("part"), path)
    return FS.load_metadata(spark, path, AS_OF)


@register("external_metadata_iso", W("SELECT * FROM metadata", O.metadata_cte(null_fill=None)))
def q_external_metadata_iso(spark, sf_dir):
    """The SQL load: ISO dates in the external file, read strictly."""
    path = fresh_path(spark, "metadata_iso_csv")
    iso = lambda c: F.date_format(D.parse_dmy_hm(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(c)
    rows = job_export_table(spark, sf_dir)
    TB.export_csv(rows.withColumns({c: iso(c) for c in ("publishing_date", "expiration_date")}), path)
    ext = FS.register_external_csv(spark, "job_metadata_iso_" + path.rsplit("-", 1)[-1], path)
    return C.normalise_metadata(ext, AS_OF, null_fill=None, dates="iso")


TYPED_SQL = """SELECT entity_id AS entity_id_str, CAST(strptime(event_date, '%Y%m%d') AS DATE) AS event_date_parsed,
  event_date AS event_date_original, entity_id AS entity_id_original, event_name, organization_name,
  title, regions, occupations, importer_id, upgrades
FROM legacy"""


@register("typed_events_ctas", W(TYPED_SQL, O.LEGACY_CTE))
def q_typed_events_ctas(spark, sf_dir):
    return TB.rebuild_typed_events(legacy_events(spark, sf_dir), fresh_path(spark, "typed_events"))


@register("range_partition_ctas", W("""SELECT *,
  CASE WHEN TRY_CAST(event_date AS BIGINT) IS NULL THEN NULL
       WHEN TRY_CAST(event_date AS BIGINT) >= 20200101 AND TRY_CAST(event_date AS BIGINT) < 20300101
         THEN CAST(floor((TRY_CAST(event_date AS BIGINT) - 20200101) / 10000) AS INTEGER)
       ELSE -1 END AS event_date_bucket
FROM legacy""", O.LEGACY_CTE))
def q_range_partition_ctas(spark, sf_dir):
    return TB.rebuild_range_partitioned(legacy_events(spark, sf_dir), fresh_path(spark, "range_events"))


@register("overwrite_add_columns", W("SELECT *, CAST(NULL AS VARCHAR) AS legacy_note FROM metadata",
                                     O.metadata_cte()))
def q_overwrite_add_columns(spark, sf_dir):
    path = fresh_path(spark, "metadata_overwrite")
    meta = _metadata(spark, sf_dir)
    old = meta.select("entity_id", "title", "last_updated").withColumn("legacy_note", F.lit("v1"))
    old.write.parquet(path)
    back, _n = TB.overwrite_table(spark, meta, path)
    return back


@register("add_columns", W("""SELECT *, CAST(NULL AS VARCHAR) AS salary_band, CAST(NULL AS BOOLEAN) AS remote
FROM metadata""", O.metadata_cte()))
def q_add_columns(spark, sf_dir):
    return TB.add_columns(_metadata(spark, sf_dir), {"salary_band": "string", "remote": "boolean"})


@register("merge_backfill", W("""SELECT m.entity_id, m.title, m.workflow_state,
  CASE WHEN s.entity_id IS NOT NULL THEN s.occupational_fields ELSE NULL END AS occupational_fields,
  CASE WHEN s.entity_id IS NOT NULL THEN s.locations ELSE NULL END AS locations,
  m.publishing_date, m.expiration_date, m.organization_profile_name, m.organization_id,
  m.employment_type, m.last_updated
FROM metadata m LEFT JOIN src s ON m.entity_id = s.entity_id""", O.metadata_cte(),
    """src AS (SELECT DISTINCT entity_id_str AS entity_id, occupational_fields_export AS occupational_fields,
  locations FROM job_events)"""))
def q_merge_backfill(spark, sf_dir):
    target = (_metadata(spark, sf_dir)
              .withColumn("occupational_fields", F.lit(None).cast("string"))
              .withColumn("locations", F.lit(None).cast("string")))
    ev = job_events_table(spark, sf_dir)
    source = ev.select(F.col("entity_id_str").alias("entity_id"),
                       F.col("occupational_fields_export").alias("occupational_fields"),
                       "locations").distinct()
    merged = TB.merge_update(target, source, "entity_id", ["occupational_fields", "locations"])
    path = fresh_path(spark, "metadata_merged")
    merged.write.parquet(path)
    return spark.read.parquet(path)


VACANCY_REPORT_SQL = O.vacancy_report_sql(DATE_SQL)


def _vacancy_report(spark, sf_dir):
    full = enriched_events(spark, sf_dir)
    return V.vacancy_report_filtered(full, FL.FilterSpec(date_range=DATE_RANGE), AS_OF)


@register("snapshot_table", VACANCY_REPORT_SQL)
def q_snapshot_table(spark, sf_dir):
    folder = fresh_path(spark, "snapshots")
    out = TB.snapshot_table(spark, _vacancy_report(spark, sf_dir), folder, "vacancy_report",
                            "2024-01-31 06:00", keep=3)
    return spark.read.parquet(out["current"])


@register("csv_export", O.benchmark_sql("uk_region"))
def q_csv_export(spark, sf_dir):
    rep = M.benchmark(enriched_events(spark, sf_dir), "uk_region")
    path = TB.export_csv(rep, fresh_path(spark, "benchmark_csv"))
    return TB.read_csv_like(spark, path, rep.schema)


PREVIEW_ORDER = ["event_date_parsed", "entity_id_str", "event_name", "event_date", "title_export",
                 "organization_name", "location_region_matched", "occupational_fields_export",
                 "importer_ID", "publishing_date", "expiration_date", "workflow_state", "upgrades",
                 "locations"]


@register("preview_recent", W("SELECT * FROM job_events WHERE event_date_parsed >= DATE '2024-01-25' ORDER BY "
                              + ", ".join(f"{c} DESC NULLS LAST" if i == 0 else f"{c} ASC NULLS FIRST"
                                          for i, c in enumerate(PREVIEW_ORDER)) + " LIMIT 10"))
def q_preview_recent(spark, sf_dir):
    e = job_events_table(spark, sf_dir).where(F.col("event_date_parsed") >= D.as_date_literal("2024-01-25"))
    order = [F.col(PREVIEW_ORDER[0]).desc_nulls_last()] + [F.col(c).asc_nulls_first() for c in PREVIEW_ORDER[1:]]
    return EV.preview(e, 10, order)


# =============================================================================================
# 2.B projection, cleaning, typing, dedup
# =============================================================================================

@register("prepare_enriched", W("""SELECT entity_id_str AS entity_id, event_date_parsed AS event_date, event_name,
  title_export AS title, organization_name, location_region_matched AS uk_region,
  occupational_fields_export AS occupational_fields, importer_ID, publishing_date AS start_date,
  expiration_date AS end_date, workflow_state, upgrades FROM scanned"""))
def q_prepare_enriched(spark, sf_dir):
    return C.prepare_enriched(EV.scan_events(job_events_table(spark, sf_dir), AS_OF))


@register("importer_names", W("SELECT entity_id, event_date, importer_ID, importer_id_str, importer_name FROM enriched"))
def q_importer_names(spark, sf_dir):
    scanned = EV.scan_events(job_events_table(spark, sf_dir), AS_OF)
    df = enrich(scanned, _mapping_csv(spark))
    return df.select("entity_id", "event_date", "importer_ID", "importer_id_str", "importer_name")


@register("importer_names_raw", W("""SELECT e.entity_id, e.event_date, e.importer_ID, e.importer_id_str,
  coalesce(m.importer_name, e.importer_id_str) AS importer_name
FROM (SELECT entity_id, event_date, importer_ID, importer_id_str FROM enriched) e
LEFT JOIN importer_mapping m ON e.importer_id_str = m.importer_id"""))
def q_importer_names_raw(spark, sf_dir):
    df = C.prepare_enriched(EV.scan_events(job_events_table(spark, sf_dir), AS_OF))
    out = C.apply_importer_mapping(df, FX.importer_mapping_rows(spark), fallback="raw")
    return out.select("entity_id", "event_date", "importer_ID", "importer_id_str", "importer_name")


@register("parse_upgrades", W("""SELECT entity_id, event_date, upgrades,
  array_to_string(upgrades_list, ', ') AS upgrades_joined, CAST(len(upgrades_list) AS INTEGER) AS n_upgrades FROM enriched"""))
def q_parse_upgrades(spark, sf_dir):
    df = enriched_events(spark, sf_dir)
    return df.select("entity_id", "event_date", "upgrades",
                     F.array_join("upgrades_list", ", ").alias("upgrades_joined"),
                     F.size("upgrades_list").alias("n_upgrades"))


@register("upgrade_vocabulary", W("SELECT DISTINCT unnest(upgrades_list) AS upgrade FROM enriched"))
def q_upgrade_vocabulary(spark, sf_dir):
    return C.upgrade_vocabulary(enriched_events(spark, sf_dir))


@register("primary_occupation", W("SELECT entity_id, event_date, occupational_fields, occupation FROM enriched"))
def q_primary_occupation(spark, sf_dir):
    return enriched_events(spark, sf_dir).select("entity_id", "event_date", "occupational_fields", "occupation")


@register("parse_dates", W("SELECT entity_id, event_date, start_date, end_date FROM enriched"))
def q_parse_dates(spark, sf_dir):
    return enriched_events(spark, sf_dir).select("entity_id", "event_date", "start_date", "end_date")


@register("parse_yyyymmdd", W("""SELECT entity_id, event_date, CAST(try_strptime(event_date, '%Y%m%d') AS DATE)
  AS event_date_parsed FROM legacy""", O.LEGACY_CTE))
def q_parse_yyyymmdd(spark, sf_dir):
    df = legacy_events(spark, sf_dir).select("entity_id", "event_date")
    return C.parse_yyyymmdd_column(df, "event_date", out="event_date_parsed")


@register("parse_dmy_timestamp", W("""SELECT job_id, publishing_date, expiration_date,
  try_strptime(publishing_date, '%d/%m/%Y %H:%M') AS start_date,
  try_strptime(expiration_date, '%d/%m/%Y %H:%M') AS end_date FROM job_export"""))
def q_parse_dmy_timestamp(spark, sf_dir):
    x = job_export_table(spark, sf_dir)
    return x.select("job_id", "publishing_date", "expiration_date",
                    D.parse_dmy_hm("publishing_date").alias("start_date"),
                    D.parse_dmy_hm("expiration_date").alias("end_date"))


@register("normalise_metadata", W("SELECT * FROM metadata", O.metadata_cte()))
def q_normalise_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir)


@register("dedup_latest", W("""SELECT entity_id,
  CASE WHEN workflow_state = 'published' THEN upper(title) ELSE title END AS title,
  CASE WHEN workflow_state = 'published' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_updated END AS last_updated
FROM metadata""", O.metadata_cte()))
def q_dedup_latest(spark, sf_dir):
    old = _metadata(spark, sf_dir).select("entity_id", "title", "last_updated")
    new = (C.normalise_metadata(job_export_table(spark, sf_dir), "2024-02-01")
           .where(F.col("workflow_state") == "published")
           .select("entity_id", F.upper("title").alias("title"), "last_updated"))
    return C.dedup_latest(old.unionByName(new), "entity_id", "last_updated")


JOB_DETAIL_COLS = ["entity_id", "event_date", "event_name", "title", "organization_name", "uk_region",
                   "occupation", "importer_name", "workflow_state", "start_date", "end_date", "upgrades"]


@register("job_details", W(f"""SELECT {', '.join(JOB_DETAIL_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_date DESC, event_name DESC) AS rn
  FROM enriched) WHERE rn = 1"""))
def q_job_details(spark, sf_dir):
    df = enriched_events(spark, sf_dir).select(*JOB_DETAIL_COLS)
    return C.first_row_per(df, "entity_id")


@register("select_columns", W("SELECT event_date, event_name, organization_name, occupation, importer_name FROM enriched"))
def q_select_columns(spark, sf_dir):
    return C.select_columns(enriched_events(spark, sf_dir))


# =============================================================================================
# 2.C address -> region
# =============================================================================================

def _region_rows(spark, sf_dir, **cols):
    e = job_events_table(spark, sf_dir)
    return e.select("entity_id_str", "event_date", "locations", *[v.alias(k) for k, v in cols.items()])


def _region_sql(**cols):
    sel = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return W(f"SELECT entity_id_str, event_date, locations, {sel} FROM job_events")


@register("postcode_outward", _region_sql(outward=O.outward_sql("locations")))
def q_postcode_outward(spark, sf_dir):
    return _region_rows(spark, sf_dir, outward=R.postcode_outward("locations"))


@register("region_by_postcode", _region_sql(region_reference=O.region_postcode_sql("locations"),
                                            region_area=O.region_postcode_sql("locations", "area")))
def q_region_by_postcode(spark, sf_dir):
    return _region_rows(spark, sf_dir, region_reference=R.region_from_postcode("locations"),
                        region_area=R.region_from_postcode("locations", "area"))


@register("region_by_city", _region_sql(region_city=O.region_city_sql("locations")))
def q_region_by_city(spark, sf_dir):
    return _region_rows(spark, sf_dir, region_city=R.region_from_city("locations"))


@register("region_by_keyword", _region_sql(region_keyword=O.region_keyword_sql("locations")))
def q_region_by_keyword(spark, sf_dir):
    return _region_rows(spark, sf_dir, region_keyword=R.region_from_keyword("locations"))


@register("region_from_address", _region_sql(uk_region=O.region_address_sql("locations"),
                                             uk_region_area=O.region_address_sql("locations", "area")))
def q_region_from_address(spark, sf_dir):
    return _region_rows(spark, sf_dir, uk_region=R.region_from_address("locations"),
                        uk_region_area=R.region_from_address("locations", "area"))


@register("region_from_locations", _region_sql(uk_region=O.region_locations_sql("locations")))
def q_region_from_locations(spark, sf_dir):
    return _region_rows(spark, sf_dir, uk_region=R.region_from_locations("locations"))


LEGACY_MERGED_CTE = f"""merged AS (
  SELECT l.*, x.title AS title_from_jobiqo, x.publishing_date AS start_date,
         x.expiration_date AS end_date, x.organization_profile_name AS organization_name_jobiqo,
         x.locations AS location_full
  FROM legacy l LEFT JOIN job_export x ON l.entity_id = x.job_id),
legacy_regions AS (
  SELECT merged.*, {O.region_locations_sql('location_full')} AS uk_region,
         coalesce(m.importer_name, 'ID: ' || coalesce(trim(CAST(merged.importer_id AS VARCHAR)), '<NA>')) AS importer_name
  FROM merged LEFT JOIN importer_mapping m
    ON coalesce(trim(CAST(merged.importer_id AS VARCHAR)), '<NA>') = m.importer_id)"""


@register("add_region_column", W("SELECT entity_id, event_date, regions, location_full, uk_region FROM legacy_regions",
                                 O.LEGACY_CTE, LEGACY_MERGED_CTE))
def q_add_region_column(spark, sf_dir):
    return _legacy_merged(spark, sf_dir).select("entity_id", "event_date", "regions", "location_full", "uk_region")


@register("region_summary", W(f"""SELECT {O.region_address_sql('regions')} AS uk_region, count(*) AS count
FROM legacy GROUP BY 1""", O.LEGACY_CTE))
def q_region_summary(spark, sf_dir):
    return RG.region_summary(legacy_events(spark, sf_dir), "regions")


# =============================================================================================
# 2.D filters, predicates, facets
# =============================================================================================

def _filter_query(spec: FL.FilterSpec):
    def q(spark, sf_dir):
        return FL.apply_filters(enriched_events(spark, sf_dir), spec).select(*FILTER_COLS)
    return q


def _filter_sql(where: str) -> str:
    return W(f"SELECT {FILTER_COLS_SQL} FROM enriched WHERE {where}")


register("filter_date_range", _filter_sql(DATE_SQL))(_filter_query(FL.FilterSpec(date_range=DATE_RANGE)))
register("filter_importer", _filter_sql(f"importer_name IN {_in(IMPORTERS)}"))(
    _filter_query(FL.FilterSpec(importer=IMPORTERS)))
register("filter_company", _filter_sql(f"organization_name IN {_in(COMPANIES)}"))(
    _filter_query(FL.FilterSpec(company=COMPANIES)))
register("filter_region", _filter_sql(f"uk_region IN {_in(REGIONS)}"))(
    _filter_query(FL.FilterSpec(region=REGIONS)))
register("filter_occupation", _filter_sql(f"occupation IN {_in(OCCUPATIONS)}"))(
    _filter_query(FL.FilterSpec(occupation=OCCUPATIONS)))
register("filter_upgrades_any", _filter_sql(UPGRADES_SQL))(_filter_query(FL.FilterSpec(upgrades=UPGRADES)))
register("filter_title_search", _filter_sql(TITLE_SQL))(_filter_query(FL.FilterSpec(job_title=TITLE_TERM)))

COMBINED_SPEC = FL.FilterSpec(date_range=DATE_RANGE, importer=IMPORTERS + ("Scrape", "Backfill"),
                              occupation=OCCUPATIONS, upgrades=("Boosted job",), job_title="a")
COMBINED_SQL = (f"{DATE_SQL} AND importer_name IN {_in(IMPORTERS + ('Scrape', 'Backfill'))} "
                f"AND occupation IN {_in(OCCUPATIONS)} "
                f"AND coalesce(list_has_any(upgrades_list, ['Boosted job']), false) "
                f"AND coalesce(regexp_matches(lower(title), 'a'), false)")
register("filter_combined", _filter_sql(COMBINED_SQL))(_filter_query(COMBINED_SPEC))


@register("filter_organisation_export", W(
    "SELECT entity_id, event_date, event_name, organization_name_jobiqo FROM legacy_regions "
    "WHERE organization_name_jobiqo IN ('Org 2', 'Org 3')", O.LEGACY_CTE, LEGACY_MERGED_CTE))
def q_filter_organisation_export(spark, sf_dir):
    df = FL.apply_filters(_legacy_merged(spark, sf_dir), FL.FilterSpec(organisation_export=("Org 2", "Org 3")))
    return df.select("entity_id", "event_date", "event_name", "organization_name_jobiqo")


@register("filter_event_names", W("""SELECT entity_id_str, event_date_parsed, event_name FROM job_events
WHERE event_name IN ('job_visit', 'signup')"""))
def q_filter_event_names(spark, sf_dir):
    e = job_events_table(spark, sf_dir)
    return FL.apply_filters(e, FL.FilterSpec(event_names=("job_visit", "signup"))).select(
        "entity_id_str", "event_date_parsed", "event_name")


@register("facet_options", W("""SELECT DISTINCT dimension, value FROM (
  SELECT 'importer' AS dimension, importer_name AS value FROM enriched
  UNION ALL SELECT 'company', organization_name FROM enriched
  UNION ALL SELECT 'region', uk_region FROM enriched
  UNION ALL SELECT 'occupation', occupation FROM enriched
  UNION ALL SELECT 'upgrade', unnest(upgrades_list) FROM enriched) WHERE value IS NOT NULL"""))
def q_facet_options(spark, sf_dir):
    return FL.facet_options(enriched_events(spark, sf_dir))


@register("facet_options_sheet", W(f"""SELECT DISTINCT dimension, value FROM (
  SELECT 'event' AS dimension, event_name AS value FROM ({SHEET_SQL})
  UNION ALL SELECT 'importer', importer_id FROM ({SHEET_SQL})
  UNION ALL SELECT 'company', organization_name FROM ({SHEET_SQL})
  UNION ALL SELECT 'occupation', occupation FROM ({SHEET_SQL})
  UNION ALL SELECT 'region', regions FROM ({SHEET_SQL})) WHERE value IS NOT NULL"""))
def q_facet_options_sheet(spark, sf_dir):
    return FL.facet_options(_sheet_frame(spark, sf_dir), {
        "event": "event_name", "importer": "importer_id", "company": "organization_name",
        "occupation": "occupation", "region": "regions"})


@register("date_bounds", W("""SELECT min(event_date) AS min_date, max(event_date) AS max_date,
  greatest(DATE '2023-08-04', min(event_date)) AS default_start FROM enriched"""))
def q_date_bounds(spark, sf_dir):
    return FL.date_bounds(enriched_events(spark, sf_dir), AS_OF, months=6)


@register("filter_vacancy_overlap", _filter_sql(
    f"CAST(start_date AS DATE) <= DATE '{DATE_RANGE[1]}' AND CAST(end_date AS DATE) >= DATE '{DATE_RANGE[0]}' "
    f"AND {DATE_SQL}"))
def q_filter_vacancy_overlap(spark, sf_dir):
    spec = FL.FilterSpec(date_range=DATE_RANGE, vacancy_active=True)
    return FL.apply_filters(enriched_events(spark, sf_dir), spec).select(*FILTER_COLS)


def _legacy_report_sql(src: str, region_expr: str = "max(uk_region)", where: str = "") -> str:
    return f"""SELECT title, organisation, job_id, start_date, end_date, region, total_clicks,
       total_apply_start, apply_click_ratio_pct FROM (
  SELECT max(title) AS title, max(organization_name) AS organisation, entity_id AS job_id,
         max(start_date) AS start_date, max(end_date) AS end_date, {region_expr} AS region,
         count(*) FILTER (WHERE event_name = 'job_visit') AS total_clicks,
         count(*) FILTER (WHERE event_name = 'job_apply_start') AS total_apply_start,
         CASE WHEN count(*) FILTER (WHERE event_name = 'job_visit') > 0
              THEN round_even(count(*) FILTER (WHERE event_name = 'job_apply_start')
                              / count(*) FILTER (WHERE event_name = 'job_visit') * 100, 2)
              ELSE 0.0 END AS apply_click_ratio_pct
  FROM {src} GROUP BY entity_id) {where}"""


@register("filter_vacancy_table", W(_legacy_report_sql(
    "legacy_regions", where="WHERE region IN ('North West', 'Unknown') AND organisation IN ('Org 1', 'Org 4', 'Org 6')"),
    O.LEGACY_CTE, LEGACY_MERGED_CTE))
def q_filter_vacancy_table(spark, sf_dir):
    rep = V.vacancy_report_legacy(legacy_events(spark, sf_dir), export=job_export_table(spark, sf_dir))
    return FL.filter_vacancies(rep, ("North West", "Unknown"), ("Org 1", "Org 4", "Org 6"),
                               "region", "organisation")


# =============================================================================================
# 2.E joins
# =============================================================================================

JOIN_METADATA_SQL = W("""SELECT e.entity_id, e.event_name, e.event_date, e.organization_name, e.regions,
  e.upgrades, e.importer_id, m.title, m.workflow_state, m.occupational_fields, m.locations AS location_full,
  m.publishing_date AS start_date, m.expiration_date AS end_date,
  m.organization_profile_name AS organization_name_jobiqo, m.employment_type
FROM legacy e LEFT JOIN metadata m ON e.entity_id = m.entity_id
WHERE e.event_name IN ('job_visit', 'job_apply_start')""", O.LEGACY_CTE, O.metadata_cte())


@register("join_metadata", JOIN_METADATA_SQL)
def q_join_metadata(spark, sf_dir):
    meta = C.dedup_latest(_metadata(spark, sf_dir), "entity_id", "last_updated")
    return J.join_metadata(legacy_events(spark, sf_dir), meta)


@register("merge_job_export", W("""SELECT entity_id, event_date, event_name, title, title_from_jobiqo,
  start_date, end_date, organization_name_jobiqo, location_full FROM merged""", O.LEGACY_CTE,
    LEGACY_MERGED_CTE.split(",\nlegacy_regions")[0]))
def q_merge_job_export(spark, sf_dir):
    m = J.merge_job_export(legacy_events(spark, sf_dir), job_export_table(spark, sf_dir))
    return m.select("entity_id", "event_date", "event_name", "title", "title_from_jobiqo", "start_date",
                    "end_date", "organization_name_jobiqo", "location_full")


DAILY_TREND_SQL = W("""SELECT CAST(event_date AS DATE) AS event_date,
  count(*) FILTER (WHERE event_name = 'job_visit') AS clicks,
  count(*) FILTER (WHERE event_name = 'job_apply_start') AS applies
FROM enriched GROUP BY 1 HAVING clicks > 0 OR applies > 0""")


@register("daily_trend_outer_join", DAILY_TREND_SQL)
def q_daily_trend_outer_join(spark, sf_dir):
    return T.daily_trend_outer_join(enriched_events(spark, sf_dir))


@register("unmatched_events", W("""SELECT count(*) AS unmatched_events FROM legacy e
WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.entity_id = e.entity_id)""", O.LEGACY_CTE, O.metadata_cte()))
def q_unmatched_events(spark, sf_dir):
    return J.unmatched_events(legacy_events(spark, sf_dir), _metadata(spark, sf_dir))


@register("key_mismatch", W("""SELECT DISTINCT entity_id AS key, 'events_only' AS side FROM legacy
WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM metadata)
UNION ALL
SELECT DISTINCT entity_id AS key, 'metadata_only' AS side FROM metadata
WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM legacy WHERE entity_id IS NOT NULL)""",
    O.LEGACY_CTE, O.metadata_cte()))
def q_key_mismatch(spark, sf_dir):
    return J.key_mismatch(legacy_events(spark, sf_dir), _metadata(spark, sf_dir))


# =============================================================================================
# 2.F aggregations
# =============================================================================================

@register("kpi_metrics", O.kpi_sql())
def q_kpi_metrics(spark, sf_dir):
    return M.kpi_metrics(enriched_events(spark, sf_dir))


@register("vacancy_counts", W("""SELECT entity_id, count(*) FILTER (WHERE event_name = 'job_visit') AS clicks,
  count(*) FILTER (WHERE event_name = 'job_apply_start') AS applies FROM enriched GROUP BY entity_id"""))
def q_vacancy_counts(spark, sf_dir):
    return M.vacancy_counts(enriched_events(spark, sf_dir))


@register("basic_totals", W("""SELECT count(DISTINCT entity_id) AS num_vacancies,
  count(*) FILTER (WHERE event_name = 'job_visit') AS total_clicks,
  count(*) FILTER (WHERE event_name = 'job_apply_start') AS total_applies FROM enriched"""))
def q_basic_totals(spark, sf_dir):
    return M.basic_totals(enriched_events(spark, sf_dir))


PV_CTE = """pv AS (SELECT entity_id,
  CASE WHEN entity_id IS NULL THEN 0 ELSE count(*) FILTER (WHERE event_name = 'job_visit') END AS clicks,
  CASE WHEN entity_id IS NULL THEN 0 ELSE count(*) FILTER (WHERE event_name = 'job_apply_start') END AS applies
  FROM enriched GROUP BY entity_id)"""


def _quartile_sql() -> str:
    groups = {"top_25": "clicks >= q3", "middle_50": "clicks >= q1 AND clicks < q3", "bottom_25": "clicks < q1"}
    parts = []
    for g, cond in groups.items():
        parts.append(f"""SELECT '{g}' AS quartile, count(*) FILTER (WHERE {cond}) AS num_vacancies,
  CAST(coalesce(sum(clicks) FILTER (WHERE {cond}), 0) AS BIGINT) AS total_clicks,
  CAST(coalesce(sum(applies) FILTER (WHERE {cond}), 0) AS BIGINT) AS total_applies
FROM pv, th WHERE n >= 4 GROUP BY n, q1, q3""")
    body = f"""SELECT quartile, num_vacancies, total_clicks, total_applies,
  CASE WHEN total_clicks > 0 THEN total_applies / total_clicks * 100 ELSE 0.0 END AS apply_click_ratio,
  CASE WHEN num_vacancies > 0 THEN total_clicks / num_vacancies ELSE 0.0 END AS clicks_per_vacancy,
  CASE WHEN num_vacancies > 0 THEN total_applies / num_vacancies ELSE 0.0 END AS applies_per_vacancy
FROM ({' UNION ALL '.join(parts)})"""
    return W(body, PV_CTE, """th AS (SELECT quantile_cont(clicks, 0.25) AS q1, quantile_cont(clicks, 0.75) AS q3,
  count(*) AS n FROM pv)""")


@register("quartile_metrics", _quartile_sql())
def q_quartile_metrics(spark, sf_dir):
    return M.quartile_metrics(enriched_events(spark, sf_dir))


IQR_CTE = """th AS (SELECT quantile_cont(clicks, 0.25) AS q1, quantile_cont(clicks, 0.75) AS q3,
  count(clicks) AS n FROM pv)"""
IQR_WHERE = "(n < 4 OR clicks BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"


@register("iqr_filter", W(f"SELECT entity_id, clicks, applies FROM pv, th WHERE {IQR_WHERE}", PV_CTE, IQR_CTE))
def q_iqr_filter(spark, sf_dir):
    return M.remove_outliers_iqr(M.per_vacancy(enriched_events(spark, sf_dir)), "clicks")


@register("iqr_mean_clicks", W(f"""SELECT count(*) AS vacancies_kept, avg(clicks) AS iqr_mean_clicks,
  avg(applies) AS iqr_mean_applies FROM pv, th WHERE {IQR_WHERE}""", PV_CTE, IQR_CTE))
def q_iqr_mean_clicks(spark, sf_dir):
    return M.iqr_mean(enriched_events(spark, sf_dir))


for _key, _dim in (("benchmark_importer", "importer_name"), ("benchmark_region", "uk_region"),
                   ("benchmark_occupation", "occupation"), ("benchmark_company", "organization_name")):
    register(_key, O.benchmark_sql(_dim))(
        lambda spark, sf_dir, _d=_dim: M.benchmark(enriched_events(spark, sf_dir), _d))

for _key, _dim in (("overview_importer", "importer_name"), ("overview_region", "uk_region")):
    register(_key, O.overview_sql(_dim))(
        lambda spark, sf_dir, _d=_dim: M.overview_by(enriched_events(spark, sf_dir), _d))


@register("daily_trend", DAILY_TREND_SQL)
def q_daily_trend(spark, sf_dir):
    return T.daily_trend(enriched_events(spark, sf_dir))


@register("daily_counts", W("""SELECT CAST(try_strptime(event_date, '%Y%m%d') AS DATE) AS date, count(*) AS count
FROM legacy WHERE try_strptime(event_date, '%Y%m%d') IS NOT NULL GROUP BY 1""", O.LEGACY_CTE))
def q_daily_counts(spark, sf_dir):
    df = C.parse_yyyymmdd_column(legacy_events(spark, sf_dir), "event_date")
    return T.daily_counts(df, "event_date")


CELLS_SQL_BODY = """SELECT uk_region, importer_name,
  CAST(sum(clicks) AS BIGINT) / count(entity_id) AS clicks_per_vacancy,
  CAST(sum(applies) AS BIGINT) / count(entity_id) AS applies_per_vacancy,
  CASE WHEN sum(clicks) > 0 THEN CAST(sum(applies) AS BIGINT) / CAST(sum(clicks) AS BIGINT) * 100 ELSE 0.0 END
    AS apply_click_ratio
FROM (SELECT uk_region, importer_name, entity_id,
        count(*) FILTER (WHERE event_name = 'job_visit') AS clicks,
        count(*) FILTER (WHERE event_name = 'job_apply_start') AS applies
      FROM enriched WHERE uk_region IS NOT NULL AND importer_name IS NOT NULL
      GROUP BY uk_region, importer_name, entity_id)
GROUP BY uk_region, importer_name"""


@register("heatmap_cells", W(CELLS_SQL_BODY))
def q_heatmap_cells(spark, sf_dir):
    return X.cross_metrics(enriched_events(spark, sf_dir))


def _pivot_sql(metric: str) -> str:
    return W("SELECT uk_region, " + ", ".join(
        f"max({metric}) FILTER (WHERE importer_name = {O._q(v)}) AS \"{v}\"" for v in HEATMAP_IMPORTERS)
        + f" FROM ({CELLS_SQL_BODY}) GROUP BY uk_region")


# the heatmap's three metric choices
for _key, _metric in (("heatmap_pivot", "clicks_per_vacancy"),
                      ("heatmap_pivot_applies", "applies_per_vacancy"),
                      ("heatmap_pivot_ratio", "apply_click_ratio")):
    register(_key, _pivot_sql(_metric))(
        lambda spark, sf_dir, _m=_metric: X.heatmap(enriched_events(spark, sf_dir), _m))


def _top_sql(col: str, n: int | None = 10) -> str:
    lim = f" ORDER BY count DESC, {col} ASC LIMIT {n}" if n else ""
    return W(f"SELECT {col}, count(*) AS count FROM enriched WHERE {col} IS NOT NULL GROUP BY {col}{lim}")


register("top_occupations", _top_sql("occupation"))(
    lambda spark, sf_dir: X.top_values(enriched_events(spark, sf_dir), "occupation", 10))
register("top_regions", _top_sql("uk_region"))(
    lambda spark, sf_dir: X.top_values(enriched_events(spark, sf_dir), "uk_region", 10))
register("top_importers", _top_sql("importer_name"))(
    lambda spark, sf_dir: X.top_values(enriched_events(spark, sf_dir), "importer_name", 10))
register("region_distribution", _top_sql("uk_region", None))(
    lambda spark, sf_dir: X.value_counts(enriched_events(spark, sf_dir), "uk_region"))


@register("card_metrics", W(f"""SELECT count(*) AS total_records, count(DISTINCT organization_name) AS unique_organizations,
  count(DISTINCT occupation) AS unique_occupations, count(DISTINCT regions) AS unique_regions FROM ({SHEET_SQL})"""))
def q_card_metrics(spark, sf_dir):
    return M.card_metrics(_sheet_frame(spark, sf_dir))


@register("dataset_totals", W("SELECT count(*) AS total_events, count(DISTINCT entity_id) AS unique_vacancies FROM enriched"))
def q_dataset_totals(spark, sf_dir):
    return M.dataset_totals(enriched_events(spark, sf_dir))


@register("conversion_funnel", W("""SELECT 'Vacancies' AS stage, count(DISTINCT entity_id) AS count FROM enriched
UNION ALL SELECT 'Clicks', count(*) FILTER (WHERE event_name = 'job_visit') FROM enriched
UNION ALL SELECT 'Applies', count(*) FILTER (WHERE event_name = 'job_apply_start') FROM enriched"""))
def q_conversion_funnel(spark, sf_dir):
    return M.conversion_funnel(enriched_events(spark, sf_dir))


@register("table_verification", W("""SELECT count(*) AS total_rows, min(event_date_parsed) AS min_date,
  max(event_date_parsed) AS max_date, count(DISTINCT entity_id_str) AS unique_entities FROM job_events"""))
def q_table_verification(spark, sf_dir):
    return M.verify_table(job_events_table(spark, sf_dir))


@register("mapping_audit", W("""SELECT DISTINCT e.importer_id_str AS importer_id,
  coalesce(m.importer_name, 'NOT FOUND') AS mapped_name
FROM enriched e LEFT JOIN importer_mapping m ON e.importer_id_str = m.importer_id"""))
def q_mapping_audit(spark, sf_dir):
    return X.mapping_audit(enriched_events(spark, sf_dir), FX.importer_mapping_rows(spark))


@register("importer_record_counts", W("SELECT importer_name, count(*) AS records FROM enriched GROUP BY importer_name"))
def q_importer_record_counts(spark, sf_dir):
    return X.importer_record_counts(enriched_events(spark, sf_dir))


# =============================================================================================
# 2.G vacancy report
# =============================================================================================

@register("vacancy_report", VACANCY_REPORT_SQL)
def q_vacancy_report(spark, sf_dir):
    return _vacancy_report(spark, sf_dir)


@register("vacancy_days_active", W(f"""SELECT entity_id AS job_id, start_date, end_date, workflow_state AS status,
  CASE WHEN {O.days_raw_sql()} > 0 THEN CAST({O.days_raw_sql()} AS INTEGER) END AS days_active FROM vt""",
    O.vacancy_table_cte("vt", "enriched")))
def q_vacancy_days_active(spark, sf_dir):
    return V.days_active(enriched_events(spark, sf_dir), AS_OF)


@register("occupation_benchmark", W("""SELECT occupation, round_even(avg(clicks), 1) AS avg_clicks_occupation,
  round_even(avg(applies), 1) AS avg_applies_occupation FROM vt GROUP BY occupation""",
    O.vacancy_table_cte("vt", "enriched")))
def q_occupation_benchmark(spark, sf_dir):
    return V.occupation_benchmark(enriched_events(spark, sf_dir))


@register("vacancy_totals", O.vacancy_report_sql(DATE_SQL).replace(
    "SELECT vt.title,", "SELECT count(*) AS total_vacancies, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS total_clicks, "
    "CAST(coalesce(sum(applies), 0) AS BIGINT) AS total_applies, avg(ratio_pct) AS avg_apply_rate FROM (SELECT vt.title,", 1)
    + ")")
def q_vacancy_totals(spark, sf_dir):
    return V.vacancy_totals(_vacancy_report(spark, sf_dir))


@register("vacancy_report_legacy", W(_legacy_report_sql("legacy_regions"), O.LEGACY_CTE, LEGACY_MERGED_CTE))
def q_vacancy_report_legacy(spark, sf_dir):
    return V.vacancy_report_legacy(legacy_events(spark, sf_dir), export=job_export_table(spark, sf_dir))


CHANGING_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ("event_date", "title", "workflow_state", "uk_region"))


@register("vacancy_table_changing", W(f"""SELECT entity_id, event_date, title, workflow_state, uk_region, clicks, applies
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {CHANGING_ORDER}) AS rn,
        CASE WHEN entity_id IS NULL THEN 0 ELSE count(*) FILTER (WHERE event_name = 'job_visit')
          OVER (PARTITION BY entity_id) END AS clicks,
        CASE WHEN entity_id IS NULL THEN 0 ELSE count(*) FILTER (WHERE event_name = 'job_apply_start')
          OVER (PARTITION BY entity_id) END AS applies FROM changing)
WHERE rn = 1""", """changing AS (
  SELECT entity_id, event_date, event_name, uk_region,
         title || ' v' || CAST(extract(day FROM CAST(event_date AS DATE)) % 3 AS VARCHAR) AS title,
         CASE WHEN extract(day FROM CAST(event_date AS DATE)) % 2 = 0 THEN 'published' ELSE 'draft' END
           AS workflow_state
  FROM enriched)"""))
def q_vacancy_table_changing(spark, sf_dir):
    """Attributes that change from day to day: the newest day's row represents the vacancy."""
    day = F.dayofmonth("event_date")
    df = enriched_events(spark, sf_dir).select(
        "entity_id", "event_date", "event_name",
        F.concat("title", F.lit(" v"), (day % 3).cast("string")).alias("title"),
        F.when(day % 2 == 0, "published").otherwise("draft").alias("workflow_state"), "uk_region")
    return V.vacancy_table(df)


VIEW_SQL = W(_legacy_report_sql(
    "legacy_start", region_expr=O.region_address_sql("max(regions)"),
    where="WHERE region IN ('North West', 'Wales', 'Unknown')").replace(
        "max(start_date) AS start_date, max(end_date) AS end_date",
        "'N/A' AS start_date, 'N/A' AS end_date"),
    O.LEGACY_CTE, "legacy_start AS (SELECT * FROM legacy)")


@register("vacancy_view", VIEW_SQL)
def q_vacancy_view(spark, sf_dir):
    return V.vacancy_view(legacy_events(spark, sf_dir), regions=("North West", "Wales", "Unknown"))


# =============================================================================================
# 2.H comparison and indicators
# =============================================================================================

SPEC_A = FL.FilterSpec(date_range=("2024-01-01", "2024-01-15"))
SPEC_B = FL.FilterSpec(date_range=("2024-01-16", "2024-01-30"), occupation=("BUILDING", "HOUSEHOLD", "Unknown"))
SIDE_A_SQL = "CAST(event_date AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'"
SIDE_B_SQL = ("CAST(event_date AS DATE) BETWEEN DATE '2024-01-16' AND DATE '2024-01-30' "
              "AND occupation IN ('BUILDING', 'HOUSEHOLD', 'Unknown')")
SIDES_CTE = f"""sides AS (
  SELECT count(DISTINCT entity_id) FILTER (WHERE {SIDE_A_SQL}) AS vacancies_a,
         count(*) FILTER (WHERE {SIDE_A_SQL} AND event_name = 'job_visit') AS clicks_a,
         count(*) FILTER (WHERE {SIDE_A_SQL} AND event_name = 'job_apply_start') AS applies_a,
         count(DISTINCT entity_id) FILTER (WHERE {SIDE_B_SQL}) AS vacancies_b,
         count(*) FILTER (WHERE {SIDE_B_SQL} AND event_name = 'job_visit') AS clicks_b,
         count(*) FILTER (WHERE {SIDE_B_SQL} AND event_name = 'job_apply_start') AS applies_b
  FROM enriched)"""


def _ab_sql() -> str:
    def m(s):
        return {
            "vacancies": f"vacancies_{s}", "clicks": f"clicks_{s}", "applies": f"applies_{s}",
            "apply_click_ratio": f"CASE WHEN clicks_{s} > 0 THEN applies_{s} / clicks_{s} * 100 ELSE 0.0 END",
            "clicks_per_vacancy": f"CASE WHEN vacancies_{s} > 0 THEN clicks_{s} / vacancies_{s} ELSE 0.0 END",
            "applies_per_vacancy": f"CASE WHEN vacancies_{s} > 0 THEN applies_{s} / vacancies_{s} ELSE 0.0 END",
        }
    a, b = m("a"), m("b")
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS metric, CAST({a[k]} AS DOUBLE) AS side_a, CAST({b[k]} AS DOUBLE) AS side_b FROM sides"
        for k in H.METRICS)
    body = f"""SELECT metric, side_a, side_b, side_b - side_a AS diff,
  CASE WHEN metric = 'apply_click_ratio' THEN NULL WHEN side_a > 0 THEN (side_b / side_a - 1) * 100 ELSE 0.0 END
    AS pct_change,
  CASE WHEN side_b - side_a > 0 THEN 'up' WHEN side_b - side_a < 0 THEN 'down' ELSE 'equal' END AS direction
FROM ({rows})"""
    return W(body, SIDES_CTE)


@register("ab_compare", _ab_sql())
def q_ab_compare(spark, sf_dir):
    return H.compare(enriched_events(spark, sf_dir), SPEC_A, SPEC_B)


@register("ab_compare_long", W("""SELECT * FROM (
  SELECT 'A' AS side, 'Vacancies' AS metric, vacancies_a AS value FROM sides
  UNION ALL SELECT 'B', 'Vacancies', vacancies_b FROM sides
  UNION ALL SELECT 'A', 'Clicks', clicks_a FROM sides
  UNION ALL SELECT 'B', 'Clicks', clicks_b FROM sides
  UNION ALL SELECT 'A', 'Applies', applies_a FROM sides
  UNION ALL SELECT 'B', 'Applies', applies_b FROM sides)""", SIDES_CTE))
def q_ab_compare_long(spark, sf_dir):
    return H.compare_long(enriched_events(spark, sf_dir), SPEC_A, SPEC_B)


def _band_sql(v: str, avg: str) -> str:
    d = f"(({v}) - ({avg})) / ({avg}) * 100"
    return (f"CASE WHEN ({v}) IS NULL OR ({avg}) IS NULL OR ({avg}) = 0 THEN NULL "
            f"WHEN {d} > 10 THEN 'above' WHEN {d} < -10 THEN 'below' ELSE 'near' END")


@register("performance_band", W(f"""SELECT g.uk_region, g.mean_clicks_per_vacancy, g.apply_click_ratio,
  {_band_sql('g.mean_clicks_per_vacancy', 'o.mean_clicks_per_vacancy')} AS clicks_band,
  {_band_sql('g.apply_click_ratio', 'o.apply_click_ratio')} AS ratio_band
FROM g, o""", O.per_vacancy_cte("pv_g", "enriched", ["uk_region"]),
    f"g AS ({O.metrics_select(['uk_region'], 'pv_g')})",
    O.per_vacancy_cte("pv_o", "enriched"), f"o AS ({O.metrics_select(None, 'pv_o')})"))
def q_performance_band(spark, sf_dir):
    return M.benchmark_bands(enriched_events(spark, sf_dir), "uk_region")


from . import registry_stored  # noqa: E402,F401  (adds its keys)
