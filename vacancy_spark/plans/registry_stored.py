"""Registered queries over stored tables: ranges of any step, published versions, daily counts, bucketed
tables, the address dictionary, CSV folders of several headers. They add to ``registry``'s keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as O
from ..functions import dates as D
from ..operators import clean as C
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import trends as T
from ..operators import vacancy as V
from ..session import fresh_path
from ..sources import csv_ranges as CR
from ..sources import events as EV
from ..sources import files as FS
from . import addresses as AD
from . import bucketed as BK
from . import daily as DY
from . import published as PB
from . import tables as TB
from .enrich import enriched_events, legacy_events
from .materialize import job_events_table, job_export_table
from .registry import AS_OF, DATE_RANGE, JOIN_METADATA_SQL, VACANCY_REPORT_SQL, W, _metadata, register

_IN_RANGE = f"CAST(event_date AS DATE) BETWEEN DATE '{DATE_RANGE[0]}' AND DATE '{DATE_RANGE[1]}'"


# -- ranges (A2, A10) ----------------------------------------------------------------------------

def _range_sql(start: int, step: int, count: int) -> str:
    return W(f"""SELECT *, CASE WHEN TRY_CAST(event_date AS BIGINT) IS NULL THEN NULL
  WHEN TRY_CAST(event_date AS BIGINT) >= {start} AND TRY_CAST(event_date AS BIGINT) < {start + step * count}
    THEN CAST(floor((TRY_CAST(event_date AS BIGINT) - {start}) / {step}) AS INTEGER) ELSE -1 END AS event_date_bucket
FROM legacy WHERE event_date >= '20240117'""", O.LEGACY_CTE)


for _name, (_start, _stop, _step) in {"monthly": (20230101, 20241231, 100), "days": (20240110, 20240125, 1),
                                      "decade": (20000101, 20400101, 100000)}.items():
    @register(f"scan_events_range_{_name}", _range_sql(_start, _step, (_stop - _start) // _step))
    def q_scan_range(spark, sf_dir, _ranges=(_start, _stop, _step)):
        path = fresh_path(spark, "range_events")
        TB.rebuild_range_partitioned(legacy_events(spark, sf_dir), path, *_ranges)
        return EV.scan_events_legacy(path, AS_OF, days_back=14)


# -- CSV (A3, A7) ----------------------------------------------------------------------------------

@register("read_job_export_folder", W("""SELECT job_id, title, workflow_state, occupational_fields,
  CASE WHEN CAST(job_id AS INTEGER) % 2 = 0 THEN locations END AS locations, publishing_date, expiration_date,
  organization_profile_name, CASE WHEN CAST(job_id AS INTEGER) % 2 = 1 THEN 'x,' || chr(10) || job_id END AS note FROM job_export"""))
def q_read_job_export_folder(spark, sf_dir):
    """A folder of exports with two headers: other order, a column less, a column more."""
    path = fresh_path(spark, "job_export_folder_csv")
    rows = job_export_table(spark, sf_dir)
    even = F.col("job_id").cast("int") % 2 == 0
    TB.export_csv(rows.where(even), f"{path}/a")
    other = rows.where(~even).withColumn("note", F.concat(F.lit("x,\n"), "job_id")).drop("locations")
    TB.export_csv(other.select(*reversed(other.columns)), f"{path}/b")
    return FS.read_job_export(spark, f"{path}/*")


@register("csv_rejects", W("""SELECT job_id || ',' || job_id || ',too many' AS record, 3 AS n_fields, 2 AS expected
FROM job_export WHERE CAST(job_id AS INTEGER) % 3 = 0"""))
def q_csv_rejects(spark, sf_dir):
    """Records with a field too many, kept apart from the rest."""
    path = fresh_path(spark, "odd_csv")
    rows = job_export_table(spark, sf_dir)
    odd = F.when(F.col("job_id").cast("int") % 3 == 0, F.lit(",too many")).otherwise(F.lit(""))
    lines = rows.select(F.concat("job_id", F.lit(","), "job_id", odd).alias("value"))
    header = spark.createDataFrame([("a,b",)], "value string")
    header.unionByName(lines).coalesce(1).write.text(path)
    return CR.csv_rejects(spark, path).select("record", "n_fields", "expected")


# -- published tables (A11, A13, A14) ----------------------------------------------------------------

MERGED_COLUMNS = ("entity_id_str", "event_date_parsed", "event_name", "title_export", "workflow_state")


@register("merge_into_days", W("""SELECT entity_id_str, event_date_parsed, event_name,
  CASE WHEN workflow_state = 'unpublished' AND entity_id_str IS NOT NULL THEN title_export || ' (closed)'
       ELSE title_export END AS title_export, workflow_state FROM job_events"""))
def q_merge_into_days(spark, sf_dir):
    """MERGE into a published table partitioned by day: the titles of closed vacancies."""
    events = job_events_table(spark, sf_dir).select(*MERGED_COLUMNS)
    path = fresh_path(spark, "published_events")
    PB.replace(events, path, partition_by=["event_date_parsed"], sort_by=["entity_id_str"])
    closed = (events.where("workflow_state = 'unpublished'")
              .select("entity_id_str", F.concat("title_export", F.lit(" (closed)")).alias("title_export")).distinct())
    PB.merge_into(spark, path, closed, "entity_id_str", ["title_export"])
    return PB.open_table(spark, path)


@register("replace_days", W("""SELECT entity_id_str, event_date_parsed, CASE WHEN event_date_parsed >= DATE '2024-01-20'
  THEN upper(event_name) ELSE event_name END AS event_name, title_export, workflow_state FROM job_events"""))
def q_replace_days(spark, sf_dir):
    """Some days of a published table replaced, the others untouched."""
    events = job_events_table(spark, sf_dir).select(*MERGED_COLUMNS)
    path = fresh_path(spark, "published_events")
    PB.replace(events, path, partition_by=["event_date_parsed"])
    late = events.where(F.col("event_date_parsed") >= D.as_date_literal("2024-01-20"))
    PB.replace_partitions(late.withColumn("event_name", F.upper("event_name")), path)
    return PB.open_table(spark, path)


@register("snapshot_backup", W("SELECT * FROM metadata", O.metadata_cte()))
def q_snapshot_backup(spark, sf_dir):
    """A backup still holds its rows after the table was replaced."""
    folder, meta = fresh_path(spark, "snapshots"), _metadata(spark, sf_dir)
    TB.snapshot_table(spark, meta, folder, "metadata", "2024-01-30 06:00", keep=2)
    TB.snapshot_table(spark, meta.select("entity_id"), folder, "metadata", "2024-01-31 06:00", keep=2)
    return TB.open_backup(spark, folder, "metadata", "metadata_backup_2024-01-30_0600")


# -- daily counts (F1, F2, F10, G1) --------------------------------------------------------------------

def _daily(spark, sf_dir):
    """The counts, stored in two steps: the days up to the 15th, then those that are missing."""
    path, events = fresh_path(spark, "daily_counts"), enriched_events(spark, sf_dir)
    DY.add_days(events.where(F.col("event_date").cast("date") <= D.as_date_literal("2024-01-15")), path)
    DY.add_days(events, path)
    return DY.daily(spark, path)


RANGE = FL.FilterSpec(date_range=DATE_RANGE)
_FILTERED = f"filtered AS (SELECT * FROM enriched WHERE {_IN_RANGE})"


@register("kpi_metrics_daily", O.kpi_sql("filtered", _FILTERED))
def q_kpi_metrics_daily(spark, sf_dir):
    return M.kpi_metrics(FL.apply_filters(_daily(spark, sf_dir), RANGE))


@register("vacancy_counts_daily", W("""SELECT entity_id, count(*) FILTER (WHERE event_name = 'job_visit') AS clicks,
  count(*) FILTER (WHERE event_name = 'job_apply_start') AS applies FROM filtered GROUP BY entity_id""", _FILTERED))
def q_vacancy_counts_daily(spark, sf_dir):
    return M.vacancy_counts(FL.apply_filters(_daily(spark, sf_dir), RANGE))


@register("daily_trend_daily", W("""SELECT CAST(event_date AS DATE) AS event_date,
  count(*) FILTER (WHERE event_name = 'job_visit') AS clicks,
  count(*) FILTER (WHERE event_name = 'job_apply_start') AS applies
FROM filtered GROUP BY 1 HAVING clicks > 0 OR applies > 0""", _FILTERED))
def q_daily_trend_daily(spark, sf_dir):
    return T.daily_trend(FL.apply_filters(_daily(spark, sf_dir), RANGE))


@register("vacancy_report_daily", VACANCY_REPORT_SQL)
def q_vacancy_report_daily(spark, sf_dir):
    return V.vacancy_report_filtered(_daily(spark, sf_dir), RANGE, AS_OF)


# -- bucketed tables (A9, E1, F2) ------------------------------------------------------------------------

BUCKETS = 16


def _bucketed(spark, df, kind, sort, split_hot=True):
    name = fresh_path(spark, kind).rsplit("/", 1)[-1].replace("-", "_")
    return BK.write_bucketed(df, name, "entity_id", sort, BUCKETS, split_hot)


@register("vacancy_counts_bucketed", W("""SELECT entity_id, count(*) FILTER (WHERE event_name = 'job_visit') AS clicks,
  count(*) FILTER (WHERE event_name = 'job_apply_start') AS applies FROM legacy GROUP BY entity_id""", O.LEGACY_CTE))
def q_vacancy_counts_bucketed(spark, sf_dir):
    return BK.vacancy_counts(_bucketed(spark, legacy_events(spark, sf_dir), "bucketed_events", ["event_date"]))


@register("join_metadata_bucketed", JOIN_METADATA_SQL)
def q_join_metadata_bucketed(spark, sf_dir):
    meta = C.dedup_latest(_metadata(spark, sf_dir), "entity_id", "last_updated")
    return BK.join_metadata(_bucketed(spark, legacy_events(spark, sf_dir), "bucketed_events", ["event_date"]),
                            _bucketed(spark, meta, "bucketed_metadata", [], split_hot=False))


# -- address dictionary (C5-C8) ------------------------------------------------------------------------------

@register("regions_by_dictionary", W(f"""SELECT entity_id, event_date, regions,
  {O.region_address_sql('regions')} AS uk_region FROM legacy""", O.LEGACY_CTE))
def q_regions_by_dictionary(spark, sf_dir):
    events = legacy_events(spark, sf_dir).select("entity_id", "event_date", "regions")
    return AD.regions_by_dictionary(events, "regions", path=fresh_path(spark, "address_regions"))


@register("regions_of_locations_by_dictionary", W(f"""SELECT l.entity_id, x.locations AS location_full,
  {O.region_locations_sql('x.locations')} AS uk_region FROM legacy l LEFT JOIN job_export x ON l.entity_id = x.job_id""",
                                                  O.LEGACY_CTE))
def q_regions_of_locations_by_dictionary(spark, sf_dir):
    events = J.merge_job_export(legacy_events(spark, sf_dir), job_export_table(spark, sf_dir))
    return AD.add_region_column(events.select("entity_id", "location_full"), path=fresh_path(spark, "address_regions"))
