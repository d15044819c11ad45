"""Bind the driver's TPC-H-like tables onto the vacancy schemas (FIXTURES.md section 2).

The binding gives every event row vacancy attributes that depend on the user only. Rather
than joining each event to four dimension tables (or computing MIN/MAX over a window, which
puts a whole user's events into one task), we:

1. reduce events to one row per user (partial + final aggregate: min/max time),
2. attach the dimension columns to that per-user table (small joins),
3. join the per-user attributes back onto the events once.

Step 3 is a single equi-join on ``user_id``. ``plans.materialize`` writes the per-user table
first, so Spark sees its real size and broadcasts it only when it is under the broadcast
threshold; otherwise the join is a shuffle join whose hot-user partitions AQE splits.
Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the reporting date used with the driver tables.
AS_OF = "2024-01-31"

# Synthetic location strings, chosen per user_id % 8.
LOCATION_SAMPLES = [
    None,
    "England, Manchester, GB",
    "1 High St, Leicester LE1 5YA",
    "SW1A 1AA",
    "Paris, , FR | Wales, Cardiff, GB",
    "Nowhere",
    "England, Leeds, GB | England, Bristol, GB",
    "Kirkstall LS5 3BT",
]

# The importer mapping file's five rows, in file order.
IMPORTER_MAPPING_ROWS = [
    ("2", "ATS feed"),
    ("5", "Civil Service"),
    ("1", "Scrape"),
    ("6", "Backfill"),
    ("-1", "Unknown/Other"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case_mod(key, n: int, values) -> F.Column:
    """``CASE key % n WHEN 0 THEN values[0] ... END`` (values may be Columns or literals)."""
    m = key % F.lit(n)
    expr = None
    for i, v in enumerate(values):
        v = v if isinstance(v, F.Column) else F.lit(v)
        expr = F.when(m == i, v) if expr is None else expr.when(m == i, v)
    return expr


def user_attributes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One row per user of ``events`` with every user-level column of the binding."""
    ev = events if events is not None else table(spark, sf_dir, "events")
    span = ev.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")

    u = (span
         .join(cust, span.user_id == cust.c_custkey, "left")
         .join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
         .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
         .join(part, span.user_id == part.p_partkey, "left"))

    uid = F.col("user_id")
    seg = F.col("c_mktsegment")
    return u.select(
        uid,
        F.concat(F.col("p_name"), F.lit(" officer")).alias("title_export"),
        F.concat(F.lit("Org "), (uid % 12).cast("string")).alias("organization_name"),
        F.when(uid % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("r_name"))
         .alias("location_region_matched"),
        _case_mod(uid, 5, [F.lit(None).cast("string"), F.lit("  "), seg,
                           F.concat(seg, F.lit(" | "), F.col("p_type")),
                           F.concat(seg, F.lit(" | "), F.col("p_type"))])
         .alias("occupational_fields_export"),
        F.when(uid % 13 == 0, F.lit(None).cast("bigint"))
         .otherwise((uid % 8 - 1).cast("bigint")).alias("importer_ID"),
        F.col("first_ts").alias("publishing_date"),
        F.when(uid % 4 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("last_ts"))
         .alias("expiration_date"),
        F.when(uid % 3 == 0, F.lit("unpublished")).otherwise(F.lit("published"))
         .alias("workflow_state"),
        _case_mod(uid, 4, [F.lit(None).cast("string"), "Boosted job", "Boosted job | Featured job",
                           "Top Job|Export job | Boosted job"]).alias("upgrades"),
        _case_mod(uid, 8, [F.lit(None).cast("string")] + LOCATION_SAMPLES[1:]).alias("locations"),
    )


def job_events(spark: SparkSession, sf_dir: str, attrs: DataFrame | None = None) -> DataFrame:
    """The enriched event table (``app`` schema plus legacy ``event_date`` and ``locations``).

    ``attrs`` is the per-user attribute table when it has already been materialised
    (``plans.materialize``); otherwise it is derived here in the same plan.
    """
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    if attrs is None:
        attrs = user_attributes(spark, sf_dir, ev)
    joined = ev.join(attrs, ev.user_id.eqNullSafe(attrs.user_id), "left").drop(attrs.user_id)
    et = F.col("event_type")
    return joined.select(
        F.col("user_id").cast("string").alias("entity_id_str"),
        F.col("ts").cast("date").alias("event_date_parsed"),
        F.date_format("ts", "yyyyMMdd").alias("event_date"),
        F.when(et.isin("view", "click"), F.lit("job_visit"))
         .when(et == "purchase", F.lit("job_apply_start"))
         .otherwise(et).alias("event_name"),
        "title_export", "organization_name", "location_region_matched",
        "occupational_fields_export", "importer_ID", "publishing_date", "expiration_date",
        "workflow_state", "upgrades", "locations",
    )


def job_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job export (all strings, day-first dates; some unparseable, some null)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("c_custkey")
    return (c.join(p, k == p.p_partkey, "left")
            .where(k % 9 != 0)
            .select(
                k.cast("string").alias("job_id"),
                F.concat(F.col("p_name"), F.lit(" officer")).alias("title"),
                F.when(k % 3 == 0, F.lit("unpublished")).otherwise(F.lit("published"))
                 .alias("workflow_state"),
                F.col("c_mktsegment").alias("occupational_fields"),
                F.lit("England, Manchester, GB").alias("locations"),
                F.when(k % 5 == 0, F.lit("bad date"))
                 .otherwise(F.concat(F.lit("0"), (k % 9 + 1).cast("string"), F.lit("/01/2024 09:30")))
                 .alias("publishing_date"),
                F.when(k % 4 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("2"), (k % 9).cast("string"), F.lit("/02/2024 17:00")))
                 .alias("expiration_date"),
                F.concat(F.lit("Org "), (k % 12).cast("string")).alias("organization_profile_name"),
            ))


def importer_mapping_rows(spark: SparkSession) -> DataFrame:
    """The five mapping rows as an inline table (a local relation with exact size
    statistics, so the planner broadcasts it without a hint)."""
    values = ", ".join(f"('{i}', '{n}')" for i, n in IMPORTER_MAPPING_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(importer_id, importer_name)")


# ---------------------------------------------------------------------------------------------
# The same bindings as SQL, for the DuckDB oracle (inlined as CTEs there).
# ---------------------------------------------------------------------------------------------

JOB_EVENTS_SQL = """
SELECT CAST(e.user_id AS VARCHAR) AS entity_id_str,
       CAST(e.ts AS DATE) AS event_date_parsed,
       CAST(year(e.ts)*10000 + month(e.ts)*100 + day(e.ts) AS VARCHAR) AS event_date,
       CASE WHEN e.event_type IN ('view','click') THEN 'job_visit'
            WHEN e.event_type = 'purchase' THEN 'job_apply_start'
            ELSE e.event_type END AS event_name,
       p.p_name || ' officer' AS title_export,
       'Org ' || CAST(e.user_id % 12 AS VARCHAR) AS organization_name,
       CASE WHEN e.user_id % 17 = 0 THEN NULL ELSE r.r_name END AS location_region_matched,
       CASE e.user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN c.c_mktsegment
            ELSE c.c_mktsegment || ' | ' || p.p_type END AS occupational_fields_export,
       CASE WHEN e.user_id % 13 = 0 THEN NULL ELSE CAST(e.user_id % 8 - 1 AS BIGINT) END AS importer_ID,
       MIN(e.ts) OVER (PARTITION BY e.user_id) AS publishing_date,
       CASE WHEN e.user_id % 4 = 0 THEN NULL ELSE MAX(e.ts) OVER (PARTITION BY e.user_id) END AS expiration_date,
       CASE WHEN e.user_id % 3 = 0 THEN 'unpublished' ELSE 'published' END AS workflow_state,
       CASE e.user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Boosted job' WHEN 2 THEN 'Boosted job | Featured job'
            ELSE 'Top Job|Export job | Boosted job' END AS upgrades,
       CASE e.user_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'England, Manchester, GB'
            WHEN 2 THEN '1 High St, Leicester LE1 5YA' WHEN 3 THEN 'SW1A 1AA'
            WHEN 4 THEN 'Paris, , FR | Wales, Cardiff, GB' WHEN 5 THEN 'Nowhere'
            WHEN 6 THEN 'England, Leeds, GB | England, Bristol, GB' ELSE 'Kirkstall LS5 3BT' END AS locations
FROM events e
LEFT JOIN customer c ON e.user_id = c.c_custkey
LEFT JOIN nation n   ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r   ON n.n_regionkey = r.r_regionkey
LEFT JOIN part p     ON e.user_id = p.p_partkey
"""

JOB_EXPORT_SQL = """
SELECT CAST(c.c_custkey AS VARCHAR) AS job_id,
       p.p_name || ' officer' AS title,
       CASE WHEN c.c_custkey % 3 = 0 THEN 'unpublished' ELSE 'published' END AS workflow_state,
       c.c_mktsegment AS occupational_fields,
       'England, Manchester, GB' AS locations,
       CASE WHEN c.c_custkey % 5 = 0 THEN 'bad date'
            ELSE '0' || CAST(c.c_custkey % 9 + 1 AS VARCHAR) || '/01/2024 09:30' END AS publishing_date,
       CASE WHEN c.c_custkey % 4 = 0 THEN NULL
            ELSE '2' || CAST(c.c_custkey % 9 AS VARCHAR) || '/02/2024 17:00' END AS expiration_date,
       'Org ' || CAST(c.c_custkey % 12 AS VARCHAR) AS organization_profile_name
FROM customer c LEFT JOIN part p ON c.c_custkey = p.p_partkey
WHERE c.c_custkey % 9 <> 0
"""

IMPORTER_MAPPING_SQL = (
    "SELECT * FROM (VALUES "
    + ",".join(f"('{i}','{n}')" for i, n in IMPORTER_MAPPING_ROWS)
    + ") AS t(importer_id, importer_name)"
)
