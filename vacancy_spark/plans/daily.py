"""Stored daily counts: the report frame with equal events counted.

One row for each day, vacancy, event name and combination of report attributes, with the number of
events it stands for (``metrics.EVENTS``). Filters, key figures, trends and vacancy reports work on it
as on the events themselves and give the same results for any range of days, from a table of about one row a
vacancy and day. It is a published table partitioned by day: new days are added by themselves,
and days whose events changed are counted again, without touching the others.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import as_date_literal
from ..operators.metrics import EVENTS
from . import published

DAY = "event_date"
COLUMNS = ("entity_id", "event_name", "title", "organization_name", "workflow_state", "start_date", "end_date",
           "uk_region", "occupation", "importer_name", "upgrades_list", DAY)


def counted(events: DataFrame) -> DataFrame:
    """Equal events of a day as one row with their number (a hash aggregate with a partial step)."""
    keys = [c for c in COLUMNS if c in events.columns]
    day = F.col(DAY).cast("date").alias(DAY)
    return events.select(*[c for c in keys if c != DAY], day).groupBy(*keys).agg(F.count(F.lit(1)).alias(EVENTS))


def stored_days(spark: SparkSession, path: str) -> set[str] | None:
    """Days of the table (from its partition folders; "" for events without a day); None without a table."""
    m = published.current(spark, path)
    if m is None:
        return None
    folders = (x for p in m.parts for x in published.folders_of(spark, path, p, 1))
    days = (x.split("=", 1)[1] for x in folders)
    return {"" if d == "__HIVE_DEFAULT_PARTITION__" else d for d in days}


def add_days(events: DataFrame, path: str, days: list | None = None) -> published.Manifest:
    """Count the days of ``events`` that the table under ``path`` does not have yet, or just ``days`` (again,
    if it has them; a day without events any more loses its rows). Other days are not read where
    ``events`` is partitioned by day."""
    spark = events.sparkSession
    day, known = F.col(DAY).cast("date"), stored_days(spark, path)
    if days is not None:
        names = [d.isoformat() if isinstance(d, dt.date) else str(d)[:10] for d in days]
        events = events.where(day.isin(*[as_date_literal(d) for d in names]))
    elif known:
        seen = [as_date_literal(d) for d in sorted(known - {""})]
        fresh = ~day.isin(*seen) if seen else F.lit(True)
        events = events.where((day.isNotNull() & fresh) | (day.isNull() & F.lit("" not in known)))
    if known is None:
        return published.replace(counted(events), path, partition_by=[DAY], sort_by=["entity_id"])
    only = [f"{DAY}={d}" for d in names] if days is not None else None
    return published.replace_partitions(counted(events), path, sort_by=["entity_id"], only=only)


def daily(spark: SparkSession, path: str) -> DataFrame:
    """The counted events, to be used in place of the events."""
    return published.open_table(spark, path)
