"""The load -> enrich path every report starts from.

``scan -> rename -> importer names -> upgrades -> dates -> occupation`` is one narrow stage
(plus a broadcast-sized lookup join Spark picks from the mapping's measured size). Reports
built on it add one or two hash aggregates keyed by the vacancy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import (add_occupation, apply_importer_mapping, parse_dates,
                               parse_upgrades, prepare_enriched)
from ..sources import fixtures
from ..sources.events import scan_events
from .materialize import job_events_table


def enrich(scanned: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Report columns from the 12-column scan."""
    df = prepare_enriched(scanned)
    df = apply_importer_mapping(df, mapping)
    df = parse_upgrades(df)
    df = parse_dates(df)
    return add_occupation(df)


_PLANS: dict[tuple, DataFrame] = {}


def enriched_events(spark: SparkSession, sf_dir: str, as_of: str = fixtures.AS_OF,
                    days_back: int = 30, mapping: DataFrame | None = None) -> DataFrame:
    """The enriched report frame over the driver tables.

    With the default mapping the (immutable, lazy) DataFrame is kept per table and window,
    so the reports that start from it share one analysed plan instead of rebuilding it.
    """
    events = job_events_table(spark, sf_dir)
    key = None
    if mapping is None:
        key = (spark.sparkContext.applicationId, id(events), str(as_of), int(days_back))
        if key in _PLANS:
            return _PLANS[key]
        mapping = fixtures.importer_mapping_rows(spark)
    out = enrich(scan_events(events, as_of, days_back), mapping)
    if key is not None:
        _PLANS[key] = out
    return out


def legacy_events(spark: SparkSession, sf_dir: str, with_day: bool = False) -> DataFrame:
    """The raw (legacy) event table: ``YYYYMMDD`` string dates, address strings. ``with_day``
    adds the parsed day that the table is partitioned by, for pruning."""
    e = job_events_table(spark, sf_dir)
    return e.select(
        e.entity_id_str.alias("entity_id"), "event_date", "event_name", "organization_name",
        e.title_export.alias("title"), e.locations.alias("regions"),
        e.occupational_fields_export.alias("occupations"), e.importer_ID.alias("importer_id"),
        "upgrades", *(["event_date_parsed"] if with_day else []),
    )
