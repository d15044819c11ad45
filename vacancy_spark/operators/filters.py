"""Filters, predicates and facets.

A ``FilterSpec`` folds into ONE boolean Column, so a filtered report is a single ``where``
that Catalyst pushes as far down as it can (date and event-name terms reach the Parquet
scan; the others run inside the scan's whole-stage-codegen span).
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date_literal
from ..functions.patterns import to_jvm


@dataclass(frozen=True)
class FilterSpec:
    """Filter selections. Empty lists / blank text / a range that is not exactly two dates
    mean "no filter" for that field (SURVEY S8)."""

    date_range: tuple = ()
    importer: tuple = ()
    company: tuple = ()
    organisation_export: tuple = ()
    region: tuple = ()
    occupation: tuple = ()
    upgrades: tuple = ()
    job_title: str = ""
    title_regex: bool = True
    event_names: tuple = ()
    vacancy_active: bool = False
    columns: dict = field(default_factory=lambda: dict(DEFAULT_COLUMNS))


# Report column behind each filter field.
DEFAULT_COLUMNS = {
    "date": "event_date",
    "importer": "importer_name",
    "company": "organization_name",
    "organisation_export": "organization_name_jobiqo",
    "region": "uk_region",
    "occupation": "occupation",
    "upgrades": "upgrades_list",
    "title": "title",
    "event_name": "event_name",
    "start": "start_date",
    "end": "end_date",
}


def _date(d):
    if isinstance(d, str):
        return dt.date.fromisoformat(d[:10])
    return d.date() if isinstance(d, dt.datetime) else d


def date_range_predicate(c, start, end) -> Column:
    """Inclusive on both ends, on the event's day."""
    return F.col(c).cast("date").between(as_date_literal(_date(start)), as_date_literal(_date(end)))


def in_predicate(c, values) -> Column:
    return F.col(c).isin(list(values))


def any_of_predicate(c, values) -> Column:
    """The list column shares at least one value with ``values`` (null -> no match)."""
    lits = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.arrays_overlap(F.col(c), lits), F.lit(False))


def title_predicate(c, term: str, regex: bool = True) -> Column:
    """Case-insensitive partial match. ``regex=True`` reproduces the reference: the stripped,
    lower-cased term is a regular expression in Python's syntax over the lower-cased title (SURVEY S7);
    one that is none, or has no equal on the JVM, raises ``patterns.PatternError`` here."""
    t = term.strip().lower()
    if regex:
        t = re.sub(r"\(\?p([<=])", r"(?P\1", t)  # lower-casing must not break a named group
    low = F.lower(F.col(c))
    m = low.rlike(to_jvm(t)) if regex else low.contains(F.lit(t))
    return F.coalesce(m, F.lit(False))


def overlap_predicate(start_col, end_col, range_start, range_end) -> Column:
    """Vacancy active during the range: start <= range_end and end >= range_start."""
    s = F.col(start_col).cast("date")
    e = F.col(end_col).cast("date")
    return (s <= as_date_literal(_date(range_end))) & (e >= as_date_literal(_date(range_start)))


def spec_predicate(spec: FilterSpec | None, columns=None) -> Column | None:
    """Fold a spec into one predicate; ``None`` when nothing is selected.

    Fields whose column is missing from ``columns`` (if given) are skipped, like the
    reference does.
    """
    if spec is None:
        return None
    cols = spec.columns
    have = (lambda c: True) if columns is None else (lambda c: c in columns)
    terms: list[Column] = []
    if spec.date_range and len(spec.date_range) == 2 and have(cols["date"]):
        if spec.vacancy_active and have(cols["start"]) and have(cols["end"]):
            terms.append(overlap_predicate(cols["start"], cols["end"], *spec.date_range))
        terms.append(date_range_predicate(cols["date"], *spec.date_range))
    for fld, key in (("importer", "importer"), ("company", "company"),
                     ("organisation_export", "organisation_export"), ("region", "region"),
                     ("occupation", "occupation"), ("event_names", "event_name")):
        vals = getattr(spec, fld)
        if vals and have(cols[key]):
            terms.append(in_predicate(cols[key], vals))
    if spec.upgrades and have(cols["upgrades"]):
        terms.append(any_of_predicate(cols["upgrades"], spec.upgrades))
    if spec.job_title and spec.job_title.strip() and have(cols["title"]):
        terms.append(title_predicate(cols["title"], spec.job_title, spec.title_regex))
    if not terms:
        return None
    return reduce(lambda a, b: a & b, terms)


def apply_filters(df: DataFrame, spec: FilterSpec | None) -> DataFrame:
    """All selected filters combined with AND; ``None``/empty spec -> ``df`` unchanged."""
    p = spec_predicate(spec, df.columns)
    return df if p is None else df.where(p)


def facet_options(df: DataFrame, dims=None) -> DataFrame:
    """Sorted distinct non-null option values per filter dimension, as (dimension, value).

    One scan: rows are first reduced to distinct combinations inside each task, then each emits
    its (dimension, value) pairs.
    """
    dims = dims or {"importer": "importer_name", "company": "organization_name",
                    "region": "uk_region", "occupation": "occupation"}
    scalar = [F.struct(F.lit(k).alias("dimension"), F.col(c).cast("string").alias("value"))
              for k, c in dims.items() if c in df.columns]
    cols = [c for c in dict.fromkeys([*dims.values(), "upgrades_list"]) if c in df.columns]
    df = df.select(*cols).distinct()
    arr = F.array(*scalar)
    if "upgrades_list" in df.columns:
        arr = F.concat(arr, F.transform("upgrades_list",
                                        lambda u: F.struct(F.lit("upgrade").alias("dimension"),
                                                           u.alias("value"))))
    return (df.select(F.inline(arr))
              .where(F.col("value").isNotNull())
              .distinct()
              .orderBy("dimension", "value"))


def date_bounds(df: DataFrame, as_of, months: int = 6, date_col: str = "event_date") -> DataFrame:
    """min and max event day, and the default window start max(as_of - months*30 days, min)."""
    start = _date(as_of) - dt.timedelta(days=months * 30)
    d = F.col(date_col).cast("date")
    return (df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"))
              .withColumn("default_start", F.greatest(as_date_literal(start), F.col("min_date"))))


def filter_vacancies(vac: DataFrame, regions=(), orgs=(), region_col: str = "region",
                     org_col: str = "organisation") -> DataFrame:
    """Post-aggregation filters on a vacancy table."""
    out = vac
    if regions:
        out = out.where(F.col(region_col).isin(list(regions)))
    if orgs:
        out = out.where(F.col(org_col).isin(list(orgs)))
    return out
