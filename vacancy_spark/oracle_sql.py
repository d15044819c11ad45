"""DuckDB SQL for the correctness oracle: one statement per registered query.

Each statement inlines the fixture bindings as CTEs over the pre-registered driver views, then
re-states the operator in plain SQL. Column names equal the Spark query's.
"""

from __future__ import annotations

from .sources.fixtures import IMPORTER_MAPPING_SQL, JOB_EVENTS_SQL, JOB_EXPORT_SQL

CUTOFF = "DATE '2024-01-01'"      # AS_OF 2024-01-31 minus the default 30-day window
AS_OF_TS = "TIMESTAMP '2024-01-31 00:00:00'"


def _blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


BASE_CTES = f"""
job_events AS ({JOB_EVENTS_SQL}),
importer_mapping AS ({IMPORTER_MAPPING_SQL}),
job_export AS ({JOB_EXPORT_SQL}),
scanned AS (
  SELECT entity_id_str, event_date_parsed, event_name, title_export, organization_name,
         location_region_matched, occupational_fields_export, importer_ID, publishing_date,
         expiration_date, workflow_state, upgrades
  FROM job_events
  WHERE event_date_parsed >= {CUTOFF} AND event_name IN ('job_visit', 'job_apply_start')
),
enriched AS (
  SELECT s.entity_id_str AS entity_id, s.event_date_parsed AS event_date, s.event_name,
         s.title_export AS title, s.organization_name, s.location_region_matched AS uk_region,
         s.occupational_fields_export AS occupational_fields, s.importer_ID,
         s.publishing_date AS start_date, s.expiration_date AS end_date, s.workflow_state,
         s.upgrades,
         coalesce(trim(CAST(s.importer_ID AS VARCHAR)), '<NA>') AS importer_id_str,
         coalesce(m.importer_name, 'ID: ' || coalesce(trim(CAST(s.importer_ID AS VARCHAR)), '<NA>'))
           AS importer_name,
         CASE WHEN {_blank('s.upgrades')} THEN CAST([] AS VARCHAR[])
              ELSE list_transform(string_split(s.upgrades, '|'), lambda x: trim(x)) END AS upgrades_list,
         CASE WHEN {_blank('s.occupational_fields_export')} THEN 'Unknown'
              ELSE trim(string_split(s.occupational_fields_export, '|')[1]) END AS occupation
  FROM scanned s
  LEFT JOIN importer_mapping m ON coalesce(trim(CAST(s.importer_ID AS VARCHAR)), '<NA>') = m.importer_id
)"""


def with_base(body: str, extra_ctes: str = "") -> str:
    ctes = BASE_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


def per_vacancy_cte(name: str, src: str, dims: list[str] | None = None) -> str:
    d = ", ".join(dims or [])
    dsel = (d + ", ") if d else ""
    return f"""{name} AS (
  SELECT {dsel}entity_id,
         count(*) FILTER (WHERE event_name = 'job_visit') AS clicks,
         count(*) FILTER (WHERE event_name = 'job_apply_start') AS applies
  FROM {src} GROUP BY {dsel}entity_id)"""


def metrics_select(dims: list[str] | None, src: str) -> str:
    """Level-2 metrics per group from a per-vacancy CTE ``src``; null group -> zeros."""
    dims = dims or []
    d = ", ".join(dims)
    isnull = " OR ".join(f"{x} IS NULL" for x in dims) or "FALSE"
    med_c = "median(CASE WHEN entity_id IS NULL THEN 0 ELSE clicks END)"
    med_a = "median(CASE WHEN entity_id IS NULL THEN 0 ELSE applies END)"
    v = "count(entity_id)"
    tc = "CAST(coalesce(sum(clicks), 0) AS BIGINT)"
    ta = "CAST(coalesce(sum(applies), 0) AS BIGINT)"
    z = f"CASE WHEN {isnull} THEN"
    body = f"""
  SELECT {d + ',' if d else ''}
    {z} 0 ELSE {v} END AS num_vacancies,
    {z} 0 ELSE {tc} END AS total_clicks,
    {z} 0 ELSE {ta} END AS total_applies,
    {z} 0.0 ELSE (CASE WHEN {tc} > 0 THEN {ta} / {tc} * 100 ELSE 0.0 END) END AS apply_click_ratio,
    {z} 0.0 ELSE (CASE WHEN {v} > 0 THEN {tc} / {v} ELSE 0.0 END) END AS mean_clicks_per_vacancy,
    {z} 0.0 ELSE (CASE WHEN {v} > 0 THEN {ta} / {v} ELSE 0.0 END) END AS mean_applies_per_vacancy,
    {z} 0.0 ELSE (CASE WHEN {v} > 0 THEN coalesce({med_c}, 0.0) ELSE 0.0 END) END AS median_clicks_per_vacancy,
    {z} 0.0 ELSE (CASE WHEN {v} > 0 THEN coalesce({med_a}, 0.0) ELSE 0.0 END) END AS median_applies_per_vacancy
  FROM {src}"""
    if dims:
        body += f" GROUP BY {d}"
    return body


def kpi_sql(src: str = "enriched", extra_ctes: str = "") -> str:
    pv = per_vacancy_cte("pv", src)
    m = metrics_select(None, "pv")
    body = f"""SELECT num_vacancies, total_clicks, total_applies, apply_click_ratio,
       mean_clicks_per_vacancy, mean_applies_per_vacancy,
       median_clicks_per_vacancy, median_applies_per_vacancy,
       mean_clicks_per_vacancy AS clicks_per_vacancy, mean_applies_per_vacancy AS applies_per_vacancy
FROM ({m})"""
    return with_base(body, (extra_ctes + "," if extra_ctes else "") + pv)


def benchmark_sql(dim: str, src: str = "enriched") -> str:
    pv = per_vacancy_cte("pv", src, [dim])
    m = metrics_select([dim], "pv")
    body = f"""SELECT {dim}, num_vacancies AS vacancies, total_clicks, total_applies,
       round_even(apply_click_ratio, 2) AS apply_click_pct,
       round_even(median_clicks_per_vacancy, 1) AS median_clicks_per_vac,
       round_even(mean_clicks_per_vacancy, 1) AS mean_clicks_per_vac,
       round_even(median_applies_per_vacancy, 2) AS median_applies_per_vac,
       round_even(mean_applies_per_vacancy, 2) AS mean_applies_per_vac
FROM ({m})"""
    return with_base(body, pv)


def overview_sql(dim: str, src: str = "enriched") -> str:
    pv = per_vacancy_cte("pv", src, [dim])
    m = metrics_select([dim], "pv")
    body = f"""SELECT {dim}, num_vacancies AS vacancies,
       round_even(median_clicks_per_vacancy, 1) AS median_clicks,
       round_even(mean_clicks_per_vacancy, 1) AS mean_clicks,
       round_even(median_applies_per_vacancy, 2) AS median_applies,
       round_even(mean_applies_per_vacancy, 2) AS mean_applies,
       round_even(apply_click_ratio, 2) AS apply_click_pct
FROM ({m})"""
    return with_base(body, pv)


# ---------------------------------------------------------------------------------------------
# Region expressions in SQL, generated from the same fixed tables as the Spark expressions.
# ---------------------------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def region_city_sql(x: str) -> str:
    from .functions.regions import UK_REGIONS
    s = f"trim({x})"
    city = f"lower(trim(split_part({s}, ',', 2)))"
    cases = " ".join(f"WHEN {city} IN ({', '.join(_q(w) for w in words)}) THEN {_q(r)}"
                     for r, words in UK_REGIONS)
    return f"(CASE WHEN {s} LIKE '%,%' AND {city} <> '' THEN (CASE {cases} END) END)"


def outward_sql(x: str) -> str:
    from .functions.regions import POSTCODE_PATTERN
    return (f"nullif(regexp_replace(regexp_extract(upper({x}), {_q(POSTCODE_PATTERN)}, 1), "
            f"'[A-Z]$', ''), '')")


def region_postcode_sql(x: str, mode: str = "reference") -> str:
    from .functions.regions import postcode_map
    out = outward_sql(x)
    key = out if mode == "reference" else f"nullif(regexp_extract({out}, '^[A-Z]+', 0), '')"
    cases = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in postcode_map().items())
    return f"(CASE {key} {cases} END)"


def region_keyword_sql(x: str) -> str:
    from .functions.regions import UK_REGIONS
    low = f"lower(trim({x}))"
    cases = " ".join(f"WHEN regexp_matches({low}, {_q('|'.join(words))}) THEN {_q(r)}"
                     for r, words in UK_REGIONS)
    return f"(CASE {cases} END)"


def region_address_sql(x: str, mode: str = "reference") -> str:
    found = f"coalesce({region_city_sql(x)}, {region_postcode_sql(x, mode)}, {region_keyword_sql(x)})"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'Unknown' ELSE coalesce({found}, 'Unknown') END)"


def region_locations_sql(x: str, mode: str = "reference") -> str:
    inner = region_address_sql("trim(loc)", mode)
    lst = (f"list_filter(list_transform(string_split({x}, '|'), lambda loc: {inner}), "
           f"lambda r: r <> 'Unknown')")
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'Unknown' ELSE coalesce({lst}[1], 'Unknown') END)"


# ---------------------------------------------------------------------------------------------
# Shared CTEs for the legacy path and the metadata table.
# ---------------------------------------------------------------------------------------------

LEGACY_CTE = """legacy AS (
  SELECT entity_id_str AS entity_id, event_date, event_name, organization_name,
         title_export AS title, locations AS regions,
         occupational_fields_export AS occupations, importer_ID AS importer_id, upgrades
  FROM job_events)"""


def metadata_cte(name: str = "metadata", null_fill: str | None = "''", as_of: str = AS_OF_TS) -> str:
    def s(c, src=None):
        src = src or c
        e = f"CAST({src} AS VARCHAR)"
        return f"coalesce({e}, {null_fill}) AS {c}" if null_fill else f"{e} AS {c}"
    nul = "NULL" if not null_fill else null_fill
    return f"""{name} AS (
  SELECT {s('entity_id', 'job_id')}, {s('title')}, {s('workflow_state')}, {s('occupational_fields')},
         {s('locations')},
         try_strptime(publishing_date, '%d/%m/%Y %H:%M') AS publishing_date,
         try_strptime(expiration_date, '%d/%m/%Y %H:%M') AS expiration_date,
         {s('organization_profile_name')},
         CAST({nul} AS VARCHAR) AS organization_id, CAST({nul} AS VARCHAR) AS employment_type,
         {as_of} AS last_updated
  FROM job_export)"""


def vacancy_table_cte(name: str, src: str) -> str:
    """Per vacancy from the enriched frame: attributes are per-vacancy constants in the
    binding, so max() picks the (single) value."""
    return f"""{name} AS (
  SELECT entity_id, max(title) AS title, max(organization_name) AS organization_name,
         max(workflow_state) AS workflow_state, max(start_date) AS start_date,
         max(end_date) AS end_date, max(uk_region) AS uk_region, max(occupation) AS occupation,
         max(importer_name) AS importer_name, max(upgrades) AS upgrades,
         CASE WHEN entity_id IS NULL THEN 0 ELSE count(*) FILTER (WHERE event_name = 'job_visit') END AS clicks,
         CASE WHEN entity_id IS NULL THEN 0 ELSE count(*) FILTER (WHERE event_name = 'job_apply_start') END AS applies
  FROM {src} GROUP BY entity_id)"""


def days_raw_sql(start="start_date", end="end_date", status="workflow_state", as_of=AS_OF_TS) -> str:
    return (f"(CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL THEN date_sub('day', {start}, {end}) "
            f"WHEN {start} IS NOT NULL AND {status} = 'published' THEN date_sub('day', {start}, {as_of}) END)")


def upgrades_joined_sql(x: str) -> str:
    return (f"(CASE WHEN {_blank(x)} THEN 'None' ELSE "
            f"array_to_string(list_transform(string_split({x}, '|'), lambda u: trim(u)), ', ') END)")


def vacancy_report_sql(filtered_where: str) -> str:
    """Vacancy report over ``enriched WHERE filtered_where`` with benchmarks on all of it."""
    raw = days_raw_sql()
    ctes = ",\n".join([
        f"filtered AS (SELECT * FROM enriched WHERE {filtered_where})",
        vacancy_table_cte("vt", "filtered"),
        vacancy_table_cte("vfull", "enriched"),
        """bench AS (SELECT occupation, round_even(avg(clicks), 1) AS avg_clicks_occupation,
                  round_even(avg(applies), 1) AS avg_applies_occupation FROM vfull GROUP BY occupation)""",
    ])
    body = f"""SELECT vt.title, vt.organization_name AS company, vt.entity_id AS job_id,
       vt.workflow_state AS status, vt.start_date, vt.end_date,
       CASE WHEN {raw} > 0 THEN CAST({raw} AS INTEGER) END AS days_active,
       vt.uk_region AS region, vt.occupation, vt.importer_name AS importer,
       {upgrades_joined_sql('vt.upgrades')} AS upgrades,
       vt.clicks, vt.applies,
       CASE WHEN vt.clicks > 0 THEN round_even(vt.applies / vt.clicks * 100, 2) END AS ratio_pct,
       CASE WHEN {raw} > 0 THEN round_even(vt.clicks / {raw}, 2) END AS clicks_per_day,
       CASE WHEN {raw} > 0 THEN round_even(vt.applies / {raw}, 2) END AS applies_per_day,
       coalesce(b.avg_clicks_occupation, 0.0) AS avg_clicks_occupation,
       coalesce(b.avg_applies_occupation, 0.0) AS avg_applies_occupation
FROM vt LEFT JOIN bench b ON vt.occupation = b.occupation"""
    return with_base(body, ctes)
