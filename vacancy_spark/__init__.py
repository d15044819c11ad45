"""vacancy_spark: job-advert traffic analytics as Spark DataFrame operations.

Modules: ``session`` (settings, shared folder), ``functions`` (column expressions),
``sources`` (scans and file readers), ``operators`` (cleaning, filters, joins, metrics,
trends, vacancy reports, comparisons), ``plans`` (enrichment, materialised tables, table
maintenance, report bundles, the registered queries).
"""

__version__ = "0.1.0"
