"""Compositions: enrichment, materialised tables, table maintenance, reports, registry."""
