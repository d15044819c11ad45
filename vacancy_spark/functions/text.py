"""String column helpers. All return JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which str.isspace() is true; Spark's
# trim() only removes spaces. The set is derived from Python itself, not listed by hand.
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Strip leading/trailing Unicode whitespace (the semantics of ``str.strip``)."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    """True for null or whitespace-only strings."""
    c = col_of(c)
    return c.isNull() | (trim_ws(c) == F.lit(""))


def split_pipe(c) -> Column:
    """``'a | b||c'`` -> ``['a', 'b', '', 'c']``: split on ``|`` and strip each token."""
    return F.transform(F.split(col_of(c), r"\|"), lambda t: trim_ws(t))


def id_string(c) -> Column:
    """Identifier as a stripped string (``astype(str).str.strip()``)."""
    return trim_ws(col_of(c).cast("string"))


def first_token(c, sep_regex: str = r"\|") -> Column:
    """First token of a delimited string, stripped."""
    return trim_ws(F.split(col_of(c), sep_regex).getItem(0))
