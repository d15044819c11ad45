"""Which integer ranges a range-partitioned table has.

The descriptor lies beside the data, in a file that Spark's readers pass over, so that it is replaced
together with the table. A scan prunes partitions only by a descriptor; without one it reads all.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = "_ranges.json"


@dataclass(frozen=True)
class RangePartitions:
    """Partition ``bucket`` holds column // range i: [start + i * step, start + (i + 1) * step), up to the
    last boundary that does not exceed ``stop``; -1 what lies outside; null what is no number."""

    column: str
    start: int
    stop: int
    step: int
    bucket: str = "event_date_bucket"

    def __post_init__(self):
        if self.step <= 0 or self.stop < self.start + self.step:
            raise ValueError(f"no range in {self}")

    @property
    def count(self) -> int:
        return (self.stop - self.start) // self.step

    def of(self, x: Column) -> Column:
        """The partition of a whole number."""
        last = self.start + self.count * self.step
        inside = (x >= F.lit(self.start)) & (x < F.lit(last))
        return F.when(x.isNull(), F.lit(None).cast("int")).when(
            inside, F.floor((x - F.lit(self.start)) / F.lit(self.step)).cast("int")).otherwise(F.lit(-1))

    def from_on(self, cutoff: int, text: bool) -> Column:
        """A partition predicate that keeps every row with ``column >= cutoff``.

        ``text``: the column is compared as text of eight digits. Then only ranges of eight-digit
        numbers can be left out: a shorter number may be the larger text.
        """
        first = max(0, -(-(10**7 - self.start) // self.step)) if text else 0
        low = self.start if not text else max(self.start, 10**7)
        end = min(self.count, (cutoff - self.start) // self.step) if cutoff > low else 0
        b = F.col(self.bucket)
        return (b < F.lit(first)) | (b >= F.lit(max(first, end))) | b.isNull()

    def write(self, spark: SparkSession, path: str) -> None:
        p, fs = _fs(spark, f"{path}/{NAME}")
        out = fs.create(p, True)
        out.write(bytearray((json.dumps(asdict(self)) + "\n").encode()))
        out.close()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_ranges(spark: SparkSession, path: str) -> RangePartitions | None:
    """The descriptor of the table under ``path``, if it has one."""
    p, fs = _fs(spark, f"{path}/{NAME}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return RangePartitions(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def has_ranges(df: DataFrame, ranges: RangePartitions | None) -> bool:
    """Whether ``df`` has the partition column that the descriptor names, as whole numbers."""
    return (ranges is not None and ranges.bucket in df.columns
            and isinstance(df.schema[ranges.bucket].dataType, T.IntegralType))
