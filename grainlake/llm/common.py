"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.sources.shared import discard, materialise, new_path, shared_dir  # noqa: F401

#: Words wherever a contract counts them; what separates them are the space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows that Spark hands to a Python worker at once, unless the session has less already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Words in a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
