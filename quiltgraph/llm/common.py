"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.plans.storage import materialise, work_dir  # noqa: F401

#: White space of the word contracts: the blank and the code points 9 to 13.
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Lower-cases A-Z alone, for str.translate.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skew_safe_lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, spread: str) -> DataFrame:
    """left with the columns of right for its key (a left outer join), though one key may hold most of left.

    right has each key once, with the number of rows of left that have it in ``count``; total is the number
    of rows of left. Keys that hold more than a thousandth of left, fewer than a thousand in all, are looked
    up by a broadcast join; their rows are spread by a hash of the column ``spread`` in the join of the rest.
    """
    values = [c for c in right.columns if c not in (key, count)]
    packed = right.select(key, count, F.struct(*values).alias("_value"))
    hot = packed.where(F.col(count) * 1000 > total).select(key, F.col("_value").alias("_hot"))
    rest = packed.where(F.col(count) * 1000 <= total).select(key, F.lit(0).alias("_salt"), F.col("_value").alias("_rest"))
    held = left.join(F.broadcast(hot), key, "left")
    held = held.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(65_536))).cast("int"))
    held = held.join(rest, [key, "_salt"], "left").withColumn("_value", F.coalesce("_hot", "_rest"))
    return held.select(*left.columns, *[F.col("_value")[c].alias(c) for c in values])


def few_at_once(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of an Arrow column as Python objects, of which few are held at once."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def ascii_lower(col):
    """A-Z in lower case, other letters as they are; texts of ASCII alone take the faster function, which is the same for them."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col):
    """array<string> of the words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish
