"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from quarry.session import cut, shared_dir  # noqa: F401

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fresh(name: str, taken: list[str]) -> str:
    """A column name that isn't taken."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table to the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is dealt over several tasks from this share of all rows on, so there are at most as many such keys as its inverse.
HOT_SHARE = 0.001


def salted(rows: DataFrame, found: DataFrame, keys: list[str], spread: str, counted: DataFrame | None = None) -> DataFrame:
    """rows with what found has for their keys; found has one row for each key.

    The rows of a key that holds more than a thousandth of all are dealt by the column spread, and found's row goes to each
    part. counted: a table with the keys of rows, where rows itself would be computed twice.
    """
    counted = (rows if counted is None else counted).select(*keys)
    most = max(counted.count() * HOT_SHARE, 1)
    parts, salt = fresh("parts", rows.columns + found.columns), fresh("salt", rows.columns + found.columns)
    hot = F.broadcast(cut(counted.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias(parts))))
    of = F.coalesce(F.col(parts), F.lit(1))
    left = rows.join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(spread), of).cast("int")).drop(parts)
    right = found.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), of - 1))).drop(parts)
    return left.join(right, [*keys, salt]).drop(salt)
