"""Joins in which one key may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that a hot key's rows are dealt to.
SALTS = 64


def hot_keys(counts: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """Keys of ``counts`` (key, n; a row a key) with more than a thousandth of all rows (and 1000): under a thousand keys, whatever the size of the data, so they may be broadcast."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.join(F.broadcast(total), F.col(n) > 1000 + F.col("_total") / 1000).select(*key)


def join_one(left: DataFrame, right: DataFrame, key: list[str], hot: DataFrame, how: str = "inner", hint: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``left`` joined with the one row of ``right`` that has its key (inner or left). Rows of hot keys are dealt to ``SALTS`` parts by a hash of
    the row, and ``right``'s row of such a key is copied to each; all other rows stay one. ``hint``: a join hint for ``right``; ``by``: the columns that tell ``left``'s rows apart (default: all)."""
    known = F.broadcast(hot.select(*key, F.lit(SALTS).alias("_salts")))
    by = by or [c for c in left.columns if not left.schema[c].dataType.typeName() in ("map", "variant")]
    dealt = left.join(known, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_salts"))).cast("int")).drop("_salts")
    copies = right.join(known, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies.hint(hint) if hint else copies, [*key, "_salt"], how).drop("_salt")
