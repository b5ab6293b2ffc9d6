"""Small column helpers shared by all jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The code of the first check whose condition holds, else NULL; a NULL condition does not hold."""
    return F.coalesce(*[F.when(cond, F.lit(code)) for cond, code in checks], F.lit(None).cast("string"))


LARGEST = 1.7976931348623157e308


def between(value: Column, low: float = -LARGEST, high: float = LARGEST) -> Column:
    """Finite and within the bounds; never NULL."""
    return F.coalesce(value.between(low, high), F.lit(False))


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later steps read many times, computed once.

    They pass through a one-row ``explode``: the optimizer does not copy expressions across it,
    where it would repeat a checksum or a parse for every check and every pushed filter.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.select("*", made.alias("_settled")).select(*df.columns, "_settled.*")


def settle_wide(df: DataFrame, **cols: Column) -> DataFrame:
    """The same for many or long expressions.

    They pass through a ``transform``, which Spark runs outside its fused loop, in methods that it splits: in the loop they would make
    one method of more than 8000 bytes, and the JVM runs such a method without ever compiling it.
    """
    made = F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])), lambda x: x), F.lit(0))
    return df.select("*", made.alias("_settled")).select(*df.columns, "_settled.*")
