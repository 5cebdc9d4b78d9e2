"""Join helpers: size-checked broadcast and salted equi-joins for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast sides are checked against this many rows before the hint is
# given; above it the salted shuffle join is used instead.
DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_SALTS = 16


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain count: every task sends one number. (A ``limit`` before it
    would send that many rows of every partition to one task.)
    """
    return df.count() <= max_rows


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame | None:
    """The ids (``_again``, none of them NULL) that more than one row of
    ``df`` has, or None where there are none. Only the ids are shuffled."""
    from quarry.session import stage
    again = stage(df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("n"))
                  .where("n > 1").select("_again"), "repeated-ids")
    return None if again.isEmpty() else again


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS):
    """(df, True) with a broadcast hint when its size is proven small,
    else (df, False)."""
    if fits_broadcast(df, max_rows):
        return F.broadcast(df), True
    return df, False


def salted_join(big: DataFrame, small: DataFrame, keys: list[str],
                salts: int = DEFAULT_SALTS, spread_by: str | None = None,
                how: str = "inner") -> DataFrame:
    """Equi-join that survives a hot key on ``big``.

    Rows of ``big`` get a salt from ``spread_by`` (or a hash of the row
    content); ``small`` is replicated once per salt. A key holding a third
    of ``big`` is then spread over ``salts`` tasks.
    """
    if spread_by is not None:
        salt = F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts))
    else:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts))
    b = big.withColumn("_salt", salt.cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, keys + ["_salt"], how).drop("_salt")


def join_small(big: DataFrame, small: DataFrame, keys: list[str],
               max_rows: int = DEFAULT_BROADCAST_ROWS, salts: int = DEFAULT_SALTS,
               spread_by: str | None = None, how: str = "inner") -> DataFrame:
    """Broadcast ``small`` when its size is proven bounded, else salt."""
    small_b, ok = maybe_broadcast(small, max_rows)
    if ok:
        return big.join(small_b, keys, how)
    return salted_join(big, small, keys, salts=salts, spread_by=spread_by, how=how)
