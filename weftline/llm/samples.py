"""Bounded, deterministic samples of learning rows, and the fold that learning must not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text, modulo 4, is 2; such rows only measure.  A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def share_of(key: Column, seed: int) -> Column:
    """A uniform value in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), key), F.lit(1 << 30)) / float(1 << 30)


def sample_by(df: DataFrame, key: str, group: str, per_group: int, seed: int) -> DataFrame:
    """About ``per_group`` rows of each group, chosen by the hash of their key: one count over narrow columns, then a filter; no group is gathered."""
    counts = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    wanted = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        wanted = F.when(F.col(group).eqNullSafe(F.lit(value)), share_of(F.col(key), seed) < min(1.0, per_group / n)).otherwise(wanted)
    return df.where(wanted)
