"""Join of a large table with a table of one (or few) rows per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
_SALT = "_salt"


def join_small(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str] = ("ts",),
    how: str = "inner", salts: int = SALTS,
) -> DataFrame:
    """``big`` joined to per-key rows ``small``.

    Spark broadcasts ``small`` when its measured size allows. When it does not, a key that holds
    a large share of ``big`` is spread over ``salts`` tasks by the hash of the ``spread`` columns
    and meets a copy of its ``small`` rows in each of them. The hash depends on the row alone, so
    a recomputed task sends its rows to the same place.
    """
    copies = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn(_SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*on, _SALT], how).drop(_SALT)
