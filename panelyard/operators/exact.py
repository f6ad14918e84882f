"""Sums of doubles that are rounded once, whatever the order of rows and however they are dealt to tasks.

A finite double is a whole number times a power of two.  Values are scaled by the power of two of their bin (BITS exponents
each), which is exact, and split in a whole part and 54 bits behind the point; both are added as whole numbers, map side first.  A
group is left with a row for each bin that it has, 70 at most, from which the sum is made exactly and rounded to the nearest
double, ties to even.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators.scans import same

BITS, BEHIND = 32, 54
_LOW, _HIGH = -35, 32
#: Bins of what is not a finite number.
_PLUS, _MINUS, _NAN, _NULL = 1000, 1001, 1002, 1003


def _parts(x: Column) -> dict[str, Column]:
    """bin, whole and rest of a double: x = (whole + rest / 2**BEHIND) * 2**(BITS * bin)."""
    odd = F.when(x.isNull(), _NULL).when(F.isnan(x), _NAN).when(x == float("inf"), _PLUS).when(x == float("-inf"), _MINUS)
    level = F.floor(F.log2(F.abs(x)) / BITS).cast("int")  # near a border either bin will do
    bin_ = F.when(odd.isNotNull(), odd).when(x == 0, 0).otherwise(level)
    half = F.get(F.array(*[F.lit(2.0 ** (-BITS // 2 * k)) for k in range(_LOW, _HIGH + 1)]), bin_ - _LOW)  # twice, as one step may leave the doubles' range
    y = F.when(odd.isNull(), x * half * half)
    return {"_bin": bin_, "_y": y}


def _lone_bin(p: Column, n: Column) -> Column:
    """The sum of a group that has one bin of moderate size, where one addition of doubles is its only rounding; else null.

    The rest is brought below one; it is even, as a scaled value has no bit below 2**(1 - BEHIND), so either part is a double.
    """
    unit = F.lit(1 << BEHIND).cast("decimal(17, 0)")
    carry = F.floor(p["rest"] / unit)
    whole, rest = p["whole"] + carry, p["rest"] - carry * unit
    scale = F.get(F.array(*[F.lit(2.0 ** (BITS * k)) for k in range(-20, 21)]), p["bin"] + 20)
    plain = (n == 1) & p["bin"].between(-20, 20) & (F.abs(whole) <= F.lit(1 << 53)) & (F.abs(rest) <= unit) & (rest % 2 == 0)
    return F.when(plain, (whole.cast("double") + rest.cast("double") * F.lit(2.0**-BEHIND)) * scale)


@F.pandas_udf(T.DoubleType())
def rounded(parts: pd.Series) -> pd.Series:
    """The sum of a group's bins, which hold no NaN and one infinity at most; null for no number, or no bins."""
    return parts.map(lambda p: None if p is None else _total(p))


def _total(parts) -> float | None:
    seen = {p["bin"] for p in parts}
    if seen & {_PLUS, _MINUS}:
        return float("inf") if _PLUS in seen else float("-inf")
    if not seen - {_NULL}:
        return None
    whole = sum(((int(p["whole"]) << BEHIND) + int(p["rest"])) << (BITS * (p["bin"] - _LOW)) for p in parts if p["bin"] < _PLUS)
    try:
        return whole / (1 << (BEHIND - BITS * _LOW))  # one rounding
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


def exact_sums(df: DataFrame, by: list[str], values: dict[str, Column], spoilt: bool = False) -> DataFrame:
    """``by`` and a sum for each of ``values``: equal to the true sum of the doubles, rounded once.

    Null for no number; nulls are left out, or make the sum null where ``spoilt``.  A sum beyond the doubles is infinite.
    """
    each = df.select(*by, F.posexplode(F.array(*[v.cast("double") for v in values.values()])).alias("_c", "_x"))
    split = each.withColumns(_parts(F.col("_x"))).withColumn("_whole", F.col("_y").cast("long"))
    split = split.withColumn("_rest", ((F.col("_y") - F.col("_whole")) * float(1 << BEHIND)).cast("long"))
    summed = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20, 0)")), F.lit(0).cast("decimal(30, 0)"))
    bins = split.groupBy(*by, "_c", "_bin").agg(summed("_whole").alias("_whole"), summed("_rest").alias("_rest"))
    held = bins.groupBy(*by).agg(F.collect_list(F.struct("_c", F.col("_bin").alias("bin"), F.col("_whole").alias("whole"), F.col("_rest").alias("rest"))).alias("_held"))

    def total(k: int) -> Column:
        own = F.filter("_held", lambda p: p["_c"] == k)
        alone = _lone_bin(F.get(own, F.lit(0)), F.size(own))
        several = F.when(alone.isNull(), F.transform(own, lambda p: F.struct(p["bin"].alias("bin"), p["whole"].alias("whole"), p["rest"].alias("rest"))))
        whole = F.coalesce(alone, rounded(several))
        has = lambda b: F.exists(own, lambda p: p["bin"] == b)
        whole = F.when(has(_NAN) | (has(_PLUS) & has(_MINUS)), F.lit(float("nan"))).otherwise(whole)  # a pandas UDF gives no NaN
        return F.when(~has(_NULL), whole) if spoilt else whole

    return held.select(*by, *(total(k).alias(name) for k, name in enumerate(values)))


#: A digit of what is behind the point in :func:`digits`, and the size from which values are left to :func:`exact_sums`.
_DIGIT, _MOST = BEHIND // 2, 2.0**36


def digits(value: Column, name: str) -> dict[str, Column]:
    """A double as whole numbers that plain sums add exactly: ``name`` with _whole, _high and _low (two digits behind the point), or
    with _odd for a number that has no such form (not finite, 2**36 and more, bits below 2**-54).  See :func:`added`."""
    x = value.cast("double")
    whole = F.when(F.abs(x) < _MOST, x).cast("long")
    behind = (x - whole) * float(1 << BEHIND)
    rest = behind.cast("long")  # null where the whole part is
    plain = rest.cast("double") == behind
    kept = lambda c: F.when(plain, c)
    return {f"{name}_whole": kept(whole), f"{name}_high": kept(F.shiftright(rest, _DIGIT)), f"{name}_low": kept(rest.bitwiseAND((1 << _DIGIT) - 1)), f"{name}_odd": F.when(x.isNotNull() & ~F.coalesce(plain, F.lit(False)), True)}


def added(name: str, over: Callable[[Column], Column] = lambda c: c) -> dict[str, Column]:
    """Aggregates of the columns of :func:`digits`, under the same names; ``over`` puts them in a window."""
    return {f"{name}_{d}": over(F.try_sum(f"{name}_{d}")) for d in ("whole", "high", "low")} | {f"{name}_odd": over(F.count(f"{name}_odd"))}


def told(name: str) -> Column:
    """The sum from the columns of :func:`added`, rounded once; null where that isn't sure (odd numbers, no number at all, sums that
    are too large or too near to zero), which :func:`exact_sums` must add.

    What is behind the point is brought below one and into 53 bits, the last of which also stands for the one that is cut off;
    far enough from zero that is no tie, so the one addition of doubles rounds as the whole sum would.
    """
    mask = F.lit((1 << _DIGIT) - 1).cast("long")
    high = F.col(f"{name}_high") + F.shiftright(F.col(f"{name}_low"), _DIGIT)
    whole = F.col(f"{name}_whole") + F.shiftright(high, _DIGIT)
    rest = F.shiftleft(high.bitwiseAND(mask), _DIGIT).bitwiseOR(F.col(f"{name}_low").bitwiseAND(mask))
    last = rest.bitwiseAND(F.lit(1).cast("long"))
    total = F.when(whole.between(-(1 << 53), 1 << 53) & ((last == 0) | ~whole.between(-2, 1)), whole.cast("double") + F.shiftright(rest, 1).bitwiseOR(last).cast("double") * F.lit(2.0 ** (1 - BEHIND)))
    small = lambda c: F.col(c).between(-(1 << 60), 1 << 60)
    return F.when((F.col(f"{name}_odd") == 0) & small(f"{name}_whole") & small(f"{name}_high") & small(f"{name}_low"), total)


def joined(df: DataFrame, by: list[str], *others: DataFrame) -> DataFrame:
    """``df`` with the other columns of tables that have one row for each ``by``; null keys meet."""

    def one(left: DataFrame, right: DataFrame) -> DataFrame:
        more = [c for c in right.columns if c not in by]
        if not by:
            return left.crossJoin(F.broadcast(right))  # one row
        return left.alias("l").join(right.alias("r"), same("l", "r", by), "left").select("l.*", *(F.col(f"r.`{c}`") for c in more))

    return reduce(one, others, df)
