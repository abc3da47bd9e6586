"""Numeric column expressions.  All stay inside code generation; none raises under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    """A column given by exact name (names may hold dots, blanks, brackets) or as is."""
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


def to_number(c: str | Column) -> Column:
    """Text or number to double; anything unreadable and NaN become NULL."""
    return F.nanvl(as_col(c).try_cast("double"), F.lit(None).cast("double"))


def missing(c: str | Column, policy: str = "null_only") -> Column:
    """Is a cell missing?  ``null_or_nonpositive`` also counts 0 and negatives."""
    c = as_col(c)
    if policy == "null_only":
        return c.isNull()
    if policy == "null_or_nonpositive":
        return c.isNull() | (c <= 0)
    raise ValueError(f"unknown missing policy: {policy}")


def count_true(flags: Sequence[Column]) -> Column:
    """How many flags hold in a row (NULL counts as false)."""
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def all_true(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def any_true(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def round_half_even(c: str | Column, digits: int = 3) -> Column:
    """Scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(as_col(c) * F.lit(scale)) / F.lit(scale)


def midpoint(lo: str | Column, hi: str | Column, form: str = "mean") -> Column:
    """Middle of two bounds, as ``(lo+hi)/2`` or ``lo+(hi-lo)/2``."""
    lo, hi = as_col(lo), as_col(hi)
    if form == "mean":
        return (lo + hi) / F.lit(2.0)
    return lo + (hi - lo) / F.lit(2.0)


def ratio_pos(n: str | Column, d: str | Column) -> Column:
    """n/d where both are positive, else NULL."""
    n, d = as_col(n), as_col(d)
    return F.when((n > 0) & (d > 0), n / d)


def ratio_nz(n: str | Column, d: str | Column, positive_operands: bool = False) -> Column:
    """n/d with a zero denominator giving NULL; optionally non-positive operands are missing."""
    n, d = as_col(n), as_col(d)
    if positive_operands:
        n, d = F.when(n > 0, n), F.when(d > 0, d)
    return n / F.nullif(d, F.lit(0.0))


def safe_ratio(n: str | Column, d: str | Column) -> Column:
    """n/d, NULL for a zero denominator."""
    return F.try_divide(as_col(n), as_col(d))


def wrap_longitude(lon: str | Column) -> Column:
    """Longitude folded into [-180, 180)."""
    return F.pmod(as_col(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def log10_positive(c: str | Column) -> Column:
    """log10 of positive values, NULL otherwise."""
    c = as_col(c)
    return F.when(c > 0, F.log10(c))


def log10_clipped(c: str | Column, floor: float = 1e-12) -> Column:
    """log10 after lifting values to a small floor."""
    return F.log10(F.greatest(as_col(c), F.lit(floor)))


def resolve_age(columns: Sequence[str], available: Sequence[str], in_ga: bool = False) -> Column:
    """First readable age among the columns that exist; optionally Ma to Ga."""
    present = [to_number(c) for c in columns if c in available]
    age = F.coalesce(*present) if present else F.lit(None).cast("double")
    return age / F.lit(1000.0) if in_ga else age


def id_number(sample_id: str | Column) -> Column:
    """A whole number for a row id: the id itself if it is one, else 60 bits of its text's digest."""
    c = as_col(sample_id)
    return F.coalesce(c.try_cast("bigint"), _digest_bits(c.cast("string")))


def _digest_bits(text: Column) -> Column:
    """The first 60 bits of the MD5 digest of a text, as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sample_hash(sample_id: str | Column, seed: int) -> Column:
    """Pseudo-random order key in [0, 2**60) for a row id of any type.

    Digest bits of seed and id: neighbouring ids and different seeds give unrelated keys, and any
    SQL engine gives the same draw for the same seed.
    """
    return _digest_bits(F.concat(F.lit(f"{seed}|"), as_col(sample_id).cast("string")))


def draw_hash(sample_id: str | Column, draw: str | Column, seed: int) -> Column:
    """Pseudo-random integer in [0, 2147483647) for (row, draw number).

    The row's id is kept as its remainders by two primes below 2**31, 62 bits together, so two ids
    below 4.6e18 never have equal sequences of draws.  Each draw mixes its number into both lanes,
    which then pass through squaring steps that feed each other; plain integer arithmetic, the same in
    column expressions, NumPy and SQL.
    """
    i, j = id_number(sample_id), F.pmod(as_col(draw).cast("bigint"), F.lit(DRAW_SPAN))
    m, n = F.lit(HASH_SPAN), F.lit(OTHER_SPAN)
    x = F.pmod(F.pmod(i, m) * F.lit(7919) + j * F.lit(15485863) + F.lit(seed), m)
    v = F.pmod(F.pmod(i, n) * F.lit(104729) + j * F.lit(32452843) + F.lit(3 * seed), n)
    y = (x * x + v + j * F.lit(48271) + F.lit(12345)) % m
    u = (v * v + y) % n
    return (y * y + u) % m


def wide_draw(sample_id: str | Column, draw: int, seed: int) -> Column:
    """Two draws side by side: a pseudo-random integer of 62 bits, for remainders by large counts."""
    high, low = draw_hash(sample_id, F.lit(draw), seed), draw_hash(sample_id, F.lit(draw), seed + 7368787)
    return high * F.lit(HASH_SPAN).cast("bigint") + low


HASH_SPAN = 2147483647
OTHER_SPAN = 2147483629  # the prime before it
DRAW_SPAN = 1000003  # draw numbers repeat from here on
SAMPLE_BITS = 60
