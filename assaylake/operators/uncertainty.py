"""Bootstrap intervals and densities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import DRAW_SPAN, HASH_SPAN, OTHER_SPAN, as_col, draw_hash, id_number, sample_hash
from .filters import unpivot
from .ordering import attach, exact_quantiles, hash_rank

# Distribution function of a Poisson count with mean 1, up to 11.
POISSON_ONE_CDF = list(accumulate(math.exp(-1.0) / math.factorial(k) for k in range(12)))


def poisson_one(h: Column) -> Column:
    """A Poisson count with mean 1 out of a uniform integer hash."""
    u = h / F.lit(float(HASH_SPAN))
    out = F.lit(len(POISSON_ONE_CDF))
    for k in range(len(POISSON_ONE_CDF) - 1, -1, -1):
        out = F.when(u < POISSON_ONE_CDF[k], F.lit(k)).otherwise(out)
    return out


def weighted_bootstrap(
    df: DataFrame, by: Sequence[str], value: str, weight: str | None = None, reps: int = 2000,
    seed: int = 20240611, id_col: str = "sample_id", method: str = "poisson",
) -> DataFrame:
    """Weighted mean per group with bootstrap deviation and 95 % interval.

    Rows need a value and a weight above 0; groups below three rows get counts only.
    ``poisson``, the method for groups of any size, gives every row an independent Poisson count
    per replicate: tasks sum per group and replicate, and only these sums are shuffled.
    ``multinomial`` draws exactly n rows with replacement per replicate; draws are summed where they are
    made.  Draws depend on the row id and the replicate only.
    """
    w = as_col(weight) if weight else F.lit(1.0)
    keys = list(by)
    rows = df.select(
        *[as_col(k) for k in keys], as_col(id_col).alias("_id"),
        as_col(value).cast("double").alias("_x"), w.cast("double").alias("_w"),
    ).where(F.col("_x").isNotNull() & (F.col("_w") > 0))
    stats = rows.groupBy(*[as_col(k) for k in keys]).agg(
        (F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("weighted_mean"),
        F.count(F.lit(1)).alias("n"),
        F.sum("_w").alias("weight_sum"),
        (F.sum("_w") * F.sum("_w") / F.sum(F.col("_w") * F.col("_w"))).alias("effective_n"),
    )
    sized = attach(rows, stats.select(*[as_col(k) for k in keys], F.col("n").alias("_n")), keys)
    sized = sized.where(F.col("_n") >= 3)
    if method == "poisson":
        means = _poisson_means(sized, keys, reps, seed)
    elif method == "multinomial":
        means = _multinomial_means(sized, keys, reps, seed)
    else:
        raise ValueError(f"unknown method: {method}")
    # One value per replicate and group: bounded by ``reps``.
    spread = means.groupBy(*[as_col(k) for k in keys]).agg(
        F.stddev_samp("_mean").alias("bootstrap_sem"),
        F.percentile("_mean", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"),
    )
    small = F.col("n") < 3
    return attach(stats, spread, keys).select(
        *[as_col(k) for k in keys],
        F.when(~small, F.col("weighted_mean")).alias("weighted_mean"),
        "bootstrap_sem",
        F.get("_ci", 0).alias("bootstrap_ci_lo"), F.get("_ci", 1).alias("bootstrap_ci_hi"),
        "n", "weight_sum", F.when(~small, F.col("effective_n")).alias("effective_n"),
    )


def _replicate_mean() -> Column:
    return F.try_divide(
        F.sum(F.col("_c") * F.col("_w") * F.col("_x")), F.sum(F.col("_c") * F.col("_w"))
    ).alias("_mean")


_GROUPS_HELD = 256  # groups whose sums a task holds before it passes them on


def _poisson_sums(ids: np.ndarray, x: np.ndarray, w: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Sums of count*weight*value and count*weight per replicate; counts as ``poisson_one(draw_hash)``."""
    sums, cdf = np.zeros((2, reps)), np.array(POISSON_ONE_CDF)
    j = np.arange(1, reps + 1, dtype=np.int64)[None, :]
    for at in range(0, len(ids), 512):
        i = ids[at:at + 512, None]
        lane = (np.mod(i, HASH_SPAN) * 7919 + j * 15485863 + seed) % HASH_SPAN
        other = (np.mod(i, OTHER_SPAN) * 104729 + j * 32452843 + 3 * seed) % OTHER_SPAN
        mixed = (lane * lane + other + j * 48271 + 12345) % HASH_SPAN
        u = ((mixed * mixed + (other * other + mixed) % OTHER_SPAN) % HASH_SPAN) / float(HASH_SPAN)
        count = np.searchsorted(cdf, u, side="right").astype(float)
        weight = w[at:at + 512]
        sums += np.stack([weight * x[at:at + 512], weight]) @ count
    return sums


def _poisson_means(rows: DataFrame, keys: Sequence[str], reps: int, seed: int) -> DataFrame:
    """One sum pair per group, replicate and task goes through the shuffle, whatever the rows."""
    if reps >= DRAW_SPAN:
        raise ValueError("at most 1,000,002 replicates")
    names = [*keys, "_rep", "_a", "_b"]
    given = rows.select(*[as_col(k) for k in keys], id_number("_id").alias("_id"), "_x", "_w")
    schema = StructType([given.schema[k] for k in keys]).add("_rep", "integer").add("_a", "double").add("_b", "double")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"_rep": np.tile(np.arange(1, reps + 1), len(held)), "_a": np.concatenate([v[1][0] for v in held.values()]),
                                "_b": np.concatenate([v[1][1] for v in held.values()])})
            for c in keys:
                out[c] = pd.concat([v[0][c] for v in held.values()]).repeat(reps).to_numpy()
            held.clear()
            return out[names]

        for batch in batches:
            groups = batch.groupby(list(keys), dropna=False, sort=False) if keys else [((), batch)]
            for key, part in groups:
                sums = _poisson_sums(part["_id"].to_numpy(np.int64), part["_x"].to_numpy(), part["_w"].to_numpy(), reps, seed)
                key = tuple(None if k != k else k for k in key)  # NaN and null alike
                if key in held:
                    held[key][1] += sums
                else:
                    held[key] = [part.iloc[:1], sums]
                if len(held) >= _GROUPS_HELD:
                    yield flush()
        if held:
            yield flush()

    sums = given.mapInPandas(each, schema).groupBy(*[as_col(k) for k in keys], "_rep").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return sums.where(F.col("_b") > 0).select(*[as_col(k) for k in keys], "_rep", F.try_divide("_a", "_b").alias("_mean"))


_DRAWN = 1 << 16  # draws that a task makes at a time
_SPAN_DRAWN = 1 << 31  # draws that a piece of values gets on average at most
_POSITIONS = 1 << 20  # values per piece at most
_BLOCK = 1 << 15  # rows per block of drawing rows


def _modulo(x: np.ndarray, span: int) -> np.ndarray:
    """x modulo span in place, for x of 0 or more; dividing is vectorised, the remainder is not."""
    x -= x // span * span
    return x


def _draw_positions(ids: np.ndarray, size: int, reps: np.ndarray, seed: int) -> np.ndarray:
    """Positions from 0 that a group's rows draw in replicates (rows, replicates), as ``draw_hash`` modulo the group's rows."""
    i, j = ids[:, None], reps[None, :].astype(np.int64)
    x = _modulo(np.mod(i, HASH_SPAN) * 7919 % HASH_SPAN + (j * 15485863 + seed) % HASH_SPAN, HASH_SPAN)
    v = _modulo(np.mod(i, OTHER_SPAN) * 104729 % OTHER_SPAN + (j * 32452843 + 3 * seed) % OTHER_SPAN, OTHER_SPAN)
    x *= x
    x += v
    x += j * 48271 + 12345
    y = _modulo(x, HASH_SPAN)
    v *= v
    v += y
    v = _modulo(v, OTHER_SPAN)
    y *= y
    y += v
    return _modulo(_modulo(y, HASH_SPAN), size)


def _multinomial_sums(ids: np.ndarray, x: np.ndarray, w: np.ndarray, low: int, size: int, reps: int, seed: int) -> np.ndarray:
    """Sums of weight*value and weight per replicate over the draws that land on the positions from ``low`` on.

    ``x`` holds the products and ``w`` the weights of these positions; ``size`` is the group's number of rows.
    """
    total, whole = np.zeros((2, reps)), len(w) == size
    if not whole:  # what lands elsewhere meets the zero behind the last value
        x, w = np.append(x, 0.0), np.append(w, 0.0)
    for first in range(1, reps + 1, _DRAWN):
        turn = np.arange(first, min(first + _DRAWN, reps + 1))
        step = max(1, _DRAWN // len(turn))
        for at in range(0, len(ids), step):
            where = _draw_positions(ids[at:at + step], size, turn, seed)
            if not whole:
                where -= low
                where[(where < 0) | (where >= len(w) - 1)] = len(w) - 1
            total[0, first - 1:first - 1 + len(turn)] += x[where].sum(axis=0)
            total[1, first - 1:first - 1 + len(turn)] += w[where].sum(axis=0)
    return total


def _multinomial_means(rows: DataFrame, keys: Sequence[str], reps: int, seed: int) -> DataFrame:
    """n draws per replicate: every row hands out one draw, which lands on a hashed position.

    Draws are made where they are summed up and never shuffled: a block of drawing rows meets its group's
    values, in pieces of bounded size, and hands on one sum pair per replicate.  A group of several pieces
    makes its draws once for each of them.
    """
    if reps >= DRAW_SPAN:
        raise ValueError("at most 1,000,002 replicates")
    key_cols = [as_col(k) for k in keys]
    ranked = hash_rank(rows, keys, sample_hash("_id", seed), "_id", "_pos").drop("n")
    # A group's name in the tasks; adding 0 makes the two zeros one, and JSON would cut times to milliseconds.
    exact = {"double": lambda c: c + F.lit(0.0), "float": lambda c: c + F.lit(0.0), "timestamp": F.unix_micros, "timestamp_ntz": lambda c: c.cast("string")}
    plain = [exact.get(ranked.schema[k].dataType.typeName(), lambda c: c)(c).alias(f"k{i}") for i, (k, c) in enumerate(zip(keys, key_cols))]
    ranked = ranked.withColumn("_g", F.to_json(F.struct(*plain)) if keys else F.lit(""))
    place, width = F.col("_pos").cast("long") - 1, min(_POSITIONS, max(1, _SPAN_DRAWN // reps))
    parts = lambda n, size: range(-(-int(n) // size))

    def piece(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        w = part["_w"].to_numpy()
        return pd.DataFrame({"_g": key[0], "_piece": [key[1]], "_n": part["_n"].iloc[:1].to_numpy(), "_xs": [(w * part["_x"].to_numpy()).tobytes()], "_ws": [w.tobytes()]})

    def block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_g": key[0], "_block": [key[1]], "_n": part["_n"].iloc[:1].to_numpy(), "_ids": [part["_id"].to_numpy(np.int64).tobytes()]})

    def spread(name: str, size: int):
        """Every row once for each block or piece of its group."""
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(len(batch)):
                    row = batch.iloc[at:at + 1]
                    for turn in parts(row["_n"].iloc[0], size):
                        yield row.assign(**{name: np.int32(turn)})
        return each

    values = ranked.select("_g", F.floor(place / F.lit(width)).cast("int").alias("_piece"), "_n", "_pos", "_x", "_w") \
        .groupBy("_g", "_piece").applyInPandas(piece, "_g string, _piece int, _n long, _xs binary, _ws binary") \
        .mapInPandas(spread("_block", _BLOCK), "_g string, _piece int, _n long, _xs binary, _ws binary, _block int").drop("_n")
    drawing = ranked.select("_g", F.floor(place / F.lit(_BLOCK)).cast("int").alias("_block"), "_n", id_number("_id").alias("_id")) \
        .groupBy("_g", "_block").applyInPandas(block, "_g string, _block int, _n long, _ids binary") \
        .mapInPandas(spread("_piece", width), "_g string, _block int, _n long, _ids binary, _piece int")
    # The work is in the draws, not in the bytes, so tasks are not put together by size; nor may a side that grew by its copies be broadcast.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = drawing.repartition(tasks, "_g", "_block", "_piece").hint("merge").join(values, ["_g", "_block", "_piece"]).select("_g", "_piece", "_n", "_ids", "_xs", "_ws")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, at, size, ids, xs, ws in zip(*[batch[c] for c in batch.columns]):
                total = _multinomial_sums(np.frombuffer(ids, np.int64), np.frombuffer(xs), np.frombuffer(ws), int(at) * width, int(size), reps, seed)
                drawn = np.flatnonzero(total[1])
                yield pd.DataFrame({"_g": name, "_rep": drawn.astype(np.int32) + 1, "_a": total[0][drawn], "_b": total[1][drawn]})

    sums = met.mapInPandas(add, "_g string, _rep int, _a double, _b double")
    means = sums.groupBy("_g", "_rep").agg((F.sum("_a") / F.sum("_b")).alias("_mean"))
    names = ranked.groupBy("_g").agg(*[F.first(c).alias(k) for k, c in zip(keys, key_cols)], F.count(F.lit(1)).alias("_n"))
    return attach(means, names, ["_g"], "inner").select(*key_cols, "_rep", "_mean")


def binomial_quantiles(n: int, p: float, levels: Sequence[float]) -> list[int]:
    """Smallest counts whose distribution function reaches each level; exact up to rounding.

    Terms are built from the most likely count outwards by the ratio of neighbours, over the counts
    that carry any weight in double precision: some tens of standard deviations, whatever ``n``.
    """
    if p <= 0 or p >= 1:
        return [n if p >= 1 else 0] * len(levels)
    reach = 40 * math.sqrt(n * p * (1 - p)) + 40
    mode = min(n, int((n + 1) * p))
    low, high = max(0, int(mode - reach)), min(n, int(mode + reach))
    up, down = np.arange(mode, high), np.arange(mode, low, -1)
    odds = math.log(p) - math.log1p(-p)
    logs = np.concatenate([
        np.cumsum(np.log(down) - np.log(n - down + 1) - odds)[::-1], [0.0], np.cumsum(np.log(n - up) - np.log(up + 1) + odds)])
    mass = np.cumsum(np.exp(logs))
    return [low + int(np.searchsorted(mass, level * mass[-1])) for level in levels]


def proportion_ci(
    df: DataFrame, by: Sequence[str], flag: Column | None = None, n: str | None = None, k: str | None = None,
) -> DataFrame:
    """Share of flagged rows per group with its 95 % bootstrap interval.

    Resampling n zeros and ones gives a binomial count, so the interval is read from the binomial
    distribution itself, the limit of ever more replicates, and only ``(n, k)`` per group is needed:
    rows are counted first, or ready counts are given by column name.
    """
    keys = [as_col(c) for c in by]
    if flag is not None:
        counts = df.groupBy(*keys).agg(F.count(flag).alias("n"), F.count_if(flag).alias("k"))
    else:
        counts = df.select(*keys, as_col(n).cast("bigint").alias("n"), as_col(k).cast("bigint").alias("k"))
    counts = counts.where(F.col("n") > 0)

    @F.pandas_udf("array<double>")
    def interval(size: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([[q / m for q in binomial_quantiles(int(m), s / m, (0.025, 0.975))] for m, s in zip(size, hits)])

    return counts.withColumn("_ci", interval("n", "k")).select(
        *keys, "n", (F.col("k") / F.col("n")).alias("frac"),
        F.get("_ci", 0).alias("lo"), F.get("_ci", 1).alias("hi"),
    )


# --- grids ------------------------------------------------------------------------------------


def smooth_array(values: Column, sigma: Column, radius: Column, edge: bool) -> Column:
    """Gaussian smoothing of an array; outside is the edge value or 0.  Arrays are grid-sized."""
    offsets = F.sequence(-radius, radius)
    weight = lambda o: F.exp(F.lit(-0.5) * (o / sigma) * (o / sigma))
    kernel = F.transform(offsets, weight)
    norm = F.aggregate(kernel, F.lit(0.0), lambda a, x: a + x)
    size = F.size(values)

    def at(i: Column) -> Column:
        if edge:
            return F.get(values, F.greatest(F.lit(0), F.least(size - 1, i)))
        return F.when((i < 0) | (i >= size), F.lit(0.0)).otherwise(F.get(values, F.greatest(F.lit(0), i)))

    def one(i: Column) -> Column:
        return F.aggregate(
            offsets, F.lit(0.0), lambda a, o: a + weight(o) * at((i + o).cast("int"))
        ) / norm

    return F.transform(F.sequence(F.lit(0), size - 1), one)


def interp_grid(
    df: DataFrame, keys: Sequence[str], x: str, y: str, lo: float, hi: float, points: int
) -> DataFrame:
    """Linear interpolation of a binned series onto an even grid, 0 outside its range.

    The series has one point per bin; gives keys, ``i``, ``grid`` and ``value``.
    """
    step = (hi - lo) / (points - 1)
    series = df.where(as_col(x).isNotNull()).groupBy(*[as_col(k) for k in keys]).agg(
        F.array_sort(F.collect_list(F.struct(
            as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y")))).alias("_p")
    )
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                       lambda i: F.lit(lo) + i * F.lit(step))
    before = lambda g: F.try_element_at(F.filter("_p", lambda p: p["x"] <= g), F.lit(-1))
    after = lambda g: F.get(F.filter("_p", lambda p: p["x"] >= g), 0)

    def value(g: Column) -> Column:
        a, b = before(g), after(g)
        share = F.coalesce(F.try_divide(g - a["x"], b["x"] - a["x"]), F.lit(0.0))
        return F.coalesce(a["y"] + (b["y"] - a["y"]) * share, F.lit(0.0))

    return series.select(
        *[as_col(k) for k in keys], F.posexplode(F.transform(grid, lambda g: F.struct(
            g.alias("grid"), value(g).alias("value")))).alias("i", "_s"),
    ).select(*[as_col(k) for k in keys], "i", "_s.grid", "_s.value")


def smooth_grid(
    df: DataFrame, keys: Sequence[str], index: str = "i", value: str = "value", sigma: float = 12.0
) -> DataFrame:
    """Gaussian smoothing along a grid with repeated edges, radius three sigma.

    Series of fewer than three points or all zero stay as they are.
    """
    key_cols = [as_col(k) for k in keys]
    arrays = df.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(as_col(index).alias("i"), as_col(value).alias("v")))),
                    lambda s: s["v"]).alias("_v")
    )
    radius = max(1, int(sigma * 3.0))
    flat = F.forall("_v", lambda v: F.abs(v) <= 1e-8)
    smooth = F.when((F.size("_v") < 3) | flat, F.col("_v")).otherwise(
        smooth_array(F.col("_v"), F.lit(float(sigma)), F.lit(radius), edge=True)
    )
    return arrays.select(*key_cols, F.posexplode(smooth).alias(index, value))


def density_1d(df: DataFrame, keys: Sequence[str], col: str, bins: int = 256) -> DataFrame:
    """Smoothed density per group: histogram between P0.5 and P99.5, normal-rule bandwidth.

    Gives keys, bin, centre and density.
    """
    key_cols = [as_col(k) for k in keys]
    rows = df.select(*key_cols, as_col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    facts = rows.groupBy(*key_cols).agg(
        F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.stddev_pop("_x").alias("_sd"),
        F.count(F.lit(1)).alias("_n"),
    )
    cuts = exact_quantiles(rows, keys, "_x", [0.005, 0.995]).drop("n")
    lo, hi = F.get("q", 0), F.get("q", 1)
    ok = hi > lo
    span = attach(facts, cuts, keys).withColumns(
        {"_lo": F.when(ok, lo).otherwise(F.col("_min")), "_hi": F.when(ok, hi).otherwise(F.col("_max"))}
    ).withColumn("_hi", F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo") + 1.0))
    span = span.select(*key_cols, "_lo", "_hi", "_sd", "_n")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    at = F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (
        attach(rows, span, keys).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*key_cols, at.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    )
    arrays = counts.groupBy(*key_cols).agg(
        F.map_from_entries(F.collect_list(F.struct("_b", "_c"))).alias("_h"), F.sum("_c").alias("_in")
    )
    wide = attach(arrays, span, keys).withColumn("_w", width)
    hist = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: F.coalesce(F.try_element_at("_h", i), F.lit(0)) / (F.col("_in") * F.col("_w")),
    )
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.col("_w"))
    bandwidth = F.lit(1.06) * sd * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    sigma = F.greatest(bandwidth / F.col("_w"), F.lit(1.0))
    wide = wide.withColumns({"_hist": hist, "_sigma": sigma})
    radius = F.ceil(F.lit(4.0) * F.col("_sigma")).cast("int")
    done = wide.select(
        *key_cols, "_lo", "_w",
        F.posexplode(smooth_array(F.col("_hist"), F.col("_sigma"), radius, edge=False)).alias("bin", "density"),
    )
    centre = F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")
    return done.select(*key_cols, "bin", centre.alias("centre"), "density")


def density_2d(
    df: DataFrame, x: str, y: str, x_limits: tuple[float, float], y_limits: tuple[float, float],
    x_bins: int = 150, y_bins: int = 120, sigma: float = 6.0,
) -> DataFrame:
    """Density on a grid, smoothed along both axes and scaled to a maximum of 1: ix, iy, density."""
    def cell(v: Column, limits: tuple[float, float], bins: int) -> Column:
        width = (limits[1] - limits[0]) / bins
        return F.least(F.floor((v - F.lit(limits[0])) / F.lit(width)), F.lit(bins - 1)).cast("int")

    inside = as_col(x).between(*x_limits) & as_col(y).between(*y_limits)
    counts = df.where(inside).groupBy(
        cell(as_col(x), x_limits, x_bins).alias("ix"), cell(as_col(y), y_limits, y_bins).alias("iy")
    ).agg(F.count(F.lit(1)).cast("double").alias("v"))
    counts = attach(counts, counts.agg(F.sum("v").alias("_all")), []).select(
        "ix", "iy", (F.col("v") / F.col("_all")).alias("v"))
    radius = int(np.ceil(4.0 * max(sigma, 0.8)))

    def along(table: DataFrame, axis: str, other: str, bins: int) -> DataFrame:
        maps = table.groupBy(other).agg(F.map_from_entries(F.collect_list(F.struct(axis, "v"))).alias("_m"))
        full = F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)),
        )
        maps = maps.withColumn("_a", full)
        smooth = smooth_array(F.col("_a"), F.lit(max(sigma, 0.8)), F.lit(radius), edge=False)
        return maps.select(other, F.posexplode(smooth).alias(axis, "v"))

    grid = along(along(counts, "ix", "iy", x_bins), "iy", "ix", y_bins)
    top = grid.agg(F.max("v").alias("_top"))
    return attach(grid, top, []).select(
        "ix", "iy", F.when(F.col("_top") > 0, F.col("v") / F.col("_top")).otherwise(F.col("v")).alias("density")
    )


def mass_level(grid: DataFrame, fraction: float, density: str = "density") -> DataFrame:
    """Density level whose upper set holds a fraction of the mass.  The grid has fixed size."""
    cells = grid.where(as_col(density) > 0).select(as_col(density).alias("_d"))
    everything = Window.partitionBy(F.lit(0))
    falling = everything.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.select("_d", (F.sum("_d").over(falling) / F.sum("_d").over(everything)).alias("_s"))
    return run.agg(F.coalesce(F.max(F.when(F.col("_s") >= fraction, F.col("_d"))), F.min("_d")).alias("level"))


def robust_range(df: DataFrame, cols: Sequence[str], pad: float = 0.06, lower: float = 0.005, upper: float = 0.995) -> DataFrame:
    """Axis range per column: P0.5 to P99.5 widened by a pad; falls back to the full range."""
    long = unpivot(df, [], cols)
    q = exact_quantiles(long, ["feature"], "value", [lower, upper, 0.0, 1.0])
    at = lambda i: F.get("q", i)
    ok = at(1) > at(0)
    lo = F.when(ok, at(0)).otherwise(at(2))
    hi = F.when(ok, at(1)).otherwise(at(3))
    out = q.select("feature", lo.alias("lo"), hi.alias("hi"))
    out = out.withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1.0))
    span = (F.col("hi") - F.col("lo")) * F.lit(pad)
    return out.select("feature", (F.col("lo") - span).alias("lo"), (F.col("hi") + span).alias("hi"))


def kernel_profile(
    df: DataFrame, by: str, age: str, lo: float, hi: float, points: int = 600, bandwidth: float = 0.06,
    nominal: Mapping[str, float] | None = None,
) -> DataFrame:
    """Sum of Gaussian kernels of ages on an even grid per unit, scaled to a maximum of 1.

    Equal ages are counted first.  A unit of ``nominal`` without any age gets one kernel at its
    nominal age.
    """
    counted = df.where(as_col(age).isNotNull()).groupBy(
        as_col(by).alias("unit"), as_col(age).cast("double").alias("_a")
    ).agg(F.count(F.lit(1)).alias("_c"))
    if nominal:
        stand_in = df.sparkSession.createDataFrame(
            [(u, float(a), 1) for u, a in nominal.items()], "unit string, _a double, _c bigint"
        )
        have = counted.select("unit").distinct()
        counted = counted.unionByName(stand_in.join(have, "unit", "left_anti"))
    step = (hi - lo) / (points - 1)
    rows = counted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    gap = F.lit(lo) + F.col("i") * F.lit(step) - F.col("_a")
    kernel = F.exp(-(gap * gap) / F.lit(2.0 * bandwidth * bandwidth))
    curve = rows.groupBy("unit", "i").agg(F.sum(F.col("_c") * kernel).alias("density"))
    top = F.max("density").over(Window.partitionBy("unit"))
    return curve.select(
        "unit", "i", (F.lit(lo) + F.col("i") * F.lit(step)).alias("grid"),
        F.when(top > 0, F.col("density") / top).otherwise(F.col("density")).alias("density"),
    )


def ridge_profiles(
    ratios: DataFrame, cls: str, x: str, y: str, lo: float, hi: float, points: int = 520,
    sigma: float = 12.0, height: float = 0.78,
) -> DataFrame:
    """Class shares by bin, interpolated, smoothed and scaled by the common maximum."""
    curve = smooth_grid(interp_grid(ratios, [cls], x, y, lo, hi, points), [cls], sigma=sigma)
    top = curve.agg(F.max("value").alias("_top"))
    return attach(curve, top, []).select(
        as_col(cls), "i",
        F.when(F.col("_top") > 0, F.col("value") * F.lit(height) / F.col("_top"))
        .otherwise(F.col("value")).alias("value"),
    )
