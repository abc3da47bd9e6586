"""Iron fill, closure of compositions to 100 %, fingerprints and diagram coordinates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import all_true, as_col, log10_clipped, log10_positive, ratio_pos
from ..functions.numeric import round_half_even, to_number, wrap_longitude
from .ordering import attach
from .schema import find_column, validate_features


def calculate_feot(
    df: DataFrame, allow_elemental_fe: bool = False, out: str = "FEOT(WT%)",
    source: str = "feot_source", columns: dict | None = None,
) -> DataFrame:
    """Total iron by priority, with the name of the rule that supplied it.

    Order: reported total, total ferric, ferrous plus ferric, ferrous, ferric and, if allowed,
    elemental iron.
    """
    raw = {}
    for role, (name, aliases) in (columns or K.IRON_COLUMNS).items():
        found = find_column(df, name, aliases)
        raw[role] = to_number(found) if found else F.lit(None).cast("double")
    factor = F.lit(K.FE2O3_TO_FEO)
    rules = [
        ("FeOT", raw["feot"]),
        ("Fe2O3T", raw["fe2o3t"] * factor),
        ("FeO+Fe2O3", raw["feo"] + raw["fe2o3"] * factor),
        ("FeO", raw["feo"]),
        ("Fe2O3", raw["fe2o3"] * factor),
    ]
    if allow_elemental_fe:
        rules.append(("Fe", raw["fe"]))
    named = F.coalesce(*[F.when(value.isNotNull(), F.lit(name)) for name, value in rules])
    return df.withColumns({out: F.coalesce(*[v for _, v in rules]), source: named})


def feot_source_counts(df: DataFrame, source: str = "feot_source") -> DataFrame:
    """Rows per iron rule, rows without any iron included."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def _total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _observed_total(values: Sequence[Column]) -> Column:
    """Sum over present values; NULL when none is present."""
    total = _total([F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(F.coalesce(*values).isNotNull(), total)


def closed_parts(cols: Sequence[str], mode: str) -> dict[str, Column]:
    """Expressions scaling the columns of a row to a sum of 100."""
    values = [as_col(c) for c in cols]
    if mode == "strict":
        # A NULL part makes the total NULL, and with it every part.
        total = _total(values)
        total = F.when(total > 0, total)
    elif mode == "positive":
        values = [F.when(v > 0, v) for v in values]
        total = _observed_total(values)
    elif mode == "skipna":
        total = F.nullif(_total([F.coalesce(v, F.lit(0.0)) for v in values]), F.lit(0.0))
    elif mode in ("observed", "domain"):
        total = _observed_total(values)
        total = F.nullif(total, F.lit(0.0))
    elif mode == "raise":
        total = _total(values)
    else:
        raise ValueError(f"unknown closure mode: {mode}")
    return {c: v / total * F.lit(100.0) for c, v in zip(cols, values)}


def closed_in_bounds(
    cols: Sequence[str], bounds: Mapping[str, tuple[float, float]], mode: str = "strict"
) -> Column:
    """Are the closed parts inside their inclusive bounds?  NULL when the row cannot be closed.

    The total is bound once inside a lambda: filters are pushed through projections, and a
    repeated total would repeat the text-to-number casts below it many times over.
    """
    values = [as_col(c) for c in cols]
    if mode == "strict":
        total = _total(values)
    elif mode == "positive":
        values = [F.when(v > 0, v) for v in values]
        total = _total([F.coalesce(v, F.lit(0.0)) for v in values])
    else:
        raise ValueError(f"unknown closure mode: {mode}")
    by_name = dict(zip(cols, values))
    bound = F.struct(total.alias("t"), *[by_name[c].alias(f"v{i}") for i, c in enumerate(bounds)])

    def inside(s: Column) -> Column:
        part = lambda i: s[f"v{i}"] / s["t"] * F.lit(100.0)
        tests = [part(i).between(lo, hi) for i, (lo, hi) in enumerate(bounds.values())]
        return F.when(s["t"] > 0, all_true(tests)) if tests else F.when(s["t"] > 0, F.lit(True))

    return F.get(F.transform(F.array(bound), inside), 0)


def anhydrous(
    df: DataFrame,
    cols: Sequence[str] = K.LONG_MAJORS,
    mode: str = "strict",
    valid: str = "valid",
    must_have_total: bool = False,
) -> DataFrame:
    """Close the major oxides of every row to 100.

    * ``strict``: all present and sum above 0, else every part NULL and ``valid`` false.
    * ``raise``: any missing, non-finite part or a sum not above 0 is an error.
    * ``positive``: only positive parts count, others become NULL; ``must_have_total`` makes a
      row without any positive part an error.
    * ``skipna``: NULLs are skipped; a zero sum gives NULL parts.
    * ``observed``: like skipna, but a row without any part stays NULL.
    * ``domain``: like observed, a sum not above 0 is an error.
    """
    if mode == "raise":
        validate_features(df, cols)
    if mode in ("raise", "domain") or must_have_total:
        if mode == "positive":
            present = [F.when(as_col(c) > 0, as_col(c)) for c in cols]
        else:
            present = [as_col(c) for c in cols]
        total = F.coalesce(_observed_total(present), F.lit(0.0))
        bad = df.agg(F.count_if(total <= 0)).first()[0]
        if bad:
            raise ValueError(f"{bad} rows have no major-oxide total above 0")
    closed = closed_parts(cols, mode)
    if mode == "strict":
        flag = F.coalesce(all_true([as_col(c).isNotNull() for c in cols])
                          & (_total([as_col(c) for c in cols]) > 0), F.lit(False))
        return df.withColumns({**closed, valid: flag})
    return df.withColumns(closed)


def normalization_stats(df: DataFrame, cols: Sequence[str], closed: DataFrame | None = None) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of the row totals, before and after."""
    before = _total([as_col(c) for c in cols])
    after = _total(list(closed_parts(cols, "raise").values()))
    stage = df.select(
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("stage"), before.alias("total")),
                F.struct(F.lit("after").alias("stage"), after.alias("total")),
            )
        ).alias("s")
    ).select("s.*")
    return stage.groupBy("stage").agg(
        F.avg("total").alias("mean"),
        F.stddev_samp("total").alias("std"),
        F.min("total").alias("min"),
        F.max("total").alias("max"),
    )


def round_numbers(df: DataFrame, digits: int = 3) -> DataFrame:
    """All floating-point columns rounded half to even."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: round_half_even(c, digits) for c in doubles})


def fingerprint(cols: Sequence[str], short: bool = False) -> Column:
    """Text key of a composition: values to three decimals, missing marked, joined by a bar."""
    parts = [
        F.coalesce(round_half_even(to_number(c), 3), F.lit(K.FINGERPRINT_NULL)).cast("string")
        for c in cols
    ]
    text = F.concat_ws("|", *parts)
    return F.sha2(text, 256) if short else text


def log_standardize(
    ref: DataFrame, app: DataFrame, cols: Sequence[str], mode: str = "clip"
) -> tuple[DataFrame, DataFrame]:
    """log10 values of both tables in units of the reference mean and population deviation.

    ``clip`` lifts values to 1e-12 first; ``mask`` treats non-positive values as missing and
    puts missing cells at 0, the reference mean.  A zero deviation counts as 1.
    """
    log = log10_clipped if mode == "clip" else log10_positive
    stats = ref.agg(
        *[F.avg(log(c)).alias("_m_" + c) for c in cols],
        *[F.stddev_pop(log(c)).alias("_s_" + c) for c in cols],
    )

    def scaled(df: DataFrame) -> DataFrame:
        out = {}
        for c in cols:
            spread = as_col("_s_" + c)
            spread = F.when(spread > 0, spread).otherwise(F.lit(1.0))
            z = (log(c) - as_col("_m_" + c)) / spread
            out[c] = F.coalesce(z, F.lit(0.0)) if mode == "mask" else z
        wide = attach(df, stats, [])
        return wide.withColumns(out).select(*[as_col(c) for c in df.columns])

    return scaled(ref), scaled(app)


def diagram_coords(df: DataFrame, kind: str, keep: Sequence[str] = (), **names: str) -> DataFrame:
    """Coordinates of a discrimination diagram with its validity filter.

    Kinds: ``ti_v`` (titanium in ppm/1000 against vanadium), ``nbyb_thyb`` and ``zr_zry``.
    """
    col = lambda n: as_col(names.get(n, n))
    if kind == "ti_v":
        x, y = col("TIO2") * F.lit(5994.0) / F.lit(1000.0), col("V")
        ok = x.isNotNull() & y.isNotNull()
    elif kind == "nbyb_thyb":
        x, y = ratio_pos(col("NB"), col("YB")), ratio_pos(col("TH"), col("YB"))
        ok = x.isNotNull() & y.isNotNull()
    elif kind == "zr_zry":
        x, y = col("ZR"), ratio_pos(col("ZR"), col("Y"))
        ok = y.isNotNull()
    else:
        raise ValueError(f"unknown diagram: {kind}")
    return df.where(ok).select(*[as_col(c) for c in keep], x.alias("x"), y.alias("y"))


def valid_geo(df: DataFrame, lat: str, lon: str, needed: Sequence[str] = ()) -> DataFrame:
    """Rows with coordinates on the globe, longitude folded into [-180, 180)."""
    folded = wrap_longitude(to_number(lon))
    ok = to_number(lat).between(-90.0, 90.0) & folded.between(-180.0, 180.0)
    for c in needed:
        ok = ok & as_col(c).isNotNull()
    return df.withColumn("_lon", folded).where(ok).drop(lon).withColumnRenamed("_lon", lon)


def tag_component(
    df: DataFrame, sio2: str, source: str, low_tag: str, high_tag: str, limit: float = 53.0
) -> DataFrame:
    """Constant source name and a component tag from the silica content."""
    tag = F.when(as_col(sio2) <= limit, F.lit(low_tag)).otherwise(F.lit(high_tag))
    return df.withColumns({"SOURCE_DATASET": F.lit(source), "POOL_COMPONENT": tag})
