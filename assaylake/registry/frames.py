"""Stand-in views over the given tables, as Spark frames and as SQL.

Both sides compute the same columns with the same arithmetic, so results can be compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernel import MarginModel

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SEED = 42
SPAN = 2147483647
OTHER_SPAN = 2147483629
CLASSES = ["click", "error", "purchase", "signup", "view"]
ARC = ["click", "view"]


def register(name: str, sql: str | None = None, doubles: str = "", views: str = "", digits: int = 6):
    """Add a query and, if given, its SQL twin.

    ``doubles`` names the floating-point result columns; both sides round them to the same
    number of decimals.
    """
    def add(fn):
        names = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in names}) if names else df

        QUERIES[name] = run
        if sql is not None:
            text = sql
            if names:
                swaps = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in names)
                text = f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS result_rows"
            if views:
                text = "WITH " + ",\n".join(VIEWS[v] for v in views.split()) + "\n" + text
            ORACLE[name] = text
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- samples: one row per order line ----------------------------------------------------------

_S_COLUMNS = {
    "sample_id": "l_orderkey*10000000000 + l_partkey*100000 + l_suppkey*10 + l_linenumber",
    "label": "l_returnflag",
    "source": "l_linestatus",
    "m1": "l_quantity",
    "m2": "l_extendedprice/1000",
    "m3": "nullif(l_discount,0)*100",
    "m4": "nullif(l_tax,0)*100",
    "l_orderkey": "l_orderkey",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _S_COLUMNS.items()])


# --- scored events: value as a score, hours as an age, type as a class ------------------------

_EVENT_COLUMNS = {
    "sample_id": "event_id",
    "pred_class_name": "event_type",
    "user_id": "user_id",
    "Arc_probability3": "least(value/100.0, 1.0)",
    "pred_prob_max": "0.3 + 0.007*((event_id*37) % 101)",
    "pred_prob_std": "0.001*((event_id*59) % 83)",
    "is_arc_related_9class": "event_type IN ('click','view')",
    "is_high_confidence": "(event_id*37) % 101 >= 57",
    "liu_arc_binary": "CASE WHEN event_id % 7 <> 0 THEN (event_id*53) % 97 >= 48 END",
    "Craton": "CASE WHEN user_id % 13 <> 0 THEN concat('unit ', CAST(user_id % 10 AS VARCHAR(9))) END",
    "BA": "value",
    "TH": "CAST((event_id*11) % 29 AS DOUBLE)",
    "NB": "CAST((event_id*13) % 17 AS DOUBLE)",
    "LA": "1.0*((event_id*7) % 23)",
    "POOL_COMPONENT": "concat('part ', CAST(event_id % 3 AS VARCHAR(9)))",
    "knn_distance": "0.01*((event_id*71) % 397)",
    "knn_outside_99": "(event_id*71) % 397 > 390",
    "mahalanobis_outside_99": "(event_id*73) % 389 > 380",
    "missing_feature_count": "CAST((event_id*19) % 20 AS INT)",
    "boundary_feature_count": "CAST((event_id*23) % 11 AS INT)",
    "variant_class": "CASE WHEN event_id % 5 = 0 THEN 'error' ELSE event_type END",
}
_AGE = "2500.0 + 2.0*{hours}"
_SPARK_HOURS = "timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
_SQL_HOURS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 3600000000"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the columns of a scored table; every 41st age is unknown."""
    events = table(spark, sf_dir, "events")
    if dict(events.dtypes)["ts"] == "timestamp":
        events = events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    plain = {c: e.replace("VARCHAR(9)", "STRING") for c, e in _EVENT_COLUMNS.items()}
    age = _AGE.format(hours=_SPARK_HOURS)
    return events.selectExpr(
        *[f"CAST({e} AS DOUBLE) AS {c}" if c in _EVENT_DOUBLES else f"{e} AS {c}"
          for c, e in plain.items()],
        f"CAST(CASE WHEN event_id % 41 <> 0 THEN {age} END AS DOUBLE) AS C_AGE",
    )


_EVENT_DOUBLES = {"Arc_probability3", "pred_prob_max", "pred_prob_std", "LA", "knn_distance"}


# --- class probabilities: softmax of the first ten embedding numbers --------------------------


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, ten class probabilities and the embedding as doubles."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    scores = F.transform(F.slice(vec, 1, 10), lambda x: F.exp(x))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform(scores, lambda x: x / total).alias("probs"), vec.alias("vec")
    )


def shap_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution table: dimensions 11..54 as 11 features for each of 4 classes."""
    base = probabilities(spark, sf_dir)
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("class"), F.lit(f"f{f:02d}").alias("feature"),
            F.get("vec", 10 + f).alias("value"), F.get("vec", 10 + 11 * c + f).alias("shap"),
        )
        for c in range(4) for f in range(11)
    ]))
    return base.select("vec_id", "label", cells.alias("c")).select(
        F.col("c.class"), F.col("vec_id").alias("sample_id"), (F.col("label") % 4).alias("true_class"),
        "c.feature", "c.value", "c.shap",
    )


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def _event_sql() -> str:
    parts = {c: (f"CAST({e} AS DOUBLE)" if c in _EVENT_DOUBLES else e).replace("INT)", "INTEGER)")
             for c, e in _EVENT_COLUMNS.items()}
    age = _AGE.format(hours=f"({_SQL_HOURS})")
    parts["C_AGE"] = f"CAST(CASE WHEN event_id % 41 <> 0 THEN {age} END AS DOUBLE)"
    return f"SELECT {_select(parts)} FROM events"


VIEWS = {
    "S": f"S AS (SELECT {_select(_S_COLUMNS)} FROM lineitem)",
    "E": f"E AS ({_event_sql()})",
    "B": (
        "B AS (SELECT *, floor(C_AGE/200.0)*200.0 AS lo, floor(C_AGE/200.0)*200.0 + 100.0 AS mid, "
        "floor(C_AGE/200.0)*200.0 + 200.0 AS hi FROM E WHERE C_AGE IS NOT NULL)"
    ),
    "P": (
        "V AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec "
        "FROM embeddings), "
        "X AS (SELECT vec_id, label, vec, list_transform(vec[1:10], lambda x: exp(x)) AS ex FROM V), "
        "P AS (SELECT vec_id, label, vec, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM X), "
        "Q AS (SELECT vec_id, label, probs, list_max(probs) AS conf, "
        "CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred FROM P)"
    ),
    "H": (
        "H AS (SELECT CAST(c AS INTEGER) AS class, vec_id AS sample_id, label % 4 AS true_class, "
        "format('f{:02d}', f) AS feature, vec[11 + f] AS value, vec[11 + 11*c + f] AS shap "
        "FROM P, range(4) AS tc(c), range(11) AS tf(f))"
    ),
}


def hash_sql(seed: int, key: str = "sample_id") -> str:
    """The sampling hash as SQL."""
    return f"CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


def draw_sql(key: str, draw: str, seed: int) -> str:
    """The draw hash as SQL, for keys and draw numbers of 0 or more."""
    x = f"((({key} % {SPAN}) * 7919 + {draw} * 15485863 + {seed}) % {SPAN})"
    v = f"((({key} % {OTHER_SPAN}) * 104729 + {draw} * 32452843 + {3 * seed}) % {OTHER_SPAN})"
    y = f"(({x} * {x} + {v} + {draw} * 48271 + 12345) % {SPAN})"
    return f"(({y} * {y} + ({v} * {v} + {y}) % {OTHER_SPAN}) % {SPAN})"


# --- a classifier of plain arithmetic, so that SQL can state its scores ------------------------


@dataclass(frozen=True)
class SquareShares(MarginModel):
    """Share of a class: the square of 1 + the features weighted by (3i + 5c + 7 turn) mod 11, over the sum of all classes."""

    labels: tuple[float, ...]
    width: int
    turn: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        i, c = np.arange(self.width)[:, None], np.arange(len(self.labels))
        return 1 + x @ ((3 * i + 5 * c + 7 * self.turn) % 11)

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return margins**2 / (margins**2).sum(axis=1, keepdims=True)


def shares_sql(features: list[str], classes: int, turns: tuple[int, ...]) -> str:
    """Columns p{class}_{turn}, their mean p{class} and deviation s{class}, to stand in nested selects over the given source."""
    squares = ", ".join(
        "power(1 + " + " + ".join(f"{(3 * i + 5 * c + 7 * t) % 11}*({f})" for i, f in enumerate(features)) + f", 2) AS q{c}_{t}"
        for c in range(classes) for t in turns)
    shares = ", ".join(f"q{c}_{t}/(" + " + ".join(f"q{k}_{t}" for k in range(classes)) + f") AS p{c}_{t}" for c in range(classes) for t in turns)
    mean = ", ".join("(" + " + ".join(f"p{c}_{t}" for t in turns) + f")/{len(turns)} AS p{c}" for c in range(classes))
    spread = ", ".join("sqrt((" + " + ".join(f"power(p{c}_{t} - p{c}, 2)" for t in turns) + f")/{len(turns)}) AS s{c}" for c in range(classes))
    return f"SELECT *, {spread} FROM (SELECT *, {mean} FROM (SELECT *, {shares} FROM (SELECT *, {squares} FROM {{source}}) q1) q2) q3"
