"""Mixing of sources to target weights by temperature; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_rank, stage, table, word_count


@dataclass(frozen=True)
class MixParams:
    """How far source shares are flattened and how the result is drawn.

    entropy: wanted entropy of the weights as a share of the largest possible one (log of the number
    of sources); max_repeats: largest number of passes over a source, which comes first; budget:
    tokens to draw, all tokens of the input if None; block_tokens: aimed size of a block.
    """

    entropy: float = 0.97
    max_repeats: float = 4.0
    budget: int | None = None
    block_tokens: int = 65536
    seed: str = "mix"


_STEPS = 50


def _draw(*parts: Column) -> Column:
    """Engine-neutral order key: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_weights(totals: DataFrame, p: MixParams) -> DataFrame:
    """(source, tokens, weight, quota, exponent): one row per source.

    Weights are shares to the power of an exponent in [0, 1], normalised: 1 keeps the natural mix,
    0 makes sources equal.  The exponent is the largest that reaches the wanted entropy, raised, if
    need be, to the smallest one at which no source is passed over more than ``max_repeats`` times.
    Both are found by bisection inside one expression over the array of source totals, which has a
    row per source, whatever the number of documents.  The exponent is rounded to six places.
    """
    one = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("top"), F.min("tokens").alias("low"),
                     F.array_sort(F.collect_list("tokens")).alias("ts"))
    plain = F.lit(p.budget).cast("double") if p.budget is not None else F.col("all").cast("double")

    def total(x: Column) -> Column:
        return F.aggregate("ts", F.lit(0.0), lambda s, t: s + F.pow(t / F.col("top"), x))

    def entropy(x: Column) -> Column:
        z = F.aggregate("ts", F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("e")), lambda s, t: F.struct(
            (s["z"] + F.pow(t / F.col("top"), x)).alias("z"),
            (s["e"] + F.pow(t / F.col("top"), x) * x * F.log(t / F.col("top"))).alias("e")))
        return F.transform(F.array(z), lambda s: F.log(s["z"]) - s["e"] / s["z"])[0]

    def bisect(good) -> Column:
        """Largest exponent where ``good`` fails to the right of it; good holds at 0 or nowhere."""
        def halve(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            return F.transform(F.array(good(mid)), lambda g: F.struct(
                F.when(g, mid).otherwise(s["lo"]).alias("lo"), F.when(g, s["hi"]).otherwise(mid).alias("hi")))[0]

        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, halve, lambda s: s["lo"])

    wanted = F.lit(p.entropy) * F.log(F.size("ts").cast("double"))
    flat = F.when(entropy(F.lit(1.0)) >= wanted, 1.0).otherwise(bisect(lambda x: entropy(x) >= wanted))

    def too_often(x: Column) -> Column:
        """The smallest source is passed over more often than allowed."""
        return F.pow(F.col("low") / F.col("top"), x) / total(x) * plain > p.max_repeats * F.col("low")

    within = F.when(too_often(F.lit(1.0)), 1.0).when(~too_often(F.lit(0.0)), 0.0).otherwise(bisect(too_often))
    one = one.select("top", "ts", plain.alias("plain"), F.round(F.greatest(flat, within), 6).alias("exponent")) \
        .select("top", "plain", "exponent", total(F.col("exponent")).alias("z"))
    return totals.crossJoin(F.broadcast(one)).select(  # one row of scalars
        "source", "tokens", (F.pow(F.col("tokens") / F.col("top"), F.col("exponent")) / F.col("z")).alias("weight"), "plain", "exponent") \
        .select("source", "tokens", "weight", F.floor(F.col("plain") * F.col("weight") + 1e-6).cast("long").alias("quota"), "exponent")


def mix_sources(docs: DataFrame, params: MixParams | None = None, key: str = "doc_id", source: str = "source",
                text: str = "text", tokens: str | None = None) -> DataFrame:
    """(key, source, n_tokens, epoch, block_rank): the drawn documents, one row per draw.

    Documents fall into blocks by a hash of their key; every epoch of a source permutes its blocks
    anew.  Whole epochs take every block, the last one takes blocks in order while they fit the rest
    of the source's quota and, of the block that does not, documents in hash order while they fit:
    a source never exceeds its quota.  Tokens are words unless ``tokens`` names a column.

    Documents without tokens (null or empty text) take no part; a null source is a source of its
    own; null keys are drawn like others.  Rows that repeat are drawn as often.  Other columns are
    ignored.  Empty input or a quota of zero gives no row.
    """
    p = params or MixParams()
    size = word_count(text) if tokens is None else F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("n_tokens"))
    rows = stage(rows.where("n_tokens > 0").withColumn("draw", _draw(F.lit(p.seed), F.col("key"))), "mix-rows")
    totals = stage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    weights = source_weights(totals, p).select(F.col("source").alias("of"), F.col("tokens").alias("source_tokens"), "quota")
    weights = stage(weights, "mix-weights")
    n_blocks = F.ceil(F.col("source_tokens") / p.block_tokens).cast("long")
    blocked = rows.join(F.broadcast(weights), F.col("source").eqNullSafe(F.col("of"))) \
        .withColumn("block", F.pmod(_number(F.col("draw")), n_blocks)).drop("of")  # weights: a row per source
    blocks = blocked.groupBy("source", "block", "source_tokens", "quota").agg(F.sum("n_tokens").alias("block_tokens"))
    full = F.floor(F.col("quota") / F.col("source_tokens"))
    epochs = F.ceil(F.col("quota") / F.col("source_tokens")).cast("int")
    turns = blocks.withColumn("full", full).where("quota > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs))) \
        .withColumn("turn", _draw(F.lit(p.seed), F.col("source"), F.col("epoch"), F.col("block")))
    shard = F.substring("turn", 1, 3)
    turns = spread_rank(turns, ["source", "epoch"], ["turn"], shard, F.col("block_tokens")).withColumnRenamed("before", "ahead")
    turns = spread_rank(turns, ["source", "epoch"], ["turn"], shard).withColumn("block_rank", F.col("before") + 1)
    rest = F.when(F.col("epoch") <= F.col("full"), F.col("source_tokens")).otherwise(F.col("quota") - F.col("full") * F.col("source_tokens"))
    turns = turns.withColumn("room", rest - F.col("ahead")).where("room > 0").select(
        F.col("source").alias("of"), F.col("block").alias("of_block"), "epoch", "block_rank", "room", "block_tokens")
    turns = stage(turns, "mix-turns")
    on = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))
    out = ["key", "source", "n_tokens", "epoch", "block_rank"]
    whole = blocked.join(turns.where("block_tokens <= room"), on).select(*out)
    cut = blocked.join(turns.where("block_tokens > room"), on)  # one block per source at most
    cut = spread_rank(cut, ["source"], ["draw", "key"], F.substring("draw", 1, 3), F.col("n_tokens")) \
        .where("before + n_tokens <= room").select(*out)
    return whole.unionByName(cut)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the mix of all documents' sources at the default target, as many words as there are."""
    return mix_sources(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as it is drawn (not at all, once or up to the repeat limit)."""
    drawn = mix_sources(docs).groupBy("key", "source", "n_tokens").agg(F.countDistinct("epoch").cast("int").alias("times"))
    row = F.col("row")  # under one name, so that no column can clash
    on = row["doc_id"].eqNullSafe(F.col("key")) & row["source"].eqNullSafe(F.col("source")) & (word_count(row["text"]) == F.col("n_tokens"))
    return docs.select(F.struct("*").alias("row")).join(drawn, on) \
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_tokens, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS draw
  FROM documents),
r AS (SELECT * FROM d WHERE n_tokens > 0),
t AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY 1),
c AS (SELECT sum(tokens) AS plain, max(tokens) AS top, min(tokens) AS low, 0.97 * ln(count(*)) AS wanted FROM t),
e1 AS (SELECT ln(sum(tokens / top)) - sum(tokens / top * ln(tokens / top)) / sum(tokens / top) AS e FROM t, c),
b AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, ln(sum(w)) - sum(w * x) / sum(w) >= any_value(wanted) AS good FROM (
      SELECT i, lo, hi, wanted, pow(tokens / top, (lo + hi) / 2) AS w, (lo + hi) / 2 * ln(tokens / top) AS x FROM b, t, c WHERE i < 50)
    GROUP BY i, lo, hi)),
o AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN often THEN mid ELSE lo END, CASE WHEN often THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, min(w) / sum(w) * any_value(plain) > 4.0 * any_value(low) AS often FROM (
      SELECT i, lo, hi, plain, low, pow(tokens / top, (lo + hi) / 2) AS w FROM o, t, c WHERE i < 50)
    GROUP BY i, lo, hi)),
x AS (SELECT round(greatest(
    CASE WHEN (SELECT e FROM e1) >= wanted THEN 1.0 ELSE (SELECT lo FROM b WHERE i = 50) END,
    CASE WHEN low / (SELECT sum(tokens) FROM t) * plain > 4.0 * low THEN 1.0
         WHEN NOT 1.0 / (SELECT count(*) FROM t) * plain > 4.0 * low THEN 0.0
         ELSE (SELECT lo FROM o WHERE i = 50) END), 6) AS a FROM c),
w AS (SELECT source, tokens::BIGINT AS tokens, floor(plain * pow(tokens / top, a) / (SELECT sum(pow(tokens / top, a)) FROM t, c, x) + 1e-6)::BIGINT AS quota FROM t, c, x),
k AS (SELECT r.*, w.tokens, w.quota, ('0x' || substr(draw, 1, 15))::BIGINT % ceil(w.tokens / 65536)::BIGINT AS block
      FROM r JOIN w ON r.source IS NOT DISTINCT FROM w.source),
g AS (SELECT source, block, tokens, quota, sum(n_tokens)::BIGINT AS block_tokens FROM k GROUP BY ALL),
s AS (SELECT g.*, e.epoch FROM g, range(1, 100) e(epoch) WHERE e.epoch <= ceil(quota / tokens)),
f AS (SELECT *, md5('mix|' || coalesce(source, '~') || '|' || CAST(epoch AS VARCHAR) || '|' || CAST(block AS VARCHAR)) AS turn FROM s),
u AS (SELECT *, row_number() OVER z AS block_rank,
        CASE WHEN epoch <= quota // tokens THEN tokens ELSE quota % tokens END - (sum(block_tokens) OVER z - block_tokens) AS room
      FROM f WINDOW z AS (PARTITION BY source, epoch ORDER BY turn ROWS UNBOUNDED PRECEDING)),
m AS (SELECT k.doc_id, k.source, k.n_tokens, u.epoch, u.block_rank, u.room, u.block_tokens,
        sum(k.n_tokens) OVER (PARTITION BY k.source, u.epoch, u.block ORDER BY k.draw, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source AND k.block = u.block WHERE u.room > 0)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block_rank AS BIGINT) AS block_rank
FROM m WHERE block_tokens <= room OR upto <= room
"""
