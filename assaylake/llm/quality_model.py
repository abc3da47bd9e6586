"""Quality classifier: perplexity under a model of trusted text, by sharded count joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import small_side, stage, table
from .ngrams import count_ngrams, kneser_ney, mask, text_codes


@dataclass(frozen=True)
class ClassifierParams:
    """order: bytes of the longest n-gram; quantile: share of a language's trusted documents that its
    threshold lets pass; min_trusted: languages with fewer trusted documents use all of them;
    block_bytes: text per block of documents."""

    order: int = 4
    quantile: float = 0.99
    min_trusted: int = 20
    block_bytes: int = 8 << 20


def blocks_of(docs: DataFrame, p: ClassifierParams) -> DataFrame:
    """(block, keys, sizes, body, grams): documents in blocks, texts compressed, with their distinct n-grams.

    ``docs`` has columns key and text.  Blocks follow the input's partitions, so the same input
    partitions give the same blocks.
    """
    kind = docs.schema["key"].dataType
    schema = StructType([StructField("block", LongType()), StructField("keys", ArrayType(kind)), StructField("sizes", ArrayType(LongType()))]) \
        .add("body", "binary").add("grams", ArrayType(LongType()))
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, keys, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block(key_type: pa.DataType) -> pa.RecordBatch:
            grams = [np.unique(pd.factorize(c)[1]) for _, c in text_codes(((0, t) for t in texts if t), p.order)]
            grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + made], pa.int64()), pa.array([keys], pa.list_(key_type)),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([body], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pa.array(grams, pa.int64()))], schema.names)

        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                data = (text.as_py() or "").encode()
                keys.append(key.as_py()), texts.append(data)
                size += len(data) + 16
                if size >= p.block_bytes:
                    yield block(b.schema.field(0).type)
                    made, keys, texts, size = made + 1, [], [], 0
            last = b.schema.field(0).type
        if keys:
            yield block(last)

    return docs.select("key", "text").mapInArrow(each, schema)


def gram_scores(grams: DataFrame, entries: DataFrame, contexts: DataFrame, floor: float, order: int) -> DataFrame:
    """(g, lp) for distinct n-grams ``g``: from the highest order down, a join with the order's estimates
    and, where these have none, one with the weight the context leaves to the next lower order."""
    rows = grams.select("g", F.lit(None).cast("double").alias("lp"), F.lit(0.0).alias("carried"))
    for n in range(order, 0, -1):
        own = entries.where(F.col("n") == n).select(F.col("g").alias("of"), F.col("lp").alias("found"))
        rows = rows.join(own, F.col("g").bitwiseAND(mask(n)) == F.col("of"), "left") \
            .select("g", F.coalesce("lp", F.col("carried") + F.col("found")).alias("lp"), "carried")
        if n > 1:
            left = contexts.where(F.col("n") == n).select(F.col("g").alias("of"), F.col("lg").alias("left"))
            rows = rows.join(left, F.shiftright(F.col("g").bitwiseAND(mask(n)), 8) == F.col("of"), "left") \
                .select("g", "lp", (F.col("carried") + F.coalesce("left", F.lit(0.0))).alias("carried"))
    return rows.select("g", F.coalesce("lp", F.col("carried") + floor).alias("lp"))


def document_scores(docs: DataFrame, entries: DataFrame, contexts: DataFrame, floor: float, p: ClassifierParams) -> DataFrame:
    """(key, nll, n_bytes): negative log likelihood of every document, a row per input row.

    The blocks' distinct n-grams are joined with the estimates, spread by n-gram; the answers return
    to their blocks, where every document's bytes are summed.
    """
    blocks = blocks_of(docs, p).repartition("block")
    wanted = blocks.select("block", F.explode("grams").alias("g"))
    found = gram_scores(wanted.select("g").distinct(), entries, contexts, floor, p.order)
    answers = wanted.join(found, "g").groupBy(F.col("block").alias("of")) \
        .agg(F.sort_array(F.collect_list(F.struct("g", F.col("lp").cast("float").alias("lp")))).alias("a"))
    met = blocks.join(answers, F.col("block") == F.col("of"), "left").select("keys", "sizes", "body", F.col("a.g").alias("g"), F.col("a.lp").alias("lp"))
    kind = docs.schema["key"].dataType
    schema = StructType([StructField("key", kind)]).add("nll", "double").add("n_bytes", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, sizes = b.column(0)[i].values, np.asarray(b.column(1)[i].values, np.int64)
                body, at = zstandard.ZstdDecompressor().decompress(b.column(2)[i].as_py()), np.concatenate([[0], np.cumsum(sizes)])
                known = np.asarray(b.column(3)[i].values, np.int64) if b.column(3)[i].is_valid else np.zeros(0, np.int64)
                value = np.asarray(b.column(4)[i].values, np.float64) if len(known) else np.zeros(0)
                nll = np.zeros(len(sizes))
                for of, grams in text_codes(((k, body[at[k]:at[k + 1]]) for k in range(len(sizes)) if sizes[k]), p.order):
                    local, distinct = pd.factorize(grams)
                    where = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                    if not (known[where] == distinct).all():
                        raise RuntimeError("a block was rebuilt from other rows than its n-grams; stage the input first")
                    nll -= np.bincount(of, value[where][local], len(sizes))
                yield pa.RecordBatch.from_arrays([keys, pa.array(nll), pa.array(np.where(sizes > 0, sizes + 1, 0))], schema.names)

    return met.mapInArrow(each, schema)


def trusted_keys(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose every label says good quality and not toxic."""
    return labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")) \
        .where("q = 1 AND coalesce(t, 0) = 0").select(F.col(key).alias("trusted_key"))


def classify_quality(docs: DataFrame, labels: DataFrame, params: ClassifierParams | None = None, text: str = "text",
                     key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key, lang, trusted, perplexity, threshold, kept), a row per input row.

    The model is counted over the whole texts of all trusted documents.  A language's threshold is
    the ``quantile`` of its trusted documents' perplexity per byte (by a mergeable sketch of relative
    rank error 1e-4); languages with few trusted documents, and null, use the one over all.  A
    document is kept if its perplexity is at most the threshold.  Null and empty texts have a null
    perplexity and are not kept; without trusted text nothing is.  Repeated rows repeat; null keys
    are never trusted; other columns are ignored.
    """
    p = params or ClassifierParams()
    good = stage(trusted_keys(labels, key), "trusted")
    rows = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    near = small_side(good)
    training = rows.join(near, F.col("id") == F.col("trusted_key"), "left_semi")
    entries, contexts, floor = kneser_ney(count_ngrams(training, p.order), p.order)
    keyed = rows.select(F.struct("id", "lang").alias("key"), "text")
    scores = document_scores(keyed, entries, contexts, floor, p).select("key.id", "key.lang", F.when(
        F.col("n_bytes") > 0, F.exp(F.col("nll") / F.col("n_bytes"))).alias("perplexity"))
    scores = stage(scores, "perplexity")
    marked = scores.join(near, F.col("id") == F.col("trusted_key"), "left")
    trusted = F.col("trusted_key").isNotNull()
    limits = marked.where(trusted).groupBy("lang").agg(F.count("perplexity").alias("n"), F.percentile_approx(
        "perplexity", p.quantile, 10000).alias("limit"))
    over_all = marked.where(trusted).agg(F.percentile_approx("perplexity", p.quantile, 10000)).first()[0]
    limits = limits.where((F.col("n") >= p.min_trusted) & F.col("lang").isNotNull()).select(F.col("lang").alias("of"), "limit")
    threshold = F.coalesce("limit", F.lit(over_all).cast("double"))
    return marked.join(F.broadcast(limits), F.col("lang") == F.col("of"), "left").select(  # a row per language
        F.col("id").alias("key"), "lang", trusted.alias("trusted"), "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: perplexity under trusted text, threshold and verdict of every document."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("key", "doc_id")
