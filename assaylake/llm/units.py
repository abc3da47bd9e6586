"""Substring dedup by hashing lines and the sentences inside them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

_PARTS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"\S(?:.|\n(?!\s*\n))*")}
_SENTENCE = re.compile(r"[^.!?]+(?:[.!?]+|$)")


@dataclass(frozen=True)
class UnitParams:
    """unit: ``line`` or ``paragraph``; min_words: shorter units are left alone; sentence_words:
    sentences of at least so many words are units too, None for none."""

    unit: str = "line"
    min_words: int = 5
    sentence_words: int | None = 8


def units_in(text: str, p: UnitParams) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(level, start, end, words, digest) of a text's units; level 0 holds units, level 1 sentences.

    Normalising lower-cases and joins words by one space; offsets are those of the original text,
    without the white space around a unit.
    """
    for outer in _PARTS[p.unit].finditer(text):
        raw = outer.group()
        words = raw.lower().split()
        if len(words) < p.min_words:
            continue
        lead = len(raw) - len(raw.lstrip())
        start = outer.start() + lead
        yield 0, start, start + len(raw.strip()), len(words), xxhash.xxh3_128_digest(" ".join(words))
        if p.sentence_words is None:
            continue
        for inner in _SENTENCE.finditer(raw):
            piece = inner.group()
            own = piece.lower().split()
            if len(own) >= p.sentence_words:
                at = outer.start() + inner.start() + len(piece) - len(piece.lstrip())
                yield 1, at, at + len(piece.strip()), len(own), xxhash.xxh3_128_digest(" ".join(own))


def unit_table(docs: DataFrame, p: UnitParams, text: str, key: str) -> DataFrame:
    """(key, level, start, end, words, h1, h2), a row per unit."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "level", "start", "end", "words", "h1", "h2"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, made = [], []

            def flush() -> pa.RecordBatch:
                digest = np.frombuffer(b"".join(m[4] for m in made), ">i8").astype(np.int64).reshape(-1, 2)
                cols = [pa.array([m[k] for m in made], pa.int32()) for k in range(4)]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *cols, pa.array(digest[:, 0]), pa.array(digest[:, 1])], names)

            for i, t in enumerate(b.column(1)):
                for u in units_in(t.as_py() or "", p):
                    row.append(i), made.append(u)
                if len(row) > 100_000:
                    yield flush()
                    row, made = [], []
            if row:
                yield flush()

    return docs.select(key, text).mapInArrow(each, f"key {kind}, level int, start int, end int, words int, h1 long, h2 long")


def repeated_spans(docs: DataFrame, params: UnitParams | None = None, text: str = "text", key: str = "doc_id",
                   rank: Column | None = None) -> DataFrame:
    """(key, start, end, unit, words, first_key, first_start): every span that repeats an earlier one.

    Equal digests are one group over all documents.  Its earliest occurrence by (rank, key, start)
    stays; ``rank`` is an expression over the key (default: none), nulls last.  A removed sentence
    inside a removed line is not listed again.  The earliest occurrence of a sentence never lies in
    a removed line, since that line's earliest copy holds it too.

    A first pass counts 64-bit digests, so only units that repeat are grouped by the full 128 bits.
    Null, empty and short texts have no units; very long texts are read whole.  Rows that repeat a
    key are one document and get the same spans each; null keys rank last and are one document.
    Other columns are ignored; an empty table gives no row.
    """
    p = params or UnitParams()
    units = stage(unit_table(docs, p, text, key), "units")
    many = stage(units.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "repeated")
    again = units.join(many, "h1", "left_semi")
    order = F.coalesce(rank, F.lit(None).cast("double")) if rank is not None else F.lit(0)
    again = stage(again.select("*", F.struct(order.isNull().alias("r0"), order.alias("r"), F.col("key").isNull().alias("k0"),
                                             F.col("key").alias("k"), F.col("start").alias("s")).alias("at")), "again")
    first = again.groupBy("level", "h1", "h2").agg(F.min("at").alias("first"))
    first = first.select(F.col("level").alias("l_"), F.col("h1").alias("a_"), F.col("h2").alias("b_"), "first")
    gone = again.join(first, (F.col("level") == F.col("l_")) & (F.col("h1") == F.col("a_")) & (F.col("h2") == F.col("b_"))) \
        .where(~F.col("at").eqNullSafe(F.col("first")))
    gone = stage(gone.select("key", "level", "start", "end", "words", F.col("first.k").alias("first_key"), F.col("first.s").alias("first_start")), "gone")
    # a document's removed lines as one array: bounded by the document
    lines = gone.where("level = 0").groupBy(F.col("key").alias("of")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("lines"))
    free = gone.where("level = 1").join(lines, F.col("key").eqNullSafe(F.col("of")), "left").where(
        ~F.coalesce(F.exists("lines", lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"])), F.lit(False)))
    out = ["key", "start", "end", "unit", "words", "first_key", "first_start"]
    return gone.where("level = 0").withColumn("unit", F.lit(p.unit)).select(*out) \
        .unionByName(free.withColumn("unit", F.lit("sentence")).select(*out))


def remove_spans(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with their spans cut out and ``removed``, the spans' original offsets, added."""
    cuts = spans.groupBy(F.col("key").alias("of")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))

    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        def one(t, spans_):
            if t is None or spans_ is None:
                return t
            kept, at = [], 0
            for s in spans_:
                kept.append(t[at:s["start"]])
                at = max(at, s["end"])
            return "".join(kept) + t[at:]
        return pd.Series([one(t, r) for t, r in zip(texts, removed)], dtype=object)

    row = {c: F.col("row")[c] for c in docs.columns}  # under one name, so that no column can clash
    joined = docs.select(F.struct("*").alias("row")).join(cuts, row[key].eqNullSafe(F.col("of")), "left")
    row[text] = F.when(F.col("removed").isNull(), row[text]).otherwise(F.pandas_udf(cut, "string")(row[text], F.col("removed")))
    return joined.select(*[c.alias(n) for n, c in row.items()], "removed")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every repeated span of every document with the earliest occurrence it repeats."""
    return repeated_spans(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), "unit",
        F.col("words").alias("n_words"), F.col("first_key").alias("first_doc_id"), F.col("first_start").alias("first_char_start"))
