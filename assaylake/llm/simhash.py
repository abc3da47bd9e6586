"""SimHash near-duplicates by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import components, small_side, stage, table

SEED = 42
_CHUNK = 1 << 16


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of the unsigned hashes of a set; 0 for an empty one."""
    ones = sum((_ones(hashes[at:at + _CHUNK]) for at in range(0, len(hashes), _CHUNK)), np.zeros(64, np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a whole text; 0 for null and for texts without a word.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as they
    occur; a text with fewer words than a shingle is one shingle.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    size, join, digest = min(shingle, len(words)), b" ".join, xxhash.xxh64_intdigest
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):  # bounded memory for very long texts
        part = words[at:min(n, at + _CHUNK) + size - 1]
        rows = np.fromiter((digest(join(w), SEED) for w in zip(*[part[i:] for i in range(size)])), np.uint64)
        ones += _ones(rows)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp): one row per input row."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["key", "fp"])

    kind = docs.schema[key].dataType
    return docs.select(key, text).mapInArrow(each, StructType([StructField("key", kind), StructField("fp", LongType())]))


def _turned(fp: Column, by: int) -> Column:
    """Rotation to the right, so that the segment starting at bit ``by`` comes first."""
    return fp if by == 0 else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by))


def _mask(bits: int) -> Column:
    return F.lit(-1 if bits >= 64 else (1 << bits) - 1).cast("long")


def _bit(at: int) -> Column:
    return F.lit((1 << at) - ((1 << 64) if at == 63 else 0)).cast("long")


def near_pairs(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """All pairs (a, b), a < b, of distinct values of ``fp`` that differ in at most ``max_bits`` bits.

    The 64 bits form a ring of ``max_bits + 1`` segments.  By the pigeonring principle a pair within
    the distance has a segment from which, for every chain length l, the first l segments differ in
    at most l * max_bits / (max_bits + 1) bits, that is l - 1.  So the first segment agrees and the
    second differs in one bit at most: these two make the join key (the probing side lists the
    second segment with every single bit flipped), longer chains are checked next and the full
    distance last, all inside the join condition.  A key spans half the bits at three differences,
    which keeps buckets small as the table grows.  Nothing is capped.

    Spark sizes the listed keys as the values they come from, so the join is marked: neither side is
    broadcast, whatever the table's size.
    """
    parts = max_bits + 1
    starts = [round(64 * i / parts) for i in range(parts + 1)]
    width = [starts[i + 1] - starts[i] for i in range(parts)]
    fp = F.col("fp")
    index, probe = [], []
    for i in range(parts):
        first, second = width[i], width[(i + 1) % parts]
        key = _turned(fp, starts[i]).bitwiseAND(_mask(first + second))
        index.append(F.struct(F.lit(i).alias("i"), key.alias("k")))
        flips = [key] + [key.bitwiseXOR(_bit(first + f)) for f in range(second)]
        probe += [F.struct(F.lit(i).alias("i"), k.alias("k")) for k in flips]
    distinct = fps.select("fp").where(fp.isNotNull()).distinct()
    left = distinct.select(fp.alias("a"), F.inline(F.array(*index)))
    right = distinct.select(fp.alias("b"), F.inline(F.array(*probe))).withColumnRenamed("i", "j").withColumnRenamed("k", "m")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chains = F.bit_count(differ) <= max_bits
    for i in range(parts):
        reach = width[i] + width[(i + 1) % parts]
        ring = _turned(differ, starts[i])
        for l in range(3, parts):
            reach += width[(i + l - 1) % parts]
            chains = chains & ((F.col("i") != i) | (F.bit_count(ring.bitwiseAND(_mask(reach))) <= l - 1))
    on = (F.col("k") == F.col("m")) & (F.col("i") == F.col("j")) & (F.col("a") < F.col("b")) & chains
    return left.join(right.hint("merge"), on).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """(key, fp, component): component is the smallest key reachable over links of at most ``max_bits``.

    Equal fingerprints are one class, linked classes one component; nothing is expanded into pairs
    of documents.  Null and empty texts have fingerprint 0 and are linked like any other.  Repeated
    rows give repeated result rows.  A null key is never the smallest; a component of null keys
    alone has a null component.  Other columns of the input are ignored.  Empty in, empty out.
    """
    fps = stage(fingerprints(docs, text, key, shingle), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("key").alias("first")), "classes")
    links = components(near_pairs(classes, max_bits))
    linked = stage(classes.join(links, F.col("fp") == F.col("node")).select("fp", "first", "root"), "linked")
    root = linked.groupBy("root").agg(F.min("first").alias("low"))
    moved = linked.join(root, "root").select(F.col("fp").alias("of"), "low")
    whole = classes.join(moved, F.col("fp") == F.col("of"), "left") \
        .select(F.col("fp").alias("class"), F.coalesce("low", "first").alias("component"))
    return fps.join(whole, F.col("fp") == F.col("class")).select("key", "fp", "component")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprint and component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component of near copies the document with the smallest doc_id stays.

    Candidates are SimHash fingerprints of five-word shingles joined by pigeonring, and what ``copy_groups``
    adds where fingerprints lie further apart; links are the candidates whose exact Jaccard similarity is
    0.8 or more.
    Rows that repeat a doc_id are one document and stay alike; a document without a doc_id stays.
    """
    from .near_copies import copy_groups  # which uses the fingerprints of this module

    groups = copy_groups(docs)
    gone = stage(groups.where("key IS NOT NULL AND key <> component").select("key").distinct(), "copies-gone")
    return docs.select(F.struct("*").alias("row")).join(small_side(gone), F.col("row")["doc_id"] == F.col("key"), "left_anti").select("row.*")
