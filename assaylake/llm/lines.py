"""Line deduplication with a segment-partition edit join; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, stage, table

_LINE_SPAN = 10_000_000_000  # line numbers are below this


@dataclass(frozen=True)
class LineParams:
    """edits: largest edit distance of a link; min_chars: shorter lines only go as exact copies, for
    short words are all within a few edits of each other.

    hot: a substring that more distinct lines share is joined with the texts at hand, so that its
    candidate pairs are verified where they meet and never written; results do not depend on it.
    """

    edits: int = 2
    min_chars: int = 20
    hot: int = 48


def lines_of(docs: DataFrame, p: LineParams, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, line, h1, h2, ord) of every line with a word; pos counts from 0.

    h1 and h2 are two seeded hashes of the line and name its class of equal lines; ord orders
    occurrences by key, then position (null keys last).
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.posexplode(F.split(text, "\n")).alias("pos", "line")) \
        .where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    rank = F.coalesce(F.col("key"), F.lit((1 << 63) - 1)).cast("decimal(27,0)") * F.lit(_LINE_SPAN).cast("decimal(11,0)") + F.col("pos")
    return rows.select("key", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"),
                       rank.cast("decimal(38,0)").alias("ord"))


def _segment(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` of a line cut into ``parts``; the last ones are longer."""
    short = F.floor(length / parts).cast("int")
    extra = length - short * parts  # so many segments at the end have one character more
    longer_before = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - extra))
    return short * i + longer_before + 1, short + F.when(F.lit(i) >= F.lit(parts) - extra, 1).otherwise(0)


def _key(i: int, indexed: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), indexed, F.substring(F.col("line"), start, size))


def index_keys(p: LineParams) -> list[Column]:
    """One key per segment: the segment's number, the line's length and the segment's text."""
    n = F.length("line")
    return [F.when(n >= p.min_chars, _key(i, n, *_segment(n, p.edits + 1, i))) for i in range(p.edits + 1)]


def parities() -> Column:
    """64 bits: whether the characters whose hash ends in these six bits are an odd number.

    An inserted or deleted character turns one bit, a replaced one two at most, so lines within k edits
    differ in 2 * k bits at most.  Lines of one template differ in more as soon as a word differs, which
    refuses most pairs of a common segment before their texts are looked at.  The bits are a long, since
    bit_count extends the sign of an int.
    """
    # A shift of a long counts the last six bits of its distance only.
    return F.aggregate(F.split("line", ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(c))))


def probe_keys(p: LineParams) -> list[tuple[int, str, Column | None]]:
    """(length difference, name, key) of each substring to look up; an unmoved one of a line of the
    same length is an index key, known under that name.

    For an indexed line shorter by d characters, segment i can only match substrings shifted by the
    edits before it and, from the other end, by those after it: the intersection of both ranges.
    """
    n, out = F.length("line"), []
    for d in range(p.edits + 1):
        indexed = n - d
        for i in range(p.edits + 1):
            start, size = _segment(indexed, p.edits + 1, i)
            for shift in range(max(-i, d - (p.edits - i)), min(i, d + (p.edits - i)) + 1):
                if d == shift == 0:
                    out.append((d, f"i{i}", None))
                    continue
                at = start + shift
                fits = (n >= p.min_chars) & (indexed >= p.min_chars) & (at >= 1) & (at + size - 1 <= n)
                out.append((d, f"p{len(out)}", F.when(fits, _key(i, indexed, at, size))))
    return out


def _search(a: Column, b: Column, most: Column, same) -> Column:
    """Largest k in [0, most] with same(a, b, k), where same holds for every smaller k."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(most + F.lit(2))).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(same(a, b, middle), F.struct(middle.alias("lo"), s["hi"].alias("hi"))) \
            .otherwise(F.struct(s["lo"].alias("lo"), (middle - 1).cast("int").alias("hi")))

    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings if it is at most ``most``, else null.

    Common ends are cut off by bisection.  The rest runs through a banded bit-parallel automaton:
    for each number of errors a word holds the reachable ones of the 2 * most + 1 diagonals; a
    character of ``b`` updates all diagonals at once by shifts, ands and ors.
    """
    ahead = _search(a, b, F.least(F.length(a), F.length(b)),
                    lambda x, y, k: F.substring(x, F.lit(1), k) == F.substring(y, F.lit(1), k))
    cut = F.struct(a.alias("a"), b.alias("b"), ahead.alias("n"))

    def tails(s: Column) -> Column:
        x, y = F.substring(s["a"], s["n"] + 1, F.length(s["a"])), F.substring(s["b"], s["n"] + 1, F.length(s["b"]))
        return F.struct(x.alias("a"), y.alias("b"))

    def middles(s: Column) -> Column:
        behind = _search(s["a"], s["b"], F.least(F.length(s["a"]), F.length(s["b"])),
                         lambda x, y, k: F.right(x, k) == F.right(y, k))
        return F.transform(F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"), behind.alias("n"))), lambda t: F.struct(
            F.substring(t["a"], F.lit(1), F.length(t["a"]) - t["n"]).alias("a"),
            F.substring(t["b"], F.lit(1), F.length(t["b"]) - t["n"]).alias("b")))[0]

    width, band = 2 * most + 1, (1 << (2 * most + 1)) - 1

    def automaton(s: Column) -> Column:
        m, n = F.length(s["a"]), F.length(s["b"])
        pad = F.array_repeat(F.lit(""), most)
        chars = F.struct(F.concat(pad, F.split(s["a"], ""), pad).alias("a"), F.split(s["b"], "").alias("b"))

        def run(c: Column) -> Column:
            start = F.struct(*[F.lit(sum(1 << (most + o) for o in range(k + 1))).alias(f"s{k}") for k in range(most + 1)])

            def step(old: Column, j: Column) -> Column:
                hit = F.lit(0)
                for o in range(width):
                    hit = hit.bitwiseOR(F.when(F.get(c["a"], j + o) == F.get(c["b"], j), 1 << o).otherwise(0))
                made: list[Column] = []
                packed = F.array(hit)  # computed once per character

                def update(h: Column) -> Column:
                    for k in range(most + 1):
                        now = old[f"s{k}"].bitwiseAND(h)
                        if k:
                            was = old[f"s{k - 1}"]
                            now = now.bitwiseOR(was).bitwiseOR(F.shiftright(was, 1)).bitwiseOR(F.shiftleft(made[k - 1], 1)).bitwiseAND(F.lit(band))
                        made.append(now)
                    return F.struct(*[x.alias(f"s{k}") for k, x in enumerate(made)])

                moved = F.transform(packed, update)[0]
                return F.when(old[f"s{most}"] == 0, old).otherwise(moved)

            def end(q: Column) -> Column:
                at = F.get(F.array(*[F.lit(1 << o) for o in range(width)]), m - n + most)
                out = F.lit(None).cast("int")
                for k in reversed(range(most + 1)):
                    out = F.when(q[f"s{k}"].bitwiseAND(at) != 0, k).otherwise(out)
                return out

            return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, end)

        plain = F.when((m == 0) | (n == 0), F.greatest(m, n))
        return F.when(F.abs(m - n) > most, F.lit(None).cast("int")) \
            .when((m == 0) | (n == 0), F.when(plain <= most, plain)) \
            .otherwise(F.transform(F.array(chars), run)[0])

    staged = F.transform(F.transform(F.transform(F.array(cut), tails), middles), automaton)
    return staged[0]


def line_links(lines: DataFrame, classes: DataFrame, p: LineParams) -> DataFrame:
    """(a1, a2, b1, b2, edits): every pair of different lines within the threshold, once.

    ``classes`` has a row per distinct line with its parities s, index keys i0.. and the other probe keys p1..
    The join of index and probe keys, with the parities as a condition, gives candidates by the lines'
    first hash; candidates' texts are then fetched in one more scan and verified.  Texts decide, so equal hashes of different lines cost
    time only.
    """
    index = classes.select(F.col("h1").alias("a"), F.col("s").alias("sa"), F.explode(F.array(*[f"i{i}" for i in range(p.edits + 1)])).alias("k")).where("k IS NOT NULL")
    probe = classes.select(F.col("h1").alias("b"), F.col("s").alias("sb"), F.inline(F.array(*[
        F.struct(F.col(name).alias("q"), F.lit(d > 0).alias("shorter")) for d, name, _ in probe_keys(p)]))).where("q IS NOT NULL")
    hot = stage(index.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.hot).select("k"), "hot")
    alike = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * p.edits
    on = (F.col("k") == F.col("q")) & (F.col("a") != F.col("b")) & (F.col("shorter") | (F.col("a") < F.col("b"))) & alike
    keys = small_side(hot)
    found = stage(index.join(keys, "k", "left_anti").join(probe, on).select("a", "b").distinct(), "candidates")
    need = found.select(F.col("a").alias("h1")).unionByName(found.select(F.col("b").alias("h1")))
    busy_index = index.join(keys, "k", "left_semi")
    busy_probe = probe.join(keys.withColumnRenamed("k", "q"), "q", "left_semi")
    need = need.unionByName(busy_index.select(F.col("a").alias("h1"))).unionByName(busy_probe.select(F.col("b").alias("h1")))
    need = stage(need.distinct(), "needed")
    texts = stage(lines.select("h1", "h2", "line").join(small_side(need), "h1", "left_semi")
                  .groupBy("h1", "h2").agg(F.max("line").alias("line")), "texts")
    left = texts.select(F.col("h1").alias("a"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("la"))
    right = texts.select(F.col("h1").alias("b"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("lb"))
    edits = edit_distance(F.col("la"), F.col("lb"), p.edits)
    out = ["a1", "a2", "b1", "b2", "edits"]
    cold = found.join(left, "a").join(right, "b").withColumn("edits", edits).where("edits IS NOT NULL").select(*out)
    met = busy_index.join(left, "a").drop("a").join(
        busy_probe.join(right, "b").drop("b"),
        (F.col("k") == F.col("q")) & (F.col("a1") != F.col("b1")) & (F.col("shorter") | (F.col("a1") < F.col("b1"))) & alike & edits.isNotNull())
    return cold.unionByName(met.withColumn("edits", edits).select(*out)).distinct()


def mark_lines(docs: DataFrame, params: LineParams | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, class_key, class_pos, n_copies, n_links, kept), a row per line with a word.

    A class is all equal lines, named by its first occurrence (by key, then position); n_copies
    counts its occurrences and n_links the different lines within the edit threshold, never expanded
    to occurrences.  A line is kept if it is its class's first occurrence and no linked line occurs
    first.  Lines under ``min_chars`` have no links.  Null and empty texts and blank lines give no row.  Null keys rank last;
    rows that repeat a key and its text are one document: their lines are kept or dropped alike.
    Very long lines are compared whole.  Other columns are ignored.
    """
    p = params or LineParams()
    lines = lines_of(docs, p, text, key)
    keys = {"s": parities()} | {f"i{i}": k for i, k in enumerate(index_keys(p))} | {name: k for _, name, k in probe_keys(p) if k is not None}
    classes = stage(lines.select("h1", "h2", "ord", *[k.alias(c) for c, k in keys.items()]).groupBy("h1", "h2").agg(
        F.min("ord").alias("first"), F.count(F.lit(1)).alias("n_copies"), *[F.max(c).alias(c) for c in keys]), "lines")
    links = stage(line_links(lines, classes, p), "links")
    ends = links.select("a1", "a2", "b1", "b2").unionByName(links.select(
        F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    some = stage(classes.select("h1", "h2", "first").join(ends.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).distinct(),
                                                          ["h1", "h2"], "left_semi"), "linked")
    own = some.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("own"))
    other = some.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("other"))
    linked = ends.join(own, ["a1", "a2"]).join(other, ["b1", "b2"]).groupBy("a1", "a2").agg(
        F.count(F.lit(1)).alias("n_links"), F.max(F.col("other") < F.col("own")).alias("later"))
    whole = classes.select("h1", "h2", "first", "n_copies").join(
        linked, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")), "left").drop("a1", "a2") \
        .withColumnRenamed("h1", "c1").withColumnRenamed("h2", "c2")
    span = F.lit(_LINE_SPAN).cast("decimal(11,0)")
    pos = F.pmod(F.col("first"), span)
    owner = F.expr(f"CAST((first - pmod(first, {_LINE_SPAN})) DIV {_LINE_SPAN} AS BIGINT)")
    return lines.select("key", "pos", "h1", "h2", "ord").join(whole, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))).select(
        "key", "pos", F.when(owner < F.lit((1 << 63) - 1), owner).alias("class_key"), pos.cast("int").alias("class_pos"), "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ((F.col("ord") == F.col("first")) & ~F.coalesce("later", F.lit(False))).alias("kept"))


def dedup_lines(docs: DataFrame, params: LineParams | None = None, text: str = "text", key: str = "doc_id",
                length: str | None = "n_chars") -> DataFrame:
    """The documents without their dropped lines; columns as they came, ``length`` renewed if present.

    A document none of whose lines with a word is left goes; documents that had none to begin with
    (null, empty, blank) stay as they are.
    """
    drops = mark_lines(docs, params, text, key).where(~F.col("kept")).groupBy(F.col("key").alias("of")).agg(F.collect_set("pos").alias("drops"))
    own = {c: F.col("row")[c] for c in docs.columns}  # under one name, so that no column can clash
    out = docs.select(F.struct("*").alias("row")).join(drops, own[key].cast("long").eqNullSafe(F.col("of")), "left")
    parts, changed = F.split(own[text], "\n"), F.col("drops").isNotNull()
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drops")), lambda i: F.get(parts, i))
    out = out.select("row", changed.alias("changed"), F.when(changed, F.array_join(left, "\n")).otherwise(own[text]).alias("left"))
    out = out.where(~F.col("changed") | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    own[text] = F.col("left")
    if length and length in docs.columns:
        own[length] = F.when(F.col("changed"), F.length("left").cast(docs.schema[length].dataType)).otherwise(own[length])
    return out.select(*[c.alias(n) for n, c in own.items()])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every line with a word, its class, links and verdict; line_no counts from 1."""
    return mark_lines(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), (F.col("pos") + 1).alias("line_no"), F.col("class_key").alias("class_doc_id"),
        (F.col("class_pos") + 1).alias("class_line_no"), "n_copies", "n_links", "kept")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: line dedup of the stage's own documents."""
    return dedup_lines(docs)


#: DuckDB measures edits in bytes; letters beyond ASCII are mapped to unused control characters first.
_WIDE = "ßáäçèéêíñóöúüÓÑÉÈÊÇÄÖÜÁÍÚ"
_NARROW = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 32)][:len(_WIDE)])

OP2_SQL = rf"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)
      WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
c AS (SELECT line, min(row(doc_id, pos)) AS first, count(*) AS n_copies, length(line) AS n, translate(line, '{_WIDE}', {_NARROW}) AS t
      FROM l GROUP BY line),
p AS (SELECT a.line AS one, b.line AS other, a.first AS first, b.first AS other_first FROM c a JOIN c b
      ON a.n >= 20 AND b.n >= 20 AND b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line AND levenshtein(a.t, b.t) <= 2),
k AS (SELECT one, count(*) AS n_links, bool_or(other_first < first) AS later FROM p GROUP BY one)
SELECT l.doc_id, l.pos + 1 AS line_no, c.first[1] AS class_doc_id, c.first[2] + 1 AS class_line_no, c.n_copies,
  coalesce(k.n_links, 0) AS n_links, row(l.doc_id, l.pos) = c.first AND NOT coalesce(k.later, FALSE) AS kept
FROM l JOIN c USING (line) LEFT JOIN k ON k.one = l.line
"""
