"""Registered queries against their SQL twins, and the pipeline stage by stage."""

import struct
from collections import defaultdict

import duckdb
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from assaylake.llm.mixing import OP3_SQL

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_mixing", "op4_topk", "op12_clustering"])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in df.columns]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect()) == plain([tuple(r[i] for i in order) for r in cur.fetchall()])


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def test_pipeline_stages(spark):
    """Every stage but the last returns the columns of documents; each one's decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[3] <= counts[2] < counts[0] and counts[2] <= counts[1] <= counts[0] and counts[3] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()
    rows = plain(corpus_pipeline.run(spark, SF).collect())
    assert rows == plain(packed.collect())


# --- the whole pipeline once more, in plain Python ------------------------------------------------

def within(a, b, most):
    """Edit distance at most ``most``, by a banded table."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(most + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[0] = i
            else:
                new[j] = min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (a[i - 1] != b[j - 1]))
        row = new
        if min(row.values()) > most:
            return False
    return row[len(b)] <= most


def plain_lines(docs):
    first = {}
    for key, text, *_ in docs:
        for pos, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line, (key, pos))
    by_length, gone = defaultdict(list), set()
    for line in first:
        if len(line) >= 20:
            by_length[len(line)].append(line)
    for line, at in first.items():
        if len(line) < 20:
            continue
        for n in range(len(line) - 2, len(line) + 3):
            if any(first[x] < at and within(line, x, 2) for x in by_length.get(n, ())):
                gone.add(line)
    out = []
    for key, text, lang, source in docs:
        parts = text.split("\n")
        left = [x for pos, x in enumerate(parts) if not x.strip() or first[x] == (key, pos) and x not in gone]
        if len(left) == len(parts) or "".join(left).strip():
            out.append((key, "\n".join(left), lang, source))
    return out


def plain_copies(docs):
    """The first document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    sets, root = {}, {}
    for d in docs:
        w = d[1].lower().split()
        sets[d[0]] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    for a in sorted(sets):
        near = [b for b in root if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        root[a] = a
        roots = {root[b] for b in near} | {a}
        for b, r in root.items():
            if r in roots:
                root[b] = min(roots)
    return [d for d in docs if root[d[0]] == d[0]]


def plain_mix(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", docs)
    return sorted((r[0], r[2]) for r in con.execute(OP3_SQL).fetchall())


def plain_pack(rows, most=16, budget=65536):
    lengths = sorted({n for _, n in rows})
    count = {x: sum(n == x for _, n in rows) for x in lengths}
    cost = {0: 0}  # least padded tokens of the first lengths, bucket by bucket
    bounds = {0: []}
    for _ in range(most):
        new, way = dict(cost), dict(bounds)
        for j in range(1, len(lengths) + 1):
            for i in cost:
                if i < j:
                    c = cost[i] + lengths[j - 1] * sum(count[x] for x in lengths[i:j])
                    if c < new.get(j, 1 << 60):
                        new[j], way[j] = c, [*bounds[i], lengths[j - 1]]
        cost, bounds = new, way
    return cost[len(lengths)]


def test_pipeline_against_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]
    spoken = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}  # tested by itself
    docs = [d for d in docs if d[0] in spoken]
    mixed = plain_mix(plain_copies(plain_lines(docs)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == mixed
    assert sum(r.bucket_tokens for r in got) == plain_pack(mixed)
    seed = xxhash.xxh64_intdigest(b"pack", 42)
    order = lambda r: (xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), seed) >> 1, r.doc_id)
    for bucket in {r.bucket for r in got}:
        rows = sorted((r for r in got if r.bucket == bucket), key=order)
        fit = max(1, 65536 // max(1, rows[0].bucket_tokens))
        assert [(r.batch, r.slot) for r in rows] == [(i // fit, i % fit) for i in range(len(rows))]


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    """Null and empty texts go with the language stage; an empty table gives no row."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    same = "The same words stand in this one line twice over."
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, same, "en", "a", len(same)), (4, same, "en", None, len(same)), (None, "Another text with its own words.", "en", "a", 32)]
    for name, data, want in (("odd", rows, {3, None}), ("none", [], set())):
        docs = spark.createDataFrame(data, shape)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()} == want
