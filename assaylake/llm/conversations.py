"""Conversation structure repair: a dynamic program over edits whose audits are persistent linked strings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import stage, table

_BLANK = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
_LEGAL = ("su", "ua", "au")
#: States after a part of the repaired roles: nothing, the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # what an inserted or rerolled turn leads to
_ROLE = {USER: "user", ASSISTANT: "assistant"}


@dataclass(frozen=True)
class RepairParams:
    """Costs of the edits; piece: stored rows that one run of the dynamic program takes; copies: equal
    rows of a turn that share a stored row; flush: bytes of repaired text handed on at once."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1
    piece: int = 4096
    copies: int = 16
    flush: int = 4 << 20


class Audits:
    """Strings as nodes that share their prefixes; node 0 is the empty string.

    A node knows its last letter, length, rolling hash and its ancestors at distances 1, 2, 4 and so on.
    """

    def __init__(self, modulus: int = (1 << 61) - 1, base: int = 911_382_323):
        self.modulus, self.base = modulus, base
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[0]]

    def add(self, node: int, letter: str) -> int:
        """The string of ``node`` with one more letter."""
        at = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.modulus)
        far = [node]
        k = 0
        while k < len(self.up[far[k]]) and self.depth[far[k]] > 0:
            far.append(self.up[far[k]][k])
            k += 1
        self.up.append(far)
        return at

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of length ``depth``."""
        while (over := self.depth[node] - depth) > 0:
            node = self.up[node][over.bit_length() - 1]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _differ_below(self, x: int, y: int) -> tuple[int, int] | None:
        """The first place where two nodes of equal depth and equal hash differ after all, if any."""
        found = None
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether string ``a`` sorts before string ``b``: letters after their longest common prefix decide.

        The prefix is found by lifting both nodes while hashes differ; equal hashes of different nodes
        are verified letter by letter.
        """
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            found = self._differ_below(x, y)
            return self.letter[found[0]] < self.letter[found[1]] if found else self.depth[a] < self.depth[b]
        k = len(self.up[x]) - 1
        while k >= 0:
            if k < len(self.up[x]) and k < len(self.up[y]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
            k -= 1
        x, y = self._differ_below(self.up[x][0], self.up[y][0]) or (x, y)
        return self.letter[x] < self.letter[y]


class Repair:
    """Cheapest edits of a run of rows from one state to every state; ties by the audit."""

    def __init__(self, state: int, p: RepairParams, audits: Audits | None = None):
        self.p, self.audits = p, audits or Audits()
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[state] = (0, 0)
        self._insert()

    def _offer(self, to: list, state: int, cost: int, node: int, letter: str) -> None:
        old = to[state]
        if old is None or cost < old[0]:
            to[state] = (cost, self.audits.add(node, letter))
        elif cost == old[0]:
            new = self.audits.add(node, letter)
            if self.audits.less(new, old[1]):
                to[state] = (cost, new)

    def _insert(self) -> None:
        """Inserted turns before the next row; longer chains of them are never cheaper."""
        for state in (START, SYSTEM, ASSISTANT, USER):
            if self.best[state]:
                cost, node = self.best[state]
                self._offer(self.best, _NEXT[state], cost + self.p.insert, node, "I")

    def row(self, initial: str, forced: bool, truncated: bool) -> None:
        """One more row: its role's initial, whether it has to go, whether keeping it costs more."""
        after: list[tuple[int, int] | None] = [None] * 4
        extra = self.p.truncated if truncated else 0
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self._offer(after, state, cost + self.p.delete, node, "D")
            if not forced:
                if (state, initial) in _KEEP:
                    self._offer(after, _KEEP[state, initial], cost + extra, node, "K")
                self._offer(after, _NEXT[state], cost + self.p.rerole + extra, node, "R")
        self.best = after
        self._insert()

    def results(self) -> list[tuple[int, int, str]]:
        """(state, cost, audit) of every state reached."""
        return [(s, b[0], self.audits.text(b[1])) for s, b in enumerate(self.best) if b]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, n of them alike; n = 0 for dropped ones.

    Null roles and texts, and nulls in the damage key, count as one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n"))


def ordered(rows: DataFrame, p: RepairParams) -> DataFrame:
    """(conv_id, turn, role, text, n, later, blank, truncated, at, piece), staged in one global order.

    Equal rows of a turn are counted together, in stored rows of at most ``copies``.  ``later`` marks
    rows whose role and text occur before.  Rows are dealt by ranges of (conversation, turn, role, hash
    of the text), so a conversation with a large part of all rows spreads over tasks; ``piece`` numbers
    runs of at most ``piece`` neighbours.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    alike = stage(alike.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit("row"), "role", "text")), "turns")
    first = alike.where("n > 0").groupBy(F.col("conv_id").alias("c_"), F.col("h1").alias("a_"), F.col("h2").alias("b_")) \
        .agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    met = alike.join(first, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("h1") == F.col("a_")) & (F.col("h2") == F.col("b_")), "left")
    again = F.coalesce(turn > F.col("first"), F.lit(False))
    shares = F.greatest(F.lit(1), F.ceil(F.col("n") / p.copies)).cast("int")
    flat = met.select("conv_id", "turn", "role", "text", "h1", "h2", "n", again.alias("again"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("part"))
    flat = flat.select("conv_id", "turn", "role", "text", "h1", "h2", "part", (F.col("again") | (F.col("part") > 0)).alias("later"),
                       F.least(F.lit(p.copies), F.col("n") - F.col("part") * p.copies).cast("int").alias("n"),
                       (~F.col("text").rlike(_BLANK)).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("truncated"))
    flat = stage(flat, "turns-marked")
    order = ["conv_id", "turn", "role", "h1", "h2", "part"]  # nulls first
    placed = flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stage(placed.drop("h1", "h2", "part").withColumn("piece", F.floor(F.col("at") / p.piece)), "turns-ordered")


def _streamed(rows: DataFrame, group: list[str], order: list[str], made: Callable[[Iterator[dict], bool], Iterator[dict]], schema: str) -> DataFrame:
    """``made(rows, opens)`` for each run of equal (conv_id, piece), as far as ``group`` has them, in order.

    Rows are dealt by ``group`` and sorted; a task reads them as a stream and holds what ``made`` holds.
    ``opens`` says that a row of another conversation came just before in the same piece.
    """
    runs = [c for c in ("conv_id", "piece") if c in rows.columns and (c in group or group == ["piece"])]
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in b.to_pylist())
        row, before, out, size = next(stream, None), None, [], 0
        while row is not None:
            key = tuple(row[c] for c in runs)
            opens = before is not None and before[-1:] == key[-1:] and len(key) > 1
            held = row

            def run() -> Iterator[dict]:
                nonlocal held
                while held is not None and tuple(held[c] for c in runs) == key:
                    now, held = held, None
                    yield now
                    held = next(stream, None)

            for made_row in made(run(), opens):
                out.append(made_row)
                size += 200 + sum(len(v) for v in made_row.values() if isinstance(v, (str, bytes)))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, size = [], 0
            row, before = held, key
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return rows.repartition(*group).sortWithinPartitions(*order).mapInArrow(each, schema)


def piece_summaries(rows: DataFrame, p: RepairParams) -> DataFrame:
    """A row per conversation and piece: counts, both ends, and the cheapest edits between all states."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def made(run: Iterator[dict], opens: bool) -> Iterator[dict]:
        # a conversation that starts inside the piece starts with nothing; only the first one may go on
        audits = Audits()
        repairs = {s: Repair(s, p, audits) for s in ([START] if opens else range(4))}
        out = dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "turns"], 0) | dict.fromkeys(["first_initial", "last_initial", "first_turn", "last_turn"])
        for row in run:
            out["conv_id"], out["piece"] = row["conv_id"], row["piece"]
            initial, turn = row["role"][:1], row["turn"]
            if row["n"] and turn is not None and turn != out["last_turn"]:
                out["turns"] += 1
                out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
                out["last_turn"] = turn
            for i in range(row["n"]):
                again = row["later"] or i > 0
                forced = row["blank"] or again
                cut = not forced and row["truncated"]
                out["blank"] += row["blank"]
                out["duplicate"] += again and not row["blank"]
                out["truncated"] += cut
                if out["first_initial"] is None:
                    out["first_initial"] = initial
                else:
                    out["illegal"] += out["last_initial"] + initial not in _LEGAL
                out["last_initial"] = initial
                for r in repairs.values():
                    r.row(initial, forced, cut)
        out["paths"] = [{"begin": s, "end": e, "cost": c, "audit": a} for s, r in repairs.items() for e, c, a in r.results()]
        yield out

    columns = ["conv_id", "piece", "at", "turn", "role", "n", "later", "blank", "truncated"]
    schema = (f"conv_id {kind}, piece long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
              "first_initial string, last_initial string, paths array<struct<begin: int, end: int, cost: long, audit: string>>")
    return _streamed(rows.select(*columns), ["piece"], ["piece", "at"], made, schema)


def decisions(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, state, audit, last, totals): the chosen state and edits of each piece.

    The pieces of a conversation are folded in order: cheapest paths over four states, ties by the
    whole audit.  ``last`` marks the piece that carries the conversation's totals.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def made(run: Iterator[dict], _: bool) -> Iterator[dict]:
        best: dict[int, tuple] = {START: (0, "", None)}
        total = dict.fromkeys(["blank", "duplicate", "truncated", "illegal"], 0)
        turns, low, high, end, numbers = 0, None, None, None, []
        for row in run:
            conv, now = row["conv_id"], {}
            numbers.append(row["piece"])
            for path in row["paths"]:
                if path["begin"] in best:
                    cost, audit, chain = best[path["begin"]]
                    new = (cost + path["cost"], audit + path["audit"])
                    if path["end"] not in now or new < now[path["end"]][:2]:
                        now[path["end"]] = (*new, (chain, path["begin"], path["audit"]))
            best = now
            for k in total:
                total[k] += row[k]
            if row["first_initial"] is not None:
                total["illegal"] += end is not None and end + row["first_initial"] not in _LEGAL
                end = row["last_initial"]
            if row["turns"]:
                turns += row["turns"] - (row["first_turn"] == high)
                low, high = row["first_turn"] if low is None else low, row["last_turn"]
        cost, _, chain = min((best[s] for s in (START, ASSISTANT) if s in best), key=lambda b: b[:2])
        total |= {"cost": cost, "gaps": 0 if low is None else high - low + 1 - turns}
        for number in reversed(numbers):
            chain, state, audit = chain
            yield {"conv_id": conv, "piece": number, "state": state, "audit": audit, "last": number == numbers[-1]} | total

    return _streamed(pieces, ["conv_id"], ["conv_id", "piece"], made,
                     f"conv_id {kind}, piece long, state int, audit string, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of a piece side by side with its decision."""
    of = chosen.select(F.col("conv_id").alias("c_"), F.col("piece").alias("p_"), "state", "audit", "last", *[F.col(t).alias(f"t_{t}") for t in _TOTALS])
    return rows.select("conv_id", "piece", "at", "role", "text", "n").join(of, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("piece") == F.col("p_"))).drop("c_", "p_")


def repaired_turns(run: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every repaired turn of one piece; rows as made by ``repaired_rows``."""
    state, at, audit = None, 0, ""
    for row in run:
        if state is None:
            state, audit = row["state"], row["audit"]
        for _ in range(row["n"]):
            while audit[at] == "I":
                state, at = _NEXT[state], at + 1
                yield "I", _ROLE[state], ""
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _KEEP[state, row["role"][:1]]
                yield edit, row["role"], row["text"]
            elif edit == "R":
                state = _NEXT[state]
                yield edit, _ROLE[state], row["text"]
    for _ in audit[at:]:  # only insertions are left
        state = _NEXT[state]
        yield "I", _ROLE[state], ""


def repair_plan(conversations: DataFrame, p: RepairParams) -> tuple[DataFrame, DataFrame]:
    """Ordered rows and the decision for each of their pieces."""
    rows = ordered(damaged(conversations), p)
    return rows, stage(decisions(stage(piece_summaries(rows, p), "turns-pieces")), "turns-decided")


def repaired_conversations(conversations: DataFrame, params: RepairParams | None = None) -> DataFrame:
    """(conv_id, piece, position, edit, role, text): the repaired turns in order of (piece, position)."""
    rows, chosen = repair_plan(conversations, params or RepairParams())
    kind = rows.schema["conv_id"].dataType.simpleString()

    def made(run: Iterator[dict], _: bool) -> Iterator[dict]:
        first = next(run)

        def again() -> Iterator[dict]:
            yield first
            yield from run

        for i, (edit, role, text) in enumerate(repaired_turns(again())):
            yield {"conv_id": first["conv_id"], "piece": first["piece"], "position": i, "edit": edit, "role": role, "text": text}

    return _streamed(repaired_rows(rows, chosen), ["conv_id", "piece"], ["conv_id", "piece", "at"], made,
                     f"conv_id {kind}, piece long, position int, edit string, role string, text string")


def audit_conversations(conversations: DataFrame, params: RepairParams | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    Rows are damaged, ordered by turn (nulls first; rows of one turn by role and hash of the text) and
    checked; the cheapest edits make the roles' initials read ``(s?(ua)+)?``.  A dynamic program over
    four states keeps the least audit per state as a persistent string.  Conversations are cut into
    pieces of bounded size: a piece yields its cheapest edits between any two states, and a fold over
    the pieces gives the whole, so no conversation is held in one task; only the digest, sequential by
    its nature, reads a conversation's repaired text as one stream.

    Null roles and texts count as one space; a null conv_id is a conversation of its own.  Repeated rows
    are duplicates.  Very long texts are read whole.  A conversation without rows after damage has zeros,
    an empty audit and the digest of nothing.  Other columns are ignored; an empty table gives no row.
    """
    p = params or RepairParams()
    rows, chosen = repair_plan(conversations, p)
    kind = rows.schema["conv_id"].dataType.simpleString()
    totals = ", ".join(f"{t} long" for t in _TOTALS)

    def bodies(run: Iterator[dict], _: bool) -> Iterator[dict]:
        first, held, size, part = next(run), [], 0, 0

        def again() -> Iterator[dict]:
            yield first
            yield from run

        base = {"conv_id": first["conv_id"], "piece": first["piece"]}
        for _, role, text in repaired_turns(again()):
            held.append(f"{role}:{text}")
            size += len(held[-1])
            if size > p.flush:
                yield base | {"part": part, "body": "\n".join(held), "audit": "", "last": False}
                held, size, part = [], 0, part + 1
        yield base | {"part": part, "body": "\n".join(held) if held else None, "audit": first["audit"], "last": first["last"]} | {t: first[f"t_{t}"] for t in _TOTALS}

    made_bodies = _streamed(repaired_rows(rows, chosen), ["conv_id", "piece"], ["conv_id", "piece", "at"], bodies,
                            f"conv_id {kind}, piece long, part int, body string, audit string, last boolean, {totals}")

    def digests(run: Iterator[dict], _: bool) -> Iterator[dict]:
        digest, begun, audit = hashlib.sha256(), False, []
        for row in run:
            audit.append(row["audit"])
            if row["body"] is not None:
                digest.update((("\n" if begun else "") + row["body"]).encode())
                begun = True
            if row["last"]:
                out = {"conv_id": row["conv_id"]} | {t: row[t] for t in _TOTALS}
        yield out | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    return _streamed(made_bodies, ["conv_id"], ["conv_id", "piece", "part"], digests,
                     f"conv_id {kind}, {totals}, audit string, repaired_sha256 string")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: faults, cheapest repair and its digest for every conversation."""
    return audit_conversations(table(spark, sf_dir, "conversations"))

