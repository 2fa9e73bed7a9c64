"""Repair of conversation structure by iterative-deepening A*.

The edits of a conversation are found by a depth-first search that tries them in ASCII order under rising cost bounds and
remembers, for each state, the largest budget with which it has failed.  The first accepting path is the cheapest
repair, and of the cheapest ones the first in ASCII order.

Rows are range-partitioned by conversation and turn, so a very long conversation lies in many tasks.  Each task cuts its
rows into segments and searches every way through a segment: from each role that may stand before it to each role that
may stand behind it.  A conversation's segments are then chained in one pass over their costs.  Two paths over the same
rows are never prefixes of each other, because each ends with the edit of the last row, so the first path in ASCII order
is composed of first paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from neurospan.llm.shared import crc32_fold, cut, same

#: Costs of the edits, and of keeping or reroling a row that breaks off.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a segment.
SEGMENT_ROWS = 32
SPACE = " \t\n\v\f\r"
BLANK, DUPLICATE, BROKEN, SOUND = "blank", "duplicate", "truncated", ""

# what stands before a row: nothing, a system row, a user row, an assistant row; DONE: the whole repair, ends included
START, SYSTEM, USER, ASSISTANT, DONE = range(5)
#: The role that must follow, as initial and state.
FOLLOWS = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
#: Inserts that complete a repair behind its last row.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: "", DONE: ""}


def fault(text: str) -> str:
    """Whether a row is blank or breaks off; duplicates are known from the rows before."""
    bare = text.strip(SPACE)
    return BLANK if not bare else SOUND if bare[-1] in ".!?" else BROKEN


class Search:
    """Cheapest edits of a run of rows, ending in one state; searches from several states share what has failed."""

    def __init__(self, initials: Sequence[str], faults: Sequence[str], goal: int):
        self.initials, self.faults, self.goal, self.n = initials, faults, goal, len(faults)
        self.must = [f in (BLANK, DUPLICATE) for f in faults]
        self.extra = [TRUNCATED if f == BROKEN else 0 for f in faults]
        self.least = [0] * (self.n + 1)  # of the rows from here on: what no repair avoids
        for k in range(self.n - 1, -1, -1):
            self.least[k] = self.least[k + 1] + (DELETE if self.must[k] else self.extra[k])
        self.failed: dict[tuple[int, int], int] = {}

    def _possible(self, state: int) -> bool:
        if self.goal == START:
            return state == START
        if self.goal == SYSTEM:
            return state == SYSTEM or (state == START and any(i == "s" and not m for i, m in zip(self.initials, self.must, strict=True)))
        return True

    def best(self, state: int) -> tuple[int, str] | None:
        """(cost, edits) from a state, or None if the goal cannot be reached."""
        if not self._possible(state):
            return None
        bound = self.least[0]
        while (found := self._within(state, bound)) is None:
            bound += 1
        return bound, found

    def _edits(self, k: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, next row, next state) in ASCII order."""
        role, after = FOLLOWS[state]
        if k == self.n:
            return [("I", INSERT, k, after)] if self.goal == DONE else []
        out = [("D", DELETE, k + 1, state), ("I", INSERT, k, after)]
        if not self.must[k]:
            if self.initials[k] == role:
                out.append(("K", KEEP + self.extra[k], k + 1, after))
            elif self.initials[k] == "s" and state == START:
                out.append(("K", KEEP + self.extra[k], k + 1, SYSTEM))
            out.append(("R", REROLE + self.extra[k], k + 1, after))
        return out

    def _within(self, state: int, bound: int) -> str | None:
        """The first accepting path that costs at most ``bound``."""
        path: list[str] = []
        stack = [(0, state, bound, iter(self._edits(0, state)))]
        if self._accepts(0, state):
            return ""
        while stack:
            k, at, budget, edits = stack[-1]
            for edit, cost, then, after in edits:
                left = budget - cost
                if left < self.least[then] or self.failed.get((then, after), -1) >= left:
                    continue
                path.append(edit)
                if self._accepts(then, after):
                    return "".join(path)
                stack.append((then, after, left, iter(self._edits(then, after))))
                break
            else:
                self.failed[k, at] = max(budget, self.failed.get((k, at), -1))
                stack.pop()
                if path:
                    path.pop()
        return None

    def _accepts(self, k: int, state: int) -> bool:
        return k == self.n and (state == self.goal if self.goal != DONE else state in (START, ASSISTANT))


def apply_edits(edits: str, state: int, rows: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired (role, text) rows."""
    out, k = [], 0
    for e in edits:
        role, after = FOLLOWS[state]
        if e == "I":
            out.append((ROLES[role], ""))
        elif e == "R":
            out.append((ROLES[role], rows[k][1]))
        elif e == "K":
            out.append(rows[k])
            after = SYSTEM if rows[k][0][:1] == "s" else after
        state = state if e == "D" else after
        k += e != "I"
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of ``conversations`` rows with the faults that their crc32 gives them.

    A null is one space: as part of the crc32's text, as a role and as a text.  Ids and turns themselves stay null.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = crc32_fold(F.concat(name("conv_id"), F.lit(":"), name("turn")), 20)
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    return rows.filter(what != 0).select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"),
        F.when(what == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    """Stands for a row's role and text; the role's length keeps both apart."""
    return F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"), 256)


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, first): equal rows of a turn counted, and whether any stood at an earlier turn.

    Equal rows are combined before the shuffle, so a row that repeats without end is one row per turn.
    """
    counted = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")))
    keyed = counted.withColumn("digest", _digest())
    # nulls first, as in the order of the rows
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = keyed.select("conv_id", "digest", turn.alias("t")).groupBy("conv_id", "digest").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    firsts = firsts.filter("least <> most").select(F.col("conv_id").alias("of_conv"), F.col("digest").alias("of_digest"), "least")
    met = same(F.col("conv_id"), F.col("of_conv")) & (F.col("digest") == F.col("of_digest"))
    first = F.coalesce(F.col("least") == turn, F.lit(True)).alias("first")
    return keyed.join(firsts, met, "left").select("conv_id", "turn", "role", "text", "n", first)


_SEGMENT = "part int, seq bigint, roles array<string>, texts array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, ways array<struct<enter: int, leave: int, cost: bigint, edits: string>>"


def _ways(roles: list[str], faults: list[str], whole: bool, begins: bool) -> list[dict]:
    """The best way from each state before the segment to each state behind it."""
    initials, out = [r[:1] for r in roles], []
    for goal in (DONE,) if whole else (START, SYSTEM, USER, ASSISTANT):
        search = Search(initials, faults, goal)
        for state in (START,) if begins else (START, SYSTEM, USER, ASSISTANT):
            if found := search.best(state):
                out.append({"enter": state, "leave": goal, "cost": found[0], "edits": found[1]})
    return out


def _illegal(roles: Sequence[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Segments of the rows in order, at most ``segment_rows`` each, with every way through them."""
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        now, roles, texts, faults = None, [], [], []
        begins, pure = part == 0, True  # whether the conversation begins here; whether no segment of it was cut off

        def close(ended: bool) -> dict:
            nonlocal seq
            whole = begins and pure and ended
            out = {
                "conv_id": now[0], "part": part, "seq": seq, "roles": list(roles), "texts": list(texts),
                **{k: faults.count(k) for k in (BLANK, DUPLICATE, BROKEN)}, "illegal": _illegal(roles),
                "ways": _ways(roles, faults, whole, begins and pure),
            }
            seq += 1
            roles.clear(), texts.clear(), faults.clear()
            return out

        for batch in batches:
            made = []
            for conv, role, text, n, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "first")), strict=True):
                if now is None or now[0] != conv:
                    if roles:
                        made.append(close(True))
                    begins, pure = begins if now is None else True, True
                    now = (conv,)
                kind_of = fault(text)
                for k in range(n):
                    if len(roles) == segment_rows:
                        made.append(close(False))
                        pure = False
                        if len(made) == 256:
                            yield pa.RecordBatch.from_pylist(made, schema)
                            made = []
                    roles.append(role)
                    texts.append(text)
                    faults.append(kind_of if kind_of == BLANK or (first and k == 0) else DUPLICATE)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
        if roles:
            yield pa.RecordBatch.from_pylist([close(False)], schema)

    spark_schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(_SEGMENT).fields])
    schema = to_arrow_schema(spark_schema)
    return ordered.select("conv_id", "role", "text", "n", "first").mapInArrow(run, spark_schema)


class _Chain:
    """Cheapest ways over the segments of one conversation, one for each state they may end in."""

    def __init__(self):
        self.reached = {START: (0, 0)}  # state -> (cost, place in ASCII order)
        self.back: list[dict[int, int]] = []  # per segment: state behind it -> state before it
        self.places: list[tuple[int, int]] = []
        self.illegal = 0
        self.counts = [0, 0, 0]
        self.last = None

    def add(self, part: int, seq: int, ways: list[dict], first: str, last: str, illegal: int, counts: Sequence[int]) -> None:
        best: dict[int, tuple] = {}
        for w in ways:
            if (before := self.reached.get(w["enter"])) is not None:
                found = (before[0] + w["cost"], before[1], w["edits"], w["enter"])
                if w["leave"] not in best or found < best[w["leave"]]:
                    best[w["leave"]] = found
        order = sorted(best, key=lambda s: best[s][1:3])
        self.reached = {s: (best[s][0], order.index(s)) for s in best}
        self.back.append({s: best[s][3] for s in best})
        self.places.append((part, seq))
        self.illegal += illegal + (self.last is not None and _illegal([self.last, first]))
        self.counts = [x + y for x, y in zip(self.counts, counts, strict=True)]
        self.last = last

    def chosen(self) -> Iterator[dict]:
        """The way taken through each segment; the last row has the totals."""
        cost, _, state = min((c + INSERT * len(TAIL[s]), place, s) for s, (c, place) in self.reached.items())
        states = [state]
        for back in reversed(self.back):
            states.append(back[states[-1]])
        states.reverse()
        end = len(self.places) - 1
        for k, (part, seq) in enumerate(self.places):
            tail = TAIL[state] if k == end else ""
            yield {
                "part": part, "seq": seq, "enter": states[k], "leave": states[k + 1], "tail": tail, "cost": cost if k == end else 0,
                "illegal": self.illegal if k == end else 0, **dict(zip((BLANK, DUPLICATE, BROKEN), self.counts if k == end else (0, 0, 0), strict=True)),
            }


_CHOICE = "part int, seq bigint, enter int, leave int, tail string, cost bigint, illegal bigint, blank bigint, duplicate bigint, truncated bigint"


def _chosen(segments: DataFrame) -> DataFrame:
    """The way through every segment: one streaming pass over each conversation's costs, in order."""
    rows = segments.select(
        "conv_id", "part", "seq", "ways", F.element_at("roles", 1).alias("head"), F.element_at("roles", -1).alias("last"),
        "illegal", "blank", "duplicate", "truncated",
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    names = [x.split()[0] for x in _CHOICE.split(", ")]
    schema = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[x.split()[1]]) for n, x in zip(names, _CHOICE.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, made = None, None, []
        for batch in batches:
            for conv, part, seq, ways, head, last, illegal, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if chain is not None:
                        made += chain.chosen()
                    now, chain = (conv,), _Chain()
                chain.add(part, seq, ways, head, last, illegal, counts)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if chain is not None:
            yield pa.RecordBatch.from_pylist(list(chain.chosen()), schema)

    return rows.mapInArrow(run, _CHOICE)


_PIECE = "part int, seq bigint, audit string, roles array<string>, texts array<string>, cost bigint, illegal bigint, blank bigint, duplicate bigint, truncated bigint"


def repaired(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, part, seq, audit, roles, texts, cost, illegal, blank, duplicate, truncated): repaired rows in pieces.

    ``rows`` are (conv_id, turn, role, text, copies) without null roles and texts.  A conversation's pieces in the order
    of (part, seq) are its repair; totals stand in its last piece.  Rows of one turn go by role, then text; a null
    turn comes first, and rows without an id are one conversation.  Other columns are not looked at.
    """
    segments = cut(_segments(_ordered(rows), segment_rows))
    ways = segments.select("conv_id", "part", "seq", "roles", "texts", "ways")
    chosen = _chosen(segments).withColumnsRenamed({"part": "of_part", "seq": "of_seq"})
    met = ways.join(chosen, (F.col("part") == F.col("of_part")) & (F.col("seq") == F.col("of_seq")))
    edits = F.element_at(F.filter("ways", lambda w: (w["enter"] == F.col("enter")) & (w["leave"] == F.col("leave"))), 1)["edits"]
    met = met.select(
        "conv_id", "part", "seq", F.concat(edits, "tail").alias("audit"), "enter", "roles", "texts",
        "cost", "illegal", "blank", "duplicate", "truncated",
    )
    spark_schema = T.StructType([segments.schema["conv_id"], *T._parse_datatype_string(_PIECE).fields])
    schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for x in out:
                fixed = apply_edits(x["audit"], x.pop("enter"), list(zip(x["roles"], x["texts"], strict=True)))
                x["roles"], x["texts"] = [r for r, _ in fixed], [t for _, t in fixed]
            yield pa.RecordBatch.from_pylist(out, schema)

    return met.mapInArrow(run, spark_schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """One row per conversation: totals, the whole audit and the digest of the repaired rows, streamed in order."""
    totals = [BLANK, DUPLICATE, BROKEN, "illegal", "cost"]
    kinds = ", ".join(f"{c} bigint" for c in totals)
    spark_schema = T.StructType([pieces.schema["conv_id"], *T._parse_datatype_string(f"{kinds}, audit string, repaired_sha256 string").fields])
    schema = to_arrow_schema(spark_schema)
    line = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat_ws(":", x["roles"], x["texts"])), "\n")
    rows = pieces.select("conv_id", "part", "seq", *totals, "audit", F.size("roles").alias("n"), line.alias("lines"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, audit, digest, empty, made = None, [], [], None, True, []

        def close() -> dict:
            return {"conv_id": now[0], **dict(zip(totals, sums, strict=True)), "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            for conv, _, _, *own, edits, n, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        made.append(close())
                    now, sums, audit, digest, empty = (conv,), [0] * len(totals), [], hashlib.sha256(), True
                sums = [x + y for x, y in zip(sums, own, strict=True)]
                audit.append(edits)
                if n:
                    digest.update(("" if empty else "\n").encode() + lines.encode())
                    empty = False
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([close()], schema)

    return rows.mapInArrow(run, spark_schema)


def repair_report(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each original conversation.

    The rows are damaged first (see ``damaged``) and then repaired (see ``repaired``).  A conversation that lost all
    its rows has zeros, an empty audit and the digest of the empty text.  Rows without an id are one conversation; no
    rows give no rows.
    """
    rows = damaged(conversations)
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
    )
    found = _joined(repaired(rows, segment_rows)).withColumnRenamed("conv_id", "of_conv")
    ids = conversations.select("conv_id").distinct()
    turns = turns.withColumnRenamed("conv_id", "in_conv")
    out = ids.join(turns, same(F.col("conv_id"), F.col("in_conv")), "left").join(found, same(F.col("conv_id"), F.col("of_conv")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", BLANK, DUPLICATE, BROKEN, "illegal", "cost")]
    return out.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
