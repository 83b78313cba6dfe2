"""Repair of conversations by bidirectional Dijkstra over the edit lattice.

A conversation's rows, in order of turn, are the steps of a lattice whose other
axis is the state of the wanted pattern ``(s?(ua)+)?`` of role initials.  Keep
costs 0, Rerole 1, Delete 2, Insert 5, and a truncated row that is not deleted
5 more; blank and duplicate rows must be deleted.  A forward and a reverse heap
of costs meet; all crossings of the least cost are finished, and of all
cheapest edits the one with the ASCII-least audit is walked out.

Rows lie in range partitions by conversation and turn, so a conversation that
holds a third of the table spreads over tasks.  A task cuts what it reads into
segments of bounded size.  A conversation that lies whole in a segment is
settled there.  Of any other, a segment gives the least costs between entry and
exit states (4 x 4) and the order of the audits; these few numbers are chained
per conversation, and each segment is then solved between the states so found.
Only the digest of the repaired text, which no machine can take in parts, is
made by one task for each conversation: it streams the segments in order.

Nulls count as one space (a null conversation is one of its own; a null turn
comes first and counts in no gap); rows of one turn are in order of role, then
of their digest; rows that repeat in all columns are counted once and expanded
in the segment; empty texts are blank; texts of any length are taken whole;
other columns are ignored; an empty table gives no rows.  A conversation whose
rows are all dropped has zeros, an empty audit and the digest of the empty
string.  All steps read written tables or shuffles, so lost executors cost a
step at most.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.session import materialize

#: A segment has at most so many rows, and ends after so many characters.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 2 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Words are parted by these: blank texts have no other character.
SPACES = " \t\n\x0b\x0c\r"
OTHER, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Flags of a row's code beside its role.
MUST_GO, CUT = 4, 8
# States: nothing yet, after the system row, after a user row, after an assistant row.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STEP = {(START, SYSTEM): AFTER_SYSTEM, (START, USER): AFTER_USER, (AFTER_SYSTEM, USER): AFTER_USER,
        (AFTER_USER, ASSISTANT): AFTER_ASSISTANT, (AFTER_ASSISTANT, USER): AFTER_USER}
#: Where a rerole or an insert leads: the role that the state asks for.
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ENDS = (START, AFTER_ASSISTANT)
#: (cost, audit) of what ends a conversation that a state leaves open.
TAIL = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def edges(codes: bytes, i: int, state: int, trailing: bool):
    """(letter, cost, row, state) of the edits from a place in the lattice, in
    ASCII order.  Inserts after the last row only where ``trailing``."""
    n = len(codes)
    if i < n:
        yield "D", DELETE, i + 1, state
    if i < n or trailing:
        yield "I", INSERT, i, NEXT[state]
    if i < n and not codes[i] & MUST_GO:
        extra = TRUNCATED if codes[i] & CUT else 0
        to = STEP.get((state, codes[i] & 3))
        if to is not None:
            yield "K", KEEP + extra, i + 1, to
        yield "R", REROLE + extra, i + 1, NEXT[state]


def reverse_edges(codes: bytes, i: int, state: int, trailing: bool):
    """(cost, row, state) of the places from which an edit leads here."""
    if i:
        yield DELETE, i - 1, state
    if i < len(codes) or trailing:
        for s in range(4):
            if NEXT[s] == state:
                yield INSERT, i, s
    if i and not codes[i - 1] & MUST_GO:
        extra, role = (TRUNCATED if codes[i - 1] & CUT else 0), codes[i - 1] & 3
        for s in range(4):
            if STEP.get((s, role)) == state:
                yield KEEP + extra, i - 1, s
            if NEXT[s] == state:
                yield REROLE + extra, i - 1, s


def solve(codes: bytes, entry: int = START, exits: tuple = ENDS, trailing: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of the rows from the state ``entry``
    to one of ``exits``, the ASCII-least of equal ones; None where no edits
    lead there."""
    n = len(codes)
    ahead, behind = {}, {}                  # settled costs of both searches
    forward, reverse = [(0, 0, entry)], [(0, n, e) for e in exits]
    reach = {(0, entry): 0}, {(n, e): 0 for e in exits}
    best = 0 if not n and entry in exits else None
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        if forward[0][0] <= reverse[0][0]:
            cost, i, s = heapq.heappop(forward)
            if (i, s) in ahead:
                continue
            ahead[i, s] = cost
            for _, c, j, t in edges(codes, i, s, trailing):
                if cost + c < reach[0].get((j, t), 1 << 60):
                    reach[0][j, t] = cost + c
                    heapq.heappush(forward, (cost + c, j, t))
                if (j, t) in reach[1] and (best is None or cost + c + reach[1][j, t] < best):
                    best = cost + c + reach[1][j, t]
        else:
            cost, i, s = heapq.heappop(reverse)
            if (i, s) in behind:
                continue
            behind[i, s] = cost
            for c, j, t in reverse_edges(codes, i, s, trailing):
                if cost + c < reach[1].get((j, t), 1 << 60):
                    reach[1][j, t] = cost + c
                    heapq.heappush(reverse, (cost + c, j, t))
                if (j, t) in reach[0] and (best is None or cost + c + reach[0][j, t] < best):
                    best = cost + c + reach[0][j, t]
    if best is None:
        return None
    # crossings: settled ahead, and the next place settled behind at the least cost
    rest = behind | {(n, e): 0 for e in exits}
    good = [v for v, c in ahead.items() if c + rest.get(v, 1 << 60) == best or any(
        c + k + rest.get((j, t), 1 << 60) == best for _, k, j, t in edges(codes, *v, trailing))]
    on_path = set(good)
    while good:
        v = good.pop()
        for c, j, t in reverse_edges(codes, *v, trailing):
            if (j, t) not in on_path and ahead.get((j, t), 1 << 60) + c == ahead[v]:
                on_path.add((j, t))
                good.append((j, t))
    audit, at, spent = [], (0, entry), 0
    while spent < best or at[0] < n:
        for letter, c, j, t in edges(codes, *at, trailing):
            left = rest.get((j, t))
            if (left is not None and spent + c + left == best) or ((j, t) in on_path and ahead[j, t] == spent + c):
                audit.append(letter)
                at, spent = (j, t), spent + c
                break
    return best, "".join(audit)


def apply_edits(audit: str, rows: list[tuple[str, str]], entry: int = START) -> list[str]:
    """``role:text`` lines that an audit makes of the rows."""
    out, i, state = [], 0, entry
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            role, text = rows[i]
            to = STEP[state, INITIAL.get(role[:1], OTHER)]
        else:
            to = NEXT[state]
            role, text = "user" if to == AFTER_USER else "assistant", rows[i][1] if edit == "R" else ""
        out.append(f"{role}:{text}")
        i, state = i + (edit != "I"), to
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Distinct rows after damage with the number of their copies (0: dropped)
    and their faults."""
    def space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    return rows.select("*", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("key"),
                       (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))


def with_first(rows: DataFrame) -> DataFrame:
    """Whether a row is the first of its conversation with its role and text.
    The earliest turns are aggregated and joined back by turn too, so a text
    that fills a long conversation is no hot key."""
    kept = rows.where("copies > 0")
    earliest = kept.groupBy("conv_id", "key").agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"))
    earliest = earliest.select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"),
                               F.when(~F.col("none"), F.col("least")).alias("_turn"), F.lit(True).alias("first"))
    same = (F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key"))
            & F.col("turn").eqNullSafe(F.col("_turn")))
    return rows.join(earliest, same, "left").drop("_conv", "_key", "_turn").fillna(False, ["first"])


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string, n_rows long")
#: What a segment says of its rows; the chain needs no more than this.
BRIEF = ("conv_id long, part long, no long, whole boolean, n_rows long, first_turn long, last_turn long, least_turn long, "
         "turns long, first_role int, last_role int, blank long, duplicate long, truncated long, illegal long, "
         "costs array<long>, ranks array<int>")
SEGMENT = BRIEF + ", codes binary, roles array<string>, texts array<string>, cost long, audit string, repaired_sha256 string"
ROUTE = ("part long, no long, entry int, leave int, tail string, gaps long, blank long, duplicate long, truncated long, "
         "illegal long, cost long, n_rows long")
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
         "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, KINDS[k]) for n, k in (c.split() for c in schema.split(", "))])


class Segment:
    """Consecutive rows of one conversation."""

    def __init__(self, no: int = 0):
        self.no, self.codes, self.rows, self.chars = no, bytearray(), [], 0
        self.first = self.last = self.least = None      # turns; the least one leaves nulls out
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0]                         # blank, duplicate, truncated

    def full(self) -> bool:
        return len(self.codes) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def add(self, turn: int | None, role: str, text: str, fault: int | None) -> None:
        code = INITIAL.get(role[:1], OTHER)
        if self.codes:
            self.illegal += (self.codes[-1] & 3, code) not in LEGAL
        else:
            self.first = turn
        if turn is not None and (not self.codes or turn != self.last):
            self.turns += 1
            self.least = turn if self.least is None else self.least
        self.last = turn
        if fault is not None:
            self.faults[fault] += 1
            code |= CUT if fault == 2 else MUST_GO
        self.codes.append(code)
        self.rows.append((role, text))
        self.chars += len(text)

    def record(self, conv: int | None, part: int, whole: bool) -> dict:
        codes = bytes(self.codes)
        out = {"conv_id": conv, "part": part, "no": self.no, "whole": whole, "n_rows": len(codes), "first_turn": self.first,
               "last_turn": self.last, "least_turn": self.least, "turns": self.turns, "illegal": self.illegal,
               "first_role": codes[0] & 3 if codes else None, "last_role": codes[-1] & 3 if codes else None,
               "blank": self.faults[0], "duplicate": self.faults[1], "truncated": self.faults[2]}
        if whole:
            cost, audit = solve(codes)
            lines = "\n".join(apply_edits(audit, self.rows))
            return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}
        costs, ranks = [], []
        for s in range(4):      # an insert after the last row belongs before the next segment's first one
            found = [solve(codes, s, (t,), trailing=False) for t in range(4)]
            order = sorted({f[1] for f in found if f})
            costs += [f[0] if f else None for f in found]
            ranks += [order.index(f[1]) if f else None for f in found]
        return out | {"costs": costs, "ranks": ranks, "codes": codes, "roles": [r for r, _ in self.rows],
                      "texts": [t for _, t in self.rows]}


def segments(rows: DataFrame) -> DataFrame:
    """Segments of all conversations.  A conversation of one segment that lies
    between others in its partition is settled; the first and the last of a
    partition may go on in its neighbours."""
    schema = arrow(SEGMENT)

    def run(batches):
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        conv, now, alone, first_conv = None, None, True, True

        def write():
            batch = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return batch

        for batch in batches:
            for c, turn, role, text, copies, blank, cut, first in zip(*(x.to_pylist() for x in batch.columns)):
                if now is None or c != conv:
                    if now is not None:
                        out.append(now.record(conv, part, whole=alone and not first_conv))
                        first_conv = False
                    conv, now, alone = c, Segment(now.no + 1 if now is not None else 0), True
                for k in range(copies):
                    if now.full():
                        out.append(now.record(conv, part, whole=False))
                        now, alone = Segment(now.no + 1), False
                        yield write()
                    now.add(turn, role, text, 0 if blank else 1 if k or not first else 2 if cut else None)
            if out:
                yield write()
        if now is not None:
            out.append(now.record(conv, part, whole=False))
            yield write()

    order = ["conv_id", "turn", "role", "key"]
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv_id", "turn", "role", "text", "copies", "blank", "cut", "first").mapInArrow(run, SEGMENT))


def chain(parts: pa.Table) -> pa.Table:
    """Entry and exit state of every segment of one conversation, and (on its
    first segment) the conversation's figures."""
    rows = sorted(parts.to_pylist(), key=lambda r: (r["part"], r["no"]))
    left = [list(map(lambda t: t[0], TAIL))]        # least cost to the end from each state, last segment first
    for r in reversed(rows):
        left.append([min((r["costs"][4 * s + t] + left[-1][t] for t in range(4) if r["costs"][4 * s + t] is not None),
                         default=1 << 60) for s in range(4)])
    left.reverse()
    state, out = START, []
    for k, r in enumerate(rows):
        ways = [(r["costs"][4 * state + t] + left[k + 1][t], r["ranks"][4 * state + t], t)
                for t in range(4) if r["costs"][4 * state + t] is not None]
        leave = min(ways)[2]
        out.append({"part": r["part"], "no": r["no"], "entry": state, "leave": leave, "tail": "", "cost": 0}
                   | {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "n_rows")})
        state = leave
    first, last = out[0], out[-1]
    last["tail"] = TAIL[state][1]
    first["cost"] = left[0][START]
    filled = [r for r in rows if r["n_rows"]]
    for c in ("blank", "duplicate", "truncated", "illegal", "n_rows"):
        first[c] = sum(r[c] for r in rows)
    turns = sum(r["turns"] for r in filled)
    for r, s in zip(filled, filled[1:]):
        first["illegal"] += (r["last_role"], s["first_role"]) not in LEGAL
        turns -= s["first_turn"] is not None and r["last_turn"] == s["first_turn"]
    known = [r for r in filled if r["least_turn"] is not None]
    first["gaps"] = known[-1]["last_turn"] - known[0]["least_turn"] + 1 - turns if known else 0
    return pa.Table.from_pylist(out, arrow(ROUTE))


PIECE = "conv_id long, " + ROUTE.replace("entry int, leave int, tail string, ", "") + ", audit string, lines string, kept long"


def pieces(routed: DataFrame) -> DataFrame:
    """Audit and repaired lines of each segment between its states."""
    schema = arrow(PIECE)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                _, audit = solve(r["codes"], r["entry"], (r["leave"],), trailing=False)
                audit += r["tail"]
                lines = apply_edits(audit, list(zip(r["roles"], r["texts"])), r["entry"])
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} | {
                    "audit": audit, "lines": "\n".join(lines), "kept": len(lines)}], schema)

    return routed.mapInArrow(run, PIECE)


def joined(parts: DataFrame) -> DataFrame:
    """One row per conversation from its pieces, which a task streams in
    order: it holds one piece, a digest and the audit."""
    schema = arrow(RESULT)
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_rows")

    def run(batches):
        conv, now, audit, sha, lines = None, None, [], None, 0

        def row():
            return pa.RecordBatch.from_pylist([now | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != conv:
                    if now is not None:
                        yield row()
                    conv, audit, sha, lines = r["conv_id"], [], hashlib.sha256(), 0
                    now = {"conv_id": conv} | {f: r[f] for f in figures}
                audit.append(r["audit"])
                if r["kept"]:
                    sha.update((b"\n" if lines else b"") + r["lines"].encode())
                    lines += r["kept"]
        if now is not None:
            yield row()

    return (parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(run, RESULT))


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: faults after damage, least cost, audit and the
    digest of the repaired rows."""
    found = materialize(segments(with_first(damaged(conversations))), "segments")
    settled = found.where("whole").withColumn(
        "gaps", F.coalesce(F.col("last_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0)))
    brief = [c.split()[0] for c in BRIEF.split(", ")]
    open_ = found.where("NOT whole")
    routes = open_.select(*brief).groupBy("conv_id").applyInArrow(chain, ROUTE)
    routed = open_.select("conv_id", "part", "no", "codes", "roles", "texts").join(routes, ["part", "no"])
    names = [c.split()[0] for c in RESULT.split(", ")]
    return settled.select(*names).unionByName(joined(pieces(routed)).select(*names))
