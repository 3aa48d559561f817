"""Conversation structure repair: cheapest edits to a legal order of roles, by Four-Russians tables over blocks of rows.

A conversation is a sequence of symbols (role initial, truncated or not, or a row that must go). Read from its end, each symbol turns the
vector of the costs that are still to come, one for each state of the role grammar, into another; less their minimum there are few
such vectors. A table has, for each vector and each block of symbols, the vector before the block and what it costs, so a block is one
lookup. The edits are traced from the start, where the least of all equally cheap edits can be told; for that a block is expanded
backward from the vector behind it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bookloom.session import cut_lineage

#: symbols of a block
LENGTH = 4
#: rows and bytes of text of one segment; longer conversations are cut into several
ROWS, BYTES = 4096, 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS, ENDS = " \t\n\x0b\f\r", ".!?"
#: states: nothing yet, behind a system row, behind a user row, behind an assistant row; the first and the last may end
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: state behind a row of this initial, by state and initial (s, u, a)
NEXT = ((SYSTEM, USER, None), (None, USER, None), (None, None, ASSISTANT), (None, USER, None))
#: the role that may be put in at a state, for a row or instead of a row's role
FITTING = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
#: what is to be put in behind the last row
CLOSING = ("", "II", "I", "")
#: symbols: 2 * (s, u, a, other) + truncated, and a row that must go
GONE = 8
SYMBOLS = 9


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state behind) of each edit that uses up a row."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        initial, late = symbol >> 1, TRUNCATED * (symbol & 1)
        if initial < 3 and NEXT[state][initial] is not None:
            out.append(("K", late, NEXT[state][initial]))
        out.append(("R", REROLE + late, AFTER[state]))
    return out


def _before(symbol: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from before a symbol on, from those behind it; rows may be put in before the symbol."""
    cost = [min(c + behind[s] for _, c, s in _choices(symbol, q)) for q in range(STATES)]
    for _ in range(STATES):
        cost = [min(c, INSERT + cost[AFTER[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


class Tables:
    """All cost vectors (less their minimum) that symbols lead to, and the transitions for single symbols and for blocks."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        number = {(0, 6, 3, 0): 0}  # behind the last row
        self.vectors = list(number)
        step, cost = [], []
        for v in self.vectors:
            step.append([])
            cost.append([])
            for symbol in range(SYMBOLS):
                before = _before(symbol, v)
                low = min(before)
                less = tuple(c - low for c in before)
                if less not in number:
                    number[less] = len(self.vectors)
                    self.vectors.append(less)
                step[-1].append(number[less])
                cost[-1].append(low)
        self.step, self.cost = np.array(step), np.array(cost)
        self.block, self.block_cost = self.step, self.cost
        for _ in range(length - 1):  # one symbol more in front
            self.block, self.block_cost = (
                self.step[self.block].transpose(0, 2, 1).reshape(len(step), -1),
                (self.block_cost[:, :, None] + self.cost[self.block]).transpose(0, 2, 1).reshape(len(step), -1))

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the blocks; the symbols before the first whole block are not in them."""
        whole = symbols[len(symbols) % self.length:].reshape(-1, self.length).astype(np.int64)
        return whole @ SYMBOLS ** np.arange(self.length - 1, -1, -1)

    def through(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector behind the symbols, the vector before them and the cost between."""
        at, total = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for code in self.codes(symbols)[::-1]:
            total += self.block_cost[at, code]
            at = self.block[at, code]
        for s in symbols[:len(symbols) % self.length][::-1]:
            total += self.cost[at, s]
            at = self.step[at, s]
        return at, total

    @functools.lru_cache(maxsize=1 << 18)  # noqa: B019 - the tables live as long as the process
    def traced(self, symbols: bytes, behind: int, state: int) -> tuple[str, int]:
        """The edits of a few symbols from a state on, least in ASCII order among the cheapest, one piece per row, and the state behind."""
        vectors = [self.vectors[behind]]
        for s in reversed(symbols):
            vectors.append(_before(s, vectors[-1]))
        vectors.reverse()
        out = ""
        for i, symbol in enumerate(symbols):
            while True:
                least = vectors[i][state]
                ways = [(e, c + vectors[i + 1][s], s) for e, c, s in _choices(symbol, state)]
                ways.append(("I", INSERT + vectors[i][AFTER[state]], AFTER[state]))
                edit, _, state = min(w for w in ways if w[1] == least)
                out += edit
                if edit != "I":
                    break
        return out, state

    def trace(self, symbols: np.ndarray, behind: int, state: int) -> tuple[str, int]:
        """The edits of a segment and the state behind it. Vectors between blocks come from the table, those inside from expanding it."""
        codes = self.codes(symbols)
        at = [behind]
        for code in codes[::-1]:
            at.append(int(self.block[at[-1], code]))
        at.reverse()
        raw, odd = symbols.astype(np.uint8).tobytes(), len(symbols) % self.length
        out, state = self.traced(raw[:odd], at[0], state)
        edits = [out]
        for k in range(len(codes)):
            piece = raw[odd + k * self.length:odd + (k + 1) * self.length]
            out, state = self.traced(piece, at[k + 1], state)
            edits.append(out)
        return "".join(edits), state


@functools.cache
def tables() -> Tables:
    return Tables()


def repaired(edits: str, roles: list[str], texts: list[str], copies: list[int], state: int) -> tuple[str, list[str]]:
    """The edits with those of further copies of a row, and the lines that are left."""
    out, lines, i = [], [], 0
    for e in edits:
        out.append(e)
        if e == "I":
            lines.append(f"{FITTING[state]}:")
            state = AFTER[state]
            continue
        if e == "K":
            lines.append(f"{roles[i]}:{texts[i]}")
            state = NEXT[state]["sua".index(roles[i][0])]
        elif e == "R":
            lines.append(f"{FITTING[state]}:{texts[i]}")
            state = AFTER[state]
        out.append("D" * (copies[i] - 1))
        i += 1
    return "".join(out), lines


@dataclass
class Segment:
    """Rows of one conversation in order, in one partition."""
    name: object
    part: int
    number: int
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    symbols: list[int] = field(default_factory=list)
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    size: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, symbol: int, first: bool) -> None:
        blank = symbol == GONE
        truncated = not blank and first and symbol & 1
        self.faults[0] += copies if blank else 0
        self.faults[1] += 0 if blank else copies - int(first)
        self.faults[2] += truncated
        self.faults[3] += copies - 1 + int(bool(self.roles) and not legal(self.roles[-1][:1], role[:1]))
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.symbols.append(symbol if first else GONE)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.roles) >= ROWS or self.size >= BYTES

    def row(self, whole: bool) -> tuple:
        """A row of _SEGMENTS: the solution where the conversation is whole, else what its solution needs."""
        t, symbols = tables(), np.array(self.symbols, np.int64)
        further = DELETE * (sum(self.copies) - len(self.copies))
        at, cost = t.through(symbols)
        ends = (self.roles[0][:1], self.roles[-1][:1])
        common = (self.name, self.part, self.number, whole, *self.faults, self.first_turn, self.last_turn, self.turns, *ends)
        if not whole:
            return (*common, at.tolist(), (cost + further).tolist(), bytes(self.symbols), self.roles, self.texts, self.copies, None, None, None)
        edits, state = t.trace(symbols, 0, START)
        audit, lines = repaired(edits + CLOSING[state], self.roles, self.texts, self.copies, START)
        total = int(cost[0]) + t.vectors[at[0]][START] + further
        return (*common, None, None, None, None, None, None, total, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


_FAULTS = "blank long, duplicate long, truncated long, illegal long"
_SEGMENTS = ("part int, number int, whole boolean, " + _FAULTS + ", first_turn long, last_turn long, turns long, first_role string, "
             "last_role string, at array<int>, to_pay array<long>, symbols binary, roles array<string>, texts array<string>, "
             "copies array<long>, cost long, audit string, repaired_sha256 string")


def _schema(kind: str, ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(f"conv_id {kind}, {ddl}")


def _batch(schema, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _symbol(role: Column, text: Column) -> Column:
    """2 * (s, u, a, other) + truncated, or that the row is blank. A role without letters has no initial and is other."""
    shown = F.rtrim(text, F.lit(BLANKS))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in zip("sua", range(3), strict=True) for x in p]), F.substring(role, 1, 1)), F.lit(3))
    late = F.when(F.instr(F.lit(ENDS), F.right(shown, F.lit(1))) > 0, 0).otherwise(1)
    return F.when(shown == "", GONE).otherwise(2 * kind + late).cast("int")


def _segments(rows: DataFrame, kind: str) -> DataFrame:
    """Segments of the rows (conv_id, turn, role, text, copies). Conversations that lie inside a partition, in one segment, are solved here.

    Where a conversation first says something is known from a table of firsts, whose rows are sorted before the rows they mark; so
    no text is compared with all earlier ones, and a conversation may be spread over any number of partitions.
    """
    mark = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t")) \
        .select("conv_id", "t.turn", "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    line = rows.unionByName(mark).repartitionByRange(*order).sortWithinPartitions(*order, "copies") \
        .select("conv_id", "turn", "role", "text", "copies", F.when(F.col("copies") > 0, _symbol(F.col("role"), F.col("text"))).alias("symbol"),
                F.spark_partition_id().alias("part"))
    schema = _schema(kind, _SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Segment | None = None
        number, marked, inner, ready = 0, False, False, []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for name, turn, role, text, copies, symbol, part in zip(*columns, strict=True):
                if not copies:
                    marked = True
                    continue
                if now is not None and (now.name != name or now.full()):
                    # a first conversation may have begun in an earlier partition
                    same = now.name == name
                    ready.append(now.row(inner and not same))
                    inner = not same
                    number += 1
                    now = None
                    if len(ready) >= 256 or not ready[-1][3]:
                        yield _batch(schema, ready)
                        ready = []
                if now is None:
                    now = Segment(name, part, number)
                now.add(turn, role, text, copies, symbol, marked)
                marked = False
        if now is not None:
            ready.append(now.row(False))  # it may go on in the next partition
        yield _batch(schema, ready)

    return line.mapInArrow(run, schema)


def _chained(cut: DataFrame, kind: str) -> DataFrame:
    """(part, number, behind, pay): for each segment, the cost vector behind it and the cost of all that is behind it, by composing the
    segments' transitions from a conversation's last one on. A row of numbers per segment passes through."""
    schema = _schema(kind, "part int, number int, behind int, pay long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, pay, begun = None, 0, 0, False
        for b in batches:
            out = []
            for name, part, number, to, cost in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if not begun or name != here:
                    here, at, pay, begun = name, 0, 0, True
                out.append((name, part, number, at, pay))
                at, pay = to[at], pay + cost[at]
            yield _batch(schema, out)

    line = cut.select("conv_id", "part", "number", "at", "to_pay").repartition("conv_id") \
        .sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    return line.mapInArrow(run, schema)


def _exits(cut: DataFrame, behind: DataFrame, kind: str) -> DataFrame:
    """Adds, for each state before a segment, the state behind it."""
    schema = _schema(kind, "part int, number int, behind int, pay long, exits array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, part, number, v, pay, symbols in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                s = np.frombuffer(symbols, np.uint8)
                out.append((name, part, number, v, pay, [tables().trace(s, v, q)[1] for q in range(STATES)]))
            yield _batch(schema, out)

    return behind.join(cut.select("part", "number", "symbols"), ["part", "number"]) \
        .select("conv_id", "part", "number", "behind", "pay", "symbols").mapInArrow(run, schema)


def _entered(exits: DataFrame, kind: str) -> DataFrame:
    """(part, number, behind, pay, state, last): the state before each segment."""
    schema = _schema(kind, "part int, number int, behind int, pay long, state int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, begun = None, START, False
        for b in batches:
            out = []
            for name, part, number, v, pay, to in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if not begun or name != here:
                    here, state, begun = name, START, True
                out.append((name, part, number, v, pay, state))
                state = to[state]
            yield _batch(schema, out)

    return exits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(run, schema)


def _pieces(cut: DataFrame, entered: DataFrame, kind: str) -> DataFrame:
    """The segments with their edits, the state behind them and their lines."""
    common = "part int, number int, " + _FAULTS + ", first_turn long, last_turn long, turns long, first_role string, last_role string"
    schema = _schema(kind, common + ", cost long, edits string, exit int, lines string")
    known = ["blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", "first_role", "last_role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *common, v, pay, state, to, cost, symbols, roles, texts, copies in zip(
                    *[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
                edits, leave = tables().trace(np.frombuffer(symbols, np.uint8), v, state)
                edits, lines = repaired(edits, roles, texts, copies, state)
                total = pay + cost[v] + tables().vectors[to[v]][START]
                yield _batch(schema, [(*common, total, edits, leave, "\n".join(lines) if lines else None)])

    on = entered.select(F.col("part").alias("_p"), F.col("number").alias("_n"), "behind", "pay", "state")
    return cut.join(on, (F.col("part") == F.col("_p")) & (F.col("number") == F.col("_n"))) \
        .select("conv_id", "part", "number", *known, "behind", "pay", "state", "at", "to_pay", "symbols", "roles", "texts", "copies") \
        .mapInArrow(run, schema)


_RESULT = "gaps long, " + _FAULTS + ", cost long, audit string, repaired_sha256 string"


def _joined(pieces: DataFrame, kind: str) -> DataFrame:
    """One row per conversation of several segments. Its segments pass in order; a digest and sums are what is kept of them."""
    schema = _schema(kind, _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, []

        def end() -> None:
            for role in CLOSING[now["exit"]]:
                now["audit"].append(role)
                put(f"{FITTING[now['exit']]}:")
                now["exit"] = AFTER[now["exit"]]
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            ready.append((now["name"], gaps, *now["faults"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))

        def put(lines: str) -> None:
            now["sha"].update(("\n" * now["some"] + lines).encode())
            now["some"] = 1

        for b in batches:
            for name, _, _, *faults, first, last, turns, head, tail, cost, edits, leave, lines in zip(
                    *[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
                if now is None or now["name"] != name:
                    if now is not None:
                        end()
                    now = {"name": name, "faults": [0] * 4, "low": None, "high": None, "turns": 0, "tail": None, "cost": cost, "audit": [],
                           "sha": hashlib.sha256(), "some": 0, "exit": START}
                else:
                    now["faults"][3] += not legal(now["tail"], head)
                now["faults"] = [x + y for x, y in zip(now["faults"], faults, strict=True)]
                if first is not None:
                    now["turns"] += turns - (first == now["high"])
                    now["low"], now["high"] = first if now["low"] is None else now["low"], last
                now["tail"], now["exit"] = tail, leave
                now["audit"].append(edits)
                if lines is not None:
                    put(lines)
            yield _batch(schema, ready)
            ready = []
        if now is not None:
            end()
        yield _batch(schema, ready)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows left after the damage that the CRC-32 of `conv_id:turn` deals out (nulls as one space)."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(text[0], F.lit(":"), text[1])) % 20
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(text[2]).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.translate(text[3], ENDS, "")).otherwise(text[3]).alias("text"),
                                F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"), kind.alias("_k")) \
        .where("_k <> 0").drop("_k")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of the rows (conv_id, turn,
    role, text, copies: how often the row is there).

    A conversation's rows are taken by turn, nulls first; rows of one turn by role and digest of the text. A row is blank, or repeats the role and text
    of an earlier row, or is truncated (its last character but blanks is none of `.!?`). Edits keep a row, give it the role that fits,
    delete it (blank and repeated rows always) or put in an empty row, so that the roles are an optional system row and pairs of
    user and assistant, or nothing. audit has the edits of the cheapest way (K, R, D, I), the least in ASCII order among equals.

    Rows are range-partitioned by (conversation, turn), so that a conversation of any size is spread over partitions and cut into segments
    of at most ROWS rows or about BYTES of text. A segment's costs are transitions between few cost vectors, found by block lookups; the
    transitions of a conversation's segments are composed, and each segment is then traced on its own. Equal rows are counted, not listed.

    A null role or text is one space, so the former fits nowhere and the latter is blank; a role counts by its first character, an
    empty one fits nowhere. Rows without conv_id are one conversation (null). A turn without value comes first and is in no gap. Texts may be of any
    length, a row is never cut. Extra columns are not looked at; an empty table gives none.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    blank = F.lit(" ")
    once = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), "copies") \
        .withColumn("digest", F.md5("text")).groupBy("conv_id", "turn", "role", "digest") \
        .agg(F.min("text").alias("text"), F.sum("copies").alias("copies"))
    segments = cut_lineage(_segments(cut_lineage(once), kind))
    result = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done = segments.where("whole").withColumn("gaps", F.expr("coalesce(last_turn - first_turn + 1 - turns, 0L)")).select(result)
    cut = segments.where("not whole")
    behind = cut_lineage(_chained(cut, kind))
    entered = _entered(cut_lineage(_exits(cut, behind, kind)), kind)
    return done.union(_joined(_pieces(cut, cut_lineage(entered), kind), kind).select(result))


def op13_conversation_repair(spark, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = cut_lineage(repair(damaged(conversations)))
    gone = conversations.select("conv_id").distinct().join(found.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    none = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.unionByName(gone.select("conv_id", *none, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
k AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x
  FROM conversations),
h AS (
  SELECT k.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT),
                  lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 20 AS d FROM k, crc),
g AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE r END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM g),
f AS (
  SELECT *, left(role, 1) AS a, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- the cheapest way so far to each state (1 nothing, 2 s, 3 u, 4 a): cost, edits, lines; first rows put in before any row
p AS (
  SELECT conv_id, 0::BIGINT AS i, [{'c': 0::BIGINT, 'e': '', 'l': ''}, {'c': 1000000000::BIGINT, 'e': '', 'l': ''},
    {'c': 3::BIGINT, 'e': 'I', 'l': 'user:'}, {'c': 6::BIGINT, 'e': 'II', 'l': 'user:' || chr(10) || 'assistant:'}] AS w FROM n
  UNION ALL
  SELECT conv_id, i, [w[1], w[2], list_min([w[3], struct_pack(c := w[4].c + 3, e := w[4].e || 'I', l := w[4].l || chr(10) || 'user:')]),
                      list_min([w[4], struct_pack(c := w[3].c + 3, e := w[3].e || 'I', l := w[3].l || chr(10) || 'assistant:')])] AS w
  FROM (
    SELECT conv_id, i, [w[1], w[2], list_min([w[3], struct_pack(c := w[1].c + 3, e := w[1].e || 'I', l := w[1].l || 'user:'),
                                      struct_pack(c := w[2].c + 3, e := w[2].e || 'I', l := w[2].l || chr(10) || 'user:')]), w[4]] AS w
    FROM (
      SELECT p.conv_id, f.i, list_transform([1, 2, 3, 4], lambda q: list_min(list_concat(
        [struct_pack(c := w[q].c + 4, e := w[q].e || 'D', l := w[q].l)],
        CASE WHEN fault IN ('blank', 'duplicate') THEN [] ELSE list_transform(
          list_filter([{'b': 1, 'q': 2, 'a': 's', 'r': 0, 'z': ''}, {'b': 1, 'q': 3, 'a': 'u', 'r': 0, 'z': ''}, {'b': 2, 'q': 3, 'a': 'u', 'r': 0, 'z': chr(10)},
                       {'b': 4, 'q': 3, 'a': 'u', 'r': 0, 'z': chr(10)}, {'b': 3, 'q': 4, 'a': 'a', 'r': 0, 'z': chr(10)},
                       {'b': 1, 'q': 3, 'a': 'user', 'r': 3, 'z': ''}, {'b': 2, 'q': 3, 'a': 'user', 'r': 3, 'z': chr(10)},
                       {'b': 4, 'q': 3, 'a': 'user', 'r': 3, 'z': chr(10)}, {'b': 3, 'q': 4, 'a': 'assistant', 'r': 3, 'z': chr(10)}],
                      lambda x: x.q = q AND (x.r = 3 OR x.a = f.a)),
          lambda x: struct_pack(c := w[x.b].c + x.r + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END,
                                e := w[x.b].e || CASE x.r WHEN 3 THEN 'R' ELSE 'K' END,
                                l := w[x.b].l || x.z || CASE x.r WHEN 3 THEN x.a ELSE f.role END || ':' || f.text)) END))) AS w
      FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1))),
e AS (
  SELECT p.conv_id, list_min([w[1], w[4]]) AS z, n.* EXCLUDE (conv_id) FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.c, 0)::BIGINT AS cost,
       coalesce(z.e, '') AS audit, sha256(coalesce(z.l, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
