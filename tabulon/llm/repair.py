"""Conversation structure repair by a lazily determinised weighted automaton.

The cheapest edits (keep, rerole, delete, insert) that turn a conversation's roles into `(s?(ua)+)?` are paths of a small
weighted automaton over four states. Scanned from the last row to the first, the costs to go of all states, less their
least, are one state of a deterministic automaton, which is made when it is first met and kept in a transition table; the
scan is then one table look-up a row and adds up the costs. From the first row on, against the scan, the trace takes at
each row the arc that the costs prove tight, the ASCII-least of them.

Rows are dealt over tasks by ranges of (conversation, order), so a conversation with any share of the rows is scanned by
many tasks: a range that holds the middle of one gives the costs between its boundary states, and the few of these are
composed before the ranges are scanned with their true ends. Only the trace and the digest of a conversation's texts go
through it in order, row by row, as the digest has to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, skew_join, table, unsigned_crc32

#: What an edit costs, and what a row costs more that stays although its text is cut off.
RECOST, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States: nothing yet, after the system row, after a user row, after an assistant row. By state, the role that may come next and where it leads.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: A cost that no path reaches.
FAR = 1 << 40
#: Classes of rows: 0 has to go; else 1 + twice the kind of its role (system, user, assistant, other), plus 1 if it is cut off.
KINDS = ("s", "u", "a", "")
#: Costs to go behind a conversation's last row: inserts lead to an accepting state.
LAST = (0, 2 * INSERT, INSERT, 0)


def moves(state: int, row: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state after) of what may be done with a row of this class, without inserts before it."""
    yield "D", DELETE, state
    if row:
        kind, more = KINDS[(row - 1) // 2], (row - 1) % 2 * CUT_OFF
        role, after = NEXT[state]
        if kind == "s" and state == 0:
            yield "K", more, 1
        elif kind == role[0]:
            yield "K", more, after
        yield "R", RECOST + more, after


def before(row: int, beyond: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row of this class, from those behind it."""
    own = [min(cost + beyond[after] for _, cost, after in moves(state, row)) for state in range(4)]
    for _ in range(2):  # at most two inserts lead to any state that inserts reach
        own = [min(own[state], INSERT + own[NEXT[state][1]]) for state in range(4)]
    return tuple(min(x, FAR) for x in own)


class Scanner:
    """The deterministic automaton, made as far as rows have led: vectors of costs, and where each class leads from each."""

    def __init__(self):
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: list[list[tuple[int, int] | None]] = []

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """(state, what was taken off) of a vector of costs."""
        least = min(costs)
        vector = tuple(x - least if x < FAR else FAR for x in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * (1 + 2 * len(KINDS)))
        return self.number[vector], least

    def step(self, state: int, row: int) -> tuple[int, int]:
        found = self.table[state][row]
        if found is None:
            found = self.table[state][row] = self.state(before(row, self.vectors[state]))
        return found


def trace(state: int, row: int, beyond: tuple[int, ...]) -> tuple[str, list[str], str, int]:
    """(edits, roles of inserts, role given to the row or "", state after) at a row: tight arcs, the ASCII-least of them first."""
    costs, edits, inserted = before(row, beyond), "", []
    while True:
        tight = [("I", "", NEXT[state][1])] if INSERT + costs[NEXT[state][1]] == costs[state] else []
        tight += [(edit, NEXT[state][0] if edit == "R" else "", after) for edit, cost, after in moves(state, row) if cost + beyond[after] == costs[state]]
        edit, role, state = min(tight)
        edits += edit
        if edit != "I":
            return edits, inserted, role, state
        inserted.append("user" if state == 2 else "assistant")


def ending(state: int) -> list[str]:
    """Roles of the inserts behind the last row."""
    out = []
    while LAST[state]:
        out.append(NEXT[state][0])
        state = NEXT[state][1]
    return out


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


#: The order of a conversation's rows.
ORDER = ["turn", "tie"]


def _coded(turns: DataFrame, work: Scratch) -> DataFrame:
    """(conv_id, turn, tie, n, initial, fault, class): the distinct rows without their texts, ready to be ordered.

    n: how often the row is there; all but the first are duplicates. fault: blank, duplicate, truncated or "".
    """
    fine = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    shape = F.when(fine == "", "blank").when(~F.substring(fine, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    named = {"none": F.col("conv_id").isNull(), "id": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))}
    rows = turns.select("conv_id", "turn", _tie().alias("tie"), F.substring("role", 1, 1).alias("initial"), shape.alias("shape"))
    rows = rows.groupBy("conv_id", *ORDER).agg(F.count("*").alias("n"), F.first("initial").alias("initial"), F.first("shape").alias("shape"))
    rows = work.cut("rows", rows.withColumns(named))
    # Role and text of a row are told by its tie, so an earlier row with the same tie makes it a duplicate.
    again = rows.groupBy("none", "id", "tie").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("first")).filter(F.col("n") > 1)
    again = work.cut("again", again)
    met = skew_join(rows, again.select("none", "id", "tie", F.col("first.turn").alias("first"), F.lit(True).alias("again")), ["none", "id", "tie"], "left", counts=again)
    fault = F.when(F.col("shape") == "blank", "blank").when(F.col("again") & ~F.col("turn").eqNullSafe(F.col("first")), "duplicate").otherwise(F.col("shape"))
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.when(fault.isin("blank", "duplicate"), 0).otherwise(1 + 2 * kind + (fault == "truncated").cast("int"))
    return met.select("conv_id", *ORDER, "n", "initial", fault.alias("fault"), code.cast("int").alias("class"))


def _tie() -> Column:
    """Tells roles with texts apart, and orders the rows of one turn."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


def _ranges(batches: Iterator) -> Iterator[tuple[int, list, list, list]]:
    """(part, conversations, classes, ns) of whole ranges, as their rows come."""
    part, convs, classes, ns = None, [], [], []
    for batch in batches:
        for p, c, k, n in zip(*[batch.column(x).to_pylist() for x in ("part", "conv_id", "class", "n")], strict=True):
            if p != part:
                if convs:
                    yield part, convs, classes, ns
                part, convs, classes, ns = p, [], [], []
            convs.append(c)
            classes.append(k)
            ns.append(n)
    if convs:
        yield part, convs, classes, ns


def _scan(scanner: Scanner, state: int, cost: int, row: int, n: int) -> tuple[int, int]:
    """State and cost before n equal rows: all but the first are duplicates, which are deleted and leave the state as it is."""
    after, more = scanner.step(state, row)
    return after, cost + more + (n - 1) * DELETE


def _between(batches: Iterator) -> Iterator:
    """(part, at, conv_id, whole, costs) of the first and the last conversation of each range: costs[4 * s + t] lead from
    state s before its rows to state t behind them. whole: both are one."""
    import pyarrow as pa

    scanner, kind = Scanner(), []

    def typed(batches):
        for batch in batches:
            kind.append(batch.schema.field("conv_id").type)
            yield batch

    for part, convs, classes, ns in _ranges(typed(batches)):
        first = next((i for i, c in enumerate(convs) if c != convs[0]), len(convs))
        last = len(convs) - next((i for i, c in enumerate(reversed(convs)) if c != convs[-1]), len(convs))
        out = []
        for a, b in ((0, first), (last, len(convs))):
            columns = []
            for t in range(4):
                state, cost = scanner.state(tuple(0 if s == t else FAR for s in range(4)))
                for i in range(b - 1, a - 1, -1):
                    state, cost = _scan(scanner, state, cost, classes[i], ns[i])
                columns.append([min(FAR, x + cost) for x in scanner.vectors[state]])
            out.append([columns[t][s] for s in range(4) for t in range(4)])
        arrays = [pa.array([part] * 2, pa.int32()), pa.array(["first", "last"]), pa.array([convs[0], convs[-1]], kind[0]), pa.array([first == len(convs)] * 2), pa.array(out, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "at", "conv_id", "whole", "costs"])


def range_ends(edges: list) -> dict[int, tuple[int, ...]]:
    """Per range, the costs to go behind its last row, from the rows of _between: two for each range."""
    by = {(r.part, r.at): r for r in edges}
    parts = sorted({r.part for r in edges})
    ends, beyond, follows = {}, LAST, None
    for part in reversed(parts):
        first, last = by[part, "first"], by[part, "last"]
        ends[part] = beyond if follows and last.conv_id == follows.conv_id else LAST
        own = ends[part] if first.whole else LAST
        beyond, follows = tuple(min(FAR, *(first.costs[4 * s + t] + own[t] for t in range(4))) for s in range(4)), first
    return ends


def _scanned(coded: DataFrame, work: Scratch) -> DataFrame:
    """coded with `beyond`, the costs to go behind each row, as the scan has them."""
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie")]
    ordered = work.cut("ordered", coded.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    dealt = ordered.repartition("part").sortWithinPartitions("part", *key)
    kind = dict(ordered.dtypes)["conv_id"]
    edges = dealt.select("part", "conv_id", "class", "n").mapInArrow(_between, f"part int, at string, conv_id {kind}, whole boolean, costs array<long>")
    ends = range_ends(edges.collect())  # two rows for each range

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner, part, conv, state, cost = Scanner(), None, None, 0, 0
        for batch in batches:
            beyond = []
            for p, c, k, n in zip(*[batch.column(x).to_pylist() for x in ("part", "conv_id", "class", "n")], strict=True):
                if p != part:
                    state, cost = scanner.state(ends[p])
                elif c != conv:
                    state, cost = scanner.state(LAST)
                part, conv = p, c
                beyond.append([x + cost for x in scanner.vectors[state]])
                state, cost = _scan(scanner, state, cost, k, n)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beyond, pa.list_(pa.int64()))], [*names, "beyond"])

    down = ordered.repartition("part").sortWithinPartitions("part", F.col("conv_id").desc(), F.col("turn").desc_nulls_last(), F.col("tie").desc())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    return work.cut("scanned", down.mapInArrow(run, f"{fields}, beyond array<long>"))


class Trace:
    """Goes through the rows of one conversation in their order, and edits them."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.place, self.digest, self.cost = conv_id, 0, 0, hashlib.sha256(), None
        self.audit, self.counts, self.illegal, self.before = [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, None
        self.low = self.high = self.seen = None
        self.turns = 0

    def _stays(self, edit: str, role: str, text: str, turn) -> tuple:
        self.digest.update((b"\n" if self.place else b"") + f"{role}:{text}".encode())
        self.place += 1
        return (self.conv_id, self.place, edit, turn, role, text)

    def row(self, op: dict, nth: int, role: str, text: str) -> list[tuple]:
        """The rows that the nth of the equal rows of op becomes: conv_id, place, edit, turn, role, text."""
        beyond, code, fault = op["beyond"], op["class"], op["fault"]
        left = DELETE * (op["n"] - nth)  # the equal rows that follow
        if nth > 1:
            code, fault = 0, fault if fault == "blank" else "duplicate"
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + op["initial"] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = op["initial"]
        if op["turn"] is not None and nth == 1 and op["turn"] != self.seen:
            self.low, self.high, self.seen, self.turns = op["turn"] if self.low is None else self.low, op["turn"], op["turn"], self.turns + 1
        if self.cost is None:
            self.cost = left + before(code, tuple(beyond))[0]
        edits, inserted, given, self.state = trace(self.state, code, tuple(beyond))
        self.audit.append(edits)
        out = [self._stays("I", r, "", None) for r in inserted]
        if edits[-1] != "D":
            out.append(self._stays(edits[-1], given or role, text, op["turn"]))
        return out

    def close(self) -> list[tuple]:
        out = [self._stays("I", r, "", None) for r in ending(self.state)]
        self.audit.append("I" * len(out))
        return out

    def sums(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest())


def _traced(turns: DataFrame, whole: bool) -> DataFrame:
    """The repaired rows (whole), or one row of sums for each conversation that has rows."""
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"))
    work, kind = Scratch(turns.sparkSession), dict(turns.dtypes)["conv_id"]
    scanned = _scanned(_coded(turns, work), work)
    ops = scanned.select("conv_id", *ORDER, F.lit(0).alias("own"), "n", "fault", "class", "initial", "beyond", F.lit("").alias("role"), F.lit("").alias("text"))
    texts = turns.withColumns({"tie": _tie(), "own": F.lit(1)})
    both = ops.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "tie", "own")
    rows = f"conv_id {kind}, place long, edit string, turn long, role string, text string"
    sums = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [x.split()[0] for x in (rows if whole else sums).split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, op, nth, types = None, None, 0, {n: pa.string() for n in ("edit", "role", "text", "audit", "repaired_sha256")}

        def ended(trace_: Trace) -> list[tuple]:
            rest = trace_.close()
            return rest if whole else [trace_.sums()]

        def batch_of(out: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], types.get(n, pa.int64())) for j, n in enumerate(names)], names)

        for batch in batches:
            types["conv_id"], out = batch.schema.field("conv_id").type, []
            role, text = batch.column("role"), batch.column("text")
            for i, (c, own) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("own").to_pylist(), strict=True)):
                if at is None or c != at.conv_id:
                    out += ended(at) if at else []
                    at = Trace(c)
                if not own:
                    op, nth = {k: batch.column(k)[i].as_py() for k in ("turn", "n", "fault", "class", "initial", "beyond")}, 0
                else:
                    nth += 1
                    made = at.row(op, nth, role[i].as_py(), text[i].as_py())
                    out += made if whole else []
            yield batch_of(out)
        if at:
            yield batch_of(ended(at))

    return both.mapInArrow(run, rows if whole else sums)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit (K kept, R new role, I inserted), turn (null if inserted), role, text.

    turns: conv_id, turn, role, text; other columns are ignored. Null roles and texts are one space, and so blank. A
    conversation's rows go by turn, nulls first, and within a turn by the MD5 of the role's length, role and text, so
    repeated rows are next to each other; of rows with the same role and text all but the first are duplicates. All rows
    without conv_id are one conversation. What is deleted has no row here. Empty in, empty out.
    """
    return _traced(turns, True)


def repair_summary(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation with rows; as repaired_turns.

    The audit is one string for each conversation, a character for each edit.
    """
    return _traced(turns, False)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted damage, by the hash of each row's `conv_id:turn`."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    what = unsigned_crc32(key) % 20
    text = F.when(what == 1, F.lit("")).when(what == 2, F.regexp_replace(_filled("text"), "[.!?]", "")).otherwise(_filled("text"))
    role = F.when(what == 4, F.lit("user")).otherwise(_filled("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), what.alias("what")).filter(F.col("what") != 0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    sums = repair_summary(damaged(turns)).withColumnRenamed("conv_id", "_id")
    every = turns.select("conv_id").distinct()
    met = every.join(sums, every.conv_id.eqNullSafe(sums["_id"]), "left").drop("_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return met.fillna(0, numbers).fillna("", ["audit"]).fillna(hashlib.sha256().hexdigest(), ["repaired_sha256"])


def _oracle() -> str:
    """The repair in SQL: from a conversation's last row on, the cheapest and least (cost, audit, text) from each state."""
    nxt, role = {1: 3, 2: 3, 3: 4, 4: 3}, {1: "user", 2: "user", 3: "assistant", 4: "user"}
    made = lambda cost, edit, line, rest: f"{{'c': {cost} + {rest}.c, 'a': '{edit}' || {rest}.a, 't': {line} || {rest}.t}}"

    def direct(s: int) -> str:
        more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
        stays = "fault IN ('', 'truncated')"
        keep = f"CASE WHEN {stays} AND i = '{role[s][0]}' THEN {made(more, 'K', 'chr(10) || role || chr(58) || text', f'v[{nxt[s]}]')} END"
        first = f"CASE WHEN {stays} AND i = 's' THEN {made(more, 'K', 'chr(10) || role || chr(58) || text', 'v[2]')} END" if s == 1 else "NULL"
        again = f"CASE WHEN {stays} THEN {made('1 + ' + more, 'R', f'chr(10) || {role[s]!r} || chr(58) || text', f'v[{nxt[s]}]')} END"
        gone = f"{{'c': 2 + v[{s}].c, 'a': 'D' || v[{s}].a, 't': v[{s}].t}}"
        return f"list_sort(list_filter([{gone}, {keep}, {first}, {again}], lambda x: x IS NOT NULL))[1]"

    insert = lambda s: f"list_sort([d[{s}], {made(5, 'I', f'chr(10) || {(role[s] + ':')!r}', f'd[{nxt[s]}]')}])[1]"
    inserts = f"[{', '.join(insert(s) for s in range(1, 5))}]"
    ends = "[{'c': 0, 'a': '', 't': ''}, {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 't': ''}]"
    return rf"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS what FROM filled),
live AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy_ FROM hashed WHERE what <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS p FROM live),
marked AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS i0,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
run AS (
  SELECT conv_id, max(p) + 1 AS p, {ends} AS v FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, {inserts} AS v FROM (SELECT conv_id, p, {inserts} AS d FROM (
    SELECT m.conv_id, m.p, [{', '.join(direct(s) for s in range(1, 5))}] AS d FROM run r JOIN marked m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.p = r.p - 1))),
sums AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i0 IS NOT NULL AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(substr(v[1].t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN run r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.p = 1
"""


ORACLE = _oracle()
