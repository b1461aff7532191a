"""Operator 13: conversation structure repair by bidirectional Dijkstra over the edit lattice.

A row's fault and first letter of its role make one symbol; a node of the lattice is (rows used, state of the grammar
``(s?(ua)+)?``), an edge is one edit. Forward and reverse heaps meet; both go on until no crossing of the same cost can be
missing. The remaining cost is then known for every node of every cheapest path, from the reverse side or through the crossings,
and the least letter that keeps to it, step by step, spells the least of the concatenated audits.

Rows are shuffled once by conversation and repaired in one sorted stream. Conversations over ``MAX_ROWS`` rows or ``MAX_BYTES``
bytes, at most ``MAX_LONG`` of them by construction, go another way to the same result: their rows are range-partitioned and cut
into pieces of ``PIECE`` rows; each piece gets its costs between states, in parallel; the heaps meet in the lattice of the piece
borders; each piece spells its part of the audit for each state it can be entered in; then the rows stream past once to be hashed.
What one task holds of such a conversation is a few numbers a piece and, in the end, the audit, which the result has in one cell.

Defined results: a null id, turn, role or text is read as one space (as a key, ids and turns stay null); rows of one turn are taken
in order of role and text, repeated rows are duplicates; a role without a letter fits nowhere; rows without ``conv_id`` are
one conversation; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import cut, table, written

BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
MAX_ROWS, MAX_BYTES, MAX_LONG, PIECE = 4096, 64 << 20, 500_000, 4096
PART_BYTES = 64 << 20
#: States: 0 nothing yet, 1 after a system turn, 2 after user, 3 after assistant. What may be inserted or reroled to in each.
STEP = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
TAIL = (0, 2 * INSERT, INSERT, 0)  # cost of the insertions that end a conversation in each state
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")
TURNS = "conv_id bigint, pos bigint, edit string, role string, text string"
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, next state and cost of the edits of one row; x has to go, capitals are truncated."""
    out = [("D", state, DELETE)]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        if (state, symbol.lower()) in KEEP:
            out.append(("K", KEEP[state, symbol.lower()], more))
        out.append(("R", STEP[state][1], REROLE + more))
    return out


EDITS = {s: [_edits(s, q) for q in range(4)] for s in "xsuaoSUAO"}
BEFORE = {s: [[(p, c) for p in range(4) for _, q, c in EDITS[s][p] if q == state] for state in range(4)] for s in EDITS}
INSERTED = [[p for p in range(4) if STEP[p][1] == state] for state in range(4)]


def symbol(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


def meet(sources: dict, targets: dict, after, before) -> tuple[int, dict]:
    """Cost of the cheapest paths and, for every node on one of them, the cost that remains; nodes off them may be there too.

    after(node) gives (letter, next, cost), before(node) gives (previous, cost).
    """
    tentative = [dict(sources), dict(targets)]
    settled: list[dict] = [{}, {}]
    heaps: list[list] = [[], []]
    for side in (0, 1):
        for node, cost in tentative[side].items():
            heappush(heaps[side], (cost, node))
    best, crossings = math.inf, []
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, node = heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side][node] = cost
        across = settled[1 - side].get(node, (sources if side else targets).get(node))  # an end's own cost closes a path as well
        if across is not None:
            best = min(best, cost + across)
            if not side:
                crossings.append((cost + across, node))
        for other, step in before(node) if side else [(w, c) for _, w, c in after(node)]:
            if other in settled[1 - side]:
                total = cost + step + settled[1 - side][other]
                best = min(best, total)
                crossings.append((total, other if side else node))
            if other not in settled[side] and cost + step < tentative[side].get(other, math.inf):
                tentative[side][other] = cost + step
                heappush(heaps[side], (cost + step, other))
    # Back from the equal-cost crossings along edges that keep to the forward costs.
    ahead, behind = settled
    useful = {v for total, v in crossings if total == best and v in ahead}
    todo = list(useful)
    while todo:
        node = todo.pop()
        for other, step in before(node):
            if other in ahead and other not in useful and ahead[other] + step == ahead[node]:
                useful.add(other)
                todo.append(other)
    return best, behind | {v: best - ahead[v] for v in useful}


def cheapest(symbols: str) -> tuple[int, str]:
    """Cost and least audit of a conversation's symbols."""
    return _common(symbols) if len(symbols) <= 32 else _cheapest(symbols)


def _cheapest(symbols: str) -> tuple[int, str]:
    """As cheapest. Node 4 i + q: i rows used, state q."""
    n = len(symbols)

    def after(v):
        i, q = divmod(v, 4)
        if i < n:
            yield from ((letter, 4 * i + 4 + p, c) for letter, p, c in EDITS[symbols[i]][q])
        yield "I", 4 * i + STEP[q][1], INSERT

    def before(v):
        i, q = divmod(v, 4)
        if i:
            yield from ((4 * i - 4 + p, c) for p, c in BEFORE[symbols[i - 1]][q])
        yield from ((4 * i + p, INSERT) for p in INSERTED[q])

    cost, rest = meet({0: 0}, {4 * n + q: 0 for q in ENDS}, after, before)
    v, left, audit = 0, cost, []
    while left or v < 4 * n:
        letter, v, step = next(e for e in sorted(after(v)) if rest.get(e[1]) == left - e[2])
        left -= step
        audit.append(letter)
    return cost, "".join(audit)


_common = lru_cache(maxsize=1 << 16)(_cheapest)


# Long conversations: a piece's paths end with a row's edit, so that no piece's audit begins another's.
def costs_between(symbols: str) -> list[float]:
    """Cheapest cost from each state before a piece to each state after it, row by row of the 4 x 4 table."""
    out = []
    for q in range(4):
        now = [math.inf] * 4
        now[q] = 0
        for s in symbols:
            for p in (0, 1, 2, 3):  # a longer run of insertions repeats a state
                now[STEP[p][1]] = min(now[STEP[p][1]], now[p] + INSERT)
            then = [math.inf] * 4
            for p in range(4):
                for _, r, c in EDITS[s][p]:
                    then[r] = min(then[r], now[p] + c)
            now = then
        out += now
    return out


def border_costs(pieces: list[list[float]]) -> tuple[int, list[list[float]]]:
    """Cost of a conversation of pieces, and the cost that remains at each border in each state; off the cheapest paths infinite."""
    m = len(pieces)

    def after(v):
        j, q = divmod(v, 4)
        return [("", 4 * j + 4 + p, c) for p, c in enumerate(pieces[j][4 * q : 4 * q + 4]) if c < math.inf] if j < m else []

    def before(v):
        j, p = divmod(v, 4)
        return [(4 * j - 4 + q, pieces[j - 1][4 * q + p]) for q in range(4) if pieces[j - 1][4 * q + p] < math.inf] if j else []

    cost, rest = meet({0: 0}, {4 * m + q: c for q, c in enumerate(TAIL)}, after, before)
    return cost, [[rest.get(4 * j + q, math.inf) for q in range(4)] for j in range(m + 1)]


def spelled(symbols: str, exits: list[float]) -> tuple[list[int], list[str]]:
    """For each state before a piece: the state after it and the least audit, given the costs that remain after it."""
    rest = [list(exits)]
    for s in reversed(symbols):
        now = [min(c + rest[-1][p] for _, p, c in EDITS[s][q]) for q in range(4)]
        for q in (3, 2, 1, 0, 3):
            now[q] = min(now[q], INSERT + now[STEP[q][1]])
        rest.append(now)
    rest.reverse()
    ends, audits = [], []
    for q in range(4):
        audit, i = [], 0
        while i < len(symbols) and rest[0][q] < math.inf:
            ways = sorted([(letter, i + 1, p, c) for letter, p, c in EDITS[symbols[i]][q]] + [("I", i, STEP[q][1], INSERT)])
            letter, i, q = next((e[0], e[1], e[2]) for e in ways if rest[e[1]][e[2]] + e[3] == rest[i][q])
            audit.append(letter)
        ends.append(q)
        audits.append("".join(audit))
    return ends, audits


class Repair:
    """Takes a conversation's rows in order, with an audit that may come in parts; keeps counts, a hash and, if asked, the turns."""

    def __init__(self, conv_id, turns: bool):
        self.conv_id, self.turns, self.out = conv_id, turns, []
        self.faults, self.illegal, self.initial = dict.fromkeys(FAULTS, 0), 0, None
        self.first = self.last = None
        self.distinct = 0
        self.state = self.pos = 0
        self.hash, self.any, self.audit, self.part, self.at = hashlib.sha256(), False, [], "", 0

    def more(self, part: str) -> None:
        self.audit.append(part)
        self.part, self.at = part, 0

    def _turn(self, edit: str, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True
        if self.turns:
            self.out.append((self.conv_id, self.pos, edit, role, text))
        self.pos += 1

    def inserted(self) -> None:
        while self.at < len(self.part) and self.part[self.at] == "I":
            role, self.state = STEP[self.state]
            self._turn("I", role, "")
            self.at += 1

    def row(self, turn, role: str, text: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.inserted()
        edit = self.part[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEP[self.state, role[:1]]
            self._turn("K", role, text)
        elif edit == "R":
            role, self.state = STEP[self.state]
            self._turn("R", role, text)

    def report(self, cost: int) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, *(self.faults[f] for f in FAULTS), self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def _runs(batches, key: str = "conv_id"):
    """(key, iterator of the run's rows) of consecutive rows with one key; a run has to be used up before the next one."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    return groupby(rows(), key=lambda r: r[0])


def _fault(last: str, seen: bool) -> str:
    return "blank" if not last else "duplicate" if seen else "" if last in ".!?" else "truncated"


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations that fit in memory, each repaired in the stream of its sorted rows."""
    schema = TURNS if turns else REPORT

    def run(batches):
        out, held = [], 0
        for conv_id, run in _runs(batches):
            seen, kept = set(), []
            for _, _, turn, role, text, last in run:
                if last is not None:  # else the row is only there to name the conversation
                    kept.append((turn, role, text, _fault(last, (role, text) in seen)))
                    seen.add((role, text))
            cost, audit = cheapest("".join(symbol(r[1], r[3]) for r in kept)) if kept else (0, "")
            repair = Repair(conv_id, turns)
            repair.more(audit)
            for row in kept:
                repair.row(*row)
            repair.inserted()
            out += repair.out if turns else [repair.report(cost)]
            held += sum(len(r[2]) for r in kept) if turns else len(audit) + 100
            if held > 4_000_000:
                yield _batch(out, schema)
                out, held = [], 0
        yield _batch(out, schema)

    order = ["conv_id", "dropped", "turn", "role", "text"]
    return rows.select(*order, "last").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _pieces(rows: DataFrame, size: int, n_bytes: int) -> DataFrame:
    """Rows of long conversations in order: conv_id, part, piece, at, turn, role, text, fault, symbol. Order: part, piece, at."""
    digest = F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "role", "text")))
    rows = rows.where(~F.col("dropped")).withColumn("digest", digest)
    firsts = rows.groupBy("digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    rows = rows.join(firsts, "digest").withColumn("later", ~F.col("turn").eqNullSafe(F.col("first.turn"))).drop("first")
    names = ["conv_id", "part", "piece", "at", "turn", "role", "text", "fault", "symbol"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 4

    def run(batches):
        part, piece, at, before, conv = TaskContext.get().partitionId(), 0, 0, None, ()
        for batch in batches:
            out = []
            for conv_id, turn, role, text, last, digest, later in zip(*(c.to_pylist() for c in batch.columns)):
                if at == size or conv != (conv_id,):
                    piece, at, conv = piece + 1, 0, (conv_id,)
                fault = _fault(last, later or digest == before)  # equal rows of one turn are neighbours
                before = digest
                out.append((conv_id, part, piece, at, turn, role, text, fault, symbol(role, fault)))
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([list(c) for c in zip(*out)] or [[]] * len(names), kinds)], names)

    columns = ["conv_id", "turn", "role", "text", "last", "digest", "later"]
    ranges = rows.repartitionByRange(max(1, math.ceil(n_bytes / PART_BYTES)), "conv_id", "turn", "role", F.substring("text", 1, 64))
    return ranges.sortWithinPartitions("conv_id", "turn", "role", "text").select(*columns).mapInArrow(
        run, "conv_id bigint, part bigint, piece bigint, at bigint, turn bigint, role string, text string, fault string, symbol string"
    )


def _long(rows: DataFrame, turns: bool, size: int, n_bytes: int) -> DataFrame:
    """Long conversations: costs per piece, heaps that meet over the borders, audits per piece, then one pass over the rows."""
    rows = written(_pieces(rows, size, n_bytes))
    key = ["conv_id", "part", "piece"]
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "")
    pieces = rows.groupBy(*key).agg(symbols.alias("symbols"))  # of at most size rows

    def costs(frames):
        for f in frames:
            yield f.assign(costs=[costs_between(s) for s in f["symbols"]])

    pieces = cut(pieces.mapInPandas(costs, "conv_id bigint, part bigint, piece bigint, symbols string, costs array<double>"))

    def borders(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "piece"])
        cost, rest = border_costs([list(c) for c in f["costs"]])
        return f[key].assign(exits=rest[1:], cost=cost)

    # One row a piece, without its rows: a conversation's group is a small part of it.
    exits = pieces.select(*key, "costs").groupBy("conv_id").applyInPandas(borders, "conv_id bigint, part bigint, piece bigint, exits array<double>, cost bigint")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"]) & (a["piece"] == b["piece"])
    joined = pieces.join(exits, same(pieces, exits)).select(pieces["conv_id"], pieces["part"], pieces["piece"], "symbols", "exits", "cost")

    def spell(frames):
        for f in frames:
            found = [spelled(s, list(x)) for s, x in zip(f["symbols"], f["exits"])]
            yield f[[*key, "cost"]].assign(ends=[x[0] for x in found], audits=[x[1] for x in found])

    spelt = cut(joined.mapInPandas(spell, "conv_id bigint, part bigint, piece bigint, cost bigint, ends array<int>, audits array<string>"))

    def chain(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "piece"])
        states = [0]
        for ends in f["ends"]:
            states.append(int(ends[states[-1]]))
        tail = ["", "II", "I", ""][states[-1]]
        return f[key].assign(state=states[:-1], tail=[""] * (len(f) - 1) + [tail])

    states = spelt.select(*key, "ends").groupBy("conv_id").applyInPandas(chain, "conv_id bigint, part bigint, piece bigint, state int, tail string")
    audits = spelt.join(states, same(spelt, states)).select(spelt["conv_id"], spelt["part"], spelt["piece"], "cost", F.concat(F.col("audits")[F.col("state")], "tail").alias("audit"))
    # The audit of a piece comes as a row before the piece's rows.
    none = F.lit(None).cast("string")
    heads = audits.select(*key, F.lit(-1).cast("long").alias("at"), F.col("cost").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), none.alias("fault"))
    stream = rows.select(heads.columns).unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece", "at")
    schema = TURNS if turns else REPORT

    def run(batches):
        for conv_id, run in _runs(batches):
            repair, total, held = Repair(conv_id, turns), 0, 0
            for _, _, _, at, turn, role, text, fault in run:
                if at < 0:
                    repair.inserted()
                    repair.more(text)
                    total = turn
                    continue
                repair.row(turn, role, text, fault)
                held += len(text)
                if turns and held > 4_000_000:
                    yield _batch(repair.out, schema)
                    repair.out, held = [], 0
            repair.inserted()
            yield _batch(repair.out if turns else [repair.report(total)], schema)

    return stream.mapInArrow(run, schema)


def _repaired(rows: DataFrame, turns: bool, max_rows: int, max_bytes: int, piece: int) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped): the report of every conversation, or its repaired turns."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    rows = rows.withColumn("last", F.when(~F.col("dropped"), last))
    sizes = cut(rows.groupBy("conv_id").agg(F.sum((~F.col("dropped")).cast("long")).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    is_long = (F.col("n") > max(max_rows, total[0] // MAX_LONG)) | (F.col("bytes") > max(max_bytes, total[1] // MAX_LONG))
    long = sizes.where(is_long)
    n_bytes = long.agg(F.sum("bytes")).first()[0]
    if n_bytes is None:
        return _short(rows, turns)
    named = F.broadcast(long.select(F.col("conv_id").alias("long_id")))  # at most 2 MAX_LONG numbers
    match = rows["conv_id"].eqNullSafe(F.col("long_id"))
    return _short(rows.join(named, match, "left_anti"), turns).unionByName(_long(rows.join(named, match, "left_semi"), turns, piece, n_bytes))


def _clean(conversations: DataFrame) -> DataFrame:
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def repaired(conversations: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, piece: int = PIECE) -> DataFrame:
    """conv_id, pos, edit, role, text: the turns of every conversation after the cheapest edits. Conversations left empty give none."""
    return _repaired(_clean(conversations).withColumn("dropped", F.lit(False)), True, max_rows, max_bytes, piece)


def report(rows: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, piece: int = PIECE) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, dropped): faults, cost, audit and hash of the repaired turns.

    Rows with ``dropped`` only name their conversation.
    """
    return _repaired(rows, False, max_rows, max_bytes, piece)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by the CRC of conversation and turn; ``dropped`` rows are kept as names of conversations."""
    rows = _clean(conversations)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("kind") == 0, "").otherwise(text)})
    twice = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumns({"dropped": F.col("kind") == 0, "copy": F.explode(twice)}).select("conv_id", "turn", "role", "text", "dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damaged(table(spark, sf_dir, "conversations")))


def _moves() -> str:
    """VALUES of all ways to use up one row: state, symbol, next state, cost, letters, inserted lines before, edit, new role."""
    out = []
    for s in EDITS:
        for q in range(4):
            state, letters, lines = q, "", ""
            for k in range(4):  # more insertions in one place repeat a state
                for letter, to, cost in EDITS[s][state]:
                    role = STEP[state][0] if letter == "R" else ""
                    out.append(f"({q}, '{s}', {to}, {cost + k * INSERT}, '{letters}{letter}', '{lines}', '{letter}', '{role}')")
                role, state = STEP[state]
                letters, lines = letters + "I", lines + f"{role}:|"
    return ", ".join(out)


#: The same report by a table of states that goes through the rows of all conversations side by side; | stands for the end of a line that was put in.
SQL = rf"""
with recursive src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  list_reduce(list_prepend(4294967295, [ord(c) for c in string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), '')]),
   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc from conversations),
kinds as (select *, xor(crc, 4294967295) % 20 as kind from src),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from kinds, range(2) as c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (select *, row_number() over (partition by conv_id, role, text order by n) as seen
 from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from damaged)),
judged as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen > 1 then 'duplicate'
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault from placed),
marked as (select *, case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(letter) else letter end as symbol
  from (select *, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as letter from judged)),
moves(q, symbol, p, more, letters, lines, edit, fresh) as (values {_moves()}),
states as (
 select conv_id, cast(0 as bigint) as n, 0 as q, 0 as cost, '' as audit, '' as done from (select distinct conv_id from conversations)
 union all
 select conv_id, n, q, best.cost, best.audit, best.done from (
  select s.conv_id, m.n, v.p as q, min({{'cost': s.cost + v.more, 'audit': s.audit || v.letters,
   'done': s.done || replace(v.lines, '|', chr(10)) || case v.edit when 'D' then '' when 'K' then m.role || ':' || m.text || chr(10) else v.fresh || ':' || m.text || chr(10) end}}) as best
  from states s join marked m on m.conv_id is not distinct from s.conv_id and m.n = s.n + 1 join moves v on v.q = s.q and v.symbol = m.symbol group by s.conv_id, m.n, v.p)),
ends as (select conv_id, min({{'cost': cost + t.more, 'audit': audit || t.letters, 'done': done || replace(t.lines, '|', chr(10))}}) as best
 from (select *, max(n) over (partition by conv_id) as last from states) s join (values (0, 0, '', ''), (1, {2 * INSERT}, 'II', 'user:|assistant:|'), (2, {INSERT}, 'I', 'assistant:|'), (3, 0, '', '')) as t(q, more, letters, lines)
  on t.q = s.q where s.n = s.last group by conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal
 from (select *, lag(left(role, 1)) over (partition by conv_id order by n) as before from judged) group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
 cast(best.cost as bigint) as cost, best.audit as audit, sha256(case when best.done = '' then '' else left(best.done, length(best.done) - 1) end) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id"""
