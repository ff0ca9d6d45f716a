"""Repair of conversations: a generalised LR parse over the grammar of roles, with weighted edits.

A conversation may be empty, or an optional system turn and then pairs of user and assistant. The graph-structured stack
takes its turns one by one; a turn is kept, gets another role, is deleted, or others are inserted before it. Stacks that
end in the same top are merged: that of the least (cost, audit) stays.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import record_batch, shuffle_partitions, struct, written

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rules of the role grammar: c, the conversation, and t, its turns. Left recursion keeps stacks flat.
GRAMMAR = (("c", ""), ("c", "t"), ("c", "st"), ("t", "ua"), ("t", "tua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a turn, as the stack sees them: none, to be deleted, costlier to keep.
FINE, GONE, SHORT = 0, 1, 2


class Automaton:
    """The LR(0) automaton of a grammar of single-letter symbols, and its stacks between two turns, each known by its top.

    ``shift[top]`` gives the top after each terminal, all reductions done that its rules then allow; ``ends`` holds the tops
    at which the whole may end. Stacks of the same top may be merged only where what lies under it changes nothing that
    follows; a grammar whose stacks go on otherwise is refused.
    """

    def __init__(self, rules=GRAMMAR, start: str = "c"):
        self.rules, self.start = rules, start
        self.nonterminals = {r[0] for r in rules}
        self.states = [self._closure({(-1, 0)})]
        self.tops: dict[int, int] = {}
        self.shift: list[dict[str, int]] = []
        self.ends: list[bool] = []
        self._find()

    def _after(self, item) -> str:
        rule, dot = item
        body = self.start if rule < 0 else self.rules[rule][1]
        return body[dot : dot + 1]

    def _closure(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            symbol = self._after(todo.pop())
            for i, (head, _) in enumerate(self.rules):
                if head == symbol and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def _goto(self, state: int, symbol: str) -> int | None:
        moved = {(r, d + 1) for r, d in self.states[state] if self._after((r, d)) == symbol}
        if not moved:
            return None
        new = self._closure(moved)
        if new not in self.states:
            self.states.append(new)
        return self.states.index(new)

    def _reduced(self, stack: tuple) -> tuple:
        """The stack once turns are complete: a rule of turns whose body ends at the top is reduced at once, since nothing
        else can follow there."""
        items = self.states[stack[-1]]
        if len(items) == 1 and not self._after(item := next(iter(items))) and item[0] >= 0 and self.rules[item[0]][1]:
            head, body = self.rules[item[0]]
            under = stack[: len(stack) - len(body)]
            return self._reduced((*under, self._goto(under[-1], head)))
        return stack

    def _accepts(self, stack: tuple) -> bool:
        """Whether reductions at the end of the input lead to the start symbol."""
        for rule, dot in self.states[stack[-1]]:
            if (rule, dot) == (-1, 1):
                return len(stack) == 2
            if rule >= 0 and not self._after((rule, dot)) and self.rules[rule][0] == self.start:
                return len(stack) - len(self.rules[rule][1]) == 1
        return False

    def _alike(self, a: tuple, b: tuple, turns: int) -> bool:
        """Whether two stacks of the same top take and end the same next turns, up to so many."""
        if self._accepts(a) != self._accepts(b):
            return False
        nexts = [n for s in "sua" if (n := self._goto(a[-1], s)) is not None] if turns else []
        return all(self._alike(self._reduced((*a, n)), self._reduced((*b, n)), turns - 1) for n in nexts)

    def _find(self) -> None:
        stacks = {0: (0,)}
        todo = [0]
        while todo:
            top = todo.pop(0)
            self.tops.setdefault(top, len(self.tops))
            for symbol in "sua":
                nxt = self._goto(top, symbol)
                if nxt is not None:
                    stack = self._reduced((*stacks[top], nxt))
                    if stack[-1] not in stacks:
                        stacks[stack[-1]] = stack
                        todo.append(stack[-1])
                    elif not self._alike(stack, stacks[stack[-1]], 8):
                        raise ValueError("stacks of the same top go on differently")
        self.shift, self.ends = [{} for _ in self.tops], [False] * len(self.tops)
        for top, i in self.tops.items():
            self.ends[i] = self._accepts(stacks[top])
            for symbol in "sua":
                nxt = self._goto(top, symbol)
                if nxt is not None:
                    self.shift[i][symbol] = self.tops[self._reduced((*stacks[top], nxt))[-1]]

    def inserted(self, top: int) -> list[tuple[int, int]]:
        """(top, how many) reached from a top by inserting user and assistant turns, each by its fewest."""
        found, at = {top: 0}, [top]
        while at:
            at = [q for p in at for s, q in sorted(self.shift[p].items()) if s in ROLES and q not in found and found.setdefault(q, found[p] + 1)]
        return list(found.items())


class Repair:
    """The graph-structured stack over the turns of a conversation, from the empty stack or from each possible top.

    For each start and top one path is kept, as a chain of (before, edits of a turn). An audit up to a turn ends in that
    turn's own edit, so none begins another of the same turns; so their order holds whatever follows, and each step needs
    their ranks alone.
    """

    auto = Automaton()
    tops = range(len(auto.shift))
    #: (role initial, fault) -> for each top the least (cost, edits) to each top after the turn
    _steps: dict[tuple[str, int], list[dict[int, tuple[int, str]]]] = {}

    @classmethod
    def steps(cls, initial: str, fault: int) -> list[dict[int, tuple[int, str]]]:
        found = cls._steps.get((initial, fault))
        if found is None:
            found = []
            for p in cls.tops:
                best: dict[int, tuple[int, str]] = {}
                for q, n in cls.auto.inserted(p):
                    more = TRUNCATED if fault == SHORT else 0
                    ways = [(q, DELETE, "D")]
                    if fault != GONE:
                        ways += [(t, more + (0 if s == initial else REROLE), "K" if s == initial else "R") for s, t in cls.auto.shift[q].items() if s == initial or s in ROLES]
                    for t, cost, edit in ways:
                        way = (n * INSERT + cost, "I" * n + edit)
                        best[t] = min(best.get(t, way), way)
                found.append(best)
            cls._steps[initial, fault] = found
        return found

    def __init__(self, starts: list[int] = (0,)):
        #: start -> top -> (cost, rank, chain)
        self.live = {p: {p: (0, 0, None)} for p in starts}

    def turn(self, initial: str, fault: int) -> None:
        steps = self.steps(initial if initial in ("s", "u", "a") else "?", fault)
        for start, tops in self.live.items():
            best: dict[int, tuple] = {}
            for p, (cost, rank, chain) in tops.items():
                for q, (more, edits) in steps[p].items():
                    way = (cost + more, rank, edits)
                    if q not in best or way < best[q][0]:
                        best[q] = (way, chain)
            ranks = {w: i for i, w in enumerate(sorted({(r, e) for (_, r, e), _ in best.values()}))}
            self.live[start] = {q: (c, ranks[r, e], (chain, e)) for q, ((c, r, e), chain) in best.items()}

    def paths(self) -> list[tuple[int, int, int, str]]:
        """(start, top, cost, audit) of all kept paths."""
        return [(p, q, c, audit(chain)) for p, tops in self.live.items() for q, (c, _, chain) in tops.items()]

    @classmethod
    def ended(cls, tops: dict[int, tuple]) -> tuple[int, str, int]:
        """(cost, last inserts, top) of the cheapest way to an end from tops with (cost, rank, ...)."""
        ways = [(c + n * INSERT, rank, "I" * n, p) for p, (c, rank, *_) in tops.items() for q, n in cls.auto.inserted(p) if cls.auto.ends[q]]
        cost, _, last, top = min(ways)
        return cost, last, top


def audit(chain) -> str:
    out = []
    while chain is not None:
        chain, edits = chain
        out.append(edits)
    return "".join(reversed(out))


def replayed(auto: Automaton, top: int, edits: Iterator[str], role: str | None, text: str) -> tuple[int, list[str]]:
    """What a turn (None: the end) becomes: the next top, and the ``role:text`` of it and of what is inserted before it."""
    out = []
    for e in edits:
        if e == "D":
            return top, out
        if e == "K":
            out.append(f"{role}:{text}")
            return auto.shift[top][role[:1]], out
        symbol, top = next((s, q) for s, q in sorted(auto.shift[top].items()) if s in ROLES)
        out.append(f"{ROLES[symbol]}:{text if e == 'R' else ''}")
        if e == "R":
            return top, out
    return top, out


class Joined:
    """SHA-256 of lines joined by a newline."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, lines: list[str]) -> None:
        for x in lines:
            self.hash.update((("\n" if self.any else "") + x).encode("utf-8", "surrogatepass"))
            self.any = True


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) after the given damage, by crc32(``conv_id:turn``) mod 20, nulls as one
    space: 0 drops the row (it stays with ``gone``, so that its conversation is still known), 1 empties the text, 2 takes
    its ``.!?`` out, 3 repeats it (``copy`` 1), 4 makes it the user's."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
#: Text of one conversation that a task holds until its end is known; a longer one is written in pieces.
HELD_BYTES = 4_000_000
PART_DDL = f"""conv_id {{conv}}, part long, piece long, whole boolean, starts boolean, {", ".join(f"{c} long" for c in COUNTS)}, first_turn long, last_turn long, first_role string, last_role string,
  cost long, audit string, sha string, paths array<struct<start: int, top: int, cost: long, audit: string>>, roles array<string>, texts array<string>"""


class Part:
    """The turns of one conversation in one range of the sorted rows."""

    def __init__(self, conv, starts: bool):
        self.conv, self.starts, self.n, self.turn = conv, starts, dict.fromkeys(COUNTS, 0), None
        self.low = self.high = self.first = self.last = None
        self.repair = Repair([0] if starts else list(Repair.tops))
        self.roles, self.texts, self.size, self.pieces = [], [], 0, []

    def add(self, turn, role: str, text: str, again: bool) -> None:
        n = self.n
        n["rows"] += 1
        if turn is not None and turn != self.high:
            n["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        seen = text.rstrip(BLANKS)
        fault = "blank" if not seen else "duplicate" if again else "truncated" if seen[-1] not in ".!?" else None
        if fault:
            n[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            n["illegal"] += 1
        self.first, self.last = initial if self.first is None else self.first, initial
        self.repair.turn(initial, FINE if fault is None else SHORT if fault == "truncated" else GONE)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + 16

    def flush(self, part: int):
        row = self._row(part, len(self.pieces), roles=self.roles, texts=self.texts)
        self.pieces.append(len(self.roles))
        self.roles, self.texts, self.size = [], [], 0
        return row

    def _row(self, part: int, piece: int | None, **more) -> dict:
        return {"conv_id": self.conv, "part": part, "piece": piece, "whole": False, **more}

    def rows(self, part: int, ends: bool) -> list[dict]:
        """Its result, if it began here and ends here and was held; else its paths and its turns in pieces."""
        base = dict(self.n, first_turn=self.low, last_turn=self.high, first_role=self.first, last_role=self.last, starts=self.starts)
        if self.starts and ends and not self.pieces:
            tops = self.repair.live[0]
            cost, last, top = Repair.ended(tops)
            edits = audit(tops[top][2]) + last
            out, at, it = Joined(), 0, iter(edits)
            for role, text in zip(self.roles, self.texts, strict=True):
                at, lines = replayed(Repair.auto, at, it, role, text)
                out.add(lines)
            out.add(replayed(Repair.auto, at, it, None, "")[1])
            return [self._row(part, None, **base) | {"whole": True, "cost": cost, "audit": edits, "sha": out.hash.hexdigest()}]
        paths = [dict(zip(("start", "top", "cost", "audit"), p, strict=True)) for p in self.repair.paths()]
        return [self._row(part, None, paths=paths, **base), *([self.flush(part)] if self.roles else [])]


def parts(rows: DataFrame, held: int = HELD_BYTES) -> DataFrame:
    """``damaged`` rows to parts of conversations: put in order of (conversation, turn, role, MD5 of the text) by ranges, so
    a conversation of any size is dealt to as many tasks as it needs, each of which walks its range once. Whether a turn
    repeats an earlier one is told by a marker that sorts just before each first one: the least turn by (conversation,
    role, MD5), which Spark sums up before it shuffles."""
    d = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    marks = d.where("not gone").groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("m")).select("conv_id", F.col("m.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"), F.lit(False).alias("gone"), "key", F.lit(-1).alias("copy"))
    d = d.select("conv_id", "turn", "role", "text", "gone", "key", "copy").unionByName(marks)
    by = ["conv_id", "turn", "role", "key"]  # a marker and its turn share a range
    d = d.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "copy").select("conv_id", "turn", "role", "text", "gone")
    ddl = PART_DDL.format(conv=rows.schema["conv_id"].dataType.simpleString())
    arrow = to_arrow_schema(struct(ddl))

    def run(batches):
        part, now, mark = TaskContext.get().partitionId(), None, False
        for batch in batches:
            out = []
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out += now.rows(part, True)
                    now, mark = Part(conv, now is not None), False
                if text is None:
                    mark = True
                elif not gone:
                    now.add(turn, role, text, not mark)
                    mark = False
                    if now.size > held:
                        out.append(now.flush(part))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist(now.rows(part, False), schema=arrow)

    return d.mapInArrow(run, ddl)


def composed(open_parts: DataFrame, conv: str) -> DataFrame:
    """Parts of the same conversation one after another: their counts added up, what meets at a seam counted, paths chained
    by the least (cost, audit). Gives a row for each conversation, and the chosen start and edits of each part. Rows come
    sorted, one a part; of each part only the best path to each top is kept."""
    ddl = f"conv_id {conv}, part long, start int, edits string, {', '.join(f'{c} long' for c in COUNTS)}, first_turn long, last_turn long, cost long, audit string"
    arrow = to_arrow_schema(struct(ddl))

    def closed(conv, state) -> list[dict]:
        sums, live, steps = state["sums"], state["live"], state["steps"]
        cost, last, top = Repair.ended(live)
        chosen = []
        for part, best in reversed(steps):
            start, edits = best[top]
            chosen.append({"conv_id": conv, "part": part, "start": start, "edits": edits})
            top = start
        chosen.reverse()
        text = "".join(x["edits"] for x in chosen) + last
        chosen.append({"conv_id": conv, "part": (steps[-1][0] if steps else -1) + 1, "start": None, "edits": last})  # after the last turn
        return [*chosen, {"conv_id": conv, "part": None, **sums, "first_turn": state["low"], "last_turn": state["high"], "cost": cost, "audit": text}]

    def run(batches):
        state, now = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != now:
                    if state is not None:
                        out += closed(now, state)
                    state, now = {"sums": dict.fromkeys(COUNTS, 0), "live": {0: (0, 0)}, "steps": [], "low": None, "high": None, "role": None}, r["conv_id"]
                if not r["rows"]:
                    continue
                s = state
                for c in COUNTS:
                    s["sums"][c] += r[c]
                if s["role"] is not None and s["role"] + r["first_role"] not in ("su", "ua", "au"):
                    s["sums"]["illegal"] += 1
                s["role"] = r["last_role"]
                if s["high"] is not None and s["high"] == r["first_turn"]:
                    s["sums"]["turns"] -= 1
                s["low"] = r["first_turn"] if s["low"] is None else s["low"]
                s["high"] = r["last_turn"] if r["last_turn"] is not None else s["high"]
                best: dict[int, tuple] = {}
                for p in r["paths"]:
                    if p["start"] in s["live"]:
                        cost, rank = s["live"][p["start"]]
                        way = (cost + p["cost"], rank, p["audit"], p["start"])
                        best[p["top"]] = min(best.get(p["top"], way), way)
                ranks = {w: i for i, w in enumerate(sorted({(w[1], w[2]) for w in best.values()}))}
                s["live"] = {q: (w[0], ranks[w[1], w[2]]) for q, w in best.items()}
                s["steps"].append((r["part"], {q: (w[3], w[2]) for q, w in best.items()}))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist(closed(now, state), schema=arrow)

    n = shuffle_partitions(open_parts.sparkSession)
    keep = [c for c in open_parts.columns if c not in ("roles", "texts", "piece", "whole", "sha", "cost", "audit", "starts")]
    return open_parts.where("piece is null").select(*keep).repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, ddl)


def hashed(pieces: DataFrame, chosen: DataFrame, conv: str) -> DataFrame:
    """(conv_id, sha): SHA-256 of each repaired conversation, whose pieces stream in order through one hash (it can't be
    had from parts); a task holds a piece and the edits of a part at a time."""
    ddl = f"conv_id {conv}, sha string"
    arrow = to_arrow_schema(struct(ddl))
    none = F.lit(None).cast("array<string>")
    c = chosen.where("part is not null").select("conv_id", "part", F.lit(-1).cast("long").alias("piece"), "edits", none.alias("roles"), none.alias("texts"))
    d = c.unionByName(pieces.select("conv_id", "part", "piece", F.lit(None).cast("string").alias("edits"), "roles", "texts"))

    def run(batches):
        out, now, top, it = None, None, 0, iter("")
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                if out is None or r["conv_id"] != now:
                    if out is not None:
                        done.append((now, out.hash.hexdigest()))
                    out, now, top, it = Joined(), r["conv_id"], 0, iter("")
                if r["edits"] is not None:
                    it = iter(r["edits"])
                    if set(r["edits"]) <= {"I"}:  # the inserts after the last turn
                        top, lines = replayed(Repair.auto, top, it, None, "")
                        out.add(lines)
                    continue
                for role, text in zip(r["roles"], r["texts"], strict=True):
                    top, lines = replayed(Repair.auto, top, it, role, text)
                    out.add(lines)
            yield record_batch([list(x) for x in zip(*done, strict=True)] or [[], []], arrow)
        if out is not None:
            yield record_batch([[now], [out.hash.hexdigest()]], arrow)

    n = shuffle_partitions(pieces.sparkSession)
    return d.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(run, ddl)


def repaired_conversations(rows: DataFrame, held: int = HELD_BYTES) -> DataFrame:
    """One row for each conversation of ``rows`` (as ``damaged`` gives them): gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256.

    Turns of one conversation go by turn (nulls first), then role, then MD5 of the text. Null ids form one conversation; a
    null role or text is one space; rows repeated in everything are duplicates of the first; a role other than system,
    user and assistant goes by its initial. A conversation without rows, or all of whose rows were dropped, has zeros, an
    empty audit and the hash of the empty text. An empty table gives no rows; other columns are ignored.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    p = written(parts(rows, held), "conversation-parts")
    # a conversation at the edge of a range is closed only if no other range holds more of it; those few are put together
    parted = p.where("not whole")
    c = written(composed(parted, conv), "conversation-paths")
    sums = c.where("part is null")
    sha = hashed(parted.where("piece is not null"), c, conv)
    cols = ["conv_id", *COUNTS, "first_turn", "last_turn", "cost", "audit"]
    late = sums.select(*cols).join(sha, sums["conv_id"].eqNullSafe(sha["conv_id"])).select(*(sums[k] for k in cols), "sha")
    d = p.where("whole").select(*cols, "sha").unionByName(late)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return d.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given damage done to all of ``conversations``, and each conversation's faults and cheapest repair. Nulls, ties,
    repeated rows, empty tables and other columns: see ``damaged`` and ``repaired_conversations``."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired_conversations(damaged(rows))


#: The same by other means: an automaton of four states (nothing, a system turn, a user turn, an assistant turn before), all
#: edits of a turn joined on, and the least (cost, audit) of each state kept from turn to turn.
ORACLE_OP13 = r"""
with recursive bits(n, c, k) as (
  select i, cast(i as ubigint), 0 from range(256) t(i) union all
  select n, case when c % 2 = 1 then xor(c // 2, cast(3988292384 as ubigint)) else c // 2 end, k + 1 from bits where k < 8),
crcs as (select list(c order by n) t from bits where k = 8),
k0 as (select *, dense_rank() over (order by conv_id nulls first) cv, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) h from conversations),
k1 as (select cv, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(cast(4294967295 as ubigint), list_reduce(
         list_prepend(cast(4294967295 as ubigint), [cast('0x' || h[2 * i + 1 : 2 * i + 2] as ubigint) for i in range(length(h) // 2)]),
         lambda a, b: xor(a // 256, t[cast(xor(a % 256, b) as int) + 1]))) % 20 kind from k0, crcs),
d as (select cv, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) cp from k1),
o as (select *, row_number() over (partition by cv order by turn nulls first, role, md5(text), cp) n, rtrim(text, e' \t\n\x0b\x0c\r') seen from d),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by cv, role, text order by n) > 1 then 'duplicate'
        when right(seen, 1) not in ('.', '!', '?') then 'truncated' end fault, left(role, 1) ini, left(lag(role) over (partition by cv order by n), 1) || left(role, 1) two from o),
nxt(p, s, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, q, j, lines) as (values (0, 0, 0, []::varchar[]), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 1, 0, []), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']),
  (2, 2, 0, []), (2, 3, 1, ['assistant:']), (3, 3, 0, []), (3, 2, 1, ['user:'])),
edits as (
  select ins.p, ins.q, j, lines, 'D' e, null s, 4 cost from ins union all
  select ins.p, nxt.q, j, lines, 'K', s, 0 from ins join nxt on nxt.p = ins.q union all
  select ins.p, nxt.q, j, lines, 'R', s, 3 from ins join nxt on nxt.p = ins.q where s <> 's'),
w(cv, n, q, cost, audit, lines) as (
  select distinct cv, 0::bigint, 0, 0::bigint, '', []::varchar[] from k1 union all
  select cv, n, q, cost, audit, lines from (
    select w.cv, f.n, x.q, w.cost + 3 * x.j + x.cost + case when x.e <> 'D' and fault = 'truncated' then 3 else 0 end as cost, w.audit || repeat('I', x.j) || x.e as audit,
      w.lines || x.lines || case x.e when 'D' then [] when 'K' then [f.role || ':' || f.text] else [case x.s when 'u' then 'user:' else 'assistant:' end || f.text] end as lines
    from w join f on f.cv = w.cv and f.n = w.n + 1 join edits x on x.p = w.q
    where (x.e = 'D' or coalesce(fault, '') not in ('blank', 'duplicate')) and (x.e <> 'K' or x.s = ini) and (x.e <> 'R' or x.s <> ini))
  qualify row_number() over (partition by cv, q order by cost, audit) = 1),
z as (select cv, count(*) rows_, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
        count(*) filter (two not in ('su', 'ua', 'au')) illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps from f group by cv),
fin as (select w.cv, w.cost + 3 * j as cost, w.audit || repeat('I', j) as audit, w.lines || ins.lines as lines from w left join z on z.cv = w.cv join ins on ins.p = w.q and ins.q in (0, 3)
  where w.n = coalesce(rows_, 0) qualify row_number() over (partition by w.cv order by w.cost + 3 * j, w.audit || repeat('I', j)) = 1)
select i.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, cost, audit,
  sha256(array_to_string(fin.lines, chr(10))) repaired_sha256
from (select distinct cv, conv_id from k1) i join fin using (cv) left join z using (cv)"""
