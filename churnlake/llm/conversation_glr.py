"""Repair of conversations by generalised LR parsing with weighted edits.

The roles of a conversation have to read ``(s?(ua)+)?``. Its grammar

    C -> (nothing) | H        H -> H P | s P | P        P -> u a

gives an LR(0) automaton. The parser keeps a graph-structured stack: every
live stack top is one node on a shared chain of nodes, and a row advances all
tops at once by each edit that is allowed (keep, rerole, delete), with inserts
before and after it. Tops in the same state have the same future, so equal
tops merge and the one of least (cost, audit) stays. Two audits of one cost
are never a prefix of one another (the letters fix the cost), so the order of
two merged audits stays the same whatever follows.

A conversation is read as a stream. What all live tops agree on is settled
and leaves, and a top that costs more than another plus the most it takes to
imitate its future is dropped, so mostly the rows of the last few undecided
edits are held, however long a conversation is. Only where the first edits
truly hang on the end (user rows alone: whether an answer is inserted early
goes by the parity of their number) the rows wait for it.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}

GRAMMAR = (("C", ()), ("C", ("H",)), ("H", ("H", "P")), ("H", ("s", "P")), ("H", ("P",)), ("P", ("u", "a")))
#: From any top, a future that another top allows costs at most this more (see ``tests``): the farthest are a
#: pair begun against nothing read yet (insert the answer, delete the system row that only the other can keep).
IMITATE = INSERT_COST + DELETE_COST


class Automaton:
    """LR(0) states of a grammar; a stack is a chain (state, below) that all tops share."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar, self.states, self.moves = grammar, [], {}
        self.start = self._state(frozenset((r, 0) for r, (left, _) in enumerate(grammar) if left == grammar[0][0]))
        self.bottom = (self.start, None)
        self.shift = functools.lru_cache(None)(self._shift)

    def _state(self, kernel) -> int:
        items, todo = set(kernel), list(kernel)
        while todo:
            r, dot = todo.pop()
            right = self.grammar[r][1]
            if dot < len(right):
                for new in ((q, 0) for q, (left, _) in enumerate(self.grammar) if left == right[dot]):
                    if new not in items:
                        items.add(new)
                        todo.append(new)
        items = frozenset(items)
        if items in self.states:
            return self.states.index(items)
        self.states.append(items)
        at = len(self.states) - 1
        for symbol in {self.grammar[r][1][d] for r, d in items if d < len(self.grammar[r][1])}:
            self.moves[at, symbol] = self._state(frozenset(
                (r, d + 1) for r, d in items if d < len(self.grammar[r][1]) and self.grammar[r][1][d] == symbol))
        return at

    def _reduce(self, stack, rule):
        left, right = self.grammar[rule]
        for _ in right:
            stack = stack[1]
        to = self.moves.get((stack[0], left))
        return None if to is None else (to, stack)

    def _shift(self, stack, terminal):
        """The stack after ``terminal`` and every reduction that ends there; None if it can't follow."""
        to = self.moves.get((stack[0], terminal))
        if to is None:
            return None
        stack = (to, stack)
        while True:
            done = [r for r, d in self.states[stack[0]] if d == len(self.grammar[r][1]) and self.grammar[r][0] != "C"]
            if not done:
                return stack
            stack = self._reduce(stack, done[0])

    def accepts(self, stack) -> bool:
        """Whether a rule of the start symbol ends at this top (with only the bottom below it)."""
        return any(self.grammar[r][0] == "C" and d == len(self.grammar[r][1]) for r, d in self.states[stack[0]])


AUTOMATON = Automaton()


def _merge(tops: dict, stack, cost: int, audit) -> bool:
    old = tops.get(stack[0])
    if old is None or (cost, audit) < old[:2]:
        tops[stack[0]] = (cost, audit, stack)
        return True
    return False


def _with_inserts(tops: tuple) -> dict:
    """Every top that inserts reach from ``tops`` (stack, cost), with its audit as (top it comes from, letters).

    The tops are in the order of their audits, none of which is a prefix of
    another (each ends with the edit of the same row), so the order of two
    audits is that of their tops and then of the letters since.
    """
    now = {stack[0]: (cost, (i, ""), stack) for i, (stack, cost) in enumerate(tops)}
    todo = list(now)
    while todo:  # costs only grow, so it ends
        cost, (i, letters), stack = now[todo.pop()]
        for t in NAMES:
            to = AUTOMATON.shift(stack, t)
            if to is not None and _merge(now, to, cost + INSERT_COST, (i, letters + INSERT)):
                todo.append(to[0])
    return now


@functools.lru_cache(1 << 14)
def advance(tops: tuple, initial: str, must_go: bool, truncated: bool):
    """One row: (cost that all share, new tops (stack, cost), where each comes from: (old top, letters))."""
    after: dict = {}
    for cost, (i, letters), stack in _with_inserts(tops).values():
        _merge(after, stack, cost + DELETE_COST, (i, letters + DELETE))
        if must_go:
            continue
        cost += TRUNCATED_COST * truncated
        to = AUTOMATON.shift(stack, initial)
        if to is not None:
            _merge(after, to, cost, (i, letters + KEEP))
        for t in NAMES:
            to = AUTOMATON.shift(stack, t)
            if to is not None:
                _merge(after, to, cost + REROLE_COST, (i, letters + REROLE))
    least = min(x[0] for x in after.values())
    left = sorted((audit, cost - least, stack) for cost, audit, stack in after.values() if cost <= least + IMITATE)
    return least, tuple((stack, cost) for _, cost, stack in left), tuple(audit for audit, _, _ in left)


@functools.lru_cache(1 << 14)
def finish(tops: tuple):
    """(cost, (top, letters)) of the best end."""
    return min(x[:2] for x in _with_inserts(tops).values() if AUTOMATON.accepts(x[2]))


def _letters(path) -> str:
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


class Repair:
    """The repair of one conversation; ``row`` and ``end`` return the rows that are settled by then."""

    def __init__(self):
        self.tops, self.paths = ((AUTOMATON.bottom, 0),), [None]  # a path: (letters of its last row, path before)
        self.stack, self.held, self.before = AUTOMATON.bottom, deque(), None
        self.cost, self.check = 0, 64

    def row(self, turn, role: str, text: str, seen: bool):
        """``seen``: an earlier turn has this role and text; an equal row just before it in its turn is noticed here."""
        body = text.rstrip(SPACE)
        same, self.before = self.before == (turn, role, text), (turn, role, text)
        fault = "blank" if not body else "duplicate" if seen or same else "truncated" if body[-1] not in ".!?" else None
        must_go = fault in ("blank", "duplicate")
        self.held.append((turn, role, text, fault))
        cost, self.tops, sources = advance(self.tops, role[:1], must_go, fault == "truncated")
        self.cost += cost
        settled = None
        if len({i for i, _ in sources}) == 1:  # all tops come from one
            settled = self.paths[sources[0][0]]
            self.paths = [(letters, None) for _, letters in sources]
        else:
            self.paths = [(letters, self.paths[i]) for i, letters in sources]
            if len(self.held) >= self.check:
                settled = self._shared()
        return self._settle(_letters(settled))

    def end(self):
        cost, (i, letters) = finish(self.tops)
        self.cost += cost
        return self._settle(_letters(self.paths[i]) + letters)

    def _shared(self):
        """The path that all tops have in common, cut off; looked for again when twice as many rows wait."""
        heads, back = list(self.paths), []
        while heads[0] is not None and any(h is not heads[0] for h in heads):
            back.append([h[0] for h in heads])
            heads = [h[1] for h in heads]
        self.check = max(64, 2 * len(back))
        if heads[0] is None:
            return None
        paths = [None] * len(heads)
        made: dict = {}
        for row in reversed(back):  # shared parts stay shared
            made = {(letters, id(p)): (letters, p) for letters, p in zip(row, paths)} | made
            paths = [made[letters, id(p)] for letters, p in zip(row, paths)]
        self.paths = paths
        return heads[0]

    def _settle(self, letters: str):
        out = []
        for x in letters:
            if x == INSERT:
                t = next(t for t in NAMES if AUTOMATON.shift(self.stack, t) is not None)
                out.append((None, None, None, x, NAMES[t], ""))
                self.stack = AUTOMATON.shift(self.stack, t)
                continue
            turn, role, text, fault = self.held.popleft()
            if x == DELETE:
                out.append((turn, role, fault, x, None, None))
                continue
            t = role[:1] if x == KEEP else next(t for t in NAMES if AUTOMATON.shift(self.stack, t) is not None)
            self.stack = AUTOMATON.shift(self.stack, t)
            out.append((turn, role, fault, x, role if x == KEEP else NAMES[t], text))
        return out


def damage(convs: DataFrame) -> DataFrame:
    """Rows of ``convs`` with nulls as one space and faults by crc32 of ``conv_id:turn`` modulo 20, and ``alive``.

    0: dropped (it stays as a row that is not alive, so that its conversation
    is known), 1: empty text, 2: without ``.!?``, 3: twice, 4: role user.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20)).cast("int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = convs.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        text.alias("text"), kind.alias("__kind"))
    k = F.col("__kind")
    return rows.select(
        "conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(k.isin(0, 1), F.lit("")).when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(k == 0, F.array(F.lit(False))).when(k == 3, F.array(F.lit(True), F.lit(True)))
                  .otherwise(F.array(F.lit(True)))).alias("alive"))


REPAIRED = ("conv_id long, turn long, was string, fault string, edit string, role string, text string, "
            "position long, cost long")


def _repaired(batches):
    """Sorted rows (conv_id, turn, role, text, alive, seen) -> rows of ``REPAIRED``, the last of a conversation with its cost."""
    out, conv, state, at = [], (), None, 0

    def emit(rows):
        nonlocal at
        for r in rows:
            out.append((*conv, *r, at, None))
            at += 1

    def close():
        if state is not None:
            emit(state.end())
            out.append((*conv, None, None, None, None, None, None, at, state.cost))

    for b in batches:
        for conv_id, turn, role, text, alive, seen in zip(*(c.to_pylist() for c in b.columns)):
            if conv != (conv_id,):
                close()
                conv, state, at = (conv_id,), Repair(), 0
            if alive:
                emit(state.row(turn, role, text, seen))
            if len(out) >= 5000:
                yield _batch(out)
                out.clear()
    close()
    if out:
        yield _batch(out)


_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("was", pa.string()), ("fault", pa.string()),
                    ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("position", pa.int64()),
                    ("cost", pa.int64())])


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def repair_conversations(convs: DataFrame) -> DataFrame:
    """Cheapest repair of every conversation, in order: one row per edit and a last row with the cost.

    ``convs`` has conv_id, turn, role, text and, optionally, ``alive`` (false:
    the row only names its conversation). Result: conv_id, turn and ``was``
    (role) of the row that an edit is about (null for inserts), its first
    ``fault`` (blank, duplicate, truncated), ``edit`` (K, R, D, I), ``role``
    and ``text`` afterwards (null if deleted), ``position`` of the edit; then a
    row without an edit that carries ``cost``. The rows of a conversation
    follow each other in one partition.

    Defined results: a null conv_id is a conversation of its own; rows go by
    turn (nulls first), then role and text, so equal rows are neighbours; null
    role or text is one space; a conversation without a row that is alive costs
    0; extra columns are ignored; an empty table gives an empty result. One
    conversation is read by one task, as a stream: its rows arrive sorted and
    only the undecided ones are held. Which rows repeat an earlier turn
    is found by grouping digests (MD5) of role and text before that.
    """
    alive = F.col("alive") if "alive" in convs.columns else F.lit(True)
    rows = convs.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), alive.alias("alive"))
    digest = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # nulls come first
    rows = rows.withColumn("__said", digest)
    again = rows.where("alive").groupBy("conv_id", "__said").agg(
        F.min(order).alias("first"), F.max(order).alias("last")).where("first < last") \
        .select(F.col("conv_id").alias("__conv"), F.col("__said").alias("__again"), F.col("first").alias("__first"))
    marked = rows.join(again, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__said") == F.col("__again")), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "alive",
                           F.coalesce(order > F.col("__first"), F.lit(False)).alias("seen"))
    dealt = marked.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(_repaired, REPAIRED)


DIGESTS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")


def _digests(batches):
    legal = {"su", "ua", "au"}
    out = []
    conv, fresh = None, True
    for b in batches:
        for conv_id, turn, was, fault, edit, role, text, _, cost in zip(*(c.to_pylist() for c in b.columns)):
            if fresh:
                conv, fresh = conv_id, False
                faults, illegal, initial = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
                low = high = None
                turns, audit, text_hash, kept = 0, [], hashlib.sha256(), 0
            if edit is None:
                gaps = high - low + 1 - turns if turns else 0
                out.append((conv, gaps, *faults.values(), illegal, cost, "".join(audit), text_hash.hexdigest()))
                fresh = True
                if len(out) >= 5000:
                    yield _digest_batch(out)
                    out = []
                continue
            audit.append(edit)
            if edit != INSERT:
                if fault:
                    faults[fault] += 1
                if initial is not None and initial + was[:1] not in legal:
                    illegal += 1
                initial = was[:1]
                if turn is not None and turn != high:  # turns come in order
                    low, high, turns = turn if low is None else low, turn, turns + 1
            if edit != DELETE:
                text_hash.update(f"{chr(10) if kept else ''}{role}:{text}".encode())
                kept += 1
    if out:
        yield _digest_batch(out)


_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
    ("repaired_sha256", pa.string())])


def _digest_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST_ARROW)],
                                      schema=_DIGEST_ARROW)


def repair_report(repaired: DataFrame) -> DataFrame:
    """One row per conversation from ``repair_conversations`` as it stands: faults, cost, audit and digest.

    gaps (missing numbers between the least and the largest turn), rows by
    first fault, ``illegal`` neighbours among the roles found, the edits'
    initials and the SHA-256 of the repaired ``role:text`` lines.
    """
    return repaired.mapInArrow(_digests, DIGESTS)
