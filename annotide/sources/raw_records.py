"""Rows that fail to parse: a minimum-cost error parse of undigested CSV records.

A record is parsed by a small automaton over its characters: which field it is in, whether within quotes, and what the
field holds so far. Dynamic programming over the record finds the fewest quotes and delimiters to insert or delete after
which it has the right number of columns, valid scores and a target. A row of cost zero loads. Otherwise the states that
the automaton reaches without any edit tell the reason (at which of its rules the parse breaks first), and the edits are
the detail.

Characters that no rule looks at are one symbol of the programme: an edit within them changes nothing that an edit
beside them does not. What a symbol may do, with any quotes and delimiters inserted before it, is a matrix of costs
between the automaton's fewer than a hundred states, made once; a record's table has a row of predecessors a symbol, so
time and memory are in proportion to its length, whatever that is. Only failing records go that far.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("preceding", "target", "following", "A1_Score", "A2_Score", "A3_Score")
SCORES = ("A1_Score", "A2_Score", "A3_Score")
LABELS = frozenset(("-1", "0", "1"))

# States of quoting: at the start of a field, within a plain one, within a quoted one, right after a quote inside a quoted one.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
# What a field holds so far: nothing but blanks, a minus sign, a label, a label and blanks, anything else.
_BLANK, _SIGN, _LABEL, _ENDED, _OTHER = range(5)
_SYMBOL = re.compile(r'[",01-]|\s+|[^",01\s-](?:[^",01-]*[^",01\s-])?')
_CLASSES = ('"', ",", "-", "0", "1", " ", "x")
#: An edit outweighs the odd places of a whole record.
_EDIT, _NEVER = 1 << 32, 1 << 61


def split_fields(record: str) -> list[str] | None:
    """The fields of a record that parses at cost zero, else None. A line break is ordinary text."""
    fields, at, n = [], 0, len(record)
    while True:
        if at < n and record[at] == '"':
            end = at + 1
            while True:
                end = record.find('"', end)
                if end < 0:
                    return None
                if record[end + 1 : end + 2] != '"':
                    break
                end += 2
            fields.append(record[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at == n:
                return fields
            if record[at] != ",":
                return None
        else:
            end = record.find(",", at)
            text = record[at:] if end < 0 else record[at:end]
            if '"' in text:
                return None
            fields.append(text)
            if end < 0:
                return fields
            at = end
        at += 1


def _step(state: int, char: str) -> int:
    """The next state of quoting, or -1 where the automaton has none."""
    if state == _START:
        return _QUOTED if char == '"' else _START if char == "," else _PLAIN
    if state == _PLAIN:
        return -1 if char == '"' else _START if char == "," else _PLAIN
    if state == _QUOTED:
        return _CLOSED if char == '"' else _QUOTED
    return _QUOTED if char == '"' else _START if char == "," else -1


def _hold(held: int, symbol: str) -> int:
    """What a field holds after one more symbol of its text."""
    if symbol.isspace():
        return {_BLANK: _BLANK, _LABEL: _ENDED, _ENDED: _ENDED}.get(held, _OTHER)
    if held == _BLANK and symbol in "-01":
        return _SIGN if symbol == "-" else _LABEL
    return _LABEL if held == _SIGN and symbol == "1" else _OTHER


class _Machine:
    """The automaton's states with the costs of moving between them over a symbol, inserting and deleting on the way.

    Of parses with equally many edits one with few odd places is taken: a delimiter is more likely to be text, and so
    to be deleted, where a blank follows it, and more likely to be missing where a blank stands. Further ties are
    settled by the order of the states.
    """

    def __init__(self, columns: int, scores: frozenset[int], target: int, typed: bool):
        self.columns, self.scores, self.target, self.typed = columns, scores, target, typed
        self.states = [(0, _START, _BLANK)]
        for state in self.states:  # grows while it is read
            for symbol in _CLASSES:
                to = self._next(state, symbol)
                if to is not None and to not in self.states:
                    self.states.append(to)
        self.number = {state: k for k, state in enumerate(self.states)}
        self.steps = {symbol: [self.number.get(self._next(s, symbol), -1) for s in self.states] for symbol in _CLASSES}
        self.final = np.array([f == columns - 1 and q != _QUOTED and self._ended(f, h) for f, q, h in self.states])
        self.inserted = {blank: self._closure(blank) for blank in (False, True)}
        # a delimiter has two matrices: with a blank after it, and without
        self.moves = {(symbol, after): self._over(symbol, after) for symbol in _CLASSES for after in (False, True) if symbol == "," or not after}

    def _ended(self, field: int, held: int) -> bool:
        """Whether a field may end with what it holds."""
        if not self.typed:
            return True
        return held in (_LABEL, _ENDED) if field in self.scores else held != _BLANK if field == self.target else True

    def _next(self, state: tuple[int, int, int], symbol: str) -> tuple[int, int, int] | None:
        """The state (field, quoting, held) after a symbol; None if there is none."""
        field, quoting, held = state
        to = _step(quoting, symbol)
        if to < 0:
            return None
        if symbol == "," and to == _START:
            return (field + 1, _START, _BLANK) if field + 1 < self.columns and self._ended(field, held) else None
        if not self.typed or field != self.target and field not in self.scores:
            return field, to, held
        if symbol == '"' and (quoting == _START or to == _CLOSED):  # opens or closes a field
            return field, to, held
        return field, to, _hold(held, symbol)

    def _closure(self, blank: bool) -> tuple[np.ndarray, np.ndarray]:
        """Least costs of reaching a state by insertions alone, and the state before the last of them."""
        n = len(self.states)
        cost = np.full((n, n), _NEVER, dtype=np.int64)
        np.fill_diagonal(cost, 0)
        before = np.tile(np.arange(n)[:, None], n)
        for _ in range(2 * self.columns + 2):  # no more insertions than that make sense in one place
            for symbol, price in (('"', _EDIT), (",", _EDIT + (not blank))):
                for s, to in enumerate(self.steps[symbol]):
                    if to >= 0 and not (symbol == "," and self.states[s][1] == _QUOTED):
                        better = cost[:, s] + price < cost[:, to]
                        cost[better, to] = cost[better, s] + price
                        before[better, to] = s
        return cost, before

    def _price(self, state: int, to: int, symbol: str, after: bool) -> int:
        """Of consuming a symbol: kept for nothing, or deleted."""
        if self.steps[symbol][state] == to:
            return 0
        if state == to and symbol in '",':
            return _EDIT + (symbol == "," and not after)
        return _NEVER

    def _over(self, symbol: str, after: bool) -> np.ndarray:
        cost, _ = self.inserted[symbol == " "]
        n = len(self.states)
        single = np.array([[self._price(s, t, symbol, after) for t in range(n)] for s in range(n)], dtype=np.int64)
        return np.minimum((cost[:, :, None] + single[None]).min(axis=1), _NEVER)

    def edits(self, record: str) -> list[tuple[str, int]] | None:
        """(what, place) of each edit, in order; None if no edits lead to a valid row."""
        found = list(_SYMBOL.finditer(record))
        kinds = [t if t in self.steps else " " if t.isspace() else "x" for t in (m.group() for m in found)]
        n, size = len(found), len(self.states)
        cost = np.full(size, _NEVER, dtype=np.int64)
        cost[0] = 0
        back = np.empty((n, size), dtype=np.uint8)
        columns = np.arange(size)
        afters = [k == "," and i + 1 < n and kinds[i + 1] == " " for i, k in enumerate(kinds)]
        for i in range(n):
            every = cost[:, None] + self.moves[kinds[i], afters[i]]
            back[i] = every.argmin(axis=0)
            cost = np.minimum(every[back[i], columns], _NEVER)
        last, _ = self.inserted[False]
        ends = np.where(self.final[None], cost[:, None] + last, _NEVER)
        state, to = np.unravel_index(int(ends.argmin()), ends.shape)
        if ends[state, to] >= _NEVER:
            return None
        edits = self._insertions(int(state), int(to), False, len(record))
        state = int(state)
        for i in range(n - 1, -1, -1):
            start = int(back[i, state])
            kind, after = kinds[i], afters[i]
            reached, _ = self.inserted[kind == " "]
            way = min(range(size), key=lambda u: reached[start, u] + self._price(u, state, kind, after))  # noqa: B023
            if self.steps[kind][way] != state:
                edits.append(("delete quote" if kind == '"' else "delete delimiter", found[i].start()))
            edits += self._insertions(start, way, kind == " ", found[i].start())
            state = start
        return edits[::-1]

    def _insertions(self, state: int, to: int, blank: bool, place: int) -> list[tuple[str, int]]:
        """The insertions that lead from one state to another, the last one first."""
        _, before = self.inserted[blank]
        told = []
        while to != state:
            s = int(before[state, to])
            told.append(("insert quote" if self.steps['"'][s] == to else "insert delimiter", place))
            to = s
        return told


@functools.lru_cache
def _machine(columns: int, scores: frozenset[int], target: int, typed: bool) -> _Machine:
    return _Machine(columns, scores, target, typed)


def cheapest_edits(record: str, fields: tuple[str, ...] = FIELDS, scores: tuple[str, ...] = SCORES, target: str = "target") -> tuple[list[tuple[str, int]], bool]:
    """The fewest edits that make a record a valid row, and True; if none do, those that make it a row of any values, and False.

    Each edit is (what, place); insertions stand before the character at their place.
    """
    where = frozenset(fields.index(s) for s in scores)
    for typed in (True, False):
        edits = _machine(len(fields), where, fields.index(target), typed).edits(record)
        if edits is not None:
            return edits, typed
    raise ValueError("a record always has a parse")


def _told(edits: list[tuple[str, int]]) -> str:
    return "; ".join(f"{what} at {at}" for what, at in edits)


def examine(record: str, fields: tuple[str, ...] = FIELDS, scores: tuple[str, ...] = SCORES, target: str = "target") -> tuple[str | None, str | None, int | None, list[str] | None]:
    """reason, detail, cost and fields of a record; a row that loads has no reason.

    The cost is the number of edits. A row whose columns are right but whose values aren't has its reason in the values;
    its parse costs nothing.
    """
    values = split_fields(record)
    if values is None or len(values) != len(fields):
        edits, _ = cheapest_edits(record, fields, scores, target)
        reason = "quoting" if values is None else "column_count"
        return reason, (f"{len(values)} fields; " if values is not None else "") + _told(edits), len(edits), None
    row = dict(zip(fields, values, strict=True))
    bad = [name for name in scores if row[name].strip() not in LABELS]
    if bad:
        return "score_value", ", ".join(f"{name}={row[name]!r}" for name in bad), 0, None
    if not row[target].strip():
        return "target_empty", f"{target}={row[target]!r}", 0, None
    return None, None, 0, values


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [examine(t) if t is not None else ("target_empty", "no record", 0, None) for t in batch.column(1).to_pylist()]
        columns = [pa.array([x[k] for x in seen], kind) for k, kind in ((0, pa.string()), (1, pa.string()), (2, pa.int32()))]
        values = [pa.array([x[3][k] if x[3] else None for x in seen], pa.string()) for k in range(len(FIELDS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *values], names=["key", "reason", "detail", "cost", *FIELDS])


def parsed_records(records: DataFrame, key: str = "raw_id", text: str = "raw_text") -> DataFrame:
    """``key``, reason, detail, cost and the six fields (null for a failing row) of every record.

    Every row of ``records`` gives one row, repeated ones included; keys may be null or repeated; a null text fails as
    ``target_empty``, an empty one as ``column_count``; other columns are ignored. Nothing is shuffled.
    """
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, reason string, detail string, cost int, " + ", ".join(f"{f} string" for f in FIELDS)
    return rows.mapInArrow(_parse, schema).withColumnRenamed("key", key)


def failed_records(parsed: DataFrame, key: str = "raw_id") -> DataFrame:
    """The rows set apart, with reason and detail."""
    return parsed.where("reason is not null").select(key, "reason", "detail", "cost")


def loaded_records(parsed: DataFrame, key: str = "raw_id") -> DataFrame:
    """The rows that load, scores stripped and typed."""
    typed = [F.trim(F.regexp_replace(s, "[^-01]", "")).cast("int").alias(s) for s in SCORES]
    return parsed.where("reason is null").select(key, *(f for f in FIELDS if f not in SCORES), *typed)
