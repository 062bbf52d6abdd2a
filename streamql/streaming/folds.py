"""What an updating operator keeps per key and shows for it: plain Python, no Spark.

A fold has start() -> state, add(state, row) -> state and table(state) -> list of output
rows (dicts). Rows are dicts; row_kind says whether a row comes or goes. Where state can be
large (values of an aggregate, sides of a join) it is a mapping that the caller provides.
"""

import dataclasses
from collections.abc import Callable

GOES = ("-U", "-D")


def signed(row) -> int:
    return -1 if row.get("row_kind") in GOES else 1


def nulls(value, first: bool):
    """A sort key that puts null first or last."""
    return (value is None) != first, 0 if value is None else value


def ordering(order):
    """Sort by (column, ascending, nulls first) triples, ties by arrival (stable)."""

    def sort(rows):
        rows = list(rows)
        for name, ascending, first in reversed(order):
            # Reversing the whole key would turn the place of nulls, too.
            some = [r for r in rows if r[name] is not None]
            none = [r for r in rows if r[name] is None]
            some.sort(key=lambda r: r[name], reverse=not ascending)
            rows = none + some if first else some + none
        return rows

    return sort


def _wrap(x, bits):
    return (x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


@dataclasses.dataclass
class Agg:
    """kind: count, sum, avg, min, max; column None counts rows; where filters rows; bits wraps integer sums."""

    kind: str
    column: str | None
    name: str
    distinct: bool = False
    where: Callable | None = None
    bits: int | None = None


@dataclasses.dataclass
class GroupAgg:
    """A retractable aggregate with one accumulator per aggregate.

    COUNT, SUM and AVG are scalars. Only DISTINCT, MIN and MAX need the values with their net
    counts: these stand in counts(i), a mapping, which in Spark reads and writes single
    entries of the state store. Of MIN and MAX the extreme is kept; the values are read over
    only when its last copy goes.
    """

    aggs: list[Agg]

    def start(self):
        """n: rows; per aggregate [values counted, their total, extreme]."""
        return {"n": 0, "accs": [[0, 0, None] for _ in self.aggs]}

    def add(self, state, row, counts):
        k = signed(row)
        state["n"] += k
        for i, (a, acc) in enumerate(zip(self.aggs, state["accs"])):
            v = 1 if a.column is None else row[a.column]
            if v is None or (a.where is not None and not a.where(row)):
                continue
            step = k
            if a.distinct or a.kind in ("min", "max"):
                values = counts(i)
                before = values.get(v, 0)
                after = before + k
                if after:
                    values[v] = after
                else:
                    del values[v]
                step = (after > 0) - (before > 0)
            if a.kind in ("min", "max"):
                acc[0] += step
                pick = min if a.kind == "min" else max
                if step > 0:
                    acc[2] = v if acc[2] is None else pick(acc[2], v)
                elif step < 0 and v == acc[2]:
                    acc[2] = pick((x for x, n in values.items() if n > 0), default=None)
            else:
                acc[0] += step
                if a.kind != "count":
                    acc[1] += v * step
        return state

    def table(self, state):
        return [{a.name: self._value(a, acc) for a, acc in zip(self.aggs, state["accs"])}] if state["n"] > 0 else []

    @staticmethod
    def _value(a, acc):
        n, total, extreme = acc
        if a.kind == "count":
            return n
        if a.kind in ("min", "max"):
            return extreme
        if not n:
            return None
        if a.kind == "sum":
            return _wrap(total, a.bits) if a.bits else total
        return (abs(total) // n * (1 if total >= 0 else -1)) if isinstance(total, int) else total / n


@dataclasses.dataclass
class TopN:
    """Rows offset + 1 .. n by order. row_key: a new row replaces the one with its key (update-fast)."""

    order: list
    n: int
    offset: int = 0
    rank: str | None = None
    row_key: list[str] | None = None

    def start(self):
        return []

    def add(self, state, row):
        body = {k: v for k, v in row.items() if k != "row_kind"}
        if self.row_key:
            state = [r for r in state if any(r[k] != body[k] for k in self.row_key)]
            return state if row.get("row_kind") == "-D" else state + [body]
        if signed(row) > 0:
            return state + [body]
        for i, r in enumerate(state):
            if r == body:
                return state[:i] + state[i + 1 :]
        return state

    def table(self, state):
        top = ordering(self.order)(state)[self.offset : self.n]
        return [r | {self.rank: self.offset + i + 1} for i, r in enumerate(top)] if self.rank else top


class AppendTopN(TopN):
    """For inputs that only grow: what can't be in the top any more is forgotten."""

    def add(self, state, row):
        return ordering(self.order)(super().add(state, row))[: self.n]


@dataclasses.dataclass
class Dedup:
    """First or last row of a key, by order_by (ties: first arrival when first, last when last) or by arrival."""

    keep: str = "first"
    order_by: str | None = None

    def start(self):
        return None

    def add(self, state, row):
        body = {k: v for k, v in row.items() if k != "row_kind"}
        if state is None:
            return body
        if self.order_by is None:
            return state if self.keep == "first" else body
        a, b = state[self.order_by], body[self.order_by]
        return (body if b < a else state) if self.keep == "first" else (body if b >= a else state)

    def table(self, state):
        return [] if state is None else [state]


class Normalize:
    """Upserts to a table: the key's last row, none once deleted."""

    def start(self):
        return None

    def add(self, state, row):
        if row.get("row_kind") == "-U":
            return state
        return None if row.get("row_kind") == "-D" else {k: v for k, v in row.items() if k != "row_kind"}

    def table(self, state):
        return [] if state is None else [state]


@dataclasses.dataclass
class Join:
    """An updating join, row by row. Each side is a mapping row -> [copies, matches on the other side].

    A row meets the other side of its key once; matches are counted, so that outer rows are padded
    when the first match goes and taken back when it comes. Nothing is matched anew.
    """

    how: str
    left: list[str]
    right: list[str]
    residual: Callable | None = None

    def add(self, row, side: str, sign: int, sides: dict):
        """(row kind sign, output row) of what row, a tuple of its side's columns, changes. sides: l and r -> mapping."""
        mine, other = sides[side], sides["r" if side == "l" else "l"]
        have = mine.get(row)
        if sign < 0 and not have:
            return
        own = dict(zip(self.left if side == "l" else self.right, row))
        outer_mine = self.how == "full" or self.how == ("left" if side == "l" else "right")
        outer_other = self.how == "full" or self.how == ("right" if side == "l" else "left")
        half = self.how in ("semi", "anti")
        matched = 0
        for their_row, (copies, met) in list(other.items()):
            theirs = dict(zip(self.right if side == "l" else self.left, their_row))
            pair = own | theirs if side == "l" else theirs | own
            if self.residual is not None and self.residual(*((own, theirs) if side == "l" else (theirs, own))) is not True:
                continue
            matched += copies
            if not half:
                for _ in range(copies):
                    yield sign, pair
            turns = met == 0 if sign > 0 else met == 1  # the other row gets its first match, or loses its last
            if turns and outer_other:
                padded = dict.fromkeys(self.left if side == "l" else self.right) | theirs
                for _ in range(copies):
                    yield -sign, padded
            if turns and half and side == "r":
                for _ in range(copies):
                    yield (sign if self.how == "semi" else -sign), theirs
            other[their_row] = [copies, met + sign]
        if outer_mine and not matched:
            yield sign, dict.fromkeys(self.right if side == "l" else self.left) | own
        if half and side == "l" and (matched > 0) == (self.how == "semi"):
            yield sign, own
        copies = (have[0] if have else 0) + sign
        if copies:
            mine[row] = [copies, matched]
        else:
            del mine[row]


def net(changes) -> list[dict]:
    """Changes (sign, row) of a batch as changelog rows; what cancels out is not emitted."""
    total, rows = {}, {}
    for sign, row in changes:
        k = repr(sorted(row.items(), key=lambda x: x[0]))
        total[k] = total.get(k, 0) + sign
        rows[k] = row
    out = [{"row_kind": "-D"} | rows[k] for k, n in total.items() for _ in range(-n)]
    return out + [{"row_kind": "+I"} | rows[k] for k, n in total.items() for _ in range(n)]


@dataclasses.dataclass
class Over:
    """Running aggregates in time order: functions name -> (kind, column), kind count, sum, avg, min or max.

    frame: None (unbounded, by RANGE: rows of one time share their result), ("rows", n) or
    ("range", width). Held is what later rows can still need: accumulators, or the last n
    rows, or those no older than width.
    """

    functions: dict[str, tuple[str, str | None]]
    frame: tuple | None = None

    def start(self):
        return [] if self.frame else {}

    def step(self, held, peers):
        """Take the rows of one time, (time, row) each, in order of arrival: what is held then, and the rows with their results."""
        if not self.frame:
            for name, (kind, column) in self.functions.items():
                held[name] = self._merged(kind, held.get(name), [r[column] if column else 1 for _, r in peers])
            return held, [r | {n: self._result(k, held[n]) for n, (k, _) in self.functions.items()} for _, r in peers]
        kind, size = self.frame
        out = []
        if kind == "range":
            now = peers[0][0]
            held = [x for x in held if x[0] >= now - size] + peers
            return held, [r | self._over(held) for _, r in peers]
        for t, r in peers:
            held = (held + [(t, r)])[-(size + 1) :]
            out.append(r | self._over(held))
        return held[-size:] if size else [], out

    def _over(self, rows):
        return {n: self._result(k, self._merged(k, None, [r[c] if c else 1 for _, r in rows])) for n, (k, c) in self.functions.items()}

    @staticmethod
    def _merged(kind, acc, values):
        values = [v for v in values if v is not None]
        if kind == "count":
            return (acc or 0) + len(values)
        if kind in ("min", "max"):
            values += [] if acc is None else [acc]
            return (min if kind == "min" else max)(values, default=None)
        n, total = acc or (0, 0)
        return n + len(values), total + sum(values)

    @staticmethod
    def _result(kind, acc):
        if kind not in ("sum", "avg"):
            return acc
        n, total = acc
        if not n:
            return None
        return total if kind == "sum" else (abs(total) // n * (1 if total >= 0 else -1)) if isinstance(total, int) else total / n


@dataclasses.dataclass
class Versions:
    """The versions of a key for a temporal join: (time, order, row or None once deleted), sorted. Keeps the last one before any time to come."""

    def add(self, held, time, order, row):
        held = [x for x in held if x[:2] != (time, order)] + [(time, order, row)]
        return sorted(held, key=lambda x: x[:2])

    def at(self, held, time):
        seen = [x for x in held if x[0] <= time]
        return seen[-1][2] if seen else None

    def evicted(self, held, time):
        """Without the versions that no row after time can ask for."""
        old = [x for x in held if x[0] <= time]
        return old[-1:] + held[len(old) :]


def changes(before: list[dict], after: list[dict], emit_update_before: bool = True) -> list[dict]:
    """The changelog between two tables of a key: what both hold gives nothing; the rest pairs up as updates."""
    gone, come = list(before), []
    for r in after:
        if r in gone:
            gone.remove(r)
        else:
            come.append(r)
    out = []
    for i in range(max(len(gone), len(come))):
        old, new = gone[i] if i < len(gone) else None, come[i] if i < len(come) else None
        if old is None:
            out.append({"row_kind": "+I"} | new)
        elif new is None:
            out.append({"row_kind": "-D"} | old)
        else:
            out += ([{"row_kind": "-U"} | old] if emit_update_before else []) + [{"row_kind": "+U"} | new]
    return out
