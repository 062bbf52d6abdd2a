"""Updating and event-time operators on Structured Streaming, with state per key in the state store.

Updating operators emit, once per micro-batch and key, the changelog from what the key
showed before to what it shows now. Event-time operators (over, temporal_join) hold rows
back until the watermark has passed them, emit each once and forget what no later row can
need. Rows go in and out as Spark rows, so numbers keep all their digits. Needs the RocksDB
state store (see configure()), which keeps state beyond memory and reads single entries.
"""

import datetime
import pickle

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import folds


def configure(spark: SparkSession) -> None:
    """Session settings that the processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time with a watermark of max - delay; a time without zone is read as UTC, as watermarks need instants."""
    kind = df.schema[ts].dataType
    return (df.withColumn(ts, df[ts].cast("timestamp")) if isinstance(kind, T.TimestampNTZType) else df).withWatermark(ts, delay)


class _Keyed(StatefulProcessor):
    """What the processors share: rows as dicts, rows out by name."""

    keys, columns, seq = [], [], None

    def batch(self, rows):
        found = [r.asDict() for r in rows]
        return sorted(found, key=lambda r: r[self.seq]) if self.seq else found

    def out(self, key, rows):
        by, make = dict(zip(self.keys, key)), Row(*self.columns)
        for r in rows:
            yield make(*(by[c] if c in by else r.get(c) for c in self.columns))

    def close(self) -> None:
        pass


class KeyedChangelog(_Keyed):
    """A fold whose state is small: one value per key."""

    def __init__(self, fold, keys, columns, seq=None, emit_update_before=True, ttl_ms=None):
        self.fold, self.keys, self.columns, self.seq = fold, keys, columns, seq
        self.before, self.ttl = emit_update_before, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "data binary", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.fold.start()
        old = self.fold.table(state)
        for r in self.batch(rows):
            state = self.fold.add(state, r)
        self.state.update((pickle.dumps(state),))
        yield from self.out(key, folds.changes(old, self.fold.table(state), self.before))


class _Counts:
    """The values of one aggregate: entries (aggregate, value) -> count of a map state."""

    def __init__(self, state, number):
        self.state, self.number = state, number

    def _key(self, v):
        return (self.number, pickle.dumps(v))

    def get(self, v, default):
        k = self._key(v)
        return self.state.getValue(k)[0] if self.state.containsKey(k) else default

    def __setitem__(self, v, n):
        self.state.updateValue(self._key(v), (n,))

    def __delitem__(self, v):
        self.state.removeKey(self._key(v))

    def items(self):
        return [(pickle.loads(k[1]), n[0]) for k, n in self.state.iterator() if k[0] == self.number]


class KeyedAggregate(_Keyed):
    """GroupAgg: accumulators as one small value, counts of values as single entries."""

    def __init__(self, fold, keys, columns, seq=None, emit_update_before=True, ttl_ms=None):
        self.fold, self.keys, self.columns, self.seq = fold, keys, columns, seq
        self.before, self.ttl = emit_update_before, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "data binary", self.ttl)
        self.values = handle.getMapState("values", "number int, value binary", "n long", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.fold.start()
        old = self.fold.table(state)
        counts = [_Counts(self.values, i) for i in range(len(self.fold.aggs))]
        for r in self.batch(rows):
            state = self.fold.add(state, r, counts.__getitem__)
        self.state.update((pickle.dumps(state),))
        yield from self.out(key, folds.changes(old, self.fold.table(state), self.before))


class _Side:
    """One side of a join: entries row -> (copies, matches) of a map state."""

    def __init__(self, state):
        self.state = state

    def get(self, row):
        k = (pickle.dumps(row),)
        return list(self.state.getValue(k)) if self.state.containsKey(k) else None

    def __setitem__(self, row, value):
        self.state.updateValue((pickle.dumps(row),), tuple(value))

    def __delitem__(self, row):
        self.state.removeKey((pickle.dumps(row),))

    def items(self):
        return [(pickle.loads(k[0]), list(v)) for k, v in self.state.iterator()]


class KeyedJoin(_Keyed):
    """An updating join: both sides as map states of their own, each with its own TTL."""

    def __init__(self, fold, keys, columns, seq=None, ttl_ms=None):
        self.fold, self.keys, self.columns, self.seq = fold, keys, columns, seq
        self.ttl = ttl_ms if isinstance(ttl_ms, tuple) else (ttl_ms, ttl_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = {s: _Side(handle.getMapState(s, "row binary", "copies long, matches long", ttl)) for s, ttl in zip("lr", self.ttl)}

    def handleInputRows(self, key, rows, timerValues):
        found = []
        for r in self.batch(rows):
            names = self.fold.left if r["side"] == "l" else self.fold.right
            found += self.fold.add(tuple(r[c] for c in names), r["side"], folds.signed(r), self.sides)
        yield from self.out(key, folds.net(found))


def _micros(t: datetime.datetime) -> int:
    return int(t.timestamp()) * 1_000_000 + t.microsecond


class KeyedOver(_Keyed):
    """OVER aggregates by event time: rows wait under their millisecond until the watermark passes it."""

    def __init__(self, fold, keys, columns, ts, idle_ms=None):
        self.fold, self.keys, self.columns, self.ts, self.idle = fold, keys, columns, ts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "rows binary")
        self.held = handle.getValueState("held", "ms long, data binary")

    def handleInputRows(self, key, rows, timerValues):
        passed, come = timerValues.getCurrentWatermarkInMs(), {}
        for r in self.batch(rows):
            t = _micros(r[self.ts])
            ms = -(-t // 1000)
            if ms > passed:  # later rows are dropped
                come.setdefault(ms, []).append((t, r))
        for ms, some in come.items():
            old = pickle.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            if not old:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (pickle.dumps(old + some),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ms = expiredTimerInfo.getExpiryTimeInMs()
        last, held = (0, self.fold.start())
        if self.held.exists():
            last, data = self.held.get()
            held = pickle.loads(data)
        if not self.waiting.containsKey((ms,)):
            if self.idle is not None and last + self.idle <= ms:  # no row came for so long
                self.held.clear()
            return
        rows = sorted(pickle.loads(self.waiting.getValue((ms,))[0]), key=lambda x: x[0])
        self.waiting.removeKey((ms,))
        at, out = 0, []
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            held, done = self.fold.step(held, rows[at:end])
            out += done
            at = end
        self.held.update((ms, pickle.dumps(held)))
        if self.idle is not None:
            self.handle.registerTimer(ms + self.idle)
        yield from self.out(key, out)


class KeyedTemporalJoin(_Keyed):
    """Probes wait until the watermark has passed them, so no earlier version can come; old versions are forgotten."""

    def __init__(self, fold, keys, columns, left, right, outer):
        self.fold, self.keys, self.columns, self.left, self.right, self.outer = fold, keys, columns, left, right, outer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "rows binary")
        self.versions = handle.getValueState("versions", "data binary")

    def _held(self):
        return pickle.loads(self.versions.get()[0]) if self.versions.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        passed, held, come = timerValues.getCurrentWatermarkInMs(), self._held(), {}
        for i, r in enumerate(self.batch(rows)):
            t = _micros(r["_ts"])
            if r["side"] == "r":
                held = self.fold.add(held, t, len(held) + i, None if folds.signed(r) < 0 else {k: r[k] for k in self.right})
            elif -(-t // 1000) > passed:
                come.setdefault(-(-t // 1000), []).append((t, {k: r[k] for k in self.left}))
        # Timers fire after this, so probes that the watermark has passed may still wait for their versions.
        asked = min((k[0] - 1 for k in self.waiting.keys()), default=passed)
        self.versions.update((pickle.dumps(self.fold.evicted(held, min(passed, asked) * 1000)),))
        for ms, some in come.items():
            old = pickle.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            if not old:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (pickle.dumps(old + some),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ms, held, out = expiredTimerInfo.getExpiryTimeInMs(), self._held(), []
        for t, probe in pickle.loads(self.waiting.getValue((ms,))[0]):
            v = self.fold.at(held, t)
            if v is not None or self.outer:
                out.append(probe | (v or dict.fromkeys(self.right)))
        self.waiting.removeKey((ms,))
        self.versions.update((pickle.dumps(self.fold.evicted(held, ms * 1000)),))
        yield from self.out(key, out)


def _changelog(schema: str) -> T.StructType:
    return T._parse_datatype_string("row_kind string, " + schema)


def apply_fold(df: DataFrame, keys: list[str], fold, schema: str, *, seq: str | None = None, emit_update_before: bool = True, ttl_ms: int | None = None, processor=KeyedChangelog) -> DataFrame:
    """df as a changelog of fold's tables. schema: the output columns after row_kind. Rows of one batch are taken in seq order."""
    out = _changelog(schema)
    return df.groupBy(*keys).transformWithState(processor(fold, keys, out.names, seq, emit_update_before, ttl_ms), out, "Update", "ProcessingTime" if ttl_ms else "None")


def tagged(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two inputs as one, with `side` l or r; the keys have one name, other columns are null on the other side."""
    return left.withColumn("side", F.lit("l")).unionByName(right.withColumn("side", F.lit("r")), allowMissingColumns=True).dropna(subset=keys)


def group_agg(df: DataFrame, keys: list[str], aggs: list[folds.Agg], schema: str, **options) -> DataFrame:
    return apply_fold(df, keys, folds.GroupAgg(aggs), schema, processor=KeyedAggregate, **options)


def topn(df: DataFrame, partition_by: list[str], order: list, n: int, schema: str, *, input_mode: str = "append", offset: int = 0, rank: str | None = None, row_key=None, **options) -> DataFrame:
    """input_mode: append (only the top is kept), retract or upsert (rows replaced by row_key; all rows of a partition are kept)."""
    kind = folds.AppendTopN if input_mode == "append" else folds.TopN
    return apply_fold(df, partition_by, kind(order, n, offset, rank, row_key if input_mode == "upsert" else None), schema, **options)


def dedup(df: DataFrame, keys: list[str], schema: str, *, keep: str = "first", order_by: str | None = None, **options) -> DataFrame:
    """order_by None: by arrival (processing time)."""
    return apply_fold(df, keys, folds.Dedup(keep, order_by), schema, **options)


def normalize(df: DataFrame, keys: list[str], schema: str, **options) -> DataFrame:
    return apply_fold(df, keys, folds.Normalize(), schema, **options)


def join(left: DataFrame, right: DataFrame, keys: list[str], how: str, schema: str, *, residual=None, seq: str | None = None, ttl_ms=None) -> DataFrame:
    """All of inner, left, right, full, semi, anti over changelogs; no watermark needed. ttl_ms: one for both sides, or (left, right)."""
    a = [c for c in left.columns if c not in (*keys, "row_kind", seq)]
    b = [c for c in right.columns if c not in (*keys, "row_kind", seq)]
    out, ttl = _changelog(schema), any(ttl_ms) if isinstance(ttl_ms, tuple) else ttl_ms
    return tagged(left, right, keys).groupBy(*keys).transformWithState(KeyedJoin(folds.Join(how, a, b, residual), keys, out.names, seq, ttl_ms), out, "Update", "ProcessingTime" if ttl else "None")


def over(df: DataFrame, keys: list[str], ts: str, functions: dict, schema: str, *, frame: tuple | None = None, idle_ms: int | None = None) -> DataFrame:
    """OVER aggregates of a watermarked stream, each row once, when the watermark has passed it.

    functions, frame: as in folds.Over, a range width in microseconds. idle_ms: a key without
    rows for so long, by event time, is forgotten.
    """
    out = T._parse_datatype_string(schema)
    return df.groupBy(*keys).transformWithState(KeyedOver(folds.Over(functions, frame), keys, out.names, ts, idle_ms), out, "Append", "EventTime")


def temporal_join(probe: DataFrame, versions: DataFrame, keys: list[str], probe_ts: str, version_ts: str, schema: str, *, outer: bool = False, delay: str = "0 seconds") -> DataFrame:
    """The version valid at each probe's time, emitted when the watermark (of both inputs, behind by delay) has passed the probe."""
    a = [c for c in probe.columns if c not in (*keys, "row_kind")]
    b = [c for c in versions.columns if c not in (*keys, "row_kind")]
    both = tagged(probe.withColumn("_ts", probe[probe_ts].cast("timestamp")), versions.withColumn("_ts", versions[version_ts].cast("timestamp")), keys).withWatermark("_ts", delay)
    out = T._parse_datatype_string(schema)
    return both.groupBy(*keys).transformWithState(KeyedTemporalJoin(folds.Versions(), keys, out.names, a, b, outer), out, "Append", "EventTime")


def metrics(query) -> dict:
    """Rows in, rows dropped as late, state rows and bytes, and seconds of a streaming query, summed over its progress."""
    out = {"rows_in": 0, "rows_late": 0, "state_rows": 0, "state_bytes": 0, "batches": 0, "ms": 0}
    for p in query.recentProgress:
        out["batches"] += 1
        out["rows_in"] += p["numInputRows"]
        out["ms"] += p["batchDuration"]
        states = p["stateOperators"]
        out["rows_late"] += sum(s["numRowsDroppedByWatermark"] for s in states)
        out["state_rows"], out["state_bytes"] = sum(s["numRowsTotal"] for s in states), sum(s["memoryUsedBytes"] for s in states)
    return out
