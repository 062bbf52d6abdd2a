import datetime
import itertools
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from streamql.operators import changelog, joins, rank, windows
from streamql.sources import files
from streamql.streaming import folds, processors


def net(log):
    out = {}
    for r in log:
        k = tuple(sorted((a, b) for a, b in r.items() if a != "row_kind"))
        out[k] = out.get(k, 0) + folds.signed(r)
    return {k: n for k, n in out.items() if n}


class WithCounts:
    """GroupAgg with its values in plain dicts."""

    def __init__(self, fold):
        self.fold, self.table = fold, lambda s: fold.table(s[0])

    def start(self):
        return self.fold.start(), [{} for _ in self.fold.aggs]

    def add(self, state, row):
        return self.fold.add(state[0], row, state[1].__getitem__), state[1]


def run(fold, rows, cuts):
    """Feed rows in chunks; the emitted changelog."""
    state, log, at = fold.start(), [], 0
    for cut in [*cuts, len(rows)]:
        before = fold.table(state)
        for r in rows[at:cut]:
            state = fold.add(state, r)
        log += folds.changes(before, fold.table(state))
        at = cut
    return log, fold.table(state)


def test_every_chunking_gives_the_same_table():
    ops = [{"row_kind": k, "v": v} for k in ("+I", "-D") for v in (1, 2)]
    aggs = [folds.Agg("sum", "v", "s"), folds.Agg("min", "v", "lo"), folds.Agg("max", "v", "hi"), folds.Agg("count", "v", "d", distinct=True), folds.Agg("sum", "v", "sd", distinct=True)]
    kinds = [WithCounts(folds.GroupAgg(aggs)), folds.Normalize(), folds.TopN([("v", False, False)], 1), folds.Dedup("last")]
    for fold in kinds:
        for n in (1, 2, 3):
            for seq in itertools.product(ops, repeat=n):
                rows = list(seq)
                want = net({"row_kind": "+I"} | r for r in run(fold, rows, [])[1])
                for cuts in ([], [1], list(range(n))):
                    log, _ = run(fold, rows, cuts)
                    assert net(log) == want


def test_aggregates_against_all_values():
    rng = random.Random(1)
    aggs = [folds.Agg(k, "v", f"{k}{d}", distinct=d) for k in ("count", "sum", "avg", "min", "max") for d in (False, True)]
    fold = WithCounts(folds.GroupAgg(aggs))
    for _ in range(50):
        held, state = [], fold.start()
        for _ in range(40):
            if held and rng.random() < 0.45:
                v = held.pop(rng.randrange(len(held)))
                state = fold.add(state, {"v": v, "row_kind": "-U"})
            else:
                held.append(rng.choice([None, -3, 1, 1, 4, 9]))
                state = fold.add(state, {"v": held[-1]})
            some = [v for v in held if v is not None]
            want = {}
            for d, values in ((False, some), (True, sorted(set(some)))):
                total = sum(values)
                want |= {f"count{d}": len(values), f"sum{d}": total if values else None, f"avg{d}": int(total / len(values)) if values else None, f"min{d}": min(values, default=None), f"max{d}": max(values, default=None)}
            assert fold.table(state) == ([want] if held else [])


def test_folds():
    g = WithCounts(folds.GroupAgg([folds.Agg("avg", "v", "a"), folds.Agg("sum", "v", "s", bits=16)]))
    assert run(g, [{"v": -3}, {"v": -4}, {"v": 30000}, {"v": 30000}], [])[1] == [{"a": 14998, "s": -5543}]
    assert folds.ordering([("v", False, False)])([{"v": None}, {"v": 1}, {"v": 3}]) == [{"v": 3}, {"v": 1}, {"v": None}]
    fast = folds.TopN([("v", False, False)], 2, row_key=["k"])
    assert run(fast, [{"k": 1, "v": 5}, {"k": 2, "v": 7}, {"k": 3, "v": 6}, {"k": 2, "v": 1}], [2])[1] == [{"k": 3, "v": 6}, {"k": 1, "v": 5}]
    v = folds.Versions()
    held = []
    for t, r in [(5, "b"), (1, "a"), (9, "d"), (5, "c")]:
        held = v.add(held, t, len(held), r)
    assert [v.at(held, t) for t in (0, 1, 4, 5, 8, 9)] == [None, "a", "a", "c", "c", "d"]
    assert [v.at(v.evicted(held, 6), t) for t in (6, 9)] == ["c", "d"] and len(v.evicted(held, 6)) == 2


def joined(how, left, right, residual):
    """The whole join, from all rows."""
    pad = lambda names, row: dict.fromkeys(names) | row
    hit = lambda a, b: residual is None or residual(a, b)
    if how in ("semi", "anti"):
        return [a for a in left if any(hit(a, b) for b in right) == (how == "semi")]
    out = [a | b for a in left for b in right if hit(a, b)]
    out += [pad(["b"], a) for a in left if how in ("left", "full") and not any(hit(a, b) for b in right)]
    return out + [pad(["a"], b) for b in right if how in ("right", "full") and not any(hit(a, b) for a in left)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_join_row_by_row(how):
    rng = random.Random(2)
    for residual in (None, lambda a, b: a["a"] >= b["b"]):
        fold = folds.Join(how, ["a"], ["b"], residual)
        for _ in range(60):
            sides, log, have = {"l": {}, "r": {}}, [], {"l": [], "r": []}
            for _ in range(14):
                side, found = rng.choice("lr"), []
                for _ in range(rng.randint(1, 3)):
                    name = "a" if side == "l" else "b"
                    if have[side] and rng.random() < 0.4:
                        row, sign = have[side].pop(rng.randrange(len(have[side]))), -1
                    else:
                        row, sign = {name: rng.randint(0, 3)}, 1
                        have[side].append(row)
                    found += fold.add((row[name],), side, sign, sides)
                log += folds.net(found)
                assert net(log) == net({"row_kind": "+I"} | r for r in joined(how, have["l"], have["r"], residual))


def test_over_step_by_step():
    rng = random.Random(3)
    functions = {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "a": ("avg", "v"), "rows": ("count", None)}

    def of(values, n):
        some = [v for v in values if v is not None]
        total = sum(some)
        return {"s": total if some else None, "n": len(some), "lo": min(some, default=None), "hi": max(some, default=None), "a": int(total / len(some)) if some else None, "rows": n}

    for frame in (None, ("rows", 0), ("rows", 2), ("range", 3)):
        rows = [(t, {"v": rng.choice([None, -2, 5, 7])}) for t in sorted(rng.randint(0, 30) for _ in range(60))]
        fold, out = folds.Over(functions, frame), []
        held = fold.start()
        for _, peers in itertools.groupby(rows, key=lambda x: x[0]):
            held, done = fold.step(held, list(peers))
            out += done
        for i, (t, r) in enumerate(rows):
            if not frame:
                seen = [x["v"] for u, x in rows if u <= t]
            elif frame[0] == "rows":
                seen = [x["v"] for _, x in rows[max(0, i - frame[1]) : i + 1]]
            else:
                seen = [x["v"] for u, x in rows if t - frame[1] <= u <= t]
            assert out[i] == r | of(seen, len(seen)), frame
        assert not frame or len(held) <= max(2, len(rows) // 2)


@pytest.fixture()
def one_partition(spark):
    """Each partition of each batch starts its own state worker: one will do."""
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    processors.configure(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", n)


@pytest.fixture()
def source(spark, tmp_path, one_partition):
    """The same rows as a table and as a stream of several files."""
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 5), rng.choice(["+I", "+I", "+U"]), rng.choice([None, 2**60 + rng.randint(0, 50)])) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, k long, row_kind string, v long")
    for i in range(2):
        df.where(F.col("seq").between(30 * i, 30 * i + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, streamer(spark, df.schema, tmp_path)


def streamer(spark, schema, tmp_path):
    def streamed(build, name, mode="update"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        streamed.query = q
        return spark.table(name)

    return streamed


def plain(d):
    return sorted(map(str, map(tuple, d.collect())))


def test_streaming_equals_batch(source):
    df, streamed = source
    got = changelog.collapse(streamed(lambda s: processors.group_agg(s, ["k"], [folds.Agg("sum", "v", "s", bits=64), folds.Agg("min", "v", "lo"), folds.Agg("count", "v", "d", distinct=True)], "k long, s long, lo long, d long", seq="seq"), "g"))
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    rows = [r for r in df.collect()]
    want = []
    for k in sorted({r.k for r in rows}):
        v = [r.v for r in rows if r.k == k and r.v is not None]
        want.append((k, wrap(sum(v)) if v else None, min(v, default=None), len(set(v))))
    assert plain(got) == sorted(map(str, want))
    m = processors.metrics(streamed.query)
    assert m["rows_in"] == 60 and m["batches"] >= 2 and m["state_rows"] > 0
    got = changelog.collapse(streamed(lambda s: processors.normalize(s, ["k"], "k long, seq long, v long", seq="seq"), "n"))
    assert plain(got.select("k", "seq", "v")) == plain(changelog.normalize(df, ["k"], "seq").select("k", "seq", "v"))


def test_streaming_ranks(source):
    df, streamed = source
    order = [("v", False, False), ("seq", True, True)]
    want = rank.topn(df, ["k"], [F.desc_nulls_last("v"), F.asc("seq")], 2).select("k", "seq", "v")
    got = changelog.collapse(streamed(lambda s: processors.topn(s.drop("row_kind"), ["k"], order, 2, "k long, seq long, v long", seq="seq"), "t1"))
    assert plain(got.select("k", "seq", "v")) == plain(want)
    signs = df.withColumn("gone", F.col("seq") % 3 == 0)
    taken = lambda s: s.withColumn("row_kind", F.explode(F.when(F.col("seq") % 3 == 0, F.array(F.lit("+I"), F.lit("-D"))).otherwise(F.array(F.lit("+I")))))
    got = changelog.collapse(streamed(lambda s: processors.topn(taken(s), ["k"], order, 2, "k long, seq long, v long", input_mode="retract", seq="seq"), "t2"))
    want = rank.topn(signs.where("not gone"), ["k"], [F.desc_nulls_last("v"), F.asc("seq")], 2).select("k", "seq", "v")
    assert plain(got.select("k", "seq", "v")) == plain(want)
    keyed = lambda s: s.withColumn("key", F.col("seq") % 7).withColumn("row_kind", F.lit("+U"))
    got = changelog.collapse(streamed(lambda s: processors.topn(keyed(s), ["k"], order, 2, "k long, key long, seq long", input_mode="upsert", row_key=["key"], seq="seq"), "t3"))
    last = rank.dedup(keyed(df).drop("row_kind"), ["k", "key"], "seq", "seq", "last")
    assert plain(got.select("k", "key", "seq")) == plain(rank.topn(last, ["k"], [F.desc_nulls_last("v"), F.asc("seq")], 2).select("k", "key", "seq"))
    for keep in ("first", "last"):
        for by in ("seq", None):
            got = changelog.collapse(streamed(lambda s, k=keep, b=by: processors.dedup(s, ["k"], "k long, seq long", keep=k, order_by=b, seq="seq"), f"d_{keep}_{by}"))
            assert plain(got.select("k", "seq")) == plain(rank.dedup(df, ["k"], "seq", "seq", keep).select("k", "seq"))


@pytest.mark.parametrize("how", ["inner", "full", "anti"])
def test_streaming_join(source, how):
    df, streamed = source
    left = lambda s: s.where("seq % 2 = 0").select("k", F.col("seq").alias("a"))
    right = lambda s: s.where("seq % 2 = 1").select("k", F.col("seq").alias("b"))
    schema = "k long, a long, b long" if how != "anti" else "k long, a long"
    residual = lambda x, y: (x["a"] + y["b"]) % 3 == 0
    got = changelog.collapse(streamed(lambda s: processors.join(left(s), right(s), ["k"], how, schema, residual=residual), f"j_{how}"))
    one, two = left(df), right(df).withColumnRenamed("k", "k2")
    want = one.join(two, (one["k"] == two["k2"]) & ((F.col("a") + F.col("b")) % 3 == 0), {"anti": "left_anti"}.get(how, how))
    want = want.select(F.coalesce("k", "k2").alias("k"), "a", "b") if how != "anti" else want.select("k", "a")
    assert plain(got.select(*want.columns)) == plain(want)


def test_state_survives_a_restart(spark, source, tmp_path):
    """Half of the files, then the rest with the same checkpoint: the changelog goes on from the kept state."""
    df, _ = source
    first, second = tmp_path / "half", tmp_path / "out"
    build = lambda s: processors.group_agg(s, ["k"], [folds.Agg("count", None, "n"), folds.Agg("max", "seq", "hi")], "k long, n long, hi long")
    for low, high in ((0, 29), (30, 59)):
        df.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(str(first))
        q = build(spark.readStream.schema(df.schema).parquet(str(first))).writeStream.outputMode("update").foreachBatch(files.write_once(str(second))).option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start()
        q.awaitTermination()
    log = spark.read.parquet(str(second)).drop("batch")
    assert log.where("row_kind = '-U'").count() > 0
    assert plain(changelog.collapse(log)) == plain(df.groupBy("k").agg(F.count("*"), F.max("seq")))
    files.write_once(str(second))(log.limit(1), 0)
    assert spark.read.parquet(f"{second}/batch=0").count() == 1


def test_idle_state_expires(spark, tmp_path, one_partition):
    """A query with a TTL runs batch after batch, so it is stopped once it has shown what was awaited."""
    schema, folder = "k long, v long", str(tmp_path / "in")
    put = lambda: spark.createDataFrame([(1, 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    put()
    build = processors.group_agg(spark.readStream.schema(schema).parquet(folder), ["k"], [folds.Agg("count", None, "n")], "k long, n long", ttl_ms=2000)
    q = build.writeStream.outputMode("update").format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()

    def shown(n):
        until = time.time() + 40
        while time.time() < until and spark.table("ttl").count() < n:
            time.sleep(0.5)
        return [tuple(r) for r in spark.table("ttl").collect()]

    try:
        assert shown(1) == [("+I", 1, 1)]
        time.sleep(5)
        put()
        assert shown(2) == [("+I", 1, 1), ("+I", 1, 1)]
    finally:
        q.stop()


START = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def timed(spark, tmp_path, one_partition):
    """Rows in event time over two files, out of order within 30 seconds, then one row hours later that closes everything."""
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), START + datetime.timedelta(seconds=4 * i + rng.choice([0, 0, 7, 15])), rng.randint(0, 99)) for i in range(120)]
    last = (999, 99, START + datetime.timedelta(hours=3), 0)
    schema = "id long, k long, ts timestamp_ntz, v long"
    df = spark.createDataFrame([*rows, last], schema)
    for i in range(2):
        spark.createDataFrame(rows[60 * i : 60 * i + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([last], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df.where("k < 99"), streamer(spark, df.schema, tmp_path)


def marked(s):
    return processors.watermarked(s, "ts", "30 seconds")


def test_over_on_a_stream(timed):
    df, streamed = timed
    functions = {"s": ("sum", "v"), "n": ("count", None), "hi": ("max", "v")}
    w = Window.partitionBy("k").orderBy("m")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    for name, frame, over in (("o1", None, w.rangeBetween(Window.unboundedPreceding, 0)), ("o2", ("range", 20_000_000), w.rangeBetween(-20_000_000, 0))):
        got = streamed(lambda s, f=frame: processors.over(marked(s), ["k"], "ts", functions, "id long, k long, s long, n long, hi long", frame=f, idle_ms=60_000 if f else None), name, "append")
        want = df.withColumn("m", micros).select("id", "k", F.sum("v").over(over), F.count("*").over(over), F.max("v").over(over))
        assert plain(got.where("k < 99")) == plain(want)


def test_windows_on_a_stream(timed):
    df, streamed = timed
    aggs = lambda: [F.count("*").alias("n"), F.sum("v").alias("s")]
    got = streamed(lambda s: windows.stream_session_agg(marked(s), "ts", "6 seconds", ["k"], aggs()).drop("window_time"), "s1", "append")
    assert plain(got.where("k < 99")) == plain(windows.session_agg(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 seconds", ["k"], aggs()).drop("window_time"))
    part = lambda: {"n": (F.count("*"), "sum"), "hi": (F.max("v"), "max")}
    got = streamed(lambda s: windows.stream_cumulate_agg(marked(s), "ts", "1 minute", "4 minutes", ["k"], part()), "c1", "append")
    want = windows.cumulate_agg(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 minute", "4 minutes", ["k"], part())
    assert plain(got.where("k < 99")) == plain(want.select(*got.columns))


def test_joins_on_a_stream(timed):
    df, streamed = timed
    left = lambda s: s.where("id % 2 = 0 or k = 99").select(F.col("id").alias("a"), F.col("k").alias("ka"), F.col("ts").alias("ta"))
    right = lambda s: s.where("id % 2 = 1 or k = 99").select(F.col("id").alias("b"), F.col("k").alias("kb"), F.col("ts").alias("tb"))

    def near(s, how):
        one, two = left(s), right(s)
        return joins.interval_join(one, two, one["ka"] == two["kb"], one["ta"], two["tb"], "-10 SECONDS", "5 SECONDS", how).select("a", "b")

    for how in ("inner", "left"):
        got = streamed(lambda s, h=how: near(marked(s), h), f"i_{how}", "append")
        assert plain(got.where("a < 999")) == plain(near(df, how))

    probe = lambda s: s.where("id % 2 = 0 or k = 99").select("k", F.col("id").alias("a"), F.col("ts").alias("ta"))
    rates = lambda s: s.where("id % 2 = 1").select("k", F.col("id").alias("b"), F.col("ts").alias("tb"))
    got = streamed(lambda s: processors.temporal_join(probe(s), rates(s), ["k"], "ta", "tb", "k long, a long, b long", outer=True, delay="30 seconds"), "tj", "append")
    versions = rates(df).groupBy("k", "tb").agg(F.max("b").alias("b"))
    want = joins.temporal_join(probe(df), versions, ("k", "k"), "ta", "tb", {"b": "b"}, "left", seq="b").select("k", "a", "b")
    assert plain(got.where("k < 99")) == plain(want)


def test_late_rows_are_dropped(spark, tmp_path, one_partition):
    at = lambda s: START + datetime.timedelta(seconds=s)
    schema = "id long, k long, ts timestamp_ntz, v long"
    for part in ([(1, 0, at(0), 1), (2, 0, at(100), 1)], [(3, 0, at(101), 1)], [(4, 0, at(5), 1), (5, 0, at(102), 1)], [(9, 9, at(9000), 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streamed = streamer(spark, spark.createDataFrame([], schema).schema, tmp_path)
    got = streamed(lambda s: processors.over(processors.watermarked(s, "ts", "10 seconds"), ["k"], "ts", {"n": ("count", None)}, "id long, k long, n long"), "l1", "append")
    assert plain(got.where("k = 0")) == ["(1, 0, 1)", "(2, 0, 2)", "(3, 0, 3)", "(5, 0, 4)"]
    got = streamed(lambda s: windows.stream_window_agg(processors.watermarked(s, "ts", "10 seconds"), "ts", "1 minute", ["k"], [F.count("*").alias("n")]), "l2", "append")
    assert sorted(r.n for r in got.where("k = 0").collect()) == [1, 3]
    assert processors.metrics(streamed.query)["rows_late"] == 1


def test_watermarked_window(spark, tmp_path):
    rows = spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7) AS ts FROM range(100)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = processors.watermarked(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 second")
    out = windows.stream_window_agg(stream, "ts", "1 minute", [], [F.count("*").alias("n")])
    q = out.writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.window_start: r.n for r in spark.table("w").collect()}
    want = {r.window_start: r.n for r in windows.window_agg(windows.tumble(rows, "ts", "1 minute"), [], [F.count("*").alias("n")]).collect()}
    assert len(got) >= len(want) - 2 and all(want[k] == n for k, n in got.items())


def test_file_sinks_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, None, 2.5)], "id long, part string, v double")
    files.commit_partitions(df, str(tmp_path / "p"), ["part"])
    marks = sorted(str(x.parent.name) for x in (tmp_path / "p").glob("part=*/_SUCCESS"))
    assert marks == ["part=__HIVE_DEFAULT_PARTITION__", "part=a", "part=b"]
    assert plain(files.read_parquet(spark, str(tmp_path / "p"), df.schema).select("id", "part", "v")) == plain(df)
    for codec in ("snappy", "gzip", "zstd"):
        files.write_parquet(df, str(tmp_path / codec), compression=codec)
        assert plain(files.read_parquet(spark, str(tmp_path / codec), "id long, v double")) == plain(df.select("id", "v"))
    log = str(tmp_path / "log")
    for i in range(3):
        files.append_to_log(df.withColumn("n", F.lit(i)), log, partition_by=["part"])
    schema = "id long, v double, n int, part string"
    assert files.read_log(spark, log, schema, columns=["id", "n"]).count() == 9
    q = files.stream_parquet(files.read_log(spark, log, schema, stream=True, columns=["id", "n"]), str(tmp_path / "copy"), str(tmp_path / "cc"))
    q.awaitTermination()
    assert plain(spark.read.parquet(str(tmp_path / "copy"))) == plain(files.read_log(spark, log, schema, columns=["id", "n"]))


def test_kafka_shapes(spark):
    from streamql.sources import formats

    changes = spark.createDataFrame([("+I", 1, "a"), ("+U", 1, "b"), ("-D", 1, "b")], "row_kind string, id int, name string").coalesce(1)
    rows = [(r.key, r.value) for r in files.kafka_rows(changes, formats.encode_json, key=["id"]).collect()]
    assert rows == [(b'{"id":1}', b'{"id":1,"name":"a"}'), (b'{"id":1}', b'{"id":1,"name":"b"}'), (b'{"id":1}', None)]
    assert files.kafka_rows(changes, formats.encode_csv).first().value == b"1,a"
    assert files.batch_rows(files.kafka_rows(changes, formats.encode_json), 7).first().headers[0].value == b"7"
    made = files.kafka_options("h:1", topics=["a", "b"], startup="timestamp", timestamp=5, bounded=True)
    assert made == {"kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "startingTimestamp": "5", "endingOffsets": "latest"}
    for wrong in ({"topics": ["a"], "pattern": "x"}, {}, {"topics": ["a"], "startup": "never"}):
        with pytest.raises(ValueError):
            files.kafka_options("h:1", **wrong)
