"""Streams in several micro-batches: timers that are set again, ends that move, rotation that can run again."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tapeworks.plans.stream_queries import keyed_state
from tapeworks.streaming import streams as T

NS = 1_000_000_000


def arrive(spark, folder, batches, schema, max_files=1):
    """A stream of files, one a batch, in order."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
        for f in os.listdir(f"{folder}/b{i}"):
            if f.endswith(".parquet"):
                os.rename(f"{folder}/b{i}/{f}", f"{folder}/{i}.parquet")
                os.utime(f"{folder}/{i}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return T.stream_feed(spark, f"{folder}/*.parquet", schema, max_files=max_files)


def test_heartbeats_by_timer(spark, tmp_path):
    beats = lambda s, *ts: [(s, int(t * NS)) for t in ts]
    batches = [
        beats("a", 0, 10, 20) + beats("b", 0, 5) + beats("clock", 20),
        beats("a", 60, 200) + beats("clock", 200),  # a is silent from 60 to 200, within a batch; b has been silent since 5
        beats("clock", 300),
        beats("b", 320) + beats("a", 210, 330) + beats("clock", 330),  # b is back, long after its alert; 210 comes late, but before a's timer
        beats("clock", 1000), beats("clock", 1001),
    ]
    s = arrive(spark, str(tmp_path / "in"), batches, "service string, t_ns long").withColumn("ts", F.timestamp_micros((F.col("t_ns") / 1000).cast("long"))).withWatermark("ts", "0 seconds")
    with keyed_state(spark):
        out = T.run_to_table(T.heartbeat_stream(s, 90), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["service"], r["t_ns"] // NS) for r in out.collect())
    # as in a batch over all beats, and the last ones of a and b: clock is silent from 20 to 200, 200 to 300 and 330 to 1000
    assert got == [("a", 60), ("a", 210), ("a", 330), ("b", 5), ("b", 320), ("clock", 20), ("clock", 200), ("clock", 330)]


def test_a_later_end_keeps_a_market_open(spark, tmp_path):
    row = lambda k, end, at: (k, "m" + k, end * 1000, at * NS)
    batches = [[row("1", 100, 0), row("2", 100, 0)], [row("1", 300, 50), row("2", 80, 50)], [row("9", 10_000, 200)], [row("9", 10_000, 210)], [row("9", 10_000, 400)], [row("9", 10_000, 410)]]
    s = arrive(spark, str(tmp_path / "in"), batches, "token_id string, market string, end_ms long, t_ns long").withColumn("ts", F.timestamp_micros((F.col("t_ns") / 1000).cast("long"))).drop("t_ns").withWatermark("ts", "0 seconds")
    seen, order = [], []
    with keyed_state(spark):
        T.active_set(s).writeStream.foreachBatch(lambda df, n: seen.extend((n, r["token_id"], r["change"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    order = {(k, c): n for n, k, c in seen}
    assert order["2", "remove"] < order["1", "remove"] and order["1", "remove"] >= 4 and [k for _, k, c in seen if c == "add"].count("1") == 1


def test_rotation_runs_again(spark, tmp_path):
    h = 3600
    rows = lambda *ts: [("f", t * NS, float(t)) for t in ts]
    batches = [rows(1, 2, h + 1), rows(h + 5, 2 * h, 3), rows(4 * h, h + 7), rows(5 * h)]
    s = arrive(spark, str(tmp_path / "in"), batches, "feed string, t_recv_ns long, mid double")
    root = str(tmp_path / "out")
    query, commit = T.rotate_finished(s, root, str(tmp_path / "cp"))
    query.awaitTermination()

    def state():
        read = lambda name: sorted((r["t_recv_ns"] // NS) for r in spark.read.schema("feed string, t_recv_ns long, mid double").parquet(f"{root}/{name}").collect())
        return read("hours"), read("late"), sorted(tuple(r) for r in spark.read.schema("mark bigint, batch bigint").parquet(f"{root}/marks").collect())

    want = ([1, 2, h + 1, h + 5, 2 * h, 4 * h], [3, h + 7], [(1, 0), (2, 1), (4, 2), (5, 3)])
    assert state() == want
    for n in (1, 3):  # as after a crash before the batch was recorded
        commit(spark.createDataFrame(batches[n], "feed string, t_recv_ns long, mid double"), n)
        assert state() == want
    assert spark.read.parquet(f"{root}/hours").select("date", "hour").distinct().count() == 4


@pytest.mark.parametrize("grace", [0, 2])
def test_rotation_waits(spark, tmp_path, grace):
    h = 3600 * NS
    s = arrive(spark, str(tmp_path / "in"), [[("f", k * h, 0.0) for k in range(5)]], "feed string, t_recv_ns long, mid double")
    query, _ = T.rotate_finished(s, str(tmp_path / "out"), str(tmp_path / "cp"), grace)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/hours")).count() == 4 - grace


def test_returns_across_batches(spark, tmp_path):
    import math

    batches = [[("a", 1 * NS, 100.0), ("b", 1 * NS, 10.0)], [("a", 3 * NS, 121.0), ("a", 2 * NS, 110.0), ("c", 9 * NS, 1.0)], [("a", 2 * NS, 50.0), ("b", 10 * NS, 20.0)]]
    s = arrive(spark, str(tmp_path / "in"), batches, "symbol string, t_ns long, mid double").withColumn("ts", F.timestamp_micros((F.col("t_ns") / 1000).cast("long"))).withWatermark("ts", "1 hour")
    with keyed_state(spark):
        out = T.run_to_table(T.stream_returns(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["symbol"], r["t_ns"] // NS): r["r"] for r in out.collect()}
    assert got == pytest.approx({("a", 2): math.log(1.1), ("a", 3): math.log(1.1), ("b", 10): math.log(2)})


class _State:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_returns_leave_in_bounded_frames():
    import numpy as np
    import pandas as pd

    from tapeworks.streaming import streams as T

    r = T._Returns()
    r.state, r.CHUNK = _State(), 7
    rng = np.random.default_rng(2)
    t, mid = rng.permutation(40) * 1000, rng.uniform(1, 2, 40)
    frames = [pd.DataFrame({"t_ns": t[i : i + 9], "mid": mid[i : i + 9]}) for i in range(0, 40, 9)]
    out = list(r.handleInputRows(("a",), iter(frames), None))
    assert max(map(len, out)) <= 7 and r.state.value == (39000, mid[t.argmax()])
    got = pd.concat(out)
    assert got["t_ns"].tolist() == list(range(1000, 40000, 1000)) and np.allclose(got["r"], np.diff(np.log(mid[t.argsort()])))


def test_inventory_of_a_bucket_of_tokens():
    import pandas as pd

    from tapeworks.streaming import streams as T

    n = T._Inventory()
    n.state = _State()
    batches = [[("a", 2, 0, 3.0), ("b", 1, 0, -1.0), (None, 1, 1, 4.0), ("a", 1, 0, 5.0)], [("c", 3, 0, 1.0), ("a", 3, 1, -2.0), (None, 4, 0, 1.0)]]
    got = []
    for rows in batches:
        p = pd.DataFrame(rows, columns=["token_id", "block_number", "log_index", "signed_size"]).assign(price=0.5)
        got.append({(x[0], x[1]): x[3] for f in n.handleInputRows((0,), iter([p[:2], p[2:]]), None) for x in f.itertuples(index=False)})
    assert got == [{("a", 1): 5.0, ("a", 2): 8.0, ("b", 1): -1.0, (None, 1): 4.0}, {("a", 3): 6.0, ("c", 3): 1.0, (None, 4): 5.0}]
