"""Structured Streaming: arrival of frames, deduplication, bars, sessions and keyed state. State is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import money as M


def stream_feed(spark: SparkSession, path: str, schema: str, kind: str = "parquet", max_files: int = 64) -> DataFrame:
    """Files as they arrive; JSON rows get their time of receipt."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if kind == "json":
        return r.json(path).withColumn("t_recv_ns", F.unix_micros(F.current_timestamp()) * 1000)
    return r.parquet(path)


def with_event_time(df: DataFrame, t_ns: str = "t_ns", late: str = "10 minutes") -> DataFrame:
    return df.withColumn("ts", M.ns_to_timestamp(F.col(t_ns))).withWatermark("ts", late)


def dedup_stream(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key within the watermark's delay; df has `ts` with a watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def dedup_chain(df: DataFrame) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(["block_hash", "log_index"])


def hourly_rotation(df: DataFrame, target: str, checkpoint: str):
    """Rows to hourly partitions by time of receipt; the sink's commit publishes whole files."""
    at = M.ns_to_timestamp(F.col("t_recv_ns"))
    out = df.withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")})
    return out.writeStream.partitionBy("feed", "date", "hour").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rotate_finished(df: DataFrame, root: str, checkpoint: str, grace_hours: int = 0, time: str = "t_recv_ns"):
    """A stream into hourly partitions of finished hours, `root`/hours, and a side output of rows that come after theirs, `root`/late.

    Hours before the latest one seen, less `grace_hours`, are finished: that is the mark, kept for each batch in `root`/marks. Rows of
    later hours wait in `root`/waiting by day and batch. What a batch does follows from its number and the marks of earlier ones, and
    each of its writes replaces its own partitions, so a batch that runs again after a failure leaves what it would have left; its mark
    comes last. Returns the started query and the function that commits a batch.
    """
    from pyspark.errors import AnalysisException

    hour = F.floor(F.col(time) / (3600 * M.NS)).cast("bigint")
    at = M.ns_to_timestamp(F.col("hour_no") * (3600 * M.NS))

    def write(rows: DataFrame, name: str, *by: str) -> None:
        rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{name}")

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        try:
            before = spark.read.schema("mark bigint, batch bigint").parquet(f"{root}/marks").where(F.col("batch") < number).agg(F.max("mark")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            before = None
        rows = batch.withColumn("hour_no", hour).withColumn("day_no", F.floor(F.col("hour_no") / 24).cast("bigint")).withColumn("batch", F.lit(number).cast("bigint"))
        last = rows.agg(F.max("hour_no")).first()[0]
        if last is None:
            return
        mark = max(last - grace_hours, before if before is not None else last - grace_hours)
        late = F.lit(False) if before is None else F.col("hour_no") < before
        write(rows.where(late).drop("hour_no", "day_no"), "late", "batch")
        write(rows.where(~late), "waiting", "day_no", "batch")
        waiting = spark.read.schema(f"{kept}, hour_no bigint, day_no bigint, batch bigint").parquet(f"{root}/waiting")
        ready = waiting.where((F.col("batch") <= number) & (F.col("hour_no") < mark) & (F.col("day_no") * 24 <= mark))
        if before is not None:
            ready = ready.where((F.col("hour_no") >= before) & (F.col("day_no") >= before // 24))
        write(ready.withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")}).drop("hour_no", "day_no", "batch"), "hours", "date", "hour")
        write(spark.createDataFrame([(mark, number)], "mark bigint, batch bigint"), "marks", "batch")

    return df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), commit


def late_flag(df: DataFrame, seconds: int = 10) -> DataFrame:
    """Late rows are marked, never dropped."""
    return df.withColumn("is_late", M.flag_backfilled(F.col("t_recv_ns"), F.col("t_ns"), seconds))


def stream_bars(df: DataFrame, width: str = "1 minute") -> DataFrame:
    g = df.groupBy(F.window("ts", width), "symbol").agg(F.max_by("mid", F.struct("t_ns", "mid")).alias("close"), F.count("*").alias("n"))
    return g.select("symbol", F.col("window.start").alias("start"), "close", "n")


class _Returns(StatefulProcessor):
    """A symbol's last price, from which the next one's log return is taken."""

    #: rows of a frame that is given back; a micro-batch's times and prices of a symbol are held as arrays, and nothing else of it
    CHUNK = 50_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "t_ns long, mid double")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        parts = [(p["t_ns"].to_numpy(np.int64), p["mid"].to_numpy(np.float64)) for p in rows]  # 16 bytes a row
        times, mids = (np.concatenate(x) for x in zip(*parts))
        del parts
        if self.state.exists():
            t, mid = self.state.get()
            times, mids = times[times > t], mids[times > t]  # what comes after its successor has no return
        else:
            mid = np.nan
        if not len(times):
            return
        at = np.lexsort((mids, times))
        times, mids = times[at], mids[at]
        del at
        self.state.update((int(times[-1]), float(mids[-1])))
        for i in range(0, len(times), self.CHUNK):
            t, m = times[i : i + self.CHUNK], mids[i : i + self.CHUNK]
            before = np.concatenate([[mid if i == 0 else mids[i - 1]], m[:-1]])
            out = pd.DataFrame({"symbol": key[0], "ts": pd.to_datetime(t // 1000, unit="us"), "t_ns": t, "r": np.log(m / before)})
            yield out[~np.isnan(before)]

    def close(self) -> None:
        pass


def stream_returns(df: DataFrame) -> DataFrame:
    """Ticks (symbol, t_ns, mid, ts with a watermark) -> (symbol, ts, t_ns, r): each tick's log return from the one before, across micro-batches."""
    return df.groupBy("symbol").transformWithStateInPandas(statefulProcessor=_Returns(), outputStructType="symbol string, ts timestamp, t_ns long, r double", outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")


def sliding_vol(df: DataFrame, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    g = df.groupBy(F.window("ts", width, step), "symbol").agg(F.avg(F.col("r") * F.col("r")).alias("mean_r2"), F.count("*").alias("n"))
    return g.select("symbol", F.col("window.start").alias("start"), "mean_r2", "n")


def uptime_sessions(df: DataFrame, gap: str = "90 seconds") -> DataFrame:
    g = df.groupBy(F.session_window("ts", gap), "service").agg(F.count("*").alias("n"))
    return g.select("service", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def enrich_stream(df: DataFrame, markets: DataFrame) -> DataFrame:
    """A static market table on live fills."""
    return df.join(markets, "token_id", "left")


def fill_print_join(fills: DataFrame, prints: DataFrame, bound: str = "INTERVAL 2 MINUTES") -> DataFrame:
    """Fills with their transaction's trade print, within a bound of time; both sides have `ts` with a watermark."""
    p = prints.select(F.col("tx_hash").alias("p_tx"), F.col("ts").alias("p_ts"), F.col("t_ns").alias("t_print_ns"))
    cond = F.expr(f"tx_hash = p_tx AND p_ts BETWEEN ts - {bound} AND ts + {bound}")
    return fills.join(p, cond, "leftOuter").drop("p_tx", "p_ts")


class _Inventory(StatefulProcessor):
    """Positions and last prices of the tokens of a bucket: one state and one call a bucket, for a call a token costs more than its rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("positions", "token_id array<string>, position array<double>, price array<double>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        p = pd.concat(list(rows), ignore_index=True).sort_values(["block_number", "log_index", "signed_size", "price"])
        known: dict = {}
        if self.state.exists():
            tokens, positions, prices = self.state.get()
            known = dict(zip(tokens, zip(positions, prices)))
        start = p["token_id"].map({t: v[0] for t, v in known.items()}).astype("float64").fillna(0.0)
        p["position"] = start + p.groupby("token_id", dropna=False, sort=False)["signed_size"].cumsum()
        last = p.drop_duplicates("token_id", keep="last")
        known |= {t: (float(x), float(price)) for t, x, price in zip(last["token_id"], last["position"], last["price"])}
        self.state.update((list(known), [v[0] for v in known.values()], [v[1] for v in known.values()]))
        yield p[["token_id", "block_number", "log_index", "position"]]

    def close(self) -> None:
        pass


def stream_inventory(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """Running position of each token; rows of a batch in the order of block and log, then size and price.

    Tokens are dealt over `buckets` by their hash; the number must stay for the life of a checkpoint.
    """
    bucket = F.pmod(F.xxhash64("token_id"), F.lit(buckets)).cast("int")
    return df.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Inventory(), outputStructType="token_id string, block_number long, log_index int, position double", outputMode="Append", timeMode="None")


class _ActiveSet(StatefulProcessor):
    """A token's market from its announcement until its end passes, by event time; a later end moves it, an earlier one doesn't."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("market", "market string, end_ms long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        p = pd.concat(list(rows)).sort_values("ts")
        last, now = p.iloc[-1], timerValues.getCurrentWatermarkInMs()
        end = int(last["end_ms"])
        if self.state.exists():
            market, until = self.state.get()
            if end > until:  # announced again with a later end
                self.handle.deleteTimer(until)
                self.handle.registerTimer(end)
                self.state.update((market, end))
        elif end > now:
            self.state.update((str(last["market"]), end))
            self.handle.registerTimer(end)
            yield pd.DataFrame({"token_id": [key[0]], "market": [last["market"]], "change": ["add"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.state.exists():
            market = self.state.get()[0]
            self.state.clear()
            yield pd.DataFrame({"token_id": [key[0]], "market": [market], "change": ["remove"]})

    def close(self) -> None:
        pass


def active_set(df: DataFrame) -> DataFrame:
    """Announcements (token_id, market, end_ms, ts with a watermark) -> add and remove changes of the active set."""
    return df.groupBy("token_id").transformWithStateInPandas(statefulProcessor=_ActiveSet(), outputStructType="token_id string, market string, change string", outputMode="Append", timeMode="EventTime")


class _Heartbeat(StatefulProcessor):
    """A service's last beat, with a timer that is set again at each beat and fires when none comes."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", "t_ns long, alerted boolean")

    def due(self, t_ns: int) -> int:
        """The millisecond at which a beat has been the last for longer than allowed."""
        return t_ns // 1_000_000 + self.silent_ms + 1

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        times = np.sort(np.concatenate([p["t_ns"].to_numpy() for p in rows]))
        last, alerted = self.state.get() if self.state.exists() else (None, False)
        times = times if last is None else times[times > last]  # what comes late can't undo an alert
        if not len(times):
            return
        if last is not None:
            if not alerted:
                self.handle.deleteTimer(self.due(last))
            times = np.concatenate([[last], times])
        silent = np.flatnonzero(np.diff(times) > self.silent_ms * 1_000_000)
        missed = [int(times[i]) for i in silent if not (alerted and last is not None and i == 0)]
        self.state.update((int(times[-1]), False))
        self.handle.registerTimer(self.due(int(times[-1])))
        if missed:
            yield pd.DataFrame({"service": [key[0]] * len(missed), "t_ns": missed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.state.exists():
            last, alerted = self.state.get()
            if not alerted and self.due(last) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((last, True))
                yield pd.DataFrame({"service": [key[0]], "t_ns": [last]})

    def close(self) -> None:
        pass


def heartbeat_stream(df: DataFrame, silent_s: int = 90) -> DataFrame:
    """Beats (service, t_ns, ts with a watermark) -> (service, t_ns): each beat that no other followed within silent_s seconds of event time.

    An alert comes when the watermark passes, whether or not the service is ever heard of again; state is a row for each service.
    """
    return df.groupBy("service").transformWithStateInPandas(statefulProcessor=_Heartbeat(silent_s * 1000), outputStructType="service string, t_ns long", outputMode="Append", timeMode="EventTime")


def heartbeat_alerts(df: DataFrame, silent_s: int = 90) -> DataFrame:
    """Batch form: gaps of each service longer than silent_s, with their start and length."""
    from pyspark.sql.window import Window as W

    d = df.withColumn("gap_s", (F.lead("t_ns").over(W.partitionBy("service").orderBy("t_ns")) - F.col("t_ns")) / 1e9)
    return d.where(F.col("gap_s") > silent_s).select("service", "t_ns", "gap_s")


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what has arrived and returns the rows of its in-memory sink: for small results and tests."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Runs a stream in append mode over what has arrived, into Parquet in a shared folder, and reads that."""
    df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(target)
