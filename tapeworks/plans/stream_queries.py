"""Streams over the events table, run over what has arrived."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..streaming import streams as T
from . import views as V
from .registry import register

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of files."""
    return T.stream_feed(spark, f"{sf}/events.parquet*", SCHEMA)


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream: symbol, service, t_ns, mid, with a watermark on ts."""
    s = raw(spark, sf)
    return s.select(F.col("event_type").alias("symbol"), F.col("event_type").alias("service"), F.col("event_id"), (F.unix_micros("ts") * 1000).alias("t_ns"), (F.lit(100.0) + F.col("value")).alias("mid"), "ts").withWatermark("ts", "10 minutes")


def arriving_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lineitem table as a stream of files."""
    return T.stream_feed(spark, f"{sf}/lineitem.parquet*", V.table(spark, sf, "lineitem").schema)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the queries started within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def late_rows(spark: SparkSession, path: str) -> bool:
    """Whether a side output was ever written."""
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.schema("batch bigint").parquet(path).head(1))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def collected(spark: SparkSession, df: DataFrame) -> DataFrame:
    at = V.folder(spark)
    return T.run_to_table(df, f"{at}/out", f"{at}/checkpoint")


@register("n2_dedup_stream", "SELECT event_id, symbol, t_ns, mid FROM ticks", "mid")
def dedup(spark, sf):
    """Frames delivered one to three times, as after a reconnect: each is kept once."""
    again = F.sequence(F.lit(0), F.pmod(F.floor("mid"), F.lit(3)).cast("int"))
    s = arriving(spark, sf).withColumn("delivery", F.explode(again))
    return collected(spark, T.dedup_stream(s, ["event_id"])).select("event_id", "symbol", "t_ns", "mid")


@register("n5_late_flag", "SELECT event_id, event_id % 3 * 10 > 10 AS is_late FROM events")
def late(spark, sf):
    s = arriving(spark, sf).withColumn("t_recv_ns", F.col("t_ns") + F.col("event_id") % 3 * 10 * 1_000_000_000)
    return collected(spark, T.late_flag(s)).select("event_id", "is_late")


@register("n6_stream_bars", "SELECT event_type AS symbol, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, max({'t': epoch_us(ts), 'm': 100 + value}).m AS close, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2", "close")
def bars(spark, sf):
    """Hours that the watermark has closed."""
    return collected(spark, T.stream_bars(arriving(spark, sf), "1 hour")).select("symbol", F.unix_micros("start").alias("start_us"), "close", "n")


@register("n7_stream_returns", "SELECT symbol, t_ns, r FROM (SELECT symbol, t_ns, ln(mid) - ln(lag(mid) OVER (PARTITION BY symbol ORDER BY t_ns)) AS r FROM ticks) WHERE r IS NOT NULL", "r")
def stream_returns(spark, sf):
    """Each tick's return from the symbol's tick before."""
    with keyed_state(spark):
        return collected(spark, T.stream_returns(arriving(spark, sf).select("symbol", "t_ns", "mid", "ts"))).select("symbol", "t_ns", "r")


@register("n7_sliding_vol", """WITH r AS (SELECT symbol, t_ns // 1000 AS us, ln(mid) - ln(lag(mid) OVER (PARTITION BY symbol ORDER BY t_ns)) AS r FROM ticks), w AS (SELECT *, (us // 3600000000 - k.k) * 3600000000 AS start_us FROM r, range(2) k(k) WHERE r IS NOT NULL)
    SELECT symbol, CAST(start_us AS BIGINT) AS start_us, avg(r * r) AS mean_r2, count(*) AS n FROM w WHERE start_us + 7200000000 <= (SELECT max(t_ns) // 1000 - 600000000 FROM ticks) GROUP BY 1, 2""", "mean_r2")
def sliding(spark, sf):
    """Mean square returns of two hours, each hour, of windows that the watermark has closed."""
    with keyed_state(spark):
        s = T.stream_returns(arriving(spark, sf).select("symbol", "t_ns", "mid", "ts"))
        return collected(spark, T.sliding_vol(s, "2 hours", "1 hour")).select("symbol", F.unix_micros("start").alias("start_us"), "mean_r2", "n")


@register("n8_uptime_sessions", """WITH g AS (SELECT event_type AS service, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) >= 1200000000, TRUE) AS new FROM events), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY service ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g)
    SELECT service, min(t) AS start_us, max(t) + 1200000000 AS end_us, count(*) AS n FROM s GROUP BY service, no HAVING max(t) + 1200000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)""")
def sessions(spark, sf):
    """Sessions that the watermark has closed."""
    return collected(spark, T.uptime_sessions(arriving(spark, sf), "20 minutes")).select("service", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@register("n10_heartbeat_alerts", "SELECT symbol AS service, t_ns, gap_s FROM (SELECT symbol, t_ns, (lead(t_ns) OVER (PARTITION BY symbol ORDER BY t_ns) - t_ns) / 1e9 AS gap_s FROM ticks) WHERE gap_s > 3600", "gap_s")
def alerts(spark, sf):
    return T.heartbeat_alerts(V.ticks(spark, sf).withColumnRenamed("symbol", "service"), 3600)


@register("n10_heartbeat_stream", """WITH g AS (SELECT symbol, t_ns, lead(t_ns) OVER (PARTITION BY symbol ORDER BY t_ns) AS nxt FROM ticks), w AS (SELECT max(t_ns) // 1000000 - 600000 AS now FROM ticks)
    SELECT symbol AS service, t_ns FROM g, w WHERE nxt - t_ns > 3600000000000 OR (nxt IS NULL AND t_ns // 1000000 + 3600001 <= now)""")
def heartbeat_stream(spark, sf):
    """Beats that none of their service followed within an hour, by timers."""
    with keyed_state(spark):
        return collected(spark, T.heartbeat_stream(arriving(spark, sf).select("service", "t_ns", "ts"), 3600))


@register("b2_n5_rotate_finished", "SELECT event_type AS feed, strftime(ts, '%Y-%m-%d %H') AS hour, epoch_us(ts) * 1000 AS t_recv_ns, 100 + value AS mid FROM events WHERE date_trunc('hour', ts) < (SELECT date_trunc('hour', max(ts)) FROM events)", "mid")
def rotated_finished(spark, sf):
    """Events in six files, one a batch, into finished hours; with those that came late, all but the last hour's."""
    at = V.folder(spark)
    V.table(spark, sf, "events").repartitionByRange(6, "ts").write.parquet(f"{at}/in")
    s = T.stream_feed(spark, f"{at}/in", SCHEMA, max_files=1).select(F.col("event_type").alias("feed"), (F.unix_micros("ts") * 1000).alias("t_recv_ns"), (F.lit(100.0) + F.col("value")).alias("mid"))
    query, _ = T.rotate_finished(s, f"{at}/out", f"{at}/checkpoint")
    query.awaitTermination()
    hours = spark.read.parquet(f"{at}/out/hours").select("feed", F.concat_ws(" ", F.col("date").cast("string"), F.lpad(F.col("hour").cast("string"), 2, "0")).alias("hour"), "t_recv_ns", "mid")
    late = spark.read.schema("feed string, t_recv_ns bigint, mid double, batch bigint").parquet(f"{at}/out/late") if late_rows(spark, f"{at}/out/late") else None
    if late is None:
        return hours
    stamp = F.date_format(M.ns_to_timestamp(F.col("t_recv_ns")), "yyyy-MM-dd HH")
    return hours.unionByName(late.select("feed", stamp.alias("hour"), "t_recv_ns", "mid"))


@register("n12_enrich_stream", "SELECT event_id, market FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS token_id FROM events) e LEFT JOIN markets m ON e.token_id = m.token_id")
def enrich(spark, sf):
    s = raw(spark, sf).select("event_id", F.col("user_id").cast("string").alias("token_id"))
    return collected(spark, T.enrich_stream(s, V.markets(spark, sf).select("token_id", "market"))).select("event_id", "market")


@register("n1_n4_stream_feed", "SELECT event_type AS feed, strftime(ts, '%Y-%m-%d %H') AS hour, epoch_us(ts) * 1000 AS t_recv_ns, 100 + value AS mid FROM events", "mid")
def rotated(spark, sf):
    """Arrival into hourly partitions, read back."""
    at = V.folder(spark)
    s = arriving(spark, sf).select(F.col("symbol").alias("feed"), F.col("t_ns").alias("t_recv_ns"), "mid")
    T.hourly_rotation(s, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    hour = F.concat_ws(" ", F.col("date").cast("string"), F.lpad(F.col("hour").cast("string"), 2, "0"))
    return spark.read.parquet(f"{at}/out").select("feed", hour.alias("hour"), "t_recv_ns", "mid")


@register("n1_json_frames", "SELECT event_id, event_type, value, TRUE AS stamped FROM events", "value")
def json_frames(spark, sf):
    """Events as lines of JSON, streamed with their time of receipt."""
    at = V.folder(spark)
    V.table(spark, sf, "events").select("event_id", "event_type", "value").write.json(f"{at}/in")
    s = T.stream_feed(spark, f"{at}/in", "event_id bigint, event_type string, value double", kind="json")
    return collected(spark, s).select("event_id", "event_type", "value", (F.col("t_recv_ns") > 1_700_000_000 * 10**9).alias("stamped"))


@register("n3_dedup_chain", "SELECT DISTINCT l_orderkey AS block, l_linenumber AS log_index FROM lineitem")
def dedup_logs(spark, sf):
    """Every log comes twice, as after a reorganisation's replay."""
    s = arriving_lines(spark, sf).select(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("block_hash"), F.col("l_linenumber").alias("log_index"), F.col("l_orderkey").alias("block"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("time"))
    return collected(spark, T.dedup_chain(s.withWatermark("ts", "1 hour"))).select("block", "log_index")


@register("n9_active_set", """WITH l AS (SELECT user_id, epoch_ms(max(ts)) + (user_id % 48 + 1) * 3600000 AS end_ms FROM events GROUP BY 1), w AS (SELECT epoch_ms(max(ts)) - 600000 AS now FROM events)
    SELECT CAST(user_id AS VARCHAR) AS token_id, 'm' || (user_id // 2) AS market, 'add' AS change FROM l UNION ALL SELECT CAST(user_id AS VARCHAR), 'm' || (user_id // 2), 'remove' FROM l, w WHERE end_ms <= now""")
def active(spark, sf):
    """A market for each user's token, open for some hours after its last announcement."""
    end = F.unix_millis("ts") + (F.col("user_id") % 48 + 1) * 3600000
    s = raw(spark, sf).select(F.col("user_id").cast("string").alias("token_id"), F.expr("concat('m', user_id div 2)").alias("market"), end.alias("end_ms"), "ts").withWatermark("ts", "10 minutes")
    with keyed_state(spark):
        return collected(spark, T.active_set(s))


@register("n11_stream_inventory", "SELECT token_id, block_number, log_index, sum(s) OVER (PARTITION BY token_id ORDER BY block_number, log_index, s, price ROWS UNBOUNDED PRECEDING) AS position FROM (SELECT *, CASE WHEN side = 'BUY' THEN size ELSE -size END AS s FROM fills)", "position")
def stream_positions(spark, sf):
    s = V.fills_of(arriving_lines(spark, sf)).select("token_id", "block_number", F.col("log_index").cast("int").alias("log_index"), F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size")).cast("double").alias("signed_size"), "price")
    with keyed_state(spark):
        return collected(spark, T.stream_inventory(s))


FILLED, PRINTED = "event_type in ('click', 'purchase')", "event_type <> 'click'"


@register("n13_fill_print_join", f"""SELECT event_id, CASE WHEN {PRINTED} THEN epoch_us(ts) * 1000 END AS t_print_ns FROM events WHERE {FILLED} AND ({PRINTED} OR ts <= (SELECT least(max(CASE WHEN {FILLED} THEN ts END), max(CASE WHEN {PRINTED} THEN ts END)) FROM events) - INTERVAL 1 HOUR)""")
def prints(spark, sf):
    """Clicks and purchases are fills; all but clicks have a print, up to two minutes late. Fills without one leave the stream
    when the watermark has passed: those of the last hour that both streams reach are left out."""
    tx = F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("tx_hash")
    at = (F.unix_micros("ts") * 1000).alias("t_ns")
    f = raw(spark, sf).where(FILLED).select("event_id", tx, "ts").withWatermark("ts", "10 minutes")
    p = raw(spark, sf).where(PRINTED).select(tx, F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 3 * 60_000_000).alias("ts"), at).withWatermark("ts", "10 minutes")
    out = collected(spark, T.fill_print_join(f, p))
    last = V.table(spark, sf, "events").agg(F.expr(f"least(max(ts) filter (where {FILLED}), max(ts) filter (where {PRINTED})) - INTERVAL 1 HOUR").alias("last"))
    return out.crossJoin(F.broadcast(last)).where((F.col("t_print_ns").isNotNull()) | (F.col("ts") <= F.col("last"))).select("event_id", "t_print_ns")  # one row
