"""Queries over feed scans and metadata, on JSON and messages that Spark makes of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as M
from ..sources import feeds as S
from ..sources.sinks import write_hourly
from . import views as V
from .registry import register


def lines(spark, sf):
    """Events as JSON lines; every tenth is cut short, every eleventh blank."""
    e = V.table(spark, sf, "events")
    text = F.to_json(F.struct("event_id", "event_type", F.col("value").alias("price"), F.when(F.col("event_id") % 3 == 0, F.struct(F.col("user_id").alias("u"))).alias("nested")))
    return e.select(F.when(F.col("event_id") % 11 == 0, F.lit("  ")).when(F.col("event_id") % 10 == 0, F.concat(F.lit("not json "), text)).otherwise(text).alias("value"))


@register("a1_read_jsonl", "SELECT event_id % 10 = 0 AS bad, count(*) AS n, sum(CASE WHEN event_id % 10 <> 0 THEN event_id END) AS ids FROM events WHERE event_id % 11 <> 0 GROUP BY 1")
def jsonl(spark, sf):
    """From gzipped lines in the shared folder."""
    at = f"{V.folder(spark)}/lines"
    lines(spark, sf).write.option("compression", "gzip").text(at)
    d = S.read_jsonl(spark, at, "event_id bigint, event_type string, price double, nested string")
    return d.groupBy(F.col("_bad").alias("bad")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@register("a2_infer_unified_schema", "SELECT * FROM (VALUES ('event_id', 'bigint'), ('event_type', 'string'), ('nested', 'string'), ('price', 'double')) t(name, type)")
def infer(spark, sf):
    found = S.infer_unified_schema(lines(spark, sf))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found], "name string, type string")


@register("a3_stringify_nested", """SELECT event_id, '{"u":' || user_id || '}' AS nested FROM events""")
def stringify(spark, sf):
    return S.stringify_nested(V.table(spark, sf, "events").select("event_id", F.struct(F.col("user_id").alias("u")).alias("nested")))


@register("a4_a5_conform", "SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS event_type, CAST(NULL AS VARCHAR) AS venue, CAST(CAST(value AS DECIMAL(38,6)) AS DOUBLE) AS value FROM events", "value")
def conform(spark, sf):
    schema = spark.createDataFrame([], "event_id bigint, event_type double, venue string, value decimal(38,6)").schema
    return S.conform_unified(V.table(spark, sf, "events"), schema).withColumn("value", F.col("value").cast("double"))


def partitioned(spark, sf):
    """Events as rows of three feeds with their hour's partition columns."""
    e = V.table(spark, sf, "events")
    return e.select("event_id", F.when(F.col("event_type") == "click", "book").when(F.col("event_type") == "view", "spot").otherwise("chain").alias("feed"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH").alias("hour"), "value")


PARTS = "(SELECT event_id, CASE event_type WHEN 'click' THEN 'book' WHEN 'view' THEN 'spot' ELSE 'chain' END AS feed, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, value FROM events)"


def hourly(spark, sf):
    """The path of those rows as a table by feed, date and hour, in the shared folder, as an hourly sink leaves it."""
    at = f"{V.folder(spark)}/hourly"
    write_hourly(partitioned(spark, sf), at)
    return at


@register("a6_a7_scan_feed", f"""SELECT 'day' AS scan, event_id, value FROM {PARTS} WHERE feed = 'book' AND date = '2024-01-05'
    UNION ALL SELECT 'hour', event_id, value FROM {PARTS} WHERE feed = 'book' AND date || hour = (SELECT max(date || hour) FROM {PARTS} WHERE feed = 'book')""", "value")
def scan(spark, sf):
    """A day of a feed, and its latest hour: only their directories are read."""
    at = hourly(spark, sf)
    last = S.latest_partition(spark.read.parquet(at).where("feed = 'book'")).first()
    day = S.scan_feed(spark, at, "book", "2024-01-05", columns=["event_id", "value", "absent"])
    hour = S.scan_feed(spark, at, "book", str(last["date"]), f"{last['hour']:02}", ["event_id", "value"])
    return day.withColumn("scan", F.lit("day")).unionByName(hour.withColumn("scan", F.lit("hour")))


@register("a8_scan_filtered", "SELECT token_id, t_block_ns, size FROM fills WHERE market IN (SELECT market FROM resolved WHERE up_wins = 1)")
def filtered(spark, sf):
    wanted = V.markets(spark, sf).join(V.resolved(spark, sf).where("up_wins = 1"), "market", "left_semi").select("token_id")
    return S.scan_filtered(V.fills(spark, sf), wanted).select("token_id", "t_block_ns", "size")


@register("a9_partitions", f"SELECT feed, max(date || ' ' || hour) AS latest, count(DISTINCT date || ' ' || hour) AS n FROM {PARTS} GROUP BY 1")
def partitions(spark, sf):
    """Of a table by feed, date and hour; no column of its files is read."""
    p = spark.read.parquet(hourly(spark, sf))
    n = S.list_partitions(p).groupBy("feed").agg(F.count("*").alias("n"))
    return S.latest_partition(p).select("feed", F.concat_ws(" ", F.col("date").cast("string"), F.lpad(F.col("hour").cast("string"), 2, "0")).alias("latest")).join(n, "feed")


@register("a10_common_window", f"""WITH h AS (SELECT date, hour FROM {PARTS} WHERE date >= '2024-01-03' GROUP BY 1, 2 HAVING count(DISTINCT feed) = 3) SELECT min(date || ' ' || hour) AS first_hour, max(date || ' ' || hour) AS last_hour, count(*) AS hours, count(DISTINCT date) AS dates FROM h""")
def window(spark, sf):
    return S.common_window(partitioned(spark, sf), ["book", "spot", "chain"], "2024-01-03")


@register("a11_feed_freshness", f"""SELECT feed, age_h, CASE WHEN age_h > 4 THEN 'ALERT' WHEN age_h > 2 THEN 'STALE' ELSE 'OK' END AS status FROM (SELECT feed, date_diff('second', max(strptime(date || ' ' || hour, '%Y-%m-%d %H')), TIMESTAMP '2024-01-31 01:30:00') / 3600.0 AS age_h FROM {PARTS} GROUP BY 1)""", "age_h")
def freshness(spark, sf):
    return S.feed_freshness(partitioned(spark, sf), "2024-01-31 01:30:00").drop("newest")


def snapshots(spark, sf):
    """Parts as market snapshots in JSON, with a doubly encoded token list."""
    p = V.table(spark, sf, "part")
    ids = F.to_json(F.array(F.concat(F.lit("t"), (F.col("p_partkey") * 2).cast("string")), F.concat(F.lit("t"), (F.col("p_partkey") * 2 + 1).cast("string"))))
    slug = F.concat(F.element_at(F.array(*map(F.lit, ("btc", "eth", "sol", "xrp"))), (F.col("p_partkey") % 4).cast("int") + 1), F.lit("-updown-"), F.element_at(F.array(*map(F.lit, ("5m", "15m", "1h"))), (F.col("p_partkey") % 3).cast("int") + 1), F.lit("-"), F.col("p_partkey").cast("string"))
    m = F.struct(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("conditionId"), slug.alias("slug"), F.lit("2024-01-01T00:00:00Z").alias("startDate"), F.lit("2024-01-01T01:00:00Z").alias("endDate"), (F.col("p_partkey") % 9 == 0).alias("negRisk"), ids.alias("clobTokenIds"), F.lit('["Up", "Down"]').alias("outcomes"))
    return p.select(F.to_json(m).alias("market_json"), F.col("p_partkey").alias("t_recv_ns"))


@register("a12_market_lookup_snapshots", """SELECT 't' || (p_partkey * 2 + i) AS token_id, 'm' || p_partkey AS market, ['BTC','ETH','SOL','XRP'][p_partkey % 4 + 1] AS asset_symbol, ['5m','15m','1h'][p_partkey % 3 + 1] AS horizon, CASE WHEN i = 0 THEN 'Up' ELSE 'Down' END AS outcome_side,
    CAST(1704067200 AS DOUBLE) AS start_date_unix, CAST(1704070800 AS DOUBLE) AS end_date_unix FROM part, (VALUES (0), (1)) x(i) WHERE p_partkey % 9 <> 0""")
def lookup(spark, sf):
    return S.market_lookup_from_snapshots(snapshots(spark, sf))


@register("a13_market_lookup_cache", """SELECT 't' || (p_partkey * 2 + i) AS token_id, 'm' || p_partkey AS market, p_brand AS asset_symbol, p_type AS horizon, CASE WHEN i = 0 THEN 'Up' ELSE 'Down' END AS outcome_side FROM part, (VALUES (0), (1)) x(i)""")
def cached(spark, sf):
    ids = F.to_json(F.array(F.concat(F.lit("t"), (F.col("p_partkey") * 2).cast("string")), F.concat(F.lit("t"), (F.col("p_partkey") * 2 + 1).cast("string"))))
    d = V.table(spark, sf, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("market"), F.col("p_brand").alias("asset_symbol"), F.col("p_type").alias("horizon"), F.lit(0.0).alias("start_date_unix"), F.lit(1.0).alias("end_date_unix"), ids.alias("token_ids_json"))
    return S.market_lookup_from_cache(d).drop("start_date_unix", "end_date_unix")


@register("a16_token_market_map", "SELECT CAST(user_id AS VARCHAR) AS token_id, arg_min('m' || (event_id % 3), strftime(ts, '%Y-%m-%d %H') || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS market FROM events WHERE event_type = 'view' GROUP BY 1")
def token_map(spark, sf):
    e = V.table(spark, sf, "events").select(F.when(F.col("event_type") == "view", "book").otherwise("other").alias("event_type"), F.col("user_id").cast("string").alias("asset_id"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("market"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH").alias("hour"), F.col("event_id").alias("t_recv_ns"))
    return S.token_market_map(e)


@register("a28_token_first_partition", "SELECT CAST(user_id AS VARCHAR) AS token_id, left(min(strftime(ts, '%Y-%m-%d %H')), 10) AS date, right(min(strftime(ts, '%Y-%m-%d %H')), 2) AS hour FROM events WHERE event_type = 'view' GROUP BY 1")
def first_partition(spark, sf):
    e = V.table(spark, sf, "events").select(F.when(F.col("event_type") == "view", "book").otherwise("other").alias("event_type"), F.col("user_id").cast("string").alias("asset_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH").alias("hour"))
    return S.token_first_partition(e)


@register("a17_parse_klines", "SELECT event_type AS symbol, event_id * 1000 AS open_ms, event_id * 1000 + 999 AS close_ms, value AS open, value + 2 AS high, value - 1 AS low, value + 1 AS close FROM events WHERE event_id % 13 <> 0", "open high low close")
def klines(spark, sf):
    v = F.col("value")
    price = lambda c: F.when(F.col("event_id") % 13 == 0, F.lit("bad")).otherwise(c.cast("string"))
    k = F.to_json(F.struct(F.upper("event_type").alias("s"), (F.col("event_id") * 1000).alias("t"), (F.col("event_id") * 1000 + 999).alias("T"), v.cast("string").alias("o"), (v + 2).cast("string").alias("h"), (v - 1).cast("string").alias("l"), price(v + 1).alias("c")))
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")  # t and T are two fields
    try:
        out = S.parse_klines(V.table(spark, sf, "events").select(k.alias("k")))
        out.schema
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
    return out


@register("a18_resolutions", "SELECT 'm' || p_partkey AS market, p_size % 2 AS up_wins FROM part WHERE p_partkey % 5 <> 0")
def settle(spark, sf):
    d = V.table(spark, sf, "part").select(F.lit("ConditionResolution").alias("event"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("market"), F.col("p_partkey").alias("t_recv_ns"), F.when(F.col("p_partkey") % 5 == 0, "[1]").when(F.col("p_size") % 2 == 1, "[1,0]").otherwise("[0,1]").alias("payout_numerators"))
    return S.resolutions(d)


@register("a19_classify_frames", "SELECT CASE WHEN event_type = 'view' THEN 'book' WHEN event_type IN ('click', 'error') THEN 'price_change' ELSE 'unknown' END AS frame_type, count(*) AS n FROM events GROUP BY 1")
def classify(spark, sf):
    t = F.col("event_type")
    e = V.table(spark, sf, "events").select(F.when(t == "view", "[]").alias("bids"), F.when(t == "view", "[]").alias("asks"), F.when(t.isin("click", "error"), "price_change").otherwise(t).alias("event_type"))
    return S.classify_frames(e).groupBy("frame_type").agg(F.count("*").alias("n"))


@register("a20_normalize_frames", "SELECT event_id, count(*) AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def normalize(spark, sf):
    one = F.to_json(F.struct("event_id", "value"))
    e = V.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))).otherwise(one).alias("frame"))
    return S.normalize_frames(e).groupBy("event_id").agg(F.count("*").alias("n"))


@register("a21_unwrap_stream", "SELECT event_id AS t_recv_ns, event_type AS stream, value AS p FROM events", "p")
def unwrap(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("t_recv_ns"), F.to_json(F.struct(F.col("event_type").alias("stream"), F.struct(F.col("value").alias("p")).alias("data"))).alias("value"))
    return S.unwrap_stream(e, "p: double")


LOGS = """SELECT *, CAST(l_quantity AS HUGEINT) AS q, '0x' || lpad(lower(to_hex(l_suppkey)), 40, '0') AS supp, '0x' || lpad(lower(to_hex(l_partkey)), 40, '0') AS part, '0x' || lpad(lower(to_hex(l_partkey)), 64, '0') AS part_word, '0x' || lpad(lower(to_hex(l_orderkey)), 64, '0') AS order_word,
    CAST(CAST(l_partkey AS HUGEINT) * 4294967296 + 7 AS VARCHAR) AS token, ['TransferSingle','Transfer','OrderFilled','FeeCharged','','ConditionResolution','ConditionPreparation'][l_linenumber] AS event FROM lineitem WHERE l_linenumber <> 5 AND l_suppkey % 10 <> 0"""


@register("a22_decode_chain_logs", f"""SELECT event, CASE WHEN event = 'Transfer' THEN '{S.CASH[1]}' WHEN event IN ('OrderFilled', 'FeeCharged') THEN '{S.EXCHANGES[0]}' ELSE '{S.CONDITIONS[0]}' END AS address, l_orderkey AS block_number, l_linenumber AS log_index,
    CASE WHEN event = 'TransferSingle' THEN supp END AS operator, CASE WHEN event LIKE 'Transfer%' THEN supp END AS from_, CASE WHEN event LIKE 'Transfer%' THEN part END AS "to", CASE WHEN event IN ('TransferSingle', 'OrderFilled') THEN token END AS token_id,
    CASE WHEN event LIKE 'Transfer%' OR event = 'FeeCharged' THEN CAST(q * 1000000 AS VARCHAR) END AS amount_raw, CASE WHEN event = 'FeeCharged' THEN supp END AS receiver, CASE WHEN event = 'OrderFilled' THEN order_word END AS order_hash,
    CASE WHEN event = 'OrderFilled' THEN supp END AS maker, CASE WHEN event = 'OrderFilled' THEN part END AS taker, CASE WHEN event = 'OrderFilled' THEN l_suppkey % 2 END AS side, CASE WHEN event = 'OrderFilled' THEN CAST(q * 1000000 AS VARCHAR) END AS maker_amount_raw,
    CASE WHEN event = 'OrderFilled' THEN CAST(q * 500000 AS VARCHAR) END AS taker_amount_raw, CASE WHEN event = 'OrderFilled' THEN CAST(q * 1000 AS VARCHAR) END AS fee_raw, CASE WHEN event = 'OrderFilled' THEN part_word[3:] END AS builder, CASE WHEN event = 'OrderFilled' THEN repeat('0', 64) END AS metadata,
    CASE WHEN event LIKE 'Condition%' THEN part_word END AS condition_id, CASE WHEN event LIKE 'Condition%' THEN supp END AS oracle, CASE WHEN event LIKE 'Condition%' THEN order_word END AS question_id, CASE WHEN event LIKE 'Condition%' THEN 2 END AS outcome_slot_count,
    CASE WHEN event = 'ConditionResolution' THEN (l_suppkey % 2) || ',' || (1 - l_suppkey % 2) END AS payouts FROM ({LOGS})""")
def decode(spark, sf):
    """Logs of all six kinds, dealt over all cores; each fifth line has an unknown topic, each tenth supplier's logs are of an unknown contract."""
    # zeros before the digits, cut from the end: lpad puts them there one by one
    padded = lambda n, *cs: F.concat(F.lit("0" * (64 - n)), F.substring(F.concat(F.lit("0" * n), *cs), -n, n))
    word = lambda c: padded(16, F.lower(F.hex(c.cast("bigint"))))
    hexed = lambda *cs: F.concat(F.lit("0x"), *cs)
    first = {v: F.lit(f"0x{k}") for k, v in S.TOPICS.items()}
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    q = F.col("l_quantity").cast("bigint")
    once = {"s": word(supp), "p": word(F.col("l_partkey")), "o": word(F.col("l_orderkey")), "token": padded(24, F.lower(F.hex("l_partkey")), F.lit("00000007")), "amount": word(q * 1000000)}
    s, p, o, token, amount = map(F.col, once)
    two, bit = word(F.lit(2)), supp % 2
    made = {
        1: ("TransferSingle", S.CONDITIONS[0], [s, s, p], [token, amount]),
        2: ("Transfer", S.CASH[1], [s, p], [amount]),
        3: ("OrderFilled", S.EXCHANGES[0], [o, s, p], [word(bit), token, amount, word(q * 500000), word(q * 1000), p, F.lit("0" * 64)]),
        4: ("FeeCharged", S.EXCHANGES[0], [s], [amount]),
        6: ("ConditionResolution", S.CONDITIONS[0], [p, s, o], [two, word(F.lit(64)), two, word(bit), word(1 - bit)]),
        7: ("ConditionPreparation", S.CONDITIONS[0], [p, s, o], [two]),
    }
    topics, data, address = F.array(hexed(F.lit("00" * 32))), F.lit("0x"), F.lit("0x")
    for k, (event, at, indexed, words) in made.items():
        topics = F.when(line == k, F.array(first[event], *map(hexed, indexed))).otherwise(topics)
        data = F.when(line == k, hexed(*words)).otherwise(data)
        address = F.when(line == k, F.lit(at)).otherwise(address)
    lines = S.spread(V.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
    made_once = lines.select("l_linenumber", "l_suppkey", "l_orderkey", "l_quantity", *[c.alias(k) for k, c in once.items()])
    logs = made_once.select(topics.alias("topics"), data.alias("data"), F.when(supp % 10 == 0, F.lit("0xabc")).otherwise(address).alias("address"), F.col("l_orderkey").alias("block_number"), line.alias("log_index"), F.lit("0x1").alias("tx_hash"))
    d = S.decode_chain_logs(logs)
    return d.withColumn("payouts", F.array_join("payout_numerators", ",")).drop("payout_numerators", "tx_hash")


@register("a23_book_ticks", "SELECT event_type AS symbol, event_id AS t_ns, value + 0.5 AS mid FROM events WHERE event_id % 4 <> 0", "mid")
def book_ticks(spark, sf):
    v = F.col("value")
    e = V.table(spark, sf, "events").select(F.when(F.col("event_id") % 4 == 0, "depth").alias("e"), F.upper("event_type").alias("s"), v.cast("string").alias("b"), (v + 1).cast("string").alias("a"), F.col("event_id").alias("t_recv_ns"))
    return S.book_ticks(e)


@register("a24_agg_trades", "SELECT event_type AS symbol, event_id * 1000000 AS t_ns, value AS price, value * 2 AS qty FROM events WHERE event_id % 4 = 0", "price qty")
def trades(spark, sf):
    v = F.col("value")
    e = V.table(spark, sf, "events").select(F.when(F.col("event_id") % 4 == 0, "aggTrade").otherwise("depth").alias("e"), F.upper("event_type").alias("s"), F.col("event_id").cast("string").alias("T"), v.cast("string").alias("p"), (v * 2).cast("string").alias("q"))
    return S.agg_trades(e)


@register("a27_c27_snapshot_markets", "SELECT p_partkey AS t_recv_ns, CAST(p_partkey * 10 + i AS VARCHAR) AS id, slug FROM (SELECT p_partkey, i, ['btc-a', 'bitcoin-b', 'eth-c', 'doge-d'][i + 1] AS slug FROM part, range(4) r(i)) WHERE slug LIKE 'btc%' OR slug LIKE 'bitcoin%'")
def snapshot(spark, sf):
    items = [F.struct((F.col("p_partkey") * 10 + i).cast("string").alias("id"), F.lit(s).alias("slug"), F.lit(1.0).alias("volume")) for i, s in enumerate(("btc-a", "bitcoin-b", "eth-c", "doge-d"))]
    d = V.table(spark, sf, "part").select(F.col("p_partkey").alias("t_recv_ns"), F.to_json(F.array(*items)).alias("markets"))
    return S.snapshot_markets(d, ["btc", "bitcoin"]).drop("volume")


@register("c1_c4_number_columns", "SELECT event_id, CAST(round_even(CAST(value AS DECIMAL(18,6)), 6) AS VARCHAR) AS p, value AS d, event_id * 1000000 AS ns FROM events", "d")
def numbers(spark, sf):
    v = F.col("value").cast("string")
    e = V.table(spark, sf, "events")
    return e.select("event_id", M.norm_price(v).alias("p"), M.dec6(v).cast("double").alias("d"), M.ms_to_ns(F.col("event_id").cast("string")).alias("ns"))


@register("c26_market_eligible", "SELECT o_orderkey % 4 = 0 AS neg, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 10 BETWEEN 1 AND 6 GROUP BY 1")
def eligible(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("end", F.concat(F.lit("2024-01-01T"), F.lpad((12 + F.col("o_orderkey") % 10).cast("string"), 2, "0"), F.lit(":00:00Z")))
    ok = M.market_eligible(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 4 == 0, F.col("end"), F.lit("2024-01-01 12:00:00").cast("timestamp"))
    return o.where(ok).groupBy((F.col("o_orderkey") % 4 == 0).alias("neg")).agg(F.count("*").alias("n"))


@register("h2_union_relaxed", "SELECT CAST(o_orderkey AS DOUBLE) AS k, o_orderstatus AS s, CAST(NULL AS VARCHAR) AS x FROM orders UNION ALL SELECT c_acctbal, CAST(NULL AS VARCHAR), c_name FROM customer", "k")
def relaxed(spark, sf):
    a = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = V.table(spark, sf, "customer").select(F.col("c_acctbal").alias("k"), F.col("c_name").alias("x"))
    return S.union_relaxed([a, b])


@register("b6_upsert_dimension", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert(spark, sf):
    from ..sources.sinks import upsert_dimension

    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment"))
    new = c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.upper("c_mktsegment"))
    return upsert_dimension(c.where("c_custkey % 7 <> 0 or c_custkey % 3 = 0").union(c.where("c_custkey % 7 = 0 and c_custkey % 3 <> 0")), new, "c_custkey")


@register("b1_write_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "o_totalprice", 2)
def write_table(spark, sf):
    """Orders by status, written and read back."""
    from ..sources.sinks import write_table

    at = V.folder(spark)
    write_table(V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), at, partition_by=["o_orderstatus"])
    return spark.read.parquet(at).select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("b3_b5_write_verified", "SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) AS verified FROM orders GROUP BY 1")
def write_verified(spark, sf):
    """A write that counts what it reads back, and a table that is built once and then taken as it is."""
    from ..sources.sinks import checkpointed, write_verified

    at, o = V.folder(spark), V.table(spark, sf, "orders")
    n = write_verified(o, f"{at}/orders")
    counts = lambda: spark.read.parquet(f"{at}/orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    checkpointed(spark, f"{at}/counts", counts)
    return checkpointed(spark, f"{at}/counts", lambda: None).withColumn("verified", F.lit(n).cast("bigint"))


@register("b4_write_stats", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1", "top", 2)
def write_stats(spark, sf):
    """Summary rows as one JSON file, read back."""
    from ..sources.sinks import write_stats

    at = V.folder(spark)
    write_stats(V.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")), at)
    return spark.read.schema("o_orderstatus string, n bigint, top double").json(at)


@register("a14_slot_grid", """WITH s AS (SELECT epoch_us(min(ts)) // 1000000 AS t0, epoch_us(max(ts)) // 1000000 AS t1 FROM events), h AS (SELECT * FROM (VALUES ('15m', 900), ('1h', 3600)) h(horizon, secs)), a AS (SELECT * FROM (VALUES ('BTC'), ('ETH')) a(asset))
    SELECT asset, horizon, slot, lower(asset) || '-updown-' || horizon || '-' || slot AS slug FROM (SELECT asset, horizon, unnest(range(t0 - t0 % secs, t1 + secs + 1, secs)) AS slot FROM s, h, a)""")
def slots(spark, sf):
    """Every slot of the span that the events cover."""
    t = V.table(spark, sf, "events").agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("b")).first()
    return S.slot_grid(spark, ["BTC", "ETH"], {"15m": 900, "1h": 3600}, t["a"], t["b"])


@register("h6_merge_precedence", """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.price, b.price) AS price, CASE WHEN a.o_orderkey IS NOT NULL THEN 'primary' ELSE 'fallback' END AS source
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS price FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.o_orderkey""", "price", 2)
def precedence(spark, sf):
    """Prices of finished orders, else the dearest line of the order."""
    from ..sources.sinks import merge_precedence

    o = V.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"))
    li = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("price"))
    return merge_precedence(o, li, "o_orderkey")
