"""Feed scans: JSON lines, hourly partitions, message shapes, chain logs and market metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import money as M

BOOK_SHAPE = "array<struct<price:string,size:string>>"
# The first topics (Keccak-256 of the event signatures) and what they are.
TOPICS = {
    "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef": "Transfer",
    "c3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62": "TransferSingle",
    "d543adfd945773f1a62f74f0ee55a5e3b9b1a28262980ba90b1a89f2ea84d8ee": "OrderFilled",
    "b44d84d3289691f71497564b85d4233648d9dbae8cbdbb4329f301c3a0185894": "ConditionResolution",
    "ab3760c3bd2bb38b5bcf54dc79802ed67338b4cf29f3054ded67ed24661e4177": "ConditionPreparation",
    "55bb3cade9d43b798a4fe5ffdd05024b2d7870df53920673bfc7e68047cd0ab1": "FeeCharged",
}
# The contracts whose logs are decoded.
EXCHANGES = ["0xe111180000d2663c0091e4f400237545b87b996b", "0xe2222d279d744050d28e00520010520000310f59"]
CONDITIONS = ["0x4d97dcd97ec945f40cf65f87097ace5ea0476045"]
CASH = ["0xc011a7e12a19f7b1f670d46f03b03f3342e82dfb", "0x2791bca1f2de4661ed88a30c99a7a9449aa84174"]
CONTRACTS = {"Transfer": CASH, "TransferSingle": CONDITIONS, "OrderFilled": EXCHANGES, "ConditionResolution": CONDITIONS, "ConditionPreparation": CONDITIONS, "FeeCharged": EXCHANGES}


def parse_json_lines(lines: DataFrame, schema: T.StructType | str | None = None, column: str = "value") -> DataFrame:
    """Text lines -> (parsed fields, _bad): blank lines go, lines that are no JSON object stay with _bad true and null fields."""
    rows = lines.where(F.trim(column) != "")
    if schema is None:
        schema = infer_unified_schema(rows, column)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = rows.select(F.from_json(F.col(column), schema).alias("j"), F.coalesce(F.expr(f"try_parse_json(`{column}`)").isNull(), F.lit(True)).alias("_bad"))
    return rows.select("j.*", "_bad")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, gzipped or not. Malformed lines don't fail; count them by `_bad`."""
    return parse_json_lines(spark.read.text(path), schema)


def infer_unified_schema(lines: DataFrame, column: str = "value") -> T.StructType:
    """The union of fields over all lines; types that conflict become string. Nested values are JSON strings.

    One aggregate over (field, type) pairs, whatever the number of lines.
    """
    fields = lines.select(F.explode(F.expr(f"json_object_keys(`{column}`)")).alias("k"), F.col(column).alias("v"))
    typed = fields.select("k", F.expr("schema_of_variant(try_variant_get(try_parse_json(v), concat('$[\"', k, '\"]'), 'variant'))").alias("t"))
    got = typed.where("t is not null and t <> 'VOID'").groupBy("k").agg(F.sort_array(F.collect_set("t")).alias("ts")).orderBy("k").collect()
    wide = {("BIGINT",): T.LongType(), ("BOOLEAN",): T.BooleanType()}

    def kind(ts):
        if tuple(ts) in wide:
            return wide[tuple(ts)]
        numeric = all(t == "BIGINT" or t == "DOUBLE" or t.startswith("DECIMAL") for t in ts)
        return T.DoubleType() if numeric else T.StringType()

    return T.StructType([T.StructField(r["k"], kind(r["ts"])) for r in got])


def stringify_nested(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in order: cast where they are (decimals by way of text), null where missing; others go. A bad value is null."""
    out = []
    for f in schema:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            c = F.col(f.name).cast("string") if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            out.append(c.try_cast(f.dataType).alias(f.name))
    return df.select(*out)


def conform_unified(df: DataFrame, schema: T.StructType) -> DataFrame:
    """As conform, for inferred schemas, where nested values have been made text first."""
    return conform(stringify_nested(df), schema)


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Union by name: missing columns null, types that differ widened (numbers to double, else text)."""
    types: dict[str, set[str]] = {}
    for f in frames:
        for n, t in f.dtypes:
            types.setdefault(n, set()).add(t)
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    wide = {n: next(iter(t)) if len(t) == 1 else "bigint" if t <= {"tinyint", "smallint", "int", "bigint"} else "double" if t <= numbers else "string" for n, t in types.items()}
    cast = [f.select(*[F.col(n).cast(wide[n]).alias(n) for n in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def scan_feed(spark: SparkSession, root: str, feed: str, date: str, hour: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a feed's day or hour; those of `columns` that exist in it. No other directory of the table is listed or read."""
    at = f"{root}/feed={feed}/date={date}" + (f"/hour={hour}" if hour else "")
    try:
        d = spark.read.option("basePath", root).option("mergeSchema", "true").parquet(at)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no partition of {feed} on {date}" + (f" hour {hour}" if hour else "")) from e
    return d if columns is None else d.select(*[c for c in columns if c in d.columns])


def scan_filtered(df: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows whose asset_id (or else token_id) is among the tokens."""
    key = next(c for c in ("asset_id", "token_id") if c in df.columns)
    return df.join(tokens.select(F.col("token_id").alias(key)).distinct(), key, "left_semi")


def list_partitions(df: DataFrame) -> DataFrame:
    return df.select("feed", "date", "hour").distinct().orderBy("feed", "date", "hour")


def latest_partition(df: DataFrame) -> DataFrame:
    return df.groupBy("feed").agg(F.max(F.struct("date", "hour")).alias("p")).select("feed", "p.date", "p.hour")


def common_window(partitions: DataFrame, feeds: list[str], start: str) -> DataFrame:
    """Hours that every feed has, from a start date on: first, last, number of hours and dates."""
    p = partitions.where(F.col("feed").isin(feeds) & (F.col("date") >= start)).groupBy("date", "hour").agg(F.count_distinct("feed").alias("n")).where(F.col("n") == len(feeds))
    key = F.concat_ws(" ", "date", "hour")
    return p.agg(F.min(key).alias("first_hour"), F.max(key).alias("last_hour"), F.count("*").alias("hours"), F.count_distinct("date").alias("dates"))


def feed_freshness(partitions: DataFrame, now: str, stale_h: float = 2, alert_h: float = 4) -> DataFrame:
    at = F.to_timestamp(F.concat_ws(" ", "date", F.concat("hour", F.lit(":00:00"))))
    g = partitions.groupBy("feed").agg(F.max(at).alias("newest"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("newest")) / 3600.0
    return g.select("feed", "newest", age.alias("age_h")).withColumn("status", F.when(F.col("age_h") > alert_h, "ALERT").when(F.col("age_h") > stale_h, "STALE").otherwise("OK"))


def iso_unix(c):
    return F.unix_micros(F.try_to_timestamp(F.replace(c, F.lit("Z"), F.lit("+00:00")))) / 1e6


def market_lookup_from_snapshots(df: DataFrame, column: str = "market_json") -> DataFrame:
    """Snapshot JSON -> a row for each token, first seen wins: market, asset and horizon from the slug, ISO dates as unix seconds, outcome by index."""
    get = lambda k: F.get_json_object(column, f"$.{k}")
    m = df.select(get("conditionId").alias("market"), get("slug").alias("slug"), get("startDate").alias("s"), get("endDate").alias("e"), F.coalesce(get("negRisk"), F.lit("false")).alias("neg"), F.from_json(get("clobTokenIds"), "array<string>").alias("ids"), F.from_json(get("outcomes"), "array<string>").alias("outs"), "t_recv_ns")
    m = m.where("neg <> 'true' and ids is not null")
    m = m.select("*", F.posexplode("ids").alias("i", "token_id"))
    rows = m.select("token_id", "market", F.upper(F.regexp_extract("slug", r"^([a-z]+)-updown-", 1)).alias("asset_symbol"), F.regexp_extract("slug", r"-updown-([0-9]+[mh])-", 1).alias("horizon"), F.coalesce(F.get("outs", F.col("i")), F.when(F.col("i") == 0, "Up").otherwise("Down")).alias("outcome_side"), iso_unix(F.col("s")).alias("start_date_unix"), iso_unix(F.col("e")).alias("end_date_unix"), "t_recv_ns")
    cols = [c for c in rows.columns if c not in ("token_id", "t_recv_ns")]
    return rows.groupBy("token_id").agg(F.min_by(F.struct(*cols), F.struct("t_recv_ns", *cols)).alias("m")).select("token_id", "m.*")


def market_lookup_from_cache(df: DataFrame) -> DataFrame:
    """Cached metadata rows -> two token rows each (index 0 is Up), one a token."""
    keep = ["market", "asset_symbol", "horizon", "start_date_unix", "end_date_unix"]
    rows = df.select(*keep, F.posexplode(F.from_json("token_ids_json", "array<string>")).alias("i", "token_id")).where("i < 2")
    rows = rows.select("token_id", *keep, F.when(F.col("i") == 0, "Up").otherwise("Down").alias("outcome_side"))
    return rows.groupBy("token_id").agg(F.min(F.struct(*keep, "outcome_side")).alias("m")).select("token_id", "m.*")


def slot_grid(spark: SparkSession, assets: list[str], horizons: dict[str, int], t0: int, t1: int) -> DataFrame:
    """Every slot `asset-updown-horizon-start` from the slot of t0 to one horizon past t1."""
    a = spark.createDataFrame([(x, h, s) for x in assets for h, s in horizons.items()], "asset string, horizon string, secs long")
    lo = F.lit(t0) - F.pmod(F.lit(t0), F.col("secs"))
    g = a.withColumn("slot", F.explode(F.sequence(lo, F.lit(t1) + F.col("secs"), F.col("secs"))))
    return g.select("asset", "horizon", "slot", F.concat_ws("-", F.lower("asset"), F.lit("updown"), "horizon", F.col("slot").cast("string")).alias("slug"))


def lookahead_slots(spark: SparkSession, assets: list[str], now: int, k: int = 2) -> DataFrame:
    """Current and next k slots of 5m, 15m and 1h; the hourly ones with their textual slug in UTC-4."""
    a = spark.createDataFrame([(x, h, s) for x in assets for h, s in (("5m", 300), ("15m", 900), ("1h", 3600))], "asset string, horizon string, secs long")
    g = a.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.lit(now) - F.pmod(F.lit(now), F.col("secs")) + i * F.col("secs"))))
    at = F.timestamp_seconds(F.col("slot") - 4 * 3600)
    hourly = F.concat_ws("-", F.lower("asset"), F.lit("up-or-down"), F.lower(F.date_format(at, "MMMM-d")), F.concat(F.date_format(at, "h"), F.lower(F.date_format(at, "a"))), F.lit("et"))
    return g.select("asset", "horizon", "slot", F.when(F.col("horizon") == "1h", hourly).otherwise(F.concat_ws("-", F.lower("asset"), F.lit("updown"), "horizon", F.col("slot").cast("string"))).alias("slug"))


def token_market_map(books: DataFrame) -> DataFrame:
    """token -> market from book events, first partition wins."""
    b = books.where("event_type = 'book'")
    return b.groupBy(F.col("asset_id").alias("token_id")).agg(F.min_by("market", F.struct("date", "hour", "t_recv_ns", "market")).alias("market"))


def token_first_partition(books: DataFrame) -> DataFrame:
    b = books.where("event_type = 'book'").groupBy(F.col("asset_id").alias("token_id")).agg(F.min(F.struct("date", "hour")).alias("p"))
    return b.select("token_id", "p.date", "p.hour")


def parse_klines(df: DataFrame, column: str = "k") -> DataFrame:
    """Kline JSON -> open and close ms and doubles; rows without a readable value go."""
    get = lambda k: F.get_json_object(column, f"$.{k}")
    rows = df.select(F.lower(get("s")).alias("symbol"), get("t").try_cast("bigint").alias("open_ms"), get("T").try_cast("bigint").alias("close_ms"), *[get(k).try_cast("double").alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))])
    return rows.dropna(subset=["open_ms", "close_ms", "open", "high", "low", "close"])


def resolutions(df: DataFrame) -> DataFrame:
    """Settlement events -> up_wins: 1 if the first payout is above zero; at least two slots; one row a market, the earliest."""
    p = F.from_json("payout_numerators", "array<bigint>")
    r = df.where("event = 'ConditionResolution'").select("market", "t_recv_ns", p.alias("p")).where(F.size("p") >= 2)
    return r.groupBy("market").agg(F.min_by((F.get("p", F.lit(0)) > 0).cast("int"), F.struct("t_recv_ns", F.get("p", F.lit(0)))).alias("up_wins"))


def classify_frames(df: DataFrame) -> DataFrame:
    """Message type by shape: bids and asks make a book; else the event type if known; else unknown."""
    known = ["price_change", "tick_size_change", "last_trade_price", "best_bid_ask", "new_market", "market_resolved"]
    kind = F.when(F.col("bids").isNotNull() & F.col("asks").isNotNull(), "book").when(F.col("event_type").isin(known), F.col("event_type")).otherwise("unknown")
    return df.withColumn("frame_type", kind)


def normalize_frames(df: DataFrame, column: str = "frame") -> DataFrame:
    """A frame may be one object or an array of them: a row for each object, as JSON text."""
    rows = df.withColumn("__a", F.expr(f"cast(try_parse_json(case when trim(`{column}`) like '[%' then trim(`{column}`) else concat('[', trim(`{column}`), ']') end) as array<variant>)"))
    return rows.select(*[c for c in df.columns if c != column], F.explode("__a").alias("v")).select(*[c for c in df.columns if c != column], F.to_json("v").alias(column))


def unwrap_stream(df: DataFrame, data_schema: str, column: str = "value") -> DataFrame:
    """{stream, data} -> stream and data's fields, with the time of receipt."""
    j = F.from_json(column, f"stream string, data struct<{data_schema}>")
    return df.select("t_recv_ns", j.alias("j")).select("t_recv_ns", "j.stream", "j.data.*")


def address_of(topic):
    """The last 40 hex digits of a topic, as an address."""
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores by a hash of keys, if its scan has fewer tasks than that (a table in few files): for what is costly by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def decode_chain_logs(df: DataFrame, contracts: dict[str, list[str]] | None = None) -> DataFrame:
    """Log rows (topics array of hex, data hex, address, block_number, log_index, tx_hash) -> one wide row for each known event.

    A log is decoded if its first topic is known and its address is one of that event's `contracts`; others go. Fields that an
    event doesn't have are null. Words are 32 bytes, as decimal text of any size; a word that the data lack is null, and so are
    payouts whose stated number is more than the data hold. Addresses and hashes are in lower case.
    """
    contracts = CONTRACTS if contracts is None else contracts
    pairs = list(dict.fromkeys((t, a.lower(), e) for t, e in TOPICS.items() for a in contracts.get(e, [])))
    known = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).cast("string") for x in p]) for p in pairs or [(None, None, None)]])).alias("__topic", "__at", "event"))
    plain = lambda c: F.when(F.startswith(c, F.lit("0x")), F.substring(c, 3, 2**31 - 1)).otherwise(c)
    is_ = lambda *names: F.col("event").isin(*names)
    topic = lambda i: F.get("topics", F.lit(i))
    # words are cut out of bytes: a substring of text counts characters from its start
    raw = lambda i: F.substring("__d", 64 * i + 1, 64).cast("string")
    # a join with the few known pairs works out a log's key once, where a filter of an expression does it twice
    on = (F.lower(plain(topic(0))) == F.col("__topic")) & (F.lower(df["address"]) == F.col("__at"))
    d = df.join(F.broadcast(known), on).select("event", F.col("__at").alias("address"), "block_number", "log_index", "tx_hash", "topics", F.when(F.startswith("data", F.lit("0x")), F.substring(F.col("data").cast("binary"), 3, 2**31 - 1)).otherwise(F.col("data").cast("binary")).alias("__d"))
    n = F.conv(F.substring("__d", 64 * 2 + 49, 16).cast("string"), 16, 10).cast("decimal(20,0)")
    holds = F.floor((F.length("__d") - 64 * 3) / 64)
    payouts = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: M.word_unsigned(F.substring("__d", i * 64 + (64 * 2 + 1), F.lit(64)).cast("string"), 0))
    orders, conditions = is_("OrderFilled"), is_("ConditionResolution", "ConditionPreparation")
    # each field's word is cut out first, so that few expressions read numbers, and none of them by an interpreted function of arrays
    words = {
        "token_id": F.when(orders, raw(1)).when(is_("TransferSingle"), raw(0)),
        "amount_raw": F.when(is_("TransferSingle"), raw(1)).when(is_("Transfer", "FeeCharged"), raw(0)),
        "maker_amount_raw": F.when(orders, raw(2)),
        "taker_amount_raw": F.when(orders, raw(3)),
        "fee_raw": F.when(orders, raw(4)),
    }
    number = lambda name: M.word_unsigned(F.col(f"__{name}"), 0)
    fields = {
        "operator": F.when(is_("TransferSingle"), address_of(topic(1))),
        "from_": F.when(is_("TransferSingle"), address_of(topic(2))).when(is_("Transfer"), address_of(topic(1))),
        "to": F.when(is_("TransferSingle"), address_of(topic(3))).when(is_("Transfer"), address_of(topic(2))),
        "token_id": number("token_id"),
        "amount_raw": number("amount_raw"),
        "receiver": F.when(is_("FeeCharged"), address_of(topic(1))),
        "order_hash": F.when(orders, F.lower(topic(1))),
        "maker": F.when(orders, address_of(topic(2))),
        "taker": F.when(orders, address_of(topic(3))),
        "side": F.when(orders, F.conv(F.substring("__d", 63, 2).cast("string"), 16, 10).cast("int")),
        "maker_amount_raw": number("maker_amount_raw"),
        "taker_amount_raw": number("taker_amount_raw"),
        "fee_raw": number("fee_raw"),
        "builder": F.when(orders, F.lower(raw(5))),
        "metadata": F.when(orders, F.lower(raw(6))),
        "condition_id": F.when(conditions, F.lower(topic(1))),
        "oracle": F.when(conditions, address_of(topic(2))),
        "question_id": F.when(conditions, F.lower(topic(3))),
        "outcome_slot_count": F.when(conditions, F.conv(F.substring("__d", 49, 16).cast("string"), 16, 10).cast("bigint")),
        "payout_numerators": F.when(is_("ConditionResolution") & (n <= holds), F.when(n > 0, payouts).otherwise(F.array().cast("array<string>"))),
    }
    return d.select("*", *[c.alias(f"__{k}") for k, c in words.items()]).select("event", "address", "block_number", "log_index", "tx_hash", *[c.alias(k) for k, c in fields.items()])


def book_ticks(df: DataFrame) -> DataFrame:
    """Best bid and ask rows (no event name) -> symbol, time, mid."""
    d = df.where("e is null and b is not null and a is not null")
    return d.select(F.lower("s").alias("symbol"), F.col("t_recv_ns").alias("t_ns"), ((M.num(F.col("b")) + M.num(F.col("a"))) / 2).alias("mid"))


def agg_trades(df: DataFrame) -> DataFrame:
    d = df.where("e = 'aggTrade'")
    return d.select(F.lower("s").alias("symbol"), M.ms_to_ns(F.col("T")).alias("t_ns"), M.num(F.col("p")).alias("price"), M.num(F.col("q")).alias("qty"))


def snapshot_markets(df: DataFrame, names: list[str]) -> DataFrame:
    """Poll events with nested markets -> a row for each market of the assets, with the poll's time."""
    rows = df.select("t_recv_ns", F.explode(F.from_json("markets", "array<struct<id:string,slug:string,volume:double>>")).alias("m")).select("t_recv_ns", "m.*")
    return rows.where(M.asset_prefix_filter(F.col("slug"), names))


def earliest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
