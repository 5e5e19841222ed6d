"""The star-schema tables as fills, ticks, level updates and markets, in Spark and in SQL for the oracle.

lineitem rows become fills (token: part, block: order, log index: line number), events become spot ticks (symbol: event type),
order-book level updates (token: user) and prints, parts become markets with two tokens each.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSETS, HORIZONS = ["BTC", "ETH", "SOL", "XRP"], ["5m", "15m", "1h"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where none is set (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="tapeworks-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for what reads it several times."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _ns(ts: str) -> str:
    return f"(unix_micros(cast({ts} as timestamp)) * 1000)"


def _market(k: str) -> list[str]:
    return [
        f"concat('m', {k} div 2) as market",
        f"element_at(array('BTC','ETH','SOL','XRP'), cast(({k} div 2) % 4 as int) + 1) as asset_symbol",
        f"element_at(array('5m','15m','1h'), cast(({k} div 2) % 3 as int) + 1) as horizon",
        f"if({k} % 2 = 0, 'Up', 'Down') as outcome_side",
    ]


def fills(spark: SparkSession, sf: str) -> DataFrame:
    return fills_of(table(spark, sf, "lineitem"))


def fills_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "cast(l_partkey as string) as token_id", *_market("l_partkey"),
        "l_orderkey as block_number", "l_linenumber as log_index", "concat('x', l_orderkey) as tx_hash", f"{_ns('l_shipdate')} + (l_orderkey % 86400) * 1000000000 as t_block_ns",
        f"{_ns('l_shipdate')} + (l_orderkey % 86400 + (l_linenumber - 2) * 4) * 1000000000 as t_recv_ns", "if((l_partkey + l_linenumber) % 2 = 0, 'BUY', 'SELL') as side",
        "cast(20000 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 960001 as double) / 1000000D as price", "l_quantity as size", "l_suppkey % 3 = 0 as is_maker",
    ).withColumn("maker_rebate", F.expr("if(is_maker, 0.014D * least(price, 1D - price) * size, 0D)"))


def chain_events(spark: SparkSession, sf: str) -> DataFrame:
    px = "(20000 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 960001)"
    return table(spark, sf, "lineitem").selectExpr(
        "'OrderFilled' as event", "concat('ex', l_suppkey % 4) as exchange", "concat('acct', l_suppkey % 5) as maker", "concat('acct', (l_suppkey + 2) % 5) as taker", "cast(l_partkey as string) as token_id",
        "cast((l_partkey + l_linenumber + 1) % 2 as int) as flip", "cast(if((l_partkey + l_linenumber) % 2 = 0, 1, 0) as tinyint) as side", "cast(cast(l_quantity as bigint) * 1000000 as string) as qty_raw", f"cast(cast(l_quantity as bigint) * {px} as string) as cash_raw",
        "l_orderkey as block_number", "l_linenumber as log_index", "concat('x', l_orderkey) as tx_hash", f"{_ns('l_shipdate')} + (l_orderkey % 86400) * 1000000000 as t_block_ns", f"{_ns('l_shipdate')} + (l_orderkey % 86400 + (l_linenumber - 2) * 4) * 1000000000 as t_recv_ns",
    ).withColumns({"maker_amount_raw": F.expr("if(side = 0, cash_raw, qty_raw)"), "taker_amount_raw": F.expr("if(side = 0, qty_raw, cash_raw)")}).drop("flip", "qty_raw", "cash_raw")


def markets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("cast(p_partkey as string) as token_id", *_market("p_partkey"), "788918400D + p_partkey * 86400D as start_date_unix", "1009843200D + p_partkey * 60D as end_date_unix")


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Markets with an outcome; every seventh is unresolved."""
    return table(spark, sf, "part").where("p_partkey % 2 = 0 and (p_partkey div 2) % 7 <> 0").selectExpr("concat('m', p_partkey div 2) as market", "cast(p_size % 2 as int) as up_wins")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_type as symbol", f"{_ns('ts')} as t_ns", "100D + value as mid", "event_id")


def levels_raw(spark: SparkSession, sf: str) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') as int)"
    return table(spark, sf, "events").selectExpr("cast(user_id % 40 as string) as token_id", "concat('m', (user_id % 40) div 2) as market", f"element_at(array('0.450000','0.500000','0.550000'), {k} % 3 + 1) as price", "if(event_id % 2 = 0, 'BUY', 'SELL') as side", "if(event_id % 3 = 0, 0D, value) as size", f"{_ns('ts')} as t_recv_ns")


def book_fills(spark: SparkSession, sf: str) -> DataFrame:
    """Prints close to level updates in time: clicks and purchases, shifted by up to three seconds."""
    k = "cast(get_json_object(props, '$.k') as int)"
    return table(spark, sf, "events").where("event_type in ('click', 'purchase')").selectExpr("event_id", "cast(user_id % 40 as string) as token_id", "concat('m', (user_id % 40) div 2) as market", "if(user_id % 2 = 0, 'Up', 'Down') as outcome_side", f"element_at(array('0.450000','0.500000','0.550000'), {k} % 3 + 1) as price", "if(event_id % 2 = 0, 'BUY', 'SELL') as side", "value as size", f"{_ns('ts')} + (event_id % 7 - 3) * 1000000000 as t_ns")


SQL_VIEWS = {
    "fills": """SELECT CAST(l_partkey AS VARCHAR) AS token_id, 'm' || (l_partkey // 2) AS market, ['BTC','ETH','SOL','XRP'][(l_partkey // 2) % 4 + 1] AS asset_symbol,
      ['5m','15m','1h'][(l_partkey // 2) % 3 + 1] AS horizon, CASE WHEN l_partkey % 2 = 0 THEN 'Up' ELSE 'Down' END AS outcome_side, l_orderkey AS block_number, l_linenumber AS log_index, 'x' || l_orderkey AS tx_hash,
      epoch_us(l_shipdate) * 1000 + (l_orderkey % 86400) * 1000000000 AS t_block_ns, epoch_us(l_shipdate) * 1000 + (l_orderkey % 86400 + (l_linenumber - 2) * 4) * 1000000000 AS t_recv_ns,
      CASE WHEN (l_partkey + l_linenumber) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(20000 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 960001 AS DOUBLE) / 1000000 AS price, l_quantity AS size, l_suppkey % 3 = 0 AS is_maker,
      CASE WHEN l_suppkey % 3 = 0 THEN CAST(0.014 AS DOUBLE) * least(CAST(20000 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 960001 AS DOUBLE) / 1000000, 1 - CAST(20000 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 960001 AS DOUBLE) / 1000000) * l_quantity ELSE 0 END AS maker_rebate FROM lineitem""",
    "markets": """SELECT CAST(p_partkey AS VARCHAR) AS token_id, 'm' || (p_partkey // 2) AS market, ['BTC','ETH','SOL','XRP'][(p_partkey // 2) % 4 + 1] AS asset_symbol, ['5m','15m','1h'][(p_partkey // 2) % 3 + 1] AS horizon,
      CASE WHEN p_partkey % 2 = 0 THEN 'Up' ELSE 'Down' END AS outcome_side, CAST(788918400 + p_partkey * 86400 AS DOUBLE) AS start_date_unix, CAST(1009843200 + p_partkey * 60 AS DOUBLE) AS end_date_unix FROM part""",
    "resolved": "SELECT 'm' || (p_partkey // 2) AS market, p_size % 2 AS up_wins FROM part WHERE p_partkey % 2 = 0 AND (p_partkey // 2) % 7 <> 0",
    "canon": """SELECT f.*, CASE WHEN (side = 'BUY') = (outcome_side = 'Up') THEN 1 ELSE -1 END AS canonical_sign, CASE WHEN outcome_side = 'Up' THEN price ELSE 1 - price END AS up_price FROM fills f""",
    "marked": "SELECT c.*, r.up_wins, c.canonical_sign * (r.up_wins - c.up_price) * c.size AS mtm FROM canon c LEFT JOIN resolved r ON c.market = r.market",
    "mpnl": """SELECT market, asset_symbol, horizon, sum(maker_rebate) AS rebate, sum(mtm) AS mtm, max(up_wins) AS up_wins, avg(canonical_sign) AS mean_sign, count(*) AS n, sum(maker_rebate) + coalesce(sum(mtm), 0) AS net,
      CASE WHEN max(up_wins) IS NULL THEN NULL WHEN abs(avg(canonical_sign)) < 0.1 THEN 'mixed' WHEN (avg(canonical_sign) > 0) = (max(up_wins) = 1) THEN 'favourable' ELSE 'unfavourable' END AS outcome_type FROM marked GROUP BY ALL""",
    "inv": """SELECT *, abs(position) * price AS exposure FROM (SELECT *, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) OVER (PARTITION BY token_id ORDER BY block_number, log_index, size, price, side ROWS UNBOUNDED PRECEDING) AS position FROM fills)""",
    "ticks": "SELECT event_type AS symbol, epoch_us(ts) * 1000 AS t_ns, 100 + value AS mid, event_id FROM events",
    "raw_levels": """SELECT CAST(user_id % 40 AS VARCHAR) AS token_id, 'm' || ((user_id % 40) // 2) AS market, ['0.450000','0.500000','0.550000'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 + 1] AS price,
      CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS size, epoch_us(ts) * 1000 AS t_recv_ns FROM events""",
    "levels": """SELECT *, size - size_before AS delta, CASE WHEN size - size_before > 0.001 THEN 'new_order' WHEN size - size_before < -0.001 THEN 'cancel_or_fill' ELSE 'no_change' END AS classification
      FROM (SELECT *, coalesce(lag(size) OVER (PARTITION BY token_id, price, side ORDER BY t_recv_ns, size), 0) AS size_before FROM raw_levels)""",
    "book_fills": """SELECT event_id, CAST(user_id % 40 AS VARCHAR) AS token_id, 'm' || ((user_id % 40) // 2) AS market, CASE WHEN user_id % 2 = 0 THEN 'Up' ELSE 'Down' END AS outcome_side, ['0.450000','0.500000','0.550000'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 + 1] AS price,
      CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, value AS size, epoch_us(ts) * 1000 + (event_id % 7 - 3) * 1000000000 AS t_ns FROM events WHERE event_type IN ('click', 'purchase')""",
    "bars": """SELECT symbol, t_ns // 3600000000000 AS bar, arg_min(mid, t_ns) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, t_ns) AS close, max(t_ns) AS t_ns, count(*) AS n_ticks FROM ticks GROUP BY 1, 2""",
    "rets": "SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar)) AS r FROM bars",
    "market_slots": """SELECT o_orderkey, ['BTC','ETH','SOL','XRP'][o_custkey % 4 + 1] AS asset_symbol, epoch_us(o_orderdate) * 1000 + (o_orderkey % 86400) * 1000000000 AS start_ns,
      epoch_us(o_orderdate) * 1000 + (o_orderkey % 86400 + [300, 900, 3600][o_orderkey % 3 + 1] * 20) * 1000000000 AS end_ns FROM orders""",
}
NEEDS = {"canon": ["fills"], "marked": ["fills", "canon", "resolved"], "mpnl": ["fills", "canon", "resolved", "marked"], "inv": ["fills"], "levels": ["raw_levels"], "bars": ["ticks"], "rets": ["ticks", "bars"]}


def with_views(body: str) -> str:
    """SQL with the views that its text names put before it."""
    used = {v for v in SQL_VIEWS if re.search(rf"\b{v}\b", body)}
    used |= {n for v in used for n in NEEDS.get(v, [])}
    ctes = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in SQL_VIEWS if v in used)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def market_slots(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{_ns('o_orderdate')} + (o_orderkey % 86400"
    return table(spark, sf, "orders").selectExpr("o_orderkey", "element_at(array('BTC','ETH','SOL','XRP'), cast(o_custkey % 4 as int) + 1) as asset_symbol", f"{at}) * 1000000000 as start_ns", f"{at} + element_at(array(300, 900, 3600), cast(o_orderkey % 3 as int) + 1) * 20) * 1000000000 as end_ns")
