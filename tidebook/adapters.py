"""Market-data views over the star-schema tables, in the same SQL for Spark and DuckDB.

Prices are integer ticks and quantities integers, so that sums are exact in both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Tokens that differ: milliseconds, a JSON field, and integer division.
SPARK = {"{MS}": "unix_millis(cast(ts as timestamp))", "{K}": "get_json_object(props,'$.k')", "//": "div"}
DUCK = {"{MS}": "epoch_us(ts) // 1000", "{K}": "json_extract_string(props,'$.k')", "//": "//"}

VIEWS = {
    "quotes": """
        select event_id as seq, user_id % 4 as session_id, {MS} as time_ms,
               cast(round(value*100) as bigint) as bid, cast(round(value*100) as bigint) + 1 + event_id % 5 as ask,
               1 + user_id % 9 as bid_qty, 1 + event_id % 7 as ask_qty
        from events where event_type in ('view','click','signup')""",
    "trades": """
        select event_id as seq, user_id % 4 as session_id, {MS} as time_ms, cast(round(value*100) as bigint) as price,
               1 + cast({K} as bigint) as qty, event_id % 2 = 0 as is_buyer_maker, event_id as agg_trade_id
        from events where event_type = 'purchase'""",
    "fills": """
        select event_id as seq, event_id as fill_id, user_id % 4 as session_id, event_id // 3 as order_id, {MS} as time_ms,
               case when cast({K} as bigint) % 2 = 0 then 'buy' else 'sell' end as side,
               cast(round(value*100) as bigint) as price, 1 + cast({K} as bigint) % 10 as qty, event_id % 10 <> 0 as is_maker
        from events where event_type = 'purchase'""",
    "level_updates": """
        select event_id as seq, user_id % 4 as session_id, event_id // 500 as segment_id,
               case when event_id % 2 = 0 then 'bid' else 'ask' end as side,
               cast(floor(value) as bigint) + case when event_id % 2 = 0 then 0 else 500 end as price,
               cast({K} as bigint) % 5 as qty
        from events""",
    "diffs": """
        select event_id as seq, user_id % 4 as session_id, {MS} as time_ms,
               event_id * 10 + case when event_id % 50 = 0 then 1 else 0 end as first_update_id,
               event_id * 10 + 9 as last_update_id
        from events""",
    "bars": """
        select cast(o_orderdate as date) as day, min_by(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
               min(o_totalprice) as low, max_by(o_totalprice, o_orderkey) as close, count(*) as volume
        from orders group by 1""",
}
TABLES = {"bars": "orders"}


def _in(tokens: dict[str, str], sql: str) -> str:
    for k, v in tokens.items():
        sql = sql.replace(k, v)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables in ``sf_dir``."""
    table = TABLES.get(name, "events")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(_in(SPARK, VIEWS[name]).replace(f"from {table}", "from {rows}"), rows=rows)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that ``sql`` names put before it."""
    used = [f"{n} as ({_in(DUCK, v)})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    body = sql.strip()
    if not used:
        return body
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(used) + ",\n" + body[15:]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(used) + ",\n" + body[5:]
    return "with " + ",\n".join(used) + "\n" + body
