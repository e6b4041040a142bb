"""Pieces of the oracle SQL."""

EV = """ev AS (SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS user_id, event_type, value AS amount,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, json_extract_string(props, '$.k') AS item_id FROM events)"""

AGGREGATES = """count(*) AS event_count, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN count(*) FILTER (event_type = 'click') END AS click_count,
  CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN count(*) FILTER (event_type = 'purchase') END AS purchase_count,
  round(sum(coalesce(amount, 0)) FILTER (event_type = 'purchase'), 4) AS total_purchase_amount"""

WIDE = f"{EV}, wide AS (SELECT user_id, {AGGREGATES} FROM ev GROUP BY user_id)"


def windows(size: int) -> str:
    return f"win AS (SELECT user_id, t - t % {size} AS window_start, {AGGREGATES} FROM ev GROUP BY ALL)"


def text(x: str) -> str:
    """A number as the engine writes it."""
    return f"regexp_replace(CAST(CAST(round(coalesce(CAST({x} AS DOUBLE), 0), 4) AS DECIMAL(38, 4)) AS VARCHAR), '\\.?0+$', '')"


FEATURES = ("event_count", "click_count", "purchase_count", "total_purchase_amount")


def cells(table: str, prefix: str) -> str:
    """(key, value) rows of a wide table; prefix is the SQL of the key before the feature."""
    return " UNION ALL ".join(f"SELECT {prefix} || '{f}' AS key, {text(f)} AS value FROM {table} WHERE {f} IS NOT NULL" for f in FEATURES)


BATCH_CELLS = cells("wide", "'feature:user:' || user_id || ':'")
WINDOW_CELLS = cells("win", "'feature:user:' || user_id || ':window:' || window_start || ':'")


def ring(shards: tuple[str, ...], nodes: int, name: str = "ring") -> str:
    rows = ", ".join(f"('{s}')" for s in shards)
    return f"{name} AS (SELECT md5(s || '::' || n) AS token, s AS shard_id, CAST(n AS INTEGER) AS virtual_node FROM (VALUES {rows}) v(s), range({nodes}) r(n))"


def routed(keys: str, name: str = "ring") -> str:
    """Rows of a relation with a key, and the shard of each."""
    return f"""(SELECT k.*, coalesce(arg_min(r.shard_id, r.token) FILTER (r.token >= md5(k.key)), arg_min(r.shard_id, r.token)) AS shard_id
  FROM {keys} k CROSS JOIN {name} r GROUP BY ALL)"""
