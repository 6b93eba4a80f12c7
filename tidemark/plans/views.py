"""The logical views as DuckDB common table expressions, for reference SQL."""

from __future__ import annotations

VIEWS = {
    "v_book": """SELECT *, size - filled AS remaining, (CASE WHEN trader_id < 100 THEN 1 WHEN size < 1000 THEN 2 ELSE 3 + trader_id % 12 END)::INTEGER AS slot FROM (
      SELECT *, (CASE status WHEN 'F' THEN size WHEN 'P' THEN size // 2 ELSE 0 END)::BIGINT AS filled FROM (
      SELECT o_orderkey AS order_id, o_orderkey AS seq, o_custkey AS trader_id, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
        (6500000 + (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (1 + round(o_totalprice * 100)::BIGINT % 500))::BIGINT AS price,
        100 + round(o_totalprice * 100)::BIGINT % 20000 AS size, o_orderstatus AS status, 101 + o_custkey % 11 AS symbol FROM orders))""",
    "v_takers": "SELECT l_orderkey AS taker_id, sum(l_quantity)::BIGINT AS size, l_orderkey AS arrival FROM lineitem GROUP BY l_orderkey",
    "v_tx": """SELECT event_id AS arrival, (user_id + 1)::BIGINT AS uid, event_id + (event_id * 7919) % 50 AS nonce,
      CASE event_type WHEN 'signup' THEN 41 WHEN 'view' THEN 0 WHEN 'click' THEN 61 WHEN 'purchase' THEN 65 WHEN 'error' THEN 62 END AS op_code,
      json_extract_string(props, '$.k')::BIGINT % 128 AS market, ts, round(value * 100)::BIGINT AS amount,
      sha256('sig:' || (event_id - CASE WHEN event_id % 17 = 0 AND event_id > 0 THEN 1 ELSE 0 END)::VARCHAR) AS sig FROM events""",
    "v_users": "SELECT c_custkey AS uid, 0::BIGINT AS init_nonce FROM customer WHERE c_acctbal >= -500",
    "v_changes": "SELECT user_id::BIGINT AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, round(value * 100)::BIGINT AS value FROM events",
    "v_store": "SELECT lang AS tree, doc_id AS id, text AS value FROM documents",
    "v_accounts": "SELECT c_custkey AS uid, (c_custkey % 5)::INTEGER AS status, xor(c_custkey, 3405691582) AS email_hash FROM customer",
    "v_balances": "SELECT *, available // 10 AS locked FROM (SELECT c_custkey AS user_id, c_nationkey::BIGINT AS asset_id, abs(round(c_acctbal * 100)::BIGINT) AS available FROM customer)",
    "v_ticks": "SELECT ts, round(value * 100)::BIGINT AS price, event_id AS arrival FROM events",
    "v_target": "SELECT p_partkey AS key, (p_partkey % 2)::INTEGER AS side, round(p_retailprice * 100)::BIGINT AS price, p_size::BIGINT AS qty FROM part",
    "v_managed": """SELECT key, side, price + CASE WHEN key % 3 = 0 THEN 25 ELSE 0 END AS price, qty FROM v_target WHERE key % 10 < 8
      UNION ALL SELECT key + 1000000, side, price, qty FROM v_target WHERE key % 50 = 0""",
}


def with_views(names: str, sql: str) -> str:
    """The SQL after the common table expressions of the views that it names; it may start with more of them after a comma."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    return f"WITH {ctes}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
