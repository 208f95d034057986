"""Registered queries: a function of (spark, sf_dir), and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The derived tables of ledgerloom.sources.tables, for SQL.
TABLES = {
    "messages": """
  SELECT user_id AS sid, event_id AS seq, props AS body, event_type, (epoch_us(ts) // 1000) AS ts_ms,
         '/events/' || user_id || '/.updates' AS path, CAST(4 + strlen(props) AS BIGINT) AS size,
         CAST(coalesce(sum(4 + strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS msg_offset,
         CAST(sum(4 + strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS next_offset,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place
  FROM events""",
    "streams": """
  SELECT sid, count(*) AS n, max(next_offset) AS tail,
         max(CASE WHEN place = cnt // 4 THEN msg_offset END) AS trim,
         CASE WHEN sid % 5 > 0 THEN sid % 5 * 86400 END AS ttl_s, max(ts_ms) AS last_access_ms
  FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS cnt FROM messages) GROUP BY sid""",
    "forks": """
  SELECT c.sid, c.sid // 4 AS source, p.tail // 2 AS fork_offset
  FROM streams c JOIN streams p ON p.sid = c.sid // 4 WHERE c.sid > 0""",
    "kv_log": """
  SELECT l_returnflag || l_linestatus AS partition, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS key, seq,
         (seq - 1) // 8 AS batch, (seq - 1) % 8 AS batch_pos,
         CASE WHEN l_quantity < 5 THEN 'delete' ELSE 'put' END AS op,
         l_partkey || '/' || l_suppkey AS value, CAST(l_quantity AS BIGINT) AS amount, l_suppkey AS supplier,
         (epoch_us(l_shipdate) // 1000) AS create_ts,
         CASE WHEN l_linenumber % 3 > 0 THEN (epoch_us(l_shipdate) // 1000) + l_linenumber % 3 * 86400000 END AS expire_ts
  FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq
        FROM lineitem)""",
    "kv_state": """
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY partition, key ORDER BY seq DESC) AS k FROM kv_log)
  WHERE k = 1 AND op <> 'delete'""",
    "merge_log": """
  SELECT supplier AS key, seq, amount,
         CASE WHEN seq % 97 = 0 THEN 'delete' WHEN seq % 50 = 0 THEN 'put' ELSE 'merge' END AS op FROM kv_log""",
    "merge_tail": """
  SELECT m.key, m.seq, m.op, m.amount FROM merge_log m
  LEFT JOIN (SELECT key, max(seq) AS base FROM merge_log WHERE op <> 'merge' GROUP BY key) b ON m.key = b.key
  WHERE m.seq >= coalesce(b.base, 0) AND m.op <> 'delete'""",
    "log_entries": """
  SELECT conv_id AS base, turn AS seq, role, text AS body, CAST(4 + strlen(coalesce(text, '')) AS BIGINT) AS size,
         CAST(coalesce(sum(4 + strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS entry_offset,
         CAST(sum(4 + strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS next_offset
  FROM conversations""",
    "log_snapshots": "SELECT base, next_offset AS snapshot_offset, seq FROM log_entries WHERE seq % 3 = 2",
    "log_index": """
  SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS snap_offset, (epoch_us(o_orderdate) // 1000) AS created_ms,
         o_orderkey AS order_key FROM orders""",
    "files": """
  SELECT source AS partition, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, text AS body, doc_id, lang FROM documents""",
}

#: Which derived tables each of them reads.
NEEDS = {"streams": ["messages"], "forks": ["streams"], "kv_state": ["kv_log"], "merge_log": ["kv_log"], "merge_tail": ["merge_log"], "log_snapshots": ["log_entries"]}


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return order


def query(sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name. sql may read the derived tables that uses names."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            heads = ",\n".join(f"{n} AS ({TABLES[n]})" for n in _closure(uses.split()))
            body = sql.strip()
            if heads and body.upper().startswith("WITH RECURSIVE"):
                SQL[function.__name__] = f"WITH RECURSIVE {heads},\n{body[14:]}"
            elif heads and body.upper().startswith("WITH "):
                SQL[function.__name__] = f"WITH {heads},\n{body[5:]}"
            else:
                SQL[function.__name__] = f"WITH {heads}\n{body}" if heads else body
        return function

    return register
