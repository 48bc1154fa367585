"""Collects queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


#: The adapters in SQL, as common table expressions.
COMMENTS = """comments AS (
  SELECT l_orderkey * 10 + l_linenumber AS comment_id, l_orderkey AS content_id, l_suppkey AS user_id, CAST(l_quantity AS BIGINT) AS like_count,
         l_shipdate AS created_at, CAST(floor(l_tax * 100) AS BIGINT) AS reply_count, l_partkey, l_extendedprice FROM lineitem)"""
SEQ = "created_at, l_partkey, user_id, l_extendedprice"
SEQ_DESC = "created_at DESC, l_partkey DESC, user_id DESC, l_extendedprice DESC"
CONTENTS = """contents AS (
  SELECT o_orderkey AS content_id, o_custkey AS owner_id, o_totalprice AS view_count, o_orderdate AS published_at, o_orderpriority AS source, o_orderstatus AS status FROM orders)"""
USERS = """users AS (
  SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS sign, CAST(greatest(0, floor(c_acctbal)) AS BIGINT) AS follower,
         CAST(c_nationkey * 40 AS BIGINT) AS following, CAST(c_custkey % 7 AS INTEGER) AS level,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'face' || c_custkey || '.jpg' END AS avatar,
         CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE -1 END AS verify_type,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 3 END AS post_count,
         CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE c_custkey % 2 END AS upload_count,
         CASE WHEN c_custkey % 2 = 0 THEN '20' || lpad(CAST(c_custkey % 25 AS VARCHAR), 2, '0') || '-03-01' ELSE CAST(c_custkey * 1000000 AS VARCHAR) END AS registered_raw FROM customer)"""
TIMED = """timed AS (
  SELECT event_id AS comment_id, event_type AS content_id, user_id, ts AS created_at, CAST(floor(value) AS BIGINT) AS like_count FROM events)"""
TEXTS = """texts AS (
  SELECT doc_id AS comment_id, lang AS content_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS user_id, text FROM documents)"""
THREADS = """threads AS (
  SELECT (conv_id + 1) * 100 + turn AS comment_id, CASE WHEN turn = 0 THEN 0 ELSE (conv_id + 1) * 100 END AS root_id,
         CASE WHEN turn = 0 THEN 0 ELSE (conv_id + 1) * 100 + turn - 1 END AS parent_id, role AS user_name, turn AS seq, text FROM conversations)"""
VERDICTS = "verdicts AS (SELECT doc_id AS user_id, toxic AS type_id, CAST(50 + 40 * quality AS DOUBLE) AS confidence FROM labels)"
POSTS = "posts AS (SELECT comment_id AS post_id, user_id, text, comment_id % 3 = 0 AS is_repost FROM texts WHERE content_id <> 'en')"
SCORED = "scored AS (SELECT doc_id AS user_id, lang AS content_id, n_chars % 1001 / 10 AS score FROM documents)"
