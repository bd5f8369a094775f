"""The evidence model's tables as views of the tables at hand, for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from tidemark.plans.dialect import Dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _items(d: Dialect) -> str:
    return f"""SELECT doc_id AS item_id, source AS source_id, lang AS language_code, split_part(text, {d.newline}, 1) AS title,
        text AS plain_text, {d.sha256(f"concat(split_part(text, {d.newline}, 1), {d.newline}, {d.newline}, text)")} AS content_hash,
        CAST(1704067200 + (doc_id * 37 % 43200) * 60 AS BIGINT) AS published_at, CAST(doc_id AS {'STRING' if d.spark else 'VARCHAR'}) AS external_id
        FROM documents WHERE text IS NOT NULL"""


def _evidence(d: Dialect) -> str:
    """Items with the identities that duplicate detection reads, and short items that quote others by their URLs."""
    string = "STRING" if d.spark else "VARCHAR"
    part = lambda n: f"CAST(CAST(floor(item_id / {n}.0) AS BIGINT) AS {string})"
    url = f"""CASE WHEN item_id % 7 = 0 THEN concat('https://example.org/', source_id, '/a', {part(280)}) WHEN item_id % 10 <> 3 THEN concat('https://example.org/', source_id, '/', CAST(item_id AS {string})) END"""
    return f"""SELECT item_id, source_id, language_code, title, plain_text, content_hash, published_at,
        CASE WHEN item_id % 11 = 0 THEN '' WHEN item_id % 13 = 0 THEN concat('x', {part(520)}) ELSE external_id END AS external_id,
        {url} AS canonical_url, CASE WHEN item_id % 9 <> 0 THEN concat('  Desk of ', source_id, ' ') END AS author FROM v_items
        UNION ALL SELECT 1000000000 + item_id, 'quotes', language_code, title, concat(title, {d.newline}, 'Via ', {url}), {d.sha256(f"concat('quotes', {url})")}, published_at + 3600,
        concat('q', external_id), NULL, 'Desk of quotes' FROM v_items WHERE item_id % 20 = 1 AND {url} IS NOT NULL"""


def _segments(d: Dialect) -> str:
    parts = f"split(plain_text, '\\\\n')" if d.spark else "string_split(plain_text, chr(10))"
    return f"""SELECT item_id, source_id, language_code, published_at, CAST(ordinal AS BIGINT) AS ordinal, part AS text,
        CASE WHEN length(part) < 100 AND ({d.starts("part", "'#'")} OR NOT {d.matches("part", "[.。，]")}) THEN 'heading' ELSE 'paragraph' END AS kind
        FROM {d.explode(f"(SELECT *, {parts} AS parts FROM v_items)", "parts", "part", "ordinal")}"""


VIEWS: dict[str, Callable[[Dialect], str]] = {
    "v_items": _items,
    "v_segments": _segments,
    "v_evidence": _evidence,
    "v_revisions": lambda d: "SELECT conv_id AS item_id, turn AS ordinal, role AS author, text AS body FROM conversations",
    "v_metrics": lambda d: f"SELECT event_id, user_id AS item_id, event_type AS metric, value, {d.seconds('ts')} AS captured_at FROM events",
    "v_events": lambda d: f"""SELECT o_orderkey AS event_id, o_custkey AS entity_id, {d.seconds('o_orderdate')} AS started_at, o_orderpriority AS title, o_totalprice AS weight,
        CASE o_orderstatus WHEN 'F' THEN 'archived' ELSE 'active' END AS lifecycle, o_orderstatus = 'P' AS is_tombstoned, o_custkey % 13 = 0 AS is_saved,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'majorUpdate' WHEN '2-HIGH' THEN 'contentUpdate' WHEN '3-MEDIUM' THEN 'correction' WHEN '4-NOT SPECIFIED' THEN 'merge' ELSE 'minorMetadata' END AS change_kind FROM orders""",
    "v_memberships": lambda d: f"""SELECT l_orderkey AS event_id, l_partkey AS item_id, l_suppkey AS source_id, l_linenumber AS ordinal,
        greatest(0.0, least(1.0, l_discount * 10)) AS confidence, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'provisional' END AS decision,
        CASE l_linestatus WHEN 'O' THEN 'independent' ELSE 'repeated' END AS role, CASE WHEN l_tax >= 0.07 THEN 'user' ELSE 'deterministic' END AS provenance, {d.seconds('l_shipdate')} AS published_at, l_quantity AS quantity FROM lineitem""",
    "v_sources": lambda d: """SELECT s_suppkey AS source_id, s_name AS display_name, n_name AS independence_group, s_acctbal AS balance,
        CASE r_name WHEN 'ASIA' THEN 'chinaFocused' WHEN 'EUROPE' THEN 'globalFocused' WHEN 'AMERICA' THEN 'globalFocused' WHEN 'MIDDLE EAST' THEN 'mixed' ELSE 'unknown' END AS ecosystem,
        s_suppkey % 7 = 0 AS is_followed FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_topics": lambda d: "SELECT p_partkey AS item_id, p_brand AS topic, p_type AS topic_kind, p_size AS size, p_retailprice AS price, p_name AS name, p_size % 9 = 0 AS is_followed FROM part",
    "v_entities": lambda d: "SELECT c_custkey AS entity_id, c_name AS display_name, lower(c_name) AS normalized_name, c_mktsegment AS kind, c_nationkey AS nation_id, c_acctbal AS balance, c_custkey % 11 = 0 AS is_followed FROM customer",
    "v_pages": lambda d: "SELECT page_id, url, html FROM pages",
}


def with_views(sql: str, d: Dialect) -> str:
    """sql with the views that it names, and those that they name, put in front."""
    used: dict[str, str] = {}

    def add(text: str) -> None:
        for name in sorted(set(re.findall(r"\bv_[a-z]+\b", text)) & set(VIEWS)):
            if name not in used:
                body = VIEWS[name](d)
                add(body)
                used[name] = body

    add(sql)
    head = ",\n".join(f"{k} AS ({v})" for k, v in used.items())
    if not head:
        return sql
    own = sql.lstrip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if own.startswith(opening):
            return f"{opening}{head},\n{own.removeprefix(opening)}"
    return f"WITH {head}\n{own}"
