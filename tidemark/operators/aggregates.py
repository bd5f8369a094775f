"""Aggregations, windows and top-k over the evidence tables."""

from __future__ import annotations

from tidemark.plans.dialect import Dialect
from tidemark.plans.run import Query


def source_and_group_counts(d: Dialect) -> str:
    """Distinct sources and distinct independence groups of each event in one pass."""
    return """SELECT m.event_id, count(DISTINCT m.source_id) AS sources, count(DISTINCT coalesce(s.independence_group, concat('source-', m.source_id))) AS groups_n
        FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id WHERE m.decision IN ('accepted', 'provisional') GROUP BY m.event_id"""


def velocity_groups(d: Dialect) -> str:
    """Groups within 24 hours before the moment, groups before that, and the trend velocity; no decision filter."""
    cut = f"{d.now('1999-01-01 00:00:00')} - 86400"
    return f"""SELECT event_id, recent, prior, {d.real("CASE WHEN recent >= 2 THEN least(1.0, recent / greatest(2.0, prior / 7.0)) ELSE 0.0 END")} AS velocity FROM (
        SELECT event_id, count(DISTINCT CASE WHEN published_at >= {cut} THEN source_id END) AS recent, count(DISTINCT CASE WHEN published_at < {cut} THEN source_id END) AS prior
        FROM v_memberships GROUP BY event_id) x"""


def ecosystem_group_counts(d: Dialect) -> str:
    """Independent groups by ecosystem, and whether an event has two on each side."""
    return """SELECT m.event_id, count(DISTINCT CASE WHEN s.ecosystem = 'chinaFocused' THEN s.independence_group END) AS china, count(DISTINCT CASE WHEN s.ecosystem = 'globalFocused' THEN s.independence_group END) AS global_n,
        count(DISTINCT CASE WHEN s.ecosystem = 'chinaFocused' THEN s.independence_group END) >= 2 AND count(DISTINCT CASE WHEN s.ecosystem = 'globalFocused' THEN s.independence_group END) >= 2 AS qualifies
        FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id GROUP BY m.event_id"""


def topic_rollup_max(d: Dialect) -> str:
    """The largest confidence of each topic of an event."""
    return f"SELECT m.event_id, t.topic, {d.real('max(m.confidence)')} AS confidence FROM v_memberships m JOIN v_topics t ON t.item_id = m.item_id WHERE m.decision = 'accepted' GROUP BY m.event_id, t.topic"


def topic_event_counts(d: Dialect) -> str:
    """Events by topic, topics without events included."""
    return "SELECT t.topic, coalesce(c.events_n, 0) AS events_n FROM (SELECT DISTINCT topic FROM v_topics) t LEFT JOIN (SELECT t.topic, count(DISTINCT m.event_id) AS events_n FROM v_memberships m JOIN v_topics t ON t.item_id = m.item_id WHERE m.confidence > 0.85 GROUP BY t.topic) c ON c.topic = t.topic"


def keep_oldest_alias(d: Dialect) -> str:
    """De-duplicates by normalized name, keeping the smallest id."""
    return "SELECT item_id, name FROM v_topics WHERE item_id IN (SELECT min(item_id) FROM v_topics GROUP BY lower(name))"


def collect_topic_sets(d: Dialect) -> str:
    """Sets gathered in order: topics and sources of an event."""
    string = "STRING" if d.spark else "VARCHAR"
    return f"SELECT m.event_id, {d.join(d.gather('t.topic'))} AS topics, {d.join(d.gather(f'CAST(m.source_id AS {string})'))} AS sources FROM v_memberships m JOIN v_topics t ON t.item_id = m.item_id WHERE m.decision = 'accepted' GROUP BY m.event_id"


def ordered_hash_list(d: Dialect) -> str:
    """Segment hashes of an item in the order of their ordinals."""
    row = f"struct(ordinal, {d.sha256('text')} AS h)" if d.spark else f"{{'ordinal': ordinal, 'h': {d.sha256('text')}}}"
    short = d.map(d.gather_all(row), "s", "substr(s.h, 1, 12)")
    return f"SELECT item_id, count(*) AS segments, {d.join(short)} AS hashes FROM v_segments GROUP BY item_id"


def weighted_membership_sum(d: Dialect) -> str:
    """Identity weight of each event: confidence by 1, or by half where provisional; negative weights count nothing."""
    weight = "greatest(0.0, confidence * CASE decision WHEN 'accepted' THEN CASE WHEN provenance = 'user' THEN 1.5 ELSE 1.0 END WHEN 'provisional' THEN 0.5 ELSE 0.0 END)"
    return f"SELECT event_id, {d.real(f'sum({weight})')} AS weight, min(published_at) AS started_at, max(published_at) AS ended_at FROM v_memberships GROUP BY event_id"


def nearest_rank_percentile(d: Dialect) -> str:
    """p50 and p95 by nearest rank: the element at ceil((n - 1) * q) of the sorted values, from 0.

    Values are counted in ranges of one first, and only the range that a rank falls in is put in order.
    """
    ranges = "SELECT metric, floor(value) AS bucket, count(*) AS n FROM v_metrics WHERE value IS NOT NULL GROUP BY metric, floor(value)"
    upto = f"SELECT metric, bucket, n, sum(n) OVER (PARTITION BY metric ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY metric) AS total FROM ({ranges}) r"
    asked = f"SELECT metric, bucket, total, q, ceil((total - 1) * q) - (upto - n) AS place FROM ({upto}) u CROSS JOIN (SELECT 0.5 AS q UNION ALL SELECT 0.95) t WHERE ceil((total - 1) * q) < upto AND ceil((total - 1) * q) >= upto - n"
    counted = f"SELECT a.metric, a.q, a.total, a.place, m.value, count(*) AS n FROM ({asked}) a JOIN v_metrics m ON m.metric = a.metric AND floor(m.value) = a.bucket GROUP BY a.metric, a.q, a.total, a.place, m.value"
    at = lambda q: f"min(CASE WHEN q = {q} AND upto > place THEN value END)"
    return f"""SELECT metric, CAST(max(total) AS BIGINT) AS n, {d.real(at('0.5'))} AS p50, {d.real(at('0.95'))} AS p95 FROM (
        SELECT *, sum(n) OVER (PARTITION BY metric, q ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto FROM ({counted}) c) x GROUP BY metric"""


def latest_row_per_key(d: Dialect) -> str:
    """The latest membership of each source; ties by event, item and place."""
    return "SELECT source_id, event_id, item_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, event_id, item_id, ordinal, quantity) AS rn FROM v_memberships) x WHERE rn = 1"


def revision_ordinals(d: Dialect) -> str:
    """Revisions at changes of content: an item's row opens one if its body differs from the one before."""
    return f"""SELECT item_id, ordinal, row_number() OVER (PARTITION BY item_id ORDER BY ordinal) AS revision FROM (
        SELECT item_id, ordinal, {d.sha256("body")} AS h, lag({d.sha256("body")}) OVER (PARTITION BY item_id ORDER BY ordinal) AS before FROM v_revisions) x WHERE before IS NULL OR h <> before"""


def revision_ledger(d: Dialect) -> str:
    """Revisions under the commit ledger: content seen before under the same item is dropped for good."""
    return f"""SELECT item_id, ordinal, row_number() OVER (PARTITION BY item_id ORDER BY ordinal) AS revision FROM (
        SELECT item_id, min(ordinal) AS ordinal FROM (SELECT item_id, ordinal, {d.sha256("body")} AS h FROM v_revisions) y GROUP BY item_id, h) x"""


def metric_velocity_per_hour(d: Dialect) -> str:
    """Growth per hour of each series from its first to its last value, at least 0; null with under two times."""
    first, last = ("min_by", "max_by") if d.spark else ("arg_min", "arg_max")
    key = "captured_at * 10000000 + event_id"
    return f"""SELECT item_id, metric, CASE WHEN hi > lo THEN {d.real("greatest(0.0, b - a) / ((hi - lo) / 3600.0)")} END AS per_hour FROM (
        SELECT item_id, metric, min(captured_at) AS lo, max(captured_at) AS hi, {first}(value, {key}) AS a, {last}(value, {key}) AS b FROM v_metrics GROUP BY item_id, metric) x"""


def heading_propagation(d: Dialect) -> str:
    """Each paragraph with the last heading above it and its byte offset in the text."""
    ignore = "last(CASE WHEN kind = 'heading' THEN text END, true)" if d.spark else "last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS)"
    over = "OVER (PARTITION BY item_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    return f"""SELECT item_id, ordinal, kind, {d.sha256("coalesce(heading, '')")} AS heading_hash, utf8_start, utf8_length FROM (
        SELECT item_id, ordinal, kind, {ignore} {over.format('CURRENT ROW')} AS heading,
        CAST(coalesce(sum({d.n_bytes("text")} + 1) {over.format('1 PRECEDING')}, 0) AS BIGINT) AS utf8_start, {d.n_bytes("text")} AS utf8_length FROM v_segments) x"""


def read_status(d: Dialect) -> str:
    """Read, updated or unread by comparing ordinals with the last one seen."""
    return """SELECT r.item_id, CASE WHEN s.seen IS NULL OR s.manual_unread THEN 'unread' WHEN s.seen = r.ordinal THEN 'read' WHEN r.ordinal > s.seen THEN 'updated' ELSE 'read' END AS status
        FROM (SELECT item_id, max(ordinal) AS ordinal FROM v_revisions GROUP BY item_id) r
        LEFT JOIN (SELECT item_id, max(CASE WHEN author = 'user' THEN ordinal END) AS seen, item_id % 5 = 0 AS manual_unread FROM v_revisions GROUP BY item_id) s ON s.item_id = r.item_id"""


def digest_rank(d: Dialect) -> str:
    """Rank within a section, from 0: the fifteen that a digest can take."""
    return "SELECT event_id, section, rn - 1 AS rank_n FROM (SELECT event_id, title AS section, row_number() OVER (PARTITION BY title ORDER BY weight DESC, event_id) AS rn FROM v_events WHERE lifecycle = 'active') x WHERE rn <= 15"


def initial_and_current_revision(d: Dialect) -> str:
    """The first and the latest revision of a day."""
    day, key = "CAST(floor(captured_at / 86400) AS BIGINT)", "captured_at * 10000000 + event_id"
    first, last = ("min_by", "max_by") if d.spark else ("arg_min", "arg_max")
    return f"SELECT {day} AS day_n, {first}(event_id, {key}) AS initial_id, {last}(event_id, {key}) AS current_id FROM v_metrics GROUP BY {day}"


def top_per_topic(d: Dialect) -> str:
    """The 48 most recent items of each topic."""
    return "SELECT topic, item_id, rn FROM (SELECT t.topic, t.item_id, row_number() OVER (PARTITION BY t.topic ORDER BY t.price DESC, t.item_id) AS rn FROM v_topics t) x WHERE rn <= 48"


def stable_distinct(d: Dialect) -> str:
    """Distinct words of a text in the order of their first occurrence."""
    words = d.filter(d.split("lower(concat(name, ' ', topic_kind, ' ', name))", r"\s+"), "w", "w <> ''")
    once = f"array_distinct({words})" if d.spark else f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"
    return f"SELECT item_id, {d.join(once, chr(39) + ' ' + chr(39))} AS words, {d.size(once)} AS n FROM v_topics"


def duplicate_family_summary(d: Dialect) -> str:
    """Groups, members and the largest group of equal contents."""
    return "SELECT count(*) AS groups_n, CAST(sum(n) AS BIGINT) AS members, max(n) AS largest FROM (SELECT content_hash, count(*) AS n FROM v_items GROUP BY content_hash HAVING count(*) > 1) x"


def x_grouping_sets(d: Dialect) -> str:
    """Extra, not in the reference: totals by ecosystem and decision, by each, and overall."""
    return "SELECT s.ecosystem, m.decision, count(*) AS n FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id GROUP BY GROUPING SETS ((s.ecosystem, m.decision), (s.ecosystem), ())"


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        source_and_group_counts, velocity_groups, ecosystem_group_counts, topic_rollup_max, topic_event_counts, keep_oldest_alias,
        collect_topic_sets, ordered_hash_list, weighted_membership_sum, nearest_rank_percentile, latest_row_per_key, revision_ordinals,
        revision_ledger, metric_velocity_per_hour, heading_propagation, read_status, digest_rank, initial_and_current_revision,
        top_per_topic, stable_distinct, duplicate_family_summary, x_grouping_sets,
    )
}
