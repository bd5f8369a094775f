"""Filters, joins and set operations over the evidence tables."""

from __future__ import annotations

from tidemark.plans.dialect import Dialect
from tidemark.plans.run import Query

NOW = "1999-01-01 00:00:00"


def scan_live_items(d: Dialect) -> str:
    """Live items: neither removed at the source nor by the reader (here: labels of low quality stand for removal at the source, toxic ones for removal by the reader)."""
    return """SELECT i.item_id, i.source_id, i.language_code, i.content_hash, i.published_at FROM v_items i LEFT JOIN labels l ON l.doc_id = i.item_id
        WHERE coalesce(l.quality, 1) <> 0 AND coalesce(l.toxic, 0) = 0"""


def active_events_topn(d: Dialect) -> str:
    """The latest 500 active events; ties by id."""
    return "SELECT event_id, title, started_at FROM v_events WHERE NOT is_tombstoned AND lifecycle = 'active' ORDER BY coalesce(started_at, 0) DESC, event_id LIMIT 500"


def current_revision_join(d: Dialect) -> str:
    """Header and current revision: the one of the largest ordinal of each item."""
    return """SELECT h.item_id, r.ordinal, r.author, r.body FROM (SELECT item_id, max(ordinal) AS current_ordinal FROM v_revisions GROUP BY item_id) h
        JOIN v_revisions r ON r.item_id = h.item_id AND r.ordinal = h.current_ordinal"""


def event_evidence_star(d: Dialect) -> str:
    """Event, membership, item, source and topic in one star; small dimensions are left to the engine to broadcast."""
    return """SELECT e.event_id, m.item_id, m.ordinal, m.confidence, s.display_name, s.ecosystem, t.topic, t.name AS item_name,
        CASE WHEN m.role = 'independent' THEN 0 ELSE 1 END AS role_order
        FROM v_events e JOIN v_memberships m ON m.event_id = e.event_id JOIN v_sources s ON s.source_id = m.source_id JOIN v_topics t ON t.item_id = m.item_id
        WHERE NOT e.is_tombstoned AND m.decision IN ('accepted', 'provisional')"""


def coverage_star(d: Dialect) -> str:
    """Coverage of an event by ecosystem, with the current flag in the join condition."""
    return """SELECT e.event_id, s.ecosystem, count(*) AS pieces, count(DISTINCT s.independence_group) AS groups_n, min(m.published_at) AS first_at
        FROM v_events e JOIN v_memberships m ON m.event_id = e.event_id AND m.decision <> 'rejected' JOIN v_sources s ON s.source_id = m.source_id
        WHERE NOT e.is_tombstoned GROUP BY e.event_id, s.ecosystem"""


def alias_rank_left_join(d: Dialect) -> str:
    """The best alias by name: linked ones first (condition inside the joined side), then confidence, then length, then id."""
    return f"""SELECT normalized_name, entity_id, linked FROM (
        SELECT c.normalized_name, c.entity_id, CASE WHEN o.event_id IS NULL THEN 0 ELSE 1 END AS linked,
               row_number() OVER (PARTITION BY c.kind, c.nation_id ORDER BY CASE WHEN o.event_id IS NULL THEN 1 ELSE 0 END, c.balance DESC, length(c.display_name) DESC, c.entity_id) AS rn
        FROM v_entities c LEFT JOIN (SELECT entity_id, min(event_id) AS event_id FROM v_events WHERE lifecycle = 'active' GROUP BY entity_id) o ON o.entity_id = c.entity_id) x WHERE rn = 1"""


def optional_blob_left_join(d: Dialect) -> str:
    """Items with their optional label row."""
    return "SELECT i.item_id, l.quality, l.toxic, coalesce(l.quality, -1) AS quality_or_default FROM v_items i LEFT JOIN labels l ON l.doc_id = i.item_id"


def revision_history_counts(d: Dialect) -> str:
    """Evidence counts by event, zero included."""
    return "SELECT e.event_id, e.title, count(m.item_id) AS evidence FROM v_events e LEFT JOIN v_memberships m ON m.event_id = e.event_id AND m.decision = 'accepted' GROUP BY e.event_id, e.title"


def official_source_semi(d: Dialect) -> str:
    """Events with evidence from a followed source."""
    return "SELECT e.event_id, e.title FROM v_events e WHERE EXISTS (SELECT 1 FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id WHERE m.event_id = e.event_id AND s.is_followed)"


def followed_flag(d: Dialect) -> str:
    """The same as a flag on each event, from a distinct key set."""
    return """SELECT e.event_id, f.event_id IS NOT NULL AS has_followed FROM v_events e
        LEFT JOIN (SELECT DISTINCT m.event_id FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id WHERE s.is_followed) f ON f.event_id = e.event_id"""


def pending_segments_anti(d: Dialect) -> str:
    """Documents and parts without an accepted or provisional membership."""
    return "SELECT t.item_id, t.kind FROM (SELECT item_id, 'part' AS kind FROM v_topics UNION ALL SELECT -1 - item_id, 'document' FROM v_items) t WHERE NOT EXISTS (SELECT 1 FROM v_memberships m WHERE m.item_id = t.item_id AND m.decision IN ('accepted', 'provisional'))"


def unreferenced_triple_anti(d: Dialect) -> str:
    """Entities that no event, no source nation and no followed entity of the same name refers to: three anti joins."""
    return """SELECT c.entity_id FROM v_entities c
        WHERE NOT EXISTS (SELECT 1 FROM v_events e WHERE e.entity_id = c.entity_id AND e.lifecycle = 'archived' AND e.weight > 200000)
          AND NOT EXISTS (SELECT 1 FROM v_events e WHERE e.entity_id = c.entity_id AND e.is_tombstoned)
          AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.nation_id AND s.s_acctbal > 9500)"""


def duplicate_pair_selfjoin(d: Dialect) -> str:
    """Items in a duplicate group of two or more (here: equal content), each with the group's representative and size."""
    return """SELECT i.item_id, g.representative, g.members FROM v_items i
        JOIN (SELECT content_hash, min(item_id) AS representative, count(*) AS members FROM v_items GROUP BY content_hash HAVING count(*) > 1) g ON g.content_hash = i.content_hash"""


def in_subquery_and_not_in(d: Dialect) -> str:
    """IN and NOT IN subqueries."""
    return """SELECT event_id, title FROM v_events WHERE entity_id IN (SELECT entity_id FROM v_entities WHERE is_followed)
        AND event_id NOT IN (SELECT event_id FROM v_memberships WHERE decision = 'rejected')"""


def in_list_and_range(d: Dialect) -> str:
    """A parameter list, a closed range, CASE flags and a null default in one projection."""
    return """SELECT event_id, entity_id, CASE WHEN weight BETWEEN 100000 AND 200000 THEN 1 ELSE 0 END AS in_range, coalesce(nullif(title, '3-MEDIUM'), 'none') AS title_or_none
        FROM v_events WHERE title IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND weight BETWEEN 50000 AND 299999"""


def endpoint_health_scalar_aggs(d: Dialect) -> str:
    """Six figures of each endpoint, each child aggregated before its join."""
    latest = "max_by(decision, published_at * 100 + ordinal)" if d.spark else "arg_max(decision, published_at * 100 + ordinal)"
    return f"""SELECT s.source_id, s.display_name, a.last_at, a.first_at, a.pieces, f.failures, t.items,
        coalesce(f.failures, 0) > coalesce(a.pieces, 0) AS unhealthy
        FROM v_sources s
        LEFT JOIN (SELECT source_id, max(published_at) AS last_at, min(published_at) AS first_at, count(*) AS pieces FROM v_memberships WHERE decision <> 'rejected' GROUP BY source_id) a ON a.source_id = s.source_id
        LEFT JOIN (SELECT source_id, count(*) AS failures FROM v_memberships WHERE decision = 'rejected' GROUP BY source_id) f ON f.source_id = s.source_id
        LEFT JOIN (SELECT source_id, count(DISTINCT item_id) AS items FROM v_memberships GROUP BY source_id) t ON t.source_id = s.source_id"""


def endpoint_match_or_join(d: Dialect) -> str:
    """Same group and (same name or same standing): the OR split into two equi-joins, each with the first source of its key."""
    one = "SELECT a.source_id, b.source_id AS match_id FROM v_sources a JOIN (SELECT {0}, min(source_id) AS source_id FROM v_sources GROUP BY {0}) b ON {1} AND a.source_id <> b.source_id"
    on = lambda *cs: (", ".join(cs), " AND ".join(f"a.{c} = b.{c}" for c in cs))
    return f"{one.format(*on('independence_group', 'display_name'))} UNION {one.format(*on('independence_group', 'is_followed', 'ecosystem'))}"


def cannot_link_cross(d: Dialect) -> str:
    """Retained by moving lineages of an event: a product within the event only."""
    return """SELECT DISTINCT a.event_id, a.item_id AS retained, b.item_id AS moving FROM v_memberships a JOIN v_memberships b ON a.event_id = b.event_id
        WHERE a.decision = 'accepted' AND b.decision = 'rejected' AND a.item_id <> b.item_id"""


def null_safe_consent(d: Dialect) -> str:
    """Consent by source where a null source means every source: null-safe equality."""
    same = "l.scope <=> r.scope" if d.spark else "l.scope IS NOT DISTINCT FROM r.scope"
    return f"""SELECT l.entity_id, l.scope, r.granted FROM (SELECT entity_id, CASE WHEN is_followed THEN NULL ELSE kind END AS scope FROM v_entities) l
        JOIN (SELECT CASE WHEN kind = 'BUILDING' THEN NULL ELSE kind END AS scope, count(*) AS granted FROM v_entities GROUP BY CASE WHEN kind = 'BUILDING' THEN NULL ELSE kind END) r ON {same}"""


def expiry_and_due(d: Dialect) -> str:
    """Rows whose expiry is open or ahead, with the 30-minute bucket of the key that makes a refresh happen once."""
    now = d.now("2024-01-15 00:00:00")
    bucket = f"CAST(floor({now} / 1800) AS BIGINT)"
    return f"""SELECT item_id, last_at, concat('scheduled-refresh:', item_id, ':', {bucket}) AS idempotency_key
        FROM (SELECT item_id, max(captured_at) AS last_at, CASE WHEN item_id % 3 > 0 THEN min(captured_at) + (item_id % 50) * 86400 END AS expires_at FROM v_metrics WHERE captured_at <= {now} GROUP BY item_id) m WHERE (last_at IS NULL OR last_at <= {now} - 1800) AND (expires_at IS NULL OR expires_at > {now})"""


def historical_search_union(d: Dialect) -> str:
    """Current and historical search documents in one schema: UNION ALL of six branches."""
    string = "STRING" if d.spark else "VARCHAR"
    return f"""SELECT CAST(item_id AS {string}) AS stable_id, 'item' AS kind, title, plain_text AS body, FALSE AS is_historical FROM v_items
        UNION ALL SELECT CAST(item_id AS {string}), 'item', author, body, TRUE FROM v_revisions
        UNION ALL SELECT CAST(event_id AS {string}), 'event', title, lifecycle, is_tombstoned FROM v_events
        UNION ALL SELECT CAST(entity_id AS {string}), 'entity', display_name, kind, FALSE FROM v_entities
        UNION ALL SELECT CAST(source_id AS {string}), 'source', display_name, ecosystem, FALSE FROM v_sources
        UNION ALL SELECT DISTINCT topic, 'topic', topic, '', FALSE FROM v_topics"""


def set_operations(d: Dialect) -> str:
    """Overlap, Jaccard similarity and difference of each source's accepted topics against all topics of its group."""
    shared = d.common("own", "peers")
    return f"""SELECT source_id, {shared} AS shared, {d.size("own")} AS own_n, {d.size("peers")} AS peers_n, {d.size("peers")} - {shared} AS missing,
        {d.real(f"{shared} * 1.0 / ({d.size('own')} + {d.size('peers')} - {shared})")} AS jaccard
        FROM (SELECT m.source_id, s.independence_group, {d.gather("t.topic")} AS own FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id JOIN v_topics t ON t.item_id = m.item_id WHERE m.decision = 'accepted' GROUP BY m.source_id, s.independence_group) a
        JOIN (SELECT s.independence_group, {d.gather("t.topic")} AS peers FROM v_sources s JOIN v_memberships m ON m.source_id = s.source_id JOIN v_topics t ON t.item_id = m.item_id GROUP BY s.independence_group) b
        ON a.independence_group = b.independence_group"""


def binding_status(d: Dialect) -> str:
    """Casebook bindings: exact, same content, diverged or missing."""
    return f"""SELECT b.item_id AS binding_id, CASE WHEN i.item_id IS NULL THEN 'missing' WHEN i.plain_text = b.text THEN 'exact' WHEN lower(trim(i.plain_text)) = lower(trim(b.text)) THEN 'sameContent' ELSE 'diverged' END AS status
        FROM benchmark b LEFT JOIN v_items i ON i.item_id = b.item_id"""


def hash_join_dictionary(d: Dialect) -> str:
    """Unique-key lookup of each membership's item, counted by event: the lookup reads every membership."""
    return "SELECT m.event_id, count(*) AS found, count(DISTINCT t.topic) AS topics, round(sum(t.price), 2) AS price FROM v_memberships m JOIN v_topics t ON t.item_id = m.item_id GROUP BY m.event_id"


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_live_items, active_events_topn, current_revision_join, event_evidence_star, coverage_star, alias_rank_left_join,
        optional_blob_left_join, revision_history_counts, official_source_semi, followed_flag, pending_segments_anti,
        unreferenced_triple_anti, duplicate_pair_selfjoin, in_subquery_and_not_in, in_list_and_range, endpoint_health_scalar_aggs,
        endpoint_match_or_join, cannot_link_cross, null_safe_consent, expiry_and_due, historical_search_union, set_operations,
        binding_status, hash_join_dictionary,
    )
}
