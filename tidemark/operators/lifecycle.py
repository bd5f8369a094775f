"""Mutations as set operations: upserts, superseding, tombstones, garbage, leases and ledgers."""

from __future__ import annotations

from tidemark.plans.dialect import Dialect
from tidemark.plans.run import Query


def upsert_current(d: Dialect) -> str:
    """Insert or update by key: the incoming row wins where it has values, else the old one stays."""
    new = "SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier"
    return f"SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, {d.real('coalesce(n.balance, o.balance)', 2)} AS balance FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer) o FULL OUTER JOIN ({new}) n ON n.k = o.k"


def insert_ignore(d: Dialect) -> str:
    """Insert or ignore: the first row of a key stays."""
    return "SELECT topic, item_id FROM (SELECT topic, item_id, row_number() OVER (PARTITION BY topic ORDER BY item_id) AS rn FROM v_topics) x WHERE rn = 1"


def insert_replace(d: Dialect) -> str:
    """Insert or replace under two unique keys, (topic, kind) and name: a row removes all earlier ones that it meets on either.

    So what stays is the last row of each of its keys.
    """
    return """SELECT v.item_id, v.topic, v.topic_kind, v.name FROM v_topics v
        JOIN (SELECT max(item_id) AS item_id FROM v_topics GROUP BY topic, topic_kind) a ON a.item_id = v.item_id
        JOIN (SELECT max(item_id) AS item_id FROM v_topics GROUP BY name) b ON b.item_id = v.item_id"""


def scd2_supersede(d: Dialect) -> str:
    """Assertions with validity: each closes when the next of its key opens; the last is current."""
    return """SELECT item_id, ordinal, lead(ordinal) OVER (PARTITION BY item_id ORDER BY ordinal) AS closed_at, lag(ordinal) OVER (PARTITION BY item_id ORDER BY ordinal) AS supersedes,
        lead(ordinal) OVER (PARTITION BY item_id ORDER BY ordinal) IS NULL AS is_current FROM v_revisions"""


def tombstone_overlay(d: Dialect) -> str:
    """Removals laid over items at reading: three of five kinds purge title and text, remote deletion keeps the item in search."""
    kinds = ("remoteDeletion", "userTrash", "userPurge", "legalPolicyPurge", "connectorMandatedPurge")
    kind = "CASE (l.quality * 2 + l.toxic + l.doc_id) % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    purged = "kind IN ('userPurge', 'legalPolicyPurge', 'connectorMandatedPurge')"
    return f"""SELECT item_id, kind AS deletion_kind, CASE WHEN kind IS NULL THEN 'live' WHEN kind = 'remoteDeletion' THEN 'remoteDeletedRetained' ELSE 'tombstoned' END AS state,
        CASE WHEN {purged} THEN '[Purged]' ELSE title END AS title, CASE WHEN {purged} THEN 0 ELSE {d.n_bytes("plain_text")} END AS text_bytes, kind IS NULL OR kind = 'remoteDeletion' AS searchable
        FROM (SELECT i.item_id, i.title, i.plain_text, {kind} AS kind FROM v_items i LEFT JOIN labels l ON l.doc_id = i.item_id) x"""


def gc_mark_sweep(d: Dialect) -> str:
    """Blobs: what nothing refers to is put in quarantine, and deleted once it has been there for seven days; the rest stays.

    References are the accepted memberships of full quantity; the quarantine of earlier runs is by the item's number.
    """
    now = d.now("2001-06-01 00:00:00")
    return f"""SELECT item_id, quarantined_at, CASE WHEN referenced THEN 'keep' WHEN quarantined_at IS NULL THEN 'quarantine' WHEN {now} - quarantined_at >= 604800 THEN 'delete' ELSE 'wait' END AS action
        FROM (SELECT t.item_id, m.item_id IS NOT NULL AS referenced, CASE t.item_id % 4 WHEN 1 THEN {now} - 259200 WHEN 2 THEN {now} - 604800 WHEN 3 THEN {now} - 864000 END AS quarantined_at
              FROM v_topics t LEFT JOIN (SELECT DISTINCT item_id FROM v_memberships WHERE decision = 'accepted' AND quantity >= 49) m ON m.item_id = t.item_id) x"""


def job_lease_candidates(d: Dialect) -> str:
    """The next hundred jobs to lease: pending ones and those whose lease ran out, by time and id, with the attempt that they start."""
    now = d.now("2024-01-25 00:00:00")
    return f"""SELECT job_id, attempts + 1 AS attempt, next_attempt_at FROM (
        SELECT item_id AS job_id, count(*) AS attempts, max(captured_at) + least(21600, CAST(power(2, least(count(*), 10)) AS BIGINT) * 15) AS next_attempt_at, bool_or(metric = 'signup' AND captured_at > {now} - 600) AS leased
        FROM v_metrics WHERE captured_at <= {now} AND metric IN ('error', 'signup') GROUP BY item_id) x WHERE NOT leased AND next_attempt_at <= {now} ORDER BY next_attempt_at, job_id LIMIT 100"""


def sync_health_latest(d: Dialect) -> str:
    """Latest state of each endpoint; a failure does not move its last success."""
    last = "max_by(metric, captured_at * 10000000 + event_id)" if d.spark else "arg_max(metric, captured_at * 10000000 + event_id)"
    return f"SELECT item_id, {last} AS latest, max(CASE WHEN metric <> 'error' THEN captured_at END) AS last_success, sum(CASE WHEN metric = 'error' THEN 1 ELSE 0 END) AS failures FROM v_metrics GROUP BY item_id"


def idempotent_commit(d: Dialect) -> str:
    """Commit keys seen before write nothing: the first of each key stays; generations count the writes of a domain."""
    return f"""SELECT domain, count(*) AS generation, min(key) AS first_key FROM (SELECT DISTINCT source_id AS domain, concat('ingest:', source_id, ':', content_hash) AS key FROM v_items) x GROUP BY domain"""


def generation_diff(d: Dialect) -> str:
    """Domains to compute again: those whose generation passed what the index has."""
    return "SELECT a.metric, a.n AS canonical, b.n AS indexed, a.n <> coalesce(b.n, 0) AS stale FROM (SELECT metric, count(*) AS n FROM v_metrics GROUP BY metric) a LEFT JOIN (SELECT metric, count(*) AS n FROM v_metrics WHERE value > 1 GROUP BY metric) b ON b.metric = a.metric"


def conditional_update(d: Dialect) -> str:
    """An update through CASE and one through a subquery, as projections."""
    return f"""SELECT e.event_id, CASE WHEN m.n IS NULL THEN 'empty' WHEN e.is_tombstoned THEN 'hidden' ELSE e.lifecycle END AS lifecycle, {d.real('coalesce(m.best, e.weight / 1000000)')} AS weight
        FROM v_events e LEFT JOIN (SELECT event_id, count(*) AS n, max(confidence) AS best FROM v_memberships GROUP BY event_id) m ON m.event_id = e.event_id"""


def bounded_pages(d: Dialect) -> str:
    """Items by page of a cursor, fifty to a page, with the cursor that follows. A source's items are numbered in slices of ids."""
    cut = "CAST(floor(item_id / 1000.0) AS BIGINT)"
    slices = f"SELECT source_id, cut, sum(n) OVER (PARTITION BY source_id ORDER BY cut ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT source_id, {cut} AS cut, count(*) AS n FROM v_items GROUP BY source_id, {cut}) c"
    placed = f"SELECT item_id, source_id, cut, row_number() OVER (PARTITION BY source_id, cut ORDER BY item_id) - 1 AS place FROM (SELECT item_id, source_id, {cut} AS cut FROM v_items) i"
    return f"""SELECT item_id, page_n, max(item_id) OVER (PARTITION BY source_id, page_n) AS next_cursor FROM (
        SELECT p.item_id, p.source_id, CAST(floor((s.before + p.place) / 50) AS BIGINT) AS page_n FROM ({placed}) p JOIN ({slices}) s ON s.source_id IS NOT DISTINCT FROM p.source_id AND s.cut = p.cut) x"""


def x_asof(d: Dialect) -> str:
    """Extra, not in the reference: each purchase with the latest earlier view of its user."""
    last = "last(CASE WHEN metric = 'view' THEN event_id END, true)" if d.spark else "last_value(CASE WHEN metric = 'view' THEN event_id END IGNORE NULLS)"
    return f"SELECT event_id, view_id FROM (SELECT event_id, metric, {last} OVER (PARTITION BY item_id ORDER BY captured_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS view_id FROM v_metrics) x WHERE metric = 'purchase'"


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        upsert_current, insert_ignore, insert_replace, scd2_supersede, tombstone_overlay, gc_mark_sweep, job_lease_candidates,
        sync_health_latest, idempotent_commit, generation_diff, conditional_update, bounded_pages, x_asof,
    )
}
