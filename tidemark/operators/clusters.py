"""Segments, their alignment across revisions, cluster scores, assignment under constraints, and event identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.names import name_spans, word_places
from tidemark.plans.dialect import Dialect
from tidemark.plans.run import Query, duck_sql, spark_query

#: Weights of the candidate score and the maintainer's policy.
W_SEMANTIC, W_ENTITY, W_TOPIC, W_TEMPORAL, W_TITLE, W_CITATION, W_INDEPENDENCE, W_COHERENCE = 0.28, 0.17, 0.14, 0.11, 0.10, 0.07, 0.06, 0.07
THRESHOLD, SECONDARY, MARGIN, MOST = 0.50, 0.78, 0.025, 2
DECAY_DAYS = 14


def segment_spans(d: Dialect) -> str:
    """Segments with byte spans and lineage identifiers of (hash, heading)."""
    over = "OVER (PARTITION BY item_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    heading = f"last(CASE WHEN kind = 'heading' THEN text END, true) {over.format('CURRENT ROW')}" if d.spark else f"last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) {over.format('CURRENT ROW')}"
    joined = f"concat({d.sha256('text')}, '|', coalesce(heading, ''))"
    return f"""SELECT item_id, ordinal, CASE WHEN parts_n = 1 THEN 'whole' ELSE kind END AS kind, utf8_start, utf8_length, {t.name_uuid(d, joined)} AS lineage_id FROM (
        SELECT item_id, ordinal, kind, text, {heading} AS heading, count(*) OVER (PARTITION BY item_id) AS parts_n,
        CAST(coalesce(sum({d.n_bytes("text")} + 1) {over.format('1 PRECEDING')}, 0) AS BIGINT) AS utf8_start, {d.n_bytes("text")} AS utf8_length FROM v_segments) x"""


def revision_alignment_exact(d: Dialect) -> str:
    """Segments of an item's next revision aligned with those of the one before by equal hash, each prior used once, in their order.

    The next revision has every fifth segment edited and every seventh left out.
    """
    place = "row_number() OVER (PARTITION BY item_id, h ORDER BY ordinal)"
    own = lambda text, where: f"SELECT item_id, ordinal, h, {place} AS k FROM (SELECT item_id, ordinal, {d.sha256(text)} AS h FROM v_segments WHERE {where}) r"
    edited = "CASE WHEN ordinal % 5 = 4 THEN concat(text, ' (edited)') ELSE text END"
    return f"SELECT a.item_id, a.ordinal, b.ordinal AS prior_ordinal FROM ({own(edited, 'ordinal % 7 <> 3')}) a LEFT JOIN ({own('text', 'TRUE')}) b ON a.item_id = b.item_id AND a.h = b.h AND a.k = b.k"


def _scores(d: Dialect) -> str:
    """Scores of items against the events that they are members of; titles stand for segments and events.

    An item's entities are those of the events that accepted it, an event's entity is its own; a group of sources that another
    member of the event has already counts little as independent.
    """
    overlap = lambda a, b: f"CASE WHEN {d.size(a)} = 0 OR {d.size(b)} = 0 THEN 0.0 ELSE {d.common(a, b)} * 1.0 / least({d.size(a)}, {d.size(b)}) END"
    jaccard = lambda a, b: f"CASE WHEN {d.size(a)} + {d.size(b)} - {d.common(a, b)} = 0 THEN 0.0 ELSE {d.common(a, b)} * 1.0 / ({d.size(a)} + {d.size(b)} - {d.common(a, b)}) END"
    item, event = t.tokens_cluster(d, "tp.name"), t.tokens_cluster(d, "ev.event_text")
    none = "CAST(array() AS ARRAY<BIGINT>)" if d.spark else "CAST([] AS BIGINT[])"
    return f"""SELECT item_id, event_id, semantic, entity_overlap, topic_overlap, temporal, independence,
        {W_SEMANTIC} * semantic + {W_ENTITY} * entity_overlap + {W_TOPIC} * topic_overlap + {W_TEMPORAL} * temporal + {W_TITLE} * semantic + {W_CITATION} * 0.0 + {W_INDEPENDENCE} * independence + {W_COHERENCE} * semantic AS score FROM (
        SELECT m.item_id, m.event_id, {jaccard("tp.words", "ev.words")} AS semantic, {overlap("tp.topics", "ev.topics")} AS topic_overlap, {overlap(f"coalesce(en.entities, {none})", "ev.entities")} AS entity_overlap,
        greatest(0.0, 1 - abs(m.published_at - ev.started_at) / ({DECAY_DAYS} * 86400.0)) AS temporal, CASE WHEN g.members > 1 THEN 0.2 ELSE 1.0 END AS independence
        FROM (SELECT DISTINCT event_id, item_id, source_id, published_at FROM v_memberships WHERE decision <> 'rejected') m
        JOIN v_sources s ON s.source_id = m.source_id
        JOIN (SELECT x.event_id, y.independence_group, count(DISTINCT x.item_id) AS members FROM v_memberships x JOIN v_sources y ON y.source_id = x.source_id WHERE x.decision <> 'rejected' GROUP BY x.event_id, y.independence_group) g ON g.event_id = m.event_id AND g.independence_group = s.independence_group
        JOIN (SELECT item_id, {item.replace("tp.", "")} AS words, {d.array("topic", "topic_kind")} AS topics FROM v_topics) tp ON tp.item_id = m.item_id
        LEFT JOIN (SELECT x.item_id, {d.gather("e.entity_id")} AS entities FROM v_memberships x JOIN v_events e ON e.event_id = x.event_id WHERE x.decision = 'accepted' GROUP BY x.item_id) en ON en.item_id = m.item_id
        JOIN (SELECT e.event_id, e.started_at, {d.array("e.entity_id")} AS entities, {event.replace("ev.event_text", "x.name")} AS words, {d.array("x.topic", "x.topic_kind")} AS topics FROM v_events e
              JOIN (SELECT event_id, max(item_id) AS item_id FROM v_memberships GROUP BY event_id) l ON l.event_id = e.event_id JOIN v_topics x ON x.item_id = l.item_id) ev ON ev.event_id = m.event_id) c"""


def cluster_scores(d: Dialect) -> str:
    """The score vector and its weighted sum."""
    cols = ", ".join(f"{d.real(f'min({c})')} AS {c}" for c in ("semantic", "entity_overlap", "topic_overlap", "temporal", "independence"))
    return f"SELECT item_id, event_id, {cols}, {d.real('max(score)', 5)} AS score FROM ({_scores(d)}) x GROUP BY item_id, event_id"


def cluster_assign(d: Dialect) -> str:
    """Assignment of items to events: never a rejected event; all forced ones; else the best over the threshold and near seconds."""
    return f"""WITH s AS (SELECT item_id, event_id, round(max(score), 9) AS score FROM ({_scores(d)}) q GROUP BY item_id, event_id),
        forced AS (SELECT DISTINCT item_id, event_id FROM v_memberships WHERE decision = 'accepted' AND quantity = 50 AND role = 'independent'),
        rejected AS (SELECT DISTINCT item_id, event_id FROM v_memberships WHERE decision = 'rejected' AND quantity >= 40),
        f AS (SELECT f.item_id, f.event_id FROM forced f LEFT JOIN rejected r ON r.item_id = f.item_id AND r.event_id = f.event_id WHERE r.event_id IS NULL),
        o AS (SELECT s.* FROM s LEFT JOIN rejected r ON r.item_id = s.item_id AND r.event_id = s.event_id LEFT JOIN (SELECT DISTINCT item_id FROM f) g ON g.item_id = s.item_id WHERE r.event_id IS NULL AND g.item_id IS NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, event_id) AS rn, max(score) OVER (PARTITION BY item_id) AS best FROM o)
        SELECT item_id, event_id, 'forced' AS why FROM f
        UNION ALL SELECT item_id, event_id, CASE WHEN rn = 1 THEN 'best' ELSE 'secondary' END FROM k
        WHERE rn <= {MOST} AND best >= {THRESHOLD} AND (rn = 1 OR (score >= {SECONDARY} AND best - score <= {MARGIN}))"""


#: What each connector and host adds, and the reasons of a primary choice, in their order.
CONNECTOR_SCORES = {"github": 0.42, "arxiv": 0.46, "bluesky": 0.16, "x": 0.16, "rss": 0.12, "atom": 0.12, "jsonFeed": 0.12, "website": 0.12}
REASONS = {
    "official": "first-party Source/entity relationship", "github": "official repository artifact", "arxiv": "paper record", "bluesky": "author account evidence",
    "complete": "complete source text", "dated": "connector publication timestamp", "none": "most direct available evidence",
}


def _primary(d: Dialect) -> str:
    """Memberships with their primary score and its trace; connector, host and length of text are by the source and the quantity."""
    connector = "CASE s.ecosystem WHEN 'chinaFocused' THEN 'github' WHEN 'globalFocused' THEN 'arxiv' WHEN 'mixed' THEN 'bluesky' ELSE 'rss' END"
    host = "CASE s.source_id % 5 WHEN 0 THEN 'github.com' WHEN 1 THEN 'export.arxiv.org' WHEN 2 THEN 'notgithub.com' ELSE 'example.org' END"
    base = f"""SELECT m.item_id, m.event_id, m.ordinal, m.source_id, m.provenance, s.is_followed AS official, {connector} AS connector, {host} AS host, CAST(m.quantity * 100 AS BIGINT) AS text_bytes, CASE WHEN m.ordinal % 4 <> 3 THEN m.published_at END AS dated
        FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id WHERE m.decision <> 'rejected'"""
    of_connector = "CASE connector " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CONNECTOR_SCORES.items()) + " ELSE 0.0 END"
    of_host = f"CASE WHEN host = 'github.com' OR {'endswith' if d.spark else 'ends_with'}(host, 'arxiv.org') THEN 0.18 ELSE 0.0 END"
    score = f"CASE WHEN official THEN 0.45 ELSE 0.0 END + {of_connector} + {of_host} + least(0.16, text_bytes / 25000.0) + CASE WHEN dated IS NOT NULL THEN 0.04 ELSE 0.0 END"
    when = {"official": "official", "github": "connector = 'github'", "arxiv": "connector = 'arxiv'", "bluesky": "connector IN ('bluesky', 'x')", "complete": "text_bytes >= 1200", "dated": "dated IS NOT NULL"}
    why = d.join(d.filter(d.array(*[f"CASE WHEN {c} THEN '{REASONS[k]}' ELSE '' END" for k, c in when.items()]), "x", "x <> ''"), "'; '")
    return f"SELECT item_id, event_id, ordinal, source_id, provenance, round(CAST({score} AS DOUBLE), 6) AS score, coalesce(nullif({why}, ''), '{REASONS['none']}') AS trace FROM ({base}) b"


def primary_score(d: Dialect) -> str:
    """How well a source item stands as primary evidence, with the reasons."""
    return f"SELECT item_id, source_id, event_id, max(score) AS primary_score, max(trace) AS trace FROM ({_primary(d)}) x GROUP BY item_id, source_id, event_id"


def primary_switch(d: Dialect) -> str:
    """The primary that an event has after its latest member came: the new one only if better by over 0.08; a reader's choice stays."""
    row = lambda order: f"row_number() OVER (PARTITION BY event_id ORDER BY ordinal {order}, item_id {order}, source_id {order})"
    switched = "c.provenance <> 'user' AND n.score > c.score + 0.08"
    return f"""WITH p AS (SELECT *, {row('')} AS first_n, {row('DESC')} AS last_n FROM ({_primary(d)}) x)
        SELECT c.event_id, c.item_id AS current_item, n.item_id AS new_item, CASE WHEN {switched} THEN n.item_id ELSE c.item_id END AS primary_item,
        CASE WHEN c.provenance = 'user' THEN concat(c.trace, '; user override remains authoritative') WHEN {switched} THEN n.trace ELSE c.trace END AS trace
        FROM (SELECT * FROM p WHERE first_n = 1) c JOIN (SELECT * FROM p WHERE last_n = 1 AND first_n > 1) n ON n.event_id = c.event_id"""


#: Weight of a membership by its decision.
_WEIGHT = "greatest(0.0, confidence * CASE WHEN decision = 'accepted' AND provenance = 'user' THEN 1.5 WHEN decision = 'accepted' THEN 1.0 WHEN decision = 'provisional' THEN 0.5 ELSE 0.0 END)"


def membership_weight(d: Dialect) -> str:
    """Weight of each decision: confidence by 1.5 where the reader accepted, by 1, by a half, or nothing."""
    return f"SELECT decision, provenance, role, count(*) AS n, {d.real(f'avg({_WEIGHT})')} AS mean_weight FROM v_memberships GROUP BY decision, provenance, role"


def split_identity(d: Dialect) -> str:
    """The partition of a split that keeps the event's identity: largest share of the weight, then count, then hash of its sorted members."""
    string = "STRING" if d.spark else "VARCHAR"
    key = d.sha256(d.join(d.gather(f"CAST(item_id AS {string})"), "'|'"))
    share = "CASE WHEN sum(weight) OVER (PARTITION BY event_id) > 0 THEN weight / sum(weight) OVER (PARTITION BY event_id) ELSE 0.0 END"
    return f"""SELECT event_id, partition_id, members, overlap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, members DESC, h) AS rn FROM (
        SELECT event_id, partition_id, members, h, {d.real(share)} AS overlap FROM (
        SELECT event_id, role AS partition_id, count(*) AS members, round(CAST(sum({_WEIGHT}) AS DOUBLE), 9) AS weight, {key} AS h FROM v_memberships GROUP BY event_id, role) z) y) x WHERE rn = 1"""


def merge_identity(d: Dialect) -> str:
    """The event that survives a merge of one entity's events: largest weight, then smallest id."""
    return f"""SELECT entity_id, event_id AS survivor, {d.real('weight', 2)} AS weight, merged FROM (SELECT entity_id, event_id, weight, count(*) OVER (PARTITION BY entity_id) AS merged, row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, event_id) AS rn FROM v_events) x WHERE rn = 1"""


def manual_merge(d: Dialect) -> str:
    """What a merge of the tombstoned events of an entity leaves: clones of the losers' memberships, must-links, lineage, aliases, and losers hidden.

    The event of the largest weight survives, of equal weights the smallest id.
    """
    weight = "sum(greatest(0.0, confidence) * CASE decision WHEN 'accepted' THEN CASE WHEN provenance = 'user' THEN 1.5 ELSE 1.0 END WHEN 'provisional' THEN 0.5 ELSE 0.0 END)"
    rated = f"SELECT e.entity_id, e.event_id, coalesce(round(w.weight, 9), 0.0) AS weight FROM v_events e LEFT JOIN (SELECT event_id, {weight} AS weight FROM v_memberships GROUP BY event_id) w ON w.event_id = e.event_id WHERE e.is_tombstoned"
    first = f"SELECT *, first_value(event_id) OVER (PARTITION BY entity_id ORDER BY weight DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS survivor, count(*) OVER (PARTITION BY entity_id) AS n FROM ({rated}) r"
    events = f"SELECT * FROM ({first}) f WHERE n > 1"
    none = "CAST(NULL AS BIGINT)"
    items = "SELECT DISTINCT event_id, item_id FROM v_memberships WHERE decision <> 'rejected'"
    real = d.real("weight")
    return f"""SELECT 'membership' AS kind, survivor AS event_id, event_id AS other_id, item_id, CAST(NULL AS DOUBLE) AS weight FROM (SELECT m.survivor, m.event_id, i.item_id FROM ({events}) m JOIN ({items}) i ON i.event_id = m.event_id WHERE m.event_id <> m.survivor) a
        UNION ALL SELECT DISTINCT 'mustLink', m.survivor, {none}, i.item_id, CAST(NULL AS DOUBLE) FROM ({events}) m JOIN ({items}) i ON i.event_id = m.event_id
        UNION ALL SELECT 'lineage', survivor, event_id, {none}, {real} FROM ({events}) b UNION ALL SELECT 'alias', event_id, survivor, {none}, CAST(NULL AS DOUBLE) FROM ({events}) c WHERE event_id <> survivor
        UNION ALL SELECT 'merged', event_id, {none}, {none}, CAST(NULL AS DOUBLE) FROM ({events}) e WHERE event_id <> survivor"""


def manual_split(d: Dialect) -> str:
    """A split of an event's items by a moving one, the largest id: both partitions with their confirmed memberships, the new event's identity, and cannot-links between them.

    Events of over 50 items are not split here: cannot-links are as many as the product of the partitions.
    """
    items = "SELECT event_id, item_id, max(item_id) OVER (PARTITION BY event_id) AS moving, count(*) OVER (PARTITION BY event_id) AS n FROM (SELECT DISTINCT event_id, item_id FROM v_memberships WHERE decision = 'accepted') i"
    own = f"SELECT s.event_id, s.item_id, s.item_id = s.moving AS moves FROM ({items}) s JOIN v_events e ON e.event_id = s.event_id WHERE s.n BETWEEN 2 AND 50 AND e.is_saved"
    string = "STRING" if d.spark else "VARCHAR"
    new = t.name_uuid(d, f"concat('split:', CAST(event_id AS {string}))")
    key = f"CASE WHEN moves THEN {new} ELSE CAST(event_id AS {string}) END"
    return f"""SELECT 'membership' AS kind, {key} AS event_key, item_id, CAST(NULL AS BIGINT) AS other_item FROM ({own}) a
        UNION ALL SELECT 'lineage', {new}, CAST(NULL AS BIGINT), event_id FROM ({own}) b WHERE moves
        UNION ALL SELECT 'cannotLink', CAST(x.event_id AS {string}), x.item_id, y.item_id FROM ({own}) x JOIN ({own}) y ON y.event_id = x.event_id AND y.moves AND NOT x.moves"""


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of 2 to 100 letters or digits that a text holds as whole words, each with its first place in bytes and its de-dup key.

    Names are the words of the benchmark texts; `entity_spans` has every span, with diacritics and width folded.
    """
    names = spark_query(lambda d: f"SELECT item_id, {_words(d, 'text')} AS ws FROM benchmark")(spark, sf_dir).select(F.explode("ws").alias("w"))
    texts = spark_query(lambda d: "SELECT item_id, plain_text FROM v_items")(spark, sf_dir)
    found = word_places(texts, names, "item_id", "plain_text", "w")
    return found.withColumn("dedup_key", F.substring(F.sha2(F.concat_ws("|", F.col("item_id").cast("string"), "alias"), 256), 1, 16))


def _words(d: Dialect, x: str) -> str:
    return d.distinct(d.filter(d.split(f"lower({x})", r"[^\p{L}\p{N}]+"), "w", "length(w) BETWEEN 2 AND 100"))


def _mentions_sql(d: Dialect) -> str:
    """The same by looking each word up in its text."""
    exploded = lambda table, key, x: d.explode(f"(SELECT {key}, {_words(d, x)} AS ws FROM {table})", "ws", "w")
    bare = f"concat(' ', {d.replace_all('lower(plain_text)', r'[^\p{L}\p{N}]', chr(39) + ' ' + chr(39))}, ' ')"
    start = d.n_bytes("substr(i.plain_text, 1, CAST(strpos(i.bare, concat(' ', m.w, ' ')) AS INT) - 1)")
    key = d.sha256("concat(CAST(m.item_id AS VARCHAR), '|', m.w)")
    return f"""SELECT m.item_id, m.w AS alias, {start} AS utf8_start, {d.n_bytes("m.w")} AS utf8_length, substr({key}, 1, 16) AS dedup_key FROM (SELECT item_id, w FROM {exploded("v_items", "item_id", "plain_text")}) m
        JOIN (SELECT DISTINCT w FROM {exploded("benchmark", "item_id AS bid", "text")}) n ON n.w = m.w JOIN (SELECT item_id, plain_text, {bare} AS bare FROM v_items) i ON i.item_id = m.item_id"""


def entity_resolution(d: Dialect) -> str:
    """Each name's best known entity, or a new deterministic identifier."""
    return f"""SELECT n.display_name, coalesce(CAST(b.entity_id AS {'STRING' if d.spark else 'VARCHAR'}), {t.name_uuid(d, 'n.display_name')}) AS entity_key, b.entity_id IS NULL AS created
        FROM (SELECT display_name FROM v_sources UNION SELECT display_name FROM v_entities) n LEFT JOIN (SELECT normalized_name, min(entity_id) AS entity_id FROM v_entities GROUP BY normalized_name) b ON b.normalized_name = lower(n.display_name)"""


def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole span of every name of 2 to 100 characters: item_id, alias, utf8_start, utf8_length, mentioned_text.

    Case, diacritics and width are folded. Names are the words of the benchmark texts, and each two that stand side by side there.
    """
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text IS NOT NULL").select(words.alias("words"))
    names = items.select(F.explode(F.when(F.size("words") > 1, F.concat("words", pairs)).otherwise(F.col("words"))).alias("name")).where(F.length("name").between(2, 100)).distinct()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("item_id"), "text")
    return name_spans(texts, names, "item_id", "text", "name")


SPARK_QUERIES = {f.__name__: f for f in (entity_mentions, entity_spans)}
ORACLES = {"entity_mentions": duck_sql(_mentions_sql)}

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        segment_spans, revision_alignment_exact, cluster_scores, cluster_assign, primary_score, primary_switch, membership_weight, split_identity,
        merge_identity, manual_merge, manual_split, entity_resolution,
    )
}
