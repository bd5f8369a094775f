"""Event snapshots, ranking signals and scores, digest sections and briefing decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clamp01
from tidemark.plans.commits import Store
from tidemark.plans.dialect import Dialect
from tidemark.plans.run import Query, duck_sql, spark_query
from tidemark.plans.scratch import scratch_path, written

NOW = "2001-11-05 00:00:00"


def _snapshot(d: Dialect) -> str:
    now = d.now(NOW)
    # the primary membership is the first that is not rejected; its trace tells a first-party source, a repository or a paper
    traced = "s.is_followed OR s.ecosystem IN ('chinaFocused', 'globalFocused')"
    primary = f"min(struct(m.ordinal, m.item_id, m.source_id, {traced} AS traced)).traced" if d.spark else f"min({{'a': m.ordinal, 'b': m.item_id, 'c': m.source_id, 'traced': {traced}}}).traced"
    china, world = (d.n_distinct(f"CASE WHEN s.ecosystem = '{x}' THEN s.independence_group END") for x in ("chinaFocused", "globalFocused"))
    recent, prior = (d.n_distinct(f"CASE WHEN m.published_at {c} {now} - 86400 THEN s.independence_group END") for c in (">=", "<"))
    return f"""SELECT e.event_id, e.title, e.change_kind, e.is_saved, e.started_at, e.weight, coalesce(c.sources, 0) AS sources, coalesce(c.groups_n, 0) AS groups_n, coalesce(c.ecosystems, 0) AS ecosystems,
        coalesce(p.is_followed, FALSE) AS followed_people, coalesce(c.followed_source, FALSE) AS followed_source, coalesce(c.followed_topic, FALSE) AS followed_topic,
        coalesce(c.topics, 0) AS topics, coalesce(c.best, 0.0) AS best, CASE WHEN coalesce(c.traced, FALSE) THEN 1.0 ELSE 0.65 END AS authority, coalesce(v.recent, 0) AS recent, coalesce(v.prior, 0) AS prior,
        coalesce(c.china, 0) >= 2 AND coalesce(c.world, 0) >= 2 AS covered_both, CAST(floor(e.weight / 100) AS BIGINT) AS reader_chars,
        CASE WHEN coalesce(v.recent, 0) >= 2 THEN least(1.0, v.recent / greatest(2.0, v.prior / 7.0)) ELSE 0.0 END AS velocity, greatest(coalesce(c.latest_at, e.started_at), e.started_at) AS latest_at
        FROM v_events e LEFT JOIN v_entities p ON p.entity_id = e.entity_id
        LEFT JOIN (SELECT m.event_id, count(DISTINCT m.source_id) AS sources, {d.n_distinct("s.independence_group")} AS groups_n, {d.n_distinct("s.ecosystem")} AS ecosystems, bool_or(s.is_followed) AS followed_source, bool_or(t.is_followed) AS followed_topic,
                   {d.n_distinct("t.topic")} AS topics, max(m.confidence) AS best, {primary} AS traced, {china} AS china, {world} AS world, max(m.published_at) AS latest_at
                   FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id JOIN v_topics t ON t.item_id = m.item_id WHERE m.decision <> 'rejected' GROUP BY m.event_id) c ON c.event_id = e.event_id
        LEFT JOIN (SELECT m.event_id, {recent} AS recent, {prior} AS prior
                   FROM v_memberships m JOIN v_sources s ON s.source_id = m.source_id GROUP BY m.event_id) v ON v.event_id = e.event_id
        WHERE e.lifecycle = 'active' AND NOT e.is_tombstoned"""


def event_snapshot(d: Dialect) -> str:
    """One row for each live event with all that ranking needs: one plan in place of many statements for each event."""
    flags = "followed_people, followed_source, followed_topic, is_saved, covered_both"
    return f"SELECT event_id, title, change_kind, sources, groups_n, ecosystems, {flags}, topics, {d.real('best')} AS best, {d.real('authority')} AS authority, recent, prior, {d.real('velocity')} AS velocity, reader_chars, latest_at FROM ({_snapshot(d)}) x"


# Fixed values from here to REASONS: magnitudes, weights, bonuses and reasons.
#: How far a change matters, by its kind.
MAGNITUDE = {"initial": 1.0, "majorUpdate": 1.0, "correction": 1.0, "contentUpdate": 0.72, "merge": 0.72, "split": 0.72, "minorMetadata": 0.25}
#: Weights of the clamped signals, and what each tie to the reader adds.
WEIGHTS = {"importance": 0.20, "relevance": 0.17, "novelty": 0.12, "authority": 0.12, "coverage": 0.11, "velocity": 0.09, "recency": 0.09, "diversity": 0.05}
BONUSES = {"followed_people": 0.025, "followed_source": 0.015, "followed_topic": 0.01, "is_saved": 0.01}
#: Reasons in the order in which they are given.
REASONS = [
    ("followed_people", "followedPerson"), ("followed_source", "followedSource"), ("followed_topic", "followedTopic"), ("authority >= 0.75", "primarySource"),
    ("coverage >= 0.65", "independentCoverage"), ("velocity >= 0.72", "rapidGrowth"), ("novelty >= 0.72", "novelDevelopment"), ("is_saved", "savedRelationship"),
]


def _signals(d: Dialect) -> str:
    now = d.now(NOW)
    magnitude = "CASE change_kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MAGNITUDE.items()) + " END"
    coverage = "least(1.0, groups_n / 8.0)"
    signals = {
        "importance": f"least(1.0, ({magnitude}) * 0.55 + {coverage} * 0.45)", "relevance": "CASE WHEN followed_people OR followed_topic OR followed_source THEN 1.0 WHEN is_saved THEN 0.8 ELSE 0.15 END",
        "novelty": magnitude, "authority": "authority", "coverage": coverage, "velocity": "velocity",
        "recency": f"greatest(0.0, 1 - greatest(0, {now} - latest_at) / 3600.0 / 96)", "diversity": "least(1.0, sources / 10.0)",
    }
    return f"SELECT event_id, title, sources, groups_n, {', '.join(BONUSES)}, covered_both, reader_chars, {now} - latest_at AS age_s, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in signals.items())} FROM ({_snapshot(d)}) x"


def ranking_signals(d: Dialect) -> str:
    """Eight signals of each event."""
    return f"SELECT event_id, {', '.join(f'{d.real(c)} AS {c}' for c in WEIGHTS)} FROM ({_signals(d)}) x"


def _ranked(d: Dialect) -> str:
    score = " + ".join([f"{w} * {clamp01(c)}" for c, w in WEIGHTS.items()] + [f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for c, w in BONUSES.items()])
    why = d.filter(d.array(*[f"CASE WHEN {c} THEN '{r}' ELSE '' END" for c, r in REASONS]), "x", "x <> ''")
    return f"SELECT event_id, title, sources, groups_n, {', '.join(BONUSES)}, covered_both, reader_chars, age_s, authority, velocity, round(CAST({score} AS DOUBLE), 6) AS score, {d.join(why)} AS reasons FROM ({_signals(d)}) y"


def ranked_events(d: Dialect) -> str:
    """Scores and reasons; ties to the reader may carry a score past 1, as scores are not clamped."""
    return f"SELECT event_id, {d.real('score', 5)} AS score, reasons FROM ({_ranked(d)}) z"


#: Sections in the order in which they are filled: name, condition, most entries; fifteen in all.
SECTIONS = [
    ("today", "age_s <= 604800 AND (authority >= 0.8 OR groups_n >= 2 OR followed_source OR followed_people OR followed_topic)", 5), ("emerging", "velocity > 0", 3),
    ("peopleYouFollow", "followed_people OR followed_source", 3), ("worthReading", "reader_chars >= 1200", 3), ("chinaGlobal", "covered_both", 2), ("everythingElse", "TRUE", 15),
]
ALL_ENTRIES = 15


def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sections filled in turn from what is left; ranks from 0. A section is a top-k of at most fifteen rows."""
    ranked = written(spark_query(_ranked)(spark, sf_dir).withColumn("score", F.col("score").cast("double")), "ranked")
    # fifteen of each condition hold all that any section can take, so ninety rows decide
    tops = [ranked.where(where).orderBy(F.desc("score"), "event_id").limit(ALL_ENTRIES).select(F.lit(name).alias("section"), "event_id", "score") for name, where, _ in SECTIONS]
    found = reduce(DataFrame.unionByName, tops).collect()
    rows: list[tuple[str, int, int, float]] = []
    for name, _, most in SECTIONS:
        taken = {r[1] for r in rows}
        own = sorted((-r["score"], r["event_id"]) for r in found if r["section"] == name and r["event_id"] not in taken)
        rows += [(name, e, i, round(-s, 5)) for i, (s, e) in enumerate(own[: min(most, ALL_ENTRIES - len(rows))])]
    return spark.createDataFrame(rows, "section string, event_id long, rank_n int, score double")


def _digest_sql(d: Dialect) -> str:
    parts, done = [f"r AS ({_ranked(d)})"], []
    for name, where, most in SECTIONS:
        all_done = " UNION ALL ".join(f"SELECT event_id FROM s_{n}" for n in done)
        taken = f" AND event_id NOT IN ({all_done})" if done else ""
        before = f" - (SELECT count(*) FROM ({all_done}) t)" if done else ""
        parts.append(f"s_{name} AS MATERIALIZED (SELECT event_id, score, rn FROM (SELECT event_id, score, row_number() OVER (ORDER BY score DESC, event_id) AS rn FROM r WHERE {where}{taken}) q WHERE rn <= least({most}, {ALL_ENTRIES}{before}))")
        done.append(name)
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT '{n}' AS section, event_id, rn - 1 AS rank_n, {d.real('score', 5)} AS score FROM s_{n}" for n in done)


def briefing_decisions(d: Dialect) -> str:
    """What each trigger does in each state of the day: an initial digest once, children for additional times, requests and material changes.

    Changes are the live events with a growth of evidence, so that every kind and threshold occurs; times are those of a schedule.
    """
    triggers = ", ".join(f"('{k}', '{at}')" for k, at in [("opening", ""), ("manualRefresh", ""), ("scheduled", "08:00"), ("scheduled", "12:30"), ("scheduled", "18:00"), ("scheduled", "21:00")])
    states = ", ".join(f"({i}, {str(has).upper()}, '{done}')" for i, (has, done) in enumerate([(False, ""), (True, ""), (True, "12:30"), (True, "12:30,18:00")]))
    daily, additional = "08:00", "12:30,18:00"
    # the change that comes with each trigger of kind eventChanged
    changes = f"""SELECT event_id, change_kind, importance, growth, is_new, primary_arrived, corrected, lineage_changed,
        corrected OR lineage_changed OR primary_arrived OR change_kind IN ('majorUpdate', 'correction', 'merge', 'split') OR CASE WHEN is_new THEN importance >= 0.55 ELSE importance >= 0.72 AND growth >= 2 AND change_kind <> 'minorMetadata' END AS material
        FROM (SELECT s.event_id, e.change_kind, s.importance, s.sources AS growth, e.weight < 50000 AS is_new, s.event_id % 97 = 0 AS primary_arrived, s.event_id % 89 = 0 AS corrected, s.event_id % 83 = 0 AS lineage_changed
              FROM ({_signals(d)}) s JOIN v_events e ON e.event_id = s.event_id) c"""
    listed = lambda one, times: f"({one} <> '' AND contains({times}, {one}))"
    first = f"CASE WHEN kind IN ('opening', 'manualRefresh') OR (kind = 'scheduled' AND (at_time = '{daily}' OR {listed('at_time', repr(additional))})) THEN 'initialDaily' ELSE 'noRevision' END"
    later = f"CASE WHEN kind = 'manualRefresh' THEN 'manualRefresh' WHEN kind = 'eventChanged' AND material THEN CASE WHEN is_new THEN 'materialEvent' ELSE 'majorUpdate' END WHEN kind = 'scheduled' AND {listed('at_time', repr(additional))} AND NOT {listed('at_time', 'done')} THEN 'additionalBriefing' ELSE 'noRevision' END"
    state = f"(VALUES {states}) AS s(state_id, has_initial, done)"
    return f"""SELECT kind, at_time, state_id, event_id, CASE WHEN has_initial THEN {later} ELSE {first} END AS decision FROM (
        SELECT kind, at_time, state_id, has_initial, done, CAST(NULL AS BIGINT) AS event_id, FALSE AS material, FALSE AS is_new FROM (VALUES {triggers}) AS t(kind, at_time) JOIN {state} ON TRUE
        UNION ALL SELECT 'eventChanged', '', state_id, has_initial, done, event_id, material, is_new FROM ({changes}) c JOIN {state} ON TRUE) x"""


def schedule_times(d: Dialect) -> str:
    """Additional times of a day without the daily one, distinct and sorted."""
    rows = [("08:00", "12:00,08:00,18:30,12:00"), ("07:30", ""), ("09:00", "09:00"), ("06:00", "22:00,07:00")]
    values = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(rows))
    times = d.distinct(d.filter(d.split("additional", ","), "x", "x <> '' AND x <> daily"))
    return f"SELECT id, daily, {d.join(times)} AS times FROM (VALUES {values}) AS s(id, daily, additional)"


def flow_order(d: Dialect) -> str:
    """Cards in both orders, by score with display reasons and by date: the best hundred of each, with their places."""
    score = d.real("least(1.0, 0.5 + 0.06 * sources)")
    one = lambda name, by: f"SELECT '{name}' AS ordered_by, place, event_id, card_score, reasons, started_at FROM (SELECT c.*, row_number() OVER (ORDER BY {by}, event_id) AS place FROM ({cards}) c ORDER BY {by}, event_id LIMIT 100) q"
    cards = f"SELECT x.event_id, {score} AS card_score, x.reasons, e.started_at FROM ({_ranked(d)}) x JOIN v_events e ON e.event_id = x.event_id"
    return f"SELECT * FROM ({one('score', 'card_score DESC')}) a UNION ALL SELECT * FROM ({one('date', 'started_at DESC')}) b"


QUERIES: dict[str, Query] = {f.__name__: f for f in (event_snapshot, ranking_signals, ranked_events, briefing_decisions, schedule_times, flow_order)}
def digest_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's digest as written and read back: digests, revisions and entries in one commit, whose key keeps a second run from writing."""
    store, day = Store(spark, scratch_path(spark, "digests"), "briefing"), NOW[:10]
    entries = written(digest_sections(spark, sf_dir), "entries")
    revision = f"{day}#1"
    head = spark.createDataFrame([(day, revision)], "day string, current_revision string")
    made = spark.createDataFrame([(revision, day, 1, "initialDaily")], "revision string, day string, ordinal int, trigger string")
    rows = {"digests": ("replace", head), "revisions": ("append", made), "entries": ("append", entries.withColumn("revision", F.lit(revision)))}
    if store.commit(rows, {"digests"}, key=f"digest:{day}:initialDaily") != 1 or store.commit(rows, {"digests"}, key=f"digest:{day}:initialDaily") is not None:
        raise AssertionError("a digest is written once a day")
    found = store.table("digests").join(store.table("revisions").withColumnRenamed("day", "of"), F.col("current_revision") == F.col("revision")).drop("revision", "of")
    return found.join(store.table("entries"), F.col("current_revision") == F.col("revision")).select("day", "ordinal", "trigger", "section", "event_id", "rank_n", "score")


SPARK_QUERIES = {"digest_sections": digest_sections, "digest_persist": digest_persist}
ORACLES = {"digest_sections": duck_sql(_digest_sql), "digest_persist": duck_sql(lambda d: f"SELECT '{NOW[:10]}' AS day, 1 AS ordinal, 'initialDaily' AS trigger, * FROM ({_digest_sql(d)}) x")}
