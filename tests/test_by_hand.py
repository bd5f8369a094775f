"""Rules of ranking, garbage, tombstones, duplicates and weights on tiny tables, with results worked out by hand."""

from datetime import datetime

import pytest

from tidemark.catalog import QUERIES
from tidemark.operators.dedup import classified

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """make(**tables): a folder with tables of the usual schemas from rows as dictionaries; columns not given are null."""

    def make(**tables) -> str:
        for name, rows in tables.items():
            schema = spark.read.parquet(f"{DATA}/{name}.parquet").schema
            spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def rows_of(df, key: str) -> dict:
    return {r[key]: r for r in df.collect()}


def day(text: str) -> datetime:
    return datetime.fromisoformat(text)


def test_one_event_is_ranked(spark, folder):
    line = {"l_orderkey": 1, "l_quantity": 10.0, "l_discount": 0.05, "l_tax": 0.0, "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": day("2001-11-04")}
    path = folder(
        region=[{"r_regionkey": 0, "r_name": "ASIA"}, {"r_regionkey": 1, "r_name": "EUROPE"}],
        nation=[{"n_nationkey": 0, "n_name": "A", "n_regionkey": 0}, {"n_nationkey": 1, "n_name": "B", "n_regionkey": 1}],
        supplier=[{"s_suppkey": 1, "s_name": "s1", "s_nationkey": 0, "s_acctbal": 1.0}, {"s_suppkey": 2, "s_name": "s2", "s_nationkey": 1, "s_acctbal": 1.0}],
        customer=[{"c_custkey": 26, "c_name": "c", "c_nationkey": 0, "c_acctbal": 1.0, "c_mktsegment": "X"}],
        orders=[{"o_orderkey": 1, "o_custkey": 26, "o_orderstatus": "O", "o_totalprice": 150000.0, "o_orderdate": day("2001-11-04"), "o_orderpriority": "2-HIGH"}],
        lineitem=[line | {"l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1}, line | {"l_partkey": 2, "l_suppkey": 2, "l_linenumber": 2}],
        part=[{"p_partkey": 1, "p_name": "x", "p_brand": "b1", "p_type": "t", "p_size": 5, "p_retailprice": 1.0}, {"p_partkey": 2, "p_name": "y", "p_brand": "b2", "p_type": "t", "p_size": 9, "p_retailprice": 1.0}],
    )
    # importance .72 * .55 + .25 * .45; a followed topic; two groups in the last day; a day of four old; two of ten sources
    signals = QUERIES["ranking_signals"](spark, path).first().asDict()
    assert signals == {"event_id": 1, "importance": 0.5085, "relevance": 1.0, "novelty": 0.72, "authority": 1.0, "coverage": 0.25, "velocity": 1.0, "recency": 0.75, "diversity": 0.2}
    ranked = QUERIES["ranked_events"](spark, path).first()
    assert ranked["score"] == pytest.approx(0.1017 + 0.17 + 0.0864 + 0.12 + 0.0275 + 0.09 + 0.0675 + 0.01 + 0.01 + 0.01)
    assert ranked["reasons"] == "followedTopic,primarySource,rapidGrowth,novelDevelopment,savedRelationship"
    assert [tuple(r) for r in QUERIES["digest_sections"](spark, path).collect()] == [("today", 1, 0, 0.6931)]
    decided = {(r["kind"], r["at_time"], r["state_id"]): r["decision"] for r in QUERIES["briefing_decisions"](spark, path).collect()}
    assert decided["opening", "", 0] == decided["scheduled", "12:30", 0] == "initialDaily" and decided["scheduled", "21:00", 0] == decided["opening", "", 1] == "noRevision"
    assert decided["scheduled", "12:30", 1] == "additionalBriefing" and decided["scheduled", "12:30", 2] == "noRevision" and decided["manualRefresh", "", 3] == "manualRefresh"
    # a content update of small importance is not material
    assert decided["eventChanged", "", 1] == "noRevision"


def test_garbage_goes_through_seven_days_of_quarantine(spark, folder):
    part = lambda i: {"p_partkey": i, "p_name": "n", "p_brand": "b", "p_type": "t", "p_size": 1, "p_retailprice": 1.0}
    line = {"l_orderkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 50.0, "l_discount": 0.1, "l_tax": 0.0, "l_returnflag": "A", "l_linestatus": "O", "l_shipdate": day("2001-01-01")}
    path = folder(part=[part(i) for i in (4, 5, 6, 7, 8, 9, 11)], lineitem=[line | {"l_partkey": i} for i in (8, 11)] + [line | {"l_partkey": 9, "l_returnflag": "R"}, line | {"l_partkey": 7, "l_quantity": 3.0}])
    # by the item's number modulo four: never in quarantine, three days, seven days, ten days
    found = {i: r["action"] for i, r in rows_of(QUERIES["gc_mark_sweep"](spark, path), "item_id").items()}
    assert found == {4: "quarantine", 5: "wait", 6: "delete", 7: "delete", 8: "keep", 9: "wait", 11: "keep"}


def test_tombstones_purge_three_kinds_of_five(spark, folder):
    path = folder(documents=[{"doc_id": i, "text": f"Title {i}\nbody", "lang": "en", "source": "s"} for i in range(7)], labels=[{"doc_id": i, "quality": 0, "toxic": 0} for i in range(6)])
    found = rows_of(QUERIES["tombstone_overlay"](spark, path), "item_id")
    assert [(found[i]["deletion_kind"], found[i]["state"], found[i]["title"], found[i]["text_bytes"], found[i]["searchable"]) for i in range(7)] == [
        ("remoteDeletion", "remoteDeletedRetained", "Title 0", 12, True), ("userTrash", "tombstoned", "Title 1", 12, False), ("userPurge", "tombstoned", "[Purged]", 0, False),
        ("legalPolicyPurge", "tombstoned", "[Purged]", 0, False), ("connectorMandatedPurge", "tombstoned", "[Purged]", 0, False), (None, "live", "Title 5", 12, True), (None, "live", "Title 6", 12, True),
    ]


def test_replacing_under_two_keys_leaves_the_last_of_each(spark, folder):
    part = lambda i, brand, name: {"p_partkey": i, "p_name": name, "p_brand": brand, "p_type": "t", "p_size": 1, "p_retailprice": 1.0}
    path = folder(part=[part(1, "a", "x"), part(2, "b", "y"), part(3, "a", "z"), part(4, "c", "z"), part(5, "d", "w")])
    # 3 removes 1 by its topic, 4 removes 3 by its name
    assert sorted(rows_of(QUERIES["insert_replace"](spark, path), "item_id")) == [2, 4, 5]


def test_a_reader_counts_half_as_much_again(spark, folder):
    line = {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1.0, "l_discount": 0.04, "l_linestatus": "O", "l_shipdate": day("2001-01-01")}
    path = folder(lineitem=[line | {"l_returnflag": f, "l_tax": t} for f in "ANR" for t in (0.0, 0.08)])
    found = {(r["decision"], r["provenance"]): r["mean_weight"] for r in QUERIES["membership_weight"](spark, path).collect()}
    assert found == {("accepted", "user"): 0.6, ("accepted", "deterministic"): 0.4, ("provisional", "user"): 0.2, ("provisional", "deterministic"): 0.2, ("rejected", "user"): 0.0, ("rejected", "deterministic"): 0.0}


def test_the_decision_list_of_duplicates(spark):
    names = ["left_id", "right_id", "same_hash", "same_url", "same_external", "same_author", "cites", "other_language", "title", "shingle"]
    flags = lambda *on: [c in on for c in names[2:8]]
    cases = [
        (flags("same_external", "same_url"), 0.0, 0.0, "exactDuplicate", 0.99), (flags("same_hash"), 1.0, 1.0, "exactDuplicate", 0.99), (flags("same_url", "cites"), 0.9, 0.1, "alias", 0.97),
        (flags("other_language", "cites"), 0.83, 0.1, "translation", 0.82), (flags("cites", "other_language"), 0.82, 0.44, "quotation", 0.8), (flags("cites"), 0.9, 0.45, "independentCoverage", 0.72),
        (flags("same_author"), 0.76, 0.89, "repost", 0.89), (flags(), 0.76, 0.9, "syndication", 0.9), (flags(), 0.66, 0.69, "independentCoverage", 0.72), (flags(), 0.65, 0.1, None, None), (flags(), 0.75, 0.89, None, None),
    ]
    signals = spark.createDataFrame([(i, 100 + i, *f, t, s) for i, (f, t, s, _, _) in enumerate(cases)], ", ".join(f"{n} {'long' if n.endswith('_id') else 'double' if n in ('title', 'shingle') else 'boolean'}" for n in names))
    found = {r["left_id"]: (r["classification"], r["confidence"]) for r in classified(signals).collect()}
    assert found == {i: (k, c) for i, (*_, k, c) in enumerate(cases) if k}
