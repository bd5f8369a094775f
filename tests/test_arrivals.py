"""Views of neighbouring arrivals against brute force, and duplicate detection where views are small and its other paths occur."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.catalog import ORACLE_SQL, QUERIES
from tidemark.operators import arrivals, dedup
from tidemark.plans.views import TABLES

DATA = "/root/testdata/sf0.001"


def lists(rng, n: int, values: int, most: int) -> list[list[int]]:
    return [sorted({int(x) for x in rng.integers(0, values, rng.integers(0, most))}) for _ in range(n)]


def column(x: list[list[int]]) -> pa.ChunkedArray:
    return pa.chunked_array([pa.array(x, pa.list_(pa.int64()))])


@pytest.mark.parametrize(("values", "asked_from"), [(30, 0), (400, 120), (3000, 120)])
def test_the_latest_items_with_a_common_key(values, asked_from):
    rng, n = np.random.default_rng(values), 600
    title, text = lists(rng, n, values, 6), lists(rng, n, 3 * values, 30)
    own, first = np.arange(n) >= asked_from, asked_from == 0
    order = np.arange(n)
    *found, open_ = arrivals.latest(arrivals.Keys(column(title), order), arrivals.Keys(column(text), order), own, first, 48)
    wanted, more = set(), set()
    for r in np.flatnonzero(own):
        met = [(l, int(r), len({*title[l]} & {*title[r]}), len({*text[l]} & {*text[r]})) for l in range(r)]
        met = [x for x in met if x[2] + x[3]][-48:]
        wanted |= set(met)
        if len(met) < 48 and not first:
            more.add(int(r))
    assert set(zip(*(x.tolist() for x in found), strict=True)) == wanted and set(open_.tolist()) == more


def test_common_keys_of_pairs(monkeypatch):
    monkeypatch.setattr(arrivals, "LOOKUPS", 100)
    rng, n = np.random.default_rng(5), 80
    title, text, ids = lists(rng, n, 50, 6), lists(rng, n, 90, 30), rng.permutation(n) + 10
    pairs = [(i, j) for i in range(n) for j in range(0, i, 3)]
    found = arrivals.counted(pa.table({"item_id": ids, "title": column(title), "shingles": column(text)}), pa.table({"left_id": ids[[i for i, _ in pairs]], "right_id": ids[[j for _, j in pairs]]}))
    assert found["title_common"].to_pylist() == [len({*title[i]} & {*title[j]}) for i, j in pairs]
    assert found["shingles_common"].to_pylist() == [len({*text[i]} & {*text[j]}) for i, j in pairs]
    assert found["shingles_l"].to_pylist() == [len(text[i]) for i, _ in pairs]


@pytest.mark.parametrize("name", ["dedup_candidates", "dedup_pairs_scored"])
def test_small_views_and_hot_keys_give_the_same(spark, monkeypatch, name):
    for module, key, value in ((arrivals, "CHUNK", 20_000), (arrivals, "END", 4_000), (dedup, "HOT", 10), (dedup, "SENT", 0)):
        monkeypatch.setattr(module, key, value)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    got = c.execute(ORACLE_SQL[name])
    at = [[x[0] for x in got.description].index(k) for k in found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[i] for i in at) for r in got.fetchall())


def test_keys_are_not_sent_by_themselves(spark):
    """Shuffled bytes stay near the size of the sets (1.9 times here); with a row for each key and each item before it they were 5 times as many."""
    shuffled = lambda: sum(s.shuffleWriteBytes() for s in _stages(spark))
    path = "/root/testdata/sf0.01"
    sets = dedup.features(spark, path).selectExpr("sum(8 * (size(title) + size(shingles)))").first()[0]
    before = shuffled()
    QUERIES["dedup_pairs_scored"](spark, path).write.format("noop").mode("overwrite").save()
    assert shuffled() - before < 3 * sets


def _stages(spark) -> list:
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [stages.apply(i) for i in range(stages.size())]
