"""Searches over an index of words: few frequent words, many slices of queries, and what is shuffled."""

import duckdb
import pytest

from tests.test_arrivals import _stages
from tidemark.catalog import ORACLE_SQL, QUERIES
from tidemark.operators import search
from tidemark.plans.views import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["history_opt_in", "trigram_search", "best_per_document"])
def test_rare_words_and_slices_of_queries_give_the_same(spark, monkeypatch, name):
    monkeypatch.setattr(search, "FREQUENT", 20)
    monkeypatch.setattr(search, "SENT", 20_000)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    got = c.execute(ORACLE_SQL[name])
    at = [[x[0] for x in got.description].index(k) for k in found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[i] for i in at) for r in got.fetchall())


def work(spark, name: str, value) -> int:
    before = sum(value(s) for s in _stages(spark))
    QUERIES[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    return sum(value(s) for s in _stages(spark)) - before


def test_a_query_is_joined_with_its_rarest_term_only(spark):
    """19,235 rows here; 79,975 where each query met every item of each of its terms."""
    assert work(spark, "history_opt_in", lambda s: s.shuffleWriteRecords()) < 40_000


def test_no_row_is_made_for_each_trigram(spark):
    """4 CPU seconds here; 36 with a row for each trigram of each text."""
    assert work(spark, "trigram_search", lambda s: s.executorCpuTime()) < 18e9
