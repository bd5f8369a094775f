"""Large shards of several families of one template against brute force."""

import random

import numpy as np
import pytest

from tests.llm.test_operators import joined_by_hand, sorted_rows
from tidemark.llm import similar_groups, simhash_dedup


def families(seed: int, n: int, size: int = 320) -> list[tuple[int, str]]:
    """Texts of four families in turn: about 0.6 alike between families; in a family members differ by a few words, so links lie near 0.8."""
    r = random.Random(seed)
    template = [f"w{r.randrange(10**6)}" for _ in range(size)]

    def changed(words, k, mark):
        own = list(words)
        for at in r.sample(range(0, size, 6), k):
            own[at] = f"{mark}{r.randrange(10**6)}"
        return own

    heads = [changed(template, 8, f"f{f}x") for f in range(4)]
    return [(i, " ".join(changed(heads[i % 4], r.choice([3, 4, 5]), "m"))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_a_template_are_joined_in_large_shards(spark, seed):
    rows = families(seed, 320)
    sets = [(i, frozenset(similar_groups.shingle_set(t, 5).tolist())) for i, t in rows]
    want = joined_by_hand(sets, lambda a, b: len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))
    assert 4 <= len({c for _, c in want}) < 60
    found = similar_groups.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted_rows(found, "doc_id", "component_id") == want


def test_blocks_of_a_shard_and_small_limits_give_the_same(spark):
    rows = families(3, 120)
    sets = [(i, frozenset(similar_groups.shingle_set(t, 5).tolist())) for i, t in rows]
    want = joined_by_hand(sets, lambda a, b: len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = similar_groups.similar_groups(docs, searched=8, compared=16)
    assert sorted_rows(found, "doc_id", "component_id") == want


def test_hot_shards_in_blocks_give_the_same(spark):
    r = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in np.where(r.random(60) < 0.03, r.integers(0, 99, 60), np.arange(60)))) for i in range(300)], "doc_id long, text string").repartition(3)
    want = sorted_rows(simhash_dedup.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert len({x[2] for x in want}) < 250
    assert sorted_rows(simhash_dedup.near_duplicates(docs, hot_shard=20), "doc_id", "fingerprint", "component_id") == want
