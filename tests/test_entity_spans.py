"""Spans of names against alias_spans, name by name."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.catalog import QUERIES
from tidemark.functions import folding
from tidemark.functions.names import Names, name_spans

TEXTS = ["AI said: ai, a.i. and AIs; AI", "Café CAFE\u0301 cafe cafeteria ＣＡＦＥ", "人工智能AI的ai2 x_ai ß straße STRASSE", "ﬁn fin ﬁ ½2 ²a", "", "Tom tom-tom tomtom tom tom tom", "İx .NET net 工智 a b  a b a b a"]
NAMES = ["ai", "ais", "cafe", "cafeteria", "ai2", "x", "ss", "strasse", "fin", "fi", "2a", "2", "tom", "tomtom", "and", "tom tom", "said: ai", "人工", "工智能ai", ".net", "a b a", "cafe cafe", "aa"]


def by_hand(text, names):
    return sorted((n, *x) for n in names for x in folding.alias_spans(text, n))


def test_spans_of_all_names_are_alias_spans_of_each():
    automaton = Names(NAMES)
    for text in TEXTS:
        assert sorted(automaton.spans(text)) == by_hand(text, NAMES)


@given(st.text(alphabet="aAbé\u0301ß 人.ﬁ_İ", max_size=30), st.lists(st.text(alphabet="aeb ss人.f", min_size=1, max_size=4), max_size=6))
@settings(max_examples=500, deadline=None)
def test_spans_of_any_names_are_alias_spans_of_each(text, names):
    names = sorted({folding.fold(n) for n in names} - {""})
    assert sorted(Names(names).spans(text)) == by_hand(text, names)


def test_names_in_turns_find_the_same(spark):
    r = random.Random(2)
    texts = spark.createDataFrame([(i, " ".join(r.choice(["AI", "tom", "Café", "人工", "x"]) for _ in range(30))) for i in range(40)] + [(99, None)], "id long, text string")
    names = spark.createDataFrame([(n,) for n in [*NAMES, None, " ", "AI", "Ai"]], "name string")
    one, turns = (sorted(tuple(x) for x in name_spans(texts, names, "id", "text", "name", sent=k).collect()) for k in (1 << 20, 16))
    assert one == turns and len(one) > 400


def test_every_span_of_every_name(spark, tmp_path):
    spark.createDataFrame([*enumerate(TEXTS), (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = "AI, café Cafe; fin (a) Tom tom 人工 " + "b" * 100 + " " + "c" * 101
    spark.createDataFrame([(0, asked), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = re.findall(r"[^\W_]+", asked)
    names = {folding.fold(x) for x in [*words, *map(" ".join, zip(words, words[1:], strict=False))] if 2 <= len(x) <= 100}
    want = sorted((i, *x) for i, text in enumerate(TEXTS) for x in by_hand(text, names))
    assert {"ai", "cafe", "fin", "tom", "tom tom", "cafe cafe", "人工"} <= {x[1] for x in want}
    assert sorted(tuple(r) for r in QUERIES["entity_spans"](spark, str(tmp_path)).collect()) == want
