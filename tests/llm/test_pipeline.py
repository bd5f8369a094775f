"""The stages against brute force, each on its own input, and the whole run."""

import ast
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import kept_by_hand, key, removed_by_counting
from tidemark.llm import language_id, mixing, similar_groups
from tidemark.llm.packing import token_pieces
from tidemark.llm.shared import driver_rows, map_rows
from tidemark.plans.scratch import written


@pytest.fixture(scope="module")
def stages(spark, docs):
    """[(input, output)] by stage."""
    own, out = docs, []
    for name, stage in corpus_pipeline.STAGES:
        left = written(stage(spark, own, ""), name)
        out.append((own, left))
        own = left
    return out


def test_stages_keep_the_columns(docs, stages):
    assert len(corpus_pipeline.STAGES) == 5
    for before, after in stages[:-1]:
        assert after.dtypes == docs.dtypes and before.count() >= 1


def test_language_keeps_all_with_letters(stages):
    before, after = stages[0]
    said = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(before, language_id.fit(before)).collect()}
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert gone == {90, 91, 92, 93} and {i for i, l in said if l == "und"} - {None} == gone
    assert after.where("doc_id is null").count() == 1


def test_near_copies_leave_one_of_each_group(stages):
    before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = sorted((rows[i] for i in kept_by_hand(rows)), key=key)
    assert sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=key) == want


def test_passages_are_gone_and_the_rest_stays(stages):
    before, after = stages[2]
    left = {r["doc_id"]: r for r in after.collect()}
    for i, n, gone, _ in removed_by_counting(before.collect(), 35):
        assert (i in left) == (n > gone)
        if i in left:
            assert len(left[i]["text"].encode().split()) == n - gone and left[i]["n_chars"] == len(left[i]["text"])
    same = {r["doc_id"]: r["text"] for r in before.collect()}
    untouched = [i for i, n, gone, _ in removed_by_counting(before.collect(), 35) if not gone and n]
    assert untouched and all(left[i]["text"] == same[i] for i in untouched)


def test_mix_takes_each_document_as_often_as_its_source_does(stages):
    before, after = stages[3]
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in after.collect()) == want and max(want.values()) <= 3


def test_packing_holds_every_token(stages):
    before, after = stages[4]
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
    rows = after.collect()
    assert sum(r["length"] for r in rows) == want and max(r["length"] for r in rows) <= 4096
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in before.collect())


def test_run_is_its_stages(spark, docs, stages, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = lambda df: sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect()), key=key)
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == pieces(stages[4][1])


def test_entry_registers_all():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import tidemark

    def imported(path: Path) -> set[str]:
        names = set()
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.ImportFrom):
                names |= {f"{node.module}.{x.name}" for x in node.names}
            elif isinstance(node, ast.Import):
                names |= {x.name for x in node.names}
        return {n for n in names if "llm" in n.split(".")}

    root = Path(tidemark.__file__).parent
    assert imported(root / "llm" / "queries.py")
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and imported(p)]


def test_ops_give_whole_results_on_equal_hashes():
    assert np.array_equal(similar_groups.shingle_set("A b C", 5), similar_groups.shingle_set("a B c", 5))


def test_workers_drop_the_vocabulary_when_another_operator_comes(spark, docs):
    def build():
        import gc

        n = sum(type(x).__name__ == "WordTokens" for x in gc.get_objects())
        return lambda b: {"n": [n] * len(b)}

    token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096).collect()
    seen = map_rows(spark.range(0, 8, 1, 4), {"n": "long"}, build).collect()
    assert [r["n"] for r in seen] == [0] * 8


def test_rows_of_the_driver_start_no_python_workers(spark, docs, monkeypatch):
    """From a list they would be those of a Python RDD, whose workers stay in each executor beside those of Arrow functions."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert driver_rows(spark, [("a", 1), (None, None)], "s string, n long").collect() == [("a", 1), (None, None)]
    assert driver_rows(spark, [], "s string, n long").collect() == []
    assert language_id.fit(docs).languages == ["de", "en"]
    assert mixing.mix(docs).count() == mixing.mix(docs, carry=True).count() == docs.count()
