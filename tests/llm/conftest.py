import random

import pytest

#: With columns that clash with names used inside the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, lang_pred string, _h long, node long, gone int, fp long, starts string"


def rows(seed: int = 1) -> list[tuple]:
    """Texts with copies, near copies, shared passages, repeated lines, nulls, repeated rows and one very long text."""
    r = random.Random(seed)
    words = {"en": "the of and to in is that for it as with was on be at by".split() + [f"{a}{b}ing" for a in "abcdefghij" for b in "klmnop"], "de": "der die und in den von zu das mit sich des auf".split() + [f"{a}{b}ung" for a in "abcdefghij" for b in "klmnop"]}
    say = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    out = [(i, say("de" if i % 3 == 0 else "en", r.randint(1, 260)), "de" if i % 3 == 0 else "en", f"s{i % 4}") for i in range(40)]
    passage, line = say("en", 60), say("en", 9)
    out += [(40 + i, out[i][1], out[i][2], "s0") for i in range(4)]  # exact copies
    out += [(50 + i, f"{say('en', 30)} {passage}\n{say('en', 20)}", "en", "s1") for i in range(4)]
    out += [(60, "\n".join([line] * 30), "en", "s2"), (61, f"{line} " * 12 + say("en", 50), "en", None)]
    long_ = say("en", 9000)
    out += [(70, long_, "en", "s3"), (71, long_.replace("the", "an", 2), "en", "s3")]
    base = out[5][1].split()
    out += [(80 + i, " ".join([*base[: 7 + i], "changed", *base[8 + i :]]), "en", "s0") for i in range(3)]
    out += [(90, None, "en", "s0"), (91, "", None, "s1"), (92, "  \n\t ", "en", None), (93, "1234 !!! ---", "de", "s2"), (94, "日本語 テキスト 🙂  a\x0bb\xa0c", None, "s3"), (95, "one", "en", "s0"), (None, "a row without id", "en", "s1"), (None, None, None, None)]
    out += [(30, out[30][1], out[30][2], out[30][3])]  # a repeated row
    return [(i, t, lang, s, len(t or ""), 7, "x", 5, 6, 1, 2, "y") for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
