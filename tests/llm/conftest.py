import random

import pytest

WORDS = "the of and to in is was for that with on as his they at be this from have or by one had not but what all were when we there can an your which their".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.6 else "") for _ in range(n))


def rows():
    """doc_id, text, lang, source, n_chars and columns whose names clash with the operators' own."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [(0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), None, "b"), (3, None, "en", None), (4, "", "de", "b"), (5, " \n\t ", "de", ""), (6, "12 34 !!", None, "b"),
           (7, prose(2, 6000), "en", "a"), (8, "one two three", "en", None), (9, "ONE  two\tthree", "en", "é"), (9, "ONE  two\tthree", "en", "é"), (12, "日本語 テキスト ▁ <|endoftext|> x", "ja", "é"), (None, "no id here", "en", "a")]
    out += [(100 + k, prose(100 + k, 30 + k), "en", "a") for k in range(30)]
    return [(*r, len(r[1]) if r[1] is not None else None, "x", 1.5, 7) for r in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size double, n long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
