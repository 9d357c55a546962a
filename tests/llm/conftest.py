import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_words long, row long, h1 long, x1 long, kept_id string, doc string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long one, ties, repeated rows, and columns that clash with inner names."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    base = say(200).split()
    near = list(base)
    near[100] = "changed"
    texts = [None, "", "   \n\t ", "one", "two words", say(60), "x" * 30_000, say(60_000), " ".join(base), " ".join(base), " ".join(near),
             "é 漢字 😀 \u00a0 end", say(30) + "\n" + "same line here\n" * 30]
    rows = [(i, t, None, s, 1, 2, 3, 4, "a", "b") for i, (t, s) in enumerate(zip(texts, ["b", None, "a", "b", "b", "a", None, "c", "b", "b", "c", "a", "b"], strict=True))]
    rows += [rows[8], rows[8], (None, say(80), "en", "a", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
