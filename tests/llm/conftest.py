import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, size string, node string"
WORDS = "the of and ring stone water light over under river little house green tree walked slowly toward evening nothing else remained but a sound".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Nulls in any column, empty, blank, short and long texts, copies, near copies, shared passages, repeated rows; extra columns bear names the operators use."""
    rng = random.Random(5)
    texts: list = [None, "", " \n\t", "one", "one  two", "One Two three", "é漢字🙂 naïve\x00 x", "a" * 450, "ab " * 400, prose(rng, 6000)]
    base = prose(rng, 200)
    passage = prose(rng, 60)
    texts += [base, base, base.replace(" ", "  "), base + " tail", "head " + base, base[: len(base) // 2], base.upper()]
    words = base.split()
    for k in range(12):
        w = words.copy()
        for _ in range(k):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 80) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    texts += [prose(rng, rng.randrange(1, 120)) for _ in range(30)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["b", "a", "c", None]), None, "x", "y", None) for i, t in zip(ids, texts, strict=True)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    rows = [(None, "some words stand here now and then", 1), (None, None, 1), (3, "some words stand here now and then", 1), (3, "some words stand here now and then", 1), (3, "other words altogether stand here", 1), (1, "", 1), (None, "some words stand here now and then", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
