import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import quality as Q
from quirespark.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def test_gradient_fits_ordered_grades():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (600, 4)).astype(float)
    z = x @ np.array([3.0, 2.0, 0, 0])
    grades = np.digitize(z, [1, 2.5, 4])
    rows, cols = np.nonzero(x)
    w, theta = X.fit_ordinal(rows, cols, x[rows, cols], grades, 4, ridge=0.5)
    assert w[0] > w[1] > 1 > abs(w[2]) and (np.diff(theta) > 0).all()
    p = X.SeverityModel({}, tuple(theta)).at_least(x @ w)
    assert (np.diff(p, axis=1) <= 0).all()
    assert ((p > 0.5).sum(axis=1) == grades).mean() > 0.95


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    clean = "the of and ring stone water light over under river little house".split()
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(rng.randrange(20, 200))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 8) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["Blorg!", "blorgish", "zork,", "zork"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_severity_on_held_out_documents(labelled):
    docs, labels = labelled
    model = X.fit_severity(docs, labels.where("doc_id % 7 < 5"))
    got = X.severity(docs, model).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where("doc_id % 7 >= 5").toPandas()
    assert (got["toxic"] == (got["y"] == 1)).mean() > 0.98
    assert got["severity"].between(0, X.GRADES).all()
    assert got[got["y"] == 1]["severity"].mean() > 1 > got[got["y"] == 0]["severity"].mean()


def test_severity_scores_are_those_of_brute_force(labelled):
    """Every score, grade and call again, from the model's weights, by a plain loop over words."""
    import math
    import zlib

    docs, labels = labelled
    model = X.fit_severity(docs, labels)
    texts = dict(docs.collect())
    got = {r["doc_id"]: r for r in X.severity(docs, model).collect()}
    edges = ".,;:!?\"'()[]«»„“”…¿¡"
    for i, text in texts.items():
        words, counts = text.split(), {}
        for word in words:
            word = word.lower().strip(edges)
            for name in [f"w:{word}"] + [f"s{n}:{word[:n]}" for n in (4, 5, 6, 7) if len(word) > n]:
                f = zlib.crc32(name.encode()) % 2**20
                counts[f] = counts.get(f, 0) + 1
        z = sum(model.weights.get(f, 0) * (math.log(1 + c) + math.log(1 + 100 * c / len(words))) for f, c in counts.items())
        p = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        mass = [a - b for a, b in zip([1, *p], [*p, 0], strict=True)]
        r = got[i]
        assert abs(r["severity"] - sum(p)) < 1e-9 and r["toxic"] == (p[0] >= model.cut) and mass[r["grade"]] >= max(mass) - 1e-12


def test_features_are_all_that_mark(labelled, spark):
    """The chosen features against counts made by plain Python; none is left out, however many there are."""
    import math

    docs, labels = labelled
    texts, toxic = dict(docs.collect()), dict(labels.collect())
    prints = {}
    for i, t in texts.items():
        prints.setdefault((X.print_of(t), toxic[i]), t)
    n1, n0 = (sum(y == k for _, y in prints) for k in (1, 0))
    seen: dict = {}
    for (_, y), t in prints.items():
        for f in {f for w in t.split() for f in X.features_of(w)}:
            seen.setdefault(f, [0, 0])[y] += 1
    want = {f for f, (c, t) in seen.items() if t >= X.LEAST_DOCS and math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1)) >= X.LEAST_ODDS}
    assert set(X.fit_severity(docs, labels).weights) <= want and len(want) > 3


def test_models_learn_one_row_an_id(spark):
    """An id that stands in very many rows counts once."""
    docs = spark.createDataFrame([(k, f"plain words number {k} stand here today") for k in range(40)] + [(7, f"{k} ! {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    assert len(Q.fit_quality(docs, labels).labels) == sum(1 for k in range(40) if __import__("zlib").crc32(str(k).encode()) % 4 != 2)
    assert X.severity(docs, X.fit_severity(docs, labels)).count() == 540


def test_severity_odd(labelled, docs, odd, empty):
    model = X.fit_severity(*labelled)
    got = X.severity(docs.withColumn("toxic", F.lit("mine")), model)
    assert got.count() == docs.count() and dict(got.dtypes)["toxic"] == "boolean" and "size" in got.columns
    assert not any(r["toxic"] for r in X.severity(odd, model).collect()) and X.severity(empty, model).count() == 0
    none = X.fit_severity(labelled[0], labelled[1].where("toxic = 0"))
    assert not any(r["toxic"] for r in X.severity(labelled[0], none).collect())
    assert X.severity(labelled[0], X.fit_severity(labelled[0], labelled[1].limit(0))).count() == 400


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.quality_scores(docs, Q.fit_quality(docs, labels)).join(labels, "doc_id").toPandas()
    out = got[got["held_out"]]
    assert len(out) > 50 and (out["predicted"] == out["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()


def test_votes_are_those_of_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit_quality(docs, labels, sample=200)
    texts = [r["text"] for r in docs.select("text").limit(40).collect()] + ["", "x"]
    counts = Q.term_counts(texts, Q.Memo(Q.terms_of, 1000))
    got = model.vote(counts, 5)
    for v, s in zip(model.vectors(counts), got, strict=True):
        cosines = model.points @ v
        near = np.argsort(-cosines, kind="stable")[:5]
        w = np.maximum(cosines[near], 0).astype(float)
        low = np.sort(cosines)[-5]
        if (np.abs(cosines - low) < 1e-6).sum() == 1:  # no tie at the edge
            want = (w * model.labels[near]).sum() / w.sum() if w.sum() > 1e-9 else model.prior
            assert abs(want - s) < 1e-4


def test_every_character_of_a_long_word_counts():
    a, b = "x" * 44 + "!" * 11, "x" * 44 + "7" * 11
    one, two, three = Q.term_counts([a, b, "y" * 4000 + "!"], Q.Memo(Q.terms_of, 1000))
    assert (one != two).any() and one[1 : Q.CLASSES].sum() == 2 and three[Q.CLASSES :].sum() == 101
    assert (Q.term_counts(["one two"], Q.Memo(Q.terms_of, 10)) != Q.term_counts(["won tow"], Q.Memo(Q.terms_of, 10))).any()


def test_quality_odd(spark, docs, odd, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    assert Q.quality_scores(docs, model).count() == docs.count() and Q.quality_scores(empty, model).count() == 0
    rows = Q.quality_scores(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows) and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert {r["score"] for r in Q.quality_scores(docs, Q.fit_quality(docs, labels.limit(0))).collect()} == {0.5}
