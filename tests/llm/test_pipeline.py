"""Each stage of the pipeline against a plain version of it, on its own input; and the whole."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import near_brute, norm, texts_of

import corpus_pipeline
from quirespark.llm import queries
from quirespark.llm.mixing import mix
from quirespark.llm.unigram import coder


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    toxic = spark.range(1000, 1060).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("river stone light water "), F.repeat(F.concat(F.lit("blorg "), F.col("id").cast("string"), F.lit(" zork house ")), 3)).alias("text"),
        F.lit("en").alias("lang"),
        F.lit("a").alias("source"),
        F.lit(9).cast("long").alias("n_chars"),
    )
    whole = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(toxic)
    whole.write.parquet(f"{path}/documents.parquet")
    whole.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= 1000).cast("int").alias("toxic")).where("doc_id % 4 <> 1").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, before, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == first.columns
        kept = {r["doc_id"] for r in docs.collect()}
        was = texts_of(before)
        if name == "toxicity":
            assert kept == {i for i in was if i < 1000}
        elif name == "exact dedup":
            groups: dict = {}
            for i, t in was.items():
                groups.setdefault(norm(t), []).append(i)
            assert kept == {min(g) for g in groups.values()}
        elif name == "near dedup":
            assert kept == {c for _, c in near_brute(was, 5).values()} and docs.count() == len(kept)
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mix(before).collect()}
            assert kept == {i for i, n in taken.items() if n}
        else:
            c = coder(public_tokenizers.path("piece_bpe_32k.model"))
            want = sorted((r["doc_id"], c.encode(r["text"]).tolist()) for r in before.collect())
            assert sorted((r["doc_id"], r["ids"]) for r in docs.collect()) == want and all(r["round_trip"] for r in docs.collect())


def test_run_and_registry(spark, sf_dir):
    assert queries.queries()["pipeline"](spark, sf_dir).count() > 0
    names = list(queries.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and set(queries.oracle_sql()) <= set(names)


def test_stages_take_empty_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls, repeated ids and rows, and extra columns under names that the operators use: each stage's rows are what its docstring says."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a, "en", "s", 5, "x"), (1, a, "en", "s", 5, "x"), (1, b, None, None, None, "y"), (2, a + "  ", "en", "s", 1, None), (None, b, "de", "t", 1, "z"), (3, None, None, None, None, None), (None, "", None, "s", 0, "w"), (4, a.replace("a30 ", "new "), "en", "s", 1, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _times string")
    out = {name: stage(spark, df, sf_dir) for name, stage in corpus_pipeline.STAGES}
    assert all(d.columns == df.columns for name, d in out.items() if name != "encoding")
    key = lambda r: (r["doc_id"], (r["text"] or "").split(" ")[0][:1], len((r["text"] or "").split()))
    assert out["toxicity"].count() == len(rows)
    assert sorted(map(key, out["exact dedup"].collect()), key=str) == sorted([(1, "a", 60), (1, "b", 60), (3, "", 0), (4, "a", 60), (2, "a", 60)], key=str)
    assert sorted(map(key, out["near dedup"].collect()), key=str) == sorted([(1, "a", 60), (1, "b", 60), (3, "", 0), (None, "", 0)], key=str)
    taken = sum(r["taken"] for r in mix(df).collect())
    assert sum(len(r["text"].split()) for r in out["mixing"].collect()) == taken > 0
    assert out["encoding"].count() == len(rows)
