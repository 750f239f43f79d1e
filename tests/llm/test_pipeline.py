import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandmill.llm import langid, queries
from tests.conftest import DATA
from tests.llm import brute


def test_pipeline_equals_brute_force(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")).unionByName(docs.limit(2).withColumn("text", F.lit("12 34")).withColumn("doc_id", F.col("doc_id") + 100_000))
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["text"], r["n_chars"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())

    known = {r["doc_id"] for r in langid.identify(docs, langid.train(docs)).where("accepted").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] in known]
    assert len(rows) <= docs.count() - 2
    texts = brute.drop_lines([r[:2] for r in rows])
    rows = [(i, t, s) for (i, _, s), t in zip(rows, texts)]
    classes = brute.near_classes([r[:2] for r in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    library = Tokenizer.from_file(queries._tokenizer())
    want = []
    for (i, t, _), n in zip(rows, brute.copies(rows)):
        ids = library.encode(t, add_special_tokens=False).ids
        want += [(i, t, len(t), len(ids), tuple(ids), hashlib.sha256(t.encode()).hexdigest())] * n
    assert got == sorted(want)


def test_stages_keep_columns(spark, messy, tmp_path):
    docs = messy
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert out.columns[: len(messy.columns)] == messy.columns
        assert k == len(corpus_pipeline.STAGES) - 1 or len(out.columns) == len(messy.columns)
        docs = out
    assert docs.count() > 0 and np.all([r["n_tokens"] == len(r["ids"]) for r in docs.collect()])


def test_stages_of_no_documents(spark, messy):
    docs = messy.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_encoding_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "x", "y")], "doc_id long, text string, Ids string, n_tokens string")
    row = corpus_pipeline.encode(spark, docs, DATA).first()
    assert list(row.asDict()) == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and row["n_tokens"] == len(row["ids"])
