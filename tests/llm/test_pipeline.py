"""The pipeline on a small table: each stage's rows follow from its operator on the stage before."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from skeinwork.llm import near_dedup, quality, secrets

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        kept.append(docs)
    for df in kept[:-1]:
        assert df.columns == list(pipeline.COLUMNS)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = quality.quality_scores(spark.read.parquet(f"{DATA}/documents.parquet"), labels).where(F.col("_score") >= pipeline.LEAST_QUALITY)
    assert {r.doc_id for r in kept[0].collect()} == {r.doc_id for r in scores.collect()}
    heads = near_dedup.near_duplicates(kept[0], percent=80).where("kept").select("doc_id")
    assert {r.doc_id for r in kept[1].collect()} == {r.doc_id for r in heads.collect()}
    assert kept[2].count() == kept[1].count() and kept[2].where("n_chars <> length(text)").count() == 0
    assert secrets.secrets(kept[3]).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0
    assert {r.doc_id for r in kept[4].select("doc_id").distinct().collect()} == {r.doc_id for r in kept[3].collect()}


def test_near_copies_between_80_and_85_percent_go(spark):
    words = [f"w{i}" for i in range(104)]
    texts = {1: words, 2: [*words[:94], *[f"x{i}" for i in range(10)]], 3: [*words[:89], *[f"y{i}" for i in range(15)]]}
    sets = {k: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for k, t in texts.items()}
    near, far = (len(sets[1] & sets[k]) / len(sets[1] | sets[k]) for k in (2, 3))
    assert 0.8 <= near < 0.85 and far < 0.8
    docs = spark.createDataFrame([(k, " ".join(t), "en", "web", 0) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, DATA).collect()} == {1, 3}


def test_documents_that_the_classifier_rejects_go(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "text", "en", "web", 4) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    scores = F.element_at(F.array(F.lit(0.4), F.lit(0.5), F.lit(0.9)), (F.col("doc_id") + 1).cast("int"))
    monkeypatch.setattr(quality, "quality_scores", lambda df, labels: df.withColumn("_score", scores))
    assert {r.doc_id for r in pipeline.reject_low_quality(spark, docs, DATA).collect()} == {1, 2}
