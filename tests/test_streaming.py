"""The streaming scorer runs the batch operators over a file stream."""

from pyspark.sql import functions as F

from testsieve.operators import features as FE
from testsieve.operators import learn as L
from testsieve.sources import adapters as A
from testsieve.sources.readers import GENERATIONS
from testsieve.streaming.scoring import score_generations_stream

FEATS = [f"{s}_{t}" for s in ("input", "output") for t in ("mean", "max", "min", "sum", "total", "variance")]


def test_stream_scores_every_generation(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    gens = A.generations_v(spark, sf).select(*[f.name for f in GENERATIONS.fields])
    src, model, sink, ckpt = (str(tmp_path / d) for d in ("src", "model", "sink", "ckpt"))
    gens.write.parquet(src)
    L.fit_full_pipeline(FE.token_stats_nested(gens, "entropy"), FEATS, "is_valid", model)
    q = score_generations_stream(spark, src, model, sink, ckpt)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == gens.count()
    assert out.filter((F.col("prediction_y_prob") < 0) | (F.col("prediction_y_prob") > 1)).count() == 0

    # later files of the same (dataset, llm) add to the scores of earlier batches
    gens.limit(5).write.mode("append").parquet(src)
    score_generations_stream(spark, src, model, sink, ckpt).awaitTermination(300)
    spark.catalog.refreshByPath(sink)
    out = spark.read.parquet(sink)
    assert out.count() == gens.count() + 5
    assert out.select("batch_id").distinct().count() == 2
