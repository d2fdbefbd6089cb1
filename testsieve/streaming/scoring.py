"""Incremental scoring of generations as they arrive.

The reference has no streaming; this module only runs the existing batch
operators on a file stream: per-test features from the nested token arrays
(stateless, narrow) and a saved feature pipeline (``fit_full_pipeline``),
written with ``foreachBatch`` into a scored table partitioned by (batch_id, dataset,
llm).  Exactly-once comes from the checkpoint location, which repeats a batch
under its id, and the overwrite of that batch's folder alone."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import features as FE
from ..operators import learn as L
from ..sources.readers import GENERATIONS


def score_generations_stream(spark: SparkSession, source_dir: str, model_path: str, sink_path: str,
                             checkpoint_dir: str, name: str = "logistic_regression",
                             trigger_once: bool = True) -> StreamingQuery:
    gens = spark.readStream.schema(GENERATIONS).parquet(source_dir)
    feats = FE.token_stats_nested(gens, "entropy")
    model = PipelineModel.load(model_path)

    def write(batch: DataFrame, epoch: int) -> None:
        scored = L.predict_proba(model, batch, name, "prediction_y_prob")
        (scored.sortWithinPartitions("dataset", "llm").write.mode("overwrite").partitionBy("dataset", "llm")
         .parquet(f"{sink_path}/batch_id={epoch}"))

    w = feats.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
