"""The flagship query: "which tests do we keep, and how valid are they?"

generations -> token entropy -> per-test features (punctuation-filtered) ->
group folds -> out-of-fold Gaussian NB y_prob -> threshold/top-N selection
per function -> precision / recall / F1 of the selection.

Shuffles: none for the features (computed on the nested token arrays where a
generation is read, stored once), one partial aggregation for the k-fold
moments (k x 2 rows, broadcast back), one top-N window with partial
WindowGroupLimit, one cutoff join (AQE-sized), one final aggregation.  The
generations are scanned once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import learn as L
from ..operators import metrics as M
from ..operators import selection as S
from ..sources import adapters as A

FEATS = [f"{s}_{t}" for s in ("input", "output") for t in ("mean", "max", "min", "sum", "total", "variance")]
KEY = ("dataset", "llm", "function_id")


def scored_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The per-test features (key + 12 doubles) are read by the NB fit and by
    # the scoring, and the scores feed both the cutoffs and the flags: the fit
    # stores the feature table, so the generations are scanned once; scoring
    # from it is a projection with a broadcast k-row parameter table.
    feats = FE.token_stats_nested(A.generations_v(spark, sf_dir), "entropy")
    nb = L.gaussian_nb_oof(S.group_kfold(feats, 5), FEATS, "is_valid")
    return nb.select(*KEY, "test_idx", "fold", "y_prob", F.col("is_valid").alias("y_true"))


def flagship(spark: SparkSession, sf_dir: str, threshold: float = 0.8, top_n: int = 3) -> DataFrame:
    flagged = S.flag_selected(scored_tests(spark, sf_dir), threshold, top_n, by=KEY)
    return M.selection_prf(flagged)
