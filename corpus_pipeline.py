"""The corpus pipeline: five stages over ``documents``, each written as Parquet in
the shared folder and read again as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All stages but the last return the columns of their input.
Rows are handled as the operators state: null and empty texts have no letter and
leave at the first stage; rows that repeat an id stay or go each by its own text, equal
rows count once; further columns stay, whatever their names; an empty table passes
through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from testsieve import session
from testsieve.llm import common as C
from testsieve.llm import decontamination, language, near_duplicates, piece_encoding, secret_spans
from testsieve.session import ship_package
from testsieve.sources.tables import load

#: SQL cannot express trained models and the encoder; tests use brute-force versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that ``op3_language`` calls ``und``: those without letters."""
    predict = language.predictor(spark, language.fit(language.training_rows(docs)))

    def known(texts):
        return [lang != language.UNKNOWN for lang, _ in predict(texts)]

    return C.filter_rows(docs, "text", known)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return near_duplicates.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by benchmark passages."""
    return decontamination.clean(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts; all documents stay."""
    return secret_spans.redact(docs, secret_spans.fit(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of the ids and of the decoded text.  The workers'
    tables are small: executors also hold what the stages before have used."""
    import public_tokenizers

    return piece_encoding.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, chunks=100_000)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = session.mark()
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # nothing reads the tables that the stage has made on its way; its own output is the last
        session.release(spark, before, keep=tuple(session.made(before)[-1:]))
    return docs
