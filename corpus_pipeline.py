"""A corpus pipeline of five stages; each works on all that the one before has kept.

Each stage's rows are written as Parquet in the folder that all executors share and read
again. Toxic documents, documents of low quality, all but one of each group of near
copies, and documents contaminated by benchmark items go; shorter passages of benchmark items are cut
from the texts that stay. Of the rest the last stage mixes the sources to their target weights,
by documents' expected grades.

Rows: a null or empty text is neither toxic nor contaminated nor anyone's copy; the quality model
judges it by its threshold alone, and the mix, which takes words, leaves it out. Very long texts are read
whole. Rows with the same doc_id and text become one; of equal texts under several ids the least id stays (a
row without an id only if no other has one). A null source is a source of its own. An empty table gives
an empty table at every stage, and empty ``labels`` or ``benchmark`` let every row pass. Extra columns pass
unchanged through all stages but the last, whatever their names; the last adds size, source_size, target and
taken, and replaces columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm import decontam, jaccard, mixing, quality, toxicity
from chunkwright.llm.textops import fresh, relieved, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    scorer = toxicity.train(docs, _training_labels(spark, sf_dir))
    relieved(spark)
    return toxicity.drop_toxic(docs, scorer)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    return quality.drop_low(docs, quality.train(docs, _training_labels(spark, sf_dir), "quality"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    return jaccard.keep_one(docs, n=5, share=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    return decontam.remove_spans(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Grades come from a model of the whole ``documents``, as rows of low quality are gone here."""
    relieved(spark)
    model = quality.train(_table(spark, sf_dir, "documents"), _training_labels(spark, sf_dir), "quality")
    grade, tails = fresh(docs, "expected_grade"), fresh(docs, "tail_probabilities")
    graded = quality.add_grades(docs, model, names=(grade, tails)).drop(tails)
    return mixing.mix(graded, weight=grade, keep_text=True).where("taken > 0").drop(grade)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: The stages' models cannot be written in SQL; tests hold each stage against planted cases and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
