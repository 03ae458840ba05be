"""The corpus pipeline: language ID, quality, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm import jaccard, language, packing, quality
from strandloom.session import saved


def _columns(judged, columns):
    return judged.select(*[F.col(f"kept_{c}").alias(c) for c in columns])


def identify_language(spark, docs, sf_dir):
    """Drops documents without letters and those unlike every learned language."""
    judged = language.identify(docs, language.held_out_by(5, 0), keep=tuple(docs.columns))
    return _columns(judged.where("not rejected"), docs.columns)


def classify_quality(spark, docs, sf_dir):
    """Drops documents whose combined score says poor quality."""
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=tuple(docs.columns))
    return _columns(judged.where("kept"), docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group of near duplicates."""
    return jaccard.deduplicated(docs)


def pack(spark, docs, sf_dir):
    """Packs all that is left into sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("quality", classify_quality), ("near_duplicates", drop_near_duplicates),
          ("best_fit_packing", pack)]
#: Trained classifiers, whole-text similarity joins and token ids have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
