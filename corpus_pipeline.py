"""Corpus pipeline: stages that clean, mix and encode documents.

Each stage takes ``(spark, docs, sf_dir)``, where docs is what its predecessor kept, and
returns a frame with the columns of ``documents`` (the last: token ids).  Between stages the
rows are written to the shared folder as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm import line_dedup, mixing, ngram_join, sentencepiece, toxicity
from tracewell.storage import materialize


def _counted(docs):
    """``docs`` with n_chars as the text now has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length(F.col("text")).cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark, docs, sf_dir):
    """Documents that score 0.5 or more go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark, docs, sf_dir):
    """Later copies of runs of lines with 50 words or more go; all documents stay."""
    return _counted(line_dedup.without_repeats(docs))


def drop_near_copies(spark, docs, sf_dir):
    """Of each group linked by a Jaccard similarity of 0.8 or more of 5-word shingles, the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """Sources weigh 5, 2, 1 in turn; a document appears once for each time it is taken."""
    return _counted(mixing.mixed(docs))


def encode(spark, docs, sf_dir):
    """Token ids of each row of the mix."""
    return sentencepiece.encode_documents(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
