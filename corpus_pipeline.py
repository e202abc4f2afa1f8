"""Corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage
returns as Parquet in the shared checkpoint folder and reads it back as the next one's docs.
All stages but the last return the columns of their input.

1.  quality rules: documents that the current policy rejects go.
2.  line dedup: later copies of repeated line runs are deleted; a document that loses all its
    words with them goes.
3.  n-gram Jaccard join: one document of each component stays (links at 0.8 on five-word
    shingles).
4.  secret scans: live-looking secrets are replaced by a mark; copied examples stay.
5.  packing: documents are put into length buckets and token-budget batches, by encoded tokens.

Null and empty texts, and texts without words, fail the quality rules and go with the first stage;
in later stages alone they are left as they are.  Very long texts are worked on whole.  Ties go to the
smaller id, then text hash.  Rows equal in all columns are near duplicates: one stays.  Extra
columns are carried along, whatever their names, by every stage but the last.  An empty table gives
an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm import bpe, jaccard_join, line_dedup, packing, quality_rules, secrets
from churnspark.llm._shared import WORD_RE, col, fresh, staged, table


#: Near duplicates: words of a shingle and percentage of shared ones.
NEAR = jaccard_join.Rule(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runs = fresh(docs, "runs")
    out = line_dedup.dedup(docs, runs_name=runs)
    return out.filter(col(runs).isNull() | F.col("text").rlike(WORD_RE)).select(*[col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, rule=NEAR)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer=bpe.tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("line dedup", dedup_lines),
    ("near duplicates", near_duplicates),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: No SQL twin: prefix doubling, components and the bucket programme are iterative.  The whole
#: run is tested against a brute-force version (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
