"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.session import checkpoint_dir

#: The characters that separate words: space and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
#: One word, and a run of separators, as regular expressions.
WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the cluster's shared checkpoint folder and read it
    back: lineage is cut, column pruning still works on the copy, and a lost executor costs a
    reread of files instead of a recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(text: str | Column) -> Column:
    c = col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text that is not null, as an array."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_RE))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(id, text hash): tells apart rows that share an id but not a text.  Rows equal in both
    are one document to every operator."""
    return [col(id_col).alias("id"), F.xxhash64(F.lit("t"), col(text_col)).alias("th")]
