"""Operator 12: importance resampling towards a target distribution.

Hashed counts of runs of one and two words are taken over all documents and over all target
texts.  The gain of a bucket is the floored logarithm of its share in the target over its share
in the documents; the gains form one array of ``N_BUCKETS`` numbers, and a document's weight is
the floored mean of the array at its features.  Weight plus a Gumbel number of the document's id
is its score; the documents drawn are those of the highest scores.

The place where the drawn ones end is found by a distributed quickselect over the composite key
(score descending, id, text hash): members of the open interval are picked at random as pivots,
one pass counts exactly how many rows lie before, at and between them, and the interval shrinks
to the part that holds the k-th key.  Only the rows up to that key are sorted and ranked, over
many range partitions.

Null and empty texts have no features: weight 0, and too few words to be drawn.  A null id counts
as an empty one in the Gumbel number and comes after all others of its score.  Rows equal in
score, id and text are interchangeable: as many of them are ranked as there is room for.  Very long
texts are read in pieces, so a task holds one piece's features at a time.  Without target texts
all gains come from the documents alone; an empty table gives no rows.  Extra columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm._shared import col, staged, table
from churnspark.operators.rows import positions

N_BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
#: Pivots of one selection pass.
PIVOTS = 15
#: Bytes of a text whose features are held at once.
PIECE_BYTES = 1 << 20

#: Words of lower-cased UTF-8: ASCII letters and digits, and every byte of a wider character.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def features(text: bytes, n_buckets: int, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their runs of one and two) piece by piece; the runs that cross two pieces
    belong to the second.  ``bytes.lower`` changes A-Z only."""
    before, start = None, 0
    while start < len(text):
        gap = _GAP.search(text, start + piece_bytes) if len(text) - start > piece_bytes else None
        stop = len(text) if gap is None else gap.start()
        words = _WORD.findall(text[start:stop].lower())
        start = stop
        if not words:
            continue
        own = list(map(crc32, words))
        # the check sum of "first second" goes on from that of "first"
        firsts = own[:-1] if before is None else [before, *own[:-1]]
        seconds = words[1:] if before is None else words
        pairs = list(map(crc32, [b" " + w for w in seconds], firsts))
        before = own[-1]
        yield len(words), np.array(own + pairs, dtype=np.int64) % n_buckets


def bucket_counts(texts: DataFrame, text_col: str, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: one partial array a task, summed by Spark; the sums
    (``n_buckets`` rows whatever the corpus) come to the driver."""
    def run(batches):
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, buckets in features(text.as_buffer().to_pybytes() if text.is_valid else b"", n_buckets):
                    total += np.bincount(buckets, minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = texts.select(col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(n_buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each of the B buckets."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gumbel(id_col: str | Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256("seed:id")."""
    c = F.coalesce((col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``th`` (text hash), ``n_words``, ``n_features`` and ``weight`` of every document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        g = held.value
        for batch in batches:
            out = []
            for text in batch.column(2):
                n_words = n = total = 0
                for words, buckets in features(text.as_buffer().to_pybytes() if text.is_valid else b"", len(g)):
                    n_words, n, total = n_words + words, n + len(buckets), total + int(g[buckets].sum())
                out.append((n_words, n, total // n if n else 0))
            cols = [pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols],
                                             ["doc_id", "th", "n_words", "n_features", "weight"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(F.lit("t"), col(text_col)).alias("th"),
                       col(text_col).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {id_type}, th bigint, n_words bigint, n_features bigint, weight bigint")


# -- the k-th key ----------------------------------------------------------------------------

def _key(columns: list[str]) -> Column:
    """The composite key, smallest first: score descending, then ids with nulls last, then text."""
    score, *rest = columns
    parts = [(-F.col(score)).alias("k0")]
    for i, c in enumerate(rest):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"k{i + 1}")]
    return F.struct(*parts)


def kth_key(rows: DataFrame, key: Column, k: int, pivots: int = PIVOTS, seed: int = SEED):
    """The k-th smallest ``key`` (from 1) of ``rows`` as a Row, None without it.  Every pass reads
    the rows of the open interval once, counts them around the sorted pivots of the pass before,
    and picks each part's next pivots: the rows least by a seeded hash, random members that a
    recomputed task picks again."""
    if k < 1:
        return None
    key_type = rows.select(key.alias("key")).schema["key"].dataType
    keys = rows.select(key.alias("key"))
    below, above, before = None, None, 0          # open interval (below, above), rows before it

    def lit(row) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, key_type.fields)])

    turn = 0
    while True:
        inside = keys
        if below is not None:
            inside = inside.filter(F.col("key") > lit(below))
        if above is not None:
            inside = inside.filter(F.col("key") < lit(above))
        picks = inside.agg(*[F.min_by("key", F.xxhash64(F.lit(f"{seed}:{turn}:{p}"), F.col("key"))).alias(f"p{p}")
                             for p in range(pivots)]).first()
        turn += 1
        chosen = sorted({tuple(p) for p in picks if p is not None}, key=_sortable)
        if not chosen:
            return None
        sums = inside.agg(*[F.sum((F.col("key") < lit(p)).cast("long")).alias(f"l{i}") for i, p in enumerate(chosen)],
                          *[F.sum(F.col("key").eqNullSafe(lit(p)).cast("long")).alias(f"e{i}") for i, p in enumerate(chosen)]).first()
        less = [before + sums[f"l{i}"] for i in range(len(chosen))]
        last = None
        for i, p in enumerate(chosen):
            if k <= less[i]:
                above = p
                break
            if k <= less[i] + sums[f"e{i}"]:
                return p
            last = i
        if last is not None:
            below, before = chosen[last], less[last] + sums[f"e{last}"]


def _sortable(row: tuple) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in row)


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``scored`` (``doc_id``, ``th``, ``score`` and more, written once) with ``rank``: 1, 2, 3... for
    the floor(percent / 100) of the eligible rows with the highest scores, null for the others."""
    rows = scored.filter(eligible)
    n = rows.count()
    k = percent * n // 100
    key = _key(["score", "doc_id", "th"])
    edge = kth_key(rows, key, k, seed=seed)
    if edge is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    fields = scored.select(key.alias("key")).schema["key"].dataType.fields
    bound = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(edge, fields)])
    # the plain bound on the score prunes the scan; the key decides
    wins = eligible & (F.col("score") >= -edge[0]) & (key <= bound)
    won = scored.filter(wins).withColumn("_seq", F.monotonically_increasing_id())
    ranked = positions(won, [F.desc("score"), F.asc_nulls_last("doc_id"), "th", "_seq"], name="rank").drop("_seq")
    # rows equal to the last key share its room
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(scored.filter(~F.coalesce(wins, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", n_buckets: int = N_BUCKETS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``n_features``, ``weight``, ``score``, ``rank``."""
    gain = gains(bucket_counts(docs, text_col, n_buckets), bucket_counts(target, target_col, n_buckets))
    scored = weigh(docs, gain, id_col, text_col)
    scored = staged(scored.withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scored")
    return draw(scored, F.col("n_words") >= min_words, percent, seed).select(
        "doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
