r"""Operator 9: document fingerprints from closed syncmers (native SQL functions only).

A text is a row of letters.  A word of up to ``SHORT`` code points is one letter; a longer one
(a text without spaces, a hash, a link) gives one letter for each of its places, the
``WINDOW`` code points from there on.  Letters are hashed; a k-mer is ``K`` letters in a row
and holds ``K - S + 1`` inner s-mers of ``S`` letters.  A k-mer is a closed syncmer, and its
hash an anchor, when the smallest of its inner s-mer hashes is the first or the last one.
Whether a k-mer is an anchor depends on its own letters alone, so that an edit changes only
the anchors that overlap it.  The fingerprint keeps every anchor at every place, written as 16
hex digits with its letter position, in order of hash, then of position; it grows with the text.

Likeness is the Jaccard similarity of the two sets of anchors, exact; ``aligned`` counts the
places where both texts have the same anchor at the same position.  Texts without a word have
the empty fingerprint; two equal fingerprints have likeness 1, an empty and a non-empty one 0.
Texts of fewer than ``K`` letters have one anchor, the hash of all their letters.

Null texts count as empty; very long texts and words are processed whole, by the same rule;
names of extra columns do not matter.  Rows that share an id are ordered by text hash; rows equal in id
and text count as one document in the order of documents and get equal results; a null id
comes last.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm._shared import WORD_RE, row_key, staged, table, text_or_empty, words_of
from churnspark.operators.rows import positions

K, S = 3, 1
#: Code points: the longest word that is one letter, and the window over longer words.
SHORT, WINDOW = 16, 8


def letters_of(text: Column) -> Column:
    """Hashes of the letters of a text that is not null, in order.  Windows are cut from four
    bytes a code point, so that each is found at once, however long the word is."""
    words = words_of(text)

    def windows(word: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(word) - WINDOW)
        bound = F.transform(F.array(F.encode(F.make_valid_utf8(word), "UTF-32")), lambda b: F.transform(
            starts, lambda i: F.xxhash64(F.substring(b, i * 4 + 1, F.lit(4 * WINDOW)))))
        return F.get(bound, F.lit(0))

    mixed = F.flatten(F.transform(words, lambda x: F.when(
        F.length(x) <= SHORT, F.array(F.xxhash64(x))).otherwise(windows(x))))
    return F.when(text.rlike(WORD_RE[:-1] + "{%d}" % (SHORT + 1)), mixed).otherwise(
        F.transform(words, lambda x: F.xxhash64(x)))


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: array of (h, p), all anchors of the column ``text`` with their positions,
    in order of both."""
    h, s = F.col("_h"), F.col("_s")
    n = F.size("_h")
    inner = K - S + 1
    df = df.withColumn("_h", letters_of(F.col(text)))
    df = df.withColumn("_s", F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, S)])))

    def closed(i: Column) -> Column:
        first, *between, last = (F.get(s, i + j) for j in range(inner))
        low = F.least(first, last)
        return low <= (F.least(low, *between) if between else low)

    def anchor(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(K)]).alias("h"), i.alias("p"))

    short = F.when(n > 0, F.array(F.struct(F.xxhash64(h).alias("h"), F.lit(0).alias("p")))).otherwise(
        F.array().cast("array<struct<h:bigint,p:int>>"))
    # the places are chosen first, so that only anchors are hashed and none is made to be dropped
    every = F.when(n < K, short).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), closed), anchor))
    return df.withColumn(name, F.sort_array(every)).drop("_s", "_h")


def as_string(anchors: Column) -> Column:
    return F.lower(F.concat_ws(",", F.transform(anchors, lambda x: F.concat(
        F.lpad(F.hex(x["h"]), 16, "0"), F.lit(":"), x["p"].cast("string")))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two anchor arrays, 0 to 1."""
    common, either = F.size(F.array_intersect(a["h"], b["h"])), F.size(F.array_union(a["h"], b["h"]))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
             .otherwise(common.cast("double") / F.greatest(either, F.lit(1))))


def aligned(a: Column, b: Column) -> Column:
    """Common places.  Long hashes of (h, p), since structs are intersected pair by pair."""
    pa, pb = (F.transform(x, lambda y: F.xxhash64(y["h"], y["p"])) for x in (a, b))
    return F.size(F.array_intersect(pa, pb)).cast("long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``th`` (text hash), ``n_chars`` and ``anchors``."""
    base = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("t"))
    return with_anchors(base.withColumn("n_chars", F.length("t").cast("long")), "t", "anchors").drop("t")


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the anchors of the next document
    in descending order of id (after the last: the first).

    Only (id, text hash, length) is put in order.  Texts are shuffled once by their key; each
    is then sent to its receiver (the document before it), which takes over a prefix and
    computes the anchors (a text is smaller than all its anchors)."""
    # one column, equal for null ids too: the aggregate and the joins below share its partitions
    key = F.struct(*row_key(id_col, text_col)).alias("key")
    base = docs.select(key, text_or_empty(text_col).alias("t"))
    keys = base.select("key.id", "key.th", F.length("t").cast("long").alias("n_chars")).distinct()
    order = [F.col("id").desc_nulls_last(), F.col("th").desc()]
    at = staged(positions(keys, order, name="pos"), "order")
    top = at.agg(F.max("pos").alias("top")).scalar()
    want = at.select(F.struct("id", "th").alias("receiver"), F.expr("n_chars div 3").alias("takes"),
                     (F.col("pos") % top + 1).alias("pos"))
    link = staged(want.join(at.select("pos", F.struct("id", "th").alias("key")), "pos").drop("pos"), "links")

    # rows equal in id and text send the same once
    sent = base.join(link, "key").select(F.col("receiver").alias("key"), "takes", F.col("t").alias("next"))
    sent = sent.groupBy("key").agg(*[F.first(c).alias(c) for c in ("takes", "next")])
    edited = F.concat(F.expr("substring(t, 1, int(length(t) - takes))"), F.expr("substring(next, 1, int(takes))"))
    both = base.join(sent, "key").select("key.id", "key.th", "t", "next", edited.alias("e"))
    both = with_anchors(with_anchors(both, "next", "next_anchors").drop("next"), "t", "anchors").select(
        "id", "th", F.length("t").cast("long").alias("n_chars"), "e", "anchors", "next_anchors",
        F.sha2("e", 256).alias("edited_sha256"))
    return with_anchors(both, "e", "edited_anchors").drop("e")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e, x = F.col("anchors"), F.col("edited_anchors"), F.col("next_anchors")
    return with_edited(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_string(a).alias("fingerprint"),
        as_string(e).alias("edited_fingerprint"), likeness(a, e).alias("near_edited"),
        likeness(a, x).alias("near_next"), aligned(a, e).alias("aligned_edited"),
        aligned(a, x).alias("aligned_next"))
