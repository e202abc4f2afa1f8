"""Operator 7: quality rules as a bitmask ledger (native SQL functions only).

``ledger`` measures every text once and stores, beside the measurements, one bit per rule
that the text fails.  Policies are versioned sets of rules, i.e. masks over those bits, so
that a new policy, or the ablation of a rule, is a bitwise test over the ledger and never a
second pass over texts.

Null texts count as empty (no words, every base bit as measured); ties do not arise, since
each row is judged alone and repeated rows get equal rows; an empty table gives an empty
ledger.  A very long text is one row whose arrays hold its word hashes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm._shared import WS_CHARS, col, fresh, table, text_or_empty, words_of

WINDOW = 8

#: rule name -> failing condition over the measurements, in bit order
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines",
    "word_length": "n_words > 0 AND (2 * word_chars < 5 * n_words OR word_chars > 12 * n_words)",
    "upper_case": "10 * n_upper > 4 * word_chars",
}
BASE_RULES = ("few_words", "repeated_windows")

#: policy version -> the rules that reject a document under it
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE_RULES,
    "web-1": BASE_RULES + ("symbols", "upper_case"),
    "web-2": tuple(RULES),
}
CURRENT_POLICY = "web-2"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(version: str) -> int:
    return sum(bit(r) for r in POLICIES[version])


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at the given sorted positions."""
    reach = F.transform(positions, lambda p, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get(positions, j + 1) - p, F.lit(WINDOW))))
    return F.aggregate(reach, F.lit(0), lambda a, x: a + x)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and the measurements of its whole text.

    ``n_repeat_words`` counts words inside 8-word windows that the text holds twice or more:
    window hashes are sorted with their positions, equal neighbours name the repeated
    positions, and the union of those windows is added up."""
    t = F.col("t")
    step = docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    step = step.select("doc_id", "t", words_of(t).alias("words"),
                       F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "").alias("lines"))
    step = step.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    n, h = F.size("h"), F.col("h")
    step = step.withColumn("win", F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))).drop("h")
    some = F.size(F.array_distinct("win")) < F.size("win")
    step = step.withColumn("by_hash", F.when(some, F.sort_array(
        F.transform("win", lambda x, i: F.struct(x.alias("w"), i.alias("i")))))).drop("win")
    s = F.col("by_hash")
    twin = F.transform(s, lambda x, j: F.when(
        (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"]), x["i"]))
    step = step.withColumn("starts", F.sort_array(F.array_compact(twin))).drop("by_hash")
    return step.select("doc_id", *MEASURES[:5],
                       F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
                       "n_upper")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """Measurements plus ``fail_bits``: bit i is set when rule i of ``RULES`` fails."""
    bits = sum((F.when(F.expr(cond), F.lit(bit(r))).otherwise(F.lit(0)) for r, cond in RULES.items()),
               F.lit(0))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def apply_policy(led: DataFrame, version: str = CURRENT_POLICY) -> DataFrame:
    """Add ``policy``, ``base_failed`` and ``kept``: no rule of the version may fail, and the
    base rules hold under every version."""
    base = sum(bit(r) for r in BASE_RULES)
    bits = F.col("fail_bits")
    return (led.withColumn("policy", F.lit(version))
               .withColumn("base_failed", bits.bitwiseAND(base) != 0)
               .withColumn("kept", bits.bitwiseAND(mask(version) | base) == 0))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         version: str = CURRENT_POLICY) -> DataFrame:
    """The input rows and columns that the policy keeps.  The verdict is an expression over the
    row itself, so nothing is shuffled or joined.

    A row number in the condition keeps the optimizer from pushing the filter below the steps
    of ``measure``: it would put each step's expression into the next one's lambda, to be
    evaluated once per word."""
    whole = fresh(docs, "row")
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(whole))
    judged = apply_policy(ledger(rows, whole, F.col(whole).getField(text_col)), version)
    judged = judged.select("doc_id", "kept", F.monotonically_increasing_id().alias("at"))
    return judged.filter("kept AND at >= 0").select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns])


def ablations(led: DataFrame, version: str = CURRENT_POLICY) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it fails, and documents kept
    when it alone is switched off.  One aggregation over the stored bits."""
    m, bits = mask(version), F.col("fail_bits")
    rules = POLICIES[version]
    agg = [F.count_if(bits.bitwiseAND(m) == 0).alias("kept")]
    for r in rules:
        agg += [F.count_if(bits.bitwiseAND(bit(r)) != 0).alias(f"f_{r}"),
                F.count_if(bits.bitwiseAND(m) == bit(r)).alias(f"o_{r}")]
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed"),
                                        F.col(f"o_{r}").alias("failed_alone"),
                                        (F.col("kept") + F.col(f"o_{r}")).alias("kept_without"))
                               for r in rules]))
    return led.agg(*agg).select(rows.alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_lines", "n_upper", "fail_bits")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT k, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (
  SELECT k, i, array_to_string(words[i:i+7], ' ') AS g
  FROM (SELECT k, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
dup AS (
  SELECT k, i FROM win JOIN (SELECT k, g FROM win GROUP BY k, g HAVING count(*) > 1) USING (k, g)),
cov AS (
  SELECT k, count(DISTINCT i + o) AS c FROM dup, generate_series(0, 7) AS s(o) GROUP BY k),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '\P{Lu}', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN cov USING (k)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
     + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN n_words > 0 AND (2 * word_chars < 5 * n_words OR word_chars > 12 * n_words) THEN 16 ELSE 0 END
     + CASE WHEN 10 * n_upper > 4 * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, fail_bits FROM f
"""
