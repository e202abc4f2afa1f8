"""Operator 2: secret scans with corpus-wide ownership frequency.

Every text is scanned once for candidate values.  Their hashes are aggregated over the whole
corpus by distinct repositories and distinct owners: a value that many owners publish is a
widely copied example, a value of few owners looks live.  Base spans (assign, access, hex)
always stay; spans of the extra kind ``opaque`` (long mixed strings) are added only when
their value is owner-specific.

A repository is (source, language) and its owner the source, unless other columns are named.
Null texts count as empty, a null owner or repository is one of its own, repeated rows are
scanned like any other row, several kinds may start at the same place (ordered by kind), and
an empty table gives no rows.  Texts are scanned whole; a value shared by a third of all rows
is pre-aggregated before the shuffle and its join side is split by adaptive execution.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm._shared import col, fresh, row_key, staged, table, text_or_empty

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "opaque")
#: Extra candidates of the method: long strings that mix digits with both cases.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")

#: A value that at least so many owners publish is a widely copied example.
EXAMPLE_OWNERS = 3


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), by start and kind.  A maximal run of hex digits of 24 or
    more is what the pattern ``[0-9a-f]+`` finds and its length test keeps."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(s, e) for s, _, e, _ in out]
    for m in OPAQUE.finditer(text):
        v = m[0]
        mixed = sum(c.isdigit() for c in v) >= 3 and any(c.islower() for c in v) and any(c.isupper() for c in v)
        if mixed and not any(s < m.end() and m.start() < e for s, e in taken):
            out.append((m.start(), 3, m.end(), v))
    return sorted(out, key=lambda x: x[:2])


def span_string(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def _value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])


def _scan(batches):
    for batch in batches:
        counts, digests, spans = ([], [], []), [], []
        for text in batch.column("t").to_pylist():
            found = candidates(text)
            base = [x for x in found if x[1] < 3]
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            digests.append(hashlib.sha256(span_string(base).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "end": e, "value": _value_hash(v)} for s, k, e, v in found])
        keep = [n for n in batch.schema.names if n != "t"]
        made = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(spans, pa.list_(_SPAN))]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *made],
                                         names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         repo_cols: tuple[str, ...] = ("source", "lang"), owner_cols: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row per input row with its candidate spans and value hashes; written once, so that
    the texts are scanned once and every row has a number of its own."""
    keys = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("t"),
                       F.to_json(F.array(*[col(c).cast("string") for c in repo_cols])).alias("repo"),
                       F.to_json(F.array(*[col(c).cast("string") for c in owner_cols])).alias("owner"))
    kind = keys.schema["id"].dataType.simpleString()
    out = keys.mapInArrow(_scan, f"id {kind}, th bigint, repo string, owner string, n_assign bigint, n_access bigint, "
                                 "n_hex bigint, base_sha256 string, "
                                 "found array<struct<start:int,kind:int,end:int,value:bigint>>")
    return staged(out.withColumn("rid", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """Per value hash: spans, distinct repositories and distinct owners.  Each step is a
    partial aggregation on a narrower key, so a hot value is a few rows before it is shuffled."""
    spans = scanned.select("repo", "owner", F.explode("found.value").alias("value"))
    per_repo = spans.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_repo.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("value").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"),
                                          F.count(F.lit(1)).alias("n_owners"))


def judge(scanned: DataFrame) -> DataFrame:
    """One row per scanned row: ``spans`` (array of start, kind, end, live), without the extra
    candidates that are widely copied."""
    each = scanned.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    judged = each.join(ownership(scanned), "value").withColumn("live", F.col("n_owners") < EXAMPLE_OWNERS)
    judged = judged.filter((F.col("kind") < 3) | F.col("live"))
    spans = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    return scanned.drop("found").join(spans, "rid", "left").withColumn("spans", F.coalesce("spans", none))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(scan(table(spark, sf_dir, "documents")))
    live = F.filter("spans", lambda x: x["live"])
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
                      spans_text(F.col("spans")).alias("spans"), F.size(live).cast("long").alias("n_live"),
                      (F.size("spans") - F.size(live)).cast("long").alias("n_example"),
                      spans_text(live).alias("live_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           repo_cols: tuple[str, ...] = ("source", "lang"), owner_cols: tuple[str, ...] = ("source",)) -> DataFrame:
    """The input rows and columns, with every live-looking span of the text replaced by
    ``mark`` (overlapping spans by one mark).  Widely copied examples stay as they are."""
    found = judge(scan(docs, id_col, text_col, repo_cols, owner_cols))
    live = found.select("id", "th", F.filter("spans", lambda x: x["live"]).alias("live")).filter(F.size("live") > 0)
    live = live.dropDuplicates(["id", "th"])
    # union of overlapping spans, in order
    start = F.array().cast("array<struct<s:int,e:int>>")
    union = F.aggregate("live", start, lambda a, x: F.when(
        (F.size(a) > 0) & (x["start"] <= F.element_at(a, -1)["e"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["end"]).alias("e"))))
    ).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))))
    names = {c: fresh(docs, c) for c in ("id", "th", "cut")}
    live = live.select(F.col("id").alias(names["id"]), F.col("th").alias(names["th"]), union.alias(names["cut"]))
    th = F.xxhash64(F.lit("t"), col(text_col))
    both = docs.join(live, col(id_col).eqNullSafe(col(names["id"])) & (th == col(names["th"])), "left")
    cut, text = col(names["cut"]), col(text_col)
    pieces = F.transform(cut, lambda x, i: F.concat(
        F.substring(text, F.coalesce(F.get(cut, i - 1)["e"], F.lit(0)) + 1,
                    x["s"] - F.coalesce(F.get(cut, i - 1)["e"], F.lit(0))), F.lit(mark)))
    tail = F.substring(text, F.element_at(cut, -1)["e"] + 1, F.length(text))
    clean = F.when(cut.isNull(), text).otherwise(F.concat(F.concat_ws("", pieces), tail))
    return both.select(*[clean.alias(c) if c == text_col else col(c) for c in docs.columns])
