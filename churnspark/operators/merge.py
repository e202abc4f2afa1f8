"""Keyed merge family: multi-source merge, dedup, upsert, update, delete, insert-ignore,
version differences and order-free fingerprints.

Scale notes
-----------
* ``merge_sources`` folds the per-source "last row wins" dedup and the N-way full outer
  merge into ONE aggregation keyed on the customer key: each source becomes a nullable
  struct column, rows are unioned, and ``max(struct(order..., payload...))`` per source
  picks the last row.  One shuffle instead of one per join, and map-side partial
  aggregation collapses a hot key before it is shuffled.  A caller that names the columns it
  wants shuffles only these (the optimizer cannot prune the fields of an aggregated struct).
* ``dedup_last`` uses the same ``max(struct)`` aggregate instead of a
  ``row_number`` window, so a key holding a third of all rows is pre-aggregated on the
  map side instead of sorted inside one task.
* Upsert / update / delete / insert-ignore measure the (deduplicated) incoming batch: a
  small batch is broadcast and the table is only scanned, never shuffled; a large one
  uses one sort-merge join, where AQE splits skewed partitions.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators import rows as R


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _order_struct(order: Sequence[str | Column] | None) -> Column:
    if not order:
        return F.lit(0)
    cols = [(_q(c) if isinstance(c, str) else c) for c in order]
    return F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(cols)])


# -- D19 / W1: last row per key ------------------------------------------------------

def dedup_last(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column] | None = None,
               payload: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the greatest by ``order`` (ties broken by the row values, so the
    result is deterministic).  Aggregate, not a window: partial aggregation runs map-side.
    ``payload`` names the columns kept (default: all but the key)."""
    keys = [key] if isinstance(key, str) else list(key)
    payload = list(payload) if payload is not None else [c for c in df.columns if c not in keys]
    if not payload:
        return df.select(*[_q(k) for k in keys]).distinct()
    packed = F.struct(_order_struct(order).alias("_ord"), F.struct(*[_q(c) for c in payload]).alias("_row"))
    return (df.groupBy(*[_q(k) for k in keys])
              .agg(F.max(packed).alias("_m"))
              .select(*[_q(k) for k in keys], "_m._row.*"))


class RepeatedKeysError(ValueError):
    pass


def require_order(df: DataFrame, key: str, order: Sequence[str | Column] | None) -> None:
    """Without an ``order`` no row of a repeated key is the last one: raise when a key has
    different rows.  One partial aggregation over the batch; NULL keys match nothing."""
    if order:
        return
    row = F.struct(*[_q(c) for c in df.columns])
    clash = (df.filter(_q(key).isNotNull()).groupBy(_q(key))
               .agg((~F.min(row).eqNullSafe(F.max(row))).alias("_clash")).filter("_clash").limit(3).collect())
    if clash:
        raise RepeatedKeysError(f"keys with different rows and no order, e.g. {[r[0] for r in clash]}")


def dedup_first(df: DataFrame, key: str, order: Sequence[str | Column] | None = None) -> DataFrame:
    """One row per key: the least by ``order`` (ties broken by the row values)."""
    packed = F.struct(_order_struct(order).alias("_ord"), F.struct(*[_q(c) for c in df.columns]).alias("_row"))
    return df.groupBy(_q(key).alias("_k")).agg(F.min(packed).alias("_m")).select("_m._row.*")


# -- J1: merge of topic sources ------------------------------------------------------

def merge_sources(sources: Sequence[DataFrame], key: str = S.KEY,
                  orders: Sequence[Sequence[str | Column] | None] | None = None,
                  strategy: str = "aggregate", columns: Sequence[str] | None = None,
                  no_ties: bool = False) -> DataFrame:
    """N-way full outer merge on ``key``: a key in any source is kept, with NULLs for the
    fields of the sources it is absent from.  Duplicate keys within a source keep the last
    row by that source's order (``orders[i]``).

    ``strategy="aggregate"`` (default): one shuffle, see module notes.
    ``strategy="join"``: dedup each source, then chained full outer joins ``USING(key)``.

    ``columns``: the columns wanted beside the key (default: all).  The rows stay the same; of
    a source only these columns are shuffled, and of a source with none of them only its
    keys.  Rows that tie in the order are told apart by their values from left to right, so the
    columns before a wanted one are carried too, unless ``no_ties`` states that no two rows of a
    key tie (without an order: that keys do not repeat)."""
    orders = list(orders) if orders is not None else [None] * len(sources)
    # order columns given by name are ordering only, not payload
    payloads = [[c for c in s.columns if c != key and c not in {x for x in (o or []) if isinstance(x, str)}]
                for s, o in zip(sources, orders)]
    seen: set[str] = set()
    for p in payloads:
        dup = seen.intersection(p)
        if dup:
            raise ValueError(f"columns in more than one source: {sorted(dup)}")
        seen.update(p)
    wanted = [[c for c in p if columns is None or c in columns] for p in payloads]
    if columns is not None:
        unknown = set(columns) - seen - {key}
        if unknown:
            raise ValueError(f"columns in no source: {sorted(unknown)}")
        payloads = [w if no_ties or not w else p[:p.index(w[-1]) + 1] for p, w in zip(payloads, wanted)]

    if strategy == "join":
        out = None
        for s, o, p in zip(sources, orders, payloads):
            d = dedup_last(s, key, o, payload=p)
            out = d if out is None else out.join(d, on=key, how="full_outer")
        return out.select(_q(key), *[_q(c) for w in wanted for c in w])

    tagged = []
    for i, (s, p, o) in enumerate(zip(sources, payloads, orders)):
        if not p:
            tagged.append(s.select(_q(key)))
            continue
        packed = F.struct(_order_struct(o).alias("_ord"), F.struct(*[_q(c) for c in p]).alias("_row"))
        tagged.append(s.select(_q(key), packed.alias(f"_s{i}")))
    unioned = tagged[0]
    for t in tagged[1:]:
        unioned = unioned.unionByName(t, allowMissingColumns=True)
    winners = [F.max(f"_s{i}").alias(f"_s{i}") for i, p in enumerate(payloads) if p]
    merged = unioned.groupBy(_q(key)).agg(*winners) if winners else unioned.distinct()
    return merged.select(_q(key), *[F.col(f"_s{i}._row.`{c}`").alias(c)
                                     for i, w in enumerate(wanted) for c in w])


# -- small-batch path ---------------------------------------------------------------------
# An incoming batch (upload file, micro-batch, update list) is usually tiny next to the
# table.  A full outer / shuffle join would move the whole table through the network on
# every batch; instead the deduplicated batch is measured and, under the bound, broadcast:
# the table is only scanned (twice, once for its key column) and never shuffled.

def _measured(df: DataFrame, max_bytes: int) -> tuple[DataFrame, bool]:
    df = R._keep(df)                       # released by R.release_caches(), after each published version
    return df, R.measured_bytes(df) <= max_bytes


def _present_keys(table: DataFrame, small_keys: DataFrame, key: str) -> DataFrame:
    """Keys of a small batch that exist in the table: a broadcast semi join, deduplicated, so
    it has at most one row per batch key and is safe to broadcast in turn."""
    return (table.select(_q(key)).join(F.broadcast(small_keys.select(_q(key))), on=key, how="left_semi")
                 .distinct())


def _choose(strategy: str, batch: DataFrame, max_bytes: int) -> tuple[DataFrame, str]:
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError("strategy must be 'auto', 'broadcast' or 'shuffle'")
    if strategy != "auto":
        return batch, strategy
    batch, small = _measured(batch, max_bytes)
    return batch, "broadcast" if small else "shuffle"


# -- J2 / A6: upsert -----------------------------------------------------------------

def upsert(table: DataFrame, incoming: DataFrame, key: str = S.KEY,
           blanks: str = "overwrite", order: Sequence[str | Column] | None = None,
           fields: Iterable[str] | None = None, strategy: str = "auto",
           max_broadcast_bytes: int = R.MAX_BROADCAST_BYTES) -> DataFrame:
    """The merged table, see ``upsert_plan``."""
    return upsert_plan(table, incoming, key, blanks, order, fields, strategy, max_broadcast_bytes)[0]


def upsert_plan(table: DataFrame, incoming: DataFrame, key: str = S.KEY,
                blanks: str = "overwrite", order: Sequence[str | Column] | None = None,
                fields: Iterable[str] | None = None, strategy: str = "auto",
                max_broadcast_bytes: int = R.MAX_BROADCAST_BYTES, unique: bool = False) -> tuple[DataFrame, str]:
    """Insert new keys; for existing keys overwrite the columns the incoming frame carries
    and keep all others.  Presence is decided by the incoming *schema*, not by value.

    ``blanks="overwrite"``: an incoming NULL overwrites (the source system's behaviour).
    ``blanks="keep"``: an incoming NULL keeps the old value.
    Incoming duplicate keys: the last by ``order`` wins; without an order, keys with different
    rows raise ``RepeatedKeysError``.  ``unique`` says that keys do not repeat (a merge of sources,
    say): the batch is then neither checked nor deduplicated.  Unknown incoming columns are ignored.
    ``strategy``: "shuffle" = one full outer sort-merge join; "broadcast" = the deduplicated
    batch is broadcast and the table is never shuffled; "auto" = broadcast when the batch
    takes at most ``max_broadcast_bytes`` (measured), else shuffle.

    Returns (merged table, strategy taken): after "broadcast" the table's rows stand in the
    partitions and the order they were read in.
    """
    if blanks not in ("overwrite", "keep"):
        raise ValueError("blanks must be 'overwrite' or 'keep'")
    allowed = set(fields) if fields is not None else set(table.columns)
    given = [c for c in incoming.columns if c != key and c in allowed and c in table.columns]
    inc = incoming
    if not unique:
        require_order(incoming.select(_q(key), *[_q(c) for c in given]), key, order)
        inc = dedup_last(incoming, key, order, payload=given)
    inc = inc.select(_q(key), *[_q(c).alias(f"_n_{c}") for c in given], F.lit(True).alias("_in"))
    inc, strategy = _choose(strategy, inc, max_broadcast_bytes)

    def merged_cols(key_col: Column) -> list[Column]:
        cols = []
        for c in table.columns:
            if c == key:
                cols.append(key_col.alias(key))
            elif c in given:
                new = F.col(f"_n_{c}").cast(table.schema[c].dataType)
                if blanks == "overwrite":
                    cols.append(F.when(F.col("_in"), new).otherwise(_q(c)).alias(c))
                else:
                    cols.append(F.coalesce(new, _q(c)).alias(c))
            else:
                cols.append(_q(c))
        return cols

    if strategy == "shuffle":
        return table.join(inc, on=key, how="full_outer").select(merged_cols(_q(key))), strategy
    b = F.broadcast(inc)
    updated = table.join(b, on=key, how="left").select(merged_cols(_q(key)))
    fresh = inc.join(F.broadcast(_present_keys(table, inc, key)), on=key, how="left_anti")
    inserted = fresh.select([
        _q(key) if c == key else
        (F.col(f"_n_{c}").cast(table.schema[c].dataType).alias(c) if c in given
         else F.lit(None).cast(table.schema[c].dataType).alias(c))
        for c in table.columns])
    return updated.unionByName(inserted), strategy


def type_errors(incoming: DataFrame, types: Mapping[str, str], key: str = S.KEY) -> DataFrame:
    """Rows whose non-NULL value does not convert to the table type: (key, column, value).
    An upsert job fails before writing when this is non-empty (one transaction)."""
    checks = [(c, t) for c, t in types.items() if c in incoming.columns and c != key]
    if not checks:
        return incoming.sparkSession.createDataFrame([], f"{key} string, column string, value string")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value"),
                               (_q(c).isNotNull() & _q(c).try_cast(t).isNull()).alias("bad"))
                      for c, t in checks])
    return (incoming.select(_q(key).cast("string").alias(key), F.inline(pairs))
                    .filter("bad").drop("bad"))


# -- J3: update ----------------------------------------------------------------------

def update(table: DataFrame, updates: DataFrame, key: str = S.KEY, strategy: str = "auto",
           max_broadcast_bytes: int = R.MAX_BROADCAST_BYTES,
           order: Sequence[str | Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Set the given columns where the key matches.  Returns (new table, keys not found).
    The last row of a key by ``order`` wins; order columns named as strings are ordering only.
    Without an order, keys with different rows raise ``RepeatedKeysError``.  A small update list is broadcast (measured), so the table is not shuffled."""
    named = {c for c in (order or []) if isinstance(c, str)}
    given = [c for c in updates.columns if c != key and c in table.columns and c not in named]
    if not given:
        raise ValueError(f"no recognised fields in update; expected some of {table.columns}")
    require_order(updates.select(_q(key), *[_q(c) for c in given]), key, order)
    upd = dedup_last(updates, key, order, payload=given)
    upd = upd.select(_q(key), *[_q(c).alias(f"_n_{c}") for c in given], F.lit(True).alias("_in"))
    upd, strategy = _choose(strategy, upd, max_broadcast_bytes)
    small = strategy == "broadcast"
    joined = table.join(F.broadcast(upd) if small else upd, on=key, how="left")
    out = joined.select([
        (F.when(F.col("_in"), F.col(f"_n_{c}").cast(table.schema[c].dataType)).otherwise(_q(c)).alias(c)
         if c in given else _q(c)) for c in table.columns])
    present = F.broadcast(_present_keys(table, upd, key)) if small else table.select(_q(key))
    not_found = upd.select(_q(key)).join(present, on=key, how="left_anti")
    return out, not_found


# -- J5: delete ----------------------------------------------------------------------

def delete(table: DataFrame, keys: DataFrame, key: str = S.KEY, strategy: str = "auto",
           max_broadcast_bytes: int = R.MAX_BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Remove the listed keys.  Returns (new table, keys not found).  A small key list is
    broadcast (measured), so the table is not shuffled."""
    k, strategy = _choose(strategy, keys.select(_q(key)).distinct(), max_broadcast_bytes)
    if strategy == "broadcast":
        return (table.join(F.broadcast(k), on=key, how="left_anti"),
                k.join(F.broadcast(_present_keys(table, k, key)), on=key, how="left_anti"))
    return table.join(k, on=key, how="left_anti"), k.join(table.select(_q(key)), on=key, how="left_anti")


# -- A12 / G2: insert, ignore existing keys ------------------------------------------

def insert_ignore(table: DataFrame, rows: DataFrame, key: str = S.KEY, strategy: str = "auto",
                  max_broadcast_bytes: int = R.MAX_BROADCAST_BYTES,
                  order: Sequence[str | Column] | None = None) -> DataFrame:
    """Insert the rows whose key the table does not hold.  Of rows that share a key the first
    by ``order`` goes in (order columns unknown to the table are ordering only); without an
    order, keys with different rows raise ``RepeatedKeysError``."""
    known = [c for c in rows.columns if c in table.columns]
    require_order(rows.select(*[_q(c) for c in known]), key, order)
    rows = dedup_first(rows, key, order)
    rows = rows.drop(*[c for c in (order or []) if isinstance(c, str) and c not in table.columns])
    rows, strategy = _choose(strategy, rows, max_broadcast_bytes)
    present = F.broadcast(_present_keys(table, rows, key)) if strategy == "broadcast" else table.select(_q(key))
    new = rows.join(present, on=key, how="left_anti")
    return table.unionByName(new, allowMissingColumns=True)


# -- J4 / G1: what changed between versions ------------------------------------------

def _null_safe_cond(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    cond = None
    for c in cols:
        e = a[c].eqNullSafe(b[c])
        cond = e if cond is None else cond & e
    return cond


def added_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of ``current`` with no equal row in ``previous`` over the common columns
    (NULL equals NULL).  Keeps duplicates; a changed row shows up here too."""
    common = [c for c in current.columns if c in previous.columns]
    prev = previous.select(*[_q(c) for c in common])
    a, b = current.alias("_cur"), prev.alias("_prev")
    return a.join(b, on=_null_safe_cond(a, b, common), how="left_anti").select(*[F.col(f"_cur.`{c}`") for c in current.columns])


def removed_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    return added_rows(previous, current)


def except_all_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Bag difference over the common columns (``EXCEPT ALL``)."""
    common = [c for c in current.columns if c in previous.columns]
    return current.select(*[_q(c) for c in common]).exceptAll(previous.select(*[_q(c) for c in common]))


# -- G3: order-free fingerprint ------------------------------------------------------

def fingerprint_aggregates(df: DataFrame) -> tuple[Column, Column]:
    """(row count, order-free sum of row hashes) as aggregate expressions, usable in
    ``agg`` or in ``observe`` during a write."""
    def part(c: str) -> Column:
        text = _q(c).cast("string")
        return F.coalesce(F.concat(F.lit("V"), F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("N"))

    # each value as its byte length and text, so no two rows share a text; 60 bits of md5
    row = F.concat(*[F.concat(part(c), F.lit(";")) for c in df.columns]) if df.columns else F.lit("")
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n_rows, row_hash_sum (decimal, order-free), n_cols, schema string.
    Two frames with equal fingerprints hold the same bag of rows (up to hash collisions)."""
    n_rows, hash_sum = fingerprint_aggregates(df)
    return df.agg(n_rows.alias("n_rows"), hash_sum.cast("string").alias("row_hash_sum")) \
             .withColumn("n_cols", F.lit(len(df.columns))) \
             .withColumn("schema", F.lit(df.schema.simpleString()))
