"""Operator 11: alignment of two tokenizers over the same bytes.

Every text is encoded by a byte-level BPE file (A, on space + text) and by a sentencepiece model
(B, on the text; it adds the space itself).  The spans the libraries give, A's character offsets
and the spans of B's proto, are coarse cuts; tokens that share a character (a multibyte character
split between tokens, byte-fallback tokens) are told apart by the lengths of their decoded bytes.
Places where tokens of both end cut a text into groups; every pair of tokens whose byte ranges
overlap is a link.

No token of either tokenizer reaches over a single space between two other characters (see
``Tokenizers``), so texts are cut into chunks there, a chunk is aligned once and found again in a
dictionary of bounded size.

Links are counted over the corpus in two steps.  A task works in blocks of about ``BLOCK_CHARS``
characters of whole texts and writes, per text, its chunks as codes into the block's own list of
distinct chunks, and per block that list with its id pairs and their counts.  Only the pairs are
shuffled to be summed; the sums travel back to their block, never to the driver or to every
executor.  Joins are on the id pair, where a frequent pair is one row a block, and on the block,
whose size is bounded by ``BLOCK_CHARS`` and the longest text.

Null and empty texts, and texts whose joined token bytes differ from space + text, have no tokens:
zeros and an empty ``groups_sha256``.  Very long texts are read piece by piece; a chunk is encoded
whole, however long.  Ties for the best partner of a B id all count as best.  Each of repeated rows
counts.  Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm._shared import col, staged, table, text_or_empty
from churnspark.llm.bpe import byte_alphabet, read_tokenizer

#: Characters of whole texts that share one list of chunks and id pairs.
BLOCK_CHARS = 8_000_000
#: Characters of texts that are cut and looked up at once.
PIECE_CHARS = 1_000_000
#: Characters of unknown chunks that are encoded as one text.
PART_CHARS = 16_000
#: A dictionary of more chunks, or characters in chunks, keeps those that a block held repeatedly, if
#: they are few enough, and starts anew otherwise.
KEPT_CHUNKS = 300_000
KEPT_CHARS = 6_000_000
#: Where a text may be cut: before a single space between two other characters.
_CUT = re.compile(r"(?<=\S)(?= \S)")


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        # one task is one core: no threads of the library's own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(raw_a.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        # A's pattern starts a new word at a single space; B must hold no piece that goes on over one
        self.can_cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.len_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        # the texts of an id before a comma, a bar and a semicolon
        self.names = [f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in ",|;"]


@lru_cache(maxsize=1)
def tokenizers_of(raw_a: bytes, raw_b: bytes) -> Tokenizers:
    return Tokenizers(raw_a, raw_b)


def cut(text: str, can_cut: bool, size: int = PIECE_CHARS) -> Iterator[list[str]]:
    """Chunks of space + text, a list for every ``size`` characters or so."""
    full, start = " " + text, 0
    if not can_cut:
        yield [full]
        return
    while start < len(full):
        end = _CUT.search(full, start + size) if len(full) - start > size else None
        stop = len(full) if end is None else end.start()
        yield _CUT.split(full[start:stop])
        start = stop


def refine(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Exact byte ends of tokens.  A coarse end counts where the token's span is not empty and does
    not reach into the next one; from the last such place on, decoded byte lengths are summed."""
    sure = end > begin
    sure[:-1] &= end[:-1] <= begin[1:]
    summed = np.cumsum(size)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(size)), -1))
    return summed + np.where(last >= 0, end[last] - summed[last], 0)


def char_starts(text: str) -> np.ndarray | None:
    """Byte place of every character (and of the end); None where it is the character's number."""
    if text.isascii():
        return None
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def encode(tok: Tokenizers, parts: list[str]) -> Iterator[tuple[np.ndarray, ...] | None]:
    """(A ids, A byte ends, B ids, B byte ends) of each part (all begin with a space), None where
    joined bytes differ."""
    for part, a, b in zip(parts, tok.a.encode_batch(parts, add_special_tokens=False),
                          tok.b.encode([p[1:] for p in parts], return_type="proto", num_threads=1)):
        raw = part.encode()
        ids_a = a.ids
        pieces = [(p.id, p.begin, p.end) for p in b.pieces]
        if b"".join([tok.bytes_a[i] for i in ids_a]) != raw or b"".join([tok.bytes_b[p[0]] for p in pieces]) != raw:
            yield None
            continue
        ids_a = np.array(ids_a, dtype=np.int64)
        at = np.fromiter(chain.from_iterable(a.offsets), dtype=np.int64, count=2 * len(ids_a)).reshape(-1, 2)
        starts = char_starts(part)
        if starts is not None:
            at = starts[at]
        spans = np.fromiter(chain.from_iterable(pieces), dtype=np.int64, count=3 * len(pieces)).reshape(-1, 3)
        # B's spans are byte places in the text: one more with the space, which the first token holds
        begin = spans[:, 1] + 1
        begin[0] = 0
        yield (ids_a, refine(at[:, 0], at[:, 1], tok.len_a[ids_a]),
               spans[:, 0], refine(begin, spans[:, 2] + 1, tok.len_b[spans[:, 0]]))


def align(tok: Tokenizers, chunks: list[str], ids_a, ends_a, ids_b, ends_b) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of the chunks of an encoded part: an array of their A tokens, B tokens, groups and links, the
    id pairs of all links in order, and the group texts."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    cuts = np.union1d(ends_a, ends_b)
    # between two neighbouring cuts lies one token of each: one link
    links = ids_a[np.searchsorted(ends_a, cuts)] * len(tok.bytes_b) + ids_b[np.searchsorted(ends_b, cuts)]
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    n_a, n_b, order = len(ids_a), len(ids_b), np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    # A's tokens of a group stand before B's: places by the other side's tokens of earlier groups
    order[np.arange(n_a) + np.searchsorted(group_b, group_a)] = ids_a * 3 + last_a
    order[np.arange(n_b) + np.searchsorted(group_a, group_b, side="right")] = ids_b * 3 + 2 * last_b
    names = [tok.names[k] for k in order.tolist()]
    bounds = np.cumsum([len(c.encode()) for c in chunks])
    upto = np.stack([np.searchsorted(x, bounds, side="right") for x in (ends_a, ends_b, common, cuts)])
    if not np.array_equal(common[upto[2] - 1], bounds):
        raise ValueError("a token reaches over a chunk")
    stops = (upto[0] + upto[1]).tolist()
    texts = ["".join(names[i:j]) for i, j in zip([0, *stops], stops)]
    return np.diff(upto, axis=1, prepend=0).T, links, texts


class Chunks:
    """Aligned chunks by number.  A chunk whose bytes differ has no tokens and is in ``unsound``."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []
        self.unsound: set[int] = set()
        self._sizes: list[np.ndarray] = []
        self._links: list[np.ndarray] = []

    def trim(self, times: np.ndarray) -> None:
        """Hold the bounds of the dictionary: ``times`` says how often a block held each chunk."""
        if len(self.number) <= KEPT_CHUNKS and self.chars <= KEPT_CHARS:
            return
        chunks, texts, unsound, sizes = list(self.number), self.texts, self.unsound, self.sizes()
        kept = np.array([k for k in np.flatnonzero(times > 1).tolist() if k not in unsound], dtype=np.int64)
        links = self.links_of(kept)
        self.clear()
        if len(kept) <= KEPT_CHUNKS and sum([len(chunks[k]) for k in kept.tolist()]) <= KEPT_CHARS:
            self._keep([chunks[k] for k in kept.tolist()], sizes[kept], links, [texts[k] for k in kept.tolist()])

    def sizes(self) -> np.ndarray:
        """A tokens, B tokens, groups and links of each chunk."""
        self._sizes = [np.concatenate([np.empty((0, 4), dtype=np.int64), *self._sizes])]
        return self._sizes[0]

    def links_of(self, chunks) -> np.ndarray:
        """The id pairs of the given chunks, one chunk after the other."""
        self._links = [np.concatenate([np.empty(0, dtype=np.int64), *self._links])]
        n = self.sizes()[:, 3]
        starts, n = (np.cumsum(n) - n)[chunks], n[chunks]
        return self._links[0][np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)]

    def _keep(self, chunks: list[str], sizes: np.ndarray, links: np.ndarray, texts: list[str]) -> None:
        self.number.update(zip(chunks, range(len(self.texts), len(self.texts) + len(chunks))))
        self.chars += sum(map(len, chunks))
        self.texts += texts
        self._sizes.append(sizes)
        self._links.append(links)

    def learn(self, chunks: Iterable[str]) -> None:
        """Unknown chunks that begin with one space and end with another character can follow each
        other in one text; the others are encoded alone."""
        parts, size = [[]], 0
        for c in chunks:
            if self.tok.can_cut and len(c) > 1 and not c[1].isspace() and not c[-1].isspace():
                parts[-1].append(c)
                size += len(c)
                if size >= PART_CHARS:
                    parts.append([])
                    size = 0
            else:
                parts.insert(0, [c])
        parts = [p for p in parts if p]
        for k in range(0, len(parts), 16):
            self._learn(parts[k:k + 16])

    def _learn(self, parts: list[list[str]]) -> None:
        unsound = []
        for part, got in zip(parts, encode(self.tok, ["".join(p) for p in parts])):
            if got is not None:
                self._keep(part, *align(self.tok, part, *got))
            elif len(part) == 1:
                self.unsound.add(len(self.texts))
                self._keep(part, np.zeros((1, 4), dtype=np.int64), np.empty(0, dtype=np.int64), [""])
            else:
                unsound += [[c] for c in part]
        if unsound:
            self._learn(unsound)


class Block:
    """Texts that share one list of chunks and id pairs."""

    def __init__(self, known: Chunks):
        self.known, self.numbers, self.digests, self.pending = known, [], [], []
        self.chars = self.waiting = 0

    def add(self, text: str) -> None:
        self.chars += len(text)
        if len(text) > PIECE_CHARS:
            self.flush()
            self._take(self._learned(cut(text, self.known.tok.can_cut, PIECE_CHARS)))
            return
        self.waiting += len(text)
        self.pending.append(next(cut(text, self.known.tok.can_cut, PIECE_CHARS)) if text else [])
        if self.waiting >= PIECE_CHARS:
            self.flush()

    def _learned(self, pieces: Iterable[list[str]]) -> Iterator[list[str]]:
        for cs in pieces:
            self.known.learn({c: None for c in cs if c not in self.known.number})
            yield cs

    def flush(self) -> None:
        number = self.known.number
        self.known.learn({c: None for cs in self.pending for c in cs if c not in number})
        for cs in self.pending:
            self._take([cs] if cs else [])
        self.pending, self.waiting = [], 0

    def _take(self, pieces: Iterable[list[str]]) -> None:
        known, parts, digest, held, sound = self.known, [], hashlib.sha256(), "", True
        for cs in pieces:
            ks = [known.number[c] for c in cs]
            sound = sound and known.unsound.isdisjoint(ks)
            text = held + "".join([known.texts[k] for k in ks])
            # the last semicolon ends the text and is left out
            digest.update(text[:-1].encode())
            held = text[-1:]
            parts.append(np.array(ks, dtype=np.int64))
        whole = sound and bool(parts)
        self.numbers.append(np.concatenate(parts) if whole else np.empty(0, dtype=np.int64))
        self.digests.append(digest.hexdigest() if whole else "")

    def coded(self) -> tuple[list[list], list[bytes]]:
        """Columns of the text rows (sizes, links, digests and chunk codes), and of the block's list:
        id pairs, their counts, the links of its chunks as places in the pairs, links per chunk."""
        known, lengths = self.known, np.array([len(x) for x in self.numbers])
        every, sizes = np.concatenate(self.numbers), known.sizes()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        sums = [np.concatenate([[0], np.cumsum(x[every])])[ends] for x in sizes.T]
        cols = [np.diff(x).tolist() for x in sums] + [self.digests]
        times = self.times = np.bincount(every, minlength=len(sizes))
        # frequent chunks get small codes, which pack better
        used = np.argsort(-times, kind="stable")[:np.count_nonzero(times)]
        place = np.zeros(len(sizes), dtype="<u4")
        place[used] = np.arange(len(used))
        cols.append([x.tobytes() for x in np.split(place[every], ends[1:-1])])
        if not len(used):
            return cols, []
        n_links = sizes[used, 3]
        pairs, at = np.unique(known.links_of(used), return_inverse=True)
        counts = np.bincount(at, weights=np.repeat(times[used], n_links)).astype("<i8")
        return cols, [pairs.astype("<i8").tobytes(), counts.tobytes(), at.astype("<u4").tobytes(),
                      n_links.astype("<u4").tobytes()]


_TEXT_ROW = [("n_a", "bigint", pa.int64()), ("n_b", "bigint", pa.int64()), ("n_groups", "bigint", pa.int64()),
             ("n_links", "bigint", pa.int64()), ("groups_sha256", "string", pa.string()), ("codes", "binary", pa.binary())]
_LIST_ROW = ["pairs", "counts", "chunk_links", "chunk_sizes"]


def encoded_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per text (``is_list`` false, ``codes``: its chunks as places in the block's list) and
    one per block (``is_list`` true: the list, see ``Block.coded``)."""
    sc = docs.sparkSession.sparkContext
    raw_a, raw_b = sc.broadcast(read_tokenizer(path_a)), sc.broadcast(read_tokenizer(path_b))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"is_list boolean, block bigint, doc_id {id_type}, " + ", ".join(
        [f"{n} {t}" for n, t, _ in _TEXT_ROW] + [f"{n} binary" for n in _LIST_ROW])
    names = ["is_list", "block", "doc_id", *[x[0] for x in _TEXT_ROW], *_LIST_ROW]

    def run(batches):
        known = Chunks(tokenizers_of(raw_a.value, raw_b.value))
        block, ids, number = Block(known), [], TaskContext.get().partitionId() << 32

        def rows(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            block.flush()
            cols, listed = block.coded()
            n = len(block.digests)
            start = [pa.array([False] * n), pa.array([number] * n, pa.int64()), pa.chunked_array(ids, id_type).combine_chunks()]
            yield pa.RecordBatch.from_arrays(start + [pa.array(c, x[2]) for c, x in zip(cols, _TEXT_ROW)] +
                                             [pa.nulls(n, pa.binary())] * len(_LIST_ROW), names)
            if listed:
                start = [pa.array([True]), pa.array([number], pa.int64()), pa.nulls(1, id_type)]
                yield pa.RecordBatch.from_arrays(start + [pa.nulls(1, x[2]) for x in _TEXT_ROW] +
                                                 [pa.array([x], pa.binary()) for x in listed], names)
            known.trim(block.times)

        for batch in batches:
            kind, start = batch.schema[0].type, 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                block.add(text)
                if block.chars >= block_chars:
                    ids.append(batch.column(0).slice(start, k + 1 - start))
                    start = k + 1
                    yield from rows(kind)
                    block, ids, number = Block(known), [], number + 1
            if start < batch.num_rows:
                ids.append(batch.column(0).slice(start))
        if ids:
            yield from rows(kind)

    texts = docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    return texts.mapInArrow(run, schema)


def _listed(batches):
    """Lists of id pairs -> one row per pair of a block."""
    for batch in batches:
        for block, pairs, counts in zip(*[c.to_pylist() for c in batch.columns]):
            p, n = np.frombuffer(pairs, dtype="<i8"), np.frombuffer(counts, dtype="<i8")
            for k in range(0, len(p), 100_000):
                m = len(p[k:k + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, block)), pa.array(np.arange(k, k + m, dtype=np.int32)), pa.array(p[k:k + m]), pa.array(n[k:k + m])],
                    ["block", "code", "pair", "n"])


def _summed(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Corpus counts of a block's pairs, summed over the links of its chunks, then over the chunks of
    its texts."""
    total = best = np.zeros(0, dtype=np.int64)
    for one in rows.filter(rows["is_list"]).select(["chunk_links", "chunk_sizes"]).to_pylist():
        code = pairs["code"].to_numpy()
        links, sizes = np.frombuffer(one["chunk_links"], dtype="<u4"), np.frombuffer(one["chunk_sizes"], dtype="<u4")
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        of_pair = np.empty(pairs.num_rows, dtype=np.int64)
        of_pair[code] = pairs["total"].to_numpy()
        total = np.add.reduceat(of_pair[links], starts)
        of_pair[code] = pairs["is_best"].to_numpy()
        best = np.add.reduceat(of_pair[links], starts)
    texts = rows.filter(pc.invert(rows["is_list"]))
    sums = []
    for codes in texts["codes"].to_pylist():
        c = np.frombuffer(codes, dtype="<u4")
        sums.append((int(best[c].sum()), int(total[c].sum())))
    out = texts.drop_columns(["is_list", "block", "codes", "chunk_links", "chunk_sizes"])
    return out.append_column("n_best", pa.array([x[0] for x in sums], pa.int64())) \
              .append_column("count_sum", pa.array([x[1] for x in sums], pa.int64()))


def pair_counts(listed: DataFrame, size_b: int) -> DataFrame:
    """``pair``, ``total`` (links of the corpus that hold it) and ``is_best`` (1 where no pair with
    the same B id has more).  The table of best counts has one row per B id at most: its size is
    bounded by the vocabulary, so it is broadcast."""
    totals = staged(listed.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    b = F.col("pair") % size_b
    best = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return totals.withColumn("b", b).join(F.broadcast(best), "b").select(
        "pair", "total", (F.col("total") == F.col("most")).cast("int").alias("is_best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                     block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per text: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256``."""
    spark = docs.sparkSession
    blocks = staged(encoded_blocks(docs, path_a, path_b, id_col, text_col, block_chars), "aligned")
    size_b = _size_b(path_b)
    listed = blocks.filter("is_list").select("block", "pairs", "counts").mapInArrow(
        _listed, "block bigint, code int, pair bigint, n bigint")
    pairs = listed.join(pair_counts(listed, size_b), "pair").select("block", "code", "total", "is_best")
    rows = blocks.drop("pairs", "counts")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "n_best bigint, count_sum bigint")
    out = rows.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(_summed, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _size_b(path: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=read_tokenizer(path)).get_piece_size()


def paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), *paths())
