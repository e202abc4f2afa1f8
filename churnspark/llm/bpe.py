"""Operator 4: BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into words as the tokenizer file says; each word starts as one symbol a byte.
Leaf i of the segment tree holds the rank of the pair (symbol i, next live symbol), packed
with i, and every node the smaller of its children: the root is the leftmost pair of lowest
rank.  A merge changes three leaves, each a logarithmic path to the root, and merging ends
when the root holds no rank.

Words of one length class are merged side by side: row w of a two-dimensional array is the
tree of word w.  A word longer than ``WIDE`` symbols has a tree of its own.  Encoded words are
kept in a dictionary of bounded size (a word that is missing is just encoded again).

Null texts count as empty: no ids, empty decoded text.  Special tokens in a text are their
own ids, as in the tokenizers library.  Rows are independent of each other, so ties and
repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from churnspark.llm._shared import col, table, text_or_empty

WIDE = 256
#: Words kept by a task; beyond it the dictionary starts anew.
KEPT_WORDS = 200_000
#: Words whose number of tokens a worker process keeps, for all its tasks.
KEPT_LENGTHS = 1_000_000
#: Characters of text that are worked on together.
CHUNK_CHARS = 2_000_000
NONE = np.iinfo(np.int64).max

#: Below this code point the own splitting and the tokenizers library use equal Unicode tables.
_UNSURE = re.compile("[^\x00-՗]")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _ascii_form(pattern: str) -> re.Pattern | None:
    """The splitting pattern for lower-case ASCII texts, where the standard engine is faster; None
    if it names other classes than letters, numbers and white space."""
    for name, chars in ((r"[\p{L}]", "[a-z]"), (r"[\p{N}]", "[0-9]"), (r"\p{L}", "a-z"), (r"\p{N}", "0-9"), (r"\s", r"\t-\r ")):
        pattern = pattern.replace(name, chars)
    return None if re.search(r"\\[a-zA-Z]", pattern.replace(r"\t-\r", "")) else re.compile(pattern)


class Vocabulary:
    """Symbols, merges and splitting rules of a tokenizer file (BPE on words with word ends)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.raw = raw
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in (self.ids | self.special).items()}
        end = model["end_of_word_suffix"]
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in alphabet.items()}
        self.inner = np.array([self.ids[alphabet[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([self.ids[alphabet[b] + end] for b in range(256)], dtype=np.int64)
        self.base = max(self.tokens) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.ids[a] * self.base + self.ids[b] for a, b in merges], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int64), made
        self.rank_of = dict(zip(keys.tolist(), range(len(merges))))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.ascii_word = _ascii_form(split["pattern"]["Regex"])
        marks = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.mark = re.compile(f"({'|'.join(marks)})") if marks else None
        self._library = None

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if self.ascii_word is not None and text.isascii():
            return self.ascii_word.findall(text.lower())
        if _UNSURE.search(text):
            return self._words_by_library(text)
        if not text.isascii():
            # the library lowers each character by itself, without the rule for a final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def _words_by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_str(self.raw.decode())
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    def parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """(is special, words) in order of the text."""
        if self.mark is None or not self.mark.search(text):
            return [(False, self.words(text))]
        out = []
        for k, piece in enumerate(self.mark.split(text)):
            if piece:
                out.append((True, [piece]) if k % 2 else (False, self.words(piece)))
        return out

    def symbols(self, word: str) -> np.ndarray:
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        out = self.inner[raw]
        out[-1] = self.last[raw[-1]]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair has none."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def merge_many(vocab: Vocabulary, words: list[np.ndarray]) -> list[np.ndarray]:
    """Merge words of at most ``size`` symbols side by side, ``size`` the power of two that
    holds the longest."""
    size = max(2, 1 << (max(map(len, words)) - 1).bit_length())
    n = len(words)
    lengths = np.array([len(w) for w in words])
    inside = np.arange(size) < lengths[:, None]
    sym = np.full((n, size + 1), -1, dtype=np.int64)
    sym[:, :size][inside] = np.concatenate(words)
    nxt = np.tile(np.arange(1, size + 2), (n, 1))
    nxt[np.arange(size + 1) >= lengths[:, None] - 1] = size
    prv = np.tile(np.arange(-1, size), (n, 1))
    tree = np.full((n, 2 * size), NONE, dtype=np.int64)
    rank = vocab.ranks(sym[:, :size], sym[:, 1:])
    live = (rank >= 0) & inside & (sym[:, 1:] >= 0)
    tree[:, size:] = np.where(live, rank * size + np.arange(size), NONE)
    for v in range(size - 1, 0, -1):
        tree[:, v] = np.minimum(tree[:, 2 * v], tree[:, 2 * v + 1])

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        v = leaf + size
        tree[rows, v] = value
        for _ in range(size.bit_length() - 1):
            v = v >> 1
            tree[rows, v] = np.minimum(tree[rows, 2 * v], tree[rows, 2 * v + 1])

    def pair(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        r = vocab.ranks(sym[rows, i], sym[rows, j])
        return np.where((r >= 0) & (j < size), r * size + i, NONE)

    rows = np.arange(n)
    while len(rows := rows[tree[rows, 1] < NONE]):
        root = tree[rows, 1]
        i = root % size
        j = nxt[rows, i]
        k = nxt[rows, j]
        sym[rows, i] = vocab.made[root // size]
        sym[rows, j] = -1
        nxt[rows, i] = k
        prv[rows, k] = i
        put(rows, j, np.full(len(rows), NONE))
        put(rows, i, pair(rows, i, k))
        before = prv[rows, i]
        has = before >= 0
        put(rows[has], before[has], pair(rows[has], before[has], i[has]))
    kept = sym[:, :size] >= 0
    return np.split(sym[:, :size][kept], np.cumsum(kept.sum(axis=1))[:-1])


def merge_long(vocab: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """The same merging for one long word, with its tree in a list."""
    sym = symbols.tolist()
    n = len(sym)
    size = 1 << (n - 1).bit_length()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    first = vocab.ranks(symbols[:-1], symbols[1:])
    leaves = np.where(first >= 0, first * size + np.arange(n - 1), NONE)
    tree = np.full(2 * size, NONE, dtype=np.int64)
    tree[size:size + n - 1] = leaves
    at = size
    while at > 1:
        tree[at // 2:at] = np.minimum(tree[at:2 * at:2], tree[at + 1:2 * at:2])
        at //= 2
    tree = tree.tolist()
    base, rank_of, none = vocab.base, vocab.rank_of, int(NONE)

    def put(leaf: int, value: int) -> None:
        v = leaf + size
        tree[v] = value
        while v > 1:
            low = min(tree[v], tree[v ^ 1])
            v >>= 1
            if tree[v] == low:
                break
            tree[v] = low

    def pair(i: int, j: int) -> int:
        r = rank_of.get(sym[i] * base + sym[j]) if j < n else None
        return none if r is None else r * size + i

    while tree[1] < none:
        r, i = divmod(tree[1], size)
        j = nxt[i]
        k = nxt[j]
        sym[i], sym[j] = int(vocab.made[r]), -1
        nxt[i] = k
        if k < n:
            prv[k] = i
        put(j, none)
        put(i, pair(i, k))
        if prv[i] >= 0:
            put(prv[i], pair(prv[i], i))
    return np.array([s for s in sym if s >= 0], dtype=np.int64)


class Encoder:
    """Word by word encoding with a bounded dictionary of (id bytes, decoded text)."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, tuple[bytes, str]] = {}

    def learn(self, words: Iterable[str]) -> None:
        v = self.vocab
        by_size: dict[int, list[str]] = {}
        long = []
        for w in words:
            size = len(w.encode())
            (long if size > WIDE else by_size.setdefault(max(1, (size - 1).bit_length()), [])).append(w)
        for w in long:
            self._keep(w, merge_long(v, v.symbols(w)))
        for group in by_size.values():
            for k in range(0, len(group), 20_000):
                part = group[k:k + 20_000]
                for w, ids in zip(part, merge_many(v, [v.symbols(w) for w in part])):
                    self._keep(w, ids)

    def _keep(self, word: str, ids: np.ndarray) -> None:
        tokens = self.vocab.tokens
        self.known[word] = (ids.astype("<u4").tobytes(), " ".join([tokens[i] for i in ids.tolist()]))

    def encode(self, texts: list[str]) -> Iterator[list[tuple[bytes, str]]]:
        """Per text, the (id bytes, decoded text) of its words in order."""
        v = self.vocab
        cut = [v.parts(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        self.learn({w for parts in cut for special, ws in parts if not special for w in ws if w not in known})
        for parts in cut:
            out = []
            for special, ws in parts:
                if special:
                    out += [(int(v.special[w]).to_bytes(4, "little"), w) for w in ws]
                else:
                    out += [known[w] for w in ws]
            yield out
        for w in [w for w in known if len(w) > WIDE]:
            del known[w]


class Lengths(Encoder):
    """Numbers of tokens, from a dictionary of words to theirs."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab)
        self.known: dict[str, int] = {}

    def _keep(self, word: str, ids: np.ndarray) -> None:
        self.known[word] = len(ids)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.vocab.parts(t) for t in texts]
        if len(self.known) > KEPT_LENGTHS:
            self.known.clear()
        words = set(chain.from_iterable([ws for parts in cut for special, ws in parts if not special]))
        new = words.difference(self.known)
        self.learn(new)
        of = self.known.__getitem__
        out = [sum([len(ws) if special else sum(map(of, ws)) for special, ws in parts]) for parts in cut]
        for w in new:
            if len(w) > WIDE:
                del self.known[w]
        return out


@lru_cache(maxsize=1)
def lengths_of(raw: bytes) -> Lengths:
    """One dictionary a worker process: tasks that follow each other in it share what it knows."""
    return Lengths(vocabulary(raw))


def decode(vocab: Vocabulary, ids: bytes) -> str:
    """Ids (little-endian unsigned 32-bit) -> text; the tokenizer file names no decoder, so the
    tokens are joined by spaces, special tokens included."""
    return " ".join([vocab.tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``CHUNK_CHARS`` characters; a text is never cut."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, texts[start:k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def read_tokenizer(path: str) -> bytes:
    """The tokenizer file, read by the driver; a vocabulary file has a fixed size (about 2 MB)
    and is sent to the executors whole."""
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, id_col: str, text_col: str, path: str, per_text, schema: str, arrow: pa.Schema) -> DataFrame:
    raw = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        enc = Encoder(vocabulary(raw.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for _, part in chunks(texts):
                rows += [per_text(words) for words in enc.encode(part)]
            cols = [batch.column(0), *(pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), list(arrow)[1:]))]
            if rows:
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(arrow[0].name, batch.schema[0].type), *list(arrow)[1:]]))

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).mapInArrow(
        run, f"doc_id {key}, {schema}")


def _digests(words: list[tuple[bytes, str]]) -> tuple[int, str, str]:
    ids = b"".join([w[0] for w in words])
    text = " ".join([w[1] for w in words])
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _full(words: list[tuple[bytes, str]]) -> tuple[list[int], str]:
    return np.frombuffer(b"".join([w[0] for w in words]), dtype="<u4").tolist(), " ".join([w[1] for w in words])


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` of every whole text."""
    return _mapped(docs, id_col, text_col, path, _full, "ids array<int>, decoded string", pa.schema(
        [pa.field("doc_id", pa.int64()), pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of ids and decoded text."""
    return _mapped(docs, id_col, text_col, path, _digests,
                   "n_tokens bigint, ids_sha256 string, decoded_sha256 string", pa.schema(
                       [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()),
                        pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]))


def encoded_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``n_tokens``: every text is split and its words' numbers of tokens are summed."""
    raw = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        known = lengths_of(raw.value)
        for batch in batches:
            n = [x for _, part in chunks(batch.column(1).to_pylist()) for x in known.count(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).mapInArrow(
        run, f"doc_id {key}, n_tokens bigint")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())
