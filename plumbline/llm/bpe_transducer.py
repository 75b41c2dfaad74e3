"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

*Lexicon.* The most frequent words of the corpus (counted over all documents, before any is dropped from the list) are
encoded once and compiled into a minimal acyclic automaton: equal suffixes share states. Every transition carries a
number; the numbers along a word's path add up to the word's rank in sorted order, and the rank points to its ids. The
arrays are written to one file, which Spark hands to every executor and each worker memory-maps.

*Encoding.* A text is cut at special strings, then into words by the tokenizer's pattern. Words in the lexicon take
their ids from the transducer, all words of a batch walking it at once. Unseen words are merged exactly: all words of
one byte length form a matrix, and each step joins, in every row, the leftmost pair of the lowest rank. Very long words
go through a heap instead. Results are remembered per worker, up to ``MEMO`` words.

*Decoding* joins the bytes of the ids and reads them as UTF-8, with replacement where they are none.

Null and empty texts encode to no ids. Texts of any length are fine; a word (say, 100 kB of one letter) takes time
n log n. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.groups import lean
from plumbline.llm.scratch import Scratch

MEMO = 400_000
#: Words longer than this many bytes are merged by the heap.
MATRIX_MAX = 64
LEXICON_WORDS = 65_536
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY = regex.compile(PATTERN)
#: The same pattern for texts whose characters all are ASCII or Latin letters, where ``re`` agrees and is faster.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*")
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary, merge ranks and special strings of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, ranks, joins = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            keys.append(vocab[a] << 32 | vocab[b])
            ranks.append(rank)
            joins.append(vocab[a + b])
        self.pair_rank = dict(zip(keys, ranks, strict=True))
        self.join_of = np.array(joins, dtype=np.int32)
        self._hash(np.array(keys, dtype=np.uint64), np.array(ranks, dtype=np.int32))
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of the pairs; ``probes`` is the longest run of taken slots."""
        self.bits = max(16, int(len(keys) * 8 - 1).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, _NONE, dtype=np.int32)
        self.probes = 1
        for k, s, r in zip(keys.tolist(), self._slot(keys).tolist(), ranks.tolist(), strict=True):
            n = 1
            while self.keys[s] != np.uint64(2**64 - 1):
                s, n = (s + 1) & ((1 << self.bits) - 1), n + 1
            self.keys[s], self.ranks[s], self.probes = k, r, max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], _NONE)
        open_ = np.nonzero((out == _NONE) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(open_[0]):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[open_]]
            found = hit == keys[open_]
            got = tuple(x[found] for x in open_)
            out[got] = self.ranks[slot[got]]
            open_ = tuple(x[~found & (hit != np.uint64(2**64 - 1))] for x in open_)
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, merged exactly from its bytes."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            if n > MATRIX_MAX:
                for i in at:
                    out[i] = self._merge_long(words[i])
            elif n:
                self._merge_matrix(np.frombuffer(b"".join([words[i] for i in at]), dtype=np.uint8).reshape(len(at), n), np.array(at), out)
        return out

    def _merge_matrix(self, chars: np.ndarray, at: np.ndarray, out: list[list[int]]) -> None:
        ids = self.byte_ids[chars]
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(at):
            width = ids.shape[1]
            if width == 1:
                done = np.ones(len(at), dtype=bool)
            else:
                best = ranks.argmin(axis=1)
                rows = np.arange(len(at))
                low = ranks[rows, best]
                done = low == _NONE
            if done.any():
                for i, row in zip(at[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = row
                if done.all():
                    return
                keep = ~done
                ids, ranks, at, best, low = ids[keep], ranks[keep], at[keep], best[keep], low[keep]
                rows = np.arange(len(at))
            take = np.arange(width - 1)[None, :]
            take = take + (take > best[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            ids[rows, best] = self.join_of[low]
            if width > 2:
                ranks = _without(ranks, best)
                left = np.nonzero(best > 0)[0]
                ranks[left, best[left] - 1] = self.rank(ids[left, best[left] - 1], ids[left, best[left]])
                right = np.nonzero(best < width - 2)[0]
                ranks[right, best[right]] = self.rank(ids[right, best[right]], ids[right, best[right] + 1])

    def _merge_long(self, word: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pair_rank
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.join_of[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (s := rank.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        return (_LATIN if _PLAIN.fullmatch(text) else _ANY).findall(text)

    def parts(self, text: str) -> list[str]:
        """Words and special strings in order; a special string is kept whole."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for piece in self.cut.split(text):
            out += [piece] if piece in self.special else self.words(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def _without(m: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Each row of m without one element."""
    keep = np.ones(m.shape, dtype=bool)
    keep[np.arange(len(m)), column] = False
    return m[keep].reshape(len(m), m.shape[1] - 1)


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of distinct sorted words, each transition with the ranks that it skips.

    Arrays: ``key`` (state << 8 | byte, sorted), ``to`` and ``skip`` by transition, ``final`` by state. State 0 is the
    start; a word's rank is the sum of its transitions' ``skip``.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def frozen(node: list) -> int:
        sig = (node[0], tuple(node[1]))
        if sig not in register:
            register[sig] = len(states)
            states.append(sig)
        return register[sig]

    path: list[list] = [[False, []]]
    last = b""
    for w in words:
        common = len(os.path.commonprefix([last, w]))
        for depth in range(len(last), common, -1):
            node = path.pop()
            path[-1][1].append((last[depth - 1], frozen(node)))
        for _ in range(common, len(w)):
            path.append([False, []])
        path[-1][0] = True
        last = w
    for depth in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1].append((last[depth - 1], frozen(node)))
    root = frozen(path[0])
    below = [0] * len(states)  # words that end at or below a state; targets come before their sources
    key, to, skip = [], [], []
    renumber = lambda s: 0 if s == root else s + 1
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, target in arcs:
            key.append(renumber(s) << 8 | byte)
            to.append(renumber(target))
            skip.append(n)
            n += below[target]
        below[s] = n
    order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
    final_ = np.zeros(len(states) + 1, dtype=np.uint8)
    for s, (final, _) in enumerate(states):
        final_[renumber(s)] = final
    pick = lambda x: np.array(x, dtype=np.int64)[order]
    return {"key": pick(key), "to": pick(to), "skip": pick(skip), "final": final_}


_FIELDS = ("key", "to", "skip", "final", "offset", "ids")


def write_lexicon(path: str, words: list[bytes], bpe: ByteBpe) -> None:
    """One file: a JSON line with the arrays' places, then the arrays, aligned to 64 bytes."""
    words = sorted(set(words) - {b""})
    arrays = build_automaton(words)
    ids = bpe.merge(words)
    arrays["offset"] = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    arrays["ids"] = np.array([x for w in ids for x in w], dtype=np.int64)
    head, at = {}, 4096
    for f in _FIELDS:
        head[f] = [str(arrays[f].dtype), at, len(arrays[f])]
        at += -(-arrays[f].nbytes // 64) * 64
    with open(path, "wb") as out:
        out.write(json.dumps(head).encode().ljust(4096))
        for f in _FIELDS:
            out.seek(head[f][1])
            out.write(arrays[f].tobytes())
        out.truncate(max(at, 4096))


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = json.loads(f.read(4096))
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        for f in _FIELDS:
            kind, at, n = head[f]
            setattr(self, f, whole[at : at + n * np.dtype(kind).itemsize].view(kind))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, or -1; all words step along the automaton together."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        chars = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.cumsum(lengths) - lengths
        state, rank = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        alive, step = np.flatnonzero(lengths > 0), 0
        rank[lengths == 0] = -1
        while len(alive):
            want = state[alive] << 8 | chars[first[alive] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1) if len(self.key) else np.zeros(len(alive), dtype=np.int64)
            ok = self.key[at] == want if len(self.key) else np.zeros(len(alive), dtype=bool)
            rank[alive[~ok]] = -1
            alive, at = alive[ok], at[ok]
            state[alive] = self.to[at]
            rank[alive] += self.skip[at]
            step += 1
            ends = lengths[alive] == step
            over = alive[ends]
            rank[over[self.final[state[over]] == 0]] = -1
            alive = alive[~ends]
        return rank

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.offset[rank] : self.offset[rank + 1]].tolist()


class Encoder:
    """Encoding and decoding with a lexicon before the merges and a memory of words behind both."""

    def __init__(self, bpe: ByteBpe, lexicon: Lexicon | None = None):
        self.bpe, self.lexicon = bpe, lexicon
        self.known: dict[str, str] = {}
        self.text_of: dict[str, bytes] = {}

    def ids_of(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(words)
        rest = list(range(len(words)))
        if self.lexicon is not None and words:
            ranks = self.lexicon.ranks(raw).tolist()
            rest = []
            for i, r in enumerate(ranks):
                if r >= 0:
                    out[i] = self.lexicon.ids_of(r)
                else:
                    rest.append(i)
        for i, ids in zip(rest, self.bpe.merge([raw[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > MEMO:
            self.known.clear()
            self.text_of.clear()
        new = [w for w in words if w not in self.known]
        for w in [w for w in new if w in self.bpe.special]:
            self.known[w] = str(self.bpe.special[w])
        plain = [w for w in new if w not in self.bpe.special]
        for w, ids in zip(plain, self.ids_of(plain), strict=True):
            self.known[w] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[list[str]]:
        """For each text its words' ids, each word's ids joined by commas."""
        parts = [self.bpe.parts(t) if t else [] for t in texts]
        self.learn(set().union(*parts))
        known = self.known
        return [[known[w] for w in p] for p in parts]

    def decode(self, coded: list[str]) -> bytes:
        """UTF-8 bytes of a text from what ``encode`` gives, by the ids alone."""
        try:
            return b"".join(map(self.text_of.__getitem__, coded))
        except KeyError:
            table = self.bpe.bytes_of
            for c in set(coded):
                if c not in self.text_of:
                    self.text_of[c] = b"".join([table[int(i)] for i in c.split(",")])
            return b"".join(map(self.text_of.__getitem__, coded))


_encoders: dict[tuple, Encoder] = {}


def encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    key = (tokenizer, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ByteBpe(tokenizer), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[key]


def frequent_words(docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """(word, n): the most frequent pattern words, ``most`` at most, counted over all whole texts.

    All words from a count on are taken (counts stand in eighths of powers of two), the least such count with which they
    are no more than ``most``; so nothing is sorted, and the driver gets these words only. Each batch hands over the words it holds twice or more, with their counts there; what a batch holds once is left
    out of the sums. The list only decides which words are compiled, never what ids come out.
    """

    def run(batches):
        import collections

        for batch in batches:
            counts: collections.Counter = collections.Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(t.split(" "))
            kept = [(" " + w, n) for w, n in counts.items() if n > 1 and w and len(w) <= 32 and w.isalpha()]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    counted = docs.select(text_col).mapInArrow(lean(run), "word string, n long")
    level = F.floor(F.log2("n") * 8).cast("int")
    words = Scratch(docs.sparkSession, "words").table(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", level), "words")
    held, least = 0, None
    for r in words.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # a few hundred rows
        held += r.n
        if held > most:
            break
        least = r.level
    return words.where(F.col("level") >= (least if least is not None else 1 << 30)).select("word", "n")


def compile_lexicon(spark: SparkSession, docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compile the corpus's frequent words and hand the file to all executors; its name there is returned."""
    words = sorted(r.word.encode() for r in frequent_words(docs, text_col, most).collect())  # at most ``most`` words
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.fst")
        write_lexicon(path, words, ByteBpe(tokenizer))
        kept = os.path.join(tempfile.gettempdir(), os.path.basename(path))
        os.replace(path, kept)
    spark.sparkContext.addFile(kept)
    return os.path.basename(kept)


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text."""

    def run(batches):
        enc = encoder(tokenizer, lexicon)
        for batch in batches:
            coded = enc.encode(batch.column(1).to_pylist())
            ids = [[int(x) for c in words for x in c.split(",")] for words in coded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, ids array<int>")


def decode_documents(coded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded documents; null ids count as none."""

    def run(batches):
        bpe = encoder(tokenizer, None).bpe
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode its ids again, digest both."""

    def run(batches):
        enc = encoder(tokenizer, lexicon)
        for batch in batches:
            n_tokens, of_ids, of_text = [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = held = 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= slice_bytes or i + 1 == len(texts):
                    for words in enc.encode(texts[start : i + 1]):
                        line = ",".join(words)
                        n_tokens.append(line.count(",") + 1 if line else 0)
                        of_ids.append(hashlib.sha256(line.encode()).hexdigest())
                        of_text.append(hashlib.sha256(enc.decode(words)).hexdigest())
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
