"""Removal of long byte strings that occur earlier in the corpus.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier (in a document of smaller id, or
at a smaller place of the same one). Strings are judged on the input and never cross documents.

1. Every string of ``length`` bytes has one *anchor*, the leftmost of its smallest q-grams by hash. Consecutive strings
   with the same anchor form a segment of at most length - q + 1 strings. Equal strings have equal anchors, so strings
   can only be equal within one anchor's hash. A segment travels as a row: anchor hash, fingerprint of its bytes, place.
2. Of segments with the same fingerprint all but the first go as a whole. A batch keeps only its own first ones under
   their anchor, so a passage that a third of all documents share sends one row a batch, not one a document.
3. Where different segments share an anchor (the edges of repeats), their bytes are brought together by anchor and
   suffix-sorted by induction (``suffix_sort``); equal strings stand next to each other, and all but the first go.
4. Each document's spans are merged and cut out.

Null and empty texts, and those shorter than ``length``, lose nothing. Rows without an id come before all others; rows
that repeat an id are documents of their own, in order of their texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bytescan import BYTE_VALUE, as_bytes, groups_by_bytes, mix, powers
from plumbline.llm.groups import grouped, lean, sorted_groups
from plumbline.llm.scratch import Scratch
from plumbline.llm.suffix_sort import equal_neighbours, suffix_order

LENGTH, GRAM = 100, 40
#: Low bits of a packed minimum that hold the place in a chunk.
_PLACE_BITS = 21
_CHUNK = 1 << 20
_FIRST_ID = -(1 << 63)
#: No byte of UTF-8 text.
_BETWEEN = b"\xff"


def segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first string, last string, anchor hash, fingerprint) of the segments of documents buf[start:end]."""
    n, grams = len(buf), length - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    power, inverse = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[buf] * power[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= grams:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if grams > size:
        least = np.minimum(least[: size - grams], least[grams - size :])
    anchor = (least & low).astype(np.int64)
    step = np.zeros(len(anchor) + 1, dtype=np.int64)
    long = ends - starts >= length
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(step)[:-1] > 0)
    if not len(s):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    a = anchor[s]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    first, last, at = s[np.concatenate([[0], cut])], s[np.concatenate([cut, [len(s)]]) - 1], a[np.concatenate([[0], cut])]
    shape = ((at - first) << 16 | (last - first)).astype(np.uint64)
    return first, last, h[at], mix((sums[last + length] - sums[first]) * inverse[first] ^ mix(shape))


def document_segments(texts: list[bytes], length: int, gram: int):
    """(text number, first string, strings, anchor hash, fingerprint) arrays over all texts, in order."""
    out: list[tuple] = []
    for a, b in groups_by_bytes(texts, _CHUNK):
        if b == a + 1 and len(texts[a]) > _CHUNK:  # a long text goes by overlapping pieces
            for at in range(0, len(texts[a]) - length + 1, _CHUNK):
                buf = np.frombuffer(texts[a], dtype=np.uint8)[at : at + _CHUNK + length - 1]
                first, last, key, fp = segments(buf, np.array([0]), np.array([len(buf)]), length, gram)
                out.append((np.full(len(first), a), first + at, last - first + 1, key, fp))
            continue
        buf = np.frombuffer(b"\n".join(texts[a:b]), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts[a:b]])
        starts = np.cumsum(sizes + 1) - sizes - 1
        first, last, key, fp = segments(buf, starts, starts + sizes, length, gram)
        own = np.searchsorted(starts, first, side="right") - 1
        out.append((own + a, first - starts[own], last - first + 1, key, fp))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, copy, doc_id, text): ``copy`` tells apart rows that repeat an id."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID))
    rows = docs.select(ident.alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows.withColumn("copy", F.lit(0))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1)


def segment_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, fp, doc, copy, at, n, again): segments; ``again`` if the batch has an equal one before."""

    def run(batches):
        for batch in batches:
            doc, copy = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = as_bytes(batch.column(2))
            order = np.lexsort((copy, doc))
            own, at, n, key, fp = document_segments([texts[i] for i in order], length, gram)
            if not len(own):
                continue
            both = mix(key ^ (fp * np.uint64(0x9E3779B97F4A7C15)))
            by = np.argsort(both, kind="stable")
            again = np.zeros(len(own), dtype=bool)
            again[by[1:]] = both[by[1:]] == both[by[:-1]]
            row = order[own]
            key = np.where(again, mix(doc[row].view(np.uint64) + (at.astype(np.uint64) << np.uint64(32))), key)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), fp.view(np.int64), doc[row], copy[row].astype(np.int32), at.astype(np.int32), n.astype(np.int32), again)], names=["key", "fp", "doc", "copy", "at", "n", "again"])

    return rows.select("doc", "copy", "text").mapInArrow(lean(run), "key long, fp long, doc long, copy int, at int, n int, again boolean")


def judged(found: DataFrame) -> DataFrame:
    """Segments that go as a whole (``whole``), and those whose strings must be compared."""
    by = Window.partitionBy("key").orderBy("fp", "doc", "copy", "at")
    all_ = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = found.withColumn("repeat", F.coalesce(F.lag("fp").over(by) == F.col("fp"), F.lit(False)) | F.col("again")).withColumn("mixed", F.min("fp").over(all_) != F.max("fp").over(all_))
    return seen.where("repeat or mixed").select("key", "doc", "copy", "at", "n", F.col("repeat").alias("whole"))


def pieces(rows: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """(key, doc, copy, at, piece): the bytes of segments."""
    listed = edges.groupBy("doc", "copy").agg(F.collect_list(F.struct("key", "at", "n")).alias("parts"))

    def run(batches):
        for batch in batches:
            doc, copy, parts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(3)
            flat = parts.flatten()
            own = np.repeat(np.arange(len(doc)), pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False))
            key, at, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = as_bytes(batch.column(2))
            cut = [texts[o][a : a + m + length - 1] for o, a, m in zip(own.tolist(), at.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[own]), pa.array(copy[own].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(cut, pa.binary())], names=["key", "doc", "copy", "at", "piece"])

    joined = rows.join(listed, ["doc", "copy"]).select("doc", "copy", "text", "parts")
    return joined.mapInArrow(lean(run), "key long, doc long, copy int, at int, piece binary")


def repeated_strings(cut: DataFrame, length: int) -> DataFrame:
    """(doc, copy, at, n): runs of strings within pieces of one key that occur earlier, by suffix sorting."""

    def run(batches):
        for keys, (doc, copy, at, piece) in grouped(batches, 1):
            doc, copy, at = (x.to_numpy(zero_copy_only=False) for x in (doc, copy, at))
            data = piece.to_pylist()
            sizes = np.array([len(p) for p in data])
            text = np.frombuffer(_BETWEEN.join(data) + _BETWEEN * 8, dtype=np.uint8)
            starts = np.cumsum(sizes + 1) - sizes - 1
            own = np.repeat(np.arange(len(data)), sizes - length + 1)
            pos = np.arange(len(own)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1) + starts[own]
            string = np.full(len(text), -1, dtype=np.int64)
            string[pos] = np.arange(len(pos))
            order = suffix_order(text, length)
            order = order[string[order] >= 0]
            same = equal_neighbours(text, order, length)
            _, doc_rank = np.unique(np.rec.fromarrays([doc, copy]), return_inverse=True)
            o = string[order]
            place = doc_rank[own[o]].astype(np.int64) << 32 | (at[own[o]] + pos[o] - starts[own[o]])
            head = np.flatnonzero(~same)
            least = np.repeat(np.minimum.reduceat(place, head), np.diff([*head, len(place)]))
            again = np.zeros(len(own), dtype=bool)
            again[o] = place != least
            w = np.flatnonzero(again)
            if not len(w):
                continue
            cut_ = np.flatnonzero((w[1:] != w[:-1] + 1) | (own[w[1:]] != own[w[:-1]])) + 1
            a, b = w[np.concatenate([[0], cut_])], w[np.concatenate([cut_, [len(w)]]) - 1]
            p = own[a]
            yield pa.RecordBatch.from_arrays([pa.array(doc[p]), pa.array(copy[p]), pa.array((at[p] + pos[a] - starts[p]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))], names=["doc", "copy", "at", "n"])

    return sorted_groups(cut.select("key", "doc", "copy", "at", "piece"), ["key"]).mapInArrow(lean(run), "doc long, copy int, at int, n int")


def removed_spans(size: int, at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that strings ``at`` to ``at + n - 1`` cover."""
    step = np.zeros(size + 1, dtype=np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + n + length - 1, -1)
    gone = np.zeros(size + 2, dtype=np.int8)
    gone[1:-1] = np.cumsum(step)[:-1] > 0
    edge = np.diff(gone)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc, copy, doc_id, text) of all rows, and (doc, copy, at, n) of the strings to remove."""
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    rows = numbered(docs, id_col, text_col)
    marked = scratch.table(judged(segment_rows(rows, length, gram)), "judged")
    inner = scratch.table(repeated_strings(pieces(rows, marked.where("not whole"), length), length), "edges")
    return rows, marked.where("whole").select("doc", "copy", "at", "n").unionByName(inner)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and what is kept (``kept`` binary) if asked."""
    rows, strings = repeats(docs, length, gram, id_col, text_col, scratch)
    listed = strings.groupBy("doc", "copy").agg(F.collect_list(F.struct("at", "n")).alias("gone"))

    def run(batches):
        for batch in batches:
            texts, gone = as_bytes(batch.column(1)), batch.column(2).to_pylist()
            out = []
            for t, g in zip(texts, gone, strict=True):
                if not g:
                    out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest(), t))
                    continue
                at, n = (np.array([x[k] for x in g], dtype=np.int64) for k in ("at", "n"))
                a, b = removed_spans(len(t), at, n, length)
                kept = b"".join([t[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(t)], strict=True)])
                out.append((len(t), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays if with_text else arrays[:5], names=names if with_text else names[:5])

    joined = rows.join(listed, ["doc", "copy"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
