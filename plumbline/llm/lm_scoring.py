"""Scores of whole texts under the attention model and under a smoothed word unigram, over scans of the corpus.

Words are A-Z lower-cased and split at white space; behind each text's words comes one end, which counts as a token.
Texts whose crc32 of the id (as text), modulo ``fold``, is ``held`` are held out; all others are training texts.

Scan 1 counts the words (64-bit hashes) of all training texts. A batch sends its (word, text, times) triples to the word's bucket, packed as arrays; the bucket
counts the word over the corpus and sends each text its share of the unigram score. Words of the *frequent list* (those
of a bounded sample, ``SAMPLE_TEXTS``) send one count a batch instead, as they would swamp their bucket: their counts
come to the driver (bounded by the list) and their share of the score is added in scan 5. The list decides how counts
travel, never what they are.

Scan 2 cuts all texts, whole, into ids and writes these to a table, which the later scans read instead of the texts; the
counts of the training texts' ids settle the classes. Scan 3 counts what follows which id in all training texts.
The attention weights start from a fit on the sample. Then, in scan 4, every task takes each window of its training
texts once, and the tasks' weights are averaged by their windows. Scan 5 scores every text, all ids.

Null texts are empty: they have one token, the end. A null id counts as the empty text for the fold. Rows may repeat.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import attention_lm as lm
from plumbline.llm.bytescan import as_bytes, groups_by_bytes, word_hashes
from plumbline.llm.groups import lean
from plumbline.llm.scratch import Scratch

SAMPLE_TEXTS, SAMPLE_CHARS = 1500, 8_000
BUCKETS, BUCKET_BYTES = 32, 32e6
#: Bytes of text that share one sort of their words.
SLICE = 4 << 20
#: Bytes of packed ids that are learned or scored together.
IDS = 2 << 20
_TEXT_BITS, _TIMES = 14, (1 << 17) - 1
_pieces: dict[str, lm.Pieces] = {}


def pieces_of(path: str) -> lm.Pieces:
    if path not in _pieces:
        _pieces[path] = lm.Pieces(path)
    return _pieces[path]


def keyed(docs: DataFrame, id_col: str, text_col: str, fold: int, held: int) -> DataFrame:
    """(doc_id, key, held_out, text); equal rows have equal keys."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    out = F.pmod(F.crc32(ident.cast("binary")), F.lit(fold)) == held
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), ident, text_col).alias("key"), out.alias("held_out"), F.col(text_col).alias("text"))


def _texts(batch: pa.RecordBatch, keys_at: int):
    """Slices of a batch: (key, held out, texts)."""
    texts = as_bytes(batch.column(keys_at + 2))
    key, held = batch.column(keys_at).to_numpy(zero_copy_only=False), batch.column(keys_at + 1).to_numpy(zero_copy_only=False).astype(bool)
    for a, b in groups_by_bytes(texts, SLICE):
        for s in range(a, b, 1 << _TEXT_BITS):
            e = min(b, s + (1 << _TEXT_BITS))
            yield slice(s, e), key[s:e], held[s:e], texts[s:e]


def _among(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash among the sorted ``words``, and whether it is there."""
    if not len(words):
        return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
    slot = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return slot, words[slot] == hashes


def counted(rows: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, words, meta, keys, common, sums): packed triples of rare words, and the frequent words' sums."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            for _, key, held, texts in _texts(batch, 0):
                hashes, n_words = word_hashes(texts)
                words_here, _, of = lm.distinct(hashes)
                pair, times = np.unique(of << _TEXT_BITS | np.repeat(np.arange(len(texts)), n_words), return_counts=True)
                of, t = pair >> _TEXT_BITS, pair & ((1 << _TEXT_BITS) - 1)
                h, common = words_here[of], _among(words_here, shared.value)[1][of]
                train = ~held[t]
                # frequent words: one count for the slice's training texts
                words, of = np.unique(h[common & train], return_inverse=True)
                sums = np.bincount(of, weights=times[common & train], minlength=len(words)).astype(np.int64)
                rare_h, rare_t, rare_n = h[~common], t[~common], times[~common]
                big = np.flatnonzero(rare_n > _TIMES)  # more times than a triple holds
                more = [(rare_h[i], rare_t[i], int(rare_n[i]) - _TIMES) for i in big]
                rare_n = np.minimum(rare_n, _TIMES)
                for x, y, left in more:
                    parts = [_TIMES] * (left // _TIMES) + [left % _TIMES]
                    rare_h, rare_t, rare_n = np.append(rare_h, [x] * len(parts)), np.append(rare_t, [y] * len(parts)), np.append(rare_n, parts)
                meta = rare_n.astype(np.uint32) << np.uint32(_TEXT_BITS + 1) | (~held[rare_t]).astype(np.uint32) << np.uint32(_TEXT_BITS) | rare_t.astype(np.uint32)
                where, where_f = (rare_h % np.uint64(buckets)).astype(np.int64), (words % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cut = np.searchsorted(where[order], np.arange(buckets + 1))
                out = []
                for b in range(buckets):
                    at = order[cut[b] : cut[b + 1]]
                    f = where_f == b
                    if not len(at) and not f.any():
                        continue
                    used, place = np.unique(meta[at] & np.uint32((1 << _TEXT_BITS) - 1), return_inverse=True)
                    packed = meta[at] & ~np.uint32((1 << _TEXT_BITS) - 1) | place.astype(np.uint32)
                    out.append((b, rare_h[at].tobytes(), packed.tobytes(), key[used].tobytes(), words[f].tobytes(), sums[f].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["bucket", "words", "meta", "keys", "common", "sums"])

    return rows.select("key", "held_out", "text").mapInArrow(lean(run), "bucket int, words binary, meta binary, keys binary, common binary, sums binary")


def unigram_parts(packed: DataFrame) -> DataFrame:
    """(key, part, known) of every text and bucket; and for each bucket its totals and frequent words' counts (``stats``).

    ``part`` is the sum of log10(c + 1) over the text's words in the bucket.
    """

    def run(_, table):
        cols = {n: table.column(n).to_pylist() for n in table.column_names}
        words = [np.frombuffer(x, dtype=np.uint64) for x in cols["words"]]
        metas = [np.frombuffer(x, dtype=np.uint32) for x in cols["meta"]]
        all_words = np.concatenate(words)
        meta = np.concatenate(metas)
        times = (meta >> np.uint32(_TEXT_BITS + 1)).astype(np.int64)
        train = (meta >> np.uint32(_TEXT_BITS)) & np.uint32(1) == 1
        distinct, of = np.unique(all_words, return_inverse=True)
        c = np.bincount(of, weights=times * train, minlength=len(distinct)).astype(np.int64)
        of_f, at = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in cols["common"]]), return_inverse=True)
        c_f = np.bincount(at, weights=np.concatenate([np.frombuffer(x, dtype=np.int64) for x in cols["sums"]]), minlength=len(of_f)).astype(np.int64)
        keys, parts, known = [], [], []
        here = c[of]
        gain, seen = times * np.log10(here + 1.0), times * (here > 0)
        start = 0
        for m, k in zip(metas, cols["keys"], strict=True):
            own = np.frombuffer(k, dtype=np.int64)
            text = (m & np.uint32((1 << _TEXT_BITS) - 1)).astype(np.int64)
            part = slice(start, start + len(m))
            keys.append(own)
            parts.append(np.bincount(text, weights=gain[part], minlength=len(own)))
            known.append(np.bincount(text, weights=seen[part], minlength=len(own)).astype(np.int64))
            start += len(m)
        n = sum(map(len, keys))
        total = np.array([c.sum() + c_f.sum(), (c > 0).sum() + (c_f > 0).sum()], dtype=np.int64)
        none = [None] * n
        return pa.table(
            {
                "key": pa.array([*np.concatenate(keys).tolist(), None], pa.int64()),
                "part": pa.array([*np.concatenate(parts).tolist(), None], pa.float64()),
                "known": pa.array([*np.concatenate(known).tolist(), None], pa.int64()),
                "total": pa.array([*none, total.tobytes()], pa.binary()),
                "common": pa.array([*none, of_f.tobytes()], pa.binary()),
                "counts": pa.array([*none, c_f.tobytes()], pa.binary()),
            }
        )

    return packed.groupBy("bucket").applyInArrow(run, "key long, part double, known long, total binary, common binary, counts binary")


def narrow(size: int) -> type:
    """The type in which tables hold numbers below ``size``."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def _packed(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary cell for each text's ``n`` values."""
    ends = np.concatenate([[0], np.cumsum(n * values.itemsize)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())


def cut_texts(rows: DataFrame, vocabulary: str, frequent: np.ndarray) -> DataFrame:
    """(doc_id, key, held_out, n_words, ids, slots, counts) of every text, cut into ids once for all later scans.

    ``ids`` and ``slots`` are packed: the text's ids, its end included, and the places of its frequent words in their
    list. A task's last row has no key, but the counts of the ids of its training texts.
    """
    spark, size = rows.sparkSession, pieces_of(vocabulary).size
    shared = spark.sparkContext.broadcast(frequent)
    names = ["doc_id", "key", "held_out", "n_words", "ids", "slots", "counts"]

    def run(batches):
        own, words, single = pieces_of(vocabulary), shared.value, np.zeros(size, dtype=np.int64)
        for batch in batches:
            for at, key, held, texts in _texts(batch, 1):
                hashes, n_words = word_hashes(texts)
                words_here, first, of = lm.distinct(hashes)
                ids, n_ids = lm.cut_words(texts, own, n_words, first, of)
                single += np.bincount(ids[np.repeat(~held, n_ids)], minlength=size)
                slot, hit = (x[of] for x in _among(words_here, words))
                n_slots = np.bincount(np.repeat(np.arange(len(texts)), n_words)[hit], minlength=len(texts))
                ident = batch.column(0).slice(at.start, at.stop - at.start)
                columns = (pa.array(key), pa.array(held), pa.array(n_words.astype(np.int64)), _packed(ids.astype(narrow(size)), n_ids), _packed(slot[hit].astype(narrow(len(words))), n_slots))
                yield pa.RecordBatch.from_arrays([ident, *columns, pa.nulls(len(texts), pa.list_(pa.int64()))], names=names)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([single], pa.list_(pa.int64()))], names=names)

    return rows.select("doc_id", "key", "held_out", "text").mapInArrow(lean(run), "doc_id long, key long, held_out boolean, n_words long, ids binary, slots binary, counts array<long>")


def _ids(batch: pa.RecordBatch, kind: type):
    """Slices of a batch: (slice, ids of its texts one after another, ids of each text); its column ``ids``."""
    cells = as_bytes(batch.column("ids"))
    for a, b in groups_by_bytes(cells, IDS):
        yield slice(a, b), np.frombuffer(b"".join(cells[a:b]), dtype=kind).astype(np.int32), np.array([len(x) for x in cells[a:b]], dtype=np.int64) // np.dtype(kind).itemsize


def training(cut: DataFrame) -> DataFrame:
    """The ids of the training texts of ``cut_texts``."""
    return cut.where("key is not null and not held_out").select("ids")


def learned(cut: DataFrame, seed: int, start: dict[str, np.ndarray], classes: lm.Classes, follow: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """Weights after a pass over all training texts, and the number of windows it took.

    Each task goes on from ``start`` over every window of its texts. It hands over its weights once, in blocks; their
    sums by windows have a fixed size, however large the corpus is.
    """
    shared = cut.sparkSession.sparkContext.broadcast((start, classes, follow))
    names, block, kind = sorted(start), 1 << 16, narrow(len(classes.of))

    def run(batches):
        first, of, behind = shared.value
        adam, r, n = lm.Adam({k: x.copy() for k, x in first.items()}), np.random.default_rng(seed), 0
        for batch in batches:
            for _, ids, n_ids in _ids(batch, kind):
                n += lm.train_on_all(adam, ids, n_ids, of, behind, r)
        if n:
            flat = np.concatenate([adam.w[k].ravel() for k in names]).astype(np.float32)
            out = [(b, n, flat[b * block : (b + 1) * block].tobytes()) for b in range(-(-len(flat) // block))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["block", "n", "weights"])

    def add(key, table):
        n, total = 0, 0
        for k, x in zip(table.column("n").to_pylist(), table.column("weights").to_pylist(), strict=True):
            n, total = n + k, total + np.frombuffer(x, dtype=np.float32).astype(np.float64) * k
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    form = "block int, n long, weights binary"
    got = sorted(training(cut).mapInArrow(lean(run), form).groupBy("block").applyInArrow(add, form).collect())
    if not got:
        return start, 0
    flat = np.concatenate([np.frombuffer(r.weights, dtype=np.float32) for r in got])
    ends = np.cumsum([start[k].size for k in names])
    return {k: x.reshape(start[k].shape).astype(start[k].dtype) for k, x in zip(names, np.split(flat, ends[:-1]), strict=True)}, got[0].n


def corpus_classes(cut: DataFrame, size: int) -> tuple[lm.Classes, np.ndarray]:
    """Classes of ``size`` ids and what follows which id, with the counts of all training texts.

    Which ids share a class is settled on the counts of all; shares and pairs are counted over the corpus. A task hands
    over its sums once, in blocks; sums of sums have a fixed size (ids x classes) however large the corpus is.
    """
    single = np.zeros(size, dtype=np.int64)
    for r in cut.where("counts is not null").select(F.posexplode("counts").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).collect():
        single[r.id] = r.n
    grouping = lm.Classes.fit(single)
    shared = cut.sparkSession.sparkContext.broadcast(grouping)
    block, kind = 256, narrow(size)

    def count(batches):
        pairs = np.zeros((size, lm.CLASSES), dtype=np.int32)
        for batch in batches:
            for _, ids, n_ids in _ids(batch, kind):
                pairs += lm.pair_counts(shared.value, lm.shifted(ids, n_ids, size - 1), ids).astype(np.int32)
        out = [(b, zlib.compress(pairs[b * block : (b + 1) * block].tobytes(), 1)) for b in range(-(-size // block))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary()), strict=True)], names=["block", "pairs"])

    def add(key, table):
        pairs = 0
        for y in table.column("pairs").to_pylist():
            pairs = pairs + np.frombuffer(zlib.decompress(y), dtype=np.int32).astype(np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "pairs": pa.array([zlib.compress(pairs.astype(np.float32).tobytes(), 1)], pa.binary())})

    form = "block int, pairs binary"
    pairs = np.zeros((size, lm.CLASSES), dtype=np.float32)
    for r in training(cut).mapInArrow(lean(count), form).groupBy("block").applyInArrow(add, form).collect():
        part = slice(r.block * block, (r.block + 1) * block)
        pairs[part] = np.frombuffer(zlib.decompress(r.pairs), dtype=np.float32).reshape(-1, lm.CLASSES)
    shares = single + 1.0
    classes = lm.Classes(grouping.of, np.log(shares / np.bincount(grouping.of, weights=shares, minlength=lm.CLASSES)[grouping.of]))
    return classes, lm.follow_table(classes, single, pairs)


def scored(cut: DataFrame, model: tuple, counts: np.ndarray) -> DataFrame:
    """(doc_id, key, held_out, n_tokens, known, part, score) of every text: the model's score, and the frequent words' part."""
    shared = cut.sparkSession.sparkContext.broadcast((model, np.log10(counts + 1.0), counts > 0))
    kind, slot_kind = narrow(len(model[1].of)), narrow(len(counts))

    def run(batches):
        for batch in batches:
            (weights, classes, follow), gain, seen = shared.value
            cells = as_bytes(batch.column("slots"))
            for at, ids, n_ids in _ids(batch, kind):
                value = lm.score(weights, classes, follow, ids, n_ids) / np.log(10)
                own = cells[at]
                slot = np.frombuffer(b"".join(own), dtype=slot_kind)
                text = np.repeat(np.arange(len(own)), [len(x) // slot.itemsize for x in own])
                part = np.bincount(text, weights=gain[slot], minlength=len(own)).astype(np.float64)  # whole numbers if there are none
                known = np.bincount(text, weights=seen[slot], minlength=len(own)).astype(np.int64)
                ident, key, held, n_words = (batch.column(c).slice(at.start, at.stop - at.start) for c in ("doc_id", "key", "held_out", "n_words"))
                n_tokens = n_words.to_numpy(zero_copy_only=False) + 1
                yield pa.RecordBatch.from_arrays([ident, key, held, *map(pa.array, (n_tokens, known, part, value))], names=["doc_id", "key", "held_out", "n_tokens", "known", "part", "score"])

    return cut.where("key is not null").drop("counts").mapInArrow(lean(run), "doc_id long, key long, held_out boolean, n_tokens long, known long, part double, score double")


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2, steps: int = lm.STEPS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    rows = keyed(docs, id_col, text_col, fold, held)
    n_train, n_bytes = rows.agg(F.count_if(~F.col("held_out")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    own = pieces_of(vocabulary)
    smallest = rows.where("not held_out").select("key").orderBy("key").limit(SAMPLE_TEXTS)
    sample = rows.where("not held_out").select("key", F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(smallest.distinct()), "key", "left_semi").orderBy("key").limit(SAMPLE_TEXTS).collect()
    hashes, _, ids, n_ids = lm.tokenized([r.text.encode() for r in sample], own)
    words, n = np.unique(hashes, return_counts=True)
    frequent = words[n >= 3]

    n_buckets = max(BUCKETS, int(-(-n_bytes // BUCKET_BYTES)))
    parts = scratch.table(unigram_parts(counted(rows, frequent, n_buckets)), "parts")
    stats = parts.where("key is null and total is not null").select("total", "common", "counts").collect()  # a row a bucket, with the frequent list's counts
    total = sum((np.frombuffer(r.total, dtype=np.int64) for r in stats), np.zeros(2, dtype=np.int64))
    train_tokens, distinct = int(total[0]) + n_train, int(total[1]) + (n_train > 0)
    counts = np.zeros(len(frequent), dtype=np.int64)
    for r in stats:
        counts[np.searchsorted(frequent, np.frombuffer(r.common, dtype=np.uint64))] = np.frombuffer(r.counts, dtype=np.int64)

    cut = scratch.table(cut_texts(rows, vocabulary, frequent), "cut")
    classes, follow = corpus_classes(cut, own.size)
    weights, _ = learned(cut, 13, lm.train(ids, n_ids, classes, follow, own.size, steps), classes, follow)
    found = scored(cut, (weights, classes, follow), counts)
    rare = parts.where("key is not null").groupBy("key").agg(F.sum("part").alias("rare_part"), F.sum("known").alias("rare_known"))
    copies = found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.first("n_tokens").alias("n_tokens"), F.first("known").alias("known"), F.first("part").alias("part"), F.first("score").alias("score"), F.count("*").alias("copies"))
    smoothed = float(np.log10(train_tokens + distinct + 1.0))
    joined = copies.join(rare, "key", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rare_part, rare_known = F.coalesce(F.col("rare_part") / F.col("copies"), F.lit(0.0)), F.coalesce((F.col("rare_known") / F.col("copies")).cast("long"), F.lit(0))
    base = F.col("part") + rare_part + F.lit(float(np.log10(n_train + 1.0))) - F.col("n_tokens") * F.lit(smoothed)
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + rare_known + F.lit(int(n_train > 0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
