"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. A document's set of word shingles gives a fingerprint (equal sets are one class from here on) and K minima.
2. Every class is posted under its (coordinate, value) pairs. Two sets that agree in T coordinates share one of the
   K - T + 1 pairs that come first in any fixed order, so only that prefix is posted, rarest pairs first (by a counting
   sketch of fixed size over all postings): pairs that a common passage makes frequent are seldom posted.
3. Within a posting list the collisions of the pairs of classes are counted over the whole signatures. Counting skips
   pairs that can no longer reach T after the first coordinates, and pairs whose classes the list has already linked.
   Long lists are dealt to block pairs of bounded size. Only a spanning forest of a list's collisions goes on.
4. Classes that collisions connect are brought together once, again in block pairs of bounded size, with their whole
   texts; every pair of T collisions that is not linked already is compared on its full shingle sets.
5. Components of the confirmed links are found by star contraction; a class passes its component to all its documents.

At a similarity of exactly 0.8, a pair has fewer than T = 13 of K = 32 equal coordinates with a chance of about 1e-6.

Null and empty texts have empty sets: they link to nothing. Rows without an id link to nothing either and have no
component. Rows that repeat an id share its component. Copies, ties and extra columns need no care.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bytescan import as_bytes, groups_by_bytes, mix, shingle_sets, word_hashes
from plumbline.llm.components import components
from plumbline.llm.groups import grouped, lean, sorted_groups
from plumbline.llm.idset import maybe_in
from plumbline.llm.scratch import Scratch

K, T = 32, 13
PREFIX = K - T + 1
SKETCH = 1 << 18
#: Classes of a posting list, and documents of a candidate group, that one block holds.
LIST_BLOCK, GROUP_BLOCK = 1024, 256
_rng = np.random.default_rng(7)
_MULTIPLIER = _rng.integers(1 << 40, 1 << 62, K, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 62, K, dtype=np.uint64)


def sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in groups_by_bytes(texts):
        words, counts = word_hashes(texts[a:b])
        out += [shingle_sets(w, size) for w in np.split(words, np.cumsum(counts)[:-1])]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 (sets, K); all sets have elements."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), K), dtype=np.uint32)
    for k in range(K):
        out[:, k] = np.minimum.reduceat(((flat * _MULTIPLIER[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def posting_keys(sig: np.ndarray) -> np.ndarray:
    """int64 (rows, K): one number for each coordinate and value."""
    return mix(sig.astype(np.uint64) | (np.arange(K, dtype=np.uint64) << np.uint64(32))[None, :]).view(np.int64)


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, K)


def features(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, fp, sig): fingerprint of 128 bits and signature, null for empty sets."""

    def run(batches):
        for batch in batches:
            n_all, fps, sigs = [], [], []
            texts = as_bytes(batch.column(1))
            for a, b in groups_by_bytes(texts):
                sets = sets_of(texts[a:b], size)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                for s in sets:
                    n_all.append(len(s))
                    if len(s):
                        fps.append(np.array([mix(s).sum(), np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5BD1E9955BD1E995)))], dtype=np.uint64).tobytes())
                        sigs.append(next(rows).tobytes())
                    else:
                        fps.append(None)
                        sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_all, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "fp", "sig"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lean(run), "doc_id long, n_shingles long, fp binary, sig binary")


def frequency_sketch(classes: DataFrame) -> np.ndarray:
    """How many postings fall into each of SKETCH cells, over all classes; the driver gets SKETCH numbers."""
    width = 1 << 12

    def count(batches):
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            total += np.bincount((posting_keys(_signature_matrix(batch.column(0))) & (SKETCH - 1)).ravel(), minlength=SKETCH)
        blocks = np.flatnonzero(total.reshape(-1, width).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[b * width : (b + 1) * width].tobytes() for b in blocks], pa.binary())], names=["block", "counts"])

    def add(key, table):
        total = sum((np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist()), np.zeros(width, dtype=np.int64))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(SKETCH, dtype=np.int64)
    for r in classes.select("sig").mapInArrow(lean(count), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r.counts, dtype=np.int64)
    return out


def postings(classes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(key, rep): each class under the PREFIX rarest of its pairs."""
    shared = classes.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = posting_keys(_signature_matrix(batch.column(1)))
            seen = np.minimum(shared.value[keys & (SKETCH - 1)], (1 << 31) - 1).astype(np.uint64)
            order = seen << np.uint64(32) | (keys.view(np.uint64) >> np.uint64(32))
            best = np.argpartition(order, PREFIX - 1, axis=1)[:, :PREFIX]
            yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(keys, best, axis=1).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), PREFIX))], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(lean(run), "key long, rep long")


def in_blocks(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """``rows`` with (part_a, part_b, part): members of large groups are dealt to parts, and to every pair of parts."""
    n = F.count("*").over(Window.partitionBy(key))
    dealt = rows.withColumn("_n", n).where("_n > 1").withColumn("_parts", F.ceil(F.col("_n") / block).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(member), F.col("_parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return dealt.withColumn("_other", other).withColumn("part_a", F.least("part", "_other")).withColumn("part_b", F.greatest("part", "_other")).drop("_n", "_parts", "_other")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def colliding(sig: np.ndarray, row: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``others`` that agree with ``row`` in T coordinates at least, and in how many."""
    half = K // 2
    n = (sig[others, :half] == sig[row, :half]).sum(axis=1)
    near = n >= T - (K - half)
    others, n = others[near], n[near]
    n = n + (sig[others, half:] == sig[row, half:]).sum(axis=1)
    near = n >= T
    return others[near], n[near]


def forest_edges(listed: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of the collisions of every list's block pair. listed: key, part_a, part_b, part, rep, sig."""

    def of_group(reps, parts, sig, cross: bool):
        forest, out = Forest(len(reps)), []
        side = np.flatnonzero(parts == parts.min()) if cross else None
        rest = np.flatnonzero(parts != parts.min()) if cross else None
        rows = side.tolist() if cross else range(len(reps) - 1)
        for x in rows:
            others = rest if cross else np.arange(x + 1, len(reps))
            hit, _ = colliding(sig, x, others)
            for y in hit.tolist():
                if forest.join(x, y):
                    out.append((reps[x], reps[y]))
        return out

    def run(batches):
        for keys, cols in grouped(batches, 3):
            parts, reps = cols[0].to_numpy(), cols[1].to_numpy()
            sig = _signature_matrix(cols[2])
            same = np.ones(len(reps), dtype=bool)
            same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            first = np.flatnonzero(~same | (np.arange(len(reps)) == 0))
            size = np.diff([*first, len(reps)])
            pairs = first[size == 2]
            ok = (sig[pairs] == sig[pairs + 1]).sum(axis=1) >= T if len(pairs) else np.zeros(0, dtype=bool)
            u, v = reps[pairs[ok]].tolist(), reps[pairs[ok] + 1].tolist()
            for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                edges = of_group(reps[a : a + n], parts[a : a + n], sig[a : a + n], keys[1][a] != keys[2][a])
                u += [x for x, _ in edges]
                v += [y for _, y in edges]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return sorted_groups(listed.select("key", "part_a", "part_b", "part", "rep", "sig"), ["key", "part_a", "part_b"]).mapInArrow(lean(run), "u long, v long")


def confirmed_links(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links confirmed on full sets, of every candidate group's block pair. groups: component, part_a, part_b, part, rep, text."""

    def run(batches):
        for keys, cols in grouped(batches, 3):
            parts, reps, texts = cols[0].to_numpy(), cols[1].to_numpy(), as_bytes(cols[2])
            first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
            u: list[int] = []
            v: list[int] = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(reps)], strict=True):
                if b - a < 2:
                    continue
                sets = sets_of(texts[a:b], size)
                full = np.flatnonzero([len(s) > 0 for s in sets])
                if len(full) < 2:
                    continue
                sets = [sets[i] for i in full]
                sig = signatures(sets)
                cross = keys[1][a] != keys[2][a]
                part, rep = parts[a:b][full], reps[a:b][full]
                forest = Forest(len(full))
                for x in range(len(full)):
                    others = np.arange(x + 1, len(full))
                    if cross:
                        others = others[part[others] != part[x]]
                    hit, n = colliding(sig, x, others)
                    for y in hit[np.argsort(-n, kind="stable")].tolist():
                        if forest.root(x) != forest.root(y) and similar(sets[x], sets[y], percent):
                            forest.join(x, y)
                            u.append(int(rep[x]))
                            v.append(int(rep[y]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return sorted_groups(groups.select("component", "part_a", "part_b", "part", "rep", "text"), ["component", "part_a", "part_b"]).mapInArrow(lean(run), "u long, v long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    known = scratch.table(features(docs, size, id_col, text_col), "features")
    sets = known.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    least = sets.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    members = scratch.table(sets.select("doc_id", "fp").distinct().join(least, "fp").select("doc_id", "rep", "fp"), "members")
    own = members.where("doc_id = rep").select("rep", "fp")
    classes = scratch.table(sets.select("fp", "sig", F.col("doc_id").alias("rep")).join(own, ["rep", "fp"], "left_semi").dropDuplicates(["rep", "fp"]).select("rep", "fp", "sig"), "classes")
    listed = in_blocks(postings(classes, frequency_sketch(classes)), "key", "rep", LIST_BLOCK)
    candidates = scratch.table(forest_edges(listed.join(classes.select("rep", "sig"), "rep")).distinct(), "candidates")
    groups = components(candidates, scratch)
    dealt = in_blocks(groups.select("component", F.col("node").alias("rep")), "component", "rep", GROUP_BLOCK)
    whole = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    whole = maybe_in(whole, "rep", groups.select("node"))
    links = scratch.table(confirmed_links(dealt.hint("merge").join(whole, "rep"), size, percent), "links")
    found = components(links, scratch)
    by_doc = members.join(found.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("doc_id", "fp", F.coalesce("component", "rep").alias("component_id"))
    out = known.select("doc_id", "n_shingles", "fp").join(by_doc, ["doc_id", "fp"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
