"""Benchmark decontamination by DataFrame operations alone.

A document leaks an item if some window of the item's number of words is similar to it: the weighted Jaccard similarity
of their SHINGLE-word shingles (a shingle weighs as often as it occurs) is at least ``percent``.

1. Documents' shingles meet the items' shingles. A similar window holds at least ``percent`` of the item's shingles, so
   pairs of document and item with fewer meetings are out. A best window can be moved to start at a shingle that the
   item has too, so only these windows are cut out (moved back if the document ends before).
2. Windows and items get SimHash fingerprints of 64 bits. Fingerprints within RADIUS agree in one of RADIUS + 1 blocks
   of bits; windows and items of one size are joined by (size, block, bits), then by the Hamming distance.
3. What is left is verified on exact weighted shingles.

At a similarity of exactly 0.8 fingerprints differ by more than RADIUS = 23 bits with a chance of about 1e-6. Words are
lower-cased and split at white space. Items of fewer than SHINGLE words leak nowhere; null and empty texts hold
nothing. Rows without an id are ignored; rows that repeat an id are checked each on its own and reported together.
Extra columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

SHINGLE, RADIUS, BITS = 5, 23, 64
#: Benchmark shingles are broadcast up to this number (about 50 MB); beyond it they are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000
_LANES, _MASK = 16, 0x0001000100010001
_SPACE = "[\\x20\\x09-\\x0D]+"


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _in_order(hashes: str) -> Column:
    n = F.size(hashes)
    at = lambda i, k: F.get(F.col(hashes), (i + k).cast("int"))
    rolled = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, rolled).otherwise(F.array().cast("array<bigint>"))


def _with_shingles(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, row, sh) of the rows that have an id; ``row`` tells apart rows that repeat an id."""
    words = df.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.xxhash64(text).alias("row"), _word_hashes(F.col(text)).alias("_w"))
    return words.select("id", "row", _in_order("_w").alias("sh"))


def _fingerprints(rows: DataFrame, keys: list[str], shingle: str) -> DataFrame:
    """keys, n, fp: the sign of each bit's sum over a group's shingles; 16-bit lanes count four bits at a time."""
    lane = [F.sum(F.shiftrightunsigned(F.col(shingle), j).bitwiseAND(F.lit(_MASK))).alias(f"c{j}") for j in range(_LANES)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), *lane)
    bits = [
        F.when(F.shiftrightunsigned(F.col(f"c{j}"), 16 * k).bitwiseAND(F.lit(0xFFFF)) * 2 > F.col("n"), F.lit(_signed(1 << (16 * k + j)))).otherwise(F.lit(0))
        for j in range(_LANES)
        for k in range(4)
    ]
    return counted.select(*keys, "n", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _blocks(fp: str) -> Column:
    """(block, bits) of each of RADIUS + 1 blocks that divide the fingerprint."""
    cut = [b * BITS // (RADIUS + 1) for b in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))])


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, similarity): every document and item it leaks, with the best window's similarity."""
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    items = _with_shingles(benchmark, item_col, text_col).where(F.size("sh") > 0).select(F.col("id").alias("item"), "row", "sh", F.size("sh").alias("size"))
    weights = scratch.table(items.select("item", "row", "size", F.explode("sh").alias("s")).groupBy("item", "row", "size", "s").agg(F.count("*").alias("weight")), "weights")
    small = weights.count() <= BROADCAST_SHINGLES
    near = F.broadcast if small else (lambda x: x)

    # the outer form: for the inner one the optimizer adds a filter that makes the shingles a second time
    counted = _with_shingles(docs, id_col, text_col).withColumn("total", F.size("sh"))
    hits = counted.select("id", "row", "total", F.posexplode_outer("sh").alias("at", "s"))
    wanted = weights.select("s", F.col("item").alias("item"), F.col("row").alias("item_row"), "size")
    met = hits.join(near(wanted), "s")
    pair = ["id", "row", "item", "item_row"]
    enough = met.groupBy(*pair, "size", "total").agg(F.collect_set("at").alias("ats")).where(F.size("ats") * 100 >= F.col("size") * percent)
    starts = F.array_distinct(F.transform("ats", lambda p: F.least(p, F.greatest(F.col("total") - F.col("size"), F.lit(0)))))
    windows = scratch.table(enough.select("id", "row", "size", starts.alias("starts")).groupBy("id", "row").agg(F.collect_set(F.struct("size", "starts")).alias("cuts")), "windows")

    again = _with_shingles(docs.select(id_col, text_col).join(windows.select(F.col("id").alias("_id")).distinct(), F.col(id_col) == F.col("_id"), "left_semi"), id_col, text_col)
    cut = again.dropDuplicates(["id", "row"]).join(windows, ["id", "row"]).select("id", "row", "sh", F.explode("cuts").alias("cut")).select("id", "row", "sh", F.col("cut.size").alias("size"), F.explode("cut.starts").alias("start")).distinct()
    rows = scratch.table(cut.select("id", "row", "size", "start", F.explode(F.expr("slice(sh, start + 1, size)")).alias("s")), "shingles")
    window = ["id", "row", "size", "start"]
    of_windows = _fingerprints(rows, window, "s").withColumn("b", F.explode(_blocks("fp"))).select(*window, "fp", "b.block", "b.bits")
    of_items = _fingerprints(items.select("item", F.col("row").alias("item_row"), "size", F.explode("sh").alias("s")), ["item", "item_row", "size"], "s")
    of_items = of_items.withColumn("b", F.explode(_blocks("fp"))).select("item", "item_row", "size", F.col("fp").alias("item_fp"), "b.block", "b.bits")
    close = of_windows.join(near(of_items), ["size", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    candidates = close.select(*window, "item", "item_row").distinct()

    counted = rows.groupBy(*window, "s").agg(F.count("*").alias("n"))
    shared = candidates.join(counted, window).join(near(weights.select("item", F.col("row").alias("item_row"), "s", "weight")), ["item", "item_row", "s"])
    sizes = rows.groupBy(*window).agg(F.count("*").alias("held"))
    common = shared.groupBy(*window, "item", "item_row").agg(F.sum(F.least("n", "weight")).alias("common")).join(sizes, window)
    judged = common.withColumn("union", F.col("size") + F.col("held") - F.col("common")).where(F.col("common") * 100 >= F.col("union") * percent)
    return judged.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max(F.col("common") / F.col("union")).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    bad = leaks(docs, benchmark, percent, id_col, scratch=scratch).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("_leak"), "left_anti")
