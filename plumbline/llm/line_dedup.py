"""Fuzzy line deduplication by DataFrame operations alone.

Two lines are linked if the sets of all their GRAM-character shingles (at every position; a shorter line is its own) are
similar by Jaccard, counted exactly. One line of each component of links stays.

1. Lines are split out; exact copies become one class. Classes get numbers, the smaller the more copies they have.
2. Signatures: the least hashes of a line's WINDOW-character shingles that start a word of WORD
   characters or more, and for lines that are short, hold few such words or repeat themselves, of those at all positions too. An edit that breaks GRAM shingles breaks WINDOW
   windows at most, so lines near the threshold still have 0.38 of them in common, most have over 0.6.
3. Banding. Windows that no other class has among its least are left out; every other one forms bands with each of the
   NEXT that follow it. (Of 16 least hashes two such are common but for 2 in 1,000 links at 0.38, none in 4,000 at 0.5.)
4. Sets of up to WHOLE shingles (short lines, lines that repeat themselves) have every run of three in the order of
   hashes as a band: at 0.8, of u shingles of either set 0.2 u at most are not common, so the common ones form a run of
   three (of two if u = 5): no link is lost. Larger sets of lines that repeat themselves give the runs of their least.
5. All members of bands of up to SMALL are compared with each other, those of larger bands with the band's pivots first: its
   class with the most copies and the first ones in two other orders of all classes.
   A sketch of SKETCH least hashes rules most pairs out (19 of 32 agree but for 1 in 10,000 at 0.8) before any text is sent.
6. Then all members of a larger band that these links leave in different components are compared with each other, in block
   pairs of bounded size. Parities of PARITY cells rule pairs out and lose none: of two sets, the cells that differ are
   no more than the shingles that only one has, at 0.8 a ninth of both sizes at most.
7. Components by star contraction; the first place (document, line) of each one stays.

Blank lines are never removed. Null texts have no lines. Rows that share an id are told apart by their texts; rows that
repeat id and text are one document: one of them stays (which one's extra columns is not settled). Rows without an id are left as they are
and take no part. Extra columns are kept. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.idset import maybe_in
from plumbline.llm.scratch import Scratch

#: Characters of the compared shingles, and of the windows of signatures.
GRAM, WINDOW = 5, 16
#: Characters that a word has at least for a window to start with it.
WORD = 4
#: Least windows of a signature (at word starts, at all positions); set size up to which bands lose nothing.
LEAST, WHOLE = 16, 40
#: Windows that a window forms bands with; members of a band that are all compared; values of a sketch, and how many agree.
NEXT, SMALL, SKETCH, AGREE = 4, 8, 32, 19
#: Cells of the parities (in words of 64), and members of a larger band that one block holds.
PARITY, BLOCK = 1024, 4096
#: Orders of the classes, by their number with some bits turned over; the first in each is a pivot of larger bands.
ORDERS = (0, 0x35A9_6C3B_51D2_E847, 0x5A1E_B3C7_0E6D_942B)
#: Up to this length, or with fewer than one word in SPARSE characters, windows start at all positions.
SHORT, SPARSE = 100, 12


def _none() -> Column:
    return F.array().cast("array<bigint>")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, pos, line) of all lines that are not blank; ``row`` is a hash of the document's text."""
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.split(text_col, "\n").alias("_lines"))
    return named.select("doc", "row", F.posexplode_outer("_lines").alias("pos", "line")).where(F.col("line").rlike("\\S"))


def _hashes(strings: Column) -> Column:
    return F.array_distinct(F.sort_array(F.transform(strings, lambda s: F.xxhash64(s))))


def _every(line: Column, length: int) -> Column:
    """All strings of so many characters; a shorter line is its own."""
    return F.when(F.length(line) < length, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(f"(?s)(?=({'.' * length}))"), F.lit(1)))


def with_shingles(text: DataFrame) -> DataFrame:
    """Adds hs: sorted distinct hashes of the line's shingles."""
    staged = text.withColumn("_found", _every(F.col("line"), GRAM))  # a column of its own, or it would be made once for each use
    return staged.withColumn("hs", _hashes(F.col("_found"))).drop("_found")


def _runs(hs: Column, length: int) -> Column:
    """Hashes of all runs of so many; none of a shorter array."""
    at = lambda i: [F.get(hs, i + k) for k in range(length)]
    return F.when(F.size(hs) < length, _none()).otherwise(F.transform(F.sequence(F.lit(0), F.size(hs) - length), lambda i: F.xxhash64(F.lit(length), *at(i))))


def signed(text: DataFrame) -> DataFrame:
    """Adds vals: what the line posts. Odd values are bands, even ones windows, which form bands by twos."""
    line, size = F.col("line"), F.length("line")
    started = text.withColumn("_words", F.regexp_extract_all(line, F.lit(f"(?s)(?=(\\S{{{WORD}}}{'.' * (WINDOW - WORD)}))\\S++\\s*+"), F.lit(1)))
    started = started.withColumn("_starts", _hashes(F.col("_words")))
    repeats = F.size("_starts") * 5 < F.size("_words") * 4
    marked = started.withColumn("_dense", ((size <= SHORT) | (F.size("_words") * SPARSE < size)) & ~repeats)
    dense = marked.withColumn("_all", F.when(F.col("_dense"), _every(line, WINDOW))).withColumn("_wide", F.coalesce(_hashes(F.col("_all")), _none()))
    # a line all of whose windows are there several times repeats itself, wherever its words start
    by_set = (size <= WHOLE + GRAM - 1) | repeats | (F.size("_wide") * 5 < F.size("_all") * 4)
    sets = dense.withColumn("_found", F.when(by_set, _every(line, GRAM))).withColumn("_hs", F.coalesce(_hashes(F.col("_found")), _none()))
    n, least = F.size("_hs"), F.slice("_hs", 1, WHOLE)
    few = F.when(n <= 1, _runs(least, 1)).when(n <= GRAM, _runs(least, 2)).otherwise(_none())
    bands = F.transform(F.concat(_runs(least, 3), few), lambda v: v.bitwiseOR(1))
    # a partner of a set of more than WHOLE has 0.8 WHOLE shingles at least; one of a line of up to 0.75 SHORT is short too
    windows = F.transform(F.concat(F.when(size > SHORT * 0.75, F.slice("_starts", 1, LEAST)).otherwise(_none()), F.slice("_wide", 1, LEAST)), lambda v: v.bitwiseAND(-2))
    vals = F.array_distinct(F.concat(bands, F.when(size * 5 >= WHOLE * 4, windows).otherwise(_none())))
    return sets.select(*text.columns, vals.alias("vals"))


def candidates(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(u, v): the pairs of classes that bands bring together at first; and (key, id, pivots) of the larger bands."""
    posted = classes.select("id", F.explode("vals").alias("v"))
    shared = scratch.table(posted.groupBy("v").agg(F.count("*").alias("_n")).where("_n > 1").select("v"), "shared")
    met = maybe_in(posted, "v", shared).join(shared, "v")
    own = met.where(F.col("v").bitwiseAND(1) == 1).select(F.col("v").alias("key"), "id")
    held = met.where(F.col("v").bitwiseAND(1) == 0).groupBy("id").agg(F.array_sort(F.collect_list("v")).alias("vs")).where(F.size("vs") > 1)  # a signature's values
    with_next = F.transform("vs", lambda v, i: F.transform(F.slice("vs", i + 2, F.lit(NEXT)), lambda w: F.xxhash64(v, w).bitwiseAND(-2)))
    every = scratch.table(own.unionByName(held.select(F.explode(F.flatten(with_next)).alias("key"), "id")), "bands")
    pivots = [F.min(F.col("id").bitwiseXOR(salt)).bitwiseXOR(salt).alias(f"p{k}") for k, salt in enumerate(ORDERS)]
    several = every.groupBy("key").agg(F.count("*").alias("n"), *pivots).where("n > 1")
    members = every.join(several, "key")
    large = scratch.table(members.where(F.col("n") > SMALL).select("key", "id", F.array(*[f"p{k}" for k in range(len(ORDERS))]).alias("pivots")), "large")
    with_pivots = _pairs(large.select("id", F.explode("pivots").alias("pivot")), "id", "pivot")
    few = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids").distinct()
    twos = F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.lit(SMALL)), lambda y: F.struct(y.alias("u"), x.alias("v"))))
    each = few.select(F.explode(F.flatten(twos)).alias("_p")).select("_p.u", "_p.v")
    out = scratch.table(each.unionByName(with_pivots).distinct(), "candidates")
    scratch.drop(shared, every)
    return out, large


def _parities(sets: DataFrame) -> DataFrame:
    """(id, ns, w0, ...): for each word of cells, which ones hold an odd number of the hashes hs."""
    h, none = F.col("_h"), F.lit(0).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    of_word = lambda k: F.when(F.shiftright(h, 6).bitwiseAND(PARITY // 64 - 1) == k, bit).otherwise(none)
    return sets.select("id", "ns", F.explode("hs").alias("_h")).groupBy("id", "ns").agg(*[F.bit_xor(of_word(k)).alias(f"w{k}") for k in range(PARITY // 64)])


def unsettled(large: DataFrame, labels: DataFrame, text: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v, cu, cv): all pairs of a larger band's members in different components whose sizes and parities allow the similarity."""
    named = large.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), F.col("id"))).alias(f"_x{k}") for k in range(2)]  # bands of the same members count once
    split = named.groupBy("key").agg(F.count("*").alias("_n"), F.min("c").alias("_a"), F.max("c").alias("_b"), *marks).where("_a <> _b")
    split = split.groupBy("_n", "_x0", "_x1").agg(F.min("key").alias("key"))
    open_ = scratch.table(named.join(split, "key").select("key", "id", "c", F.ceil(F.col("_n") / BLOCK).cast("int").alias("parts")), "open")
    words = [f"w{k}" for k in range(PARITY // 64)]
    found = with_shingles(maybe_in(text, "id", open_.select("id")).select("id", "line", "ns"))
    dealt = open_.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(_parities(found), "id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    on, n = ["key", "part_a", "part_b"], int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    # their number given, or rows of few bytes that make many pairs would be put into few tasks
    dealt = dealt.select("key", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "id", "c", "ns", *words).repartition(n, *on)
    a, b = (dealt.select(*on, F.col("part").alias(f"p{x}"), F.col("id").alias(x), F.col("c").alias(f"c{x}"), F.col("ns").alias(f"n{x}"), *[F.col(w).alias(f"{w}{x}") for w in words]) for x in "uv")
    differ = sum((F.bit_count(F.col(f"{w}u").bitwiseXOR(F.col(f"{w}v"))) for w in words), F.lit(0))
    alone = (F.col("nu") + F.col("nv")) * (100 - percent)  # 100 + percent times the most shingles that only one has
    once = (F.col("u") > F.col("v")) & (F.col("cu") != F.col("cv")) & ((F.col("pu") != F.col("pv")) | (F.col("part_a") == F.col("part_b")))
    sized = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
    out = scratch.table(a.hint("merge").join(b, on).where(once & sized & (differ * (100 + percent) <= alone)).select("u", "v", "cu", "cv").distinct(), "unsettled")
    scratch.drop(open_)
    return out


def _may_link(percent: int, na: str, nb: str, a: str, b: str) -> Column:
    """Whether sizes allow the similarity, and AGREE of SKETCH least hashes agree (as large a part of smaller sets)."""
    less, more = F.least(na, nb), F.greatest(na, nb)
    wanted = F.when(less >= SKETCH, F.lit(AGREE)).otherwise(F.floor(less * AGREE / SKETCH))
    return (less * 100 >= more * percent) & (F.size(F.array_intersect(a, b)) >= wanted)


def confirmed(pairs: DataFrame, text: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose lines' shingle sets are similar enough."""
    a, b = (text.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("ns").alias(f"n{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v")
    for x in "uv":  # staged, or shingles would be made once for each use
        both = both.withColumn(f"_s{x}", _every(F.col(f"line_{x}"), GRAM)).withColumn(f"_h{x}", F.transform(f"_s{x}", lambda s: F.xxhash64(s))).drop(f"line_{x}", f"_s{x}")
    union = both.withColumn("union", F.size(F.array_union("_hu", "_hv")))  # of the two sizes and the union follows what is common
    return union.where((F.col("nu") + F.col("nv") - F.col("union")) * 100 >= F.col("union") * percent).select("u", "v")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _agreeing(pairs: DataFrame, sides: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes and sketches allow the similarity."""
    a, b = (sides.select(F.col("id").alias(x), F.col("ns").alias(f"n{x}"), F.col("sk").alias(f"s{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v")
    return both.where(_may_link(percent, "nu", "nv", "su", "sv")).select("u", "v")


def line_components(classes: DataFrame, text_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """(id, component) of the classes that have links; ``text_of`` gives (id, line) of classes."""
    pairs, large = candidates(classes, scratch)
    found = with_shingles(text_of(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
    sketch = F.transform(F.slice("hs", 1, SKETCH), lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int"))
    text = scratch.table(found.select("id", "line", F.size("hs").alias("ns"), sketch.alias("sk")), "text")
    close = scratch.table(_agreeing(pairs, text.select("id", "ns", "sk"), percent), "close")
    links = scratch.table(confirmed(close, text, percent), "links")
    scratch.drop(pairs, close)
    labels = components(links, scratch)
    scratch.drop(links)
    if large.isEmpty():  # every member of a band has been compared with all others
        scratch.drop(large, text)
        return labels.withColumnRenamed("node", "id")
    rest = unsettled(large, labels, text, percent, scratch)
    more = scratch.table(confirmed(rest.select("u", "v"), text, percent).join(rest, ["u", "v"]).select("cu", "cv").distinct(), "more")
    scratch.drop(large, text, rest)
    if more.isEmpty():
        return labels.withColumnRenamed("node", "id")
    joined = components(more, scratch, "cu", "cv").select(F.col("node").alias("component"), F.col("component").alias("_new"))
    own = joined.select(F.col("component").alias("node"), F.col("component"))  # also those without a label so far
    return labels.unionByName(own).distinct().join(joined, "component", "left").select(F.col("node").alias("id"), F.coalesce("_new", "component").alias("component"))


def line_classes(text: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, h1, h2, place, copies, vals): a row for each distinct line; the more copies, the smaller its number."""
    hashed = signed(text.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line")))
    # the signature follows from the line, so any of a class's rows has it
    per_line = hashed.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "pos")).alias("place"), F.count("*").alias("copies"), F.first("vals").alias("vals"))
    fewer = 31 - F.least(F.lit(31), F.floor(F.log2("copies")))
    return scratch.table(per_line.withColumn("id", F.shiftleft(fewer.cast("long"), 55).bitwiseOR(F.monotonically_increasing_id())), "classes")


def removed_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc, row, pos): every line that is not the first of its component."""
    if percent < 80:
        raise ValueError("signatures cover similarities from 80 % on")
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    text = lines(docs, id_col, text_col)
    classes = line_classes(text, scratch)

    def text_of(ids: DataFrame) -> DataFrame:
        places = classes.join(ids, "id").select("id", "place.*")
        return maybe_in(text, "doc", places.select("doc")).join(places, ["doc", "row", "pos"]).select("id", "line")

    named = classes.select("id", "h1", "h2", "place", "copies")
    final = line_components(classes, text_of, percent, scratch)
    linked = scratch.table(named.join(final, "id"), "linked")
    least = linked.groupBy("component").agg(F.min("place").alias("first"))
    firsts = linked.join(least, "component").select("h1", "h2", "first")
    alone = named.where("copies > 1").join(final.select("id"), "id", "left_anti").select("h1", "h2", F.col("place").alias("first"))
    repeated = scratch.table(firsts.unionByName(alone), "repeated")
    scratch.drop(classes, linked)
    occurrences = text.select("doc", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    gone = maybe_in(occurrences, "h1", repeated.select("h1")).join(repeated, ["h1", "h2"])
    return gone.where(F.struct("doc", "row", "pos") != F.col("first")).select("doc", "row", "pos")


def _repeats(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(_i, _r, _n): ids and text hashes that several rows have."""
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_i"), F.xxhash64(text_col).alias("_r"))
    return scratch.table(named.groupBy("_i", "_r").agg(F.count("*").alias("_n")).where("_n > 1"), "repeats")


def line_report(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row: which lines go (counted from 0)."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    split = F.split(text_col, "\n")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.coalesce(F.size(split), F.lit(0)).alias("n"), split.alias("parts"))
    gone = removed_lines(docs, percent, id_col, text_col, scratch).groupBy("doc", "row").agg(F.array_sort(F.collect_list("pos")).alias("removed"))
    gone = gone.withColumnRenamed("doc", "doc_id")
    repeats = _repeats(docs, id_col, text_col, scratch)
    if repeats.isEmpty():
        out = rows.drop("parts").join(gone, ["doc_id", "row"], "left")
    else:  # of rows that are the same document, one has its lines and the others have none
        twice = repeats.select(F.col("_i").alias("doc_id"), F.col("_r").alias("row"), "_n")
        marked = rows.join(twice, ["doc_id", "row"], "left")
        texts = F.transform(F.filter(F.transform("parts", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: z.x.rlike("\\S")), lambda z: z.i)
        one = marked.where("_n is not null").groupBy("doc_id", "row").agg(F.first("n").alias("n"), F.first(texts).alias("filled"), F.first("_n").alias("_n"))
        others = one.select("doc_id", "row", "n", "filled", F.explode(F.sequence(F.lit(2), F.col("_n").cast("int"))))
        once = marked.where("_n is null").select("doc_id", "row", "n").unionByName(one.select("doc_id", "row", "n"))
        out = once.join(gone, ["doc_id", "row"], "left").unionByName(others.select("doc_id", "row", "n", F.col("filled").alias("removed")))
    staged = out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return staged.select("doc_id", F.greatest("n", F.lit(0)).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def without_duplicate_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the kept lines only, all columns; rows that lose every line go."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    per_row = removed_lines(docs, percent, id_col, text_col, scratch).groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_list("pos").alias("_removed"))
    repeats = _repeats(docs, id_col, text_col, scratch)
    columns, rows = docs.columns, docs
    if not repeats.isEmpty():
        marked = docs.join(repeats, (F.col(id_col).cast("long") == F.col("_i")) & (F.xxhash64(F.col(text_col)) == F.col("_r")), "left")
        one = marked.where("_i is not null").groupBy("_i", "_r").agg(F.first(F.struct(*[docs[c] for c in columns])).alias("_one")).select("_one.*")
        rows = marked.where("_i is null").select(*[docs[c] for c in columns]).unionByName(one)
    marked = rows.join(per_row, (F.col(id_col).cast("long") == F.col("_doc")) & (F.xxhash64(F.col(text_col)) == F.col("_row")), "left")
    kept = F.filter(F.split(text_col, "\n"), lambda line, i: ~F.array_contains("_removed", i))
    out = marked.withColumn("_kept", F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col("_removed").isNull() | F.col("_kept").rlike("\\S"))
    return out.withColumn(text_col, F.col("_kept")).select(columns)
