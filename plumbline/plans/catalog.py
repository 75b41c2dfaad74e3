"""Registered queries of the evaluation operators over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import audit, bm25, chunkers, coerce, facts, gateway, generation, latency, logprobs, mutate, retrieval, rules, runner, scorers
from plumbline.sources import samples
from plumbline.streaming import counters

#: How much further on (around the table) the document is that others are checked against.
NEXT = 20
NODES = ["node-a", "node-b", "node-c"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark item they are held against (the one of this rank among all), and five entities of it."""
    rank = (F.row_number().over(Window.orderBy("item_id")) - 1).alias("_rank")
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"), rank)
    n = items.count()
    long = F.slice(F.array_distinct(F.regexp_extract_all("gold", F.lit("[A-Za-z]{6,}"), F.lit(0))), 1, 5)
    return _t(spark, sf_dir, "documents").join(items.withColumn("entities", long), F.pmod("doc_id", F.lit(max(n, 1))) == F.col("_rank")).drop("_rank")


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS if w.isascii())
_TERMS = f"list_filter(list_distinct(list_transform(regexp_extract_all({{0}}, '[A-Za-z]+|[0-9]+(?:\\.[0-9]+)?%?'), lambda w: lower(w))), lambda w: w NOT IN ({_STOP}))"
_MATCH = "lower(regexp_replace({0}, '\\s+', '', 'g'))"
_GRADED = f"""graded AS (
    SELECT d.*, b.text AS gold, list_distinct(regexp_extract_all(b.text, '[A-Za-z]{{6,}}')) AS unordered, b.item_id,
           list_filter(regexp_extract_all(b.text, '[A-Za-z]{{6,}}'), lambda w, i: list_position(regexp_extract_all(b.text, '[A-Za-z]{{6,}}'), w) = i)[1:5] AS entities
    FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS items FROM benchmark) b ON d.doc_id % b.items = b.place
)"""
_RECALL = f"""round_even(1 - len(list_filter({_TERMS.format('gold')}, lambda w: NOT list_contains({_TERMS.format('text')}, w))) / len({_TERMS.format('gold')}), 4)"""
_MEAN = "floor((2 * sum(CAST(round({0} * 10000) AS BIGINT)) + count(*)) / (2 * count(*))) / 10000"
_COMPLETE = f"""round_even(len(list_filter(entities, lambda e: contains({_MATCH.format('text')}, lower(e)))) / len(entities), 4)"""


@query(f"WITH {_GRADED} SELECT doc_id, item_id, {_RECALL} AS recall, {_RECALL} >= 0.8 AS passed FROM graded")
def q01_context_recall(spark, sf_dir):
    got = scorers.recall_score(F.col("gold"), F.col("text"))
    return _graded(spark, sf_dir).select("doc_id", "item_id", got.alias("recall")).withColumn("passed", F.col("recall") >= 0.8)


@query(f"WITH {_GRADED} SELECT doc_id, {_COMPLETE} AS score, {_COMPLETE} >= 0.8 AS passed FROM graded")
def q02_completeness(spark, sf_dir):
    return _graded(spark, sf_dir).select("doc_id", scorers.completeness(F.col("entities"), F.col("text")).alias("c")).select("doc_id", "c.score", "c.passed")


@query(f"WITH {_GRADED} SELECT doc_id, CAST(len(list_filter(entities, lambda e: NOT contains({_MATCH.format('text')}, lower(e)))) AS INTEGER) AS n_missing, len(list_filter(entities, lambda e: NOT contains({_MATCH.format('text')}, lower(e)))) = 0 AS passed FROM graded")
def q03_required_entities(spark, sf_dir):
    return _graded(spark, sf_dir).select("doc_id", scorers.required_entities(F.col("entities"), F.col("text")).alias("r")).select("doc_id", F.size("r.details").alias("n_missing"), "r.passed")


def _answers(spark, sf_dir) -> DataFrame:
    """Each document as an answer, with the document NEXT further on (of the same source), around the table, as its context."""
    docs = _t(spark, sf_dir, "documents")
    n = max(docs.count(), 1)
    before = F.pmod(F.col("doc_id") - NEXT, F.lit(n))
    return docs.select("doc_id", F.col("text").alias("answer")).join(docs.select(before.alias("doc_id"), F.col("text").alias("context")), "doc_id")


_ANSWERS = f"answers AS (SELECT a.doc_id, a.text AS answer, c.text AS context FROM documents a JOIN documents c ON c.doc_id = (a.doc_id + {NEXT}) % (SELECT count(*) FROM documents))"


@query(
    f"""WITH {_ANSWERS}, parts AS (
        SELECT doc_id, list_distinct(regexp_extract_all(answer, '[0-9]+(?:\\.[0-9]+)?%?')) AS numbers,
               list_transform(list_filter(regexp_extract_all(context, '[0-9.]+(?:\\s*%)?'), lambda t: regexp_full_match(t, '[0-9]+(\\.[0-9]+)?(\\s*%)?')), lambda t: regexp_replace(t, '\\s', '', 'g')) AS bounded
        FROM answers)
    SELECT doc_id, CAST(len(numbers) AS INTEGER) AS n_numbers,
           CAST(len(list_filter(numbers, lambda n: NOT (list_contains(bounded, n) OR list_contains(bounded, n || '%')))) AS INTEGER) AS n_unsupported
    FROM parts"""
)
def q04_faithfulness_numbers(spark, sf_dir):
    pairs = _answers(spark, sf_dir).select("doc_id", T.extract_numbers(F.col("answer")).alias("numbers"), T.bounded_numbers(T.normalize_text(F.col("context"))).alias("bounded"))
    return pairs.select("doc_id", F.size("numbers").alias("n_numbers"), F.size(T.unsupported_numbers(F.col("numbers"), F.col("bounded"))).alias("n_unsupported"))


_NUMBERS = "list_distinct(regexp_extract_all({0}, '[0-9]+(?:\\.[0-9]+)?%?'))"
_BOUNDED = "list_transform(list_filter(regexp_extract_all({0}, '[0-9.]+(?:\\s*%)?'), lambda t: regexp_full_match(t, '[0-9]+(\\.[0-9]+)?(\\s*%)?')), lambda t: regexp_replace(t, '\\s', '', 'g'))"


@query(
    f"""WITH {_GRADED}, r AS (SELECT source, {_RECALL} AS recall, {_COMPLETE} AS complete, {_NUMBERS.format('gold')} AS numbers, {_BOUNDED.format('text')} AS bounded FROM graded),
    f AS (SELECT *, len(list_filter(numbers, lambda n: NOT (list_contains(bounded, n) OR list_contains(bounded, n || '%')))) = 0 AS faithful FROM r)
    SELECT source, count(*) AS total, count(*) FILTER (recall >= 0.8 AND complete >= 0.8 AND faithful) AS passed, {_MEAN.format('recall')} AS avg_context_recall, {_MEAN.format('complete')} AS avg_completeness,
           {_MEAN.format('CAST(faithful AS INTEGER)')} AS faithfulness_pass_rate FROM f GROUP BY source"""
)
def q05_summary_by_source(spark, sf_dir):
    """The item as an answer from the document: recall, completeness, faithfulness and passes by source."""
    staged = _graded(spark, sf_dir).select("source", "gold", "entities", "text")
    scored = staged.select(
        "source", scorers.recall_score(F.col("gold"), F.col("text")).alias("context_recall_score"), scorers.completeness(F.col("entities"), F.col("text"))["score"].alias("completeness_score"),
        scorers.faithfulness(F.col("text"), F.col("gold"))["passed"].alias("faithfulness_pass"),
    )
    results = scored.withColumn("case_passed", scorers.case_passed(F.col("context_recall_score"), F.col("completeness_score"), F.col("faithfulness_pass")))
    return runner.summarize(results, "source").select("source", "total", "passed", "avg_context_recall", "avg_completeness", "faithfulness_pass_rate")


_TOKENS = "tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL)"


@query(f"WITH {_TOKENS} SELECT term, count(*) AS df FROM tf GROUP BY term")
def q06_doc_freq(spark, sf_dir):
    return bm25.fit(_t(spark, sf_dir, "documents")).idf.select("term", "df")


@query(f"WITH {_TOKENS}, n AS (SELECT count(*) AS n FROM documents) SELECT term, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM tf, n GROUP BY term, n")
def q07_idf(spark, sf_dir):
    return bm25.fit(_t(spark, sf_dir, "documents")).idf.select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TOKENS} SELECT d.doc_id, CAST(count(tf.term) AS INTEGER) AS len FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id")
def q08_doc_len(spark, sf_dir):
    return bm25.fit(_t(spark, sf_dir, "documents")).lengths.select(F.col("doc").alias("doc_id"), "len")


_BM25 = f"""{_TOKENS}, lens AS (SELECT d.doc_id, count(tf.term) AS len FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id),
    totals AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    asked AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark),
    scored AS (
        SELECT query_id, tf.doc_id AS doc, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))) AS score
        FROM asked JOIN tf USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), totals GROUP BY ALL),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS INTEGER) AS rank FROM scored)"""


def _bm25_hits(spark, sf_dir, k: int, **options) -> DataFrame:
    index = bm25.fit(_t(spark, sf_dir, "documents"))
    return bm25.top_k(bm25.scores(index, _t(spark, sf_dir, "benchmark"), "item_id", "text", **options), k)


@query(f"WITH {_BM25} SELECT query_id, rank, doc, round(score, 5) AS score FROM ranked WHERE rank <= 10")
def q09_bm25_topk(spark, sf_dir):
    return _bm25_hits(spark, sf_dir, 10).select("query_id", "rank", "doc", F.round("score", 5).alias("score"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, r.vec_id AS doc, list_cosine_similarity(q.e, r.e) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, rank, doc, round(score, 6) AS score FROM ranked WHERE rank <= 5"""
)
def q10_vector_topk(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.cosine_top_k(rows, rows.where("id % 20 = 0"), 5).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_BM25}, flat AS (
        SELECT query_id, tf.doc_id AS doc, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5)) AS score
        FROM asked JOIN tf USING (term) JOIN dfs USING (term), totals GROUP BY ALL),
    flat_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM flat),
    lists AS (SELECT query_id, doc, rank, 0 AS list FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, doc, rank, 1 FROM flat_ranked WHERE rank <= 10),
    fused AS (SELECT query_id, doc, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS seen FROM lists GROUP BY ALL),
    final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, doc) AS INTEGER) AS rank FROM fused)
    SELECT query_id, rank, doc, round(score, 6) AS score FROM final WHERE rank <= 5"""
)
def q11_rrf(spark, sf_dir):
    index = bm25.fit(_t(spark, sf_dir, "documents"))
    asked = _t(spark, sf_dir, "benchmark")
    lists = [bm25.top_k(bm25.scores(index, asked, "item_id", "text", b=b), 10) for b in (0.75, 0.0)]
    return retrieval.fuse(*lists, k=5).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_BM25}, blocks AS (SELECT query_id, string_agg(d.text, chr(10)) AS block FROM ranked r JOIN documents d ON r.doc = d.doc_id WHERE rank <= 3 GROUP BY query_id),
    both_ AS (SELECT b.item_id AS query_id, {_TERMS.format('b.text')} AS wanted, {_TERMS.format('k.block')} AS have FROM benchmark b JOIN blocks k ON b.item_id = k.query_id)
    SELECT query_id, round_even(len(list_filter(wanted, lambda w: list_contains(have, w))) / len(wanted), 4) AS score FROM both_"""
)
def q12_hit_at_k(spark, sf_dir):
    hits = _bm25_hits(spark, sf_dir, 3).join(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), "doc")
    blocks = hits.groupBy("query_id").agg(F.collect_list("content").alias("blocks"))
    both = blocks.join(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("gold")), "query_id")
    return both.select("query_id", scorers.hit_at_k(F.col("gold"), F.col("blocks"))["score"].alias("score"))


def _paragraphs(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query()
def q13_recursive_chunks(spark, sf_dir):
    cut = chunkers.recursive_chunks(_paragraphs(spark, sf_dir), 300, 50)
    return cut.select("chunk_id", "doc_id", "idx", F.char_length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query(
    """WITH lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l, ' \t\r\n') <> '') AS ls FROM documents),
    numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS idx FROM lines),
    cells AS (SELECT *, list_filter(list_transform(string_split(replace(line, chr(9), ','), ','), lambda c: trim(c)), lambda c: c <> '') AS cs FROM numbered)
    SELECT doc_id || '_f' || idx AS chunk_id, doc_id, CAST(idx AS INTEGER) AS idx, md5(CASE WHEN len(cs) >= 2 THEN cs[1] || '为' || array_to_string(cs[2:], '，') ELSE line END) AS content_md5 FROM cells"""
)
def q14_table_rows(spark, sf_dir):
    return chunkers.table_chunks(_t(spark, sf_dir, "documents")).select("chunk_id", "doc_id", "idx", F.md5("content").alias("content_md5"))


@query("SELECT doc_id || '_l0' AS chunk_id, doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))) AS content_md5 FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''")
def q15_legal_sections(spark, sf_dir):
    return chunkers.legal_chunks(_t(spark, sf_dir, "documents")).select("chunk_id", "doc_id", F.md5("content").alias("content_md5"))


@query(
    """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ps FROM documents),
    k AS (SELECT doc_id, ps, list_filter(ps, lambda l: regexp_matches(l, '[0-9]')) AS kept FROM p), f AS (SELECT doc_id, CASE WHEN len(kept) > 0 THEN kept ELSE ps END AS r FROM k)
    SELECT doc_id, CAST(len(r) AS INTEGER) AS n_kept, md5(array_to_string(r, chr(10))) AS kept_md5 FROM f"""
)
def q16_relevant_paragraphs(spark, sf_dir):
    kept = _paragraphs(spark, sf_dir).select("doc_id", T.relevant_paragraphs(F.lit(""), F.col("text")).alias("r"))
    return kept.select("doc_id", F.size("r").alias("n_kept"), F.md5(F.array_join("r", "\n")).alias("kept_md5"))


_LONG = "regexp_extract_all(text, '[A-Za-z]{8,}')"


@query(f"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda s: {_MATCH.format('s')}), lambda s: contains(s, lower({_LONG}[1])) AND contains(s, lower({_LONG}[2])))) > 0 AS together FROM documents WHERE len({_LONG}) >= 2")
def q17_cooccurrence(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).where(F.size("w") >= 2)
    return words.select("doc_id", T.co_occur(F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.col("text")).alias("together"))


_UNITS = "(\\d+(?:\\.\\d+)?)\\s*(亿元|万元|亿|万|元|千万|百万|billion|million|thousand|k|m|b)?"


@query(
    f"""WITH u AS (SELECT doc_id, regexp_extract_all(lower(text), '{_UNITS}', 1) AS v, regexp_extract_all(lower(text), '{_UNITS}', 2) AS s FROM documents),
    e AS (SELECT doc_id, unnest(v)::DOUBLE AS v, unnest(s) AS s FROM u),
    a AS (SELECT doc_id, v * CASE s WHEN 'billion' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1 END AS amount FROM e)
    SELECT doc_id, count(*) AS n, max(amount) AS largest, min(amount) AS smallest FROM a GROUP BY doc_id"""
)
def q18_unit_amounts(spark, sf_dir):
    each = _t(spark, sf_dir, "documents").select("doc_id", F.explode(T.amounts(F.col("text"))).alias("amount"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("amount").alias("largest"), F.min("amount").alias("smallest"))


def _typed_facts(spark, sf_dir) -> DataFrame:
    """A categorical and a condition fact from each document, against the next one of its source."""
    words = _answers(spark, sf_dir).withColumn("w", F.coalesce(F.get(F.regexp_extract_all("answer", F.lit("[A-Za-z]{8,}"), F.lit(0)), F.lit(0)), F.lit("")))
    make = lambda kind, negative: F.struct(F.lit("").alias("subject"), F.lit("").alias("predicate"), F.col("w").alias("object_value"), F.lit(kind).alias("fact_type"), F.lit(negative).alias("is_negative"), F.lit(None).cast("string").alias("source_text"))
    return words.withColumn("fact", F.explode(F.array(make("categorical", False), make("condition", True))))


@query(
    f"""WITH {_ANSWERS}, w AS (SELECT doc_id, coalesce(regexp_extract_all(answer, '[A-Za-z]{{8,}}')[1], '') AS w, {_MATCH.format('context')} AS c FROM answers),
    f AS (SELECT 'CATEGORY_NOT_FOUND' AS code, doc_id FROM w WHERE w <> '' AND NOT contains(c, lower(w))
          UNION ALL SELECT 'CONDITION_VALUE_NOT_FOUND', doc_id FROM w WHERE w <> '' AND NOT contains(c, lower(w)) UNION ALL SELECT 'NEGATION_MISSING', doc_id FROM w)
    SELECT code, count(*) AS n FROM f GROUP BY code"""
)
def q19_rule_matrix(spark, sf_dir):
    found = _typed_facts(spark, sf_dir).select("doc_id", F.explode(rules.RuleMatrix().verify(F.col("fact"), F.col("context"))).alias("f"))
    return found.groupBy(F.col("f.code").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS text_md5, count(*) AS copies, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def q20_audit_copies(spark, sf_dir):
    return audit.copies(_t(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumnRenamed("first", "first_doc")


@query(
    """WITH f AS (SELECT d.doc_id, l.quality IS NULL AS bad, d.n_chars > 300 AS hit, coalesce(l.quality = 1, false) AS oracle, d.lang = 'en' AS gold, coalesce(l.toxic = 0, false) AS actual FROM documents d LEFT JOIN labels l USING (doc_id)),
    c AS (SELECT CASE WHEN bad THEN 'data' WHEN NOT hit THEN 'retrieval_source_miss' WHEN NOT oracle THEN 'generation_with_gold_context' WHEN NOT gold THEN 'context_contamination' WHEN NOT actual THEN 'generation_with_retrieved_context' ELSE 'pass' END AS classification FROM f)
    SELECT classification, count(*) AS n FROM c GROUP BY classification"""
)
def q21_classify(spark, sf_dir):
    both = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = audit.classify_failure(F.col("quality").isNull(), F.col("n_chars") > 300, yes(F.col("quality") == 1), yes(F.col("toxic") == 0), F.col("lang") == "en")
    return both.select(kind.alias("classification")).groupBy("classification").agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT doc_id, text, regexp_extract(text, '[0-9]+') AS d, regexp_extract_all(text, '[A-Za-z]{8,}')[1] AS w FROM documents WHERE regexp_matches(text, '[0-9]')),
    m AS (SELECT *, strpos(text, d) AS p, len(d) - len(rtrim(d, '9')) AS nines, rtrim(d, '9') AS head FROM n),
    u AS (SELECT *, CASE WHEN head = '' THEN '1' ELSE substr(regexp_replace(head, '^0+(.)', '\\1'), 1, len(regexp_replace(head, '^0+(.)', '\\1')) - 1) || CAST(CAST(right(head, 1) AS INTEGER) + 1 AS VARCHAR) END || repeat('0', nines) AS e FROM m)
    SELECT doc_id, md5(substr(text, 1, p - 1) || e || substr(text, p + length(d))) AS raised_md5, md5(CASE WHEN w IS NULL THEN text ELSE replace(text, w, '') END) AS dropped_md5,
           md5(rtrim(CASE WHEN contains(text, ' the ') THEN split_part(text, ' the ', 1) ELSE text || '!' END, CASE WHEN contains(text, ' the ') THEN '，；。 ' ELSE '!' END)) AS cut_md5, md5(text || '10%') AS added_md5 FROM u"""
)
def q22_mutations(spark, sf_dir):
    text = F.col("text")
    found = _t(spark, sf_dir, "documents").where(mutate.first_number(text) != "").withColumn("w", F.get(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0)), F.lit(0)))
    cut = F.when(F.contains(text, F.lit(" the ")), mutate.condition_dropped(text, (" the ",))).otherwise(F.rtrim(F.concat(text, F.lit("!")), F.lit("!")))
    return found.select("doc_id", F.md5(mutate.number_raised(text)).alias("raised_md5"), F.md5(mutate.entity_dropped(text, F.col("w"))).alias("dropped_md5"), F.md5(cut).alias("cut_md5"), F.md5(mutate.claim_added(text, "10%")).alias("added_md5"))


_FOUR_RING = "ring AS (SELECT md5(node || '#VN' || i) AS h, node FROM (SELECT unnest(['node-b', 'node-c', 'node-d']) AS node), range(64) r(i))"
_FINGERPRINT = "substr(sha256(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 1500)), 1, 16)"


@query(f"SELECT doc_id, {_FINGERPRINT} AS fingerprint FROM documents")
def q23_fingerprint(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", gateway.prefix_fingerprint(F.col("text")).alias("fingerprint"))


_RING = "ring AS (SELECT md5(node || '#VN' || i) AS h, node FROM (SELECT unnest(['node-a', 'node-b', 'node-c']) AS node), range(64) r(i))"


@query(
    f"""WITH {_RING}, keys AS (SELECT doc_id, {_FINGERPRINT} AS fp FROM documents)
    SELECT doc_id, coalesce((SELECT min_by(node, h) FROM ring WHERE h > md5(fp)), (SELECT min_by(node, h) FROM ring)) AS node FROM keys"""
)
def q24_ring_assign(spark, sf_dir):
    keys = _t(spark, sf_dir, "documents").select("doc_id", gateway.prefix_fingerprint(F.col("text")).alias("fp"))
    return gateway.assign(keys, gateway.ring(spark, NODES), "fp").select("doc_id", "node")


@query(
    f"""WITH {_RING}, keys AS (SELECT doc_id, {_FINGERPRINT} AS fp FROM documents),
    p AS (SELECT doc_id, fp, coalesce((SELECT min_by(node, h) FROM ring WHERE h > md5(fp)), (SELECT min_by(node, h) FROM ring)) AS primary_node FROM keys),
    t AS (SELECT *, CASE WHEN primary_node <> 'node-b' THEN primary_node ELSE coalesce((SELECT min_by(node, h) FROM ring WHERE h > md5(fp) AND node <> 'node-b'), (SELECT min_by(node, h) FROM ring WHERE node <> 'node-b')) END AS target_node FROM p)
    SELECT doc_id, primary_node, target_node, primary_node <> target_node AS is_replicated FROM t"""
)
def q25_route(spark, sf_dir):
    load = spark.createDataFrame([("node-a", 1, 8), ("node-b", 8, 8), ("node-c", 0, 8)], "node string, active int, cap int")
    asked = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return gateway.route(asked, gateway.ring(spark, NODES), load).select("doc_id", "primary_node", "target_node", "is_replicated")


def _requests(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "rejected").otherwise("ok")
    return _t(spark, sf_dir, "events").select("user_id", kind.alias("status"), (F.col("value") / 100).alias("ttft"), (F.col("value") / 10).alias("e2e"), (F.col("event_type") == "click").alias("replicated"))


@query(
    """SELECT count(*) AS total_requests, count(*) FILTER (ok) AS successful_requests, count(*) FILTER (event_type = 'signup') AS rejected_shedding, count(*) FILTER (event_type = 'error') AS upstream_errors,
    count(*) FILTER (event_type = 'click') AS cache_replications, count(*) FILTER (ok AND value > 0) AS ttft_count, round(sum(value / 100) FILTER (ok AND value > 0), 3) AS ttft_sum, round(max(value / 10) FILTER (ok), 6) AS e2e_max
    FROM (SELECT *, event_type NOT IN ('error', 'signup') AS ok FROM events)"""
)
def q26_gateway_metrics(spark, sf_dir):
    got = gateway.metrics(_requests(spark, sf_dir))
    return got.select("total_requests", "successful_requests", "rejected_shedding", "upstream_errors", "cache_replications", "ttft_count", F.round("ttft_sum", 3).alias("ttft_sum"), F.round("e2e_max", 6).alias("e2e_max"))


@query(f"WITH h AS (SELECT {_FINGERPRINT} AS fingerprint, count(*) AS hits FROM documents GROUP BY 1) SELECT fingerprint, hits FROM h ORDER BY hits DESC, fingerprint LIMIT 5")
def q27_top_prefixes(spark, sf_dir):
    keys = _t(spark, sf_dir, "documents").select(gateway.prefix_fingerprint(F.col("text")).alias("fingerprint"))
    return gateway.prefix_hits(keys).orderBy(F.desc("hits"), "fingerprint").limit(5)


_ITL = "itl AS (SELECT user_id, event_id, row_number() OVER w AS seq, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000.0 AS itl_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"WITH {_ITL} SELECT user_id, count(*) AS n, round(avg(itl_ms), 3) AS mean, round(max(itl_ms), 3) AS max, round(quantile_cont(itl_ms, 0.5), 1) AS p50, round(quantile_cont(itl_ms, 0.95), 1) AS p95, round(quantile_cont(itl_ms, 0.99), 1) AS p99 FROM itl WHERE itl_ms IS NOT NULL GROUP BY user_id")
def q28_itl_percentiles(spark, sf_dir):
    got = latency.percentiles(latency.gaps(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id"), "itl_ms", "user_id")
    return got.select("user_id", "n", *[F.round(c, 3).alias(c) for c in ("mean", "max")], *[F.round(c, 1).alias(c) for c in ("p50", "p95", "p99")])


@query(f"WITH {_ITL}, r AS (SELECT user_id, itl_ms, row_number() OVER (PARTITION BY user_id ORDER BY itl_ms) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM itl WHERE itl_ms IS NOT NULL) SELECT user_id, round(itl_ms, 3) AS p90_index FROM r WHERE r - 1 = least(floor(n * 0.9), n - 1)")
def q29_index_percentile(spark, sf_dir):
    rows = latency.gaps(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return latency.percentile_by_index(rows, "itl_ms", 0.9, "user_id").withColumn("p90_index", F.round("p90_index", 3))


@query(f"WITH {_ITL} SELECT CASE WHEN seq <= 10 THEN 'pre' WHEN seq <= 35 THEN 'in' ELSE 'post' END AS phase, count(*) AS n, round(avg(itl_ms), 2) AS mean, round(max(itl_ms), 3) AS largest FROM itl WHERE itl_ms IS NOT NULL GROUP BY 1")
def q30_phases(spark, sf_dir):
    rows = latency.phases(latency.gaps(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id")).where("itl_ms is not null")
    return rows.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg("itl_ms"), 2).alias("mean"), F.round(F.max("itl_ms"), 3).alias("largest"))


def _event_tokens(spark, sf_dir) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    token = F.concat(F.col("event_type"), F.lit(" "), F.format_string("%d", F.floor("value")), F.lit(" "))
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("response_id"), F.row_number().over(by).alias("pos"), token.alias("token"), (-F.col("value") / 100).alias("logprob"))


@query("SELECT user_id AS response_id, count(*) AS n, round(exp(-avg(-value / 100)), 6) AS ppl, round(avg(exp(-value / 100)), 6) AS avg_confidence FROM events GROUP BY user_id")
def q31_perplexity(spark, sf_dir):
    return logprobs.confidence(_event_tokens(spark, sf_dir)).select("response_id", "n", F.round("ppl", 6).alias("ppl"), F.round("avg_confidence", 6).alias("avg_confidence"))


@query(
    """WITH t AS (SELECT user_id, row_number() OVER w AS pos, length(event_type || ' ' || CAST(floor(value) AS BIGINT) || ' ') AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id AS response_id, max(s) AS last_start, max(s + n) AS n_chars FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM t) GROUP BY user_id"""
)
def q32_token_offsets(spark, sf_dir):
    placed = logprobs.offsets(_event_tokens(spark, sf_dir))
    return placed.groupBy("response_id").agg(F.max("start").alias("last_start"), F.max("end").alias("n_chars"))


@query(
    """WITH m AS (SELECT user_id, count(*) FILTER (exp(-value / 100) < 0.5) AS n_flagged, exp(avg(value / 100)) AS ppl FROM events GROUP BY user_id)
    SELECT user_id AS response_id, CAST(n_flagged AS INTEGER) AS n_flagged, round(ppl, 2) AS overall_ppl, n_flagged > 0 OR ppl > 8 AS has_risk FROM m"""
)
def q33_logprob_report(spark, sf_dir):
    tokens = _event_tokens(spark, sf_dir)
    asked = tokens.select("response_id").distinct().withColumns({"critical_entities": F.array().cast("array<string>"), "context": F.lit(None).cast("string")})
    return logprobs.analyze(tokens, asked).select("response_id", "n_flagged", "overall_ppl", "has_risk")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, len(list_filter(json_keys(props), lambda x: x <> 'k'))::INTEGER AS n_unknown, json_extract_string(props, '$.k') IS NOT NULL AND TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL AS violation FROM events")
def q34_json_coerce(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", coerce.typed_field(F.col("props"), "k", "int").alias("f"), F.size(coerce.unknown_keys(F.col("props"), ("k",))).alias("n_unknown"))
    return rows.select("event_id", F.col("f.value").alias("k"), "n_unknown", F.col("f.violation").alias("violation"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, max(value) AS largest FROM events GROUP BY event_type")
def q35_streaming_counters(spark, sf_dir):
    return counters.drain(counters.running(counters.stream(spark, sf_dir, "events"))).select("event_type", "n", F.round("total", 3).alias("total"), "largest")


@query()
def q36_admission(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("req_id"), (latency.micros("ts") / 1e6).alias("at"), (F.col("value") * 3600).alias("service"))
    return gateway.admission(events, "user_id", active=2, queue=4)


@query()
def q37_demo(spark, sf_dir):
    return runner.evaluate(runner.with_responses(samples.builtin_samples(spark), samples.preset_responses(spark)))


@query()
def q38_generated_audit(spark, sf_dir):
    return audit.issues(samples.generated_samples(spark))


@query()
def q39_quality_baseline(spark, sf_dir):
    rows = samples.generated_samples(spark).withColumn("ordinal", F.monotonically_increasing_id())
    return audit.baseline(rows)[2]


@query(
    """WITH u AS (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text AS a FROM conversations WHERE role = 'assistant'),
    p AS (SELECT u.conv_id, u.turn, q, a FROM u JOIN a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1),
    s AS (SELECT conv_id, turn, """
    + _TERMS.format("q")
    + " AS wanted, "
    + _TERMS.format("a")
    + """ AS have FROM p)
    SELECT conv_id, turn, CASE WHEN len(wanted) = 0 THEN 1.0 ELSE round_even(1 - len(list_filter(wanted, lambda w: NOT list_contains(have, w))) / len(wanted), 4) END AS recall FROM s"""
)
def q40_conversation_recall(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", scorers.recall_score(F.col("q"), F.col("a")).alias("recall"))


@query()
def q41_controlled_pipeline(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("doc_id", F.col("answer").alias("question"), F.replace("context", F.lit("\n"), F.lit("\n\n")).alias("context"), F.array().cast("array<string>").alias("expected_entities"))
    return facts.run_pipeline(rows).select("doc_id", "tier1_final_passed", F.size("atomic_facts").alias("n_facts"), F.size("findings").alias("n_findings"), F.md5("answer").alias("answer_md5"))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg_ttft, max(value) AS max_ttft, round(sum(user_id) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) AS tokens_per_s FROM events GROUP BY event_type"""
)
def q42_throughput(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_type", (latency.micros("ts") / 1e6).alias("start"), (latency.micros("ts") / 1e6).alias("end"), F.col("value").alias("ttft"), F.col("user_id").alias("tokens"))
    return latency.throughput(rows, "event_type").select("event_type", "n", F.round("avg_ttft", 4).alias("avg_ttft"), "max_ttft", F.round("tokens_per_s", 6).alias("tokens_per_s"))


@query("SELECT user_id, min_by(value, event_id) AS baseline, max(value) AS peak, round(max(value) - min_by(value, event_id), 6) AS delta FROM events GROUP BY user_id")
def q43_memory_delta(spark, sf_dir):
    return latency.memory_delta(_t(spark, sf_dir, "events"), "event_id", "value", "user_id").withColumn("delta", F.round("delta", 6))


@query("WITH m AS (SELECT avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events) SELECT round(a, 6) AS first, round(b, 6) AS second, round(a / b, 6) AS speed_up, round((1 - b / a) * 100, 4) AS drop_percent FROM m")
def q44_compare_groups(spark, sf_dir):
    got = latency.compare(_t(spark, sf_dir, "events"), "event_type", "view", "click", "value")
    return got.select(F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), F.round("speed_up", 6).alias("speed_up"), F.round("drop_percent", 4).alias("drop_percent"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def q45_streaming_windows(spark, sf_dir):
    """Tumbling windows of a stream in event time (an extension); all windows, as the stream is read to its end."""
    rows = counters.drain(counters.windowed(counters.stream(spark, sf_dir, "events"), late="3650 days"), "update")
    return rows.groupBy(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 3).alias("total"))


@query(
    f"""WITH {_GRADED}, r AS (SELECT lang, source, {_RECALL} AS recall FROM graded)
    SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, floor((2 * sum(CAST(round(recall * 10000) AS BIGINT)) + count(*)) / (2 * count(*))) / 10000 AS avg_recall FROM r GROUP BY ROLLUP (lang, source)"""
)
def q46_recall_rollup(spark, sf_dir):
    rows = _graded(spark, sf_dir).select("lang", "source", scorers.recall_score(F.col("gold"), F.col("text")).alias("recall"))
    return rows.rollup("lang", "source").agg(F.count("*").alias("n"), runner.mean_of_scores("recall").alias("avg_recall")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "avg_recall")


@query()
def q47_source_scope(spark, sf_dir):
    """BM25 hits scoped to the source of the best hit."""
    docs = _t(spark, sf_dir, "documents")
    hits = _bm25_hits(spark, sf_dir, 3).join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("content"), F.col("source").alias("scope_id")), "doc")
    hits = hits.select("query_id", "rank", "content", F.col("doc").cast("string").alias("doc_id"), F.col("doc").cast("string").alias("chunk_id"), "scope_id")
    asked = hits.where("rank = 1").select("query_id", F.lit("").alias("query"), F.array("scope_id").alias("sources"))
    return retrieval.select_context(hits, asked).select("query_id", "error_code", F.md5("context").alias("context_md5"), "selected_sources", "discarded_sources")


_COSINE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    near AS (SELECT q.vec_id AS query_id, r.vec_id AS doc, list_cosine_similarity(q.e, r.e) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
    near_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM near)"""


@query(
    f"""WITH {_BM25}, {_COSINE},
    lists AS (SELECT query_id, doc, rank, 0 AS list FROM ranked WHERE rank <= 8 UNION ALL SELECT query_id, doc, rank, 1 FROM near_ranked WHERE rank <= 8),
    fused AS (SELECT query_id, doc, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS seen FROM lists GROUP BY ALL),
    final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, doc) AS INTEGER) AS rank FROM fused)
    SELECT query_id, rank, doc, round(score, 6) AS score FROM final WHERE rank <= 4"""
)
def q48_hybrid(spark, sf_dir):
    """Hybrid retrieval with a vector engine over the embeddings (vector and document of one number belong together)."""
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))

    def engine(queries: DataFrame, n: int) -> DataFrame:
        asked = rows.join(queries.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
        return retrieval.cosine_top_k(rows, asked, n)

    index = bm25.fit(_t(spark, sf_dir, "documents"))
    return retrieval.hybrid(index, _t(spark, sf_dir, "benchmark"), 4, engine, query_col="item_id").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_BM25}, k AS (SELECT query_id, string_agg(d.text, chr(10) || chr(10) ORDER BY r.rank) AS context FROM ranked r JOIN documents d ON r.doc = d.doc_id WHERE rank <= 2 GROUP BY query_id),
    b AS (SELECT item_id AS query_id, {_TERMS.format('text')} AS wanted FROM benchmark), h AS (SELECT b.query_id, wanted, {_TERMS.format('coalesce(k.context, chr(32))')} AS have FROM b LEFT JOIN k USING (query_id)),
    s AS (SELECT query_id, round_even(1 - len(list_filter(wanted, lambda w: NOT list_contains(have, w))) / len(wanted), 4) AS recall FROM h)
    SELECT query_id, recall, recall >= 0.8 AS passed FROM s"""
)
def q49_retrieval_recall(spark, sf_dir):
    """Retrieval alone, by BM25, held against the items."""
    docs, asked = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    hits = retrieval.hybrid(bm25.fit(docs), asked, 2, query_col="item_id").join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), "doc")
    return retrieval.recall_at(hits, asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("gold")))


@query(
    """SELECT 'versions' AS code, source AS subject, count(DISTINCT text) AS n FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT text) > 1
    UNION ALL SELECT 'duplicate', CAST(n_chars AS VARCHAR), count(*) FROM documents GROUP BY n_chars HAVING count(*) > 1"""
)
def q50_conflicts(spark, sf_dir):
    """Sources with several texts, and lengths that several documents have."""
    docs = _t(spark, sf_dir, "documents")
    versions = audit.conflicting(docs, "source", "text").select(F.lit("versions").alias("code"), F.col("source").alias("subject"), F.col("versions").alias("n"))
    return versions.unionByName(audit.duplicate_keys(docs, "n_chars").select(F.lit("duplicate").alias("code"), F.col("n_chars").cast("string").alias("subject"), "n"))


@query(
    f"""WITH {_ANSWERS}, w AS (SELECT doc_id, regexp_extract_all(answer, '[A-Za-z]{{8,}}')[1] AS w, regexp_extract_all(context, '[A-Za-z]{{8,}}')[1] AS r, {_MATCH.format('context')} AS c FROM answers),
    v AS (SELECT doc_id, coalesce(contains(c, lower(w)), false) AND w IS NOT NULL AS ok, r IS NOT NULL AS can FROM w)
    SELECT doc_id, ok OR can AS accepted, CAST(CASE WHEN NOT ok AND can THEN 1 ELSE 0 END AS INTEGER) AS repair_count,
           CASE WHEN ok THEN 'extract>validate>decide>accept' WHEN can THEN 'extract>validate>decide>repair>revalidate>decide>accept' ELSE 'extract>validate>decide>reject' END AS trace,
           CASE WHEN doc_id % 3 = 0 THEN '未知顶层键 ''note''，已剔除' ELSE '' END AS violations FROM v"""
)
def q51_constrained_decoding(spark, sf_dir):
    """A word of the answer as a candidate fact, and one of the context as its repair; some payloads have a strange key."""
    word = lambda c: F.get(F.regexp_extract_all(c, F.lit("[A-Za-z]{8,}"), F.lit(0)), F.lit(0))
    fact = lambda w: F.array(F.struct(F.lit("").alias("subject"), F.lit("").alias("predicate"), F.coalesce(w, F.lit("")).alias("object_value"), F.lit("categorical").alias("fact_type")))
    rows = _answers(spark, sf_dir).withColumns({"w": word("answer"), "r": word("context")})
    note = F.when(F.col("doc_id") % 3 == 0, "seen")
    rows = rows.select("doc_id", "context", F.to_json(F.struct(fact(F.col("w")).alias("atomic_facts"), note.alias("note"))).alias("payload"), F.when(F.col("r").isNotNull(), F.to_json(F.struct(fact(F.col("r")).alias("atomic_facts")))).alias("repair"))
    got = generation.decode(rows, repair="repair")
    return got.select("doc_id", "accepted", "repair_count", F.array_join("trace", ">").alias("trace"), F.array_join("schema_violations", "; ").alias("violations"))


_BURST = "burst AS (SELECT *, CASE event_type WHEN 'signup' THEN 429 WHEN 'error' THEN 500 ELSE 200 END AS status FROM events)"


@query(
    f"""WITH {_BURST}, s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place FROM burst WHERE status = 200)
    SELECT count(*) AS total, count(*) FILTER (status = 200) AS served, count(*) FILTER (status = 429) AS rejected, count(*) FILTER (status = 500) AS errors, round(avg(value) FILTER (status = 429), 4) AS rejected_mean_ms,
           min(value) FILTER (status = 429) AS rejected_min_ms, max(value) FILTER (status = 429) AS rejected_max_ms, count(*) FILTER (status = 200 AND value <= 5) AS immediate, count(*) FILTER (status = 200 AND value > 5) AS queued,
           max(value) FILTER (status = 200) AS longest_wait_ms, (SELECT value FROM s WHERE place = (SELECT count(*) // 2 FROM s)) AS middle_wait_ms, false AS shed_passed, false AS queue_passed FROM burst"""
)
def q52_burst_report(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", 429).when(F.col("event_type") == "error", 500).otherwise(200)
    rows = _t(spark, sf_dir, "events").select(status.alias("status"), F.col("value").alias("latency_ms"), (F.col("value") / 1000).alias("decision_ms"), F.col("value").alias("wait_ms"))
    got = gateway.burst_report(rows, 2, 4).withColumn("rejected_mean_ms", F.round("rejected_mean_ms", 4))
    return got.select("total", "served", "rejected", "errors", "rejected_mean_ms", "rejected_min_ms", "rejected_max_ms", "immediate", "queued", "longest_wait_ms", "middle_wait_ms", "shed_passed", "queue_passed")


@query(
    f"""WITH {_BURST} SELECT user_id % 8 AS concurrency, count(*) AS total, count(*) FILTER (status = 200) AS served, max(value) AS peak_memory, round(avg(value) FILTER (status = 200), 4) AS avg_ttft,
    round(coalesce(sum(user_id) FILTER (status = 200) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 0), 6) AS tokens_per_s FROM burst GROUP BY 1"""
)
def q53_concurrency_sweep(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", 429).when(F.col("event_type") == "error", 500).otherwise(200)
    at = latency.micros("ts") / 1e6
    rows = _t(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("concurrency"), status.alias("status"), at.alias("start"), at.alias("end"), F.col("value").alias("ttft"), F.col("value").alias("e2e"), F.col("user_id").alias("tokens"), F.col("value").alias("memory"))
    return latency.sweep(rows).select("concurrency", "total", "served", "peak_memory", F.round("avg_ttft", 4).alias("avg_ttft"), F.round("tokens_per_s", 6).alias("tokens_per_s"))


@query(
    f"""WITH {_FOUR_RING}, keys AS (SELECT doc_id, {_FINGERPRINT} AS fp FROM documents)
    SELECT doc_id, coalesce((SELECT min_by(node, h) FROM ring WHERE h > md5(fp)), (SELECT min_by(node, h) FROM ring)) AS node FROM keys"""
)
def q54_ring_changes(spark, sf_dir):
    """Nodes after one has come and another has gone."""
    nodes = gateway.without_nodes(gateway.with_nodes(gateway.ring(spark, NODES), ["node-d"]), ["node-a"])
    keys = _t(spark, sf_dir, "documents").select("doc_id", gateway.prefix_fingerprint(F.col("text")).alias("fp"))
    return gateway.assign(keys, nodes, "fp").select("doc_id", "node")


@query(
    """SELECT user_id AS node, event_id, sum(d) OVER w - least(min(d2) OVER w, 0) AS active FROM (
        SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS d, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS d2 FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""".replace("sum(d) OVER w -", "d2 -")
)
def q55_active_slots(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("node"), "event_id", F.col("event_id").alias("at"), F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("delta"))
    return gateway.active_slots(events).select("node", "event_id", "active")


@query("SELECT user_id AS req_id, (min(epoch_us(ts)) - min(epoch_us(ts) - 1000 * event_id)) / 1e6 AS ttft, (max(epoch_us(ts)) - min(epoch_us(ts) - 1000 * event_id)) / 1e6 AS e2e FROM events GROUP BY user_id")
def q56_stream_times(spark, sf_dir):
    chunks = _t(spark, sf_dir, "events").select(F.col("user_id").alias("req_id"), latency.micros("ts").alias("at"), (latency.micros("ts") - 1000 * F.col("event_id")).alias("start"))
    return gateway.stream_times(chunks).select("req_id", (F.col("ttft") / 1e6).alias("ttft"), (F.col("e2e") / 1e6).alias("e2e"))


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{"atomic_facts": [{"object_value": "' || lang || '"}, 7]}' WHEN doc_id % 3 = 1 THEN 'cut: {"object_value": "' || lang || '"} {"object_value": "x"} {"object_value":' ELSE '[1' END AS answer FROM documents)
    SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n FROM r"""
)
def q57_salvaged_objects(spark, sf_dir):
    """Facts of answers that are JSON, broken JSON, and neither."""
    lang, kind = F.col("lang"), F.col("doc_id") % 3
    whole = F.concat(F.lit('{"atomic_facts": [{"object_value": "'), lang, F.lit('"}, 7]}'))
    broken = F.concat(F.lit('cut: {"object_value": "'), lang, F.lit('"} {"object_value": "x"} {"object_value":'))
    rows = _t(spark, sf_dir, "documents").withColumn("answer", F.when(kind == 0, whole).when(kind == 1, broken).otherwise("[1"))
    return rows.select("doc_id", F.size(T.salvaged_objects(F.col("answer"))).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, completeness and pass rate by source."""
    return q05_summary_by_source(spark, sf_dir)
