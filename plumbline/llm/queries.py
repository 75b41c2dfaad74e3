"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language_id, warc
from plumbline.llm.bpe_transducer import compile_lexicon, round_trip
from plumbline.llm.decontaminate import leaks
from plumbline.llm.hamming_search import sign_code, top_k
from plumbline.llm.line_dedup import line_report
from plumbline.llm.lm_scoring import score_documents
from plumbline.llm.minhash_join import near_duplicates
from plumbline.llm.repeat_spans import without_repeats
from plumbline.llm.scratch import Scratch
from plumbline.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where("id % 20 = 0"), k=10)


def op2_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizer = _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(docs, tokenizer, compile_lexicon(spark, docs, tokenizer))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"), length=100)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their markup's evidence, and documents with their source as host; both by models of the labelled ones."""
    docs, pages = _table(spark, sf_dir, "documents"), language_id.markup(_table(spark, sf_dir, "pages"))
    model = language_id.fit(docs)
    of_pages = language_id.identify(pages, model, host="host", declared="declared", suffix="suffix")
    of_docs = language_id.identify(docs.select("doc_id", "text", "source"), model, host="source")
    found = ("lang_id", "lang_posterior", "lang_accepted")
    return of_docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), *found).unionByName(of_pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", *found))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    where = scratch.path("archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), where, scratch=scratch)
    return warc.read_archive(spark, where)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hamming_topk, op2_minhash_join, op3_bpe_transducer, op4_suffix_dedup, op5_decontaminate, op6_language_id, op7_warc, op8_lm_scoring, op9_token_counts, op10_line_dedup)}
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Components by reachability: ``links`` (u, v) of ``nodes`` (node) to ``found`` (node, component).
_REACHED = """both_ways AS (SELECT u AS a, v AS b FROM links UNION ALL SELECT v, u FROM links),
    reached(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.b FROM reached r JOIN both_ways e ON r.other = e.a),
    found AS (SELECT node, min(other) AS component FROM reached GROUP BY node)"""
_BASE32 = "array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)), '')"

ORACLE_SQL: dict[str, str] = {
    "op1_hamming_topk": """
        WITH signs AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
        pairs AS (
            SELECT q.id AS query_id, r.id AS id, CAST(len(list_filter(list_zip(q.s, r.s), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
            FROM signs q JOIN signs r ON q.id <> r.id WHERE q.id % 20 = 0
        ),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
        SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
    """,
    "op2_minhash_join": f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
        ),
        each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        nodes AS (SELECT doc_id AS node FROM documents), {_REACHED}
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept FROM sets JOIN found ON doc_id = node
    """,
    "op5_decontaminate": """
        WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        iw AS (SELECT item_id AS item, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
        d AS (SELECT id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM w WHERE len(w) >= 5),
        i AS (SELECT item, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM iw WHERE len(w) >= 5),
        weights AS (SELECT item, size, x, count(*) AS weight FROM (SELECT item, len(s) AS size, unnest(s) AS x FROM i) GROUP BY ALL),
        near AS (SELECT id, item, size FROM (SELECT id, unnest(s) AS x FROM d) JOIN weights USING (x) GROUP BY ALL HAVING count(*) * 100 >= size * 80),
        windows AS (SELECT id, item, size, s, unnest(range(0, greatest(len(s) - size, 0) + 1)) AS start FROM near JOIN d USING (id)),
        held AS (SELECT id, item, size, start, least(len(s), size) AS held, x, count(*) AS n FROM (SELECT *, unnest(s[start + 1:start + size]) AS x FROM windows) GROUP BY ALL),
        judged AS (SELECT id, item, start, size + held - sum(least(n, weight)) AS u, sum(least(n, weight)) AS c FROM held JOIN weights USING (item, size, x) GROUP BY id, item, start, size, held)
        SELECT id AS doc_id, item AS item_id, max(CAST(c AS DOUBLE) / CAST(u AS DOUBLE)) AS similarity FROM judged WHERE c * 100 >= u * 80 GROUP BY id, item
    """,
    "op7_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), h AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS n, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM h
    """,
    # pairs meet by the rarest shingles that any partner must share one of, and are then held against each other whole
    "op10_line_dedup": f"""
        WITH RECURSIVE places AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_matches(line, '\\S')),
        firsts AS (SELECT line, min({{'doc': doc_id, 'pos': pos}}) AS place FROM places GROUP BY line),
        sets AS (SELECT row_number() OVER (ORDER BY place) AS node, line, place, CASE WHEN length(line) < 5 THEN [line] ELSE list_distinct(list_transform(range(1, length(line) - 3), lambda i: substring(line, i, 5))) END AS s FROM firsts),
        nodes AS (SELECT node FROM sets),
        each AS (SELECT node, len(s) AS n, unnest(s) AS x FROM sets), spread AS (SELECT x, count(*) AS df FROM each GROUP BY x),
        ranked AS (SELECT node, n, x, row_number() OVER (PARTITION BY node ORDER BY df, x) AS r FROM each JOIN spread USING (x) WHERE true),
        rare AS (SELECT node, n, x FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
        met AS (SELECT DISTINCT a.node AS u, b.node AS v FROM rare a JOIN rare b ON a.x = b.x AND a.node < b.node AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
        counted AS (SELECT u, v, len(a.s) + len(b.s) AS n, len(list_intersect(a.s, b.s)) AS c FROM met JOIN sets a ON a.node = u JOIN sets b ON b.node = v),
        links AS (SELECT u, v FROM counted WHERE 100 * c >= 80 * (n - c)), {_REACHED},
        kept AS (SELECT s.line, f.place FROM sets s JOIN found USING (node) JOIN sets f ON f.node = component),
        gone AS (SELECT p.doc_id, p.pos FROM places p JOIN kept k ON p.line = k.line WHERE k.place <> {{'doc': p.doc_id, 'pos': p.pos}}),
        removed AS (SELECT doc_id, list(pos ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed, coalesce(removed, []) AS removed FROM documents LEFT JOIN removed USING (doc_id)
    """,
}
