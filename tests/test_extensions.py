"""Literal values of the operators around the evaluation: rounding, composition, plug-ins, decoding, gateway, retrieval."""

import importlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import plumbline  # noqa: E402
from plumbline.functions import text as T  # noqa: E402
from plumbline.operators import audit, bm25, coerce, gateway, generation, latency, mutate, retrieval, runner, scorers  # noqa: E402
from plumbline.sources import samples  # noqa: E402


def test_rounding_is_that_of_the_binary_value(spark):
    pairs = [(k, n) for n in (*range(1, 70), 96, 128, 160, 320, 640, 800) for k in range(n + 1)]
    df = spark.createDataFrame(pairs, "k int, n int").select("k", "n", T.rounded(F.col("k") / F.col("n")).alias("a"), T.rounded(1 - F.col("k") / F.col("n")).alias("b"))
    for r in df.collect():
        assert (r.a, r.b) == (round(r.k / r.n, 4), round(1 - r.k / r.n, 4)), (r.k, r.n)


def test_half_missing_terms_round_to_even(spark):
    gold = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(32))
    got = spark.createDataFrame([(gold, gold.split(" ")[0])], "g string, c string").select(scorers.recall_score(F.col("g"), F.col("c")).alias("x")).first().x
    assert got == 0.0312


def test_composition(spark):
    df = spark.createDataFrame([("été", ["ä", None, "x"], 1), ("plain", [], 2), (None, None, 3), ("医保", ["가"], 4)], "t string, l array<string>, n int")
    got = [(r.t, r.l) for r in T.composed(df, "t", "l").orderBy("n").collect()]
    assert got == [("été", ["ä", None, "x"]), ("plain", []), (None, None), ("医保", ["가"])]


def _responses(spark, *rows):
    return spark.createDataFrame(rows, "id string, question string, ground_truth_context string, ground_truth_answer string, expected_entities array<string>, required_entities array<string>, context string, answer string")


def test_decomposed_texts_match(spark):
    rows = _responses(spark, ("a", "q", "café", "x", ["café"], ["café"], "café", "café"))
    got = runner.evaluate(rows).first()
    assert got.case_passed and got.completeness_score == 1.0


def test_metrics_fail_alone(spark):
    rows = _responses(spark, ("a", "q", "one two", "x", ["one"], ["one"], "one two", "one"), ("b", "q", "one two", "x", ["one"], ["zzz"], "one two", "one"))

    def odd(row):
        if row["answer"] == "one":
            raise ValueError("no")
        return 1.0, True, []

    def unbuildable():
        raise RuntimeError("cannot")

    got = {r.sample_id: r for r in runner.evaluate(rows, metrics=[*runner.default_scorers(), runner.Scorer.of_rows("odd", odd), runner.Scorer("broken", unbuildable)]).collect()}
    assert got["a"].case_passed and got["a"].error_details == ["[harness] odd: ValueError('no')", "[harness] broken: RuntimeError('cannot')"]
    assert not got["b"].required_entities_pass and not got["b"].case_passed
    bare = runner.evaluate(rows, metrics=[runner.Scorer.of_rows("faithfulness", odd)]).collect()
    assert all(not r.faithfulness_pass and r.context_recall_score == 0.0 for r in bare)
    assert [r.required_entities_pass for r in sorted(bare, key=lambda r: r.sample_id)] == [True, False]


def test_means_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([(x, True, True) for x in (0.3333, 0.3334, 0.1)], "context_recall_score double, faithfulness_pass boolean, case_passed boolean").withColumn("completeness_score", F.lit(0.00005 * 1000))
    got = runner.summarize(rows).first()
    assert (got.avg_context_recall, got.avg_completeness, got.case_pass_rate) == (0.2556, 0.05, 1.0)
    empty = runner.summarize(rows.limit(0)).first()
    assert (empty.total, empty.avg_context_recall, empty.case_pass_rate) == (0, 0.0, 0.0)


def test_hit_at_k_without_blocks_takes_the_context(spark):
    df = spark.createDataFrame([("one two", None, "one"), ("one two", ["one", "two"], "none"), ("", None, "")], "g string, b array<string>, c string")
    got = [r.x.score for r in df.select(scorers.hit_at_k(F.col("g"), F.col("b"), context=F.col("c")).alias("x")).collect()]
    assert got == [0.5, 1.0, 1.0]


def test_hybrid_retrieval(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "alpha"), (2, "gamma"), (3, "delta")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "alpha beta"), (8, ""), (9, "nowhere")], "query_id long, text string")
    index = bm25.fit(docs)
    words = retrieval.hybrid(index, asked, 1).collect()
    assert [(r.query_id, r.rank, r.doc) for r in words] == [(7, 1, 0)]
    seen = []

    def engine(queries, n):
        seen.append(n)
        return spark.createDataFrame([(7, 1, 3), (7, 2, 1), (8, 1, 2)], "query_id long, rank int, doc long")

    got = sorted((r.query_id, r.rank, r.doc, round(r.score, 6)) for r in retrieval.hybrid(index, asked, 2, engine).collect())
    assert seen == [4]
    assert got == [(7, 1, 1, round(2 / 62, 6)), (7, 2, 0, round(1 / 61, 6)), (8, 1, 2, round(1 / 61, 6))]
    hits = retrieval.hybrid(index, asked, 2).join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), "doc")
    gold = spark.createDataFrame([(7, "alpha beta"), (9, "alpha")], "query_id long, gold string")
    assert sorted((r.query_id, r.recall, r.passed) for r in retrieval.recall_at(hits, gold).collect()) == [(7, 1.0, True), (9, 0.0, False)]


def test_missing_sources_are_named_in_order(spark):
    hits = spark.createDataFrame([(1, 1, "x", "d1", "c1", "s1")], "query_id long, rank int, content string, doc_id string, chunk_id string, scope_id string")
    asked = spark.createDataFrame([(1, "q", ["z", "s1", "b"])], "query_id long, query string, sources array<string>")
    got = retrieval.select_context(hits, asked).first()
    assert (got.error_code, got.missing_sources) == ("REQUESTED_SOURCE_NOT_FOUND", "b, z")


def test_conflicting_sources_do_not_index(spark):
    good = spark.createDataFrame([("a", "s", "one"), ("b", "s", "one"), ("c", None, "two")], "id string, source string, ground_truth_context string")
    assert sorted(r.text for r in audit.checked_sources(good).collect()) == ["one", "two"]
    bad = good.unionByName(spark.createDataFrame([("d", "s", "other")], good.schema))
    with pytest.raises(Exception, match="different texts: s"):
        audit.checked_sources(bad).collect()


def test_payloads_of_any_shape(spark):
    cases = {
        '{"atomic_facts": [{"subject": "s", "predicate": 3}, 7, "{x", null], "note": 1, "query": "q"}': (1, ["未知顶层键 'note'，已剔除", "atomic_facts[0].predicate 类型非法，已规范化为默认值", "atomic_facts[1] 必须是 object，已剔除", "atomic_facts[2] 必须是 object，已剔除", "atomic_facts[3] 必须是 object，已剔除"]),
        '{"atomic_facts": 5}': (0, ["atomic_facts 必须是数组"]),
        "[1]": (0, ["顶层必须是 JSON object"]),
        "not json": (0, ["顶层必须是 JSON object"]),
        '{"query": "q"}': (0, []),
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string").select("j", coerce.coerce_payload(F.col("j")).alias("p"))
    for r in df.collect():
        assert (len(r.p.atomic_facts), r.p.violations) == cases[r.j], r.j


def test_states_of_decoding(spark):
    fact = lambda value: json.dumps({"atomic_facts": [{"object_value": value, "fact_type": "categorical"}]})
    rows = [(1, "yellow house", fact("yellow"), None), (2, "yellow house", fact("green"), fact("house")), (3, "yellow house", fact("green"), fact("red")), (4, "yellow house", fact("green"), None), (5, "yellow house", fact(""), None)]
    got = {r.id: r for r in generation.decode(spark.createDataFrame(rows, "id int, context string, payload string, again string"), repair="again").collect()}
    start = ["extract", "validate", "decide"]
    assert got[1].trace == [*start, "accept"] and got[1].repair_count == 0
    assert got[2].trace == [*start, "repair", "revalidate", "decide", "accept"] and got[2].accepted and got[2].repair_count == 1
    assert got[3].trace[-1] == "reject" and got[3].repair_count == 1 and got[4].trace == [*start, "reject"] and not got[5].accepted
    once = generation.decode(spark.createDataFrame(rows, "id int, context string, payload string, again string"))
    assert {r.id for r in once.where("accepted").collect()} == {1}


def test_prompts_and_answers(spark):
    df = spark.createDataFrame([("q {x}", "c", ["a"], None)], "question string, context string, facts array<string>, claim string")
    assert generation.prompts(df, "Q {question} C {context} F {facts} {claim}{{}}").first().prompt == 'Q q {x} C c F ["a"] {}'
    with pytest.raises(ValueError):
        generation.prompts(df, "{nowhere}")
    said = spark.createDataFrame([(" a ",), ("B",), ("A. yes",), ("",), (None,)], "t string")
    assert [r.x for r in said.select(generation.judge_class(F.col("t")).alias("x")).collect()] == ["A", "B", "C", "C", "C"]
    assert [r.x for r in said.select(generation.judge_accepts(F.col("t"), by_prefix=True).alias("x")).collect()] == [True, False, True, False, False]
    body = spark.createDataFrame([('say "hi"\n\\n',)], "t string").select(generation.chat_request(F.col("t"), "m").alias("x")).first().x
    assert json.loads(body)["messages"][0]["content"] == 'say "hi"\n\\n' and json.loads(body)["options"]["num_predict"] == 800
    answers = spark.createDataFrame([('{"message":{"content":" ok "},"done":true}',), ("{}",)], "t string")
    assert [r.x for r in answers.select(generation.chat_answer(F.col("t")).alias("x")).collect()] == ["ok", ""]
    raw = '```json\n{"facts":[{"key":"k","value":"1","sourceText":"s","isNumeric":true},{"key":"z"}],"claims":["c1","c2"]\n```'
    got = spark.createDataFrame([(raw,)], "t string").select(generation.answered_facts(F.col("t")).alias("f"), generation.answered_claims(F.col("t")).alias("c")).first()
    assert [tuple(x) for x in got.f] == [("k", "1", "s", True)] and got.c == ["c1", "c2"]


def test_json_strings_and_policy_answer(spark):
    texts = ['a"b', "line\nnext\tx", "back\\slash \\n", "", "医保"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.json_escaped(F.col("t")).alias("e"), T.json_unescaped(T.json_escaped(F.col("t"))).alias("u")).collect()
    assert [json.loads(f'"{r.e}"') for r in got] == texts and [r.u for r in got] == texts
    cases = ['```json{"lv3_ratio": "70%", "special_clinic_ratio": "90%", "remote_medical_covered": false}```', "{}", "broken"]
    out = [r.x for r in spark.createDataFrame([(c,) for c in cases], "t string").select(T.policy_answer(F.col("t")).alias("x")).collect()]
    assert "70%" in out[0] and T.POLICY_REFUSED in out[0] and T.POLICY_UNKNOWN in out[1] and T.POLICY_PAID in out[1] and out[2] == T.POLICY_BROKEN


def test_salvaged_objects(spark):
    cases = {'x ```json\n{"atomic_facts": [{"object_value": "1"}]}\n``` y': 1, '{"object_value": "1"} junk {"object_value": "2"} {"object_value"': 2, '{"object_value": 1,} {"object_value": "2"} [': 0, "[1]": 0, "": 0, '{"atomic_facts": 3}': 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.size(T.salvaged_objects(F.col("t"))).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_mutations(spark):
    cases = [("起付线099元", "100"), ("共7元", "8"), ("limit 199999999999999999999999999999999 end", "2" + "0" * 32), ("no digits", None), ("a 0 b", "1")]
    for text, number in cases:
        got = spark.createDataFrame([(text,)], "t string").select(mutate.number_raised(F.col("t")).alias("x")).first().x
        assert got == (text if number is None else text.replace("".join(c for c in text if c.isdigit()), number))
    df = spark.createDataFrame([("报销，例外情形 x",)], "t string")
    got = df.select(mutate.condition_dropped(F.col("t"), samples.CONDITION_MARKERS).alias("c"), mutate.entity_dropped(F.col("t"), F.lit("报销")).alias("e"), mutate.entity_dropped(F.col("t"), F.lit("")).alias("n")).first()
    assert (got.c, got.e, got.n) == ("报销", "，例外情形 x", "报销，例外情形 x")


def test_gateway_surface(spark):
    asked = spark.createDataFrame([("hello", 1, 2, 3, 1.234)], "prompt string, active int, queued int, node_active int, wait_ms double")
    load = spark.createDataFrame([(n, 8, 8) for n in "ab"], "node string, active int, cap int")
    routed = gateway.route(asked, gateway.ring(spark, ["a", "b"]), load.unionByName(spark.createDataFrame([("c", 0, 8)], load.schema)))
    got = gateway.telemetry_headers(routed).first()
    assert set(got.headers) == set(gateway.HEADERS) and got.headers["x-llm-queue-wait-ms"] == "1.23" and got.headers["x-llm-node-active-slots"] == "3/8"
    assert got.headers["x-llm-primary-target"] == got.primary_node and got.headers["x-llm-cache-replicated"] == str(got.is_replicated).lower()
    counters = gateway.metrics(spark.createDataFrame([("ok", 0.5, 2.0, True)], "status string, ttft double, e2e double, replicated boolean"))
    hits = spark.createDataFrame([("ab12", 3), ("0f", 9)], "fingerprint string, hits long")
    health = json.loads(gateway.health(counters, 8, 8, 0, 16, hits).first().health)
    assert health["prefix_routing"] == {"unique_prefixes_tracked": 2, "replicated_cache_fallbacks": 1, "top_prefixes": [["0f", 9], ["ab12", 3]]} and health["status"] == "saturated"
    text = gateway.prometheus(counters, 2, 0).first().exposition
    assert text.count("# HELP") == text.count("# TYPE") == 9 and text.endswith("llm_gateway_e2e_seconds_sum 2.0000\n") and "\n\n# HELP" in text
    paths = spark.createDataFrame([("/health",), ("/api/generate",)], "path string")
    assert [r.path for r in gateway.metered(paths).collect()] == ["/api/generate"]


def test_ring_maintenance(spark):
    keys = spark.range(100).select(F.concat(F.lit("document_key_"), F.col("id").cast("string")).alias("key"))
    three = gateway.ring(spark, ["a", "b", "c"])
    before = {r.key: r.node for r in gateway.assign(keys, three, "key").collect()}
    after = {r.key: r.node for r in gateway.assign(keys, gateway.without_nodes(three, ["a"]), "key").collect()}
    assert all(after[k] == n for k, n in before.items() if n != "a") and "a" not in after.values()
    assert gateway.with_nodes(three, ["c", "d"]).count() == 4 * gateway.VIRTUAL_NODES
    back = {r.key: r.node for r in gateway.assign(keys, gateway.with_nodes(gateway.without_nodes(three, ["a"]), ["a"]), "key").collect()}
    first = {r.key: r.nodes[0] for r in gateway.candidates(keys, three, "key").collect()}
    assert back == before == first
    assert gateway.assign(keys, three.limit(0), "key").where("node is not null").count() == 0


def test_bursts(spark):
    rows = [(200, 5.0, 0.0, 0.0)] * 2 + [(200, 9.0, 0.0, 20.0 + i) for i in range(4)] + [(429, 10.0 + i, 0.1, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "status int, latency_ms double, decision_ms double, wait_ms double")
    got = gateway.burst_report(df, 2, 4).first()
    assert (got.served, got.rejected, got.errors, got.immediate, got.queued, got.middle_wait_ms, got.rejected_mean_ms) == (6, 4, 0, 2, 4, 21.0, 11.5)
    assert got.shed_passed and got.queue_passed
    none = gateway.burst_report(df.limit(0), 2, 4).first()
    assert none.total == 0 and not none.shed_passed
    assert sorted((r.status, r.n) for r in gateway.status_histogram(df).collect()) == [(200, 6), (429, 4)]
    events = spark.createDataFrame([("n", 1, 1), ("n", 2, -1), ("n", 3, -1), ("n", 4, 1), ("n", 5, 1)], "node string, at int, delta int")
    assert [r.active for r in gateway.active_slots(events).orderBy("at").collect()] == [1, 0, 0, 1, 2]


def test_load_levels(spark):
    rows = spark.createDataFrame([(4, 200, 0.0, 2.0, 0.5, 2.0, 10, 100.0), (4, 429, 0.0, 1.0, 0.0, 0.0, 0, 90.0), (8, 429, 0.0, 1.0, 0.0, 0.0, 0, 80.0)], "concurrency int, status int, start double, end double, ttft double, e2e double, tokens int, memory double")
    got = {r.concurrency: r for r in latency.sweep(rows).collect()}
    assert (got[4].served, got[4].peak_memory, got[4].tokens_per_s, got[4].avg_ttft) == (1, 100.0, 5.0, 0.5) and (got[8].served, got[8].tokens_per_s) == (0, 0.0)
    two = spark.createDataFrame([("cold", 4.0), ("cold", 2.0), ("warm", 1.0)], "g string, v double")
    c = latency.compare(two, "g", "cold", "warm", "v").first()
    assert (c.first, c.first_min, c.first_max, c.second, c.speed_up, c.saved) == (3.0, 2.0, 4.0, 1.0, 3.0, 2.0)
    gaps = spark.createDataFrame([(float(i),) for i in range(10)] + [(501.0,)], "itl_ms double")
    assert not latency.steady_streams(gaps).first().passed and latency.steady_streams(gaps.limit(10)).first().passed


def test_exports():
    assert all(hasattr(plumbline, n) for n in plumbline.__all__) and {"Scorer", "Retriever", "Chunker", "VectorEngine", "evaluate"} <= set(plumbline.__all__)


@pytest.mark.parametrize("missing", ["plumbline.llm", "sentencepiece"])
def test_entry_without_the_optional_part(missing):
    """What cannot be imported is left out; the other queries stay."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
    n, *flags = said.stdout.split()
    assert int(n) == len(importlib.import_module("plumbline.plans.catalog").QUERIES) and flags == ["False", "False", "True"]
