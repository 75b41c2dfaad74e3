"""Request gateway analytics: prefix fingerprints, the hash ring, routing, metrics, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIRTUAL_NODES, PREFIX_CHARS = 64, 1500
MAX_ACTIVE, MAX_QUEUE = 8, 16


def prefix_fingerprint(prompt: Column, chars: int = PREFIX_CHARS) -> Column:
    stripped = F.regexp_replace(prompt, r"(?U)^\s+|\s+$", "")
    return F.substring(F.sha2(F.substring(stripped, 1, chars), 256), 1, 16)


def ring(spark: SparkSession, nodes: list[str], virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(h, node): the places of the nodes' virtual copies; hex digits of MD5 sort as the numbers do."""
    base = spark.createDataFrame([(n,) for n in nodes], "node string").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))))
    return base.select(F.md5(F.concat("node", F.lit("#VN"), F.col("i").cast("string"))).alias("h"), "node")


def _sorted_ring(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.array_sort(F.collect_list(F.struct("h", "node"))).alias("_ring"))  # nodes x virtual entries


def candidates(keys: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``nodes``: all nodes in the order in which the ring meets them after the key, the primary first."""
    joined = keys.withColumn("_at", F.md5(F.col(key))).crossJoin(F.broadcast(_sorted_ring(nodes)))  # one row
    after, before = F.filter("_ring", lambda r: r["h"] > F.col("_at")), F.filter("_ring", lambda r: r["h"] <= F.col("_at"))
    return joined.withColumn("nodes", F.array_distinct(F.transform(F.concat(after, before), lambda r: r["node"]))).drop("_ring", "_at")


def _by_first_byte(nodes: DataFrame) -> DataFrame:
    """(_b, _own, _next): for each first byte of a key its part of the ring, in order, and the entry behind that part."""
    own = nodes.groupBy(F.substring("h", 1, 2).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("h", "node"))).alias("_own"))
    bytes_ = nodes.sparkSession.range(256).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("_b"))
    every = bytes_.join(own, "_b", "left").withColumn("_least", F.get("_own", F.lit(0)))
    behind = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)  # 256 rows
    around = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return every.select("_b", "_own", F.coalesce(F.min("_least").over(behind), F.min("_least").over(around)).alias("_next"))


def assign(keys: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``node``: the first virtual node strictly behind the key, around the ring; null without nodes.

    A key meets the ring's part of its first byte only, by a broadcast of 256 rows.
    """
    staged = keys.withColumn("_at", F.md5(F.col(key))).withColumn("_b", F.substring("_at", 1, 2))
    joined = staged.join(F.broadcast(_by_first_byte(nodes)), "_b", "left")
    nxt = F.get(F.filter("_own", lambda r: r["h"] > F.col("_at")), F.lit(0))
    return joined.withColumn("node", F.coalesce(nxt, F.col("_next"))["node"]).drop("_at", "_b", "_own", "_next")


def with_nodes(nodes: DataFrame, names: list[str], virtual: int = VIRTUAL_NODES) -> DataFrame:
    """The ring with further nodes; those that it has already stay as they are."""
    return nodes.unionByName(ring(nodes.sparkSession, names, virtual)).dropDuplicates(["h"])


def without_nodes(nodes: DataFrame, names: list[str]) -> DataFrame:
    """The ring without these nodes: only their keys move."""
    return nodes.where(~F.col("node").isin(*names))


def route(requests: DataFrame, nodes: DataFrame, load: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Target of each request: the primary if it has room, else the next node with room, else the primary.

    load: (node, active, cap).
    """
    free = load.where("active < cap").agg(F.collect_set("node").alias("_free"))  # one row, as long as there are nodes
    out = candidates(requests.withColumn("fingerprint", prefix_fingerprint(F.col(prompt))), nodes, "fingerprint").crossJoin(F.broadcast(free))
    open_ = F.get(F.filter("nodes", lambda n: F.array_contains("_free", n)), F.lit(0))
    primary = F.get("nodes", F.lit(0))
    out = out.withColumns({"primary_node": primary, "target_node": F.coalesce(open_, primary)})
    return out.withColumn("is_replicated", F.col("target_node") != F.col("primary_node")).drop("_free", "nodes")


def metrics(requests: DataFrame) -> DataFrame:
    """One row of counters over requests (status, ttft, e2e, replicated): only positive latencies count."""
    ok = F.col("status") == "ok"
    some = lambda c: F.when(ok & (F.col(c) > 0), F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return requests.agg(
        F.count("*").alias("total_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.count_if(F.col("status") == "rejected").alias("rejected_shedding"),
        F.count_if(F.col("status") == "error").alias("upstream_errors"),
        F.count_if(F.coalesce("replicated", F.lit(False))).alias("cache_replications"),
        F.count(some("ttft")).alias("ttft_count"), zero(F.sum(some("ttft"))).alias("ttft_sum"), zero(F.max(some("ttft"))).alias("ttft_max"),
        F.count(some("e2e")).alias("e2e_count"), zero(F.sum(some("e2e"))).alias("e2e_sum"), zero(F.max(some("e2e"))).alias("e2e_max"),
    )


def prefix_hits(requests: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    return requests.groupBy(fingerprint).agg(F.count("*").alias("hits"))


def metered(requests: DataFrame, path: str = "path") -> DataFrame:
    """Requests of the two paths that are counted."""
    return requests.where(F.col(path).isin(*METERED))


def telemetry_headers(routed: DataFrame, active: str = "active", queued: str = "queued", node_active: str = "node_active", cap: int = MAX_ACTIVE, wait: str = "wait_ms") -> DataFrame:
    """``routed`` (see ``route``) with ``headers``: a map of the eight response headers."""
    slots = F.concat(F.col(node_active).cast("string"), F.lit(f"/{cap}"))
    values = (
        F.col(active).cast("string"), F.col(queued).cast("string"), slots, F.format_string("%.2f", F.col(wait).cast("double")),
        F.col("fingerprint"), F.col("target_node"), F.col("primary_node"), F.when(F.col("is_replicated"), "true").otherwise("false"),
    )
    return routed.withColumn("headers", F.map_from_arrays(F.array(*map(F.lit, HEADERS)), F.array(*values)))


def active_slots(events: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, active): slots in use after start (+1) and end (-1) events (node, at, delta), never below none.

    With a floor the state is the sum less the least sum so far, if that is negative.
    """
    by = Window.partitionBy("node", *keys).orderBy("at", F.desc("delta"))
    running = events.withColumn("_sum", F.sum("delta").over(by))
    low = F.least(F.min("_sum").over(by), F.lit(0))
    return running.withColumn("active", (F.col("_sum") - low).cast("long")).drop("_sum")


def stream_times(chunks: DataFrame, request: str = "req_id", start: str = "start", at: str = "at") -> DataFrame:
    """(request, ttft, e2e) over chunk events: from the start to the first and to the last chunk."""
    return chunks.groupBy(request).agg((F.min(at) - F.min(start)).alias("ttft"), (F.max(at) - F.min(start)).alias("e2e"))


def burst_report(requests: DataFrame, slots: int, queue: int, decision_ms: float = 1.0, queued_ms: float = 5.0) -> DataFrame:
    """One row over a burst (status, latency_ms, decision_ms, wait_ms): the status histogram, the rejected ones' times,
    how many waited, and whether it went as it should: as many served and rejected as slots and queue say, rejected
    within the time, no errors, and a full queue. The middle wait is the one in the middle of the sorted waits."""
    served, rejected = F.col("status") == 200, F.col("status") == 429
    wait = F.when(served, F.col("wait_ms"))
    place = F.floor(F.col("served") / 2)
    ranked = requests.where(served).select("wait_ms", (F.row_number().over(Window.orderBy("wait_ms")) - 1).alias("_at"))
    out = requests.agg(
        F.count("*").alias("total"), F.count_if(served).alias("served"), F.count_if(rejected).alias("rejected"), F.count_if(~served & ~rejected).alias("errors"),
        F.avg(F.when(rejected, F.col("latency_ms"))).alias("rejected_mean_ms"), F.min(F.when(rejected, F.col("latency_ms"))).alias("rejected_min_ms"), F.max(F.when(rejected, F.col("latency_ms"))).alias("rejected_max_ms"),
        F.coalesce(F.avg(F.when(rejected, F.col("decision_ms"))), F.lit(0.0)).alias("decision_mean_ms"),
        F.count_if(wait <= queued_ms).alias("immediate"), F.count_if(wait > queued_ms).alias("queued"), F.max(wait).alias("longest_wait_ms"),
    )
    middle = out.withColumn("_at", place).join(ranked.withColumnRenamed("wait_ms", "middle_wait_ms"), "_at", "left").drop("_at")
    full = F.lit(slots + queue)
    fast = (F.col("served") == full) & (F.col("rejected") == F.col("total") - full) & (F.col("decision_mean_ms") < decision_ms)
    steady = (F.col("errors") == 0) & (F.col("served") == full) & (F.col("queued") == queue)
    return middle.withColumns({"shed_passed": fast, "queue_passed": steady})


def status_histogram(requests: DataFrame, *keys: str) -> DataFrame:
    return requests.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def health(counters: DataFrame, active: int, slots: int, queued: int, queue: int, prefixes: DataFrame | None = None) -> DataFrame:
    """The counters as one JSON document. ``prefixes``: fingerprints with hits, see ``prefix_hits``."""
    avg = lambda k: F.round(F.coalesce(F.try_divide(F.col(f"{k}_sum"), F.col(f"{k}_count")), F.lit(0.0)), 3)
    shed = F.format_string("%.2f%%", F.col("rejected_shedding") / F.greatest(F.col("total_requests"), F.lit(1)) * 100)
    share = lambda a, b: F.lit(f"{a / b * 100:.1f}%")
    if prefixes is None:
        counters = counters.withColumns({"_tracked": F.lit(0).cast("long"), "_top": F.array().cast("array<array<string>>")})
    else:
        first = prefixes.orderBy(F.desc("hits"), "fingerprint").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("n"), "fingerprint"))).alias("_best"))
        tracked = prefixes.agg(F.count("*").alias("_tracked"))
        counters = counters.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(tracked))  # one row each
        counters = counters.withColumn("_top", F.transform("_best", lambda x: F.array(x["fingerprint"], (-x["n"]).cast("string"))))
    whole = F.to_json(
        F.struct(
            F.lit("healthy" if active < slots else "saturated").alias("status"),
            F.struct(F.lit(f"{active}/{slots}").alias("active_concurrent_slots"), share(active, slots).alias("slot_utilization_rate"), F.lit(f"{queued}/{queue}").alias("pending_queue_size"), share(queued, queue).alias("queue_saturation_rate")).alias("saturation"),
            F.struct("total_requests", "successful_requests", F.col("rejected_shedding").alias("rejected_shedding_429"), "upstream_errors", shed.alias("load_shedding_rate")).alias("traffic"),
            F.struct(avg("ttft").alias("avg_ttft_seconds"), F.round("ttft_max", 3).alias("max_ttft_seconds"), avg("e2e").alias("avg_e2e_seconds"), F.round("e2e_max", 3).alias("max_e2e_seconds")).alias("latency"),
            F.struct(F.col("_tracked").alias("unique_prefixes_tracked"), F.col("cache_replications").alias("replicated_cache_fallbacks"), F.col("_top").alias("top_prefixes")).alias("prefix_routing"),
        )
    )
    # hits are numbers in the document, which an array of one type cannot say
    return counters.select(F.regexp_replace(whole, r'\["([0-9a-f]+)","(\d+)"\]', '["$1",$2]').alias("health"))


# Counted paths, response headers, and exported metrics (name, kind, column, help) in their order.
METERED = ("/v1/chat/completions", "/api/generate")
HEADERS = (
    "x-llm-gateway-active-slots", "x-llm-gateway-pending-queue", "x-llm-node-active-slots", "x-llm-queue-wait-ms",
    "x-llm-prefix-fingerprint", "x-llm-routed-target", "x-llm-primary-target", "x-llm-cache-replicated",
)
EXPORTED = (
    ("llm_gateway_requests_total", "counter", "total_requests", "Total number of incoming requests received by gateway"),
    ("llm_gateway_successful_requests_total", "counter", "successful_requests", "Total successful requests forwarded and responded"),
    ("llm_gateway_load_shedding_rejected_total", "counter", "rejected_shedding", "Total requests rejected due to queue saturation (HTTP 429)"),
    ("llm_gateway_cache_replication_total", "counter", "cache_replications", "Total requests dynamically spilled over to alternative nodes (Cache Replication)"),
    ("llm_gateway_upstream_errors_total", "counter", "upstream_errors", "Total errors received from backend inference engine"),
)
GAUGES = (("llm_gateway_active_slots", "Current active inference slots occupied in engine"), ("llm_gateway_queue_length", "Current pending requests waiting in queue"))
SUMMARIES = (("ttft", "Time to first token summary"), ("e2e", "End-to-end request duration summary"))


def prometheus(counters: DataFrame, active: int, queued: int) -> DataFrame:
    """The counters in the text exposition format: blocks with help and kind, an empty line behind each."""
    head = lambda name, kind, said: f"# HELP {name} {said}\n# TYPE {name} {kind}\n"
    blocks = [F.concat(F.lit(f"{head(name, kind, said)}{name} "), F.col(c).cast("string")) for name, kind, c, said in EXPORTED]
    blocks += [F.lit(f"{head(name, 'gauge', said)}{name} {v}") for (name, said), v in zip(GAUGES, (active, queued), strict=True)]
    for k, said in SUMMARIES:
        name = f"llm_gateway_{k}_seconds"
        blocks.append(F.concat(F.lit(f"{head(name, 'summary', said)}{name}_count "), F.col(f"{k}_count").cast("string"), F.lit(f"\n{name}_sum "), F.format_string("%.4f", F.col(f"{k}_sum"))))
    return counters.select(F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n")).alias("exposition"))


def admission(requests: DataFrame, key: str, active: int = MAX_ACTIVE, queue: int = MAX_QUEUE) -> DataFrame:
    """Replay of admission control for each key: (key, req_id, outcome, wait), in order of arrival, then request.

    requests: key, req_id, at (seconds), service (seconds). A request is rejected if the queue is full when it arrives,
    else it waits for one of the slots. One key's requests are folded in order, with a state of slots and queue only.
    """
    import heapq

    kind = requests.schema[key].dataType.simpleString()

    def replay(batches):
        import pyarrow as pa

        now_key, busy, waiting = object(), [], []
        for batch in batches:
            out = []
            for k, req, at, service in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != now_key:
                    now_key, busy, waiting = k, [], []
                while waiting and waiting[0] <= at:  # starts of queued requests that have begun
                    heapq.heappop(waiting)
                while busy and busy[0] <= at and len(busy) > 0 and not waiting:
                    heapq.heappop(busy)
                if len(waiting) >= queue:
                    out.append((k, req, "rejected", 0.0))
                    continue
                start = at
                if len(busy) >= active:
                    start = max(at, heapq.heappop(busy))
                heapq.heappush(busy, start + service)
                if start > at:
                    heapq.heappush(waiting, start)
                out.append((k, req, "queued" if start > at else "active", start - at))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=[key, "req_id", "outcome", "wait"])

    ordered = requests.select(key, F.col("req_id").cast("long"), F.col("at").cast("double"), F.col("service").cast("double")).repartition(key).sortWithinPartitions(key, "at", "req_id")
    return ordered.mapInArrow(replay, f"`{key}` {kind}, req_id long, outcome string, wait double")
