"""Latency and throughput of requests and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def gaps(tokens: DataFrame, client: str, ts: str, order: str) -> DataFrame:
    """``tokens`` with seq (from 1) and itl_ms, the time since the client's token before; the first has none."""
    by = Window.partitionBy(client).orderBy(ts, order)
    return tokens.withColumn("seq", F.row_number().over(by)).withColumn("itl_ms", (micros(ts) - F.lag(micros(ts)).over(by)) / 1000.0)


def phases(rows: DataFrame, seq: str = "seq", first: int = 10, last: int = 35) -> DataFrame:
    """Label tokens by their number: up to ``first`` before the shock, up to ``last`` in it, then after it."""
    return rows.withColumn("phase", F.when(F.col(seq) <= first, "pre").when(F.col(seq) <= last, "in").otherwise("post"))


def percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, maximum and interpolated p50, p95, p99."""
    p = lambda q: F.percentile(value, q).alias(f"p{int(q * 100)}")
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), p(0.5), p(0.95), p(0.99))


def percentile_by_index(rows: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """The value at index int(n * q) of the sorted values (the last one at most)."""
    own = Window.partitionBy(*keys)
    placed = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(own.orderBy(value))).withColumn("_n", F.count("*").over(own))
    at = F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)
    return placed.where(F.col("_r") - 1 == at).select(*keys, F.col(value).alias(f"p{int(q * 100)}_index"))


def throughput(requests: DataFrame, *keys: str) -> DataFrame:
    """Of requests (start, end in seconds, ttft, tokens): mean and maximum TTFT, tokens over wall clock."""
    wall = F.max("end") - F.min("start")
    return requests.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ttft").alias("avg_ttft"), F.max("ttft").alias("max_ttft"), F.try_divide(F.sum("tokens"), wall).alias("tokens_per_s"))


def memory_delta(samples: DataFrame, ts: str, used: str, *keys: str) -> DataFrame:
    """Memory at the first sample, its peak and the difference."""
    return samples.groupBy(*keys).agg(F.min_by(used, ts).alias("baseline"), F.max(used).alias("peak")).withColumn("delta", F.col("peak") - F.col("baseline"))


def compare(rows: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Mean, least and largest values of two groups, the means' ratio and the drop in percent."""
    own = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    sides = [own(f, g).alias(name + said) for g, name in ((a, "first"), (b, "second")) for f, said in ((F.avg, ""), (F.min, "_min"), (F.max, "_max"))]
    return rows.agg(*sides).withColumns({"speed_up": F.try_divide("first", "second"), "drop_percent": (1 - F.try_divide("second", "first")) * 100, "saved": F.col("first") - F.col("second")})


def sweep(requests: DataFrame, level: str = "concurrency") -> DataFrame:
    """For each level of (status, start, end, ttft, e2e, tokens, memory): how many were served, and with what."""
    ok = F.col("status") == 200
    served = lambda f, c: f(F.when(ok, F.col(c)))
    wall = F.max("end") - F.min("start")
    return requests.groupBy(level).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("served"), F.max("memory").alias("peak_memory"), served(F.avg, "ttft").alias("avg_ttft"), served(F.avg, "e2e").alias("avg_e2e"),
        F.coalesce(F.try_divide(served(F.sum, "tokens"), wall), F.lit(0.0)).alias("tokens_per_s"),
    )


def steady_streams(gaps_: DataFrame, *keys: str, p99_ms: float = 100.0, max_ms: float = 500.0) -> DataFrame:
    """p99 and largest inter-token latency, and whether both stay below their limits."""
    got = percentiles(gaps_, "itl_ms", *keys).select(*keys, "n", "p99", "max")
    return got.withColumn("passed", (F.col("p99") < p99_ms) & (F.col("max") < max_ms))


def by_completion(results: DataFrame, end: str = "end", *ties: str) -> DataFrame:
    """Results in the order in which they were completed."""
    return results.orderBy(end, *ties)
