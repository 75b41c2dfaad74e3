"""Language of texts by Bayesian fusion of evidence.

For every language the log posterior is the sum of
  * the text's log likelihood under byte trigrams (tempered, as overlapping trigrams are not independent),
  * the language declared in the markup, trusted to ``declared_trust``,
  * the language that the address suffix speaks for, trusted to ``suffix_trust``,
  * the prior of the host. Priors come from grouped aggregation: texts are counted by host and by the language that the
    text alone speaks for; a host's shares are smoothed by its registered domain's and those by the whole table's.
A further class ``und`` spreads its likelihood evenly over all trigrams; a row whose posterior is highest there, or
whose text has no letter, is rejected.

Trigram models are fitted on a bounded sample of labelled rows (``per_language`` rows of each language, the smallest by
hash of the id, ``sample_chars`` characters of each); host priors and decisions cover all rows and whole texts.
Null text, host, declared language or suffix are missing evidence. Input columns are kept; added names start with
``lang_``, and input columns of these names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from plumbline.llm.bytescan import as_bytes, groups_by_bytes
from plumbline.llm.groups import lean
from plumbline.llm.scratch import Scratch

BINS = 1 << 16
PER_LANGUAGE = 400
SAMPLE_CHARS = 20_000
#: More hosts than this are joined by shuffle instead of broadcast.
BROADCAST_HOSTS = 20_000
SUFFIX_LANGUAGE = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "it": "it", "uk": "en", "us": "en"}
#: Bytes as the trigrams see them: letters in lower case, UTF-8's bytes of other scripts as they are, one blank else.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Evidence:
    temper: float = 0.5
    declared_trust: float = 0.9
    suffix_trust: float = 0.7
    smoothing: float = 20.0
    und_prior: float = 1e-3


@dataclass(frozen=True)
class TextModel:
    """Log likelihood of trigram bins, one row a language and last ``und``."""

    languages: tuple[str, ...]
    table: np.ndarray  # float32 (BINS, languages + 1)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log likelihoods of each text, and its number of letters' bytes."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        letters = np.zeros(len(texts), dtype=np.int64)
        for a, b in groups_by_bytes(texts):
            bins, own, lettered = trigrams(texts[a:b])
            letters[a:b] = np.bincount(own, weights=lettered, minlength=b - a)
            for k in range(out.shape[1]):
                out[a:b, k] = np.bincount(own, weights=self.table[bins, k], minlength=b - a)
        return out, letters


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and text of each trigram, and whether its middle is no blank. A text has a blank around it, one for each run."""
    joined = np.frombuffer(b" " + b" \xff ".join(texts) + b" \xff", dtype=np.uint8)  # 0xFF is in no UTF-8 text
    own = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    buf = _FOLD[joined]
    keep = np.ones(len(buf), dtype=bool)
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32)
    buf, own = buf[keep], own[keep]
    if len(buf) < 3:
        return np.zeros(0, dtype=np.uint32), own[:0], np.zeros(0, dtype=bool)
    whole = (buf[:-2] != 255) & (buf[1:-1] != 255) & (buf[2:] != 255)
    return trigram_bins(buf)[whole], own[:-2][whole], (buf[1:-1] != 32)[whole]


def trigram_bins(buf: np.ndarray) -> np.ndarray:
    code = buf[:-2].astype(np.uint32) << np.uint32(16) | buf[1:-1].astype(np.uint32) << np.uint32(8) | buf[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> TextModel:
    """Trigram models of the labelled languages, from at most ``per_language`` rows each."""
    order = F.xxhash64(key)
    ids = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("_l"), order.alias("_o"))
    picked = ids.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_o", "_k"))).where(F.col("_r") <= per_language).select("_k", "_l")
    sample = docs.select(F.col(key).alias("_k"), F.substring(text, 1, sample_chars).alias("_t")).join(F.broadcast(picked), "_k").select("_l", "_t").collect()
    languages = tuple(sorted({r._l for r in sample}))
    counts = np.full((BINS, len(languages) + 1), 0.1, dtype=np.float64)
    for k, name in enumerate(languages):
        counts[:, k] += np.bincount(trigrams([r._t.encode() for r in sample if r._l == name])[0], minlength=BINS)
    counts[:, -1] = 1.0
    return TextModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def likelihoods(df: DataFrame, model: TextModel, text: str) -> DataFrame:
    """``df`` with lang_ll (array<double>, one a language and last und) and lang_letters."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.table))  # languages x 65,536 floats
    base = df.drop("lang_ll", "lang_letters")
    at = base.columns.index(text)

    def run(batches):
        m = TextModel(*shared.value)
        for batch in batches:
            scores, letters = m.score(as_bytes(batch.column(at)))
            n = scores.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(scores) + 1, n), pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(letters, pa.int64())], names=[*batch.schema.names, "lang_ll", "lang_letters"])

    return base.mapInArrow(lean(run), StructType([*base.schema.fields, StructField("lang_ll", ArrayType(DoubleType())), StructField("lang_letters", LongType())]))


def _domain(host: str) -> Column:
    parts = F.split(F.col(host), "\\.")
    return F.when(F.size(parts) > 2, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col(host))


def host_priors(scored: DataFrame, model: TextModel, host: str, evidence: Evidence, scratch: Scratch) -> tuple[DataFrame, list[float]]:
    """(host, lang_prior array<double>) and the table's own prior; shares smoothed from host to domain to table.

    The hosts' counts are written, so that the texts are scored once for them.
    """
    best = F.array_position(F.slice("lang_ll", 1, len(model.languages)), F.array_max(F.slice("lang_ll", 1, len(model.languages))))
    lettered = scored.where("lang_letters > 0").select(F.col(host).alias("lang_host"), best.alias("b"))
    sums = [F.sum((F.col("b") == k + 1).cast("long")).alias(f"n{k}") for k in range(len(model.languages))]
    by_host = scratch.table(lettered.groupBy("lang_host").agg(*sums), "hosts")
    names = [f"n{k}" for k in range(len(model.languages))]
    by_host = by_host.withColumn("lang_domain", _domain("lang_host"))
    by_domain = by_host.groupBy("lang_domain").agg(*[F.sum(n).alias(f"d{n}") for n in names])
    total = by_host.agg(*[F.sum(n).alias(n) for n in names]).first()
    got = [float(total[n] or 0) + 1.0 for n in names]
    world = [x / sum(got) for x in got]
    k = F.lit(evidence.smoothing)
    host_n, domain_n = sum((F.col(n) for n in names), F.lit(0)), sum((F.col(f"d{n}") for n in names), F.lit(0))
    shares = [(F.col(n) + k * (F.col(f"d{n}") + k * F.lit(p)) / (domain_n + k)) / (host_n + k) for n, p in zip(names, world, strict=True)]
    priors = by_host.where(F.col("lang_host").isNotNull()).join(by_domain, "lang_domain").select("lang_host", F.array(*shares).alias("lang_prior"))
    return priors, world


def identify(df: DataFrame, model: TextModel, text: str = "text", host: str | None = None, declared: str | None = None, suffix: str | None = None, evidence: Evidence = Evidence(), scratch: Scratch | None = None) -> DataFrame:
    """``df`` with lang_id, lang_posterior (of lang_id) and lang_accepted.

    Of languages with equal posteriors the first in alphabetical order is taken. Rows that repeat count each for their
    host. Texts without letters are und. No rows give no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "language")
    df = df.drop("lang_id", "lang_posterior", "lang_accepted", "lang_prior", "lang_host")
    langs = model.languages
    scored = likelihoods(df, model, text)
    flat = F.array(*[F.lit(1.0 / len(langs)) for _ in langs])
    if host:
        slim = likelihoods(df.select(text, F.col(host).alias("lang_at")), model, text)
        priors, world = host_priors(slim, model, "lang_at", evidence, scratch)
        flat = F.array(*map(F.lit, world))
        if priors.count() <= BROADCAST_HOSTS:
            priors = F.broadcast(priors)
        scored = scored.join(priors, scored[host] == priors["lang_host"], "left").drop("lang_host")
        prior = F.coalesce("lang_prior", flat)
    else:
        prior = flat

    def trusted(col: Column, trust: float, k: str) -> Column:
        known = col.isin(*langs)
        return F.when(known & (col == k), F.lit(float(np.log(trust)))).when(known, F.lit(float(np.log((1 - trust) / max(len(langs) - 1, 1))))).otherwise(F.lit(0.0))

    terms = []
    for i, name in enumerate(langs):
        t = F.lit(evidence.temper) * F.get("lang_ll", F.lit(i)) + F.log(F.get(prior, F.lit(i))) + F.lit(float(np.log(1 - evidence.und_prior)))
        if declared:
            t = t + trusted(F.lower(F.substring(F.col(declared), 1, 2)), evidence.declared_trust, name)
        if suffix:
            by_suffix = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
            t = t + trusted(F.element_at(by_suffix, F.lower(F.col(suffix))), evidence.suffix_trust, name)
        terms.append(t)
    terms.append(F.lit(evidence.temper) * F.get("lang_ll", F.lit(len(langs))) + F.lit(float(np.log(evidence.und_prior))))
    out = scored.withColumn("lang_terms", F.array(*terms)).withColumn("lang_top", F.array_max("lang_terms"))
    total = F.aggregate("lang_terms", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("lang_top")))
    best = F.get(F.array(*[F.lit(x) for x in (*langs, "und")]), (F.array_position("lang_terms", F.col("lang_top")) - 1).cast("int"))
    out = out.withColumn("lang_id", F.when(F.col("lang_letters") > 0, best).otherwise("und")).withColumn("lang_posterior", 1 / total)
    return out.withColumn("lang_accepted", F.col("lang_id") != "und").drop("lang_terms", "lang_top", "lang_ll", "lang_letters", "lang_prior")


def markup(pages: DataFrame) -> DataFrame:
    """Visible text, declared language, host and suffix of (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select(
        "page_id",
        bare.alias("text"),
        F.nullif(F.regexp_extract(html, "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([a-zA-Z]{2})", 1), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(host, "\\.([a-z]+)$", 1), F.lit("")).alias("suffix"),
    )
