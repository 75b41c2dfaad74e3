"""Text kernel: normalisation, terms, numbers, matching. Every function takes and gives Columns and stays in the JVM.

Texts are compared on code points; ``(?U)`` makes the classes of regular expressions Unicode-aware where the rules
speak of any white space or digit. Canonical composition (NFC) has no built-in; ``compose`` is an Arrow function to be
applied once to raw text that may hold decomposed letters; ``composed`` sends it only the texts that need it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Full-width characters and what they become.
FULLWIDTH = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ％．"
HALFWIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz%."
# Terms that recall ignores.
STOPWORDS = (
    "我们", "你们", "他们", "可以", "以及", "如果", "但是", "对于", "根据", "通过", "并且", "或者", "还是", "就是", "这个", "那个", "什么", "怎么",
    "哪些", "是否", "如下", "the", "a", "an", "of", "to", "is", "are", "for", "and", "or", "in", "on", "at", "by", "with",
)
# Negation words and condition keywords, in the order in which findings list them.
NEGATION_WORDS = ("不得", "禁止", "免予", "除外", "不纳入", "不适用", "不可", "不能", "不允许", "不应", "无须", "无需", "非", "无", "不", "否")
CONDITION_KEYWORDS = ("仅限", "仅", "必须", "须", "应当", "应", "需", "需要", "之前", "之后", "以内", "以外", "范围内", "范围外", "前提", "条件", "例外", "特殊", "除外")
# English months by their number. Spark's replacements are literal, so each month has its own pattern.
MONTHS = (
    (1, "jan(?:uary)?"), (2, "feb(?:ruary)?"), (3, "mar(?:ch)?"), (4, "apr(?:il)?"), (5, "may"), (6, "june?"), (7, "july?"), (8, "aug(?:ust)?"),
    (9, "sep(?:t(?:ember)?)?"), (10, "oct(?:ober)?"), (11, "nov(?:ember)?"), (12, "dec(?:ember)?"),
)
# Amounts of units in yuan.
UNITS = {"元": 1.0, "万": 1e4, "万元": 1e4, "亿": 1e8, "亿元": 1e8, "千万": 1e7, "百万": 1e6, "million": 1e6, "千": 1e3, "thousand": 1e3, "k": 1e3, "m": 1e6, "b": 1e9, "billion": 1e9}
_UNIT_PATTERN = r"(\d+(?:\.\d+)?)\s*(亿元|万元|亿|万|元|千万|百万|billion|million|thousand|k|m|b)?"
_CJK = r"\x{4e00}-\x{9fff}"
_SCALED = r"(?i)(\d+(?:\.\d+)?)\s*(million|billion)\b"


@F.pandas_udf(StringType())
def compose(text: pd.Series) -> pd.Series:
    """Canonical composition (NFC)."""
    return text.str.normalize("NFC")


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of the values, each of which is evaluated once for a row, however often the body speaks of it.

    An expression that occurs several times within branches and lambdas is evaluated each time; a lambda's variable is not.
    """
    named = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(named, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


#: Characters that composition may change or join with their neighbours are all outside these.
_COMPOSED = r"[^\x00-\x{2ff}\x{3001}-\x{3029}\x{3030}-\x{3098}\x{30a0}-\x{9fff}\x{ac00}-\x{d7a3}\x{ff01}-\x{ff9f}]"


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the columns' texts (strings, or arrays of strings) in composed form.

    Only texts with a character that composition may touch go to the Arrow function; the others stay in the JVM.
    """
    kinds = dict(df.dtypes)
    out = df
    for c in columns:
        if kinds[c] == "array<string>":  # the separator occurs in no text and keeps composition apart
            whole = F.array_join(F.col(c), "\u0000", "\u0001")
            fixed = F.transform(F.split(compose(F.when(whole.rlike(_COMPOSED), whole)), "\u0000"), lambda x: F.when(x != "\u0001", x))
        else:
            fixed = compose(F.when(F.col(c).rlike(_COMPOSED), F.col(c)))
        out = out.withColumn(c, F.coalesce(fixed, F.col(c)))
    return out


def normalize_text(text: Column) -> Column:
    """Full-width digits, letters, percent sign and point to half width; no commas between digits."""
    return F.regexp_replace(F.translate(text, FULLWIDTH, HALFWIDTH), r"(?<=\d),(?=\d)", "")


def normalize_for_match(text: Column) -> Column:
    """Normalised, without any white space, in lower case."""
    return F.lower(F.regexp_replace(normalize_text(text), r"(?U)\s+", ""))


def normalize_faithfulness(text: Column) -> Column:
    """Normalised; English months and ISO dates in Chinese form, millions and billions in 亿.

    Months go first, so English dates keep their order, and the verb "may" becomes a month as well.
    """
    out = normalize_text(text)
    for number, name in MONTHS:
        out = F.regexp_replace(out, rf"(?i)\b{name}\b", f"{number}月")
    out = F.regexp_replace(out, r"\b(\d{4})-(?:0(\d)|([1-9]\d))-(?:0(\d)|([1-9]\d))\b", "$1年$2$3月$4$5日")

    def in_yi(value: Column, scale: Column) -> Column:
        amount = F.when(F.lower(scale) == "million", value.cast("double") / 100).otherwise(value.cast("double") * 10)
        plain = F.format_string("%.10f", amount)
        return F.concat(F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ""), F.lit("亿"))

    def converted(whole: Column) -> Column:
        between, values, scales = F.split(whole, _SCALED, -1), F.regexp_extract_all(whole, F.lit(_SCALED), F.lit(1)), F.regexp_extract_all(whole, F.lit(_SCALED), F.lit(2))
        pieces = F.zip_with(between, F.zip_with(values, scales, in_yi), lambda gap, amount: F.concat(gap, F.coalesce(amount, F.lit(""))))
        return F.array_join(pieces, "")

    return let(lambda whole: F.when(whole.rlike(_SCALED), converted(whole)).otherwise(whole), out)


def pairs_of(run: Column) -> Column:
    """All strings of two neighbouring characters."""
    n = F.char_length(run)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def cjk_pairs_in_runs(text: Column) -> Column:
    """Pairs within each unbroken run of CJK characters."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"[{_CJK}]+"), F.lit(0)), pairs_of))


def cjk_pairs_across(text: Column) -> Column:
    """Pairs of neighbours once everything but CJK characters is left out."""
    return pairs_of(F.regexp_replace(text, f"[^{_CJK}]", ""))


def ascii_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|\d+(?:\.\d+)?%?"), F.lit(0)), F.lower)


def extract_terms(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The set of recall terms: CJK pairs within runs, words and numbers, without stopwords."""
    norm = normalize_text(text)
    return F.array_except(F.concat(cjk_pairs_in_runs(norm), ascii_tokens(norm)), F.array(*map(F.lit, stopwords)))


def numbers_of(text: Column) -> Column:
    """Ordered distinct structs (value, pct) of an already normalised text."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.struct(F.regexp_replace(t, "%$", "").alias("value"), F.endswith(t, F.lit("%")).alias("pct"))))


def extract_numbers(text: Column) -> Column:
    return numbers_of(normalize_text(text))


def extract_faithfulness_numbers(text: Column) -> Column:
    return numbers_of(normalize_faithfulness(text))


def bounded_numbers(normalized: Column) -> Column:
    """Numbers of a normalised text that no digit or point touches, with ``%`` where one follows.

    One pass over the text instead of one search for each number: a value is supported if and only if it is in the list.
    """
    found = F.regexp_extract_all(normalized, F.lit(r"(?<![\d.])\d+(?:\.\d+)?(?![\d.])(?:\s*%)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"\s", "")))


def unsupported_numbers(numbers: Column, bounded: Column) -> Column:
    """The structs of ``numbers`` that the list of ``bounded_numbers`` does not hold; a percentage needs a percentage."""
    lost = lambda found, plain: F.filter(numbers, lambda n: ~F.when(n["pct"], F.array_contains(found, F.concat(n["value"], F.lit("%")))).otherwise(F.array_contains(plain, n["value"])))
    return let(lambda found: let(lambda plain: lost(found, plain), F.transform(found, lambda t: F.regexp_replace(t, "%$", ""))), bounded)


def number_supported(value: Column, pct: Column, context: Column) -> Column:
    one = F.array(F.struct(value.alias("value"), pct.alias("pct")))
    return F.size(unsupported_numbers(one, bounded_numbers(normalize_text(context)))) == 0


def detect_negation(text: Column) -> Column:
    return normalize_text(text).rlike("|".join(NEGATION_WORDS))


def condition_keywords(text: Column) -> Column:
    norm = normalize_text(text)
    return F.filter(F.array(*map(F.lit, CONDITION_KEYWORDS)), lambda k: F.contains(norm, k))


def co_occur(a: Column, b: Column, context: Column, window: str = "sentence") -> Column:
    """Whether both entities stand in one sentence (cut at 。；and line ends) or one paragraph."""
    parts = F.split(context, "\n\n" if window == "paragraph" else "[。；\n]")
    both = let(lambda na, nb: F.exists(F.transform(parts, normalize_for_match), lambda s: F.contains(s, na) & F.contains(s, nb)), normalize_for_match(a), normalize_for_match(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(False)).otherwise(both)


def entity_pairs(text: Column, context: Column, most: int = 10, ahead: int = 4) -> Column:
    """Pairs of CJK substrings of 2 to 10 characters that the context holds, in order of place and length."""
    runs = F.regexp_extract_all(text, F.lit(f"[{_CJK}]+"), F.lit(0))

    def substrings(run: Column) -> Column:
        n = F.char_length(run)
        starts = F.sequence(F.lit(1), n)
        each = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.lit(10)), lambda k: F.when(i + k - 1 <= n, F.substring(run, i, k))))
        return F.filter(F.flatten(each), lambda s: s.isNotNull())

    within = lambda norm: F.filter(F.array_distinct(F.flatten(F.transform(runs, substrings))), lambda s: F.contains(norm, s))
    pairs = lambda found: F.flatten(F.transform(found, lambda x, i: F.transform(F.slice(found, i + 2, F.lit(ahead)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return F.slice(let(pairs, let(within, normalize_for_match(context))), 1, most)


def bm25_tokens(text: Column, protect=None) -> Column:
    """Words of letters, digits and underscores in lower case, then CJK pairs; with repetitions. ``protect`` runs first."""
    text = protect(text) if protect else text
    return F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), cjk_pairs_across(text))


_MARKER = r"(?i)【(?:模拟政策|来源)(?U:\s)+([^】]+)】|\[source:(?U:\s)*([^\]]+)\]"


def source_markers(text: Column) -> Column:
    """Sources that a text names by markers, trimmed, each once, in order."""
    first, second = F.regexp_extract_all(text, F.lit(_MARKER), F.lit(1)), F.regexp_extract_all(text, F.lit(_MARKER), F.lit(2))
    either = F.zip_with(first, second, lambda a, b: F.when(F.length(a) > 0, a).otherwise(b))
    return F.array_distinct(F.transform(either, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))


def amounts(text: Column) -> Column:
    """Numbers with their unit, in yuan; commas are not removed."""
    low = F.lower(text)
    values, units = F.regexp_extract_all(low, F.lit(_UNIT_PATTERN), F.lit(1)), F.regexp_extract_all(low, F.lit(_UNIT_PATTERN), F.lit(2))
    scale = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.zip_with(values, units, lambda v, u: v.cast("double") * F.coalesce(F.try_element_at(scale, F.coalesce(u, F.lit(""))), F.lit(1.0)))


NUMBER_SPAN = r"(?i)(?:([\x{4e00}-\x{9fff}]{2,6}))?(\$?\d[\d,]*(?:\.\d+)?\s*(?:million|billion|亿|万|元|个百分点)?%?)"


def number_spans(text: Column) -> Column:
    """Structs (before, raw): number spans with unit, and the 2 to 6 CJK characters right before each."""
    before, raw = F.regexp_extract_all(text, F.lit(NUMBER_SPAN), F.lit(1)), F.regexp_extract_all(text, F.lit(NUMBER_SPAN), F.lit(2))
    return F.zip_with(before, raw, lambda b, r: F.struct(F.coalesce(b, F.lit("")).alias("before"), r.alias("raw")))


def relevant_paragraphs(query: Column, context: Column) -> Column:
    """Paragraphs with a digit or a CJK pair of the query; all of them if there is none."""
    parts = F.filter(F.transform(F.split(context, "\n\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: F.length(p) > 0)
    kept = lambda all_, wanted: F.filter(all_, lambda p: p.rlike(r"(?U)\d") | F.arrays_overlap(cjk_pairs_across(p), wanted))
    return let(lambda all_, wanted: let(lambda some: F.when(F.size(some) > 0, some).otherwise(all_), kept(all_, wanted)), parts, cjk_pairs_across(query))


def missing_segments(gold: Column, covered: Column, most: int = 5) -> Column:
    """Struct (segments, tokens): runs of CJK characters whose pairs are not covered, the longest ``most`` in order of
    place, and the ASCII tokens that are not covered.

    Both characters of an uncovered pair count; pairs that are stopwords are never covered.
    """
    cjk = lambda c: c.rlike(f"^[{_CJK}]$")

    def runs(chars: Column, have: Column) -> Column:
        n = F.size(chars)
        at = lambda i: F.get(chars, i)
        lost = lambda i: F.when((i + 1 < n) & cjk(at(i)) & cjk(at(i + 1)), ~F.array_contains(have, F.concat(at(i), at(i + 1)))).otherwise(F.lit(False))
        gaps = F.transform(F.sequence(F.lit(0), n - 1), lost)
        shown = lambda gap: F.transform(chars, lambda c, i: F.when(F.get(gap, i) | ((i > 0) & F.coalesce(F.get(gap, i - 1), F.lit(False))), c).otherwise(F.lit("\u0000")))
        return F.regexp_extract_all(F.array_join(let(shown, gaps), ""), F.lit(r"\x00*([^\x00]+)"), F.lit(1))

    def longest(norm: Column, have: Column) -> Column:
        numbered = F.transform(let(runs, F.split(norm, ""), have), lambda s, i: F.struct((-F.char_length(s)).alias("n"), i.alias("i"), s.alias("s")))
        ordered = F.array_sort(F.transform(F.slice(F.array_sort(numbered), 1, most), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
        tokens = F.array_distinct(F.filter(ascii_tokens(norm), lambda t: ~F.array_contains(have, t)))
        return F.struct(F.transform(ordered, lambda x: x["s"]).alias("segments"), tokens.alias("tokens"))

    return let(longest, normalize_text(gold), covered)


def contains_all(text: Column, words: Column) -> Column:
    return F.forall(words, lambda w: F.contains(text, w))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# Display width of terminals (East Asian wide and full-width characters take two places).


def display_width(text: str) -> int:
    import unicodedata

    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def pad_display(text: str, width: int, align: str = "left") -> str:
    room = max(0, width - display_width(text))
    left = {"left": 0, "center": room // 2, "right": room}[align]
    return " " * left + text + " " * (room - left)


def truncate_display(text: str, width: int, suffix: str = "...") -> str:
    if display_width(text) <= width:
        return text
    kept, room = "", width - display_width(suffix)
    for c in text:
        if display_width(kept + c) > max(room, 0):
            break
        kept += c
    return kept + suffix


# Code fences, and JSON that a model's answer wraps.


def rounded(x: Column) -> Column:
    """A double from 0 to 1 to four decimals, by its exact binary value: what lies exactly in the middle goes to even.

    x times 2^70 is a whole number (all that is lost is far below the fourth decimal), so whole numbers decide.
    """
    wide = "decimal(38,0)"
    unit = F.expr(f"cast({1 << 70} as decimal(22,0))")
    times = lambda n: (n.cast("decimal(6,0)") * unit).cast(wide)

    def twice(scaled: Column) -> Column:
        whole = (F.floor(scaled).cast(wide) * F.lit(1 << 35).cast("decimal(11,0)")).cast(wide) + ((scaled - F.floor(scaled)) * float(1 << 35)).cast("long").cast(wide)
        return (whole * F.lit(20000).cast("decimal(5,0)")).cast(wide)

    below = lambda near, t: F.when(times(near * 2) > t, near - 1).when(times(near * 2 + 2) <= t, near + 1).otherwise(near)
    settled = lambda low, t: (low + ((t > times(low * 2 + 1)) | ((t == times(low * 2 + 1)) & (low % 2 == 1))).cast("long")) / F.lit(10000.0)
    return let(lambda v: let(lambda near, t: let(settled, below(near, t), t), F.floor(v * 10000).cast("long"), let(twice, v * float(1 << 35))), x)


def strip_code_fence(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^(?U:\s)*```[a-zA-Z]*(?U:\s)*", ""), r"(?U:\s)*```(?U:\s)*$", "")


def fenced(text: Column) -> Column:
    """What stands in the first code fence of a text, or the whole text, trimmed."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.regexp_replace(F.when(F.contains(text, F.lit("```")), inner).otherwise(text), r"(?U)^\s+|\s+$", "")


def salvaged_objects(text: Column, key: str = "object_value") -> Column:
    """The JSON objects of an answer's ``atomic_facts`` (array of strings): by parsing, or else, where the whole is broken,
    every complete flat object that holds the key. One that cannot be parsed itself voids them all."""
    plain = fenced(text)
    value = F.try_parse_json(F.concat(F.lit("["), plain, F.lit("]")))  # in a list, as the parser ignores what follows a value
    listed = F.coalesce(F.from_json(F.get_json_object(plain, "$.atomic_facts"), "array<string>"), F.array().cast("array<string>"))
    flat = F.regexp_extract_all(plain, F.lit(rf'\{{[^{{}}]*"{key}"[^{{}}]*\}}'), F.lit(0))
    sound = F.forall(flat, lambda x: F.try_parse_json(x).isNotNull())
    broken = F.when(sound, flat).otherwise(F.array().cast("array<string>"))
    return F.when(value.isNull(), broken).when(F.startswith(plain, F.lit("{")), listed).otherwise(F.array().cast("array<string>"))


#: Characters that a JSON string escapes, with the escape, in the order in which they are replaced.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def json_escaped(text: Column) -> Column:
    for plain, escape in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return text


def json_unescaped(text: Column) -> Column:
    """What a JSON string stands for. One pass: an escaped backslash does not start another escape."""
    return F.get_json_object(F.concat(F.lit('{"x":"'), text, F.lit('"}')), "$.x")


# The policy answer's sentence, what stands for a missing field, and for what is no JSON object.
POLICY_HEAD, POLICY_LV3, POLICY_CLINIC = "根据最新规约规定：", "1. 三级公立医院普通门诊报销比例为 ", "2. 特殊门诊（如恶性肿瘤放化疗）报销比例为 "
POLICY_FREE, POLICY_REMOTE = " 且免起付线；", "3. 异地就医政策："
POLICY_REFUSED, POLICY_PAID, POLICY_UNKNOWN, POLICY_BROKEN = "统筹基金一票否决不予报销", "可按规定报销", "未知", "规则装配异常，触发保底合规提示。"


def policy_answer(facts: Column) -> Column:
    """The sentence that a flat JSON object (lv3_ratio, special_clinic_ratio, remote_medical_covered) fills."""
    plain = F.trim(F.replace(F.replace(facts, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    field = lambda name: F.coalesce(F.get_json_object(plain, f"$.{name}"), F.lit(POLICY_UNKNOWN))
    remote = F.when(F.lower(F.coalesce(F.get_json_object(plain, "$.remote_medical_covered"), F.lit("true"))).isin("false", "0", ""), POLICY_REFUSED).otherwise(POLICY_PAID)
    told = F.concat(F.lit(POLICY_HEAD + POLICY_LV3), field("lv3_ratio"), F.lit("；" + POLICY_CLINIC), field("special_clinic_ratio"), F.lit(POLICY_FREE + POLICY_REMOTE), remote, F.lit("。"))
    return F.when(F.json_object_keys(plain).isNotNull(), told).otherwise(POLICY_BROKEN)
