"""Built-in samples, preset responses, and the seeded generator of the 100-row evaluation set."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import mutate
from plumbline.sources.schemas import PRESET, SAMPLE

# The five built-in samples (id, question, gold context, gold answer, expected entities).
SAMPLES = (
    (
        "med-ins-001",
        "职工医保普通门诊的报销比例、起付线和年度限额是多少？",
        "根据职工基本医疗保险门诊共济保障机制，参保职工在定点医疗机构发生的政策范围内普通门诊费用，纳入统筹基金支付：在职职工报销比例为70%，退休人员为75%；年度起付线为200元；在职职工年度最高支付限额为6000元，退休人员为7000元。",
        "职工医保普通门诊由统筹基金支付：在职职工报销比例70%、年度最高支付限额6000元；退休人员报销比例75%、年度限额7000元；年度起付线200元；需在定点医疗机构就医。",
        ("70%", "75%", "200元", "6000元", "定点医疗机构"),
    ),
    (
        "med-ins-002",
        "城乡居民医保住院在不同级别医院的起付线和报销比例分别是多少？",
        "城乡居民基本医疗保险住院待遇标准：一级及以下医疗机构起付线300元，政策范围内费用报销比例85%；二级医疗机构起付线600元，报销比例70%；三级医疗机构起付线1200元，报销比例55%。一个自然年度内，基本医保统筹基金最高支付限额（封顶线）为20万元。",
        "城乡居民医保住院：一级及以下医疗机构起付线300元、报销85%；二级600元、70%；三级1200元、55%；一个自然年度内统筹基金封顶线20万元。",
        ("300元", "85%", "600元", "70%", "1200元", "55%", "20万"),
    ),
    (
        "med-ins-003",
        "大病保险的起付线是多少？报销政策如何？对困难群体有没有倾斜？",
        "大病保险的保障对象为参加城乡居民基本医疗保险的人员。一个自然年度内，个人自付的合规医疗费用累计超过起付线1.5万元的部分，纳入大病保险支付范围，报销比例为60%，不设封顶线。特困人员、低保对象等困难群体起付线降低50%，报销比例提高5个百分点。",
        "大病保险起付线为1.5万元，个人自付合规费用超过起付线的部分报销60%，不设封顶线；特困人员、低保对象等困难群体起付线降低50%，报销比例提高5个百分点。",
        ("1.5万", "60%", "困难群体", "5个百分点"),
    ),
    (
        "med-ins-004",
        "异地就医的住院费用可以直接结算并正常报销吗？",
        "异地就医直接结算须同时满足两个前置条件：一是参保人员已办理异地就医备案；二是就医医院为开通跨省联网结算的定点医疗机构。满足条件的，住院费用可直接结算，按参保地政策报销。例外情形：未备案自行外出就医的，报销比例在参保地政策基础上降低20个百分点；急诊抢救人员视同已备案；非医保目录内费用不纳入报销范围。",
        "需满足前置条件：已办理异地就医备案、并在开通跨省联网结算的定点医疗机构就医，方可直接结算并按参保地政策报销；未备案自行外出就医的，报销比例降低20个百分点；急诊抢救人员视同已备案；非医保目录内费用不纳入报销范围。",
        ("异地就医备案", "20个百分点", "急诊", "医保目录"),
    ),
    (
        "med-ins-005",
        "门诊慢特病中高血压的统筹基金年度限额和报销比例是多少？",
        "高血压病（Ⅱ级及以上）纳入门诊慢特病保障范围。统筹基金支付限额为每人每年1500元，政策范围内费用报销比例为70%。待遇认定须经二级及以上定点医疗机构确诊，并由医保经办机构审核通过。",
        "高血压病（Ⅱ级及以上）纳入门诊慢特病保障范围，统筹基金支付限额每人每年1500元，政策范围内费用报销比例70%。",
        ("高血压", "门诊慢特病", "统筹基金"),
    ),
)
# Preset responses of the built-in samples; None stands for the gold text.
PRESETS = {
    "med-ins-001": (None, None),
    "med-ins-002": (
        "城乡居民基本医疗保险住院待遇标准：一级及以下医疗机构起付线300元，政策范围内费用报销比例85%；二级医疗机构起付线600元，报销比例70%。",
        "城乡居民医保住院：一级及以下医疗机构起付线300元，报销85%；二级医疗机构起付线600元，报销70%。三级医疗机构与年度封顶线的政策暂未查询到。",
    ),
    "med-ins-003": (None, "大病保险：一个自然年度内，个人自付合规医疗费用累计超过起付线1.5万元的部分纳入支付范围，报销比例为60%，不设封顶线。"),
    "med-ins-004": (
        "异地就医直接结算政策：参保人员办理异地就医备案后，在备案地开通联网结算的定点医疗机构住院，可直接结算，按参保地政策报销。",
        "可以，但需先办理异地就医备案：备案后在开通联网结算的定点医疗机构住院，可直接结算并按参保地政策正常报销。",
    ),
    "med-ins-005": (None, "高血压病（Ⅱ级及以上）属于门诊慢特病保障范围，统筹基金年度支付限额为每人每年2500元，政策范围内费用报销比例为85%；待遇认定须二级及以上定点医疗机构确诊，并经医保经办机构审核。"),
}
# What the generator fills its templates with, and the templates (question, context, answer, entities).
LEVELS = ("一级及以下", "二级", "三级")
DISEASES = ("高血压", "糖尿病", "冠心病", "慢性肾病", "慢阻肺", "类风湿关节炎", "强直性脊柱炎", "乙肝", "甲状腺功能减退", "帕金森病")
DISEASE_LIMITS = (1500, 2000, 2500, 3000, 4000)
RATIOS = (55, 60, 65, 70, 75, 80, 85, 90)
DEDUCTIBLES = (100, 200, 300, 500, 600, 800, 1000, 1200)
YEAR_LIMITS = (10, 15, 20, 25, 30)
TEMPLATES = (
    (
        "城乡居民医保住院在{level}医疗机构的起付线、报销比例和年度封顶线是多少？",
        "城乡居民基本医疗保险住院待遇标准：{level}医疗机构起付线{deductible}元，政策范围内费用报销比例{ratio}%；一个自然年度内，基本医保统筹基金最高支付限额（封顶线）为{limit}万元。",
        "城乡居民医保住院在{level}医疗机构起付线{deductible}元、报销{ratio}%；一个自然年度内统筹基金封顶线{limit}万元。",
        ("{deductible}元", "{ratio}%", "{limit}万"),
    ),
    (
        "{disease}是否纳入门诊慢特病保障范围？统筹基金年度限额和报销比例是多少？",
        "{disease}病纳入门诊慢特病保障范围。统筹基金支付限额为每人每年{limit}元，政策范围内费用报销比例为{ratio}%。待遇认定须经二级及以上定点医疗机构确诊，并由医保经办机构审核通过。",
        "{disease}病纳入门诊慢特病保障范围，统筹基金支付限额每人每年{limit}元，政策范围内费用报销比例{ratio}%。",
        ("{disease}", "门诊慢特病", "统筹基金", "{limit}元", "{ratio}%"),
    ),
    (
        "大病保险的基础起付线、报销比例是多少，对困难群体有没有倾斜？",
        "大病保险的保障对象为参加城乡居民基本医疗保险的人员。一个自然年度内，个人自付的合规医疗费用累计超过起付线{deductible}元的部分，纳入大病保险支付范围，报销比例为{ratio}%，不设封顶线。特困人员、低保对象等困难群体起付线降低50%，报销比例提高5个百分点。",
        "大病保险起付线为{deductible}元，个人自付合规费用超过起付线的部分报销{ratio}%，不设封顶线；困难群体起付线降低50%，报销比例提高5个百分点。",
        ("{deductible}元", "{ratio}%", "困难群体", "5个百分点"),
    ),
)
# What the mutations cut at and what they append, by name in the order of their turns.
CONDITION_MARKERS = ("未备案自行外出就医的", "非医保目录内费用不纳入报销范围", "例外情形")
FABRICATION = "同时，参保人员可享受补充商业保险额外10%的报销优惠。"
MUTATIONS = ("数字篡改", "实体缺失", "条件丢失", "无关注入")

_FIELDS = [f.split(" ")[0] for f in SAMPLE.split(", ")]


def _row(**values) -> dict:
    return {f: values.get(f, [] if f in ("expected_entities", "required_entities") else "standard" if f == "category" else None) for f in _FIELDS}


def builtin_rows() -> list[dict]:
    return [_row(id=i, question=q, ground_truth_context=c, ground_truth_answer=a, expected_entities=list(e)) for i, q, c, a, e in SAMPLES]


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f] for f in _FIELDS) for r in rows], SAMPLE)


def builtin_samples(spark: SparkSession) -> DataFrame:
    return _frame(spark, builtin_rows())


def preset_responses(spark: SparkSession) -> DataFrame:
    gold = {s[0]: (s[2], s[3]) for s in SAMPLES}
    return spark.createDataFrame([(k, c or gold[k][0], a or gold[k][1]) for k, (c, a) in PRESETS.items()], PRESET)


#: Which slots each template draws, in the order in which they are drawn, and what from.
DRAWN = (
    {"level": LEVELS, "deductible": DEDUCTIBLES, "ratio": RATIOS, "limit": YEAR_LIMITS},
    {"disease": DISEASES, "limit": DISEASE_LIMITS, "ratio": RATIOS},
    {"deductible": DEDUCTIBLES, "ratio": RATIOS},
)
# How edge questions vary, by turns, and the slots of the edge policy without a deductible.
ZERO = {"level": "一级及以下", "deductible": "0", "ratio": "70", "limit": "20"}
ASKED_BEHIND, ASKED_BEFORE, SHORTER = "请明确说明零起付线。", "请依据所指政策回答：", (("城乡居民", "居保"), ("大病保险", "大病险"))
#: The built-in sample that has a condition to lose, and its source.
CONDITIONAL = ("med-ins-004", "seed_d")


def slot_plan(seed: int, n: int) -> list[tuple[int, int, dict[str, str]]]:
    """(ordinal, template, slots): all that is random, drawn once."""
    choice = random.Random(seed).choice
    return [(i, i % len(DRAWN), {slot: str(choice(values)) for slot, values in DRAWN[i % len(DRAWN)].items()}) for i in range(n)]


def _filled(planned: DataFrame) -> DataFrame:
    """(ordinal, slots, template) with the template's texts, slots filled in."""
    kinds = "template int, q string, c string, a string, e array<string>"
    templates = planned.sparkSession.createDataFrame([(k, q, c, a, list(e)) for k, (q, c, a, e) in enumerate(TEMPLATES)], kinds)
    names = sorted({slot for drawn in DRAWN for slot in drawn})

    def fill(text):
        for name in names:
            text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(F.try_element_at(F.col("slots"), F.lit(name)), F.lit("")))
        return text

    both = planned.join(F.broadcast(templates), "template")
    return both.select("ordinal", fill(F.col("q")).alias("question"), fill(F.col("c")).alias("ground_truth_context"), fill(F.col("a")).alias("ground_truth_answer"), F.transform("e", fill).alias("expected_entities"))


def _scoped(rows: DataFrame, source) -> DataFrame:
    """Rows of a source: label before question and context, every expected entity required."""
    label = F.concat(F.lit("【模拟政策 "), F.col("source_id"), F.lit("】"))
    named = rows.withColumn("source_id", source)
    return named.withColumns({"question": F.concat(label, "question"), "ground_truth_context": F.concat(label, "ground_truth_context"), "required_entities": F.col("expected_entities")})


def _lettered(prefix: str, n) -> Column:
    return F.concat(F.lit(prefix), F.translate(n.cast("string"), "0123456789", "abcdefghij"))


def _numbered(prefix: str, n) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 3, "0"))


def generated_samples(spark: SparkSession, seed: int = 42, synthetic: int = 55, edge: int = 25, adversarial: int = 15) -> DataFrame:
    """The same seed gives the same rows, in order: synthetic, edge and adversarial ones, and the five built-in."""
    if min(synthetic, edge, adversarial) < 0 or (synthetic == 0 and edge + adversarial):
        raise ValueError("counts must not be negative, and edge and adversarial rows need a synthetic one")
    plan = "ordinal int, template int, slots map<string,string>"
    turn = lambda n: spark.range(n).select(F.col("id").cast("int").alias("at"))
    base = _scoped(_filled(spark.createDataFrame(slot_plan(seed, synthetic), plan)), _lettered("policy_", F.col("ordinal")))
    made = base.withColumns({"group": F.lit(0), "at": F.col("ordinal"), "id": _numbered("syn-", F.col("ordinal")), "category": F.lit("synthetic")})
    again = lambda n: turn(n).join(base, F.pmod(F.col("at"), F.lit(max(synthetic, 1))) == F.col("ordinal"))

    kind = F.pmod(F.col("at"), F.lit(3))
    shorter = F.col("question")
    for long, short in SHORTER:
        shorter = F.replace(shorter, F.lit(long), F.lit(short))
    zero = _filled(spark.createDataFrame([(0, 0, ZERO)], plan)).drop("ordinal")
    free = _scoped(turn(edge).where(kind == 0).crossJoin(F.broadcast(zero)), _lettered("edge_", F.col("at"))).withColumn("question", F.concat("question", F.lit(ASKED_BEHIND)))  # one row on that side
    asked = again(edge).where(kind != 0).drop("ordinal").withColumn("question", F.when(kind == 1, F.concat(F.lit(ASKED_BEFORE), "question")).otherwise(shorter))
    edges = free.unionByName(asked).withColumns({"group": F.lit(1), "id": _numbered("edge-", F.col("at")), "category": F.lit("edge")})

    builtin = builtin_samples(spark)
    letter = F.substring(F.lit("abcdefghij"), F.substring("id", -1, 1).cast("int"), F.lit(1))
    seeds = _scoped(builtin, F.concat(F.lit("seed_"), letter)).withColumns({"group": F.lit(3), "at": F.substring("id", -1, 1).cast("int"), "category": F.lit("seed")})
    texts = ["question", "ground_truth_context", "ground_truth_answer", "expected_entities", "source_id", "required_entities"]
    name = F.element_at(F.array(*map(F.lit, MUTATIONS)), F.pmod(F.col("at"), F.lit(len(MUTATIONS))) + 1)
    conditional = seeds.where(F.col("id") == CONDITIONAL[0]).withColumn("source_id", F.lit(CONDITIONAL[1])).select(*texts)
    losing = turn(adversarial).withColumn("mutation_type", name).where(F.col("mutation_type") == MUTATIONS[2]).crossJoin(F.broadcast(conditional))  # one row on that side
    others = again(adversarial).withColumn("mutation_type", name).where(F.col("mutation_type") != MUTATIONS[2]).select("at", "mutation_type", *texts)
    answer, told = F.col("ground_truth_answer"), F.col("mutation_type")
    candidate = (
        F.when(told == MUTATIONS[0], mutate.number_raised(answer)).when(told == MUTATIONS[1], mutate.entity_dropped(answer, F.get("expected_entities", F.lit(0))))
        .when(told == MUTATIONS[2], mutate.condition_dropped(answer, CONDITION_MARKERS)).otherwise(mutate.claim_added(answer, FABRICATION))
    )
    changed = F.when(candidate != answer, candidate).otherwise(F.raise_error(F.concat(F.lit("nothing is changed by "), told)))
    wrong = losing.unionByName(others).withColumns({"group": F.lit(2), "id": F.concat(_numbered("adv-", F.col("at")), F.lit("-"), told), "category": F.lit("adversarial"), "candidate_answer": changed})

    parts = made.unionByName(edges, allowMissingColumns=True).unionByName(wrong, allowMissingColumns=True).unionByName(seeds, allowMissingColumns=True)
    kinds = dict(x.split(" ") for x in SAMPLE.split(", "))
    return parts.orderBy("group", "at").select(*[F.col(f).cast(kinds[f]).alias(f) for f in _FIELDS])
