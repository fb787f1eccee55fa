"""Understanding a question: tokens, expansion by a synonym dictionary, variants, complexity and the window of references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content, separators inside Chinese runs, cues of complexity, and a dictionary of sweeteners and concepts.
QUESTION_WORDS = "如何|怎么|是什么|是怎样|请问|有关|相关|机制|机理"
PARTICLES = "[和与及或、在是的了呢吗吧将把对跟同]"
STOPWORDS = ["如何", "怎么", "什么", "为何", "请问", "是否", "以及", "关于", "之间", "机制", "作用", "结合"]
COMPLEX_CUES = ["机制", "机理", "路径", "调控", "比较", "差异", "综述", "评估", "证据", "局限", "mechanism", "pathway", "compare", "difference", "review", "evidence", "limitation"]
BROAD_CUES = ["如何", "为什么", "关系", "影响", "驱动力", "相互作用", "结合", "how", "why", "interaction", "binding"]
SWEETENERS = {
    "蔗糖": ["sucrose", "白糖", "食糖", "table sugar"],
    "果糖": ["fructose", "果葡糖浆", "HFCS"],
    "葡萄糖": ["glucose", "右旋糖", "dextrose"],
    "甜菊糖": ["stevia", "甜菊糖苷", "stevioside", "rebaudioside"],
    "罗汉果糖": ["monk fruit", "罗汉果甜苷", "mogroside"],
    "阿斯巴甜": ["aspartame", "天冬酰苯丙氨酸甲酯", "APM"],
    "三氯蔗糖": ["sucralose", "蔗糖素", "Splenda"],
    "糖精": ["saccharin", "邻苯甲酰磺酰亚胺"],
    "安赛蜜": ["acesulfame", "乙酰磺胺酸钾", "Ace-K"],
    "纽甜": ["neotame", "N-[N-(3,3-二甲基丁基)-L-α-天冬氨酰]-L-苯丙氨酸"],
    "甜蜜素": ["cyclamate", "环己基氨基磺酸钠"],
    "赤藓糖醇": ["erythritol", "赤藓醇"],
    "木糖醇": ["xylitol", "戊五醇"],
    "山梨糖醇": ["sorbitol", "山梨醇"],
    "甘露糖醇": ["mannitol", "甘露醇"],
    "麦芽糖醇": ["maltitol", "麦芽糖醇"],
}
CONCEPTS = {
    "甜味": ["sweetness", "甜度", "甜感", "sweet taste", "甜味感知"],
    "甜味剂": ["sweetener", "甜味物质", "代糖", "sugar substitute"],
    "甜味受体": ["sweet receptor", "T1R2", "T1R3", "taste receptor"],
    "甜度": ["sweetness intensity", "相对甜度", "甜度值", "sweetness potency"],
    "后味": ["aftertaste", "余味", "回甘", "lingering taste"],
    "协同效应": ["synergy", "协同作用", "synergistic effect"],
    "糖尿病": ["diabetes", "血糖", "glucose", "insulin"],
    "肥胖": ["obesity", "体重", "BMI", "weight gain"],
    "代谢": ["metabolism", "代谢综合征", "metabolic syndrome"],
    "肠道菌群": ["gut microbiota", "肠道微生物", "intestinal flora"],
    "饮料": ["beverage", "软饮料", "soft drink"],
    "烘焙": ["baking", "焙烤", "bakery"],
    "乳制品": ["dairy", "奶制品", "milk products"],
}


def reverse_index(*dictionaries: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Lower-cased term to standard term; of several the last one counts (so glucose means the disease's entry)."""
    return {t.lower(): standard for d in dictionaries for standard, terms in d.items() for t in (standard, *terms)}


INDEX = reverse_index(SWEETENERS, CONCEPTS)


def topic_tokens(c: Column) -> Column:
    """Latin words of three characters and Chinese runs of two, less question words, particles and stopwords; sorted, distinct."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), f"({QUESTION_WORDS})", " ")
    latin = F.regexp_extract_all(t, F.lit("[a-z][a-z0-9+._-]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit("[一-鿿]{2,}"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(runs, lambda r: F.split(r, PARTICLES))), lambda p: (F.length(p) >= 2) & ~p.isin(STOPWORDS))
    return F.array_sort(F.array_distinct(F.concat(latin, parts)))


def _some(*values: Column) -> Column:
    """The values that are not NULL, the first of equal ones, in order."""
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def concepts_of(c: Column, index: Mapping[str, str] = INDEX) -> Column:
    """Standard terms whose names or synonyms the text contains; sorted, distinct. Without lambdas, so that all is generated code and the lower-cased text is worked out once."""
    low = F.lower(c)
    return F.sort_array(_some(*[F.when(low.contains(t), F.lit(s)) for t, s in index.items()]))


def expansion(c: Column, most: int = 10, dictionaries: Sequence[Mapping[str, Sequence[str]]] = (SWEETENERS, CONCEPTS)) -> Column:
    """The question and the synonyms of its concepts, sorted so that a cut at ``most`` terms is always the same, joined by OR."""
    table: dict[str, list[str]] = {}
    for d in dictionaries:
        for k, v in d.items():
            table.setdefault(k, []).extend(v)
    found = concepts_of(c, reverse_index(*dictionaries))
    none = F.array().cast("array<string>")
    terms = F.sort_array(F.array_distinct(F.concat(none, *[F.when(F.array_contains(found, k), F.array(*[F.lit(x) for x in v])).otherwise(none) for k, v in table.items()])))
    return F.array_join(F.slice(F.concat(F.array(c), terms), 1, most), " OR ")


def variants(expanded: Column, question: Column) -> Column:
    """Up to five distinct searches: expanded, original, its first part, the first three tokens, and a broad pair."""
    tokens = topic_tokens(question)
    first = F.when(expanded.contains(" OR "), F.substring_index(expanded, " OR ", 1))
    short = F.when(F.size(tokens) > 0, F.array_join(F.slice(tokens, 1, 3), " "))
    broad = F.when(F.size(tokens) >= 2, F.concat_ws(" ", F.get(tokens, 0), F.get(tokens, 1), F.lit("相互作用 机制")))
    return F.slice(_some(*[F.nullif(F.trim(v), F.lit("")) for v in (expanded, question, first, short, broad)]), 1, 5)


def complexity(c: Column) -> Column:
    """0 to 1 by length (at most 0.4) and cues (0.15 and 0.08 each)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    cues = [*((x, 0.15) for x in COMPLEX_CUES), *((x, 0.08) for x in BROAD_CUES)]
    score = sum((F.when(low.contains(x), w).otherwise(0.0) for x, w in cues), F.least(F.lit(0.4), F.length(low) / 120.0))
    return F.when(low == "", 0.0).otherwise(F.least(F.lit(1.0), score))


def reference_window(score: Column, least: int, most: int) -> Column:
    """How many references a question of that complexity may have."""
    least, most = max(1, least), max(1, least, most)
    to = lambda more: F.lit(max(least, min(most, least + more)))
    return F.when(score < 0.20, to(5)).when(score < 0.30, to(15)).when(score < 0.55, to(25)).otherwise(F.lit(most))


def related_terms(term: Column, dictionaries: Sequence[Mapping[str, Sequence[str]]] = (SWEETENERS, CONCEPTS)) -> Column:
    """Synonyms of the standard term that ``term`` names or is a synonym of, as listed; an empty array for others."""
    index = reverse_index(*dictionaries)
    lists = {k: v for d in reversed(dictionaries) for k, v in d.items()}
    entries = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*[F.lit(x) for x in lists[s]]).alias("v")) for t, s in index.items()])
    low = F.lower(term)
    return F.coalesce(F.get(F.filter(entries, lambda e: e["t"] == low), F.lit(0))["v"], F.array().cast("array<string>"))
