"""Personal data: regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation weighs them and a classifier decides.

All work on documents is column expressions. What comes to the driver are counts of kinds, votes and forms: at most
4 kinds x 3 ** len(LABELERS) x 12 rows, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import between, pieces, running

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base spans, without needless backtracking, then wider ones whose spans must win the vote.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.-])[0-9]{4}[./\t][0-9]{4}[./\t][0-9]{4}[./\t][0-9]{4}(?![0-9])|(?<![0-9.-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])|(?<![0-9A-Za-z+])00[1-9][0-9]{0,2}[\x20.-][0-9\x20.-]{6,14}[0-9](?![0-9A-Za-z])",
}
# What a text must hold for a pattern to be tried.
TRIGGER = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
WIDE_TRIGGER = {"email": r"[\[({\x20]at[\])}\x20]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{4}", "phone": "[0-9]{3}"}

# Gazetteers of top-level domains, card issuers, calling codes, addresses that belong to nobody; and context cues.
TLDS = """com org net edu gov mil int info biz io co me app dev ai tv us uk de fr es it nl be ch at pl pt se no dk fi ie cz sk hu ro bg gr
ru ua tr il in cn jp kr tw hk sg my th vn id ph au nz ca mx br ar cl pe za ng ke eg eu""".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|30|36|38|6)"
CALLING = r"^(?:00)?(?:1[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|85[0-9]|88[06]|9[679][0-9])|^[2-9]"
NOBODYS = r"^(?:0|127|255|2(?:2[4-9]|3[0-9]|4[0-9]|5[0-5]))\."
CUES = {
    "email": r"mail|contact|write|reach|courrier|correo|kontakt|adresse|user",
    "ip": r"\bip\b|address|host|server|login|client|adresse|dirección",
    "card": r"card|visa|master|amex|credit|payment|carte|tarjeta|karte",
    "phone": r"phone|tel|call|mobile|cell|fax|téléphone|teléfono|anruf|dial",
}
AGAINST = r"version|\bv\.?$|isbn|issn|doi|order|invoice|serial|part no|section|figure|table"

LABELERS = ("regex", "shape", "gazetteer", "context", "edges")


def _find(df: DataFrame, text: Column, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each named (pattern, trigger): its leftmost non-overlapping matches as array<struct<start,end,m,before,next>>,
    in code points, end exclusive; ``before`` holds up to 40 characters on the left (at most back to the start of the match before), ``next`` the
    character on the right. Each step is a column of its own, so that no expression is worked out twice for a text, and contexts come from the
    pieces between matches, so that none is looked up from the text's start."""
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_m_{k}": F.when(F.regexp_like(text, F.lit(t)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, (p, t) in patterns.items()})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, (p, _) in patterns.items()})

    def lengths(k: str) -> Column:
        zipped = F.arrays_zip(F.slice(f"_g_{k}", 1, F.size(f"_m_{k}")).alias("g"), F.col(f"_m_{k}").alias("m"))
        return F.transform(zipped, lambda z: F.length(z["g"]) + F.length(z["m"]))

    def spans(k: str) -> Column:
        m, g, n = F.col(f"_m_{k}"), F.col(f"_g_{k}"), F.size(f"_m_{k}")
        blank = F.array(F.lit(""))
        zipped = F.arrays_zip(
            F.col(f"_e_{k}").alias("e"), m.alias("m"), F.slice(g, 1, n).alias("g"), F.slice(F.concat(blank, m), 1, n).alias("pm"),
            F.slice(g, 2, n).alias("ng"), F.concat(F.slice(m, 2, n), blank).alias("nm"),
        )
        return F.transform(zipped, lambda z: F.struct(
            (z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), z["m"].alias("m"),
            F.right(F.concat(F.right(z["pm"], F.lit(40)), F.right(z["g"], F.lit(40))), F.lit(40)).alias("before"),
            F.left(F.concat(F.left(z["ng"], F.lit(1)), F.left(z["nm"], F.lit(1))), F.lit(1)).alias("next"),
        ))

    df = df.withColumns({f"_l_{k}": lengths(k) for k in patterns})
    df = df.withColumns({f"_e_{k}": running(F.col(f"_l_{k}")) for k in patterns})
    return df.withColumns({k: F.when(F.size(f"_m_{k}") > 0, spans(k)).otherwise(F.array().cast(SPANS)) for k in patterns})


SPANS = "array<struct<start:int,end:int,m:string,before:string,next:string>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)

    def step(total: Column, i: Column) -> Column:
        x = F.substr(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IS_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"


def passes(kind: str, m: Column) -> Column:
    """The base rule of a kind beyond its pattern."""
    n = F.length(digits(m))
    return {
        "email": F.lit(True),
        "ip": F.regexp_like(m, F.lit(IS_IP)),
        "card": F.when((n >= 16) & (n <= 19), luhn(digits(m))).otherwise(False),
        "phone": (n >= 8) & (n <= 15),
    }[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column, base: bool) -> Column:
    m, d, n = s["m"], digits(s["m"]), F.length(digits(s["m"]))
    before = F.lower(s["before"])
    left, right = F.right(s["before"], F.lit(1)), s["next"]
    tld = F.lower(F.regexp_replace(F.substring_index(m, ".", -1), "^.*[^A-Za-z0-9-]", ""))
    shape = {
        "email": _vote(F.regexp_like(tld, F.lit("^[a-z]{2,24}$")), F.lit(True)),
        "ip": _vote(F.regexp_like(m, F.lit(IS_IP)) | m.contains(":"), F.lit(True)),
        "card": _vote(luhn(d), F.lit(True)),
        "phone": _vote((n >= 8) & (n <= 15), F.lit(True)),
    }[kind]
    gazetteer = {
        "email": _vote(tld.isin(TLDS), F.lit(True)),
        "ip": _vote(m.contains(":") | ~F.regexp_like(m, F.lit(NOBODYS)), F.lit(True)),
        "card": _vote(F.regexp_like(d, F.lit(ISSUERS)), F.lit(True)),
        "phone": _vote(F.regexp_like(d, F.lit(CALLING)), F.lit(True)),
    }[kind]
    context = _vote(F.regexp_like(before, F.lit(CUES[kind])), F.regexp_like(before, F.lit(AGAINST)))
    edges = _vote(~F.regexp_like(left, F.lit(r"[\p{L}\p{N}_]")) & ~F.regexp_like(right, F.lit(r"[\p{L}\p{N}_]")), F.lit(True))
    return F.array(F.lit(1 if base else 0), shape, gazetteer, context, edges)


def _form(s: Column) -> Column:
    """What no labeler looks at: the match's length, and whether a bracket, quote or colon stands before it."""
    opened = F.regexp_like(s["before"], F.lit(r"[(\[<\"':=]\s?$")).cast("int")
    return F.least(F.floor(F.length(s["m"]) / 6), F.lit(5)).cast("int") * 2 + opened


def _apart() -> dict[str, Column]:
    """Steps that leave of the wide spans ``_wide_<kind>`` those outside of the base spans ``_own_<kind>``, in ``_apart``: in order of kind and start, no base
    span before may end, and none after may start, inside. The kinds stand one after another on one line of positions."""
    every, far = F.col("_every"), (1 << 62)

    def marked(k: str, base: bool) -> Column:
        line = KINDS.index(k) << 32
        return F.transform(f"_{'own' if base else 'wide'}_{k}", lambda s: F.struct((s["start"] + F.lit(line)).alias("start"), (s["end"] + F.lit(line)).alias("end"), F.lit(base).alias("base"), F.lit(KINDS.index(k)).alias("kind"), s.alias("s")))

    wide = F.concat(*[marked(k, False) for k in KINDS])
    some = sum((F.size(f"_wide_{k}") for k in KINDS), F.lit(0)) > 0
    zipped = F.arrays_zip(every.alias("x"), F.col("_ends").alias("ends"), F.reverse("_next").alias("next"))
    return {
        "_every": F.when(some, F.array_sort(F.concat(*[marked(k, True) for k in KINDS], wide))),
        "_to": F.transform(every, lambda x: F.when(x["base"], x["end"]).otherwise(0)),
        "_from": F.reverse(F.transform(every, lambda x: F.when(x["base"], x["start"]).otherwise(far))),
        "_ends": F.when(every.isNotNull(), running(F.col("_to"), F.greatest, 0, "bigint")),
        "_next": F.when(every.isNotNull(), running(F.col("_from"), F.least, far, "bigint")),
        "_apart": F.filter(zipped, lambda z: ~z["x"]["base"] & (z["ends"] <= z["x"]["start"]) & (z["next"] >= z["x"]["end"])),
    }


def _packed(docs: DataFrame, *leave: str) -> DataFrame:
    """All columns of ``docs`` but ``leave`` in one struct ``_row``, so that no name of theirs meets one of the steps'."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in leave]).alias("_row"), *[F.col(f"`{c}`").alias(f"_given_{i}") for i, c in enumerate(leave)])


def labelled(docs: DataFrame, text_col: str = "text", out_col: str = "candidates") -> DataFrame:
    """``docs`` with its candidate spans: array<struct<kind,start,end,base,votes,form>> by kind, then start.

    Base spans satisfy the kind's pattern and rule; others come from wider patterns and lie outside of the base spans of their kind.
    Null text: empty. Whole texts are read, in time that grows with their length and number of spans; no shuffle. Repeated rows have the same spans;
    an empty table gives no rows. A column named ``out_col`` is replaced; others stay as they are, whatever their names.
    """

    def valid(k: str) -> Column:
        return F.filter(f"_base_{k}", lambda s: passes(k, s["m"]))

    rows = _packed(docs.drop(out_col)).withColumn("_text", F.coalesce(F.col("_row")[text_col], F.lit("")))
    step = _find(rows, F.col("_text"), {f"_base_{k}": (BASE[k], TRIGGER[k]) for k in KINDS} | {f"_wide_{k}": (WIDE[k], WIDE_TRIGGER[k]) for k in KINDS})
    step = step.withColumns({f"_own_{k}": valid(k) for k in KINDS})
    for name, c in _apart().items():
        step = step.withColumn(name, c)

    def apart(k: str) -> Column:
        own = F.filter("_apart", lambda z: z["x"]["kind"] == KINDS.index(k))
        return F.when(F.size("_apart") > 0, F.transform(own, lambda z: z["x"]["s"])).otherwise(F.array().cast(SPANS))

    def spans(k: str, base: bool) -> Column:
        return F.transform(F.col(f"_own_{k}") if base else apart(k), lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), _votes(k, s, base).alias("votes"), _form(s).alias("form")))

    parts = [spans(k, base) for k in KINDS for base in (True, False)]
    return step.select("_row.*", F.array_sort(F.concat(*parts)).alias(out_col))


@dataclass
class Model:
    """Reliabilities of the labelers and the classifier's weights; ``accepted``: kinds, votes and forms that it calls personal data."""

    reliabilities: dict[tuple[int, int, int, int], float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    accepted: list[str] = field(default_factory=list)


def _code(kind: int, votes: Sequence[int], form: int) -> str:
    return f"{kind}:" + ",".join(map(str, [*votes, form]))


def em(counts: Mapping[tuple[int, tuple[int, ...]], int], rounds: int = 50) -> tuple[dict, dict]:
    """Dawid-Skene over vote patterns: P(vote | truth) for each kind and labeler, and each pattern's posterior. Starts at the majority."""
    post = {p: 1 / (1 + math.exp(-2.0 * sum(p[1]))) for p in counts}
    table: dict[tuple[int, int, int, int], float] = {}
    for _ in range(rounds):
        table = {}
        prior = {}
        for k in {k for k, _ in counts}:
            own = {p: n for p, n in counts.items() if p[0] == k}
            yes = sum(n * post[p] for p, n in own.items())
            total = sum(own.values())
            prior[k] = (yes + 1) / (total + 2)
            for j in range(len(LABELERS)):
                for v in (-1, 0, 1):
                    hit = {True: sum(n * post[p] for p, n in own.items() if p[1][j] == v), False: sum(n * (1 - post[p]) for p, n in own.items() if p[1][j] == v)}
                    # a weak belief that labelers are better than chance keeps the classes from changing places
                    table[k, j, v, 1] = (hit[True] + (2.0 if v == 1 else 0.5)) / (yes + 3.0)
                    table[k, j, v, 0] = (hit[False] + (2.0 if v == -1 else 0.5)) / (total - yes + 3.0)
        new = {}
        for k, votes in counts:
            z = math.log(prior[k] / (1 - prior[k])) + sum(math.log(table[k, j, v, 1] / table[k, j, v, 0]) for j, v in enumerate(votes))
            new[k, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        moved = max((abs(new[p] - post[p]) for p in new), default=0.0)
        post = new
        if moved < 1e-6:
            break
    return post, table


def _features(kind: int, votes: Sequence[int], form: int) -> list[str]:
    return ["bias", f"k{kind}", *(f"{j}={v}" for j, v in enumerate(votes)), f"k{kind} length {form // 2}", f"opened {form % 2}"]


def classifier(counts: Mapping[tuple[int, tuple[int, ...], int], int], post: Mapping, rounds: int = 400) -> dict[str, float]:
    """Logistic regression on kind, votes and the span's form, fitted by gradient steps to the posteriors of the votes."""
    total = float(sum(counts.values())) or 1.0
    feats = {p: _features(*p) for p in counts}
    w: dict[str, float] = {}
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for p, n in counts.items():
            z = sum(w.get(f, 0.0) for f in feats[p])
            d = math.sqrt(n / total) * (post[p[:2]] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for f in feats[p]:
                grad[f] = grad.get(f, 0.0) + d
        for f, g in grad.items():
            w[f] = w.get(f, 0.0) + 0.3 * (g - 0.002 * w.get(f, 0.0))
    return w


def fit(candidates: DataFrame, col: str = "candidates") -> Model:
    """Learn from the candidates of a whole table (column ``col`` as made by :func:`labelled`). No candidate: an empty model.

    What comes to the driver are counts by kind, votes and form."""
    # explode_outer, as Spark infers a filter from explode, which would work out all spans of a lazy table once more
    rows = candidates.select(F.explode_outer(col).alias("c")).where("c is not null").groupBy("c.kind", "c.votes", "c.form").agg(F.count("*").alias("n")).collect()
    counts = {(r["kind"], tuple(r["votes"]), r["form"]): r["n"] for r in rows}
    if not counts:
        return Model()
    by_votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for (kind, votes, _), n in counts.items():
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    post, table = em(by_votes)
    weights = classifier(counts, post)
    return Model(table, weights, sorted(_code(*p) for p in counts if sum(weights.get(f, 0.0) for f in _features(*p)) >= 0.0))


def decided(candidates: DataFrame, model: Model, col: str = "candidates", out_col: str = "spans") -> DataFrame:
    """Adds ``out_col``: the candidates that are base spans or that the classifier accepts. A column of that name is replaced; null candidates: null."""
    return candidates.withColumn(out_col, _accepted(F.col(col), model))


def _accepted(candidates: Column, model: Model) -> Column:
    accepted = F.array(*[F.lit(c) for c in model.accepted]).cast("array<string>")
    code = lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.array_join(F.transform(F.array_append(s["votes"], s["form"]), lambda v: v.cast("string")), ","))
    return F.filter(candidates, lambda s: s["base"] | F.array_contains(accepted, code(s)))


def redacted(candidates: DataFrame, model: Model, text_col: str = "text", col: str = "candidates") -> DataFrame:
    """Rows with the candidates ``col`` of their text (see :func:`labelled`), less that column and with every accepted span replaced by its kind in
    brackets, overlapping spans by the first one's kind.

    Null texts stay null, texts without spans as they are; repeated rows are treated alike; an empty table gives no rows; other columns stay, whatever
    their names. The time grows with a text's length and number of spans.
    """
    step = _packed(candidates, col).withColumn("_spans", F.array_sort(F.transform(_accepted(F.col("_given_0"), model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    step = step.withColumn("_to", F.transform("_spans", lambda s: s["end"]))
    step = step.withColumn("_ends", running(F.col("_to"), F.greatest))
    # a span that starts before all spans so far have ended belongs to the one before; the rest are heads, with the end of what lies before them
    zipped = F.arrays_zip(F.col("_spans").alias("s"), F.slice(F.concat(F.array(F.lit(0)), F.col("_ends")), 1, F.size("_spans")).alias("upto"))
    step = step.withColumns({"_heads": F.filter(zipped, lambda z: z["s"]["start"] >= z["upto"]), "_cut": F.when(F.size("_spans") > 0, pieces(F.col("_row")[text_col]))})
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cut, text = F.col("_cut"), F.col("_row")[text_col]
    gaps = F.transform("_heads", lambda h: F.concat(between(cut, h["upto"], h["s"]["start"]), F.get(tags, h["s"]["kind"])))
    new = F.when(F.size(cut) > 0, F.concat(F.array_join(gaps, ""), between(cut, F.element_at("_ends", -1), F.length(text)))).otherwise(text)
    return step.select(*[new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in candidates.columns if c != col])


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans that are sorted by kind and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
