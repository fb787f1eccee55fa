"""Cleaning and extracting text, as column expressions."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"
#: Strings that stand for a missing value.
MISSING = ["", "n/a", "not available", "unknown", "unknown journal", "unknown title", "none"]
#: Phrases of an answer that declines.
REFUSALS = ["未检索到相关文献", "证据不足", "无法从给定", "无法根据给定", "cannot answer", "insufficient evidence"]


def blank_to_null(c: Column) -> Column:
    """Hard spaces count as spaces; trimmed; nothing left is NULL."""
    return F.nullif(F.trim(F.translate(c, NBSP, " ")), F.lit(""))


def collapse_space(c: Column) -> Column:
    """Runs of any Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_space(c: Column) -> Column:
    """Lower case without any white space, for containment tests."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def unicode_text(c: Column) -> Column:
    """Normal form KC, then character entities, by Arrow batches, as SQL has neither."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else html.unescape(x) for x in pc.utf8_normalize(pa.array(s, pa.string(), from_pandas=True), form="NFKC").to_pylist()])

    return run(c)


def catalog_text(c: Column, unicode: bool = True) -> Column:
    """NFKC, entities, tags, white space, then missing-value words to ''. ``unicode`` False leaves the first two out and stays in the JVM."""
    c = F.coalesce(c, F.lit(""))
    if unicode:
        c = unicode_text(c)
    c = collapse_space(strip_tags(c))
    return F.when(F.lower(c).isin(MISSING), "").otherwise(c)


def curated(c: Column) -> Column:
    """Trimmed text; blank, placeholder and n/a values are NULL."""
    t = F.trim(c)
    return F.when((t == "") | F.regexp_like(t, F.lit(r"(?i)placeholder|dummykey|^n/a$")), None).otherwise(t)


def title_key(c: Column, gap: str = " ") -> Column:
    """Lower case; what is neither a-z nor 0-9 becomes ``gap``; trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", gap))


def doi_of(c: Column) -> Column:
    """The bare DOI in a text, without prefixes, trailing punctuation, supplement and numeric article suffixes; '' if none."""
    d = F.trim(F.coalesce(c, F.lit("")))
    d = F.regexp_replace(d, r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    d = F.regexp_replace(d, r"(?i)^doi\s*:\s*", "")
    d = F.regexp_extract(d, r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0)
    d = F.regexp_replace(d, r"[.,;:)\]}]+$", "")
    d = F.regexp_replace(d, r"(?i)/-/DCSupplemental$", "")
    return F.regexp_replace(d, r"(?i)^(10\.1093/[^/]+/[^/]+)/\d+$", "$1")


def year_of(c: Column) -> Column:
    """First year from 1900 to 2099 as a number, else NULL."""
    return F.regexp_extract(c.cast("string"), r"(19|20)\d{2}", 0).try_cast("int")


def last_year_of(c: Column) -> Column:
    """Last such year that stands alone, as text, else NULL."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), F.lit(-1))


def volume_issue(c: Column) -> tuple[Column, Column]:
    """Volume and issue of '12(3)' or 'vol. 12 ... no. 3'; NULL if absent."""
    c = F.regexp_replace(c, r"\s+", " ")
    both = r"(?i)\b(?:vol(?:ume)?\.?\s*)?(\d{1,4})\s*\(\s*(\d{1,4})\s*\)"
    has = F.regexp_like(c, F.lit(both))
    volume = F.when(has, F.regexp_extract(c, both, 1)).otherwise(F.regexp_extract(c, r"(?i)\bvol(?:ume)?\.?\s*(\d{1,4})\b", 1))
    issue = F.when(has, F.regexp_extract(c, both, 2)).otherwise(F.regexp_extract(c, r"(?i)\b(?:issue|no\.)\s*(\d{1,4})\b", 1))
    return F.nullif(volume, F.lit("")), F.nullif(issue, F.lit(""))


def pages_of(c: Column) -> Column:
    """Page range such as '12-34' after 'pages' or 'pp.'; NULL if absent."""
    found = F.regexp_extract(F.regexp_replace(c, r"\s+", " "), r"(?i)\b(?:pages?|pp\.?)[ :]+([A-Za-z]?\d{1,6}\s*[-–]\s*[A-Za-z]?\d{1,6})\b", 1)
    return F.nullif(F.translate(found, "– ", "-"), F.lit(""))


def title_from_lines(c: Column) -> Column:
    """First of the first 15 lines with 20 to 300 characters and no publisher's words; joined with the next such line, if that begins
    with a capital and this does not end a sentence."""
    skip = F.lit("doi:|http|www|©|copyright|published|received")
    lines = F.transform(F.slice(F.split(c, "\n"), 1, 15), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: F.length(x).between(20, 300) & ~F.regexp_like(F.lower(x), skip))
    a, b = F.get(good, 0), F.get(good, 1)
    return F.when(~a.endswith(".") & F.regexp_like(b, F.lit(r"^\p{Lu}")), F.concat(a, F.lit(" "), b)).otherwise(a)


def authors_of(c: Column) -> Column:
    """Names split at the first separator present of ; , ' and ' &, longer than two characters, ten at most."""
    parts = F.when(c.contains(";"), F.split(c, ";")).when(c.contains(","), F.split(c, ",")).when(c.contains(" and "), F.split(c, " and ")).when(c.contains("&"), F.split(c, "&")).otherwise(F.array(c))
    return F.slice(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 2), 1, 10)


def citation_noise_removed(c: Column) -> Column:
    """Numbered references, link labels and list numbers go; white space collapses."""
    c = F.regexp_replace(c, r"\[\d+\]", "")
    c = F.regexp_replace(c, r"(?i)\[CrossRef\]|\[PubMed\]|\[Google Scholar\]", "")
    c = F.regexp_replace(c, r"(?m)^\d+\.\s+", "")
    return collapse_space(c)


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether lower-cased ``c`` contains one of the terms, as literal text."""
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: low.contains(t))


def count_contained(c: Column, terms: Sequence[str]) -> Column:
    """How many of the terms lower-cased ``c`` contains."""
    low = F.lower(c)
    return F.size(F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: low.contains(t)))


def is_refusal(c: Column) -> Column:
    return contains_any(F.coalesce(c, F.lit("")), REFUSALS)


def citation_ids(c: Column) -> Column:
    """Distinct reference ids of groups like [ref_1, ref_2], in order of appearance."""
    groups = F.regexp_extract_all(c, F.lit(r"\[((?:ref_\d+\s*,\s*)*ref_\d+)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))))


def citations_kept(c: Column, valid: Column) -> Column:
    """The answer without ids that ``valid`` (array) lacks: groups shrink, empty groups go, runs of spaces become one."""
    group = r"\[(?:ref_\d+\s*,\s*)*ref_\d+\]"
    gaps, found = F.split(c, group, -1), F.regexp_extract_all(c, F.lit(group), F.lit(0))

    def fixed(g: Column) -> Column:
        ids = F.filter(F.split(F.regexp_replace(g, r"[\[\]]", ""), r"\s*,\s*"), lambda x: F.array_contains(valid, x))
        return F.when(F.size(ids) > 0, F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]"))).otherwise("")

    parts = F.zip_with(gaps, found, lambda a, b: F.concat(a, F.coalesce(fixed(b), F.lit(""))))
    return F.regexp_replace(F.array_join(parts, ""), " {2,}", " ")


def first_present(*columns: Column) -> Column:
    """First of the columns that is neither NULL nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def mapped(c: Column, table: Mapping[str, object]) -> Column:
    """``table[c]``, NULL for other values."""
    keys = list(table.items())
    out = F.when(c == keys[0][0], F.lit(keys[0][1]))
    for k, v in keys[1:]:
        out = out.when(c == k, F.lit(v))
    return out


#: Parameters that a request may state, and how.
PARAMETERS = {
    "simulation_time_ns": r"\b(\d+(?:\.\d+)?)\s*(?:ns|nanoseconds?)\b",
    "temperature_k": r"\b(\d+(?:\.\d+)?)\s*(?:k|kelvin)\b",
    "pressure_bar": r"\b(\d+(?:\.\d+)?)\s*bar\b",
    "salt_molar": r"\b(\d+(?:\.\d+)?)\s*(?:m|molar)\s*(?:nacl|salt)?\b",
    "solvent_padding_a": r"(?:padding|buffer|solvent\s+shell)\D{0,16}(\d+(?:\.\d+)?)\s*(?:a|angstroms?|å)",
    "cutoff_a": r"(?:cutoff|nonbonded\s+cutoff)\D{0,12}(\d+(?:\.\d+)?)\s*(?:a|angstroms?|å)",
    "timestep_fs": r"(?:time\s*step|timestep|dt)\D{0,12}(\d+(?:\.\d+)?)\s*fs\b",
    "heating_ps": r"(?:heat(?:ing)?)\D{0,16}(\d+(?:\.\d+)?)\s*ps\b",
    "equilibration_ps": r"(?:equilibrat(?:e|ion|ing))\D{0,16}(\d+(?:\.\d+)?)\s*ps\b",
    "trajectory_interval_ps": r"(?:trajectory|output|write|save|ntwx)\D{0,20}(\d+(?:\.\d+)?)\s*ps\b",
}


#: Whole numbers that a request may state about a ligand.
COUNTS = {
    "ligand_net_charge": r"\b(?:net\s+)?charge\s*(?:of|=|is|:)?\s*([+-]?\d+)\b",
    "ligand_multiplicity": r"\bmultiplicity\s*(?:of|=|is|:)?\s*(\d+)\b",
}
#: Choices that a request may state, by patterns of its lower-cased text; the first that is found counts.
CHOICES = {
    "charge_method": [("am1-?bcc", "am1bcc"), ("resp", "resp"), ("existing charge|keep charge", "existing")],
    "protein_force_field": [("ff19sb", "ff19SB"), ("ff14sb", "ff14SB")],
    "water_model": [(r"\bopc(?:box)?\b", "OPCBOX"), (r"\btip3p(?:box)?\b", "TIP3PBOX")],
    "preset": [(r"\bstandard\s+preset\b", "standard"), (r"\bcompatibility\s+preset\b", "compatibility")],
}


def parameters_of(c: Column) -> dict[str, Column]:
    """What a free-text request states, by name: numbers, whole numbers and choices; NULL if it does not."""
    low = F.lower(c)

    def choice(options: Sequence[tuple[str, str]]) -> Column:
        return F.coalesce(*[F.when(F.regexp_like(low, F.lit(p)), F.lit(v)) for p, v in options])

    return (
        {k: F.regexp_extract(c, f"(?i){p}", 1).try_cast("double") for k, p in PARAMETERS.items()}
        | {k: F.regexp_extract(c, f"(?i){p}", 1).try_cast("int") for k, p in COUNTS.items()}
        | {k: choice(options) for k, options in CHOICES.items()}
    )


#: Words of a request for help with a failed run, and of one to set a run up.
TROUBLE = r"(?i)\b(?:error|failed?|failure|crash(?:ed)?|nan|blow(?:n|ing)?\s+up|unstable|drift(?:ed|ing)?|escaped?|left\s+the\s+(?:site|box)|unbound|dissociat(?:ed|ion))\b|跑出|跑飞|失败|报错|崩溃|爆炸|不稳定|解离|漂移"
ASKING = r"(?i)\b(?:what|why|how|when|which|difference)\b|什么|为什么|如何|怎么|区别"
SETUP = r"(?i)\b(?:set\s*up|configure|prepare|build|generate|simulate|run)\b|设置|配置|生成|准备.*模拟|运行.*模拟"


def intent_of(c: Column) -> Column:
    """troubleshooting, setup (an action, or stated numbers outside of a question) or general."""
    stated = F.coalesce(*[x.cast("string") for x in parameters_of(c).values()]).isNotNull()
    return (
        F.when(F.regexp_like(c, F.lit(TROUBLE)), "troubleshooting")
        .when(F.regexp_like(c, F.lit(SETUP)) | (stated & ~F.regexp_like(c, F.lit(ASKING))), "setup")
        .otherwise("general")
    )


#: How molecule strings begin, go on and end, and descriptor names and acronyms that look like them.
SMILES = r"\b[A-Z][A-Za-z0-9@+\-\[\]()=#$:/\\.]{2,}\b"
SMILES_STOP = ["TPSA", "BCUT2D", "VSA", "PEOE", "ECFP", "MACCS", "RDKit", "SHAP", "AUC", "ROC", "API", "RAG", "LLM", "PDF", "CSV"]


def smiles_candidates(c: Column) -> Column:
    """Strings in running text that could be molecules, in order, repeats kept: a capital and at least two more of a molecule string's characters, from
    word edge to word edge, but no descriptor name or acronym."""
    return F.filter(F.regexp_extract_all(c, F.lit(SMILES), F.lit(0)), lambda x: ~x.isin(SMILES_STOP))


def chunks(c: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that share ``overlap`` words with the one before; the last may be shorter."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    step = size - overlap
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - overlap - 1) / step).cast("int"), F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(size)), " "))


def sentence_chunks(c: Column, size: int = 512, overlap: int = 50) -> Column:
    """Chunks of whole sentences, at most ``size`` words each, as far as sentences of paragraphs (parted by blank lines) fit; each chunk but the first repeats
    the last sentences of the one before that have at most ``overlap`` words together. A sentence ends at , . ; 。 ？ ！ or with its paragraph; one of more than
    ``size`` words is cut into pieces of ``size``. White space becomes single spaces.
    """
    none = F.array().cast("array<string>")
    sentences = F.flatten(F.transform(F.split(c, r"\n\n"), lambda p: F.regexp_extract_all(p, F.lit(r"[^,.;。？！]+[,.;。？！]?|[,.;。？！]"), F.lit(0))))
    words = F.filter(F.transform(sentences, lambda s: F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")), lambda w: F.size(w) > 0)
    cut = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda k: F.slice(w, k * size + 1, F.lit(size)))))
    start = F.struct(none.alias("done"), F.array().cast("array<array<string>>").alias("open"), F.lit(0).alias("n"))
    count = lambda parts: F.aggregate(parts, F.lit(0), lambda n, w: n + F.size(w))
    joined = lambda parts: F.array_join(F.flatten(parts), " ")

    def kept(parts: Column, room: Column) -> Column:
        """The last sentences that repeat: no more words than the overlap, nor than leave room for the next sentence."""
        starts = F.sequence(F.lit(1), F.size(parts) + 1)
        first = F.get(F.filter(starts, lambda k: count(F.slice(parts, k, F.size(parts))) <= F.least(F.lit(overlap), room)), F.lit(0))
        return F.slice(parts, first, F.size(parts))

    def add(st: Column, w: Column) -> Column:
        fits = st["n"] + F.size(w) <= size
        again = kept(st["open"], F.lit(size) - F.size(w))
        open_ = F.when(fits, F.array_append(st["open"], w)).otherwise(F.array_append(again, w))
        return F.struct(
            F.when(fits, st["done"]).otherwise(F.array_append(st["done"], joined(st["open"]))).alias("done"), open_.alias("open"),
            F.when(fits, st["n"] + F.size(w)).otherwise(count(again) + F.size(w)).alias("n"),
        )

    return F.aggregate(cut, start, add, lambda st: F.when(F.size(st["open"]) > 0, F.array_append(st["done"], joined(st["open"]))).otherwise(st["done"]))


# Journals by a name or short name in running text; the longest that occurs counts.
JOURNALS = {
    "nature": "Nature", "science": "Science", "cell": "Cell", "lancet": "The Lancet", "jama": "JAMA", "nejm": "New England Journal of Medicine",
    "food chemistry": "Food Chemistry", "food research international": "Food Research International", "journal of agricultural and food chemistry": "Journal of Agricultural and Food Chemistry",
    "food hydrocolloids": "Food Hydrocolloids", "food quality and preference": "Food Quality and Preference", "lwt": "LWT - Food Science and Technology",
    "trends in food science": "Trends in Food Science & Technology", "comprehensive reviews in food science": "Comprehensive Reviews in Food Science and Food Safety",
    "journal of food science": "Journal of Food Science", "food science and nutrition": "Food Science & Nutrition", "nutrients": "Nutrients", "nutrition": "Nutrition",
    "american journal of clinical nutrition": "American Journal of Clinical Nutrition", "journal of nutrition": "Journal of Nutrition", "british journal of nutrition": "British Journal of Nutrition",
    "frontiers in nutrition": "Frontiers in Nutrition", "chemical senses": "Chemical Senses", "physiology & behavior": "Physiology & Behavior", "appetite": "Appetite",
    "plos one": "PLOS ONE", "plos": "PLOS ONE", "scientific reports": "Scientific Reports", "bmc": "BMC", "frontiers": "Frontiers",
    "ijms": "International Journal of Molecular Sciences", "molecules": "Molecules", "life": "Life", "foods": "Foods", "diabetes care": "Diabetes Care",
    "nihms": "NIH Manuscript", "proceedings": "Proceedings",
}


def journal_of(c: Column, journals: Mapping[str, str] = JOURNALS) -> Column:
    """Name of the longest pattern that the lower-cased text contains (of equals the first listed), else NULL."""
    low = F.lower(c)
    order = sorted(journals, key=lambda p: -len(p))
    entries = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(journals[p]).alias("name")) for p in order])
    return F.get(F.filter(entries, lambda e: low.contains(e["p"])), F.lit(0))["name"]


def journal_of_name(c: Column, journals: Mapping[str, str] = JOURNALS) -> Column:
    """Name of the first listed pattern that a file name without its ending contains, else 'Unknown Journal'."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(c, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", ""))
    entries = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("name")) for p, n in journals.items()])
    return F.coalesce(F.get(F.filter(entries, lambda e: stem.contains(e["p"])), F.lit(0))["name"], F.lit("Unknown Journal"))


# Journals by the beginning of a DOI, by the letters after one publisher's prefix, and by a code inside another publisher's.
DOI_JOURNALS = {
    "10.1038/srep": "Scientific Reports", "10.1038/s41538": "npj Science of Food", "10.1038/s41467": "Nature Communications", "10.1038/s41586": "Nature",
    "10.1038/s41598": "Scientific Reports", "10.1038/ijo": "International Journal of Obesity", "10.1017/s0029665": "Proceedings of the Nutrition Society",
    "10.1016/j.foodhyd": "Food Hydrocolloids", "10.1016/j.foodchem": "Food Chemistry", "10.1016/j.foodres": "Food Research International",
    "10.1016/j.lwt": "LWT - Food Science and Technology", "10.1016/j.ijbiomac": "International Journal of Biological Macromolecules",
    "10.1016/j.carbpol": "Carbohydrate Polymers", "10.1016/j.jcis": "Journal of Colloid and Interface Science",
    "10.1016/j.colsurfb": "Colloids and Surfaces B: Biointerfaces", "10.1016/j.foodcont": "Food Control",
    "10.1016/j.tifs": "Trends in Food Science & Technology", "10.1016/j.fbio": "Food Bioscience", "10.1016/j.ultsonch": "Ultrasonics Sonochemistry",
}
LETTER_JOURNALS = {"nutrients": "Nutrients", "foods": "Foods", "molecules": "Molecules", "ijms": "International Journal of Molecular Sciences", "sensors": "Sensors", "life": "Life"}
CODE_JOURNALS = {
    "s00217": "European Food Research and Technology", "s10068": "Food Science and Biotechnology", "s11694": "Journal of Food Measurement and Characterization",
    "s11248": "Transgenic Research", "s002170": "European Food Research and Technology",
}


def journal_of_doi(c: Column) -> Column:
    """The journal that a DOI names by its beginning or code; NULL where it names a publisher at most."""
    low = F.lower(c)
    begins = F.coalesce(*[F.when(low.startswith(p), F.lit(n)) for p, n in DOI_JOURNALS.items()])
    letters = F.regexp_replace(F.split_part(c, F.lit("/"), F.lit(2)), r"[^\p{L}]", "")
    own = F.coalesce(mapped(F.lower(letters), LETTER_JOURNALS), F.concat(F.lit("MDPI - "), F.upper(F.left(letters, F.lit(1))), F.lower(F.substr(letters, F.lit(2)))))
    coded = F.coalesce(*[F.when(low.contains(k), F.lit(n)) for k, n in CODE_JOURNALS.items()])
    return F.when(begins.isNotNull(), begins).when(low.startswith("10.3390"), F.when(letters != "", own)).when(low.startswith("10.1007"), coded)


def authors_in(c: Column) -> Column:
    """Up to five names like 'Smith J. A.' or 'Smith, J.' of the first 20 lines of running text. A line with both forms gives its names twice."""
    forms = (r"[A-Z][a-z]+\s+[A-Z]\.", r"[A-Z][a-z]+,\s+[A-Z]\.")
    lines = F.transform(F.slice(F.split(c, "\n"), 1, 20), lambda x: F.trim(x))

    def names(line: Column) -> Column:
        found, none = F.regexp_extract_all(line, F.lit(r"[A-Z][a-z]+(?:,?\s+[A-Z]\.)+"), F.lit(0)), F.array().cast("array<string>")
        return F.concat(*[F.when(F.regexp_like(line, F.lit(f)), found).otherwise(none) for f in forms])

    return F.slice(F.flatten(F.transform(lines, names)), 1, 5)


#: Words that show that a request speaks of a parameter, whether or not it gives a number.
MENTIONS = {
    "project_name": r"\bproject\s+name\b",
    "simulation_time_ns": r"\b(?:ns|nanoseconds?|production\s+(?:time|length)|duration)\b",
    "temperature_k": r"\b(?:temperature|temp|kelvin)\b|\d\s*k\b",
    "pressure_bar": r"\b(?:pressure|bar|atm)\b",
    "preset": r"\b(?:standard|compatibility)\s+preset\b",
    "protein_force_field": r"\b(?:ff19sb|ff14sb|force\s*field)\b",
    "water_model": r"\b(?:opc(?:box)?|tip3p(?:box)?|water\s+model)\b",
    "solvent_padding_a": r"\b(?:padding|buffer|solvent\s+shell)\b",
    "cutoff_a": r"\b(?:cutoff|nonbonded\s+cutoff)\b",
    "salt_molar": r"\b(?:salt|nacl|molar)\b|\d\s*m\b",
    "timestep_fs": r"\b(?:time\s*step|timestep|dt|fs)\b",
    "heating_ps": r"\bheat(?:ing)?\b",
    "equilibration_ps": r"\bequilibrat(?:e|ion|ing)\b",
    "trajectory_interval_ps": r"\b(?:trajectory|output|write|save|ntwx)\b",
    "charge_method": r"\b(?:am1-?bcc|resp|existing\s+charges?|keep\s+charges?)\b",
    "ligand_net_charge": r"\b(?:ligand\s+)?(?:net\s+)?charge\b",
    "ligand_multiplicity": r"\b(?:multiplicity|spin\s+state)\b",
}


def mentioned(c: Column) -> Column:
    """Names of the parameters that a request speaks of, in the order of the table."""
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(F.regexp_like(low, F.lit(p)), F.lit(k)) for k, p in MENTIONS.items()]))


def citations_numbered(c: Column) -> Column:
    """Groups like [ref_7, ref_3] as [[1]](#ref_7) [[2]](#ref_3), numbered by first appearance in the text."""
    order, group = citation_ids(c), r"\[(?:ref_\d+\s*,\s*)*ref_\d+\]"
    gaps, found = F.split(c, group, -1), F.regexp_extract_all(c, F.lit(group), F.lit(0))

    def linked(g: Column) -> Column:
        ids = F.split(F.regexp_replace(g, r"[\[\]]", ""), r"\s*,\s*")
        return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("[["), F.array_position(order, i).cast("string"), F.lit("]](#"), i, F.lit(")"))), " ")

    return F.array_join(F.zip_with(gaps, found, lambda a, b: F.concat(a, F.coalesce(linked(b), F.lit("")))), "")
