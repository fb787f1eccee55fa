"""Benchmark decontamination: windows of canonical templates and of plain words, joined by hash; slots must correspond one to one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.words import parts, tokens, windows

#: Tokens of a window (shorter items are one window of their own length), and how many of them must be literal where others are slots.
WINDOW, LITERALS = 8, 4
#: A document holds an item if it covers this share of its tokens, or so many tokens in one run.
SHARE, RUN = 0.5, 13
#: The filter of window hashes has about FILTER bits for each window of the benchmark, within these bounds (logarithms); it never decides, the join does.
FILTER, LEAST_BITS, MOST_BITS = 512, 16, 27
#: Words that a worker remembers; the memory starts anew when it is full.
MAX_WORDS = 150_000

# Units of measure and number words that become placeholders.
UNITS = """kg g mg lb lbs oz t ton tons km m cm mm mi mile miles ft foot feet inch inches yard yards l ml litre litres liter liters
gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years km/h mph
percent % c f k usd eur gbp dollar dollars euro euros pound pounds cent cents degree degrees watt watts kw kwh v volt volts
hz khz mhz ghz kb mb gb tb bit bits byte bytes""".split()
NUMBERS = """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()

NUM, UNIT, CAPITAL, ENDS, NOTHING = 1, 2, 4, 8, 16
_units, _numbers = frozenset(UNITS), frozenset(NUMBERS)
_number = re.compile(r"[+-]?\d[\d.,:/]*")
_glued = re.compile(r"(\d)([^\W\d_]{1,8}|%)(?=\W|$)")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%") + "«»“”„‘’…–—¿¡€£"
_CLOSING, _SIGNS = "\"')]»”’", tuple(".,;:!?")
SLOT_CODES = {"num": np.uint64(0x11), "unit": np.uint64(0x22), "name": np.uint64(0x33)}
#: Kinds of windows: plain words, templates, templates whose sentences' first words are slots if they may be names.
PLAIN, CLOSED, OPEN = 0, 1, 2
#: What sets the hashes of plain windows apart from those of templates.
_PLAIN = np.uint64(0x5851F42D4C957F2D)

_known: dict[bytes, tuple[tuple[int, int], ...]] = {}


def _piece(word: str) -> tuple[int, int]:
    """Hash of the lower-cased word without punctuation round it, and its flags."""
    core = word.strip(_EDGE)
    low = core.lower()
    open_ = word.rstrip(_CLOSING)
    ends = ENDS if open_[-1:] in (".", "!", "?", ":", "…") and open_ else 0
    if word == "\x01":
        return 0, NOTHING | ENDS
    if not core:
        return 0, NOTHING | (ENDS if word[-1] in ".!?:" else 0)
    flags = ends
    if _number.fullmatch(core) or low in _numbers:
        flags |= NUM
    elif low in _units:
        flags |= UNIT
    elif core[0].isupper() and (core[1:2].isalpha() or core[2:3].isupper()):  # Ann, McDonald, USA, O'Brien, but not I'm
        flags |= CAPITAL
    return xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")), flags


def _pieces(raw: bytes) -> tuple[tuple[int, int], ...]:
    """A word as tokens: a number and the unit that is written on to it are two."""
    found = _known.get(raw)
    if found is None:
        word = raw.decode("utf-8", "replace")
        core = word if word.isalpha() else word[:-1] if word[-1:] in _SIGNS and word[:-1].isalpha() else ""
        if core:  # letters and perhaps one sign, as most words are: what _piece finds, sooner
            low = core.lower()
            flags = ENDS if word[-1] in ".!?:" else 0
            flags |= NUM if low in _numbers else UNIT if low in _units else CAPITAL if core[0].isupper() and len(core) > 1 else 0
            found = ((xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")), flags),)
        else:
            found = tuple(_piece(w) for w in _glued.sub(r"\1 \2", word).split(" ")) if word else ()
        if len(_known) >= MAX_WORDS:
            _known.clear()
        _known[raw] = found
    return found


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of all texts of an Arrow array: their row, canonical code, literal hash, and whether they are a slot.

    Numbers, units after a number, and words that begin with a capital but do not begin a sentence are slots: their code is their type's.
    """
    return readings(texts)[:4]


def readings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`templates`, and whether a token is a word with a capital that begins a sentence: a name or any other word, so it is read as either."""
    row, at, vocabulary = tokens(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \x01 "))
    learned = [_pieces(w) for w in vocabulary]
    flat = [x for pieces in learned for x in pieces]
    hash_, flags = np.array([h for h, _ in flat], np.uint64), np.array([f for _, f in flat], np.uint8)
    count = np.array([len(p) for p in learned], np.int64)
    first = np.cumsum(count) - count
    n = count[at]
    if (n > 1).any():
        ends = np.cumsum(n)
        place = np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1])
        row = np.repeat(row, n)
    else:
        place = first[at]
    h, f = hash_[place], flags[place]
    begins = np.ones(len(f), bool)
    begins[1:] = ((f[:-1] & ENDS) > 0) | (row[1:] != row[:-1])
    keep = (f & NOTHING) == 0
    row, h, f, begins = row[keep], h[keep], f[keep], begins[keep]
    num = (f & NUM) > 0
    unit = (f & UNIT) > 0
    unit[1:] &= num[:-1] & (row[1:] == row[:-1])
    unit[:1] = False
    capital = (f & CAPITAL) > 0
    name, either = capital & ~begins, capital & begins & ~unit
    codes = np.where(num, SLOT_CODES["num"], np.where(unit, SLOT_CODES["unit"], np.where(name, SLOT_CODES["name"], h)))
    return row, codes, h, num | unit | name, either


def _windows(row: np.ndarray, codes: np.ndarray, literals: np.ndarray, slots: np.ndarray, either: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, places and codes of the windows of ``n`` tokens within one text: of plain words, then of templates with a slot and enough literal tokens, then
    of those templates that differ where a capital at a sentence's start is read as a name."""
    if len(codes) < n:
        return
    whole = row[n - 1 :] == row[: len(row) - n + 1]
    at = np.flatnonzero(whole)
    yield PLAIN, at, (windows(literals, n) + np.uint64(n) ^ _PLAIN)[at]
    if n < LITERALS:
        return
    summed = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int32)]))[n:] - c[:-n]
    held, open_ = summed(slots), summed(either)
    at = np.flatnonzero(whole & (held > 0) & (held <= n - LITERALS))
    yield CLOSED, at, (windows(codes, n) + np.uint64(n))[at]
    at = np.flatnonzero(whole & (open_ > 0) & (held + open_ <= n - LITERALS))
    if len(at):
        yield OPEN, at, (windows(np.where(either, SLOT_CODES["name"], codes), n) + np.uint64(n))[at]


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id, version, length, n, at, kind, code, literals, slots`` of every window of ``benchmark(item_id, text)``; version: a hash of the item's text."""
    names = ["item_id", "version", "length", "n", "at", "kind", "code", "literals", "slots"]
    schema = "item_id bigint, version bigint, length int, n int, at int, kind int, code bigint, literals array<bigint>, slots array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {k: [] for k in names}
            for item, version, text in zip(b.column("item_id").to_pylist(), b.column("version").to_pylist(), b.column("text")):
                row, codes, lits, slots, either = readings(pa.array([text.as_py()], pa.string()))
                n = min(window, len(codes))
                for kind, at, code in _windows(row, codes, lits, slots, either, n) if n else ():
                    open_ = slots | either if kind == OPEN else slots
                    for i, c in zip(at.tolist(), code.view(np.int64).tolist()):
                        found = ([], []) if kind == PLAIN else (lits.view(np.int64)[i : i + n].tolist(), open_[i : i + n].tolist())
                        for k, v in zip(names, (item, version, len(codes), n, i, kind, c, *found)):
                            rows[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], kind) for k, kind in zip(names, kinds)], names=names)

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.xxhash64("text").alias("version"), "text").distinct()
    return rows.transform(scratch.bounded).mapInArrow(run, schema)


def _filter(items: DataFrame) -> tuple[int, np.ndarray]:
    """A bit table of the leading bits of all window hashes of the benchmark, put together in Spark: at most 2^MOST_BITS bits come to the driver."""
    n = items.select("code").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, (FILTER * n).bit_length()))
    lead = items.select(F.shiftrightunsigned("code", 64 - bits).alias("lead"))
    bytes_ = lead.groupBy(F.shiftright("lead", 3).alias("k")).agg(F.bit_or(F.expr("shiftleft(1, int(lead % 8))")).alias("v"))
    found = bytes_.toArrow()
    table = np.zeros(1 << (bits - 3), np.uint8)
    table[found.column("k").to_numpy()] = found.column("v").to_numpy().astype(np.uint8)
    return bits, table


def text_key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """Texts of ``docs(text)`` that hold an item of ``benchmark(item_id, text)``, word for word or with other numbers, names or units.

    Returns ``text_key`` (see :func:`text_key`), ``item_id``, ``covered`` and ``share`` of the item's tokens, ``altered`` (slots whose value
    differs), one row for each distinct text and item that reaches ``share`` of the item's tokens or ``run`` tokens at one alignment.

    A window of plain words counts wherever the words are equal, whatever their number: an item shorter than ``window`` is one window, so a
    one-word item is held by every text with that word (leave such items out of ``benchmark`` if that is not meant). A window of a template has LITERALS
    literal tokens at least and counts where, over all windows of the same alignment, equal slots of the item stand for equal ones of the text and
    different for different. A word with a capital is a name within a sentence; where it begins one, item and text are read in both ways, as a name and as
    the word it is, so a name there may change too. Case and punctuation don't matter. Null, empty and wordless texts and items hold nothing and are held by nothing; a repeated
    item id counts with each of its texts, repeated rows once. Empty tables give no rows. Other columns are ignored.

    Executors read whole texts once, however long, in narrow tasks, and emit only windows whose hash lies in a bit table of bounded size; those meet
    the item windows in an equi-join, and further grouping is by text, item and token with map-side sums, so repeats inside a long text never meet in
    one list. Nothing that grows with the documents is broadcast.
    """
    items = scratch.written(item_windows(benchmark, window), "bench")
    sizes = [r["n"] for r in items.select("n").distinct().collect()]
    bits, table = _filter(items)
    names = ["text_key", "pos", "plain", "code", "found"]

    def passes(code: np.ndarray) -> np.ndarray:
        lead = (code >> np.uint64(64 - bits)).astype(np.int64)
        return (table[lead >> 3] >> (lead & 7).astype(np.uint8)) & 1 > 0

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, (first_row, texts) in ((b.column("text_key"), p) for b in batches for p in parts(b.column("text"))):
            row, codes, lits, slots, either = readings(texts)
            for n in sizes:
                for kind, at, code in _windows(row, codes, lits, slots, either, n):
                    plain, hit = kind == PLAIN, passes(code)
                    at, code = at[hit], code[hit]
                    if plain and n < window and len(at):  # such a window is a whole item: the first place is enough
                        _, first = np.unique(np.stack([row[at].astype(np.uint64), code]), axis=1, return_index=True)
                        at, code = at[first], code[first]
                    if not len(at):
                        continue
                    start = np.searchsorted(row, row[at])
                    found = np.empty(0, np.int64) if plain else lits.view(np.int64)[at[:, None] + np.arange(n)].ravel()
                    cols = [keys.take(pa.array(first_row + row[at])), pa.array((at - start).astype(np.int32)), pa.array(np.full(len(at), plain)), pa.array(code.view(np.int64)), _lists(found, np.full(len(at), 0 if plain else n), pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    texts = docs.where("text is not null").select(text_key(F.col("text")).alias("text_key"), "text")
    hits = texts.transform(scratch.bounded).mapInArrow(emit, "text_key binary, pos int, plain boolean, code bigint, found array<bigint>").join(items.withColumn("plain", F.col("kind") == PLAIN), ["code", "plain"])
    # an alignment is looked at by its closed templates alone, and by all of them
    kinds = F.when(F.col("kind") == CLOSED, F.array(F.lit(CLOSED), F.lit(OPEN))).otherwise(F.array("kind"))
    hits = hits.withColumn("reading", F.explode(kinds))
    slots = F.filter(F.arrays_zip("slots", "literals", "found"), lambda s: s["slots"])
    pairs = F.transform(slots, lambda s: F.struct(s["literals"].alias("a"), s["found"].alias("b")))
    one = ["text_key", "item_id", "version", "length"]
    lined = hits.groupBy(*one, "n", (F.col("pos") - F.col("at")).alias("shift"), "reading").agg(F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"))
    only = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: s[side]))) == F.size("slots")
    lined = lined.where(only("a") & only("b")).withColumn("altered", F.size(F.filter("slots", lambda s: s["a"] != s["b"])))
    # one alignment has a row of plain windows and two of templates at most, each with no more places than the item has tokens
    lined = lined.groupBy(*one, "n", "shift").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.max("altered").alias("altered"))
    covers = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("n") - 1))))
    lined = lined.withColumn("tokens", covers).withColumn("run", F.size("tokens"))
    tokens_ = lined.select(*one, "run", "altered", F.explode("tokens").alias("token")).groupBy(*one, "token").agg(F.max(F.struct("run", (-F.col("altered")).alias("kept"))).alias("best"))
    held = tokens_.groupBy(*one).agg(F.count("*").cast("int").alias("covered"), F.max("best").alias("best"))
    part = F.col("covered") / F.col("length")
    held = held.where((part >= share) | (F.col("best.run") >= run)).groupBy("text_key", "item_id").agg(F.max(F.struct(part.alias("share"), "covered", (-F.col("best.kept")).alias("altered"))).alias("b"))
    return held.select("text_key", "item_id", "b.covered", "b.share", "b.altered")


def clean(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """``docs`` less the rows whose text holds a benchmark item (see :func:`leaks`); null texts stay, all columns stay as they are."""
    held = scratch.written(leaks(docs, benchmark, **kwargs).select(F.col("text_key").alias("_held")).distinct(), "leaks")
    return docs.join(held, text_key(docs["text"]) == held["_held"], "left_anti")  # both sides are named, so a column _held of docs does no harm
