"""Re-parameterised questions: other names, numbers and units in every place, sentences that begin with a name among them."""

import random

from pyspark.sql import functions as F

from quern.llm import decontaminate

NAMES = "Natalia Robert Ken Tim Ann Bob Zed Moe Lucía McDonald O'Brien USA Otto Ivy Ravi Noor Xan Pia Sven Uma".split()
VERBS = "sold bought kept lost found gave took moved carried painted washed packed counted stored shipped baked planted fixed drew cut".split()
THINGS = "clips apples books marbles stamps boxes tiles ropes cards shells lamps seeds coins bricks shirts plates bolts jars pens kites".split()
PLACES = "at the old market, near the river bank, in the corner shop, for the school fair, behind the red barn, on the long train ride, before the big storm, with some good friends, after the long meeting, during the quiet morning".split(", ")
UNITS = "kg g km m litres hours days minutes".split()
FILL = "plain words that no question has stand here and there so that a text is longer than what it holds".split()


def question(rng):
    """Sentences that mostly begin with a name, as pieces of which some are parameters."""
    out = []
    for _ in range(rng.randint(3, 5)):
        thing, verb, place = rng.choice(THINGS), rng.choice(VERBS), rng.choice(PLACES)
        kind = rng.randrange(4)
        if kind == 0:
            out += [("name", rng.randrange(3)), verb, ("num", rng.randrange(4)), thing, *place.split(), "."]
        elif kind == 1:
            out += [("name", rng.randrange(3)), verb, ("num", rng.randrange(4)), ("unit", rng.randrange(2)), "of", thing, *place.split(), "."]
        elif kind == 2:
            out += ["Then", ("name", rng.randrange(3)), verb, "some", thing, "and", ("name", rng.randrange(3)), rng.choice(VERBS), ("num", rng.randrange(4)), rng.choice(THINGS), *place.split(), "."]
        else:
            out += [("name", rng.randrange(3)), "and", ("name", rng.randrange(3)), verb, "all", "of", "the", thing, *place.split(), "."]
    return [*out, "How", "many", rng.choice(THINGS), "were", rng.choice(VERBS), "by", ("name", rng.randrange(3)), *rng.choice(PLACES).split(), "?"]


def said(pieces, rng, used=()):
    """The question with values drawn for its parameters, none of those in ``used`` for names and numbers."""
    values = {"name": [n for n in NAMES if n not in used], "num": [str(n) for n in range(2, 99) if str(n) not in used], "unit": UNITS}
    drawn = {k: rng.sample(v, min(4, len(v))) for k, v in values.items()}
    text = " ".join(p if isinstance(p, str) else drawn[p[0]][p[1]] for p in pieces)
    return text.replace(" .", ".").replace(" ?", "?"), {x for v in drawn.values() for x in v}


def canonical(text):
    words = [w.strip(".?") for w in text.split()]
    return ["<name>" if w in NAMES else "<num>" if w.isdigit() else "<unit>" if w in UNITS else w.lower() for w in words]


def common(a, b):
    """The longest run of tokens that both have."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def held(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    keyed = docs.select("doc_id", decontaminate.text_key(F.col("text")).alias("text_key"))
    return {(r["doc_id"], r["item_id"]): r for r in keyed.join(found, "text_key").collect()}


def test_questions_with_other_parameters_are_found(spark):
    rng = random.Random(12)
    asked = [question(rng) for _ in range(150)]
    items, texts = [], []
    for q in asked:
        item, used = said(q, rng)
        copy, _ = said(q, rng, used)
        items.append(item)
        texts.append(f"{' '.join(rng.choices(FILL, k=20))}. {copy} {' '.join(rng.choices(FILL, k=20))}")
    unlike = [said(question(rng), rng)[0] for _ in range(150)]
    found = held(spark, texts + unlike, items)
    recall = sum((i, i) in found for i in range(150)) / 150
    wrong = [(d, i) for d, i in found if d != i]
    print(f"recall {recall:.3f}, wrong {len(wrong)} of {300 * 150 - 150}")
    assert recall >= 0.95 and len(wrong) < 0.001 * 300 * 150
    # those that are found beside their own share whole windows of template tokens by chance
    assert all(common(canonical((texts + unlike)[d]), canonical(items[i])) >= decontaminate.WINDOW for d, i in wrong)
    assert all(found[i, i]["altered"] > 0 for i in range(150) if (i, i) in found)


def test_names_where_sentences_begin(spark):
    items = [
        "Natalia sold clips to 48 of her friends in April. Ken kept half as many of the clips for himself in May.",
        "Ann bought 3 kg of rice. Bob bought 5 kg.",
        "We drove from McDonald to the lake near USA in 3 hours and came back to McDonald at night.",
        "They went from Paris to Rome by train, then from Rome to Oslo, and back to Paris in 9 days.",
    ]
    texts = [
        "Robert sold clips to 57 of her friends in June. Tim kept half as many of the clips for himself in July.",
        "Zed bought 8 kg of rice. Moe bought 2 kg.",
        "We drove from O'Brien to the lake near NATO in 7 hours and came back to O'Brien at night.",
        "They went from Berlin to Wien by train, then from Berlin to Kiel, and back to Wien in 4 days.",  # two places made one
    ]
    assert {k for k in held(spark, texts, items)} == {(0, 0), (1, 1), (2, 2)}


def test_a_first_word_that_changes_spoils_no_closed_template(spark):
    item = "She packed 12 red boxes for the fair in Rome. She gave 7 of them to the man from Oslo at noon."
    text = "She packed 15 red boxes for the fair in Bern. Ann gave 9 of them to the man from Kyiv at noon."
    assert set(held(spark, [text], [item])) == {(0, 0)}
