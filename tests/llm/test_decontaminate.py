"""Containment search against plain sets."""

import random

from ledgerlark.llm.decontaminate import contaminated_pairs, decontaminate

DOCS = "doc_id long, text string, h string"
ITEMS = "item_id long, text string"


def grams(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_against_sets_with_long_documents_and_edits(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(say(rng.randint(3, 60)))) for i in range(40)]
    docs = []
    for d in range(300):
        words = say(rng.choice([5, 40, 400, 3000 if d < 20 else 60]))
        if d % 3 == 0:
            passage = items[rng.randrange(40)][1].split()
            for _ in range(rng.randint(0, 2)):
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if d % 2 else w for w in passage]
        docs.append((d, rng.choice([" ", "\n", " \t "]).join(words), "x"))
    got = contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    want = set()
    for i, t in items:
        q = grams(t)
        for d, text, _ in docs:
            hit = len(q & grams(text)) if q else 0
            if q and hit * 10 >= 8 * len(q):
                want.add((d, i, hit, len(q)))
    assert {(r.doc_id, r.item_id, r.matched, r.item_shingles) for r in got} == want and len(got) == len(want) > 30


def test_odd_inputs(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame(
        [(1, item, "a"), (1, item, "a"), (None, f"x {item} y", "a"), (2, None, "a"), (3, "", "a"), (4, "one two", "a"), (1, "quite other words in this one", "a")], DOCS
    )
    items = spark.createDataFrame([(7, item), (None, item), (8, None), (9, "one two"), (7, "one two three four five")], ITEMS)
    got = sorted((r.doc_id or -1, r.item_id, r.matched) for r in contaminated_pairs(docs, items).collect())
    assert got == [(-1, 7, 3), (1, 7, 3)]
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "quite other words in this one"), (2, ""), (3, ""), (4, "one two")]
    assert contaminated_pairs(docs.limit(0), items).collect() == [] and decontaminate(docs, items.limit(0)).count() == 7
