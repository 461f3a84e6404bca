"""Near copies by Jaccard similarity against all pairs."""

import random
import re

import corpus_pipeline
import pytest
from ledgerlark.llm import jaccard
from ledgerlark.llm.common import table


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_all_pairs(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(texts):
        for b in texts:
            if b < a and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted({find(i) for i in texts})


def edited_copies():
    """Bases with a common passage, copies with edits around the threshold, a large group of near copies, odd texts."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    texts = ["", None, " \n", "one two", "ONE two", "a b c d e", "a b c d e f"]
    for g in range(15):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(12, 200))] + passage
        for _ in range(rng.randint(1, 5) if g else 40):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_stage_against_all_pairs(spark, sf, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    texts = dict(enumerate(edited_copies()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect())
    assert got == kept_by_all_pairs(texts)


def test_stage_on_documents(spark, sf):
    docs = table(spark, sf, "documents")
    want = kept_by_all_pairs({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == want
