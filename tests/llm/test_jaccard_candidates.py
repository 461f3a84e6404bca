"""Candidate pairs of the prefix filter: sets that share a common passage meet only where they can be similar."""

import random

import numpy as np
import pytest
from ledgerlark.llm import jaccard


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


@pytest.fixture
def asked(monkeypatch):
    counts, similar = [], jaccard.Verifier.similar

    def counted(self, pairs):
        counts.append(pairs.count())
        return similar(self, pairs)

    monkeypatch.setattr(jaccard.Verifier, "similar", counted)
    return counts


def components(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return len({r.root for r in jaccard.near_copies(docs).collect()})


def test_passage_that_fills_most_of_a_text_makes_no_pairs(spark, asked):
    rng = random.Random(3)
    passage = words(rng, 44)  # 40 shingles of 48: similarity 0.71, but the first fifth of a set has two of them
    assert components(spark, [" ".join(words(rng, 8) + passage) for _ in range(60)]) == 60
    assert sum(asked) < 60


def test_passages_too_rare_for_the_sample_go_last(spark, asked, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    rng = random.Random(4)
    passages = [words(rng, 30) for _ in range(4)]
    texts = [" ".join(words(rng, 60) + passages[i % 4]) for i in range(80)]
    assert components(spark, texts) == 80
    assert sum(asked) < 80


def test_more_late_shingles_leave_other_heads_alone():
    s = np.arange(10, dtype=np.int64)
    late = jaccard.Late(np.array([7, 1], dtype=np.int64), np.array([5, 90], dtype=np.int64))
    assert late.head(s, 10).tolist() == [0, 2, 3, 4, 5, 6, 8, 9, 7, 1]
    more = late.plus(np.array([1, 4], dtype=np.int64), np.array([2, 30], dtype=np.int64))
    assert more.head(s, 10).tolist() == [0, 2, 3, 5, 6, 8, 9, 7, 4, 1]
    assert more.head(s[5:], 10).tolist() == late.head(s[5:], 10).tolist()
