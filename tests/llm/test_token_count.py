"""The whole-token shortcut against the library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlark.llm.common import table
from ledgerlark.llm.queries import op6_token_counts
from ledgerlark.llm.token_count import Counter, count_tokens, prove

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def proof():
    return prove(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_query_equals_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op6_token_counts(spark, sf).collect()}
    for i, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False))
        assert got[i] == (len(t.encode()), n, n > 512)


def test_odd_and_random_texts(proof, library):
    counter = Counter(proof)
    rng = random.Random(4)
    pool = [chr(c) for c in range(32, 127)] * 3 + list("éßñüА中文٣²½ⅷ\u0301\u200b\u2003\x85\x1c\x1f\xa0\n\t\r😀𝟙𐐷") + ["<|endoftext|>", "'s", "'re", "  ", "_", "\ufffd"]
    texts = ["", " ", "\n\n ", "<|endoftext|>", "a<|endoftext|>  <|endoftext|>b", "x" * 5000, "word " * 20_000]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False)), repr(t)
    assert len(proof.whole) > 40_000


def test_nulls_repeats_and_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "hello world", "x")], "doc_id long, text string, N_tokens string")
    got = count_tokens(df, PATH, limit=1)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == [(0, 0, False), (0, 0, False), (11, 2, True)]
    assert count_tokens(df.limit(0), PATH).collect() == []
