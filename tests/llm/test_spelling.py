"""Spelling variants against a plain version over deletion keys, and odd inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlark.llm import spelling
from ledgerlark.llm.common import table
from ledgerlark.llm.queries import op11_spelling_variants


def plain_words(rows, shortest=6, least=5, every=199):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, ratio=5):
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_over_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = rows_of(op11_spelling_variants(spark, sf_dir))
    assert got == plain_variants(plain_words((r.doc_id, r.text) for r in docs.collect()))
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_all_one_edit_pairs_of_random_words(spark, symbols):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcdéÀ÷") for _ in range(rng.randint(1, 6))): rng.randint(1, 9) for _ in range(500)}
    got = {(r.word, r.near) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), symbols).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_chains_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 3)
    texts = ["aaaaaa " * 1, "aaaaab " * 6, "aaaabb " * 40, "zzaaab " * 6, None, "", "×÷ÿ" * 3, "q" * 5000 + " " + "q" * 5001, "AAAAAA!aaaaaa"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "aaaaab", "y")] * 2, "doc_id long, text string, word string")
    got = rows_of(spelling.variants(docs, least=1, ratio=5))
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()], least=1, every=0))
    assert got == want
    planted = rows_of(spelling.variants(docs, least=1, every=2))
    assert planted == plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()], least=1, every=2))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).collect() == []


def test_no_table_of_words_is_broadcast(spark):
    words = spark.createDataFrame([(f"planeta{c}", 7) for c in "abcdefgh"], "word string, n bigint")
    docs = words.selectExpr("n as doc_id", "concat_ws(' ', array_repeat(word, 6)) as text")
    for df in (spelling.near_words(words), spelling.variants(docs)):
        assert df.count() > 0
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
