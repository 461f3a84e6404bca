"""Base measures against regular expressions; thresholds against the binomial law."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerlark.llm import quality_rules
from ledgerlark.llm.common import table
from ledgerlark.llm.quality_rules import apply_rules, binomial_tail, measure_text, select_cutoffs, measured, strictest


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n ", "a\x85b c\u2003d", "x\nx\n\n x\nx", "a b c d e " * 3, "# " * 20])
def test_measures_of_odd_texts(text):
    assert measure_text(None if text is None else text.encode()) == plain(text)


def test_measures_of_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choices(["a", "b", "é", "中", "#", "|", " ", " ", "\n", "\t", "\x0b"], k=rng.randint(0, 300)))
        assert measure_text(t.encode()) == plain(t)


def test_rules_over_all_documents(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in apply_rules(table(spark, sf, "documents"), table(spark, sf, "labels")).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain(texts[r.doc_id])
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (r.kept and r.base_failed)


def test_binomial_tail():
    for n, p in ((1, 0.3), (30, 0.05), (400, 0.01)):
        for k in range(min(n, 8)):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert strictest([0, 0, 5], 1000, 0.01, 0.05) == 2 and strictest([0], 10, 0.01, 0.05) == 0 and strictest([], 0, 0.1, 0.1) == 0


def test_cutoffs_hold_their_risk_per_stratum(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        lang = "xx" if i % 10 else "yy"
        good = i % 5 > 0
        words = ["word"[: rng.randint(2, 4)] + str(rng.randrange(10**6)) for _ in range(30)]
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang, "old"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in apply_rules(docs, marks, risk=0.02).collect()}
    for lang in ("xx", "yy"):
        mine = [i for i, _, x, _ in rows if x == lang]
        lost = [i for i in mine if i % 5 and not got[i]]
        assert len(lost) <= 0.02 * len(mine)
    caught = sum(not got[i] for i in range(0, 6000, 5) if i % 10)
    assert caught == sum(1 for i in range(0, 6000, 5) if i % 10)  # 4,320 good documents of xx prove a cutoff
    holdout = measured(docs.filter("lang = 'yy'").limit(100))
    assert all(v is None for r in select_cutoffs(holdout, ["lang"]).collect() for v in list(r)[1:])


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "en"), (1, "", "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    assert [(r.n_words, r.kept) for r in apply_rules(docs, marks).collect()] == [(0, False)] * 3
    assert apply_rules(docs.limit(0), marks).collect() == []
    assert apply_rules(docs, marks.limit(0)).count() == 3


def test_path_is_nested_and_follows_junk():
    cuts = quality_rules.CANDIDATES
    for junk in (None, {m: [0] * len(c) for m, c in cuts.items()}, {m: list(range(len(c))) for m, c in cuts.items()}):
        path = quality_rules.tightening_path(junk)
        assert path[-1] == {m: c[-1] for m, c in cuts.items()}
        assert all(b.get(m, math.inf) <= c for a, b in zip(path, path[1:]) for m, c in a.items())
    junk = {m: [0] * len(c) for m, c in cuts.items()}
    junk["symbols_per_word"] = [0, 0, 50] + [60] * 11
    assert quality_rules.tightening_path(junk) == [{"symbols_per_word": x} for x in (4.0, 3.0, 2.0, 1.5)]


def test_a_few_hundred_labels_prove_cutoffs_and_sparse_strata_share_them(spark):
    rows, labels = [], []
    for i in range(2000):  # good: 900 aa, 600 bb, 60 cc, 60 dd (odd: many symbols are good there), none of ee
        lang, good = ("aa", 1) if i < 900 else ("bb", 1) if i < 1500 else ("cc", 1) if i < 1560 else ("dd", 1) if i < 1620 else (["aa", "bb", "cc", "dd", "ee"][i % 5], 0)
        words = [f"word{i}x{j}" for j in range(12)]
        if not good or lang == "dd":
            words = [w + "##" for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in apply_rules(docs, marks, risk=0.01).collect()}
    assert all(kept[i] for i in range(1620))
    # The pool has 60 of 1,620 good documents with many symbols: no cutoff there. aa and bb have their own.
    assert {rows[i][2] for i in range(1620, 2000) if kept[i]} == {"cc", "dd", "ee"}
    calm = docs.filter("lang <> 'dd'")
    kept = {r.doc_id: r.kept for r in apply_rules(calm, marks, risk=0.01).collect()}
    assert {rows[i][2] for i in kept if i >= 1620 and kept[i]} == {"ee"}
    assert quality_rules.labels_needed(0.01, 0.05, 4) == 437
