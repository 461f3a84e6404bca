"""Hierarchical empirical Bayes: held-out accuracy, shrinkage, odd inputs."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import quality_classifier
from ledgerlark.llm.common import table
from ledgerlark.llm.quality_classifier import classify, features, training_sample


def auc(pairs):
    order = sorted(pairs)
    pos = [i for i, (_, y) in enumerate(order) if y]
    n1, n0 = len(pos), len(order) - len(pos)
    return (sum(i + 1 for i in pos) - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels, "doc_id").drop("quality", "toxic")
    train = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = classify(docs, labels.filter(train)).join(labels.filter(~train), "doc_id").collect()
    assert auc([(r.p_quality, r.quality) for r in got]) > 0.9
    assert auc([(r.p_toxic, r.toxic) for r in got]) > 0.85
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in clean) / len(clean) > 0.97


def test_sites_shrink_towards_host_and_globe(spark):
    rows = [(i, "same words for all", "good" if i < 300 else "bad", "en") for i in range(600)]
    rows += [(900, "same words for all", "bad", "fr"), (901, "same words for all", "new", "en")]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    p = {r.doc_id: r.p_quality for r in classify(docs, labels).collect()}
    assert p[0] > 0.9 and p[599] < 0.1
    assert p[599] < p[900] < 0.5  # a sparse path follows its host
    assert p[599] < p[901] < p[0]  # an unknown host stays near the global rate


def test_odd_inputs(spark):
    schema = "doc_id long, text string, source string, lang string, kept string, p_toxic int"
    docs = spark.createDataFrame(
        [(None, None, None, None, "x", 1), (1, "", "s", None, "x", 1), (1, "", "s", None, "x", 1), (2, "a" * 200_000, "s", "en", "x", 1)], schema
    )
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == 4 and all(isinstance(r.kept, bool) and 0 < r.p_quality < 1 for r in got)
    none = classify(docs, labels.limit(0)).collect()
    assert all(r.quality_evidence == 0 and r.p_quality == pytest.approx(0.5) for r in none)
    assert classify(docs.limit(0), labels).collect() == []


def test_features_are_words_and_style():
    got = features("Idiot! idiot, |x|")
    assert {"idiot", "x"} < got and sum(f[0].isdigit() for f in got) == 7
    assert features(None) == features("")


def plain_classify(docs, labels, least_gain=30.0):
    """Evidence and two-level posteriors by loops over (id, text, source, lang) and {id: (quality, toxic)}."""
    pairs = {i: 2 * q + t for i, (q, t) in labels.items()}
    whole, counts = Counter(), defaultdict(Counter)
    for i, text, _, _ in docs:
        if i in pairs:
            whole[pairs[i]] += 1
            for f in features(text):
                counts[f][pairs[i]] += 1
    out = {i: [] for i, *_ in docs}
    for head, yes in (("quality", (2, 3)), ("toxic", (1, 3))):
        no = [p for p in range(4) if p not in yes]
        of = lambda c, side: sum(c[p] for p in side)
        n1, n0 = of(whole, yes), of(whole, no)

        def gain(c):
            k1, k0, total = of(c, yes), of(c, no), 0.0
            rate = (k1 + k0) / (n1 + n0)
            for k, n, r in ((k1, n1, rate), (k0, n0, rate), (n1 - k1, n1, 1 - rate), (n0 - k0, n0, 1 - rate)):
                total += 2 * k * math.log(k / (r * n)) if k and r * n else 0
            return total

        good = {f for f, c in counts.items() if gain(c) > least_gain}
        llr = {}
        for i, text, _, _ in docs:
            own = Counter([pairs[i]] if i in pairs else [])
            llr[i] = 0.0
            for f in features(text) & good:
                (k1, k0), (m1, m0) = ((of(c, yes) - of(own, yes), of(c, no) - of(own, no)) for c in (counts[f], whole))
                llr[i] += math.log((k1 + 0.5) / (m1 + 1)) - math.log((k0 + 0.5) / (m0 + 1))
        side = {i: int(p in yes) for i, p in pairs.items()}
        base = (sum(side.values()) + 0.5) / (len(side) + 1)
        soft = {i: side.get(i, 1 / (1 + math.exp(-(llr[i] + math.log(base / (1 - base)))))) for i in llr}
        up = {(): base}
        for depth in (1, 2):
            sums = defaultdict(lambda: [0.0, 0])
            for i, _, *site in docs:
                sums[tuple(site[:depth])][0] += soft[i]
                sums[tuple(site[:depth])][1] += 1
            above = {k: up[k[:-1]] for k in sums}
            spread = sum(n * (s / n - above[k]) ** 2 for k, (s, n) in sums.items())
            chance = sum(above[k] * (1 - above[k]) for k in sums)
            room = sum((n - 1) * above[k] * (1 - above[k]) for k, (_, n) in sums.items())
            strength = max(1.0, min(1e9, 1 / max((spread - chance) / max(room, 1e-12), 1e-9) - 1))
            up = {k: (s + strength * above[k]) / (n + strength) for k, (s, n) in sums.items()}
        for i, _, *site in docs:
            mean = up[tuple(site)]
            out[i] += [llr[i], 1 / (1 + math.exp(-(llr[i] + math.log(mean / (1 - mean)))))]
    return out


@pytest.mark.parametrize("loaded", [100_000, 6])
def test_whole_tables_against_loops(spark, monkeypatch, loaded):
    """Also with most of the weights joined instead of loaded."""
    monkeypatch.setattr(quality_classifier, "LOADED", loaded)
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").filter("doc_id % 3 <> 0")
    twice = [r for r in labels.groupBy("doc_id").count().collect() if r["count"] > 1]
    assert not twice
    want = plain_classify(
        [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}, 8.0
    )
    got = classify(docs, labels, least_gain=8.0).collect()
    assert len(got) == len(want) > 100
    for r in got:
        assert [r.quality_evidence, r.p_quality, r.toxic_evidence, r.p_toxic] == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-6)
    assert len({r.quality_evidence for r in got}) > 20


def test_own_label_is_no_evidence(spark):
    rows = [(i, f"calm words {'good' if i % 2 else 'poor'}", "s", "en") for i in range(200)]
    docs = spark.createDataFrame([*rows, (200, "calm words good", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = [(i, i % 2, 0) for i in range(200)]

    def odd_one(q):
        table_ = spark.createDataFrame([*labels, *([] if q is None else [(200, q, 0)])], "doc_id long, quality int, toxic int")
        return classify(docs, table_).filter("doc_id = 200").first()

    low, none, high = (odd_one(q) for q in (0, None, 1))
    assert low.quality_evidence == none.quality_evidence == high.quality_evidence > 0


def test_sample_keeps_smallest_hashes_within_bound(spark):
    marks = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert training_sample(marks, "doc_id", 20_000).count() == 20_000
    got = {r.doc_id for r in training_sample(marks, "doc_id", 1_000).collect()}
    order = [r.doc_id for r in marks.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).collect()]
    assert 990 <= len(got) <= 1_000 and got == set(order[: len(got)])
