"""Quality and toxicity of documents by hierarchical empirical Bayes.

A document's own evidence is the log likelihood ratio of its features (words, and bins of its style)
under naive Bayes counts of all labelled documents. A site's evidence is a Beta posterior: the host
level is shrunk towards the global rate and the path level towards its host, each with a strength that
is estimated from the spread between sites. The posterior log odds of a document are those of its path
plus its own evidence. The evidence leaves the document's own label out; the counts of its site keep it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import in_map, key_map, small, stash, without

HEADS = ("quality", "toxic")
OUTPUTS = ("quality_evidence", "toxic_evidence", "p_quality", "p_toxic", "kept")
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 300_000  # distinct features a task holds before it passes its counts on
_SYMBOLS = b"#*$%&|<>"
#: The most frequent features of a model, whose weights every task loads; the weights of the others are joined.
LOADED = 100_000
_SLICES = 1 << 16  # of the hash range in which the training sample ends
_UNIT = 1e9  # weights are whole numbers of billionths, whose sums depend on no order


def features(text: str | None) -> set[str]:
    """Distinct words in lower case and seven style bins; style names start with a digit, words never."""
    text = text or ""
    raw = text.encode()
    tokens = raw.split()
    n = max(1, len(tokens))
    found = set(_WORD.findall(text.lower()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = max(1, len(text))

    def level(share: float, *cuts: float) -> int:
        return sum(share > c for c in cuts)

    found |= {
        f"0symbols{level((len(raw) - len(raw.translate(None, _SYMBOLS))) / n, 0.02, 0.1, 0.3, 1)}",
        f"1variety{level(len(set(tokens)) / n, 0.05, 0.15, 0.3, 0.5)}{level(n, 20, 60, 200, 1000)}",
        f"2length{level(len(text) / n, 3, 4.5, 5.5, 7, 10, 15)}",
        f"3capitals{level(sum(map(str.isupper, text)) / size, 0.02, 0.06, 0.15, 0.4)}",
        f"4lines{level(len(set(lines)) / max(1, len(lines)), 0.3, 0.6, 0.9)}",
        f"5shouts{level(text.count('!') / n, 0.02, 0.1, 0.4)}",
        f"6words{level(n, 5, 10, 30)}",
    }
    return found


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of documents by feature and label pair; the pair 0..3 is 2 x quality + toxic."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(counts.values(), pa.int64())],
            names=["feature", "pair", "n"],
        )
        counts.clear()
        return batch

    for batch in batches:
        for text, pair in zip(batch.column(0), batch.column(1)):
            pair = pair.as_py()
            counts.update((f, pair) for f in features(text.as_py()))
            counts[("", pair)] += 1
            if len(counts) > _FLUSH:
                yield flush()
    if counts:
        yield flush()


def clean_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per key: with repeats, the worst quality and the worst toxicity; nulls are unlabelled."""
    bad = lambda c: F.col(c).cast("int")
    return (
        labels.filter(F.col(key).isNotNull() & bad("quality").isin(0, 1) & bad("toxic").isin(0, 1))
        .groupBy(key)
        .agg(F.min(bad("quality")).alias("__quality"), F.max(bad("toxic")).alias("__toxic"))
    )


def training_sample(marks: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` of the labelled keys, those with the smallest hashes: the same ones in every run.

    A count gives the range of hashes in which the sample must end, counts of its slices (a fixed number of rows)
    give the slice; no task sorts or holds the sample.
    """
    n = marks.count()
    if n <= most:
        return marks
    reach = 1.5 * most / n
    place = F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)
    near = marks.withColumn("__slice", F.floor(place / reach * _SLICES)).filter(F.col("__slice") < _SLICES)
    sizes = {r["__slice"]: r["count"] for r in near.groupBy("__slice").count().collect()}
    last, held = -1, 0
    while last + 1 < _SLICES and held + sizes.get(last + 1, 0) <= most:
        last += 1
        held += sizes.get(last, 0)
    return near.filter(F.col("__slice") <= last).drop("__slice")


@dataclass(frozen=True)
class Evidence:
    """Counts of a fitted model: ``whole`` documents by label pair, and a table (feature, n0..n3, quality, toxic) of
    the features that count; the last two columns tell for which head."""

    whole: tuple[int, ...]
    table: DataFrame


def _pairs(head: str) -> tuple[list[int], list[int]]:
    """Label pairs in which the head's label is 1, and those in which it is 0."""
    yes = [2, 3] if head == "quality" else [1, 3]
    return yes, [p for p in range(4) if p not in yes]


def fit_evidence(labelled: DataFrame, text: str = "text", least_gain: float = 30.0) -> Evidence | None:
    """Naive Bayes counts of all rows with ``__pair``; None without any.

    A feature counts for a head where its likelihood-ratio statistic passes ``least_gain`` (chance gives it to a
    feature about once in 20 million). Counts are grouped sums over all labelled documents, and every such feature
    is in the model, however many there are.
    """
    counted = labelled.select(text, "__pair").mapInArrow(_count_features, "feature string, pair int, n long")
    sums = [F.sum(F.when(F.col("pair") == p, F.col("n")).otherwise(0)).alias(f"n{p}") for p in range(4)]
    table = stash(counted.groupBy("feature").agg(*sums), "features")
    whole = table.filter("feature = ''").select("n0", "n1", "n2", "n3").first()
    if whole is None:
        return None
    counts: dict[str, Column] = {}
    for head in HEADS:
        yes, no = _pairs(head)
        n1, n0 = (float(sum(whole[p] for p in side)) for side in (yes, no))
        k1, k0 = (sum(F.col(f"n{p}") for p in side) for side in (yes, no))
        cells = [(k1, n1), (k0, n0), (n1 - k1, n1), (n0 - k0, n0)]
        rate = (k1 + k0) / (n1 + n0)
        gain = F.lit(0.0)
        for (k, n), r in zip(cells, (rate, rate, 1 - rate, 1 - rate)):
            gain = gain + F.when((k > 0) & (r * n > 0), 2 * k * F.log(k / (r * n))).otherwise(0.0)
        counts[head] = F.lit(n1 * n0 > 0) & (gain > least_gain)
    table = table.filter("feature <> ''").withColumns(counts).filter("quality or toxic")
    return Evidence(tuple(whole), stash(table, "model"))


def weight(head: str, counts: Sequence[int], whole: Sequence[int]) -> int:
    """Log likelihood ratio of a feature in billionths."""
    (k1, k0), (n1, n0) = (
        [sum(c[p] for p in side) for side in _pairs(head)] for c in (counts, whole)
    )
    return round(_UNIT * (math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))))


def _weight_column(head: str, whole: Sequence[int]) -> Column:
    """``weight`` of the counts n0..n3 without one document of the label pair ``__pair`` (-1: without none)."""
    own = [(F.col("__pair") == p).cast("int") for p in range(4)]

    def share(side: list[int]) -> Column:
        k, n = sum(F.col(f"n{p}") - own[p] for p in side), sum(whole[p] - own[p] for p in side)
        return F.log((k + 0.5) / (n + 1))

    yes, no = _pairs(head)
    return F.when(F.col(head), F.rint(_UNIT * (share(yes) - share(no))).cast("long")).otherwise(F.lit(0).cast("long"))


def _loaded_evidence(text: Column, pair: Column, model: Evidence, rows: list, spark) -> Column:
    """[quality, toxic] sums of the loaded features, in billionths.

    A weight without one document depends on the document's label pair alone, so there are five of each.
    """
    loaded: dict[int, dict[str, tuple[int, ...]]] = {left: {} for left in range(-1, 4)}
    for feature, *counts, quality, toxic in rows:
        for left, weights in loaded.items():
            if left < 0 or counts[left]:  # else no document of the pair has it
                own, whole = ([n - (p == left) for p, n in enumerate(c)] for c in (counts, model.whole))
                weights[feature] = tuple(weight(h, own, whole) if on else 0 for h, on in zip(HEADS, (quality, toxic)))
    shared = spark.sparkContext.broadcast(loaded)

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array, pairs: pa.Array) -> pa.Array:
        out = []
        for t, pair in zip(texts, pairs.to_pylist()):
            known = shared.value[pair]
            hits = [known[f] for f in features(t.as_py()) & known.keys()]
            out.append([sum(h[0] for h in hits), sum(h[1] for h in hits)])
        return pa.array(out, pa.list_(pa.int64()))

    return of(text, pair)


def _joined_evidence(docs: DataFrame, text: str, model: Evidence, rest: DataFrame) -> DataFrame:
    """(__text, __pair, __q, __t): sums of the features in ``rest`` per distinct text and label pair.

    Only features that a bit map of fixed size may know leave the Python workers; what remains are rare features, so no
    key of the join is hot, and copies of a text fall together before it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_map(rest.select(F.xxhash64("feature").alias("h")), "h"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t, name, pair in zip(*batch.columns):
                names = sorted(features(t.as_py()))
                keys = np.array([xxhash.xxh64_intdigest(f, seed=42) for f in names], dtype=np.uint64)
                names = [f for f, hit in zip(names, in_map(shared.value, keys)) if hit]
                for column, values in zip(out, ([name.as_py()] * len(names), [pair.as_py()] * len(names), names)):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())],
                names=["__text", "__pair", "feature"],
            )

    rows = docs.select(text, "__text", "__pair").mapInArrow(found, "__text string, __pair int, feature string").distinct()
    sums = [F.sum(_weight_column(h, model.whole)).alias(f"__{h[0]}") for h in HEADS]
    return rows.join(rest, "feature").groupBy("__text", "__pair").agg(*sums)


def with_evidence(docs: DataFrame, text: str, model: Evidence | None) -> DataFrame:
    """The documents (with ``__pair``: the label pair with which they were fitted, else -1) without their text and with both
    log likelihood ratios; what a document's own label gave to the counts is left out (which features count at all is
    decided once, with all of them)."""
    names = [f"{h}_evidence" for h in HEADS]
    if model is None:
        return docs.drop(text).withColumns({n: F.lit(0.0) for n in names})
    total = sum(F.col(f"n{p}") for p in range(4))
    rows, loaded, rest = model.table.count(), model.table, None
    if rows > LOADED:
        ordered = model.table.orderBy(F.desc(total), "feature").limit(LOADED)
        loaded = stash(ordered, "model-loaded")
        rest = stash(model.table.join(loaded.select("feature"), "feature", "left_anti"), "model-joined")
    listed = [tuple(r) for r in loaded.select("feature", *[f"n{p}" for p in range(4)], *HEADS).collect()]  # at most LOADED
    mine = _loaded_evidence(F.col(text), F.col("__pair"), model, listed, docs.sparkSession)
    if rest is None:
        sums = docs.withColumn("__e", mine).drop(text)
        return sums.withColumns({n: F.col("__e")[i] / _UNIT for i, n in enumerate(names)}).drop("__e")
    named = docs.withColumn("__text", F.md5(F.coalesce(F.col(text), F.lit(""))))
    other = _joined_evidence(named, text, model, rest)
    sums = named.withColumn("__e", mine).drop(text).join(other, ["__text", "__pair"], "left")
    both = {n: (F.col("__e")[i] + F.coalesce(F.col(f"__{n[0]}"), F.lit(0))) / _UNIT for i, n in enumerate(names)}
    return sums.withColumns(both).drop("__e", "__q", "__t", "__text")


def site_posteriors(scored: DataFrame, sites: Sequence[str], head: str) -> tuple[list[DataFrame], Column]:
    """Grouped posteriors of one head, one table per level: [(site columns..., mean)], and the global rate.

    The count of a site is the sum over all its documents: a label counts 1 or 0, an unlabelled document the
    probability that its evidence gives under the global rate. The strength of the shrinkage at a level
    is the Beta precision that explains the spread of its sites (method of moments, at least 1).
    """
    label, llr = F.col(f"__{head}"), F.col(f"{head}_evidence")
    base = scored.agg(((F.coalesce(F.sum(label), F.lit(0)) + 0.5) / (F.count(label) + 1)).alias("p")).first()["p"]
    prior = math.log(base / (1 - base))
    soft = F.coalesce(label.cast("double"), 1 / (1 + F.exp(-(llr + prior))))
    cells = stash(scored.groupBy(*sites).agg(F.sum(soft).alias("s"), F.count(F.lit(1)).alias("n")), "sites")
    tables: list[DataFrame] = []
    for depth in range(1, len(sites) + 1):
        level = cells.groupBy(*sites[:depth]).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        if tables:
            upper = tables[-1].withColumnsRenamed({c: f"__u{c}" for c in sites[: depth - 1]} | {"mean": "up"})
            same = [F.col(c).eqNullSafe(F.col(f"__u{c}")) for c in sites[: depth - 1]]
            cond = same[0]
            for s in same[1:]:
                cond = cond & s
            level = level.join(upper, cond).select(*sites[:depth], "s", "n", "up")
        else:
            level = level.withColumn("up", F.lit(base))
        level = stash(level, "site-level")
        rate = F.col("s") / F.col("n")
        noise = F.col("up") * (1 - F.col("up"))
        moments = level.agg(
            F.sum(F.col("n") * (rate - F.col("up")) ** 2).alias("spread"),
            F.sum(noise).alias("chance"),
            F.sum((F.col("n") - 1) * noise).alias("room"),
        ).first()
        # E[n (rate - up)^2] = up (1 - up) (1 + (n - 1) / (strength + 1))
        extra = ((moments["spread"] or 0) - (moments["chance"] or 0)) / max(moments["room"] or 0, 1e-12)
        strength = max(1.0, min(1e9, 1 / max(extra, 1e-9) - 1))
        tables.append(level.select(*sites[:depth], ((F.col("s") + strength * F.col("up")) / (F.col("n") + strength)).alias("mean")))
    return tables, F.lit(base)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    sites: Sequence[str] = ("source", "lang"),
    text: str = "text",
    key: str = "doc_id",
    cutoff: float = 0.5,
    train_rows: int = 200_000,
    **fit,
) -> DataFrame:
    """One row per document: key, sites, both evidences, ``p_quality``, ``p_toxic`` and ``kept``.

    ``sites`` name the host and, inside it, path levels, from coarse to fine; a null site is a site of its
    own. Kept are documents with p_quality of at least ``cutoff`` and p_toxic below it. The evidence is fitted on
    at most ``train_rows`` labelled documents, whose keys are broadcast, so texts are not shuffled; all labels
    and all documents count for the sites. A document's evidence leaves its own label out. A null or
    empty text has only style evidence. Without any labels both evidences are 0 and both rates 0.5. Repeated rows return
    a row each; a repeated key with labels takes them for each row; an empty table returns no rows.
    """
    marks = stash(clean_labels(labels, key), "labels")
    plain = without(docs, *OUTPUTS, "__quality", "__toxic").select(key, *sites, text)
    pair = (2 * F.col("__quality") + F.col("__toxic")).cast("int").alias("__pair")
    sample = stash(training_sample(marks, key, train_rows).select(key, pair), "training-keys")
    paired = plain.join(F.broadcast(sample), key, "left").withColumn("__pair", F.coalesce("__pair", F.lit(-1)))
    model = fit_evidence(plain.join(F.broadcast(sample), key), text, **fit)  # at most train_rows narrow rows
    scored = stash(with_evidence(paired, text, model).drop("__pair"), "evidence").join(marks, key, "left")
    scored = stash(scored, "evidence-labelled")
    out = scored
    for head in HEADS:
        tables, _ = site_posteriors(scored, sites, head)
        finest = tables[-1]
        rows = finest.count()
        right = finest.withColumnsRenamed({c: f"__s{c}" for c in sites} | {"mean": f"__m{head}"})
        cond = F.lit(True)
        for c in sites:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__s{c}"))
        out = out.join(small(right, rows), cond).drop(*[f"__s{c}" for c in sites])
        mean = F.col(f"__m{head}")
        out = out.withColumn(f"p_{head}", 1 / (1 + F.exp(-(F.col(f"{head}_evidence") + F.log(mean / (1 - mean))))))
    kept = (F.col("p_quality") >= cutoff) & (F.col("p_toxic") < cutoff)
    return out.withColumn("kept", kept).select(key, *sites, *OUTPUTS)
