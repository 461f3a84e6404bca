"""Quality rules with risk-controlled thresholds.

The base rules are fixed. Beyond them, cutoffs per stratum are selected on labelled documents along one path
that tightens all metrics: the strictest step up to which every step rejects good documents at a rate
proved to be below the allowed one. Labelled junk orders the path, so that what catches junk is tightened first;
the proof is the exact binomial test of the good documents in the stratum, which had no part in the order.
Testing in a fixed order needs no correction along the path, and the level is divided over the
strata (a stratum that passes its whole path leaves its share to the others). Strata with too few labels take the
cutoffs that are proved, as one more test, on all labelled good documents, as far as their own ones bear them out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import small, stash, without

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
_SYMBOLS = b"#*$%&|<>"

#: Metric: candidate cutoffs from lenient to strict; a document is rejected above its cutoff.
CANDIDATES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": tuple(x / 100 for x in (400, 300, 200, 150, 100, 80, 60, 50, 40, 30, 25, 20, 15, 10)),
    "dup_lines_per_word": tuple(x / 1000 for x in (300, 200, 150, 100, 80, 60, 50, 40, 30, 20, 15, 10)),
    "repeat_share": tuple(x / 100 for x in (20, 18, 16, 14, 12, 10, 8, 6, 5, 4, 3, 2)),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5),
}


def measure_text(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """The five base measures of one text; a null text measures like an empty one."""
    raw = raw or b""
    tokens = raw.split()
    n = len(tokens)
    # Code points of the words: all bytes of words but UTF-8 continuation bytes.
    chars = sum(map(len, tokens)) - len(raw.translate(None, _NOT_CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(tokens)


_NOT_CONTINUATION = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def repeated_words(tokens: list[bytes]) -> int:
    """Words that lie in a 5-word window found at least twice in the text."""
    windows = list(zip(*[tokens[i:] for i in range(WINDOW)]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = reach = 0
    for at, w in enumerate(windows):
        if w in twice:
            covered += at + WINDOW - max(at, reach)
            reach = at + WINDOW
    return covered


def measures(text: Column) -> Column:
    kind = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

    @F.arrow_udf(kind)
    def of(texts: pa.Array) -> pa.Array:
        columns = list(zip(*[measure_text(t.as_py()) for t in texts.cast(pa.binary())])) or [[]] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    return of(text)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the five measures and ``base_failed``: under 10 words, or over a fifth of the words in
    repeated windows."""
    docs = without(docs, *MEASURES, "base_failed", "kept")
    out = docs.withColumn("__m", measures(F.col(text)))
    out = out.withColumns({m: F.col("__m")[m] for m in MEASURES}).drop("__m")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def metric(name: str) -> Column:
    per = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / per,
        "dup_lines_per_word": F.col("n_dup_lines") / per,
        "repeat_share": F.col("n_repeat_words") / per,
        "chars_per_word": F.col("word_chars") / per,
    }[name]


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p): how likely so few false rejections are if the true rate were p."""
    if k >= n:
        return 1.0
    terms = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(terms)
    return math.exp(top) * math.fsum(math.exp(t - top) for t in terms)


def strictest(counts: Sequence[int], n: int, risk: float, level: float) -> int:
    """How many candidates, from lenient to strict, pass the test before the first that fails."""
    for i, k in enumerate(counts):
        # The tail grows with k and is at least 1/2 or so from k = n risk on: no need to sum up more.
        if n == 0 or k > n * risk or binomial_tail(k, n, risk) > level:
            return i
    return len(counts)


def tightening_path(junk: dict[str, Sequence[int]] | None = None) -> list[dict[str, float]]:
    """Cutoffs by metric, step by step; every step rejects what the one before does.

    ``junk``: junk documents over each candidate. Steps go where most junk a candidate is caught and end where no
    more is. Without any, all metrics are tightened evenly.
    """
    if not junk or not any(c[-1] for c in junk.values()):
        n = max(map(len, CANDIDATES.values()))
        return [{m: c[i * len(c) // n - 1] for m, c in CANDIDATES.items() if i * len(c) >= n} for i in range(1, n + 1)]
    at, path = dict.fromkeys(CANDIDATES, -1), []
    while True:
        caught = {m: junk[m][i] if i >= 0 else 0 for m, i in at.items()}
        gains = [((junk[m][j] - caught[m]) / (j - at[m]), m, j) for m in CANDIDATES for j in range(at[m] + 1, len(junk[m]))]
        gain, m, to = max(gains, key=lambda g: g[0], default=(0, "", 0))
        if gain <= 0:
            return path
        for at[m] in range(at[m] + 1, to + 1):
            path.append({x: CANDIDATES[x][i] for x, i in at.items() if i >= 0})


def labels_needed(risk: float, level: float, strata: int) -> int:
    """Good documents with which a stratum gets a cutoff if none of them is rejected."""
    return math.ceil(math.log(level / max(1, strata)) / math.log1p(-risk))


def select_cutoffs(
    holdout: DataFrame, strata: Sequence[str], risk: float = 0.01, level: float = 0.05,
    path: Sequence[dict[str, float]] | None = None,
) -> DataFrame:
    """(strata..., one nullable cutoff per metric) from measured good documents that pass the base rules.

    With probability 1 - ``level``, no stratum of ``labels_needed`` loses more than ``risk`` of its good documents, and
    the pooled cutoffs of the others reject no more than ``risk`` of the good documents of all strata. Strata without
    any good label are not listed.
    """
    path = tightening_path() if path is None else list(path)
    over = [reduce(or_, [metric(m) > c for m, c in step.items()]) for step in path]
    sums = [F.sum(x.cast("long")).alias(f"__k{i}") for i, x in enumerate(over)]
    counted = stash(holdout.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"), *sums), "holdout-counts")
    names = ["__n", *[f"__k{i}" for i in range(len(path))]]
    n_all, *k_all = counted.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in names]).first()
    family = max(1, counted.count())
    needed = labels_needed(risk, level, family)
    fields = [f for f in counted.schema.fields if f.name in strata]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + "".join(f", {x} double" for x in CANDIDATES) + ", __whole boolean"
    whole = 0
    while True:
        share = level / (family - whole)
        pooled = strictest(k_all, n_all, risk, share)

        def choose(batches, share=share, pooled=pooled):
            for batch in batches:
                picked, own = [], batch["__n"] >= needed
                for n, *ks in batch[names].itertuples(index=False, name=None):
                    if n >= needed:
                        picked.append(strictest(ks, n, risk, share))
                    else:
                        picked.append(next((i for i, k in enumerate(ks[:pooled]) if k > n * risk), pooled))
                out = batch[list(strata)].copy()
                for m in CANDIDATES:
                    out[m] = pd.Series([path[i - 1].get(m) if i else None for i in picked], index=out.index, dtype="float64")
                yield out.assign(__whole=own & (pd.Series(picked, index=out.index) == len(path)))

        cutoffs = stash(counted.mapInPandas(choose, schema), "cutoffs")
        # Only a stratum that errs in no step can have passed its whole path: its share is free (Holm).
        passed = min(cutoffs.filter("__whole").count(), family - 1)
        if passed <= whole:
            return cutoffs.drop("__whole")
        whole = passed


def labelled(labels: DataFrame, key: str, good: bool = True) -> DataFrame:
    """Keys labelled good, or junk: quality 1, or below, in every row that labels them."""
    return (
        labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min("quality").alias("__q"), F.max("quality").alias("__r"))
        .filter("__q >= 1" if good else "__r < 1")
        .select("__key")
    )


def judge(rows: DataFrame, cutoffs: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Measured rows with ``kept``: false if the base rules fail or a metric is above its stratum's cutoff."""
    right = cutoffs.withColumnsRenamed({c: f"__s{c}" for c in strata} | {m: f"__c{m}" for m in CANDIDATES})
    cond = F.lit(True)
    for c in strata:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__s{c}"))
    rejected = F.col("base_failed")
    for m in CANDIDATES:
        rejected = rejected | F.coalesce(metric(m) > F.col(f"__c{m}"), F.lit(False))
    joined = rows.join(small(right, cutoffs.count()), cond, "left").withColumn("kept", ~rejected)
    return joined.drop(*[f"__s{c}" for c in strata], *[f"__c{m}" for m in CANDIDATES])


def fit_cutoffs(
    rows: DataFrame, labels: DataFrame, strata: Sequence[str] = ("lang",), key: str = "doc_id", risk: float = 0.01, level: float = 0.05
) -> DataFrame:
    """Cutoffs from narrow measured rows and all labels; see ``select_cutoffs``."""
    passing = rows.filter(~F.col("base_failed"))
    of = lambda good: passing.join(labelled(labels, key, good), F.col(key) == F.col("__key"), "left_semi")
    over = [F.coalesce(F.sum((metric(m) > c).cast("long")), F.lit(0)) for m, cuts in CANDIDATES.items() for c in cuts]
    counts = iter(of(False).agg(*[x.alias(f"__{i}") for i, x in enumerate(over)]).first())
    path = tightening_path({m: [next(counts) for _ in cuts] for m, cuts in CANDIDATES.items()})
    return select_cutoffs(of(True), strata, risk, level, path)


def verdicts(
    docs: DataFrame, labels: DataFrame, strata: Sequence[str] = ("lang",), text: str = "text", key: str = "doc_id", **limits
) -> DataFrame:
    """One narrow row per document: key, strata, measures, ``base_failed`` and ``kept``.

    Words are runs without blanks and ASCII controls 9 to 13. Null and empty texts have no words and fail the base
    rules. A null stratum is a stratum of its own; without labels only the base rules decide. Every row
    returns a row, also repeated ones. Texts are read once and never shuffled.
    """
    narrow = measured(docs.select(key, *strata, text), text).select(key, *strata, *MEASURES, "base_failed")
    rows = stash(narrow, "measures")
    return judge(rows, fit_cutoffs(rows, labels, strata, key, **limits), strata)


def apply_rules(
    docs: DataFrame, labels: DataFrame, strata: Sequence[str] = ("lang",), text: str = "text", key: str = "doc_id", **limits
) -> DataFrame:
    """The documents with the columns of ``verdicts``, by the same rules.

    Texts are read twice, once for the cutoffs and once for the verdicts, and never shuffled.
    """
    narrow = measured(docs.select(key, *strata, text), text).select(key, *strata, *MEASURES, "base_failed")
    cutoffs = fit_cutoffs(stash(narrow, "measures"), labels, strata, key, **limits)
    return judge(measured(docs, text), cutoffs, strata)
