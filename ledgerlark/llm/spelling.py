"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, which makes a word's one-edit neighbourhood small enough to list in full:
deletions, replacements and insertions of symbols, and the reduced word itself (a letter may be replaced by one
of the same symbol). Every word asks the reduced vocabulary for its neighbourhood; what comes back is verified
on the original strings. Reduced words travel as 64-bit polynomial hashes, from which the hashes of all neighbours
follow by prefix and suffix sums; a hash collision only adds a pair that the verification rejects.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import in_map, key_map, stash

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct words that a task counts before it hands them on.
_HELD = 300_000
SYMBOLS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LONGEST = 1 << 12  # powers are kept so far; longer words compute theirs


def mutated(key: str, word: str, every: int) -> str:
    """The word, with one code point less if ``every`` divides the checksum of ``key:word``; 0: never."""
    if not every:
        return word
    h = zlib.crc32(f"{key}:{word}".encode("utf-8", "surrogatepass"))
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 6, least: int = 5, every: int = 0) -> DataFrame:
    """(word, n): runs of letters of all whole texts, A-Z lower-cased, of ``shortest`` code points and ``least``
    occurrences or more. ``every`` > 0 plants deletions (a null key counts as ``null``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                if (value := t.as_py()) is None:
                    continue
                name = k.as_py() or "null"
                own = Counter(m.group() for m in _RUN.finditer(value.translate(_LOWER)))
                for word, n in own.items():
                    form = mutated(name, word, every)
                    if len(form) >= shortest:
                        held[form] += n
                if len(held) > _HELD:
                    yield out()
        if held:
            yield out()

    keyed = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return keyed.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def reduced(word: str, symbols: int) -> np.ndarray:
    """The word's letters as symbols 1 to ``symbols``."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return (points * np.uint64(2654435761) % np.uint64(1 << 32) >> np.uint64(13)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


_POWERS = _powers(_LONGEST)


def neighbourhood(word: str, symbols: int = SYMBOLS) -> tuple[int, np.ndarray]:
    """Hash of the reduced word; hashes of its full one-edit neighbourhood, itself included, each once."""
    s = reduced(word, symbols)
    n = len(s)
    power = _POWERS[: n + 1] if n < _LONGEST else _powers(n + 1)
    terms = s * power[:n]
    ahead = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)]
    own = ahead[n]
    behind = own - ahead  # terms from a position on
    letters = np.arange(1, symbols + 1, dtype=np.uint64)[:, None]
    deleted = ahead[:n] + behind[1:] * _BACK
    replaced = own - terms + letters * power[:n]
    inserted = ahead + letters * power + behind * _BASE
    return int(own.view(np.int64)), np.unique(np.concatenate([deleted, replaced.ravel(), inserted.ravel()])).view(np.int64)


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by one inserted, deleted or replaced code point, both ways.

    ``words``: (word, n), each word once. A bit map of the reduced vocabulary's keys, of a fixed size, spares the
    shuffle most neighbours that no word has; it never drops one that a word has.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [neighbourhood(w, symbols)[0] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column(0), batch.column(1)], names=["key", "word", "n"])

    vocabulary = stash(words.select("word", "n").mapInArrow(keys, "key bigint, word string, n bigint"), "reduced-words")
    used = words.sparkSession.sparkContext.broadcast(key_map(vocabulary, "key"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = used.value
        for batch in batches:
            counts, lists = [], []
            for w in batch.column(0).to_pylist():
                near = neighbourhood(w, symbols)[1]
                near = near[in_map(bits, near)]
                counts.append(len(near))
                lists.append(near)
            at = np.repeat(np.arange(len(counts)), counts)
            flat = np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["key", "word", "n"])

    asked = vocabulary.select("word", "n").mapInArrow(ask, "key bigint, word string, n bigint")
    # Spark sizes what is asked like the vocabulary, though every word asks for many keys, and would broadcast it.
    met = asked.join(vocabulary.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "key")
    close = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    # A pair may meet under several keys only if hashes collide or two edits have one reduced form.
    return met.filter(close).select("word", "n", "near", "near_n").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): from word along (word, form) to the last one; every hop doubles. Forms never run in circles."""
    now = stash(forms.select("word", F.col("form").alias("root")), "form-hops")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        hop = stash(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")), "form-hops")
        now = hop.select("word", "root")
        if hop.filter("went").isEmpty():
            return now


def variants(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 6, least: int = 5, ratio: int = 5, every: int = 0,
    symbols: int = SYMBOLS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least ``ratio`` times the
    word's; the root follows the forms to the last. Null texts have no words, a null key counts as ``null``,
    repeated rows count each, other columns don't matter. Empty tables give no rows; very long texts are read whole.
    No table of words is broadcast, as its files say little about its size in memory.
    """
    words = stash(count_words(docs, text, key, shortest, least, every), "words")
    near = stash(near_words(words, symbols), "near-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("b")
    found = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    placed = words.join(found.hint("merge"), "word", "left").withColumn("has", F.coalesce(-F.col("b.minus") >= ratio * F.col("n"), F.lit(False)))
    rows = stash(placed.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("b.near")).alias("form"),
        F.when(F.col("has"), -F.col("b.minus")).alias("form_n"),
    ), "word-forms")
    roots = last_forms(rows.filter("form is not null"))
    return rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
