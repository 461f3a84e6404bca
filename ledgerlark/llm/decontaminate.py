"""Benchmark decontamination: short test items found inside documents of any length.

Items are partitioned by the number of their distinct shingles. Each partition has its own MinHash sketch
length: the k smallest shingle hashes, k one more than the shingles an item of the partition can miss at the
threshold. A document that contains enough of an item must therefore hold a shingle of its sketch, however
long the document is, so no pair is lost. Pairs that meet in a sketch are verified by the exact
containment of the item's shingles. (Sketches of the documents would not do: a long document's MinHash
values hardly ever come from a short passage in it.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import BROADCAST_ROWS, small, stash, words


def shingles(df: DataFrame, text: Column, width: int, *keep: str) -> DataFrame:
    """One row per word position with ``gram`` (the words joined) and its hash ``h``; lower case."""
    tokens = df.select(*keep, words(F.lower(text)).alias("__w")).filter(F.size("__w") >= width)
    placed = tokens.select(*keep, "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - width)).alias("__i"))
    parts = [F.get("__w", F.col("__i") + j) for j in range(width)]
    return placed.select(*keep, F.xxhash64(*parts).alias("h"), F.concat_ws(" ", *parts).alias("gram"))


def item_shingles(items: DataFrame, text: str, item: str, width: int) -> DataFrame:
    """Distinct (item, h, gram) with the item's number of shingles ``q``; rows of one item are united."""
    grams = shingles(items, F.col(text), width, item).filter(F.col(item).isNotNull()).distinct()
    sizes = grams.groupBy(item).agg(F.count(F.lit(1)).alias("q"))
    return stash(grams.join(sizes, item), "item-shingles")


def sketches(grams: DataFrame, item: str, threshold: float) -> DataFrame:
    """(item, h): the sketch of every item, as long as its size partition asks for.

    Partition j has sizes from 2^j to 2^(j+1) - 1.
    """
    most = F.pow(F.lit(2.0), F.floor(F.log2(F.col("q"))) + 1) - 1
    length = F.floor(most * (1 - threshold) + 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy(item).orderBy("h", "gram"))
    return grams.withColumn("__r", rank).filter(F.col("__r") <= length).select(item, "h").distinct()


def contaminated_pairs(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    width: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(key, text_digest, item, matched, item_shingles): every document and item with
    matched >= threshold x item_shingles.

    Words are runs without white space, compared in lower case. Items with fewer than ``width`` words have
    no shingle and match nothing; so do null and empty texts and items with a null id. Repeated documents
    with equal key and text give one row; a null key is returned as null.
    """
    grams = item_shingles(items.select(item, text), text, item, width)
    sketch = stash(sketches(grams, item, threshold), "item-sketches")
    n_sketch = sketch.count()
    # The digest goes with every shingle, not the text.
    digested = docs.select(key, F.col(text).alias("__t"), F.md5(text).alias("text_digest"))
    places = shingles(digested, F.col("__t"), width, key, "text_digest")
    met = places.select(key, "text_digest", "h").join(small(sketch, n_sketch), "h")
    candidates = stash(met.select(key, "text_digest", item).distinct(), "candidates")
    verified = _verify(docs.select(F.col(text).alias("__t")), candidates, grams, item, width)
    enough = verified.filter(F.col("matched") >= F.ceil(F.col("item_shingles") * threshold - 1e-9))
    return candidates.join(enough, ["text_digest", item]).select(
        key, "text_digest", item, "matched", "item_shingles"
    )


def _verify(texts: DataFrame, candidates: DataFrame, grams: DataFrame, item: str, width: int) -> DataFrame:
    """Exact number of the item's shingles in each distinct candidate text."""
    pairs = candidates.select("text_digest", item).distinct()
    wanted = stash(pairs.select("text_digest").distinct(), "candidate-texts")
    digested = texts.filter(F.col("__t").isNotNull()).withColumn("text_digest", F.md5("__t"))
    chosen = digested.join(small(wanted, wanted.count()), "text_digest", "left_semi").dropDuplicates(["text_digest"])
    places = shingles(chosen, F.col("__t"), width, "text_digest")
    known = grams.select(item, "h", F.col("gram").alias("__g"), F.col("q").alias("item_shingles"))
    hits = (
        places.join(small(known, known.count(), BROADCAST_ROWS // 5), "h")
        .filter(F.col("gram") == F.col("__g"))
        .select("text_digest", item, "gram", "item_shingles")
        .distinct()
    )
    return (
        hits.join(pairs, ["text_digest", item], "left_semi")
        .groupBy("text_digest", item, "item_shingles")
        .agg(F.count(F.lit(1)).alias("matched"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents without those that contain an item; rows, columns and null texts otherwise as they are."""
    bad = stash(
        contaminated_pairs(docs, items, text, key, **options).select(F.col("text_digest").alias("__d")).distinct(),
        "contaminated",
    )
    digested = docs.withColumn("__digest", F.coalesce(F.md5(F.col(text)), F.lit("")))
    return digested.join(small(bad, bad.count()), F.col("__digest") == F.col("__d"), "left_anti").drop("__digest")
