"""The pipeline's stages against plain versions, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from ledgerlark.llm.common import stash, table
from test_decontaminate import grams
from test_jaccard import kept_by_all_pairs
from test_mixing import targets_of
from test_quality_rules import plain


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    rows, frames = {"start": docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES:
        frames = stash(stage(spark, frames, sf), "test-stage")
        rows[name] = frames.collect()
        if name != "sharding":
            assert frames.columns == columns
    good = {r.doc_id for r in rows["quality_rules"]}  # too few labels here for a cutoff: the base rules decide
    base = {r.doc_id: plain(r.text) for r in rows["start"]}
    assert good == {i for i, m in base.items() if m[0] >= 10 and 100 * m[4] <= 20 * m[0]}
    assert sorted(r.doc_id for r in rows["simhash_dedup"]) == kept_by_all_pairs({r.doc_id: r.text for r in rows["quality_rules"]})
    items = [grams(r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = [r.doc_id for r in rows["simhash_dedup"] if not any(q and 10 * len(q & grams(r.text)) >= 8 * len(q) for q in items)]
    assert sorted(r.doc_id for r in rows["decontamination"]) == sorted(clean)
    size = {r.doc_id: (r.source, plain(r.text)[0]) for r in rows["decontamination"]}
    sums, taken = Counter(), Counter()
    for s, n in size.values():
        sums[s] += n
    for r in rows["mixing"]:
        taken[r.source] += size[r.doc_id][1]
    longest = max(n for _, n in size.values())
    assert all(abs(taken[s] - t) <= longest / 2 + 1 for s, t in targets_of(sums).items())
    assert max(Counter(r.doc_id for r in rows["mixing"]).values()) <= 2
    assert Counter(r.doc_id for r in rows["sharding"]) == Counter(r.doc_id for r in rows["mixing"])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.text) for r in rows["sharding"])


def test_stages_on_odd_documents(spark, sf):
    """Nulls in every column, empty texts, repeated rows, columns named like the operators' own."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "a", 7, "mine", "old"), (1, words, "en", "a", 7, "mine", "old"), (2, words + " x", None, None, None, None, None)]
    rows += [(None, " ".join(f"v{i}" for i in range(30)), None, None, None, "m", "o"), (3, "", "en", "a", 0, "m", "o"), (4, None, "en", "a", 0, "m", "o")]
    rows += [(10 + i, " ".join(f"u{i}x{j}" for j in range(20 + i)), "en", "b", i, "m", "o") for i in range(5)]
    kind = "doc_id long, text string, lang string, source string, n_words int, Kept string, text_digest string"
    docs = spark.createDataFrame(rows, kind)
    given = {(r.doc_id, r.text, r.n_words, r.Kept, r.text_digest) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, sf), "odd-stage")
        if name != "sharding":
            assert docs.columns == before.columns
        out = docs.collect()
        assert out and {(r.doc_id, r.text, r.n_words, r.Kept, r.text_digest) for r in out} <= given
        if name == "quality_rules":
            assert sorted(str(r.doc_id) for r in out) == sorted(["1", "1", "2", "None", "10", "11", "12", "13", "14"])
        if name == "simhash_dedup":
            assert sorted(str(r.doc_id) for r in out) == sorted(["1", "None", "10", "11", "12", "13", "14"])


def test_stages_on_an_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf), "empty-stage")
    assert docs.collect() == []
