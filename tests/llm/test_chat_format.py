"""Windows: reading back is exact, targets count once, budgets hold."""

import random

import pytest

from ledgerlark.llm.chat_format import escape, read_back, unescape, windows
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def test_escape_round_trip(spark):
    rng = random.Random(8)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "/INST]", "a", "é", "\n", "<\\s>"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).collect()
    for r in got:
        assert unescape(r.e) == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_windows_keep_budget_history_and_targets(spark):
    rng = random.Random(1)
    rows = [(c, t, "system" if t == 0 and c % 2 else "user" if t % 2 else "assistant", " ".join(["w"] * rng.randint(0, 60)), "x")
            for c in range(6) for t in range(rng.choice([1, 2, 900 if c == 0 else 30]))]
    shown = windows(spark.createDataFrame(rows, SCHEMA), budget=300, history=100)
    got = shown.orderBy("conv_id", "window", "position").collect()
    tokens = {(c, t): len(text.split()) + 4 for c, t, _, text, _ in rows}
    fresh = [(r.conv_id, r.position) for r in got if r.fresh]
    assert sorted(fresh) == sorted(tokens)
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.window), []).append(r)
    for (conv, _), parts in by.items():
        assert sum(tokens[conv, r.position] for r in parts) <= 300  # no turn is longer than a cell here
        if conv % 2:
            assert parts[0].position == 0  # the system turn leads every window
        repeated = [r for r in parts if not r.fresh and r.position > 0]
        assert all(r.loss_from == r.loss_to for r in repeated)
        new = [r.position for r in parts if r.fresh]
        assert new == list(range(new[0], new[0] + len(new)))
        assert [r.position for r in repeated] == list(range(new[0] - len(repeated), new[0]))
    # Windows are no smaller than they must be: two neighbours seldom fit into one.
    assert len(by) <= 2 * sum(tokens.values()) / (200 - 64) + 6


def test_long_turns(spark):
    sizes = [("system", 20), ("user", 150), ("assistant", 30), ("user", 170), ("assistant", 25), ("user", 900), ("assistant", 10)]
    rows = [(1, i, role, " ".join(["w"] * (n - 4)), "x") for i, (role, n) in enumerate(sizes)]
    by = {}
    for r in windows(spark.createDataFrame(rows, SCHEMA), budget=300, history=100).collect():
        by.setdefault(r.window, []).append((r.position, r.fresh))
    shown = [sorted(w) for _, w in sorted(by.items())]
    assert sorted(p for w in shown for p, fresh in w if fresh) == list(range(7))
    for w in shown:
        total = sum(sizes[p][1] for p, _ in w)
        assert total <= 300 or (5, True) in w  # the turn of 900 alone exceeds
    prompts = {p: (p - 1, True) in w or (p - 1, False) in w for w in shown for p, fresh in w if fresh and sizes[p][0] == "assistant"}
    assert prompts == {2: True, 4: True, 6: False}  # a prompt of 170 over a history of 100 is shown, one of 900 can't be


def test_odd_turns(spark):
    rows = [(None, None, None, None, "x"), (1, 2, "assistant", "b", "x"), (1, 2, "assistant", "b", "x"), (1, None, "user", "</s>", "x"), (2, 0, "system", "long " * 5000, "x")]
    got = {r.conv_id: r for r in read_back(windows(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].n_turns) == (3, 2, 1, 1)
    assert read_back(windows(spark.createDataFrame([], SCHEMA))).collect() == []
    with pytest.raises(ValueError):
        windows(spark.createDataFrame([], SCHEMA), budget=100, history=50)
