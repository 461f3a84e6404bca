"""Chat formatting in budgeted windows.

A conversation becomes one or more training windows. Prefix sums of turn tokens place each turn in a cell of the
budget; cells and the turns that cross their ends make turn-aligned windows that leave room for the system turn and
a limited stretch of the turns just before, both repeated. The loss mask covers assistant texts in the window that they are new in, so every target is trained once.

Template: ``<s>[INST]role[/INST]text</s>`` per turn. A backslash is inserted after the first character of every
control string inside a role or text, and backslashes are doubled; so control strings in data are
never marks and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import stash, words

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, ROLE_OPEN, ROLE_CLOSE, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_STEP = 256  # turns per prefix-sum bucket


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def windows(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = 512,
    history: int = 128,
    tokens: Column | None = None,
) -> DataFrame:
    """One row per turn and window that shows it, in reading order by (conv, window, position):
    ``formatted``, ``loss_from`` and ``loss_to`` (code point offsets of the target in it, equal without one),
    ``fresh`` (false for repeated turns).

    A conversation has cells of budget - history - (tokens of its system turn). A turn that lies in one cell is new in that
    cell's window. One that crosses the end of a cell joins the window before if it fits there, else the one behind
    if it fits there, else it is a window of its own. The system turn (the first, if its role is system) leads every
    window. Repeated are the turns of the window before that start within ``history`` tokens of the new ones, and in any case
    the last of them if the first new turn is an assistant's and the budget has room. So new, repeated and system turns keep to
    the budget together. Turns are never cut: only a turn that is longer than a cell exceeds it, with what leads it.
    Tokens default to words plus 4 for the marks. Null roles and texts are empty; the order is turn (null first), role, text;
    null conversations are one conversation; repeated rows are turns of their own. No rows, no windows.
    """
    if not 0 <= history < budget - history:
        raise ValueError("history must be smaller than half the budget")
    clean = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (tokens if tokens is not None else F.size(words(F.col(text))) + 4).cast("long").alias("__t"),
    ).withColumn("__bucket", F.coalesce(F.floor(F.col("turn") / _STEP), F.lit(-(1 << 62))))
    order = ["turn", "role", "text"]
    inside = Window.partitionBy("conv_id", "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rank = Window.partitionBy("conv_id", "__bucket").orderBy(*order)
    totals = clean.groupBy("conv_id", "__bucket").agg(
        F.sum("__t").alias("__bt"), F.count(F.lit(1)).alias("__bn"), F.min(F.struct(*order, "__t")).alias("__first")
    )
    earlier = Window.partitionBy("conv_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("conv_id").alias("__c"), F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__bt").over(earlier), F.lit(0)).alias("__t0"),
        F.coalesce(F.sum("__bn").over(earlier), F.lit(0)).alias("__n0"),
        F.first("__first").over(earlier.rowsBetween(Window.unboundedPreceding, 0)).alias("__first"),
    ).withColumn("__lead", F.when(F.col("__first.role") == "system", F.col("__first.__t")).otherwise(0)).drop("__first")
    placed = (
        clean.withColumns({
            "__before": F.coalesce(F.sum("__t").over(inside), F.lit(0)),
            "__rank": F.row_number().over(rank) - 1,
        })
        .join(starts, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__bucket") == F.col("__b")))
        .withColumns({"__at": F.col("__t0") + F.col("__before"), "position": F.col("__n0") + F.col("__rank")})
    )
    system = (F.col("position") == 0) & (F.col("role") == "system")
    # The system turn takes no place of the cells, it leads every window.
    laid = placed.withColumns({
        "__system": system,
        "__at": F.when(system, 0).otherwise(F.col("__at") - F.col("__lead")),
        "__t": F.when(system, 0).otherwise(F.col("__t")),
        "__step": F.greatest(F.lit(1), budget - history - F.col("__lead")),
    })
    cell = F.floor(F.col("__at") / F.col("__step"))
    crosses = F.col("__at") + F.col("__t") > (cell + 1) * F.col("__step")
    shown = ["conv_id", "position", "role", "text", "__at", "__t", "__lead", "__step", "__system", "__cell", "__crosses"]
    rows = stash(laid.withColumns({"__cell": cell, "__crosses": crosses}).select(shown), "turns")
    return _show(_own(rows), budget, history)


def _own(rows: DataFrame) -> DataFrame:
    """The window ``__own`` in which each turn is new: twice the cell, odd for a crossing turn that stands alone."""
    tokens = lambda these: F.coalesce(F.sum(F.when(these, F.col("__t"))), F.lit(0))
    cells = rows.groupBy("conv_id", "__cell").agg(
        F.first("__step").alias("__step"), tokens(~F.col("__crosses")).alias("__in"), tokens(F.col("__crosses")).alias("__out"),
        F.count_if(~F.col("__crosses") & ~F.col("__system")).alias("__n"),
    )
    back = (F.col("__n") == 0) | (F.col("__in") + F.col("__out") <= F.col("__step"))
    sums = cells.withColumn("__back", back).withColumn("__all", F.col("__in") + F.when(F.col("__back"), F.col("__out")).otherwise(0))
    following = Window.partitionBy("conv_id").orderBy("__cell")
    ahead = F.col("__out") + F.lead("__all").over(following) <= F.col("__step")
    target = F.when(F.col("__back"), 2 * F.col("__cell")).when(ahead, 2 * F.lead("__cell").over(following)).otherwise(2 * F.col("__cell") + 1)
    targets = sums.select(F.col("conv_id").alias("__c"), F.col("__cell").alias("__k"), target.alias("__to"))
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__cell") == F.col("__k"))
    own = F.when(F.col("__crosses"), F.col("__to")).otherwise(2 * F.col("__cell"))
    return rows.join(targets, same).withColumn("__own", own).drop("__c", "__k", "__to")


def _show(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """Explode every turn into the windows that show it; only windows with a new turn exist."""
    used = placed.groupBy("conv_id", "__own").agg(
        F.min("__at").alias("__from"), F.sum("__t").alias("__new"), F.min(F.struct("position", "role")).alias("__head")
    )
    fresh = placed.withColumns({"window": F.col("__own"), "fresh": F.lit(True)})
    # Repeated in the next window that exists, as far as its history reaches.
    following = Window.partitionBy("conv_id").orderBy("__own")
    links = used.select(
        F.col("conv_id").alias("__lc"), F.col("__own").alias("__lo"),
        *[F.lead(c).over(following).alias(f"__next{c}") for c in ("__own", "__from", "__new", "__head")],
    )
    same = F.col("conv_id").eqNullSafe(F.col("__lc")) & (F.col("__own") == F.col("__lo"))
    prompt = (
        (F.col("__next__head.role") == "assistant") & (F.col("position") + 1 == F.col("__next__head.position"))
        & (F.col("__t") + F.col("__next__new") + F.col("__lead") <= budget)
    )
    near = (F.col("__at") >= F.col("__next__from") - history) | prompt
    repeated = placed.join(links, same).filter(~F.col("__system") & near).withColumns(
        {"window": F.col("__next__own"), "fresh": F.lit(False)}
    )
    system = placed.filter("__system")
    later = used.select(F.col("conv_id").alias("__lc"), F.col("__own").alias("window"))
    retained = system.join(
        later, F.col("conv_id").eqNullSafe(F.col("__lc")) & (F.col("window") > F.col("__own"))
    ).withColumn("fresh", F.lit(False)).drop("__lc")
    columns = ["conv_id", "window", "position", "fresh", "role", "text"]
    shown = fresh.select(columns).union(repeated.select(columns)).union(retained.select(columns))
    head = F.concat(F.lit(OPEN + ROLE_OPEN), escape(F.col("role")), F.lit(ROLE_CLOSE))
    body = escape(F.col("text"))
    target = F.col("fresh") & (F.col("role") == "assistant")
    return shown.select(
        "conv_id", "window", "position", "fresh",
        F.concat(head, body, F.lit(CLOSE)).alias("formatted"),
        F.length(head).alias("loss_from"),
        (F.length(head) + F.when(target, F.length(body)).otherwise(0)).alias("loss_to"),
    )


def read_back(shown: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted text alone: ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256``, ``formatted_chars`` and ``n_windows``.

    Conversation ids are read as whole numbers. The rows of a conversation are read in order as a stream; a digest is the only state that is kept, so a
    conversation may be of any length.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    columns = ["conv_id", "window", "fresh", "formatted", "loss_from", "loss_to"]
    dealt = shown.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id"), "window", "position", "fresh"
    )
    return dealt.select(columns).mapInArrow(_digest, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = object(), None, []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def close() -> None:
        conv, n, turns, chars, loss, length, count, _ = state
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length, count))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        done.clear()
        return batch

    for batch in batches:
        for row in zip(*batch.columns):
            conv, window, fresh, shown, start, stop = (v.as_py() for v in row)
            if state is None or conv != now:
                if state is not None:
                    close()
                now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, None]
            state[5] += len(shown)
            if window != state[7]:
                state[6], state[7] = state[6] + 1, window
            mark = shown.index(ROLE_CLOSE)
            if fresh:
                role = unescape(shown[len(OPEN + ROLE_OPEN) : mark])
                text = unescape(shown[mark + len(ROLE_CLOSE) : shown.index(CLOSE, mark)])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            if stop > start:
                target = unescape(shown[start:stop])
                state[3] += len(target)
                state[4].update(target.encode())
        if len(done) > 1000:
            yield flush()
    if state is not None:
        close()
    yield flush()
