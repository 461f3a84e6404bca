"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one tree whose nodes are places (paths of tags with ids and
classes). A text node is important if its texts differ from page to page: one minus the mean entropy of its distinct
texts over the pages, to the base of the number of pages. An element is important if it is laid out in
several ways or if its children are important (weights 1 - g^l and g^l for l layouts). A branch without any
important node is noise and leaves every page of the host. Places that a host shows on few pages lean
on the tree of all hosts. What markup itself declares goes first: surroundings (nav, footer, aside, forms,
adverts, comments) have no presentation importance, and bare running text of an article is never noise.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import small, stash, without
from ledgerlark.llm.page_blocks import ARTICLE, CHROME, blocks

#: Branches below this importance are noise.
NOISE = 0.75
#: So many pages of the tree of all hosts stand beside a host's own pages of a place.
LEAN = 50
#: Weight of an element's children against its own layouts.
CHILDREN = 0.9
DEPTH = 12

_BLOCKS = "array<struct<place:string,kind:int,text:string>>"
_KINDS = "struct<host:string,seen:bigint,blocks:{b},texts:array<struct<place:string,feature:bigint,times:int>>,layouts:array<struct<place:string,style:string,times:int>>>".format(b=_BLOCKS)


def host_of(url: str | None) -> str:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    if not url or "://" not in url:
        return ""
    rest = url.split("://", 1)[1]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def read_page(url: str | None, page: str | None, depth: int = DEPTH) -> dict:
    """Blocks of a page and what it adds to its host's tree. In texts the host's own name counts as a blank sign."""
    host = host_of(url)
    found, styles = blocks(page, depth)
    texts = Counter((place, _hash(text.replace(host, "\0") if host else text)) for place, _, text in found)
    own = "\0".join(text for _, kind, text in found if kind != CHROME)
    return {
        "host": host,
        "seen": _hash(own),  # pages with the same text are one page of the tree
        "blocks": [{"place": p, "kind": k, "text": t} for p, k, t in found],
        "texts": [{"place": p, "feature": f, "times": n} for (p, f), n in texts.items()],
        "layouts": [{"place": p, "style": s, "times": n} for (p, s), n in Counter(styles).items()],
    }


def read_pages(url: Column, page: Column, depth: int = DEPTH) -> Column:
    @F.arrow_udf(_KINDS)
    def of(urls: pa.Array, pages: pa.Array) -> pa.Array:
        rows = [read_page(u.as_py(), p.as_py(), depth) for u, p in zip(urls, pages)]
        one = lambda fields: pa.list_(pa.struct(fields))
        kinds = [
            ("host", pa.string()), ("seen", pa.int64()),
            ("blocks", one([("place", pa.string()), ("kind", pa.int32()), ("text", pa.string())])),
            ("texts", one([("place", pa.string()), ("feature", pa.int64()), ("times", pa.int32())])),
            ("layouts", one([("place", pa.string()), ("style", pa.string()), ("times", pa.int32())])),
        ]
        return pa.array(rows, pa.struct(kinds))

    return of(url, page)


def parsed(pages: DataFrame, url: str = "url", page: str = "html", depth: int = DEPTH) -> DataFrame:
    """All columns but the page, with ``__host``, ``__seen``, ``__blocks``, ``__texts`` and ``__layouts``, written once."""
    found = pages.withColumn("__p", read_pages(F.col(url), F.col(page), depth)).drop(page)
    rest = [c for c in found.columns if c != "__p"]
    return stash(found.select(*rest, *[F.col(f"__p.{f}").alias(f"__{f}") for f in ("host", "seen", "blocks", "texts", "layouts")]), "page-blocks")


def _log(c: Column) -> Column:
    return F.log(c.cast("double"))


def text_importance(read: DataFrame, lean: float = LEAN) -> DataFrame:
    """(host, place, pages, importance) of every text node of every host's tree.

    A host's pages with the same text count once. With m pages of the host and M of all hosts the importance is the mean
    of the host's own and that of all hosts with the weights m and ``lean`` (at most M).
    """
    each = read.select("__host", "__seen", F.explode("__texts").alias("t")).select("__host", "__seen", "t.*")
    once = each.groupBy("__host", "place", "feature", "__seen").agg(F.max("times").alias("t"))
    own = stash(
        once.groupBy("__host", "place", "feature").agg(F.sum("t").alias("n"), F.sum(F.col("t") * _log(F.col("t"))).alias("s")), "tree-texts"
    )
    pages = once.groupBy("__host", "place", "__seen").agg(F.lit(1).alias("one")).groupBy("__host", "place").agg(F.count("one").alias("m"))
    spread = F.sum(_log(F.col("n")) - F.col("s") / F.col("n")) / F.count(F.lit(1))  # mean entropy, natural logarithm
    nodes = own.groupBy("__host", "place").agg(spread.alias("h")).join(pages, ["__host", "place"])
    worth = lambda h, m: F.when(F.col(m) > 1, 1 - F.col(h) / _log(F.col(m))).otherwise(1.0)
    merged = own.groupBy("place", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    world = merged.groupBy("place").agg(spread.alias("hw")).join(pages.groupBy("place").agg(F.sum("m").alias("mw")), "place")
    by = F.least(F.lit(float(lean)), F.col("mw").cast("double"))
    both = (F.col("m") * worth("h", "m") + by * worth("hw", "mw")) / (F.col("m") + by)
    return nodes.join(world, "place").select(F.col("__host").alias("host"), "place", F.col("m").alias("pages"), both.alias("importance"))


def style_tree(read: DataFrame, noise: float = NOISE, lean: float = LEAN, children: float = CHILDREN) -> DataFrame:
    """(host, place, pages, importance, noisy) of all nodes of all hosts' trees, elements and texts (``.../#``).

    An element's importance is (1 - g^l) times the entropy of its l layouts (to the base of its pages) and g^l times the
    mean importance of its children over the layouts. ``noisy``: neither it nor any node below reaches ``noise``.
    Levels are joined from the deepest up; there are at most ``DEPTH`` of them.
    """
    layouts = read.select("__host", "__seen", F.explode("__layouts").alias("l")).select("__host", "__seen", "l.*")
    once = layouts.groupBy("__host", "place", "style", "__seen").agg(F.max("times").alias("t"))
    styles = stash(once.groupBy("__host", "place", "style").agg(F.sum("t").alias("n"), F.count(F.lit(1)).alias("m")), "tree-styles")
    spread = _log(F.sum("n")) - F.sum(F.col("n") * _log(F.col("n"))) / F.sum("n")
    own = F.when(F.sum("m") > 1, spread / _log(F.greatest(F.sum("m"), F.lit(2)))).otherwise(1.0)
    elements = styles.groupBy("__host", "place").agg(F.count(F.lit(1)).alias("l"), F.sum("m").alias("pages"), own.alias("own"))
    below = styles.select("__host", "place", "n", F.split("style", "\n").alias("c")).select(
        "__host", "place", (F.col("n") / F.size("c")).alias("w"), F.explode("c").alias("child")
    )
    edges = below.groupBy("__host", "place", F.concat_ws("/", "place", "child").alias("node")).agg(F.sum("w").alias("w"))
    edges = stash(edges.withColumn("level", F.size(F.split("place", "/"))), "tree-edges")
    elements = stash(elements.withColumn("level", F.size(F.split("place", "/"))), "tree-elements")
    texts = text_importance(read, lean).withColumn("best", F.col("importance"))
    done = stash(texts.select(F.col("host").alias("__host"), "place", "pages", "importance", "best"), "tree-nodes")
    deepest = elements.agg(F.max("level")).first()[0] or 0
    for level in range(deepest, 0, -1):
        below = done.select("__host", F.col("place").alias("node"), "importance", "best")
        mean = edges.filter(F.col("level") == level).join(below, ["__host", "node"]).groupBy("__host", "place").agg(
            (F.sum(F.col("w") * F.col("importance")) / F.sum("w")).alias("of"), F.max("best").alias("best")
        )
        g = F.pow(F.lit(float(children)), F.col("l"))
        value = (1 - g) * F.col("own") + g * F.col("of")
        up = elements.filter(F.col("level") == level).join(mean, ["__host", "place"]).select(
            "__host", "place", "pages", value.alias("importance"), F.greatest("best", value).alias("best")
        )
        done = done.union(stash(up, "tree-level"))
    return done.select(F.col("__host").alias("host"), "place", "pages", "importance", (F.col("best") < noise).alias("noisy"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", noise: float = NOISE, lean: float = LEAN, children: float = CHILDREN) -> DataFrame:
    """All columns but the page, with ``text`` (blocks joined by an empty line), ``n_chars``, and the number of blocks
    that the style tree (``n_noise``) or only the markup (``n_declared``) removed.

    Null and empty pages, and pages without text, have an empty text. Null urls and urls without :// share the
    empty host. Repeated rows each return their row and count once in the tree. Very long texts are kept whole. An
    empty table returns no rows. Input columns named like an output column are replaced.
    """
    read = parsed(without(pages, "text", "n_chars", "n_noise", "n_declared"), url, page)
    tree = style_tree(read, noise, lean, children)
    texts = tree.filter("noisy").filter(F.col("place").endswith("/#"))
    noisy = stash(texts.groupBy(F.col("host").alias("__host")).agg(F.collect_set("place").alias("__noisy")), "noisy-places")
    marked = read.join(small(noisy, noisy.count(), 20_000), "__host", "left")
    gone = lambda b: F.coalesce(F.array_contains(F.col("__noisy"), b["place"]), F.lit(False)) & (b["kind"] != ARTICLE)
    kept = F.filter("__blocks", lambda b: ~gone(b) & (b["kind"] != CHROME))
    out = marked.withColumns({
        "text": F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n"),
        "n_noise": F.size(F.filter("__blocks", gone)),
        "n_declared": F.size(F.filter("__blocks", lambda b: ~gone(b) & (b["kind"] == CHROME))),
    }).withColumn("n_chars", F.length("text").cast("long"))
    return out.drop("__host", "__seen", "__blocks", "__texts", "__layouts", "__noisy")
