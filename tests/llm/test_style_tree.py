"""Main text of pages: the given pages against a plain cut, what the tree alone removes, odd pages."""

import html
import math
import re
from collections import Counter

import pytest

from ledgerlark.llm import style_tree
from ledgerlark.llm.common import table
from ledgerlark.llm.page_blocks import ARTICLE, CHROME, OPEN, blocks
from ledgerlark.llm.queries import op13_site_style_tree


def plain_text(page):
    """Pages of the given tables: heading and paragraphs of the only article."""
    page = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", page or "")
    article = re.search(r"(?s)<article>(.*?)(</article>|\Z)", page)
    parts = re.split(r"</?(?:h1|p)>", article[1] if article else "")
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_over_all_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").collect()
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in op13_site_style_tree(spark, sf_dir).collect())
    assert got == sorted((r.page_id, r.url, t := plain_text(r.html), len(t)) for r in pages)


def test_tree_alone_removes_what_a_host_repeats(spark):
    """Nothing in this markup tells surroundings from content; a lone copy of the layout on another host leans on all hosts."""
    def page(i, k):
        side = f"<div class=x><div>Follow us {i % 3}</div><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>"
        return f"{side}<div class=y><div>Title {i}</div><div>Text number {i} of {k} is its own.</div><div>More {i * 7} words</div></div>"

    rows = [(i, "http://a.org/" + str(i), page(i, "a")) for i in range(60)] + [(100, "http://b.org/1", page(100, "b"))]
    rows += rows[:5] + [(200, None, None), (201, "nohost", "")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id int, url string, html string, TEXT string, extra int")
    got = {r.page_id: r for r in style_tree.extract(df).collect()}
    for i in [*range(60), 100]:
        assert got[i].text == f"Title {i}\n\nText number {i} of {'a' if i < 60 else 'b'} is its own.\n\nMore {i * 7} words"
        assert (got[i].n_noise, got[i].n_declared) == (3, 0)
    assert (got[200].text, got[200].n_chars, got[201].text) == ("", 0, "")
    assert style_tree.extract(df).count() == len(rows) and "extra" in style_tree.extract(df).columns


def test_importance_against_plain_entropies(spark):
    pages = [f"<div>same</div><p>one {i // 4}</p><p>two {i}</p>" for i in range(12)]
    df = spark.createDataFrame([(i, "http://h/" + str(i), p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    tree = {r.place: r for r in style_tree.style_tree(style_tree.parsed(df)).collect()}
    texts = {"body/div/#": [["same"]] * 12, "body/p/#": [[f"one {i // 4}", f"two {i}"] for i in range(12)]}
    worth = {}
    for place, each in texts.items():
        of = {}
        for j, words in enumerate(each):
            for w, n in Counter(words).items():
                of.setdefault(w, {})[j] = n
        entropy = [-sum(n / sum(c.values()) * math.log(n / sum(c.values()), 12) for n in c.values()) for c in of.values()]
        worth[place] = 1 - sum(entropy) / len(entropy)
        assert math.isclose(tree[place].importance, worth[place], abs_tol=1e-9)
    assert tree["body/div"].noisy and not tree["body/p"].noisy and not tree["body"].noisy
    assert math.isclose(tree["body"].importance, 0.9 * (0.9 * worth["body/div/#"] + 0.9 * worth["body/p/#"]) / 2, abs_tol=1e-9)


def test_copies_of_one_article_stay(spark):
    same = "<nav>menu</nav><article><h1>T</h1><p>all alike</p></article>"
    bare = "<div>all alike</div><div>second</div>"
    rows = [(i, "http://c.org/" + str(i), same) for i in range(40)] + [(50 + i, "http://d.org/" + str(i), bare) for i in range(40)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(got[i] == "T\n\nall alike" and got[50 + i] == "all alike\n\nsecond" for i in range(40))


def kinds(page):
    return [(kind, text) for _, kind, text in blocks(page)[0]]


def test_markup_of_surroundings():
    page = """<!DOCTYPE html><html><head><title>no</title><script>var x = "<p>no</p>";</script></head><body class="has-sidebar">
    <header>Site</header><div class="cookie-notice">Cookies</div><main><article><header><h1>A &lt;b&gt;</h1></header>
    <p>One<br>two&nbsp;<b>three <p>four <span class="ad">buy</span> five</p><!-- <p>no --><ul><li>x<li>y</ul>
    <aside>Side</aside><form>Name <input></form></article></main><section id=comments><article class=comment><p>First!</p></article></section>
    <div class="page sidebar-left"><article><p>kept</p></article></div><div hidden>no</div><footer>(c)</footer>"""
    shown = [t for k, t in kinds(page) if k != CHROME]
    assert shown == ["A <b>", "One two three", "four", "five", "x", "y", "kept"]
    assert {t for k, t in kinds(page) if k == CHROME} >= {"Site", "Cookies", "buy", "Side", "First!", "(c)"}
    assert ("no" not in {t for _, t in kinds(page) if t != "no"})


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p>a</p", "a<!-- b", "<script>x", "<div class='", "</p></div>", "<p title=\"a>b\">c", "&amp;&#0;&bogus;", "<" * 999, "<b>" * 999 + "z", "<div>" * 3000 + "deep"])
def test_broken_pages_do_not_fail(page):
    found, styles = blocks(page)
    assert all(place.count("/") <= 12 for place, _, _ in found)
    if page and page.startswith("<div>"):
        assert [t for _, _, t in found] == ["deep"]


def test_kinds_of_plain_blocks():
    assert kinds("<article><p>a</p><div class=z>b</div></article><p>c") == [(ARTICLE, "a"), (OPEN, "b"), (OPEN, "c")]


def test_long_page_and_empty_table(spark):
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://x/", long)], "page_id int, url string, html string")
    assert style_tree.extract(df).first().text == "\n\n".join(f"word {i}" for i in range(30_000))
    assert style_tree.extract(df.limit(0)).collect() == []
