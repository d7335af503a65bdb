"""Main-text extraction against a second, plain computation of the densities, and on rows of every kind."""

import math
import random
import time

from pyspark.sql import functions as F

from kbspark.llm import html_text


def random_page(rnd, depth=0):
    """(tag, children) with texts as children; only elements whose end tags are always written."""
    kinds = ["div", "section", "span", "a", "b"] if depth < 4 else ["span", "b"]
    children = []
    for _ in range(rnd.randrange(1, 5)):
        if rnd.random() < 0.4 or children and isinstance(children[-1], str):  # no two texts in a row: they would be one
            children.append(random_page(rnd, depth + 1) if depth < 6 else ["b", []])
        else:
            children.append("".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(1, 60))))
    return [rnd.choice(kinds), children]


def markup(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"


def facts(node, in_link=False):
    """(characters, those in links, tags inside, link tags inside), from the definition."""
    out = [0, 0, 0, 0]
    in_link = in_link or node[0] == "a"
    for child in node[1]:
        if isinstance(child, str):
            out[0] += len(child.strip())
            out[1] += len(child.strip()) * in_link
        else:
            inner = facts(child, in_link)
            out = [a + b for a, b in zip(out, inner)]
            out[2] += 1
            out[3] += child[0] == "a"
    return out


def plain_density(node, body, in_link):
    c, lc, t, lt = facts(node, in_link)
    if not c:
        return 0.0
    all_c, all_lc, _, _ = facts(body)
    lc, t, lt = max(lc, 1), max(t, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + all_lc / max(all_c, 1) * c + math.e)
    return max(0.0, c / t * (math.log(c / lc * t / lt) / math.log(base)))


def in_order(node, in_link=False):
    yield node, in_link
    for child in node[1]:
        if not isinstance(child, str):
            yield from in_order(child, in_link or node[0] == "a")


def test_densities():
    rnd = random.Random(31)
    for _ in range(150):
        body = ["body", [random_page(rnd) for _ in range(rnd.randrange(1, 4))]]
        tree = html_text._Tree(markup(body))
        density, sums, *_ = html_text._densities(tree, [False] * len(tree.tag))
        nodes = list(in_order(body))
        assert tree.tag[1:] == [n[0] for n, _ in nodes]
        want = [plain_density(n, body, linked) for n, linked in nodes]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(density[1:], want))
        for k, (node, linked) in enumerate(nodes):
            own = sum(plain_density(child, body, linked or node[0] == "a") for child in node[1] if not isinstance(child, str))
            assert math.isclose(sums[k + 1], own, rel_tol=1e-9, abs_tol=1e-9)


def test_densest_subtree_wins_without_names():
    text = lambda n: "words of the article go on and on " * n
    page = f"<body><div><div><p>{text(1)}</p></div><div><p>{text(9)}</p><p>{text(8)}<b>bold</b></p><p>short</p></div><div>{'<a href=x>link to it</a> ' * 9}</div></div></body>"
    got = html_text.main_text(page).split("\n")
    assert [x.split()[-1] for x in got[-3:]] == ["on", "onbold" if got[-2].endswith("onbold") else "bold", "short"]
    assert not any("link" in x for x in got)


def test_time_grows_with_length():
    for part in ("<div class=x>", "<a ", "<b><article><div></i>", "<p>x</span>", "<li><ul>", "<body>"):
        took = []
        for n in (4000, 16000):
            start = time.perf_counter()
            html_text.main_text(part * n + "text")
            took.append(time.perf_counter() - start)
        assert took[1] < 10 * took[0] + 0.2, part


def test_rows(spark):
    page = "<p>one &amp; two</p><p>three</p>"
    rows = [(1, page), (1, page), (None, page), (2, None), (3, ""), (4, "<p>" + "word " * 100_000 + "</p>"), (5, "<script>x")]
    df = spark.createDataFrame([(i, h, "kept", "kept") for i, h in rows], "page_id long, html string, text string, density string")
    got = df.select("page_id", "density", html_text.extract_main_text(F.col("html")).alias("main")).collect()
    want = {1: "one & two\nthree", None: "one & two\nthree", 2: "", 3: "", 4: ("word " * 100_000).strip(), 5: ""}
    assert len(got) == len(rows) and all(r["main"] == want[r["page_id"]] and r["density"] == "kept" for r in got)
    assert df.limit(0).select(html_text.extract_main_text(F.col("html"))).count() == 0


ARTICLE = """<article><h1 id="search">Search</h1><p>{0}</p><h2 id="search-algorithms">Search algorithms</h2><p>{0}</p><h2 id="comments">Comments on method</h2><p>{0}</p>
<section class="related-work"><h3>Related work</h3><p>{0}</p></section><div class="social-history"><p>Social history. {0}</p></div><section id="menu"><p id="menu">The menu had soup.</p></section>
<p class="skip-logic">Skip logic is explained.</p><div class="ad-hoc-queries"><p>Ad hoc queries. {0}</p></div>{1}</article>"""
NOISY = """<div class="ad">Buy now</div><div class="comments-list"><p>First! {0}</p></div><div id="comments"><p>Second! {0}</p></div><div class="cookie-notice">We use cookies</div>
<ul class="related-posts"><li><a href="/a">Another article</a></li><li><a href="/b">And one more</a></li></ul><div class="social"><a href="/s">Share it</a></div><div class="newsletter-signup"><form><input name="m">Your mail</form></div>"""


def test_names_do_not_take_the_articles_own_text():
    words = "This is a sentence of the article that goes on for some time, and then ends. " * 4
    for around in ("<body>{}</body>", "<body><nav><a href='/'>Home</a></nav><main>{}</main><footer>Foot</footer></body>", "<body><div id='content'>{}</div></body>"):
        page = around.format(ARTICLE.format(words, NOISY.format(words)))
        for wrapped in (page, page.replace("article>", "div>")):
            # a section named menu is one, unless it is inside an article
            own = ["The menu had soup."] * ("<article>" in wrapped or "<main>" in wrapped)
            got = html_text.main_text(f"<html>{wrapped}</html>")
            for kept in ["Search", "Search algorithms", "Comments on method", "Related work", "Social history.", "Skip logic is explained.", "Ad hoc queries."] + own:
                assert any(line.startswith(kept) for line in got.split("\n")), kept
            for gone in ("Buy now", "First!", "Second!", "cookies", "Another article", "Share it", "Your mail", "Home", "Foot"):
                assert gone not in got, gone
