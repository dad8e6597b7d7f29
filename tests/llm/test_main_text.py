"""Main text of pages: pages by hand, and held-out pages that do not name their article."""

import os
import re

import pytest
from conftest import SMALL

from arcloom.llm import main_text

SCHEMA = "page_id long, url string, html string, text string, key string, n_chars string"


def table(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in pages], SCHEMA)


BY_HAND = [
    (None, ""),
    ("", ""),
    ("plain  words\n only", "plain words only"),
    ("<p>one<p>two &amp; three &lt;b&gt; &#233;&nbsp;&copy; &unknown; &amp", "one\ntwo & three <b> é © &unknown; &"),
    ("<article><h1>Title</h1><p>a<b>b</b> c<br>d</p>tail</article><footer>foot foot foot foot</footer>", "Title\nab c d\ntail"),
    ("<nav><ul><li>menu<li>more</ul></nav><article><p>text of it</p><aside>side note</aside><div class='ad x'>buy</div><p>rest</p></article>", "text of it\nrest"),
    ("<article><p>before <script>var t='</p><p>no';</script>after<style>p{}</style></p></article>", "before after"),
    ("<article><p>said</p><section class='comments'><article><p>first!</p></article></section></article><div class=comment><p>second</p></div>", "said"),
    ("<body class='has-sidebar'><header>Site</header><main><header><h1>Own title</h1></header><p>body text</p><form><input>Name<button>Go</button></form></main>", "Own title\nbody text"),
    ("<!-- <article>no</article> --><article><p>yes<!-- no --></article", "yes"),
    ('<article><p title="a > b">quoted</p><p title="open>still</p></article>', "quoted\nstill"),
    ("<div class='cookie-notice'>we use cookies</div><article><ul><li>one</li><li>two <a href=x>link</a></li></ul></article><p>outside the article</p>", "one\ntwo link"),
    ("<article></article><p>only outside</p>", ""),
    ("<nav>only a menu</nav>", ""),
    ("<article>" + "<p>long text " * 20000 + "</article>", "\n".join(["long text"] * 20000)),
]


def test_pages_by_hand(spark):
    """Without weights: defaults and the pages' own elements."""
    for page, text in BY_HAND:
        assert main_text.main_text(page, {}) == text, page
    pages = [(i if i else None, None if i == 2 else f"http://h/{i}", h) for i, (h, _) in enumerate(BY_HAND)] + [(1, "http://h/1", BY_HAND[4][0])]
    got = main_text.extract(table(spark, pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i if i else None, None if i == 2 else f"http://h/{i}", t, len(t)) for i, (_, t) in enumerate(BY_HAND)] + [(1, "http://h/1", BY_HAND[4][1], len(BY_HAND[4][1]))]
    key = lambda r: (r[0] or 0, r[1] or "", r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert main_text.extract(table(spark, [])).count() == 0


def test_best_region_is_the_best_of_all(monkeypatch):
    """The scan against all contiguous runs."""
    import random

    rng = random.Random(4)
    weights = {">p": 0.8, ">div": -0.6, "<p": -0.1, "</p": -0.1, "<div": -0.9, "</div": -0.9}
    for _ in range(200):
        parts = [(rng.choice(["p", "div"]), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 9))]
        page = "".join(f"<{t}>" + " ".join(f"w{k}x{i}" for i in range(n)) + f"</{t}>" for k, (t, n) in enumerate(parts))
        value = [(weights[">" + t] * n, weights["<" + t] + weights["</" + t]) for t, n in parts]
        best, want = 0, ""
        for lo in range(len(parts)):
            for hi in range(lo, len(parts)):
                total = sum(v[0] for v in value[lo : hi + 1]) + sum((weights["</" + parts[i][0]] + weights["<" + parts[i + 1][0]]) for i in range(lo, hi))
                if total > best + 1e-9:
                    best, want = total, "\n".join(" ".join(f"w{k}x{i}" for i in range(parts[k][1])) for k in range(lo, hi + 1))
        assert main_text.main_text(page, weights) == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_weights_find_articles_that_are_not_named(spark):
    """Weights of one half of the pages, applied to the other half without their article's tags, adverts' classes and
    footers' names: the text must still be the article's."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id").collect()
    weights = main_text.learn(spark.createDataFrame(pages[::2], "page_id long, url string, html string"))
    assert weights[">p"] > 0.5 > -0.5 > weights[">li@"] and all(w < 0 for k, w in weights.items() if k.startswith("<"))
    right = 0
    for page in pages[1::2]:
        bare = re.sub("</?article>", "", page.html)
        bare = re.sub("<(/?)nav>", r"<\1div>", bare)
        right += main_text.main_text(bare, weights) == main_text.main_text(page.html, weights) != ""
    assert right == len(pages[1::2])
