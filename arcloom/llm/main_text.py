"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by how often words of their
context lie in the articles of labelled pages, tags always count against; the
contiguous run with the greatest sum, found by one scan, is the main text's
region.  Labelled pages are those that name their article themselves (an
``article`` or ``main`` element): the weights are learned with that element
hidden, and so carry over to pages without one.

What can be no part of an article wherever it stands (scripts, menus,
adverts, comments ...) is cut out before the scan, so that it neither ends a region
nor enters it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import small, trimmed

#: pages that weights are learned from, and pages on which a context must be seen
SAMPLE, LEAST_PAGES = 2000, 3
#: contexts kept: those seen on most pages
MOST_CONTEXTS = 10_000
#: score of a word in an article, or of a context never seen; a tag costs this at least
WORD, TAG = 0.5, 0.05
#: what a tag costs within an article that the page names
LEAST = 1e-9

# fixed values of HTML
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td template textarea tfoot th "
    "thead title tr ul".split()
)
CLOSED_BY_BLOCK = BLOCK - set("body html head option optgroup".split())
#: a start tag ends an open element of these names, up to the element that holds the list
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}

# fixed values: what is no part of an article
OTHER = set(
    "head title script style noscript template nav header footer aside form button select option textarea input label fieldset dialog menu iframe noembed "
    "noframes xmp svg canvas object embed audio video search".split()
)
OTHER_CLASS = set(
    "ad ads advert adverts advertisement advertising advertorial banner bottombar breadcrumb breadcrumbs captcha comment comments commentlist consent cookie "
    "cookies copyright disqus discussion footer gdpr header hidden infobar login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar topbar tracking".split()
)
#: class words beside which the above say nothing: "has-sidebar"; and "header", beside the second
NOT_OTHER, OWN_HEADER = set("has with no without".split()), set("article content entry post story".split())
OTHER_ROLE = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ARTICLE = ("article", "main")

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?>(?:[^>"']|"[^"]*"|'[^']*')*))(?:>|\Z)|<(?P<end_>/?)(?P<name_>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[A-Za-z]+")


class Element:
    """An open element: name, its part of a context, whether it is cut out, and whether it holds the article."""

    __slots__ = ("article", "name", "named", "other", "words")

    def __init__(self, name: str, more: str, above: Element | None):
        named, roles = [], set()
        if more:
            for kind, *values in NAMED.findall(more):
                words = [w.lower() for w in WORDS.findall("".join(values))]
                if kind.lower() == "role":
                    roles.update(words)
                else:
                    named += words
        whole, within = name in ("html", "body"), above is not None and above.article
        said = OTHER_CLASS.intersection(named) if NOT_OTHER.isdisjoint(named) else set()
        if said == {"header"} and not OWN_HEADER.isdisjoint(named):
            said = set()
        mine = name in OTHER and not (name == "header" and within)  # an article's own header holds its title
        mine = mine or not OTHER_ROLE.isdisjoint(roles) or (bool(more) and not whole and bool(HIDDEN.search(more)))
        # an article says that it is a comment or the like only within another, or by that word alone
        mine = mine or (bool(said) and not whole and (name not in ARTICLE or within or len(named) == 1))
        self.name, self.named = name, named
        self.other = mine or (above is not None and above.other and name != "main")
        self.article = within or (not self.other and name in ARTICLE)
        self.words = ""


def pieces(page: str) -> Iterator[tuple[str, str, Element | None, str]]:
    """('tag', name with its slash, element, '') and ('text', raw text, innermost element, context) in page order.

    A context is the nearest enclosing element that says what it is (by a sectioning tag, or by
    class or id), the block the text is in, and whether it is linked; articles do not show.
    """
    stack: list[Element] = []
    at, n = 0, len(page)

    def context() -> str:
        if not stack:
            return ">"
        if not stack[-1].words:
            block, marked, linked = "", "", ""
            for e in reversed(stack):
                if e.name == "a":
                    linked = "@"
                if not block and e.name in BLOCK and e.name not in ARTICLE:
                    block = e.name
                if e.name not in ARTICLE and (e.named or e.name in OTHER or e.name == "section"):
                    marked = ".".join([e.name, *e.named[:3]])
                    break
            stack[-1].words = f"{marked}>{block}{linked}"
        return stack[-1].words

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], stack[-1] if stack else None, context()
            return
        if m.start() > at:
            yield "text", page[at : m.start()], stack[-1] if stack else None, context()
        at = m.end()
        name = m["name"] or m["name_"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end_"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k : None if name in BLOCK else k + 1]
                    break
            yield "tag", "/" + name, stack[-1] if stack else None, ""
            continue
        if name in CLOSED_BY_BLOCK:
            _close(stack, {"p"}, {"table", "button"})
        if name in SIBLINGS:
            _close(stack, *SIBLINGS[name])
        element = Element(name, m["more"], stack[-1] if stack else None)
        yield "tag", name, element, ""
        if name in VOID:
            continue
        if name in RAW or name in ("title", "textarea"):
            shut = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else n
            yield "tag", "/" + name, element, ""
            continue
        stack.append(element)


def _close(stack: list[Element], names: set[str], within: set[str]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].name in names:
            del stack[k:]
            return
        if stack[k].name in within:
            return


def observe(page: str) -> tuple[Counter, Counter]:
    """Words and tags by context, inside and outside the article of a page that has one."""
    inside, outside = Counter(), Counter()
    article = False
    for kind, value, element, context in pieces(page):
        held = inside if element is not None and element.article and not element.other else outside
        article = article or held is inside
        if kind == "text":
            words = len(value.split())
            if words:
                held[context] += words
                held[context[context.index(">") :]] += words
        elif value.lstrip("/") not in ARTICLE:
            held["<" + value] += 1
    return (inside, outside) if article else (Counter(), Counter())


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights of contexts and tags, from at most about SAMPLE pages drawn by hash among all pages.

    A word's weight is between -1 and 1, twice its share inside articles less one; a tag's is
    negative, less so the more it stands in articles.  Contexts seen on fewer than LEAST_PAGES pages
    are left out, so the table is bounded by what the sample holds and by MOST_CONTEXTS.
    """
    n = pages.count()
    if not n:
        return {}
    drawn = pages.filter(F.col("html").isNotNull())
    if n > SAMPLE:
        drawn = drawn.filter(F.pmod(F.xxhash64(F.lit(7), "page_id", "url"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    drawn = drawn.select("html")

    def run(batches):
        for b in small(batches, 100):
            rows: dict[str, list[int]] = {}
            for page in b.column(0).to_pylist():
                inside, outside = observe(page)
                for key in inside.keys() | outside.keys():
                    row = rows.setdefault(key, [0, 0, 0])
                    row[0] += inside[key]
                    row[1] += outside[key]
                    row[2] += 1
            columns = list(zip(*rows.values(), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["key", "inside", "outside", "pages"])

    seen = drawn.mapInArrow(run, "key string, inside long, outside long, pages long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "pages")])
    weights = {}
    for r in seen.filter(F.col("pages") >= LEAST_PAGES).orderBy(F.desc("pages"), "key").limit(MOST_CONTEXTS).collect():
        share = (r.inside + 1) / (r.inside + r.outside + 2)
        weights[r.key] = -TAG - (1 - share) if r.key.startswith("<") else 2 * share - 1
    return weights


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, one a line."""
    found, holds = [], False
    for kind, value, element, context in pieces(page or ""):
        inside = element is not None and element.article
        holds = holds or inside
        if element is None or not element.other:
            found.append((kind, value, inside, context))
        elif kind == "tag" and value.lstrip("/") in BLOCK:
            found.append((kind, "/", inside, context))  # what is cut out ends the block that it stands in

    blocks: list[list[str]] = []
    scores: list[tuple[float, int]] = []  # of each piece, and the block that it is in
    text: list[str] = []
    for kind, value, inside, context in found:
        if kind == "tag":
            if value == "br":
                text.append(" ")
                continue
            if holds:  # a page that names its article: its tags keep none of its words apart
                weight = -LEAST if inside else -WORD
            else:
                weight = weights.get("<" + value, -2 * TAG) if value != "/" else -TAG
            scores.append((weight, -1))
            if value.lstrip("/") in BLOCK or value == "/":
                text = []
            continue
        words = len(value.split())
        if not words:
            text.append(value)
            continue
        if not any(x for x in text if not x.isspace()):
            blocks.append(text)
        text.append(value)
        weight = weights.get(context, weights.get(context[context.index(">") :], WORD))
        if holds:  # a page that names its article
            weight = max(weight, WORD) if inside else min(weight, -WORD)
        scores.append((weight * words, len(blocks) - 1))

    best, total, start, span = 0.0, 0.0, 0, None
    for k, (score, _) in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, span = total, (start, k)
    if span is None:
        return ""
    kept = [b for _, b in scores[span[0] : span[1] + 1] if b >= 0]
    lines = (" ".join("".join(html.unescape(x) for x in blocks[b]).split()) for b in range(min(kept), max(kept) + 1))
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html, and a page without words of its own, have an empty text; ids and urls may be null or
    repeated, each row has its result; a page of any length is one task's work, read in one pass; an empty table
    gives no row.  Other columns are ignored, whatever their names.  Without labelled pages words of
    every context count for a page's text, and tags against it.
    """
    weights = learn(pages.select("page_id", "url", "html"))

    def run(batches):
        for b in small(batches, 200):
            texts = [main_text(page, weights) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        trimmed()

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


#: the given pages hold their main text in one article element without elements that are cut out
ORACLE = r"""
WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(unnest(list_prepend('', string_split_regex(body, '</?(p|h[1-6]|div|ul|ol|li)>'))), '<br>', ' ', 'g') AS line,
             generate_subscripts(list_prepend('', string_split_regex(body, '</?(p|h[1-6]|div|ul|ol|li)>')), 1) AS k FROM p),
c AS (SELECT page_id, url, k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '<[^>]*>', '', 'g'),
             '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line FROM b)
SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (line <> ''), '') AS text,
       length(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (line <> ''), ''))::BIGINT AS n_chars
FROM c GROUP BY page_id, url
"""
