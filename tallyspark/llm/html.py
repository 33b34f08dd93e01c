"""Main text of web pages by maximum-scoring subsequences.

A page is a sequence of tags and words. A tag costs what labelled pages say it costs; a word earns or
costs the log odds, learned from the same pages, that words in such a place belong to the article. A place
is told by its open elements, their class and id names, and by structure that needs no known name: text
beside the article or main element, text in a box that holds few words beside the largest, and blocks that are
mostly links; length counts as every word scores. Scores are signed and have no cap.

1. One linear scan finds all maximal scoring runs; the best is the article. Another run is its continuation
   (after a long advert, say) when its words earn as much as the article's do.
2. The same scan over the negated scores of a run finds the stretches that cost most (adverts, notices,
   forms, reader comments); those that cost at least CUT are left out, with what little earns in between,
   but for paragraphs that earn as the article does. No block is left out by itself: one that costs less
   stays where its surroundings carry it.

Weights come from LABELLED, small pages written down here with their article blocks. Each is learned from
twice, with its names and with all of them unknown, so that a page of names that no labelled page has is
read by its structure. A header inside an article is a feature of its own: what it holds is the article's
headline, not the site's.

Defined results: a null or empty html, or one without an earning word, gives the empty text. Unclosed
and stray tags are tolerated (an end tag without its start is ignored; an unclosed script or style runs
to the end; a page title ends where the body begins; a "<" that opens no tag is text). Reading is linear in
the page, however deep or broken it is: a tag ends before the next "<" outside quotes, end tags without a
start are known by a count, and elements pass on only features that have a weight. Nothing is capped.
Columns of other names pass through; outputs replace equal names.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import table

# HTML element names by what they do to text.
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
#: Elements of which each stands for its kind in training, whatever else it is in.
APART = frozenset(["header", "footer", "nav", "aside", "form", "menu", "dialog", "button", "select", "label", "textarea", "title", "template", "noscript"])
#: Elements that carry features: blocks, links and those that are not shown as running text.
NAMED = BLOCK | {"a", "title", "textarea", "template", "noscript"}
HEAD = {"head", "title"}
#: Elements that are a box of their own even without a name; the others of BOXED only with one.
SECTIONS = frozenset("article aside footer form header main nav section".split())
BOXED = SECTIONS | {"div", "ul", "ol", "table"}
#: Elements of which one holds the article, where a page has any.
ARTICLE = frozenset(["article", "main", ".main"])
#: Features of a place that no name tells.
STRUCTURE = frozenset(["beside-article", "mostly-links", "small-box"])
#: A costly stretch inside the article is left out from this score on.
CUT = 1.0
#: A run that earns this share of what the article's words earn on average continues it.
ALIKE = 0.5
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+", re.I)

# Labelled pages; blocks of the article are marked by a leading "+" in the text.
LABELLED = (
    '<header class="site-header"><div class="logo">My site</div><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav></header>'
    "<main><article><h1>+A title</h1><p>+First words of the story.</p><p>+Second <b>+part</b>+ of it.</p><h2>+More</h2><ul><li>+an item</li><li>+other item</li></ul></article></main>"
    '<aside class="sidebar"><h3>Related</h3><p>Read this too</p></aside><footer><p>Copyright and contact</p></footer>',
    '<nav class="menu"><ul><li><a>one</a></li><li><a>two</a></li></ul></nav><div class="ad">Buy this now</div><article><h1>+Head line</h1><p>+Text of the piece.<div class="ad advert">Sponsored words here</div>'
    '<p>+It goes on.</p><blockquote>+A quote</blockquote></article><footer>&copy; site &middot; imprint and more</footer>',
    '<div id="header" class="top banner"><a>Brand</a></div><div id="nav" class="navbar menu"><a>News</a> <a>Sport</a></div><div id="content" class="post entry content"><h1>+Report</h1>'
    "<p>+Long text stands here.</p><p>+And <a>+a link</a>+ in text.</p><table><tr><td>+cell</td><td>+value</td></tr></table></div>"
    '<div id="sidebar" class="widget"><ul><li><a>Archive</a></li></ul><p>Popular posts</p></div><div id="comments" class="comments"><h3>Comments</h3><div class="comment"><p>Nice one, I agree</p></div></div>'
    '<div id="footer" class="footer bottom">Legal notice and terms</div>',
    '<div class="cookie notice consent banner"><p>We use cookies to improve</p><button>Accept</button></div><article class="article story"><header><p>+By a writer</p></header><p>+Body text is here.</p>'
    '<form class="newsletter subscribe signup"><label>Your mail</label><p>Subscribe to our letter</p></form><pre>+code block</pre><p>+End of text.</p>'
    '<section class="comments reader responses" id="comments"><h2>Reader comments</h2><article class="comment"><p>I do not think so</p></article></section></article>'
    '<aside class="related promo recommended"><p>See also this</p></aside>',
    '<form action="/search" class="search"><label>Search</label><p>Find something</p></form><div class="breadcrumb breadcrumbs"><a>Home</a> <a>Science</a></div>'
    '<div class="article body text"><p>+Words of an article.</p><div>+More words in a box.</div><div class="share social"><a>Share</a><a>Tweet</a></div>'
    '<div class="advertisement ads sponsor"><p>Cheap offers today</p></div><p>+Last words.</p></div><div class="tags meta byline pagination pager"><a>tag</a> next page</div>',
    '<div role="banner">Site name</div><div role="navigation"><a>Go</a> <a>Back</a></div><div role="main"><p>+Main words are these.</p><dl><dt>+term</dt><dd>+meaning</dd></dl></div>'
    '<div role="complementary">Side words</div><div role="contentinfo">Imprint</div><div class="disclaimer alert popup modal warning"><p>Please note this</p></div>',
    "<header><h2>Daily news</h2><p>All the news of today</p></header><section><h2>+Part one</h2><p>+Plain page text.</p><figure><figcaption>+A caption</figcaption></figure></section>"
    "<section><p>+Other part.</p></section><footer><p>All rights reserved here</p><ul><li><a>Terms</a></li></ul></footer>",
    '<div class="site brand">The name</div><h1>+A title above</h1><main><div class="story"><div class="intro lead summary">+Words that lead in</div><p>+The long part of it stands here, and it goes on.</p>'
    '<div class="caption image">+What the picture shows</div><p>+More of the long part is here.</p><div class="quote highlight">+Some words of a speaker</div></div></main><div class="imprint">Who made this site</div>',
    '<div class="page"><div class="headline title">+The head of it</div><div class="story text"><p>+The first part is long and holds most words.</p><p>+So does the second part of it.</p></div>'
    '<div class="replies"><div class="reply">I do not agree with this</div><div class="reply">Nor do I, my friend</div></div><div class="contact">Write to us here</div></div>',
    "<p>+A page of paragraphs only.</p><p>+Second paragraph.</p><div>+Third one.</div>",
    "<head><title>Name of the page</title></head><body><noscript><p>Please turn scripts on</p></noscript><article><header><h1>+Own headline</h1><p>+Its lead</p></header><p>+Text with <math>+x = y</math>+ in it.</p>"
    "<object><p>+Words for the picture</p></object><footer><p>Filed under news</p></footer></article><template><p>Fill this in</p></template><textarea>Write here</textarea></body>",
)


def names_of(tag: str, attributes: str) -> frozenset[str]:
    """Features of an element: its name and the words of its class, id and role."""
    found = {tag}
    for m in NAMES.finditer(attributes):
        found.update("." + x.lower() for x in PART.findall(m[1] or m[2] or m[3] or ""))
    return frozenset(found)


def parts(page: str, known=None):
    """The page as ("tag", name) and ("text", characters, features of the open elements, block number, innermost box). known: features to keep (default: all)."""
    stack: list[tuple[str, frozenset[str], str]] = []
    under: frozenset[str] = frozenset()
    box = ""
    opened: dict[str, int] = {}
    block, at, end = 0, 0, len(page)

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                yield "text", m[0], under, block, box
            continue
        yield "tag", name
        if name in BLOCK:
            block += 1
        if m[1]:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
                under, box = stack[-1][1:] if stack else (frozenset(), "")
        elif name in RAW_END:
            close = None if m[3].endswith("/") else RAW_END[name].search(page, at)
            at = close.end() if close else at if m[3].endswith("/") else end
        elif name == "br":
            yield "text", " ", under, block, box
        elif name not in VOID:
            while stack and (stack[-1][0] in CLOSES.get(name, ()) or (stack[-1][0] in HEAD and name in BLOCK)):
                pop()
            under, box = stack[-1][1:] if stack else (frozenset(), "")
            if name in NAMED:
                found = names_of(name, m[3])
                if name == "header" and opened.get("article"):
                    found = found - {"header"} | {"header-of-article"}
                if name in BOXED and (len(found) > 1 or name in SECTIONS):
                    box = " ".join(sorted(found))
                under = under | (found if known is None else found & known)
            stack.append((name, under, box))
            opened[name] = opened.get(name, 0) + 1


def placed(page: str, known=None) -> list[tuple]:
    """The page's parts; texts with the features of their structure too, and their number of words: ("text", characters, features, block, words)."""
    found = list(parts(page, known))
    inside = any(part[0] == "text" and not part[2].isdisjoint(ARTICLE) and part[1].strip() for part in found)
    boxes: dict[str, int] = {}
    blocks: dict[int, list[int]] = {}
    for part in found:
        if part[0] == "text":
            n, under = len(part[1].split()), part[2]
            count = blocks.setdefault(part[3], [0, 0])
            count[0] += n
            if "a" in under:
                count[1] += n
            elif not (inside and under.isdisjoint(ARTICLE)):
                boxes[part[4]] = boxes.get(part[4], 0) + n
    most = max(boxes.values(), default=0)
    extra: dict[tuple, frozenset[str]] = {}
    out = []
    for part in found:
        if part[0] == "tag":
            out.append(part)
            continue
        _, text, under, block, box = part
        n, linked = blocks[block]
        key = (under, inside, 2 * linked > n, bool(box) and 4 * boxes.get(box, 0) < most)
        features = extra.get(key)
        if features is None:
            features = under if key[2] else under - {"a"}  # a link within a sentence is a part of it
            if inside and under.isdisjoint(ARTICLE):
                features = features | {"beside-article"}
            features = extra[key] = features | {f for f, holds in zip(("mostly-links", "small-box"), key[2:], strict=True) if holds}
        out.append(("text", text, features, block, len(text.split())))
    return out


@cache
def weights() -> tuple[dict[str, float], float, dict[str, float]]:
    """Log odds of features for words, their bias, and the cost of each tag, from the labelled pages."""
    rows, labels, inside, outside = [], [], {}, {}
    for page in LABELLED:
        content = False
        marks = [p[1].lstrip().startswith("+") for p in parts(page) if p[0] == "text" and p[1].strip()]
        at = 0
        for part in placed(page.replace("+", "")):
            if part[0] == "tag":
                count = inside if content else outside
                count[part[1]] = count.get(part[1], 0) + 1
            elif part[1].strip():
                content = marks[at]
                at += 1
                rows.append(part[2])
                labels.append(float(content))
    for row, label in list(zip(rows, labels, strict=True)):
        nameless = frozenset(f for f in row if f[0] != ".")
        tags, place = nameless - STRUCTURE, nameless & STRUCTURE
        alone = [one - APART - {"a"} | {f} for f in row if f[0] == "." for one in (tags, nameless)] + [one | {f} for f in tags & APART for one in (frozenset(), place)]
        for one in [row] if label else [row, *alone]:  # each sign of what is no article counts by itself; both kinds stand in all surroundings
            rows += [one, one | {"article", "p"}, one | {"article", "section", "p"}, one | {"div", ".content"}, one | {"div", "p"}]
            labels += [label] * 5
        rows += [nameless] * 5  # the same page, its names unknown
        labels += [label] * 5
    known = sorted({f for row in rows for f in row})
    column = {f: i for i, f in enumerate(known)}
    x = np.zeros((len(rows), len(known)))
    for i, row in enumerate(rows):
        x[i, [column[f] for f in row]] = 1.0
    y, w, bias = np.array(labels), np.zeros(len(known)), 1.5
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(3000):
        error = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w -= 2.0 * (x.T @ (error * share) + 0.0001 * w)
    cost = {t: -0.05 - 0.1 * max(0.0, float(np.log((outside.get(t, 0) + 1) / (inside.get(t, 0) + 1)))) for t in {*inside, *outside}}
    return dict(zip(known, w.tolist(), strict=True)), bias, cost


def maximal_runs(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring runs, in order, by one linear scan.

    A run is maximal when every part of it that begins at its start or stops at its end earns, and no longer run that
    holds it is such. The best run of all is one of them.
    """
    runs: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after it, last earlier run with a smaller sum before
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start = i
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= before:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= total:
                runs.append((start, i + 1, before, total, j))
                break
            start, before = runs[j][0], runs[j][2]
            del runs[j:]
    return [(a, b, after - before) for a, b, before, after, _ in runs]


def scored(page: str) -> tuple[list[tuple], list[float]]:
    """The page's parts and the score of each."""
    odds, bias, cost = weights()
    worth: dict[frozenset[str], float] = {}
    page_parts, scores = placed(page, odds.keys()), []
    for part in page_parts:
        if part[0] == "tag":
            scores.append(cost.get(part[1], -0.05))
            continue
        each = worth.get(part[2])
        if each is None:
            each = worth[part[2]] = bias + sum([odds.get(f, 0.0) for f in sorted(part[2])])
        scores.append(each * part[4])
    return page_parts, scores


def chosen(page_parts: list[tuple], scores: list[float]) -> list[bool]:
    """For each part, whether it is in the article: in the best run or its continuations, outside of their costly stretches."""
    keep = [False] * len(scores)
    runs = maximal_runs(scores)
    if not runs:
        return keep
    words = [p[4] if p[0] == "text" else 0 for p in page_parts]

    def mean(a: int, b: int, total: float) -> float:
        return total / max(1, sum(words[a:b]))

    a, b, total = max(runs, key=lambda r: r[2])
    alike = ALIKE * mean(a, b, total)
    for start, end, total in runs:
        if mean(start, end, total) < alike:
            continue
        keep[start:end] = [True] * (end - start)
        for x, y, costs in maximal_runs([-s for s in scores[start:end]]):
            if costs < CUT:
                continue
            x, y = start + x, start + y
            keep[x:y] = [False] * (y - x)
            for u, v, back in maximal_runs(scores[x:y]):
                if mean(x + u, x + v, back) >= alike:
                    keep[x + u : x + v] = [True] * (v - u)
    return keep


def extract(page: str | None) -> str:
    """The main text: blocks of the article's runs, joined by newlines."""
    if not page:
        return ""
    page_parts, scores = scored(page)
    lines: list[list[str]] = []
    last = -1
    for part, kept in zip(page_parts, chosen(page_parts, scores), strict=True):
        if not kept or part[0] == "tag":
            continue
        if part[3] != last:
            lines.append([])
            last = part[3]
        lines[-1].append(part[1])
    blocks = (" ".join(html.unescape("".join(line)).split()) for line in lines)
    return "\n".join(b for b in blocks if b)


def main_text(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """df with the string column `out`, the page's main text."""

    @pandas_udf("string")
    def text_of_pages(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in pages], dtype="object")

    return df.withColumn(out, text_of_pages(F.col(column)))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
