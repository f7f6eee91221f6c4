"""Main-text extraction by the maximum-scoring subsequence of a page's tokens.

A page is a sequence of words and tags. What markup declares to be a menu, header, footer, sidebar, notice, advert,
form, script, style or reader comment is cut out first. Of the other tokens words tend to score positive and tags negative: the
weight of a kind of token is its log likelihood ratio inside and outside the main text, counted on labelled pages. Kinds of words
are told apart by whether they lie in a link or heading, and whether inside an article element, beside one, or on a page without one.
One linear scan finds the best contiguous stretch, and it alone decides: every block of it is kept, whatever its length, but
those beside the article elements where the stretch holds such.

Defined results: null and empty html give the empty text, as does a page without words; repeated rows
agree; broken markup is read as browsers do (unclosed and stray tags, missing ends); other columns pass; rows need no id.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of HTML.
_RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "button", "title", "canvas", "audio", "video", "datalist")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "head"}
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "toolbar"}
_BOILER_NAMES = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "cookie", "cookies", "consent", "notice", "notices", "alert",
    "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "pagination", "pager", "toolbar",
    "search", "searchbox", "form", "gdpr", "paywall", "copyright", "legal", "disclaimer", "tags", "taglist", "skip", "hidden",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(_RAW)})\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def declared_boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element's name or attributes say that it is no main text."""
    if tag in _BOILER_TAGS and not (tag == "header" and in_article):
        return True
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
        if name == "role" and value.lower() in _BOILER_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and (_BOILER_NAMES - {"header", "widget", "widgets"} if in_article else _BOILER_NAMES) & set(_NAME.split(_CAMEL.sub(" ", value).lower())):
            return True
    return False


class Page:
    """Tokens (kind, number, block) of a page, but declared boilerplate, and its blocks of text, in page order."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, int, int]] = []
        self.blocks: list[list[str]] = [[]]
        self.boiler, self.inside = [False], [False]
        stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, in an article
        opened: Counter[str] = Counter()
        link, heading, at = 0, False, 0

        def boundary() -> None:
            if self.blocks[-1]:
                self.blocks.append([])
                self.boiler.append(False)
                self.inside.append(False)
            self.boiler[-1] = bool(stack) and stack[-1][1]
            self.inside[-1] = bool(stack) and stack[-1][2]

        def token(kind: str, n: int = 1) -> None:
            if not self.boiler[-1]:
                self.tokens.append((kind, n, len(self.blocks) - 1))

        def words(text: str) -> None:
            if text and (n := len(text.split())):
                token("word_link" if link else "word_heading" if heading else "word_plain", n)
            if text:
                self.blocks[-1].append(text)

        for m in _TOKEN.finditer(source):
            words(source[at : m.start()])
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                if m[1] and m[1].lower() != "title":
                    token("tag_raw")
                continue
            close = bool(m[2])
            if tag == "br":
                self.blocks[-1].append(" ")
            if tag == "a":
                link = 0 if close else 1
            if tag in _BLOCK:
                link = 0
                heading = tag[0] == "h" and tag[1:].isdigit() and not close
                if tag not in _VOID and tag not in ("p", "li", "td", "th", "tr", "dd", "dt"):
                    if close:
                        while opened[tag]:
                            name = stack.pop()[0]
                            opened[name] -= 1
                            if name == tag:
                                break
                    else:
                        outer = stack[-1] if stack else ("", False, False)
                        boiler = outer[1] or declared_boilerplate(tag, m[4], outer[2])
                        stack.append((tag, boiler, outer[2] or (tag in ("article", "main") and not boiler)))
                        opened[tag] += 1
                boundary()
                if tag in ("p", "li", "td", "dd", "dt") and not close and declared_boilerplate(tag, m[4], True):
                    self.boiler[-1] = True
            token("tag_link" if tag == "a" else "tag_block" if tag in _BLOCK else "tag_inline")
        words(source[at:])
        some = any(i and kind.startswith("word") for kind, _, b in self.tokens if (i := self.inside[b]))
        place = {True: "_inside", False: "_beside" if some else "_alone"}
        self.tokens = [(kind + place[self.inside[b]] if kind.startswith("word") else kind, n, b) for kind, n, b in self.tokens]

    def text(self, k: int) -> str:
        return " ".join(entities.unescape("".join(self.blocks[k])).split())

    def main(self, weights: dict[str, float]) -> list[int]:
        """Blocks of the main text."""
        best, span, run, start = 0.0, None, 0.0, 0
        for i, (kind, n, _) in enumerate(self.tokens):
            if run <= 0:
                run, start = 0.0, i
            run += weights[kind] * n
            if run > best:
                best, span = run, (start, i)
        if span is None:
            return []
        stretch = range(self.tokens[span[0]][2], self.tokens[span[1]][2] + 1)
        article = any(self.inside[b] for _, _, b in self.tokens[span[0] : span[1] + 1])
        return [k for k in stretch if not self.boiler[k] and (self.inside[k] or not article)]


KINDS = (*(f"word_{kind}_{place}" for kind in ("plain", "heading", "link") for place in ("inside", "beside", "alone")), "tag_block", "tag_inline", "tag_link", "tag_raw")

#: Pages written out: html and its main text.
_WRITTEN = (
    (
        "<html><head><title>On rivers</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></nav><div class='ad'>Buy boots today</div><article><h1>On rivers</h1>"
        "<p>Rivers carry <b>sand</b> and silt to the sea, and build land where they slow down.<p>A delta grows by a few metres in a good year.</article><footer>&copy; A. Paper <a href='/c'>contact</a></footer></body></html>",
        "On rivers\n\nRivers carry sand and silt to the sea, and build land where they slow down.\n\nA delta grows by a few metres in a good year.",
    ),
    (
        "<body><div id='menu'><a href='1'>Start</a> <a href='2'>Shop</a> <a href='3'>Help</a></div><div><h2>Bread</h2><p>Mix flour, water and salt, and let the dough rest for an hour.</p><p>Bake it hot; <i>steam</i> makes the crust.</p></div>"
        "<div class='sidebar'><a href='4'>Ten best ovens</a> <a href='5'>Knives</a></div><div id='comments'><p>Great recipe, thanks!</p></div><form><input> Your name</form></body>",
        "Bread\n\nMix flour, water and salt, and let the dough rest for an hour.\n\nBake it hot; steam makes the crust.",
    ),
    (
        "<html><body><header><a href='/'>The Gazette</a></header><main><h1>Council votes</h1><p>The council voted on Monday to repair the old bridge before the winter storms arrive.</p><p>Work begins in May, the mayor said, and takes "
        "half a year.</p></main><aside><ul><li><a href='/1'>Weather</a><li><a href='/2'>Sports</a></ul></aside><footer><a href='/i'>Imprint</a> <a href='/p'>Privacy</a></footer><script>track()</script></body></html>",
        "Council votes\n\nThe council voted on Monday to repair the old bridge before the winter storms arrive.\n\nWork begins in May, the mayor said, and takes half a year.",
    ),
)


_SENTENCES = (
    "The ferry leaves the old harbour twice a day and takes an hour to reach the island.", "Nobody could say who had built the wall, or why it ended in the middle of a field.",
    "Prices rose again in spring, though less than in the year before.", "She sold the workshop, kept two of the looms, and taught weaving until she was ninety.",
    "Rain is rare here, so every roof feeds a cistern.", "The committee will meet in June to look at the results.", "It did not last.",
)
#: How a labelled page is laid out: before its main text, around it, and after it. Half of the layouts declare nothing.
_LAYOUTS = (
    ("<nav><ul>{links}</ul></nav><div class='ad'>{promo}</div>", "<article>{body}</article>", "<footer>{links}</footer>"),
    ("<header><a href='/'>Daily</a></header><ul>{links}</ul>", "<main>{body}</main>", "<div>{promo}</div><ul>{links}</ul>"),
    ("<div>{promo}</div><div>{links}</div>", "<div><article>{body}</article></div>", "<div><div>{promo}</div><a href='/all'>All</a> {links}</div><script>t()</script>"),
    ("<table><tr><td>{links}</td><td>", "{body}", "</td><td>{links}<br>{short}</td></tr></table>"),
    ("<div><ul>{links}</ul></div><div><a href='/'>Start</a> | <a href='/map'>Map</a></div>", "<div id='text'>{body}</div>", "<div><span>{short}</span><ul>{links}</ul></div><style>a{{}}</style>"),
    ("<p><a href='/'>Home</a></p><hr>", "{body}", "<hr><p><a href='/'>Home</a> <a href='/top'>Top</a></p><ul>{links}</ul>"),
)


def labelled_pages() -> list[tuple[str, str]]:
    """Pages with their main text: those written out, and one for each layout and number of paragraphs."""
    out = list(_WRITTEN)
    for k, (before, around, after) in enumerate(_LAYOUTS):
        for paragraphs in (1, 2, 4, 7):
            links = "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(4 + 2 * k))
            fill = {"links": links, "promo": "<b>Save</b> <a href='/buy'>ten per cent</a> <i>today</i>", "short": "<i>Seen</i> <b>by</b> <u>many</u>"}
            texts = [f"On matter {k}", *(" ".join(_SENTENCES[(k + p + i) % len(_SENTENCES)] for i in range(1 + p % 3)) for p in range(paragraphs))]
            body = f"<h1>{texts[0]}</h1>" + "".join(f"<p>{t}</p>" if i % 3 else f"<p><b>{t[:5]}</b>{t[5:]}" for i, t in enumerate(texts[1:]))
            out.append((f"<html><body>{before.format(**fill)}{around.format(body=body)}{after.format(**fill)}</body></html>", "\n\n".join(texts)))
    return out


def fit_weights(pages: list[tuple[str, str]] | None = None) -> dict[str, float]:
    """Log likelihood ratio of each kind of token inside and outside the main text of labelled pages."""
    inside, outside = Counter(), Counter()
    for source, text in labelled_pages() if pages is None else pages:
        page, wanted = Page(source), Counter(text.split("\n\n"))
        labels = []
        for k in range(len(page.blocks)):
            t = page.text(k)
            labels.append(wanted[t] > 0)
            wanted[t] -= wanted[t] > 0
        for kind, n, b in page.tokens:
            (inside if labels[b] else outside)[kind] += n
    most = [sum(c.values()) + 0.5 * len(KINDS) for c in (inside, outside)]
    return {k: math.log((inside[k] + 0.5) / most[0]) - math.log((outside[k] + 0.5) / most[1]) for k in KINDS}


def main_text(source: str | None, weights: dict[str, float]) -> str:
    if not source:
        return ""
    page = Page(source)
    return "\n\n".join(t for k in page.main(weights) if (t := page.text(k)))


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points."""
    weights = weights or fit_weights()
    base = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars")])
    schema = T.StructType([*base.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                texts = [main_text(h, weights) for h in b.column(b.schema.get_field_index("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*b.schema.names, "text", "n_chars"])

    return base.mapInArrow(run, schema)
