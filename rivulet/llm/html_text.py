"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides what structure and statistics decide: blocks of menus,
headers, footers, sidebars, notices, adverts, forms and reader comments are boilerplate, as are blocks that are mostly
links; long blocks with enough stop words are content, as are long blocks in a language whose stop words aren't known, if
they hold hardly any link and read as sentences. A mark that only goes with a name of content (as ``post-share``) doesn't
outvote such long, link-free prose. A form, or a container that its name marks, is no boilerplate if it holds nearly all
such prose of the page, in several blocks (some sites wrap whole pages so); reader comments and what is hidden always are.
Paragraphs and the like are marked by the whole name or its last part only (``share``, not ``share-price``). Pass two gives every short, undecided block the label of its
nearest decided neighbours; a tie goes to the neighbour in the same container, then to content inside an article and for
headings, else to boilerplate.

Where a page marks its article (``article``, ``main``, ``role=main``) and that holds content, and not just a small part of
the page's prose (a teaser), blocks outside it are boilerplate, and blocks inside it take labels from neighbours inside it
only.

A page is held as its blocks and the stack of open elements; what encloses a block is kept per marked element, so pages
nested very deeply in marked elements take memory in proportion to blocks times such elements, up to ``DEEPEST``.

Defined results: null html counts as empty; a page without main text gives the empty text. Repeated pages each give a
row. A very long page is worked on whole, an empty table gives an empty result. Extra columns are kept, but for those
with the names of the new columns, which are replaced. Markup that is broken (unclosed tags and quotes, stray end tags)
is read as a browser would, about: it never fails, and takes linear time.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters from which a block can be decided by its words, and the least share of stop words in content.
LONG_BLOCK = 70
STOP_SHARE = 0.08
#: Blocks with a larger share of characters in links are boilerplate.
LINK_SHARE = 0.5
#: Where stop words can't tell: the largest share of characters in links of content, and the least words per sentence.
PROSE_LINKS = 0.2
SENTENCE_WORDS = 5

#: The share of the page's prose, and the blocks of it, that lift a container's mark; the least share of a marked article.
LIFTED, LIFTED_BLOCKS, ARTICLE_SHARE = 0.8, 2, 0.25
#: Marked elements around a block that are looked at one by one; those deeper inside are boilerplate as their parents are.
DEEPEST = 16

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i if in into is it its not of on or our she so
    that the their them they this to was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus
    pour qu que qui sa se ses son sont sur un une vous
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im
    in ist mit nach nicht noch nur oder sein sich sie sind über um und von vor war wenn wie wir wird zu zum zur
    al como con cuando del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no o para pero por
    porque que se si sin sobre su sus también un una y ya
    """.split()
)
# Elements that never hold main text; raw ones end only at their own end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BOILERPLATE = frozenset("nav footer aside form header button select option menu dialog template svg math object audio video canvas head datalist applet map".split())
# Words in class, id and role that mark boilerplate.
MARKS = frozenset(
    """
    ad ads adbox adslot adsense advert adverts advertisement advertising banner sponsor sponsored promo promos promotion
    sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies
    consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share
    sharing social related recommended recommendations comment comments reply replies respond disqus widget widgets
    toolbar pagination pager tagcloud copyright disclaimer hidden complementary contentinfo search searchform
    """.split()
)
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
# Words that name content; beside one of these, marks of the second kind may be about a part of an article.
CONTENT_NAMES = frozenset("post article entry content story text body page main single".split())
WEAK_MARKS = frozenset("share sharing social promo promotion header footer banner notice related search".split())
# Elements that begin and end a block, elements without content, and what a start tag closes first.
BLOCKS = frozenset(
    """
    html body article main section nav aside header footer div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd menu table
    thead tbody tfoot tr td th caption colgroup blockquote pre figure figcaption form fieldset legend details summary
    address center dialog hr button select option textarea title
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: A start tag closes open elements only up to the nearest of these.
SCOPES = frozenset("html body article main section nav aside header footer div ul ol dl table blockquote form figure details".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}
_INNER = {"tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"])}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ATTRIBUTE_AT = re.compile(r"""(?:^|[\s"'/])(?=(?:class|id|role|style|aria-hidden|hidden)\b)""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\u2026\u061f\u06d4\u0964\u0f0d\u104b\u1362\u17d4](?=\s|[\"'\u00bb\u201d\u2019)]|$)|[\u3002\uff01\uff1f]")
#: Scripts written without blanks, or of wide characters: one stands for two letters.
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff]")
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    inside: bool
    structural: int  # 2 boilerplate by structure, 1 by a weak mark, 0 neither
    container: int
    marks: tuple[tuple[int, int], ...] = ()  # enclosing marked containers and forms: their number, and the same
    label: int = 0  # 1 content, -1 boilerplate, 0 undecided


def marked(name: str, attributes: str, inside: bool) -> tuple[int, int, bool]:
    """(boilerplate as in ``Block.structural`` whatever it holds, the same by its name, is the marked article), by an
    element's attributes."""
    bad, named, main = 0, 0, False
    for m in _ATTRIBUTE_AT.finditer(attributes):
        found = _ATTRIBUTE.match(attributes, m.end())
        if not found:
            continue
        key, value = found[1].lower(), (found[2] or "").strip("\"'")
        if key == "hidden":
            bad = max(bad, 2 * (found[2] is None or value.lower() in ("", "hidden", "until-found")))
        elif key == "aria-hidden":
            bad = max(bad, 2 * (value.lower() == "true"))
        elif key == "style":
            bad = max(bad, 2 * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)))
        else:
            if key == "role" and value.lower() in ("main", "article"):
                main = True
            if name in ("html", "body", "main"):
                continue
            for one in value.split():
                parts = [x for x in (p.lower() for p in _PARTS.split(one)) if x]
                if not parts or parts[0] in ("no", "with", "has", "without", "not"):
                    continue
                ends = ({parts[0], parts[-1]} if name in SCOPES else {parts[-1]}) & MARKS
                if name == "article" or main:
                    ends &= COMMENTS
                elif inside and name in HEADINGS:
                    ends -= {"header"}
                if ends:
                    level = 1 if ends <= WEAK_MARKS and CONTENT_NAMES.intersection(parts) else 2
                    if name not in SCOPES or ends & COMMENTS:
                        bad = max(bad, level)
                    named = max(named, level)
    return bad, named, main


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """The page's pieces in order: ("text", "", raw), ("open", name, attributes), ("close", name, "") and, for elements
    that end only at their own end tag, ("raw", name, content) after their "open". Comments are left out. Linear time."""
    last_end = page.rfind(">")
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at) if at <= last_end or page.find("<!", at) >= 0 else None
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[1] is not None:
            yield "text", "", m[1]
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            yield "close", name, ""
            continue
        yield "open", name, m[4] or m[7] or ""
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            yield "raw", name, page[at : close.start()] if close else page[at:]
            at = close.end() if close else end


def blocks(pieces: Iterable[tuple[str, str, str]]) -> list[Block]:
    """The blocks of a page's markup in order, those of no text left out."""
    found: list[Block] = []
    stack: list[tuple] = []  # name, boilerplate, inside the article, link, container, block, marks
    opened: Counter[str] = Counter()
    containers = 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            value = " ".join("".join(text).split())
            if value:
                _, bad, inside, _, container, tag, marks = stack[-1] if stack else ("", 0, False, False, 0, "", ())
                found.append(Block(value, linked, tag, inside, bad, container, marks))
            text.clear()
        linked = 0

    for kind, name, rest in pieces:
        if kind == "text":
            value = htmllib.unescape(rest) if "&" in rest else rest
            text.append(value)
            if stack and stack[-1][3]:
                linked += len("".join(value.split()))
            continue
        if kind == "raw":
            continue
        if name == "br":
            text.append(" ")
            continue
        if kind == "close":
            if name in BLOCKS:
                flush()
            while opened[name]:
                top = stack.pop()[0]
                opened[top] -= 1
                if top == name:
                    break
            continue
        attributes = rest
        if name in RAW:
            if name in BLOCKS or name == "noscript":
                flush()
            continue
        if name in BLOCKS:
            flush()
            closes = CLOSES.get(name, {"p"} if name in SCOPES or name in HEADINGS else set())
            scopes = _INNER.get(name, SCOPES)
            cut = len(stack)
            if any(opened[c] for c in closes):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        cut = i
                    if stack[i][0] in scopes:
                        break
            opened.subtract(s[0] for s in stack[cut:])
            del stack[cut:]
        if name in VOID or (attributes.endswith("/") and name not in BLOCKS):
            continue
        bad, inside, link, container, block, marks = stack[-1][1:] if stack else (0, False, False, 0, "", ())
        if name in SCOPES:
            containers += 1
            container = containers
        own, named, main = marked(name, attributes, inside) if attributes else (0, 0, False)
        named = 2 if name == "form" else named
        if named > own and name in SCOPES and len(marks) < DEEPEST:
            marks = (*marks, (containers, named))
        bad = max(bad, own, 2 * (name in BOILERPLATE and name != "form" and not (name == "header" and inside)))
        stack.append((name, bad, inside or name in ("article", "main") or main, link or name == "a", container, name if name in BLOCKS else block, marks))
        opened[name] += 1
    flush()
    return found


def _prose(b: Block, words: int, wide: int, letters: int) -> bool:
    """Reads as sentences and holds hardly any link: content, where stop words can't tell."""
    sentences = len(_SENTENCE.findall(b.text))
    return b.linked <= PROSE_LINKS * letters and sentences > 0 and words + wide >= SENTENCE_WORDS * sentences


def _lift(found: list[Block], prose: list[int]) -> None:
    """Take the marks of containers and forms over to their blocks, but for those that hold nearly all prose of the page."""
    size: Counter[int] = Counter()
    count: Counter[int] = Counter()
    for b, n in zip(found, prose, strict=True):
        for k, _ in b.marks if n else ():
            size[k] += n
            count[k] += 1
    total = sum(prose)
    for b in found:
        b.structural = max([b.structural, *(level for k, level in b.marks if not (total and size[k] >= LIFTED * total and count[k] >= LIFTED_BLOCKS))])


def classify(found: list[Block]) -> None:
    """Label every block, in two passes."""
    letters = [max(1, len(b.text) - b.text.count(" ")) for b in found]
    worded, content = [], []
    for b, n in zip(found, letters, strict=True):
        wide = len(_WIDE.findall(b.text)) if not b.text.isascii() else 0
        words = _WORD.findall(b.text.lower()) if len(b.text) + wide >= LONG_BLOCK else []
        worded.append(bool(words))
        content.append(bool(words) and (sum(map(STOP_WORDS.__contains__, words)) >= STOP_SHARE * len(words) or _prose(b, len(words), wide, n)))
    free = [c and b.linked <= PROSE_LINKS * n for b, n, c in zip(found, letters, content, strict=True)]
    _lift(found, [n if f and b.structural < 2 else 0 for b, n, f in zip(found, letters, free, strict=True)])
    for b, n, has_words, c, f in zip(found, letters, worded, content, free, strict=True):
        if b.structural == 2 or b.linked > LINK_SHARE * n:
            b.label = -1
        elif has_words:
            b.label = (1 if f else -1) if b.structural else int(c)
        elif b.structural or (len(b.text) >= LONG_BLOCK and not b.inside):
            b.label = -1  # a weak mark and nothing to outvote it, or long and no word in it
    prose = [(b.inside, n) for b, n in zip(found, letters, strict=True) if b.label == 1]
    teaser = sum(n for inside, n in prose if inside) < ARTICLE_SHARE * sum(n for _, n in prose)
    article = any(b.inside and b.label == 1 for b in found) or (any(b.inside and b.label == 0 for b in found) and not any(b.label == 1 for b in found))
    if article and not teaser:
        for b in found:
            if not b.inside:
                b.label = -1
        scope = [b for b in found if b.inside and (not b.structural or b.label == 1)]
    else:
        scope = found
    decided = [b.label for b in scope]
    before, last = [], None
    for i, label in enumerate(decided):
        if label:
            last = i
        before.append(last)
    after = None
    for i in range(len(scope) - 1, -1, -1):
        b = scope[i]
        if decided[i]:
            after = i
            continue
        options = [(abs(i - j), decided[j], scope[j].container == b.container) for j in (before[i], after) if j is not None]
        if not options:
            b.label = 1
            continue
        nearest = min(d for d, *_ in options)
        options = [o for o in options if o[0] == nearest]
        if len({o[2] for o in options}) == 2:
            options = [o for o in options if o[2]]
        labels = {o[1] for o in options}
        b.label = labels.pop() if len(labels) == 1 else (1 if (b.inside and not teaser) or b.tag in HEADINGS else -1)


def main_text(page: str) -> str:
    found = blocks(markup(page))
    classify(found)
    return "\n".join(b.text for b in found if b.label == 1)


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars", keep_html: bool = False) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points). Row-wise: no shuffle."""
    rows = pages.withColumn("__html", F.coalesce(F.col(html).cast("string"), F.lit(""))).drop(text, n_chars)
    if not keep_html:
        rows = rows.drop(html)
    kept = [c for c in rows.columns if c != "__html"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(text, T.StringType(), False), T.StructField(n_chars, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(value.as_py()) for value in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*kept, text, n_chars])

    return rows.mapInArrow(run, schema)
