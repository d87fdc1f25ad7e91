"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks: runs of text between block-level tags, without
scripts, styles, comments and the head. A block's features are its words and the share of
them inside links, the same of the block before and the block after, and two hints from
its enclosing elements: whether it stands in an article (no page's articles count that hold less than
``ARTICLE_SHARE`` of its plain words, as teasers do) and whether in a page frame (navigation, footer, sidebar, form, advert, notice,
reader comments ...). A decision tree, grown on the small labelled table below, classifies the blocks. It splits by
words and links first, and asks for the hints only below; the kept blocks are joined in order.

Names of classes and ids are read whole: ``site-footer`` is a frame, ``layout-sidebar-left`` and
``related-work`` are not. A form, or an element that its class calls a part of the layout, is no frame if it holds the page's
heading, article or main element or most of its plain words. A paragraph of an article is a frame
only by a name for adverts, notices or comments.

Defined results: null or empty pages give the empty text; broken markup (unclosed
or stray tags, a page that ends inside a tag) is read as far as it goes; character
references are decoded, unknown ones stay as they stand; nothing kept is cut or
limited; repeated rows get equal results; other columns pass through where kept;
an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.llm.common import concat_column, giving_way, slices, spare

SLICE_BYTES = 8_000_000
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|select|title|annotation|annotation-xml|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)|<\Z"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
TOKEN = re.compile(r"[A-Za-z]+")
#: Elements of HTML that do not break a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr"
    " math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded semantics".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
BODY_TAGS = frozenset("article main".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption".split())
ARTICLE_SHARE = 0.3
#: A form or part of the layout with more of the page's plain words is no frame.
MOST = 0.5
#: Words in class, id and role that mark the frame of a page.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs"
    " pagination pager sidebar aside rail widget widgets footer header masthead topbar toolbar comment comments reply replies disqus"
    " respond discussion related recommended share sharing social follow search skip copyright legal disclaimer tags".split()
)
FRAME_WORDS |= frozenset("adsbygoogle adslot adbox adsense responses reviews feedback".split())
#: Of them those that name adverts, at a name's end whatever stands before (``content-ad``), ...
AD_WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle adslot adbox adsense sponsor sponsored promo promoted promotion".split())
#: ... and those that stay frames however many words they hold.
SHUT = AD_WORDS | frozenset(
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager"
    " footer comment comments reply replies disqus respond discussion responses reviews feedback share sharing".split()
)
#: Words that may stand before a frame word in a name (``site-footer``), and behind one (``comment-list``).
BEFORE = frozenset("site page main global top bottom left right primary secondary post entry user reader customer product blog sub sticky mobile js wp the".split())
BEHIND = frozenset(
    "area bar block box button buttons container content form group header inner items left links list menu panel posts right section"
    " title top bottom wrap wrapper slot unit stories articles footer message text icons".split()
)

#: The labelled table: blocks of the given pages (nav items, adverts, headings, paragraphs, footers) and of pages of other builds, labelled
#: by hand. Columns: words, link share, words before, link share before, words after, link share
#: after, inside an article that counts, inside a frame, label (1: main text).
FIELDS = ["words", "links", "words_before", "links_before", "words_after", "links_after", "article", "frame"]
#: The first fields are the text's own; the tree splits by them alone for so many levels.
TEXT_FIELDS, TEXT_LEVELS = 6, 2
LABELLED = """
1 1.0 0 0.0 1 1.0 0 1 0
2 1.0 1 1.0 9 0.0 0 1 0
9 0.0 1 1.0 7 0.0 0 1 0
14 0.0 1 1.0 40 0.0 0 1 0
6 0.0 1 1.0 30 0.0 0 1 0
13 0.0 60 0.0 0 0.0 0 1 0
15 0.1 200 0.0 0 0.0 0 1 0
40 0.0 80 0.0 13 0.0 0 1 0
30 0.0 25 0.0 45 0.0 0 1 0
60 0.0 30 0.0 20 0.0 0 1 0
90 0.0 40 0.0 10 0.0 0 1 0
20 0.0 60 0.0 2 1.0 1 1 0
4 0.0 50 0.0 6 1.0 1 1 0
45 0.0 60 0.0 5 0.0 1 1 0
5 1.0 40 0.0 4 1.0 1 1 0
12 0.0 70 0.0 65 0.0 1 1 0
7 0.0 12 0.0 35 0.0 1 0 1
10 0.0 8 0.0 1 0.0 1 0 1
1 0.0 10 0.0 40 0.0 1 0 1
2 0.0 45 0.0 3 0.0 1 0 1
5 0.0 30 0.0 12 0.0 1 0 1
80 0.0 35 0.0 20 0.0 1 0 1
60 0.1 120 0.0 40 0.05 1 0 1
25 0.2 40 0.0 50 0.0 1 0 1
40 0.0 25 0.2 11 0.0 1 0 1
200 0.01 60 0.0 15 0.0 1 0 1
6 0.5 80 0.0 70 0.0 1 0 1
3 1.0 60 0.0 75 0.0 1 0 1
3 0.0 0 0.0 0 0.0 1 0 1
3 1.0 2 1.0 1 1.0 0 0 0
2 1.0 3 1.0 2 1.0 0 0 0
1 1.0 4 1.0 8 0.0 0 0 0
5 1.0 60 0.0 3 1.0 0 0 0
20 0.8 40 0.0 10 0.9 0 0 0
15 0.9 12 0.9 9 1.0 0 0 0
30 0.7 5 1.0 20 0.8 0 0 0
10 0.5 3 1.0 2 1.0 0 0 0
12 0.5 4 1.0 60 0.0 0 0 0
20 0.6 60 0.0 55 0.0 0 0 1
12 0.5 45 0.0 70 0.0 0 0 1
4 0.6 80 0.0 60 0.0 0 0 1
45 0.0 8 0.0 60 0.0 0 0 1
60 0.05 45 0.0 30 0.0 0 0 1
30 0.0 60 0.0 12 0.0 0 0 1
150 0.1 5 0.0 40 0.0 0 0 1
18 0.1 70 0.0 45 0.0 0 0 1
50 0.0 40 0.0 0 0.0 0 0 1
80 0.0 0 0.0 0 0.0 0 0 1
30 0.0 0 0.0 25 0.0 0 0 1
60 0.0 50 0.0 3 1.0 0 0 1
70 0.05 3 1.0 1 1.0 0 0 1
40 0.0 2 1.0 4 1.0 0 0 1
25 0.0 2 1.0 3 1.0 0 0 1
8 0.0 4 1.0 45 0.0 0 0 1
6 0.0 2 1.0 60 0.0 0 0 1
3 0.0 1 1.0 35 0.0 0 0 1
9 0.0 40 0.0 50 0.0 0 0 1
4 0.0 60 0.0 70 0.0 0 0 1
2 0.0 30 0.0 40 0.0 0 0 1
10 0.0 50 0.0 12 0.0 0 0 1
7 0.0 14 0.0 20 0.0 0 0 1
5 0.0 3 1.0 4 1.0 0 0 0
9 0.0 2 1.0 3 1.0 0 0 0
12 0.0 4 1.0 2 1.0 0 0 0
4 0.0 50 0.0 3 1.0 0 0 0
6 0.0 45 0.0 2 1.0 0 0 0
7 0.0 2 1.0 0 0.0 0 0 0
8 0.0 3 0.0 2 1.0 0 0 0
3 0.0 0 0.0 2 1.0 0 0 0
5 0.0 2 0.0 1 1.0 0 0 0
1 0.0 0 0.0 1 1.0 0 0 0
2 0.0 40 0.0 0 0.0 0 0 0
5 0.0 60 0.0 0 0.0 0 0 0
14 0.0 50 0.0 0 0.0 0 0 1
11 0.0 30 0.0 2 1.0 0 0 1
6 0.0 0 0.0 40 0.0 0 0 1
18 0.0 2 0.0 1 1.0 0 0 1
16 0.0 20 0.0 2 1.0 0 0 1
13 0.0 40 0.0 1 1.0 0 0 1
20 0.0 9 0.0 3 1.0 0 0 1
18 0.0 3 1.0 2 1.0 0 0 0
1 1.0 0 0.0 60 0.0 0 0 0
4 1.0 0 0.0 40 0.0 0 0 0
6 1.0 3 1.0 50 0.0 0 0 0
2 1.0 60 0.0 45 0.0 0 0 0
3 0.9 50 0.0 60 0.0 0 0 0
10 0.9 30 0.0 20 0.0 0 0 0
1 1.0 0 0.0 90 0.0 0 0 0
5 1.0 1 1.0 150 0.0 0 0 0
3 1.0 80 0.0 200 0.0 0 0 0
4 1.0 30 0.0 40 0.0 1 0 1
2 1.0 12 0.0 9 0.0 1 0 1
60 0.0 2 1.0 60 0.0 0 0 1
40 0.05 3 1.0 50 0.0 0 0 1
25 0.0 5 1.0 30 0.0 0 0 1
60 0.0 1 1.0 12 0.0 0 0 1
15 0.6 8 1.0 30 0.0 0 0 0
20 0.5 3 1.0 50 0.0 0 0 0
60 0.0 27 1.0 29 0.0 1 0 1
30 0.0 4 1.0 12 0.0 1 0 1
20 0.0 6 1.0 3 1.0 1 0 1
12 0.0 9 1.0 0 0.0 1 0 1
5 0.0 4 1.0 6 1.0 1 0 1
20 0.0 20 0.0 0 0.0 0 0 1
16 0.0 18 0.0 0 0.0 0 0 1
12 0.0 14 0.0 0 0.0 0 0 1
13 0.0 9 0.0 4 1.0 0 0 1
12 0.0 3 0.0 2 0.0 0 0 1
1 0.0 0 0.0 0 0.0 0 0 1
2 0.0 0 0.0 0 0.0 0 0 1
7 0.0 0 0.0 0 0.0 0 0 1
12 0.0 0 0.0 0 0.0 0 0 1
25 0.1 0 0.0 0 0.0 0 0 1
400 0.0 0 0.0 0 0.0 0 0 1
3 1.0 0 0.0 0 0.0 0 0 0
2 0.0 2 0.0 2 0.0 0 0 1
1 0.0 2 0.0 1 0.0 0 0 1
2 0.0 30 0.0 1 0.0 0 0 1
1 0.0 25 0.0 2 0.0 0 0 1
1 0.0 1 0.0 40 0.0 0 0 1
2 0.0 1 0.0 25 0.0 0 0 1
1 1.0 0 0.0 1 1.0 0 1 0
1 1.0 1 1.0 1 1.0 0 1 0
1 1.0 1 1.0 7 0.0 0 1 0
7 0.0 1 1.0 6 0.0 0 1 0
8 0.0 1 1.0 9 0.0 0 1 0
6 0.0 7 0.0 10 0.0 1 0 1
9 0.0 8 0.0 61 0.0 1 0 1
52 0.0 9 0.0 48 0.0 1 0 1
10 0.0 6 0.0 82 0.0 1 0 1
71 0.0 55 0.0 12 0.0 1 0 1
38 0.0 61 0.0 8 0.0 1 0 1
8 0.0 44 0.0 0 0.0 0 1 0
6 1.0 70 0.0 9 0.0 0 1 0
9 0.0 6 1.0 0 0.0 0 1 0
2 0.0 0 0.0 0 0.0 1 0 1
1 0.0 1 1.0 1 1.0 1 0 1
5 1.0 2 1.0 3 1.0 1 0 1
4 0.0 3 1.0 2 1.0 1 0 1
2 0.0 4 1.0 30 0.0 1 0 1
3 0.0 50 0.0 4 1.0 1 0 1
150 0.0 2 0.0 3 1.0 1 0 1
9 0.4 3 0.0 5 0.0 1 0 1
"""


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 9, text_levels: int = TEXT_LEVELS) -> tuple | int:
    """A decision tree by the Gini impurity: (field, threshold, at most, above) or a label.

    The upper levels split by the text's own fields, and so that both sides keep rows with every hint to tell apart below.
    """
    ones = int(labels.sum())
    if depth == 0 or ones in (0, len(labels)):
        return int(2 * ones > len(labels))
    hints = rows[:, TEXT_FIELDS:]
    best = None
    for f in range(TEXT_FIELDS if text_levels else rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            if text_levels and len(np.unique(hints[low], axis=0)) + len(np.unique(hints[~low], axis=0)) < 2 * len(np.unique(hints, axis=0)):
                continue
            gini = sum(len(y) * (p := y.mean()) * (1 - p) for y in (labels[low], labels[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut))
    if best is None:
        return grow(rows, labels, depth, 0) if text_levels else int(2 * ones > len(labels))
    _, f, cut = best
    low = rows[:, f] <= cut
    below = max(0, text_levels - 1)
    return (f, cut, grow(rows[low], labels[low], depth - 1, below), grow(rows[~low], labels[~low], depth - 1, below))


@cache
def trained() -> tuple | int:
    table = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return grow(table[:, :-1], table[:, -1])


def classify(rows: np.ndarray, tree: tuple | int) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(rows), tree == 1)
    f, cut, below, above = tree
    low = rows[:, f] <= cut
    out = np.empty(len(rows), bool)
    out[low], out[~low] = classify(rows[low], below), classify(rows[~low], above)
    return out


def frame_name(name: str) -> str:
    """What a class, id or role, read whole, names: a frame that stays one ("shut"), a part of the layout ("name") or nothing."""
    words = TOKEN.findall(name)
    if words and words[-1] in AD_WORDS:
        return "shut"
    at = next((i for i, w in enumerate(words) if w in FRAME_WORDS), None)
    if at is None or not BEFORE.issuperset(words[:at]) or not all(w in FRAME_WORDS or w in BEHIND for w in words[at + 1 :]):
        return ""
    return "shut" if SHUT.intersection(words) else "name"


@lru_cache(maxsize=100_000)
def named_frame(attributes: str, inside: bool) -> str:
    """What attributes make of their element. An article's own header is no frame."""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for one in value.lower().split():
                kind = frame_name(one)
                if kind and not (inside and "header" in TOKEN.findall(one)):
                    found = kind if found != "shut" else found
        if name == "hidden" or (name == "aria-hidden" and value == "true") or re.match(r"data-ad(-|$)", name):
            return "shut"
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return "shut"
    return found


def framed(tag: str, attributes: str, inside: bool) -> str:
    """What makes an element a frame: its "tag", a form or name that may be "released", a name that is "shut", or nothing."""
    if tag in ("form", "fieldset"):
        return "shut" if named_frame(attributes, inside) == "shut" else "released"
    if tag in FRAME_TAGS or (tag == "header" and not inside):
        return "tag"
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    kind = named_frame(attributes, inside)
    if kind == "name":
        return "" if inside and tag in TEXT_TAGS else "released"
    return kind


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    #: The outermost article (a number), -1 without; all frames around (numbers).
    article: int
    frames: tuple[int, ...]


def blocks(page: str) -> tuple[list[Block], set[int]]:
    """Flat blocks in order, and the frames that are none: they hold the page's heading, article or main element, or most of its words."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    open_tags: list[tuple[str, int, tuple[int, ...]]] = []
    may_go: list[bool] = []
    released: set[int] = set()
    link = articles = 0
    outside = ("", -1, ())

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                n = len(html.unescape(" ".join(linked)).split()) if linked else 0
                _, article, frames = open_tags[-1] if open_tags else outside
                out.append(Block(" ".join(words), len(words), min(n, len(words)), article, frames))
            parts.clear()
            linked.clear()

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if link:
                linked.append(piece)

    at = 0
    for m in MARKUP.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() not in INLINE:
                flush()
            continue
        if tag == "a":
            link = 0 if m[2] else 1
            continue
        if tag in INLINE and not m[4]:
            continue
        if tag not in INLINE:
            flush()
        if tag in EMPTY or m[4].rstrip().endswith("/"):
            continue
        if not m[2]:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_tags and open_tags[-1][0] == tag:
                open_tags.pop()
            _, article, frames = open_tags[-1] if open_tags else outside
            if tag in ("h1", "main", "article"):
                released.update(f for f in frames if may_go[f])
            why = framed(tag, m[4], article >= 0)
            if why and tag in INLINE:
                flush()
            if why:
                frames = (*frames, len(may_go))
                may_go.append(why == "released")
            if article < 0 and tag in BODY_TAGS:
                article, articles = articles, articles + 1
            open_tags.append((tag, article, frames))
        else:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    if tag in INLINE and open_tags[i][2] != (open_tags[i - 1][2] if i else ()):
                        flush()
                    del open_tags[i:]
                    break
    text(page[at:])
    flush()
    open_ones = [(b.words - b.linked, b.frames) for b in out if all(may_go[f] for f in b.frames)]
    plain = sum(n for n, _ in open_ones)
    held: dict[int, int] = {}
    for n, frames in open_ones:
        for f in frames:
            held[f] = held.get(f, 0) + n
    released.update(f for f, n in held.items() if n > MOST * plain)
    return out, released


def features(found: list[Block], released: set[int]) -> np.ndarray:
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.linked for b in found), 0], float) / np.maximum(words, 1)
    frame = np.array([any(f not in released for f in b.frames) for b in found], float)
    article = np.array([b.article >= 0 for b in found], float)
    plain = words[1:-1] * (1 - links[1:-1]) * (1 - frame)
    if plain @ article < ARTICLE_SHARE * plain.sum():
        article = np.zeros(len(found))
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], article, frame])


def main_texts(pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    rows = np.concatenate([features(*f) for f in found]) if found else np.zeros((0, len(FIELDS)))
    kept = iter(classify(rows, trained()).tolist())
    return [" ".join(b.text for b in f if next(kept)) for f, _ in found]


def extract(pages: DataFrame, page: str = "html", keep: list[str] = ()) -> DataFrame:
    """Columns ``keep``, then ``text``, the main text."""
    keep = giving_way(keep, "text")
    own = spare("selenite_page", keep)
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, own, SLICE_BYTES):
            texts = main_texts([p or "" for p in concat_column(batch.column(own)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], schema.names)

    return pages.select(*keep, F.col(page).alias(own)).mapInArrow(run, schema)
