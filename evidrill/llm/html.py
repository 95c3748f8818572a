"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at its block-level tags. A block is described by its words and link density, by those of its
two neighbours, and by where it stands: under a heading tag, in an article, in a place whose markup names it a menu, notice, comment or the like. A decision
tree, trained on the labelled blocks of TRAINING_PAGES, keeps or drops it; no single mark of the markup decides on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Content that never is text.
RAW = frozenset("script style noscript template svg math iframe object embed canvas audio video head textarea select option button datalist xmp noembed noframes".split())
#: Raw text up to the end tag, in which tags don't count.
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Tags at which a block ends.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What names a place that isn't the page's text: tags, roles, and words of a class or id.
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted promotion "
    "banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar "
    "footer masthead copyright comment comments commentlist reply replies disqus respond discussion "
    "share sharing social related recommended widget widgets search skip".split()
)
#: Of a compound name these say no more than that it is some place, so that the word before them counts ("ad-container").
PLACE_WORDS = frozenset("area bar block bottom box column container content group holder inner item items left links list main outer panel right row section slot text top wrap wrapper".split())
#: A compound that starts with one of these tells of a layout ("has-sidebar"), one with a word of the second kind inside is a title ("notice-of-meeting").
LAYOUT_WORDS = frozenset("has is no with without".split())
TITLE_WORDS = frozenset("about and for in of on the to".split())
#: Names of a page's header; in an article they are its title.
HEADER_WORDS = frozenset("header masthead".split())
MAIN_TAGS = frozenset("article main".split())

# a quote opens a value only after "="; the groups keep what they have, so that no text is scanned twice
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)


@dataclass
class Block:
    text: str
    linked: int
    mark: int
    main: bool
    heading: bool
    words: int = 0
    density: float = 0.0


def _name_mark(name: str, in_main: bool) -> int:
    """2 if a class or id names furniture, 1 if it has such a word in another role, 0 without any."""
    words = [w for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())]
    if words and words[0] in LAYOUT_WORDS:
        return 0
    own = FURNITURE_WORDS if in_main else FURNITURE_WORDS | HEADER_WORDS
    if not own.intersection(words):
        return 0
    if TITLE_WORDS.intersection(words):
        return 1
    while len(words) > 1 and words[-1] in PLACE_WORDS:
        words.pop()
    return 2 if words[-1] in own else 1


def _mark(tag: str, attributes: str, in_main: bool) -> int:
    """What an element's tag, role, class and id say of its place: 2 furniture, 1 perhaps, 0 nothing."""
    if tag in FURNITURE_TAGS or tag == "header" and not in_main:
        return 2
    if not attributes:
        return 0
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in FURNITURE_ROLES:
            return 2
        if name in ("class", "id"):
            for one in value.split():
                found = max(found, _name_mark(one, in_main))
    return found


@cache
def _end_tag(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def blocks_of(html: str) -> list[Block]:
    """The page's blocks with text, in order. Unclosed and stray tags are taken as browsers would, roughly."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, mark, main: of the containers that are open
    parts: list[str] = []
    linked = 0
    in_link = False
    heading = False
    mark, main = 0, False
    unended: set[str] = set()  # tags of which no end is left

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), mark, main, heading))
            parts, linked = [], 0

    at = 0
    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        stop = m.start() if m else size
        if stop > at:
            piece = html[at:stop]
            parts.append(piece)
            if in_link:
                linked += len(" ".join(unescape(piece).split()))
        if not m:
            break
        at = max(m.end(), stop + 1)
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            in_link = not closing
            continue
        if not closing and (tag in RAW and tag not in VOID or tag == "title"):
            end = None if tag in unended or m[3].endswith("/") and tag in ("svg", "math") else _end_tag(tag).search(html, at)
            if tag in BLOCK and tag != "title" or tag in ("head", "noscript"):
                end_block()
            if end:
                at = end.end()
            elif tag in RAW_TEXT:
                at = size
            elif not m[3].endswith("/"):
                unended.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        end_block()
        if tag in VOID:
            continue
        if len(tag) == 2 and tag[0] == "h":
            heading = not closing
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    in_link = False
                    break
        elif tag not in ("p", "html", "body"):
            if tag in ("li", "dt", "dd", "td", "th", "tr"):
                in_link = False
            opens = tag in MAIN_TAGS or 'role="main"' in m[3]
            own = _mark(tag, m[3], main or opens)
            # in an article a name of what is around it counts no more, unless it is a plain one
            stack.append((tag, max(own, mark if mark == 2 or not opens else 0), main or opens))
        elif tag == "p":
            heading = False
            # a paragraph has a context of its own only if its class says so, up to the next block tag
            own = _mark(tag, m[3], main) if m[3] else 0
            if own:
                mark = max(own, stack[-1][1] if stack else 0)
                main = stack[-1][2] if stack else False
                continue
        mark, main = stack[-1][1:] if stack else (0, False)
    end_block()
    for b in out:
        b.words = len(b.text.split())
        b.density = b.linked / len(b.text)
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "mark", "main", "main_share")


def features_of(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES a block. Beyond the page's ends there are no words and no links. main_share: of the words in blocks of few links
    that no mark names furniture, how many are in articles; 0 without any."""
    if not blocks:
        return np.empty((0, len(FEATURES)))
    words = np.array([0, *(b.words for b in blocks), 0], float)
    density = np.array([0, *(b.density for b in blocks), 0], float)
    own = np.array([(b.heading, b.mark, b.main) for b in blocks], float)
    plain = words[1:-1] * (density[1:-1] < 0.5) * (own[:, 1] < 2)
    share = float(plain @ own[:, 2] / plain.sum()) if plain.any() else 0.0
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], own, np.full(len(blocks), share)])


#: Labelled pages, one a line: blocks as "place words[/linked words] label[xtimes]", + for main text. A place is the path of tags, with classes and ids, below body.
TRAINING_PAGES = """
header.site>h2 3/3 -; nav>li 1/1 -x5; article>h1 8 +; article>p 45 +; article>p 30/3 +; article>p 3 +; article>p 61 +; aside>h3 2 -; aside>li 5/5 -x4; section#comments>p 25 -; section#comments>p 40 -; footer>p 9/2 -
div.top>p 4/4 -; div.menu>li 2/2 -x7; div.page>h1 6 +; div.page>p 52 +; div.page>p 18 +; div.page>p 33/4 +; div.page>h2 3 +; div.page>p 47 +; div.page>p 2 +; div.tags>li 1/1 -x4; div.bottom>p 8/3 -
div>li 2/2 -x4; div>h1 5 +; div>div 64 +; div>div 39 +; div>div 5 +; div>div 80/6 +; div>li 3/3 -x3; div>p 6/1 -
nav.main-nav>li 3/3 -x6; main>h1 7 +; main>p 22 +; main>ul>li 9 +x4; main>p 41 +; main>ul>li 4/4 -x6; footer>li 2/2 -x5; footer>p 7 -
div.cookie-consent>p 24/2 -; div.cookie-consent>p 2/2 -; header>p 3/3 -; div.story>h1 9 +; div.story>p 58 +; div.story>p 12 +; div.story>p 70/2 +; div.advert-box>p 14/1 -; div.story>p 35 +; div.share-links>li 1/1 -x4
table>tr>td 2/2 -x5; table>tr>td 110/3 +; table>tr>td 75 +; table>tr>td 3/3 -x4; table>tr>td 7 -
article>header>h1 10 +; article>header>p 4 +; article>p 90 +; article>p 55 +; article>section.newsletter-signup>p 19 -; article>form>p 5 -; article>p 28 +; article>div.related-items>li 7/7 -x3; article>footer>p 6/2 -
div.layout>div#social-history>h2 3 +; div.layout>div#social-history>p 66 +; div.layout>div#social-history>p 40/2 +; div.layout>div#social-history>p 8 +; div.layout>ul.menu>li 2/2 -x6
div#notice-of-sale>h1 5 +; div#notice-of-sale>p 48 +; div#notice-of-sale>p 21 +; div#notice-of-sale>p 4 +; div.notice>p 17 -; div.foot>li 1/1 -x4
div.search-help-links>li 3/3 -x3; div.doc>h1 4 +; div.doc>p 27 +; div.doc>pre 31 +; div.doc>p 11 +; div.doc>pre 6 +; div.doc>p 36/5 +; div.search-help-links>li 4/4 -x2
div.teasers>article>h3 5/5 -; div.teasers>article>p 11/11 -; div.text>h1 6 +; div.text>p 73 +; div.text>p 44 +; div.text>p 16 +; div.text>p 95/3 +; div.footer>p 5/1 -
article>h3 4/4 -; article>p 9 +; div.body>h1 7 +; div.body>p 62 +; div.body>p 37 +; div.body>p 81 +; div.body>p 6 +
p 120 +; p 45 +; p 3 +
pre 200 +
p 26 +
div 55/4 +; div 34 +; ul>li 2/2 -x5
h1 4 +; p 38 +; h2 2 +; p 29 +; h2 3 +; p 51/3 +; hr>p 3/3 -x2
main>article>h1 6 +; main>article>p 33/33 +; main>article>p 47 +; main>article>p 24/9 +; main>article>h2 4/4 +; main>article>p 58 +; main>aside>p 30 -; main>aside>p 12/2 -
div.nav-bar>li 1/1 -x6; div.wiki>h1 2 +; div.wiki>p 60/14 +; div.wiki>p 44/12 +; div.wiki>h2 1 +; div.wiki>p 38/10 +; div.wiki>ul>li 8/3 +x4; div.wiki>h2 2 -; div.wiki>ul>li 5/5 -x5; div.wiki>div.navigation>li 2/2 -x6
article>h1 5 +; article>p 2 +; article>p 6 +; article>p 1 +; article>p 9 +; article>p 3 +; footer>p 11 -; footer>p 20/4 -
main>h1 3 +; main>p 14 +; main>p 7 +; div.comments-area>h3 2 -; div.comments-area>p 60 -; div.comments-area>p 8 -; div.comments-area>p 33/1 -
div.widget>h3 2 -; div.widget>li 3/3 -x5; div.post>h1 9 +; div.post>p 49 +; div.post>p 31 +; div.reply-form>p 6 -; div.widget>p 22 -; div.widget>p 5/5 -
article>p 64 +; article>blockquote>p 20 +; article>p 39 +; article>figure>figcaption 9 +; article>p 52 +; div.comment>p 18 -; div.comment>p 70 -; div.comment>p 4 -
nav>li 4/4 -x3; div>p 4 -; div>p 3/2 -; div>p 6/4 -; div>li 5/5 -x8; div>p 5 -
div.banner>p 10/1 -; div.grid>div>p 8/8 -x6; div.grid>div>p 3 -; footer>p 14/3 -
div.login>p 5 -; div.login>p 3/3 -; div.popup>p 28 -; article>h1 6 +; article>p 15 +; article>p 57 +; article>p 5 +
main>dl>dt 2 +; main>dl>dd 25 +; main>dl>dt 1 +; main>dl>dd 34/2 +; main>dl>dt 3 +; main>dl>dd 19 +; nav.pagination>li 1/1 -x3
article>h1 12 +; article>p 12 +; article>p 150 +; article>p 4 +; article>table>tr>td 1 +x6; article>p 65 +; article>ul>li 3/3 -x5; div.sponsor>p 35/1 -
div>p 2/2 -; div>p 70/2 +; div>p 3/3 -; div>p 60 +; div>p 1/1 -; div>p 85/1 +; div>p 2/2 -
ul>li 2/2 -x5; div>p 74 +
div>li 3/3 -x3; div>p 22 +
div.links>li 2/2 -x4; div.main>p 18 +; div.main>p 130 +; ul>li 1/1 -x3; p 9 -
nav>li 1/1 -x4; main>p 40 +; div>li 2/2 -x2; div>p 5 -
ul>li 4/4 -x4; p 35 +; ul>li 3/3 -x4; p 28 +
nav>li 1/1 -x4; article>h1 3 +; article>p 5 +
article>p 4 +
div.consent>p 18 -; main>p 3 +
article>p 1 +; article>p 6 +; article>p 2 +
main>p 55 +; main>p 7 +
section>h2 4 +; section>p 41 +; section>h2 3 +; section>p 53 +; section.promo>h2 4 -; section.promo>p 29/2 -; section>h2 5 +; section>p 37 +
"""


def training_pages() -> list[tuple[str, list[int]]]:
    """(html, labels of its blocks) of TRAINING_PAGES."""
    pages = []
    for line in TRAINING_PAGES.strip().splitlines():
        out, labels, open_ = ["<html><body>"], [], []
        for part in line.split(";"):
            place, size, label = part.split()
            path = place.split(">")
            n, linked = ([int(x) for x in size.split("/")] + [0])[:2]
            for _ in range(int(label[2:] or 1)):
                same = 0
                while same < min(len(open_), len(path) - 1) and open_[same] == path[same]:
                    same += 1
                for gone in reversed(open_[same:]):
                    out.append(f"</{re.split('[.#]', gone)[0]}>")
                for new in path[same:]:
                    out.append("<" + re.sub(r"#(\S+)", r' id="\1"', re.sub(r"\.(\S+)", r' class="\1"', new)) + ">")
                words = ["words"] * n
                text = "<a href='x'>" + " ".join(words[:linked]) + "</a> " + " ".join(words[linked:]) if linked else " ".join(words)
                out.append(f"{text}</{re.split('[.#]', path[-1])[0]}>")
                open_ = path[:-1]
                labels.append(int(label[0] == "+"))
        out += [f"</{re.split('[.#]', gone)[0]}>" for gone in reversed(open_)]
        pages.append(("".join(out), labels))
    return pages


def labelled_table(pages: list[tuple[str, list[int]]] | None = None) -> np.ndarray:
    """Values of FEATURES, then 1 for main text, of the blocks of labelled pages."""
    rows = []
    for html, labels in training_pages() if pages is None else pages:
        x = features_of(blocks_of(html))
        rows.append(np.column_stack([x, np.array(labels, float)]))
    return np.concatenate(rows)


class DecisionTree:
    """A binary classification tree grown by Gini impurity on a table of numbers; the same table gives the same tree."""

    def __init__(self, depth: int = 8, leaf: int = 2) -> None:
        self.depth, self.leaf, self.root = depth, leaf, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.root = self._grow(np.asarray(x, float), np.asarray(y, float), self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean())
        if depth == 0 or share in (0.0, 1.0):
            return share
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                n = int(left.sum())
                if min(n, len(y) - n) < self.leaf:
                    continue
                a, b = y[left].mean(), y[~left].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
        if best is None:
            return share
        _, f, cut = best
        left = x[:, f] <= cut
        return (f, cut, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, float):
                out[rows] = node
            else:
                f, cut, low, high = node
                left = x[rows, f] <= cut
                todo += [(low, rows[left]), (high, rows[~left])]
        return out

    def paths(self, x: np.ndarray) -> list[list[int]]:
        """The features that each row's path through the tree asks for, in order."""
        out = []
        for row in x:
            node, path = self.root, []
            while not isinstance(node, float):
                f, cut, low, high = node
                path.append(f)
                node = low if row[f] <= cut else high
            out.append(path)
        return out


@cache
def block_tree() -> DecisionTree:
    table = labelled_table()
    return DecisionTree().fit(table[:, :-1], table[:, -1])


def main_text(html: str | None) -> str:
    """The blocks that the tree keeps, a line each."""
    blocks = blocks_of(html or "")
    keep = block_tree().predict(features_of(blocks)) >= 0.5
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        # lone surrogates can come from numeric references; they have no place in a text
        texts = [t if t.isascii() else t.encode("utf-8", "replace").decode("utf-8") for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages.

    pages: page_id, url, html. Each page is read whole. Blocks have their character references decoded, white space
    made one space and ends trimmed; they are joined in page order by a newline. A null or empty html, and a page
    without main text, give the empty text. Null ids and urls come back as they are, repeated pages each give a row, extra columns
    are ignored.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
