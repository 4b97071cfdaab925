"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between the tags of block elements, each with its tag
path, the block elements from the root down with their classes and ids. Inline tags belong to
their block. For every path the text length and the punctuation of its blocks are summed and
divided by the number of blocks (text in links does not count). The two ratios are smoothed
over neighbouring blocks in page order, averaged by path again, fused as a geometric mean, and
paths whose fused value reaches a share of the text-weighted mean of the page are content.

Two things the ratios cannot tell are read from the paths themselves. Blocks below elements
that say they are something else (``NOISE_TAGS``, or a class, id or role among ``NOISE_WORDS``:
comments and notices are long sentences too) take no part. Where a page marks its article
(``article``, ``main``), only blocks below it take part, and the bar is lower there, so that
short blocks of the article stay and lists of links go.

Pages are judged one by one, so the work is one pass without a shuffle, and a page never
depends on the others of a task.

Defined results: a null or empty page has an empty text. Unclosed and misnested tags are
read as browsers do in the common cases: a block ends a paragraph, an end tag ends what is
open below it, comments, scripts and quotes that never end run to the end of the page. White
space, also the no-break space, becomes one space; ``br`` is white space. Rows with equal ids
are judged one by one; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .frames import bounded

# Elements of HTML by what they do to the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
NOISE_TAGS = frozenset(
    "head script style textarea title iframe noembed noframes noscript template nav footer aside form fieldset button select option "
    "optgroup datalist dialog menu search object svg math canvas audio video input label legend".split()
)
CONTROLS = frozenset("button select input label".split())  # seen as gaps in a line

# Words that classes, ids and roles use for what is not the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot dfp sponsor sponsored promo promoted promotion banner "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay toast paywall "
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs crumbs pager pagination toc toolbar topbar masthead "
    "sidebar sidebars aside rail widget widgets footer foot colophon copyright legal imprint disclaimer "
    "comment comments commentlist reply replies respond disqus discussion reader feedback "
    "share sharing social follow subscribe subscription newsletter signup login signin register search form "
    "related recommended recommendations outbrain taboola tags hidden invisible contentinfo complementary alertdialog".split()
)
HEADER_WORDS = frozenset("header head hdr".split())  # noise only outside the article
#: Words after which a noise word says what the element lacks, offers or lays out.
PLAIN_AFTER = frozenset("no without has with".split())
PLAIN_BEFORE = frozenset("open closed on off enabled disabled wrap wrapper layout".split())
MAIN_WORDS = frozenset("article post entry story content main articlebody body".split())
PUNCTUATION = re.compile("[,.;:!?\"'()«»‘-‟…–—、。！，：；？।؟،]")

TAG = re.compile(
    r"<(?:(?P<open>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|/(?P<close>[A-Za-z][^\s/>]*)[^>]*+>"
    r"|(?P<comment>!--)|(?P<other>[!?/][^>]*+>)|(?P<torn>[A-Za-z][^\s/>]*)(?P<rest>[^>]*+)>)"  # torn: a quote never ends
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: What a start tag ends: open elements of these names, up to the nearest of the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


@dataclass(frozen=True)
class ExtractOptions:
    share: float = 0.4  # of the page's mean that a path must reach
    smoothing: tuple[float, ...] = (0.25, 0.5, 0.25)
    in_article: float = 16.0  # how much a path counts for below an article,
    in_main: float = 4.0  # below a main element or one with such a class,
    heading: float = 2.0  # and as a heading


@dataclass
class Open:
    name: str
    path: int
    noise: bool
    marked: int  # 0 nothing, 1 named like the main part, 2 main, 3 article
    block: bool


@dataclass
class Block:
    path: int
    text: str
    linked: int  # characters in links
    marked: int


class Page:
    """Blocks of one page in order; paths are numbers, equal for equal paths."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.stack = [Open("", 0, False, 0, True)]
        self.counts: dict[str, int] = {}
        self.parts: list[str] = []
        self.links: list[str] = []
        self.in_link = 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at = 0
        end = len(source)
        last = source.rfind(">") + 1  # no tag ends after it
        while at < end:
            found = TAG.search(source, at, last) if at < last else None
            if found is None:
                cut = re.compile("<[A-Za-z/!?]").search(source, at)
                self._text(source[at : cut.start() if cut else end])
                return
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = (found["open"] or found["torn"] or "").lower()
            if name:
                attributes = found["attributes"] or found["rest"] or ""
                closed = attributes.endswith("/")
                self._start(name, attributes)
                if name in RAW and not closed:
                    at = self._raw_end(source, at, name)
                    self._end(name)
            elif found["close"]:
                self._end(found["close"].lower())
            elif found["comment"]:
                # <!--> and <!---> are whole comments
                short = re.compile(r"-?>").match(source, at)
                close = source.find("-->", at)
                at = short.end() if short else end if close < 0 else close + 3

    def _raw_end(self, source: str, at: int, name: str) -> int:
        found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
        return len(source) if found is None else found.end()

    def _text(self, text: str) -> None:
        if self.stack[-1].noise:
            return
        text = html.unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.in_link:
            self.links.append(text)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(top.path, text, len(" ".join("".join(self.links).split())), top.marked))
        self.parts.clear()
        self.links.clear()

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCKS:
            self._flush()
            if self.counts.get("p"):
                self._close({"p"}, {"td", "th", "button", "object"})
            if name in ENDS:
                self._close(*ENDS[name])
        if name in VOID:
            return
        top = self.stack[-1]
        known = describe(attributes) if attributes.strip(" /\t\n\r\f") else ([], set(), False)
        words, labels, gone = known
        marked = top.marked
        if name == "article" or "articlebody" in labels:
            marked = 3
        elif name == "main" or "role=main" in labels:
            marked = max(marked, 2)
        elif MAIN_WORDS & set(words):
            marked = max(marked, 1)
        noise = top.noise or gone or name in NOISE_TAGS or name == "header" and top.marked < 2
        if not noise and name not in ("html", "body"):
            noise = noisy(words, top.marked >= 2, name in ("article", "main"))
        block = name in BLOCKS
        if name in CONTROLS and not top.noise:
            self.parts.append(" ")
        path = top.path
        if block:
            label = ".".join([name, *sorted(labels)])
            path = self.paths.setdefault((path, label), len(self.paths) + 1)
        self.stack.append(Open(name, path, noise, marked, block))
        self.counts[name] = self.counts.get(name, 0) + 1
        self.in_link += name == "a"

    def _close(self, names: set[str], bounds: set[str]) -> None:
        """End the elements of these names, and what is open in them, up to the nearest bound."""
        if not any(self.counts.get(n) for n in names):
            return
        last = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in bounds:
                break
            if self.stack[i].name in names:
                last = i
        if last is not None:
            self._pop(last)

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            gone = self.stack.pop()
            self.counts[gone.name] -= 1
            self.in_link -= gone.name == "a"

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if self.counts.get(name):
            at = len(self.stack) - 1
            while self.stack[at].name != name:
                at -= 1
            # an inline end tag ends no block
            if name in BLOCKS or not any(e.block for e in self.stack[at + 1 :]):
                self._pop(at)


def describe(attributes: str) -> tuple[list[str], set[str], bool]:
    """Words of class, id and role in order; labels for the path; whether the element is hidden."""
    words: list[str] = []
    labels: set[str] = set()
    gone = False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            words += [w.lower() for w in WORDS.findall(value)]
            # numbers count elements of one kind
            labels |= {re.sub("[0-9]+", "0", v) for v in value.split()} if key == "class" else set()
        elif key == "role":
            words.append(value.lower())
            labels.add(f"role={value.lower()}")
        elif key == "itemprop" and value.lower() == "articlebody":
            labels.add("articlebody")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            gone = True
    return words, labels, gone


def noisy(words: list[str], inside: bool, article: bool) -> bool:
    vocabulary = {"comment", "comments", "reply", "related", "sponsored", "promo", "ad", "advert"} if article else NOISE_WORDS
    for i, w in enumerate(words):
        if w in vocabulary or not inside and not article and w in HEADER_WORDS:
            if not (i and words[i - 1] in PLAIN_AFTER) and not (i + 1 < len(words) and words[i + 1] in PLAIN_BEFORE):
                return True
    return False


def smoothed(values: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """Weighted means over neighbours; beyond the ends the last value goes on."""
    side = len(weights) // 2
    return np.convolve(np.pad(values, side, mode="edge"), weights, "valid")


def content(page: Page, options: ExtractOptions) -> list[Block]:
    """The blocks whose paths are content."""
    blocks = page.blocks
    if any(b.marked >= 2 for b in blocks):
        blocks = [b for b in blocks if b.marked >= 2]
    if not blocks:
        return []
    _, path = np.unique([b.path for b in blocks], return_inverse=True)
    number = np.bincount(path)
    chars = np.array([len(b.text) for b in blocks], float)
    free = np.maximum(chars - [b.linked for b in blocks], 0)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    text_ratio = np.bincount(path, free) / number
    mark_ratio = np.bincount(path, np.where(free > 0, marks, 0)) / number
    text_ratio = np.bincount(path, smoothed(text_ratio[path], options.smoothing)) / number
    mark_ratio = np.bincount(path, smoothed(mark_ratio[path], options.smoothing)) / number
    unlinked = np.bincount(path, free) / np.bincount(path, chars)
    fused = np.sqrt(text_ratio * unlinked * (mark_ratio + 0.5))
    weight = np.array([1.0, options.in_main, options.in_main, options.in_article])[[b.marked for b in blocks]]
    heads = {i for (_, label), i in page.paths.items() if re.match(r"h[1-6](\.|$)", label)}
    weight *= np.where([b.path in heads for b in blocks], options.heading, 1.0)
    mean = float((fused[path] * chars).sum() / chars.sum())
    kept = (fused[path] * weight >= options.share * mean) & (unlinked[path] > 0)
    if not kept.any():  # nothing but links
        kept = np.array([b.marked == 3 for b in blocks])
    return [b for b, k in zip(blocks, kept) if k]


def main_text(source: str | None, options: ExtractOptions = ExtractOptions()) -> str:
    return "\n".join(b.text for b in content(Page(source or ""), options))


def extract(pages: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    source = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch, "html"):
                texts = [main_text(x.as_py(), options) for x in piece.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return bounded(source).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
