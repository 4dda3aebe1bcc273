"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Pass one labels each block by itself from its length, its stop-word
density, its link density and the region of markup that it stands in: good, bad, or undecided (too short to tell, or long
without stop words inside an article). Pass two gives every undecided block the label of its nearest decided neighbours;
crossing from one region of the page into another counts as a long way. The good blocks are the text.

Regions such as navigation, asides, footers, forms, adverts, notices and reader comments are always bad, as are hidden
elements; scripts, styles and other raw elements aren't blocks at all. The stop words are those of four languages; blocks of
other scripts, and pages on which no block has enough stop words, are judged by length, links and sentence ends instead. Null and empty pages, and pages without a block,
give the empty text. A page without any decided block keeps what stands in an article or main element, else nothing but
blocks outside bad regions. Equal pages give equal texts; pages of any length are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import text_of

#: Element names of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noframes noembed template xmp".split())
MUTED = frozenset("select button datalist svg math canvas audio video object applet map".split())
BAD_TAGS = frozenset("nav aside footer form menu dialog head".split())
CONTAINERS = BLOCK - HEADING - frozenset("p hr li dd dt td th tr option optgroup caption legend figcaption summary pre address".split())
#: Blocks whose end tag may be left out.
ENDED = frozenset("p li dd dt td th tr option optgroup".split())
#: Words in class, id or role that mark what isn't the article.
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay menu "
    "nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead topbar comment comments discussion respond disqus reply replies share sharing social related recommended "
    "subscribe subscription newsletter signup login search pagination pager widget toolbar contentinfo complementary toc".split()
)
LAYOUT = frozenset("has with no without".split())
#: Common function words of English, French, German and Spanish.
STOP = frozenset(
    "the of and to in is that it for was on are as with be by at or an a this from not have which he they you we his but had were been their has "
    "de la le et les des en un du une que est pour qui dans par sur au avec il ce pas plus ne se son sont aux ou "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am "
    "el y los del las una por con para su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta".split()
)
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.25
MAX_LINKS = 0.33
FAR = 1000

_TOKEN = re.compile(
    r"""<!--(?P<note>.*?)(?:--!?>|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: Latin letters, those with marks included.
_LATIN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]")
#: A sentence's end, with what may close after it.
_ENDS = re.compile(r"[.!?…。！？।؟۔։။។]\W*$")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    region: int  # of the innermost container
    bad: bool  # stands in a bad region
    article: bool  # stands in an article or main element
    heading: bool
    linked: int = 0
    label: str = ""


def _marked(name: str, attrs: str, article: bool) -> bool:
    """Whether the element's own markup says that it isn't part of the article.

    ``has-sidebar`` and the like tell of a layout, not of the element; a header inside an article belongs to it.
    """
    if not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDING.search(value)):
            return True
        if key in ("class", "id", "role") and name not in ("html", "body", "main", "article"):
            for one in value.split():
                words = [w.lower() for w in _SPLIT.split(one)]
                for before, word in zip(["", *words], words, strict=False):
                    if word in BAD_WORDS and before not in LAYOUT and not (article and word == "header"):
                        return True
    return False


def blocks_of(html: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, region, bad, article
    text: list[str] = []
    linked, link, heading, regions, muted = 0, False, False, 0, ""
    at = 0

    def flush() -> None:
        nonlocal linked
        own = " ".join("".join(text).split())
        if own:
            _, region, bad, article = stack[-1]
            out.append(Block(own, region, bad, article, heading, linked))
        text.clear()
        linked = 0

    def say(raw: str, plain: bool = False) -> None:
        nonlocal linked
        if raw and not muted:
            got = raw if plain else unescape(raw)
            text.append(got)
            linked += len("".join(got.split())) if link else 0

    while True:
        m = _TOKEN.search(html, at)
        say(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if m["data"] is not None:
            say(m["data"], plain=True)
        if not m["name"]:
            continue
        name, closing = m["name"].lower(), bool(m["end"])
        if muted:
            muted = "" if closing and name == muted else muted
            continue
        if name in RAW and not closing:
            ends = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            if not ends:
                break
            at = html.find(">", ends.start()) + 1 or len(html)
        elif name in MUTED and not closing:
            muted = "" if m["attrs"].endswith("/") else name
        elif name == "a":
            link = not closing
        elif name == "br":
            text.append(" ")
        elif name in BLOCK:
            flush()
            link = False
            heading = name in HEADING and not closing
            if closing:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                del stack[depth or len(stack) :]
                continue
            if stack[-1][0] in ENDED and (stack[-1][0] == "p" or stack[-1][0] == name):
                stack.pop()  # a paragraph ends where the next block starts, an item where the next item does
            if name == "body":
                del stack[1:]
            marked = name not in VOID and _marked(name, m["attrs"], stack[-1][3])
            if name in CONTAINERS or marked:
                _, _, bad, article = stack[-1]
                regions += 1
                bad = bad or marked or name in BAD_TAGS or (name == "header" and not article)
                stack.append((name, regions, bad, article or name in ("article", "main")))
        elif name in ("span", "ins", "amp-ad") and not closing and _marked(name, m["attrs"], stack[-1][3]):
            flush()
            regions += 1
            stack.append((name, regions, True, stack[-1][3]))
        elif closing and stack[-1][0] == name:
            flush()
            stack.pop()
    flush()
    return out


def _other_script(block: Block) -> bool:
    return not block.text.isascii() and 2 * len(_LATIN.findall(block.text)) < sum(map(str.isalpha, block.text))


def long_unlinked(block: Block) -> bool:
    """Whether the block has the length of a paragraph and few links. An ideograph tells as much as three letters."""
    letters = "".join(block.text.split())
    weight = len(letters) + (0 if letters.isascii() else 2 * sum("⺀" <= ch <= "힣" for ch in letters))
    return weight >= SHORT and block.linked <= MAX_LINKS * len(letters)


def sentences(block: Block) -> bool:
    """Whether a block of a language without a stop-word list reads like a paragraph: long, few links, ended by a full stop."""
    return long_unlinked(block) and bool(_ENDS.search(block.text))


def first_pass(block: Block, fits: bool = True) -> str:
    """good, bad, or the empty string where the block alone can't tell.

    ``fits``: whether the stop-word lists fit the page's language. Where they don't, and in blocks of other scripts, low
    density says nothing: sentences are good, other blocks undecided.
    """
    if block.bad:
        return "bad"
    letters = len("".join(block.text.split()))
    if block.linked > MAX_LINKS * letters:
        return "" if block.article and block.linked < letters else "bad"
    if block.heading:
        return ""
    known = fits and not _other_script(block)
    if not known and sentences(block):
        return "good"
    if letters < SHORT:
        return ""
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP for w in words) / max(len(words), 1)
    if stops >= STOPS_HIGH or (stops >= STOPS_LOW and (letters >= LONG or block.article)):
        return "good"
    return "" if block.article or not known or stops >= STOPS_LOW else "bad"


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided one; of two as near the good one wins in an article."""
    n = len(blocks)
    near: list[list[tuple[int, str]]] = [[], []]
    for side, order in enumerate((range(n), range(n - 1, -1, -1))):
        labels: list[tuple[int, str]] = [(1 << 30, "")] * n
        gap, label, region = 1 << 30, "", -1
        for i in order:
            b = blocks[i]
            gap += 1 if (b.region, b.article) == region else FAR
            region = (b.region, b.article)
            if b.label:
                gap, label = 0, b.label
            labels[i] = (gap, label)
        near[side] = labels
    for i, b in enumerate(blocks):
        if b.label:
            continue
        (left, a), (right, c) = near[0][i], near[1][i]
        if not a and not c:
            decided = "good" if b.article or not any(x.article for x in blocks) else "bad"
        elif a == c or not c or (a and left < right):
            decided = a
        elif not a or right < left:
            decided = c
        else:
            decided = "good"
        # Only bad regions around: nothing inside an article speaks against the block.
        # A paragraph of an article doesn't go with the links beside it.
        if decided == "bad" and b.article and (min(left, right) >= FAR or (not b.heading and long_unlinked(b))):
            decided = "good"
        b.label = decided


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    for b in blocks:
        b.label = first_pass(b)
    if not any(b.label == "good" and not _other_script(b) for b in blocks):
        for b in blocks:
            b.label = first_pass(b, fits=False)
    second_pass(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def main_text_of(column: str = "html") -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return F.pandas_udf(run, "string")(text_of(column))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select("page_id", "url", main_text_of("html").alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
