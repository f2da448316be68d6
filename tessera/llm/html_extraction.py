"""Main text of web pages: two-pass block rules, with the page's own structure as evidence.

A page is cut into blocks at block-level tags.  First pass: every block is judged by link density, length and stop-word
density as good, bad, near-good, short or a short heading.  The page's structure is a prior: blocks in regions that are
boilerplate by tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms, comments) are bad; where
the page names its article, and most of its running text stands there, blocks outside it are no candidates, and inside it neither links nor shortness count against
a block: it is ambiguous at worst.  Few stop words alone make no block bad (code, tables and names have few), and on a
page whose text is in no language of ``STOP_WORDS`` they say nothing: length decides there, ideographs counting as
words.  Second pass: ambiguous blocks inherit from their nearest decided neighbours: a short one from the nearest, a
heading from the one below it, a near-good one is good if either is.

Character references are decoded, white space in a block becomes one space, and good blocks are joined in page order
by one newline.

Defined results: a null or empty page has the empty text; markup that is cut off or badly nested is read as far as it
goes; repeated rows give equal texts; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

MAX_LINK_DENSITY = 0.33
SHORT_CHARS, LONG_CHARS = 70, 200
STOP_HIGH = 0.3
#: Blocks between a heading and the text below it.
HEADING_REACH = 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Frequent function words of the languages served.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can do for from had has have he her his i if in into is it its just like more no not of on one
    or our out she so some such than that the their them then there they this to up was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous
    als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war wie wir zu zum zur über
    al como con cuando del donde el ella ellos era esta este esto están fue ha hay las lo los más me mi muy no nos o para pero por porque quien sin sobre son su sus también te tiene todo unos y ya""".split()
)
#: Elements that end a block; elements without content of their own; elements whose content is not text.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup
    hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|textarea|select|iframe|object|canvas|svg|math|audio|video|title|button"
BAD_TAGS = frozenset("nav footer aside form dialog menu head fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar tablist toolbar status".split())
BAD_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay alert
    newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar header share sharing social related
    recommended widget pagination pager tags byline skip disclaimer""".split()
)
#: Words that say nothing of what a box holds: "comment-list" is a class of comments, "related-work" is not one of boilerplate.
BOX_WORDS = frozenset("area bar block body box buttons container content inner items link links list outer posts section thread wrap wrapper".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus discussion reader".split())
GOOD_WORDS = frozenset("article content main post entry story body text".split())
#: Words that make a box within an article no part of it wherever a class begins or ends with them ("ad-slot", "user-comments").
ADVERT_ENDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup popup modal share sharing social".split()
)
COMMENT_ENDS = frozenset("comment comments commentlist disqus replies".split())
#: Boxes of other pieces: what they begin with, and what follows it ("related-articles", but not "related-work").
LEADS, PIECES = frozenset("related recommended more read up also trending popular".split()), frozenset("article articles story stories post posts news reading next also more topics videos".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?![\w:-])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>|<({RAW_TAGS})(?![\w:-])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_NAME_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_IDEOGRAPH = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_NONE, _GOOD, _BAD, _COMMENT, _LIKELY = 0, 1, 2, 3, 4
#: Labels of what an element says is the article: by its tag or role, or by a class or id alone.
_MARKED = (_GOOD, _LIKELY)


def _of_one_kind(values: str, kind: frozenset[str]) -> bool:
    """Whether one of the names, as a whole, is of a kind: it has a word of it and else only such words and box words."""
    for value in values.split():
        parts = set(_NAME_PART.findall(value))
        if parts & kind and parts <= kind | BOX_WORDS:
            return True
    return False


def _ends_with(values: str, ends: frozenset[str]) -> bool:
    """Whether a name begins or ends with one of the words."""
    return any(parts[0] in ends or parts[-1] in ends for parts in map(_NAME_PART.findall, values.split()) if parts)


def _other_pieces(values: str) -> bool:
    """Whether a name is one of a box that leads to other pieces."""
    return any(len(parts) > 1 and parts[0] in LEADS and set(parts[1:]) <= PIECES | BOX_WORDS and parts[1] in PIECES for parts in map(_NAME_PART.findall, values.split()))


def region(tag: str, attributes: str, above: int = _NONE) -> int:
    """What an element says about the blocks inside it.

    Elsewhere any word of a class or id counts; in an article an id is only an anchor ("side-effects"), and a class counts
    as a whole or by how it begins and ends; of an article itself classes and ids count as wholes.
    """
    names: set[str] = set()
    role = whole = ""
    strict = above in _MARKED or tag in ("article", "main")
    boxed = above in _MARKED and tag not in ("article", "main")
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                names.update(_NAME_PART.findall(value))
                if key == "class" or above not in _MARKED:
                    whole += f" {value}"
            elif key == "role":
                role = value
            elif key == "itemprop" and value == "articlebody":
                names.add("article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                return _BAD
    named = tag not in ("body", "html")
    if named and (_of_one_kind(whole, COMMENT_WORDS) or (boxed and _ends_with(whole, COMMENT_ENDS)) if strict else names & COMMENT_WORDS):
        return _COMMENT
    if tag in BAD_TAGS or role in BAD_ROLES:
        return _BAD
    if tag in ("article", "main") or role in ("main", "article"):
        return _GOOD
    if named and (_of_one_kind(whole, BAD_WORDS) or (boxed and (_ends_with(whole, ADVERT_ENDS) or _other_pieces(whole))) if strict else names & BAD_WORDS):
        return _BAD
    if tag == "header":
        return _BAD
    if names & GOOD_WORDS and tag in ("div", "section", "td"):
        return _LIKELY
    return _NONE


class Block:
    """Text of one block, its part in links, and its region's label."""

    __slots__ = ("label", "linked", "parts", "tag")

    def __init__(self, label: int, tag: str):
        self.parts: list[str] = []
        self.linked = 0
        self.label = label
        self.tag = tag


def blocks_of(page: str) -> list[tuple[str, int, int, str]]:
    """(text, linked characters, label, tag) of each block with text."""
    out: list[tuple[str, int, int, str]] = []
    stack: list[tuple[str, int]] = [("", _NONE)]
    block = Block(_NONE, "")
    links = 0
    broke = False
    at = 0

    def flush(label: int, tag: str) -> Block:
        text = " ".join("".join(block.parts).split())
        if text:
            out.append((text, min(block.linked, len(text)), block.label, block.tag))
        return Block(label, tag)

    def add(raw: str) -> None:
        text = _html.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if links:
            block.linked += len(" ".join(text.split()))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            if not raw.isspace():
                broke = False
            add(raw)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                if tag in BLOCK_TAGS or any(t in BLOCK_TAGS for t, _ in stack[depth:]):
                    del stack[depth:]
                    links = 0 if tag in BLOCK_TAGS else links
                    block = flush(stack[-1][1], tag)
                else:
                    del stack[depth:]
            elif tag in BLOCK_TAGS:
                block = flush(stack[-1][1], tag)
            continue
        if tag == "br":
            if broke:
                block = flush(stack[-1][1], block.tag)
            else:
                block.parts.append(" ")
            broke = not broke
            continue
        if tag == "a":
            links += 1
        if tag in BLOCK_TAGS:
            links = 0
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
                same = ("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag[0] in "ph" else (tag, "p")
                while len(stack) > 1 and (stack[-1][0] in same or stack[-1][0] not in BLOCK_TAGS):
                    stack.pop()
            above = stack[-1][1]
            own = region(tag, m[4] or "", above)
            if above == _COMMENT:
                label = _COMMENT
            elif own == _NONE:
                label = above
            elif own in _MARKED and above == _BAD and not (tag in ("article", "main")):
                label = _BAD
            elif (tag == "header" and above in _MARKED) or (own == _LIKELY and above == _GOOD):
                label = above
            else:
                label = own
            if tag not in VOID_TAGS:
                stack.append((tag, label))
            block = flush(label, tag)
        elif tag not in VOID_TAGS and not (m[4] or "").endswith("/"):
            above = stack[-1][1]
            own = region(tag, m[4] or "", above) if m[4] else _NONE
            label = own if own in (_BAD, _COMMENT) and above != _COMMENT else above
            stack.append((tag, label))
            if label != above:
                block = flush(label, tag)
    if at < len(page):
        add(page[at:])
    flush(_NONE, "")
    return out


def weight(text: str) -> int:
    """Characters, as many as a text of the same content has in Latin letters: an ideograph stands for about three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_IDEOGRAPH.findall(text))


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words)."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def recognised(blocks: list[tuple[str, int, int, str]]) -> bool:
    """Whether the unmarked text of a page is in a language of ``STOP_WORDS``."""
    stop = n = 0
    for text, linked, label, _ in blocks:
        if label in (_NONE, *_MARKED) and linked <= MAX_LINK_DENSITY * len(text) and weight(text) >= SHORT_CHARS:
            own = stop_words(text)
            stop, n = stop + own[0], n + own[1]
    return stop >= STOP_HIGH * n


def first_pass(text: str, linked: int, label: int, tag: str, known: bool = True) -> str:
    """good, bad, near or short, by link density, length and stop words; ``known``: the page is in a language of
    ``STOP_WORDS``.

    The region is a prior: boilerplate regions are bad; in an article links alone make no block bad, but ambiguous.
    """
    if label in (_BAD, _COMMENT):
        return "bad"
    within = label in _MARKED
    linking = linked > MAX_LINK_DENSITY * len(text)
    if not within and (linking or text.startswith("©")):
        return "bad"
    size = weight(text)
    if size < SHORT_CHARS and not within:
        return "heading" if tag in HEADINGS else "short"
    if linking or size < SHORT_CHARS:
        return "near"
    stop, n = stop_words(text)
    if size >= LONG_CHARS and (not known or (n and stop / n >= STOP_HIGH)):
        return "good"
    return "near"


def second_pass(labels: list[str]) -> list[bool]:
    """Whether each block is main text, after ambiguous ones have looked to their nearest decided neighbours.

    Equal distances: near-good blocks and headings are good, short ones bad.  A heading looks down the page first.
    Without any decided block near-good ones are good.
    """
    n = len(labels)
    none = n + 1
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        at, label, held = -none, "", [("", none)] * n
        for k in order:
            held[k] = (label, abs(k - at) if label else none)
            if labels[k] in ("good", "bad"):
                at, label = k, labels[k]
        sides.append(held)
    out = []
    for label, (above, up), (below, down) in zip(labels, *sides):
        if label in ("good", "bad"):
            out.append(label == "good")
        elif label == "near":
            out.append("good" in (above, below) or not (above or below))
        elif label == "heading" and below:
            out.append(below == "good" and (up >= down or above == "good" or down <= HEADING_REACH))
        elif up == down:
            out.append(above == below == "good")
        else:
            out.append((above if up < down else below) == "good")
    return out


def article_of(blocks: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """The candidates: a mark counts only if it holds most of the text.

    Running text (long enough, not of links, in no boilerplate region) is weighed inside and outside of marks.  A mark by tag or role is believed
    first, then marks by class or id with it; where most stands outside of all of them, they say nothing.
    """
    held = {_GOOD: 0, _LIKELY: 0, _NONE: 0}
    for text, linked, label, tag in blocks:
        if label in held and linked <= MAX_LINK_DENSITY * len(text) and (size := weight(text)) >= SHORT_CHARS and tag not in HEADINGS and not text.startswith("©"):
            held[label] += size
    marked = {label for _, _, label, _ in blocks if label in _MARKED}
    if _GOOD in marked and held[_GOOD] >= held[_LIKELY] + held[_NONE]:
        return [b for b in blocks if b[2] == _GOOD]
    if marked and held[_GOOD] + held[_LIKELY] >= held[_NONE]:
        return [b for b in blocks if b[2] in _MARKED]
    return [(text, linked, _NONE if label in _MARKED else label, tag) for text, linked, label, tag in blocks]


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    found = article_of(blocks_of(page))
    known = recognised(found)
    keep = second_pass([first_pass(*b, known) for b in found])
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return rows.mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")
