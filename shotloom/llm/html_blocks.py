"""Leaf text blocks of a web page, with their paths of elements.

A forgiving reader: unknown and inline elements do not break a block, missing end tags are implied, raw-text elements
are skipped whole.  Text of formulas and fallback content of objects and media are inline text; a head needs no end tag,
as what may stand in it is skipped by itself.  A skipped element that does not end inside its parent is read as if its
start tag were not there, so that nothing after it is lost.  Character references are decoded, white space inside a
block becomes one space.

Reading takes time in proportion to the page, however broken its markup is.  Defined results: a quotation mark opens a
value only after an equals sign and only if its partner ends the value; where a tag then finds no end, it and all later
ones end at the next closing bracket, and without one the rest is text; a comment without an end is a lone tag; elements
nested deeper than MOST_DEPTH keep their texts, tags and names, but not their order; a null page has no blocks."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

#: Element names by what they do to text.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
BREAK = {"hr"}
SKIP = set("script style template noscript svg annotation annotation-xml iframe textarea title button select datalist".split())
RAW = set("script style textarea title iframe noscript".split())
ENDS = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*+>", re.I) for t in RAW}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
FENCES = set("ul ol dl table div section article main aside body nav header footer form blockquote".split())

MOST_DEPTH = 96

#: A comment, a declaration or a tag; group ``bad`` where one begins that has no end.
TAG = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?][^>]*+>|<!(?!--|\[CDATA\[)[^>]*+>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))?+)*+)>|(?P<bad><)(?=[/!?A-Za-z])", re.S)  # fmt: skip
#: The same, ending at the next closing bracket.
PLAIN = re.compile(r"<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:_-]*+)([^>]*+)>|(?P<bad><)(?=[!?A-Za-z]|/[A-Za-z])")
ATTR = re.compile(r"(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@dataclass
class Element:
    tag: str
    names: list[str] = field(default_factory=list)
    ids: list[int] | None = None  # hashed features, for the labeller


@dataclass
class Block:
    path: Sequence[Element]
    text: str
    link: float  # share of the text that is inside links


def _names(attrs: str) -> list[str]:
    out: list[str] = []
    if "=" not in attrs and "hidden" not in attrs:
        return out
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.append("hidden")
        elif key in ("class", "id", "role", "itemprop"):
            out += [w.lower() for w in TOKEN.findall(value)]
    return out


def _tags(page: str, at: int) -> Iterator[re.Match]:
    for m in TAG.finditer(page, at):
        if m["bad"] is None:
            yield m
            continue
        if m.end() < len(page) and page[m.end()] == "/" and not page[m.end() + 1 : m.end() + 2].isalpha():
            continue  # no tag at all
        for n in PLAIN.finditer(page, m.start()):  # from here on no tag has an end of its own
            if n["bad"] is not None:
                return  # no closing bracket is left
            yield n
        return


def read_blocks(page: str | None) -> list[Block]:
    """Blocks in page order; blocks without text are left out."""
    blocks: list[Block] = []
    stack: list[Element] = []
    deeper: dict[str, list[tuple[str, ...]]] = {}  # names of open elements beyond MOST_DEPTH, by tag
    beyond: dict[tuple, list] = {}  # those elements, each kind once: how many are open, and one of them
    parts: list[tuple[str, bool]] = []
    page = page or ""
    at, links, skipping = 0, 0, ""
    begun, inner = 0, []  # where the skipped content begins, and the blocks open in it
    kept: dict[str, int] = {}  # how far start tags of a skipped element count as not there
    endless: set[str] = set()  # raw-text elements that have no end tag any more

    def after(at: int, tag: str) -> int:
        """Where the raw text of an element ends: past its end tag."""
        m = None if tag in endless else ENDS[tag].search(page, at)
        if m is None:
            endless.add(tag)
        return m.end() if m else len(page) if tag in ("script", "style") else at

    def flush() -> None:
        if not parts:
            return
        raw = "".join(p for p, _ in parts)
        text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
        if text:
            linked = sum(len(p) for p, inside in parts if inside)
            blocks.append(Block((*stack, *(e for _, e in beyond.values())), text, linked / max(1, len(raw))))
        parts.clear()

    def leave(kind: tuple) -> None:
        beyond[kind][0] -= 1
        if not beyond[kind][0]:
            del beyond[kind]

    depth, tags = 0, _tags(page, 0)
    while (m := next(tags, None)) or skipping:
        if m is None:  # the skipped element never ends: back to where it began
            kept[skipping], skipping = len(page), ""
            at, tags = begun, _tags(page, begun)
            continue
        if m.start() < at:
            continue  # inside raw text that was passed over
        if m.start() > at and not skipping:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if skipping:
            if tag == skipping:
                depth += -1 if m[1] else 0 if m[3].endswith("/") else 1
                skipping = skipping if depth else ""
            elif tag in RAW and not m[1]:
                at = after(at, tag)
            elif m[1] and tag in inner:
                del inner[len(inner) - 1 - inner[::-1].index(tag) :]
            elif m[1] and any(e.tag == tag for e in stack) or (skipping == "svg" and tag in BLOCK and not m[1] and not inner):
                kept[skipping], skipping = m.end(), ""  # its parent ends, or a drawing meets a block
                at, tags = begun, _tags(page, begun)
            elif not m[1] and not m[3].endswith("/") and (tag in BLOCK or tag in ("foreignobject", "desc")):
                inner.append(tag)
            continue
        if tag in SKIP:
            if m[1]:
                continue
            if tag in RAW:
                at = after(at, tag)
            elif not m[3].endswith("/") and m.start() >= kept.get(tag, 0):
                skipping, depth, begun, inner = tag, 1, at, []
            continue
        if tag == "a":
            links = 0 if m[1] else 1
        elif tag == "br":
            parts.append((" ", links > 0))
        elif tag in BREAK:
            flush()
        elif tag in BLOCK:
            flush()
            links = 0
            if m[1] and deeper.get(tag):
                leave((tag, *deeper[tag].pop()))
            elif m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if tag not in FENCES and stack[k].tag in FENCES:
                        break
            else:
                shut = CLOSES.get(tag, {"p"})
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in FENCES:
                        break
                    if stack[k].tag in shut:
                        del stack[k:]
                        break
                if len(stack) < MOST_DEPTH:
                    stack.append(Element(tag, _names(m[3])))
                else:
                    if tag in CLOSES and deeper.get(tag):
                        leave((tag, *deeper[tag].pop()))  # an end tag is implied
                    names = _names(m[3])
                    deeper.setdefault(tag, []).append(tuple(names))
                    held = beyond.pop((tag, *names), None) or [0, Element(tag, names)]
                    held[0] += 1
                    beyond[(tag, *names)] = held  # the last is the one that was opened last
    parts.append((page[at:], links > 0))
    flush()
    return blocks
