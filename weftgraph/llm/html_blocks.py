"""HTML into leaf blocks: runs of text between block-level tags, each with the tags that enclose it.

Inline tags, formulas and graphics do not end a block, a line break is white space; scripts, styles, titles, fallbacks
and comments give no text. Elements that are not shown are blocks like others, marked by the name ``NOT_SHOWN``. Missing end tags are supplied as browsers do for paragraphs, list items and table cells; a page may end anywhere.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object svg g path circle rect line polyline polygon ellipse text tspan defs use math mi mo mn ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mspace mpadded mphantom semantics annotation".split())
FOREIGN = frozenset("g path circle rect line polyline polygon ellipse text tspan use mi mo mn ms mtext mrow mspace".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body button div footer form header html main nav ol section table td th ul dl blockquote".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>?|<[!?][^>]*>?""", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ANY_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAY_HIDE = re.compile("hidden|display", re.I)
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: A name that no attribute can give.
NOT_SHOWN = "=hidden"
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    """Words of the class, id and role of a tag."""
    return tuple(w.lower() for m in _ATTR.finditer(attributes) for w in _NAME.findall(m[2] or m[3] or m[4] or ""))


def not_shown(attributes: str) -> bool:
    """Whether a tag has an attribute named hidden, or a style that takes it off the page."""
    for m in _ANY_ATTR.finditer(attributes) if _MAY_HIDE.search(attributes) else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and _NONE.search(value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; white space is collapsed, character references are decoded, empty blocks are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), tuple(n for _, names in stack for n in names), linked))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            links -= stack.pop()[0] == "a"

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in INLINE or any(t not in INLINE for t, _ in stack[i:]):
                        pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
            ending = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            for i in range(len(stack) - 1, -1, -1) if ending else ():
                if stack[i][0] in ending:
                    pop(i)
                    break
                if stack[i][0] in SCOPES and not (stack[i][0] in ("td", "th") and tag == "tr"):
                    break
        if tag not in VOID and not (tag in FOREIGN and m[3].endswith("/")):
            names = _names(m[3]) if m[3] else ()
            if m[3] and not_shown(m[3]):
                names += (NOT_SHOWN,)
            stack.append((tag, names))
            links += tag == "a"
    if at < len(page):
        parts.append(page[at:])
        if links:
            linked += len(page) - at
    flush()
    return out
