"""Text blocks of an HTML page in page order, each with the path of open elements above it.

One pass over the page, linear in its length whatever it holds: unclosed comments, tags and quotes run to the end of the
page or fall back to the next ``>``, and a closing tag without its opening one is passed over.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Fixed values of HTML: elements without content, with raw content, and those inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when another of the same row begins.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements within which a row's beginning ends nothing outside.
HOLDS = frozenset("ul ol dl table select menu body html".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARK = re.compile(r"""(class|id|role|hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    """One leaf: its text, distinct tokens of the elements above it, tokens of the nearest one, and its characters in links."""

    text: str
    path: tuple[str, ...]
    leaf: tuple[str, ...]
    linked: int


def marks(name: str, attributes: str) -> tuple[str, ...]:
    """Tokens of an element: its name, and the word parts of its class, id, role."""
    out = [name]
    if attributes and not attributes.isspace():
        for key, *values in _MARK.findall(attributes):
            out += [f"{name[:1] if key == 'hidden' else ''}.{part.lower()}" if part else key for part in _PARTS.findall("".join(values))] or [f".{key.lower()}"]
    return tuple(dict.fromkeys(out))


def blocks(page: str | None) -> list[Block]:
    """All blocks with text; white space inside a block is one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    above: Counter[str] = Counter()
    words: list[str] = []
    path: tuple[str, ...] = ()
    leaf: tuple[str, ...] = ()
    linked = 0
    tag = _TAG

    def pop() -> str:
        name, tokens = stack.pop()
        opened[name] -= 1
        for t in tokens:
            above[t] -= 1
            if not above[t]:
                del above[t]
        return name

    def flush() -> None:
        nonlocal words, linked
        if words and (text := " ".join("".join(words).split())):
            out.append(Block(text, path, leaf, min(linked, len(text))))
        words, linked = [], 0

    def close_row(names: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in HOLDS or stack[k][0] not in INLINE and stack[k][0] not in ("p", "div"):
                return

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        stop = end if start < 0 else start
        if stop > at:
            if not words:
                path = tuple(above)
                leaf = next((tokens for name, tokens in reversed(stack) if name not in INLINE), ())
            piece = page[at:stop]
            piece = html.unescape(piece) if "&" in piece else piece
            words.append(piece)
            if opened["a"]:
                linked += len(piece.strip())
        if start < 0:
            break
        if page.startswith("<!--", start):
            at = page.find("-->", start + 4)
            at = end if at < 0 else at + 3
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start)
            at = end if at < 0 else at + 1
            continue
        found = tag.match(page, start)
        if found is None and tag is _TAG and re.match("</?[a-zA-Z]", page[start : start + 3]):
            tag = _PLAIN_TAG  # quotes do not pair up from here on
            found = tag.match(page, start)
        if found is None:
            if re.match("</?[a-zA-Z]", page[start : start + 3]):
                break  # a tag that never ends
            if not words:
                path = tuple(above)
                leaf = next((tokens for name, tokens in reversed(stack) if name not in INLINE), ())
            words.append("<")
            at = start + 1
            continue
        at = found.end()
        closing, name, attributes = found.groups()
        name = name.lower()
        if closing:
            if name not in INLINE:
                flush()
            if name in HEADINGS:  # ends the open heading, whatever its level
                name = next((n for n, _ in reversed(stack) if n in HEADINGS or n in HOLDS), name)
            if opened[name] > 0 and name not in ("html", "body"):
                while pop() != name:
                    pass
            continue
        if name == "br":
            words.append(" ")
            continue
        if name not in INLINE:
            flush()
        if name in RAW and not attributes.endswith("/"):
            done = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            at = end if done is None else done.start()
            if done is not None and (over := page.find(">", at)) >= 0:
                at = over + 1
            elif done is not None:
                at = end
            continue
        if name in VOID:
            continue
        if name not in INLINE and opened["p"] > 0:
            while pop() != "p":
                pass
        if name in CLOSES:
            close_row(CLOSES[name])
        tokens = marks(name, attributes)
        stack.append((name, tokens))
        opened[name] += 1
        above.update(tokens)
    flush()
    return out
