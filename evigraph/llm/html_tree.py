"""Balanced token streams of HTML pages: block elements and the text between them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: A comment, a declaration or a tag; quotes that never close count as plain characters.
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
#: Elements whose content is not text of the page.
SILENT = frozenset("script style noscript template svg iframe object textarea title canvas math "
                   "audio video select button".split())
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label "
                   "mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
#: What an opening tag closes if it is the innermost open block.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"},
           "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
           "option": {"option"}}
TEXT = "#text"
#: Open elements from which further ones add their text to the one they are in.
DEEP = 150


def _label(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    names = sorted((k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(attributes))
    out = tag
    for kind, value in names:
        value = re.sub(r"\d+", "0", " ".join(sorted(set(value.lower().split()))))
        out += {"class": ".", "id": "#", "role": "@"}[kind] + value
    return out


def clean(text: str) -> str:
    """Character references decoded, white space as single blanks."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


def parse(page: str, is_furniture) -> list:
    """The page as nested nodes [label, children]; text is [TEXT, string].

    Inline tags vanish into the text around them, unless ``is_furniture`` says of their
    label that they frame something else. Open blocks are closed where the next tag implies
    it, and at the end of the page; closing tags that match nothing are skipped.
    """
    root: list = ["", []]
    stack: list[tuple[str, list]] = [("", root)]
    buffer: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        if buffer:
            text = clean("".join(buffer))
            buffer.clear()
            if text:
                stack[-1][1][1].append([TEXT, text])

    while at < size:
        mark = _MARK.search(page, at)
        if mark is None:
            buffer.append(page[at:])
            break
        if mark.start() > at:
            buffer.append(page[at:mark.start()])
        at = mark.end()
        closing, name, attributes = mark.groups()
        if name is None:
            continue
        tag = name.lower()
        if not closing and tag in SILENT:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        label = _label(tag, attributes) if not closing else tag
        if tag in INLINE and (closing and not any(t == tag for t, _ in stack[-1:])
                              or not closing and not is_furniture(label)):
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        flush()
        if closing:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            continue
        closes = _CLOSES.get(tag, () if tag in INLINE else {"p"})
        while stack[-1][0] in closes:
            stack.pop()
        if _HIDDEN.search(attributes):
            label += ".hidden"
        above = stack[-1][1]
        if len(stack) > DEEP and (is_furniture(above[0]) or not is_furniture(label)):
            stack.append((tag, above))
            continue
        node = [label, []]
        above[1].append(node)
        stack.append((tag, node))
    flush()
    return root


def texts(node: list) -> Iterator[str]:
    for child in node[1]:
        if child[0] == TEXT:
            yield child[1]
        else:
            yield from texts(child)
