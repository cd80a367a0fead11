"""Leaf blocks of an HTML page: stretches of text between block-level tags, with their ancestors.

The scanner is one regular expression over the whole page. It follows the parts of the HTML standard that
shape text: raw-text elements, comments, omitted end tags of p, li, dt, dd, option and table parts, stray end tags, a page cut
off anywhere. Inline tags don't break a block. Elements may be nested to any depth: what a block's ancestors are is counted as they open and close.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

TAG = re.compile(
    r"""<!--(?P<comment>.*?)(?:--!?>|\Z)
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
      | <(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)
      | <[!?/][^>]*(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Fixed sets of the HTML standard.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "select", "title", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "label", "input", "source", "track", "link", "meta",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"ul", "ol", "table", "dl", "td", "th", "button", "html", "body", "article", "section", "div", "nav", "aside", "main", "header", "footer", "form"}
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # the ancestors' different tags, the innermost's last
    names: tuple[str, ...]  # different class, id and role words of all ancestors
    link_chars: int
    in_form: bool


@lru_cache(64)
def end_tag(name: str) -> re.Pattern:
    """The end tag of a raw-text element. ASCII letters alone differ in case, as the standard has it."""
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I | re.A)


def clean(text: str) -> str:
    return SPACE.sub(" ", html.unescape(text)).strip()


def attribute_words(attrs: str) -> tuple[str, ...]:
    out: list[str] = []
    for m in ATTRIBUTE.finditer(attrs):
        if m[2] and m[1].lower() in ("class", "id", "role", "aria-label", "itemprop"):
            out += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2].strip("\"'")).lower())
        elif m[1].lower() in ("hidden",) or m[1].lower() == "aria-hidden" and m[2] and "true" in m[2]:
            out.append("hidden")
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    tags: Counter[str] = Counter()  # of the elements in the stack
    words: Counter[str] = Counter()
    parts: list[str] = []
    links: list[str] = []
    in_link = 0
    unclosed: set[str] = set()
    at, end = 0, len(page)

    def flush() -> None:
        text = clean("".join(parts))
        if text:
            last = next((t for t, _ in reversed(stack) if t not in INLINE or t == "label"), None)
            path = (*(t for t in tags if t != last and (t not in INLINE or t == "label")), last) if last else ()
            names = tuple(words)
            blocks.append(Block(text, path, names, min(len(text), len(clean("".join(links)))), "form" in path))
        parts.clear()
        links.clear()

    def push(tag: str, names: tuple[str, ...]) -> None:
        nonlocal in_link
        stack.append((tag, names))
        tags[tag] += 1
        words.update(names)
        in_link += tag == "a"

    def drop(k: int, stop: int) -> None:
        nonlocal in_link
        for tag, names in stack[k:stop]:
            in_link -= tag == "a"
            for counts, keys in ((tags, (tag,)), (words, names)):
                for x in keys:
                    counts[x] -= 1
                    if not counts[x]:
                        del counts[x]
        del stack[k:stop]

    def pop_to(k: int) -> None:
        drop(k, len(stack))

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                links.append(text)

    while at < end:
        m = TAG.search(page, at)
        if not m:
            rest = page[at:]
            add(rest)
            break
        add(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue  # a comment or declaration
        name = name.lower()
        closing = bool(m["close"] or m["close2"])
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if name == "br":
            parts.append(" ")
            continue
        if not closing and name in RAW:
            shut = end_tag(name).search(page, at) if name not in unclosed else None
            if shut is None:
                unclosed.add(name)  # nor does it end further on
            stop = shut.start() if shut else -1
            if stop < 0 and name in ("svg", "math", "object", "select", "iframe", "template", "noscript", "title"):
                stop = at  # never closed: don't lose the page over it
            at = end if stop < 0 else stop
            if name not in ("svg", "math"):
                flush()
            continue
        if name in INLINE:
            if name in VOID or attrs.endswith("/") and not closing:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        drop(k, k + 1)
                        break
                    if stack[k][0] not in INLINE:
                        break
            else:
                if name == "a" and in_link:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "a":
                            drop(k, k + 1)
                            break
                push(name, attribute_words(attrs) if name != "a" and attrs else ())
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1) if name in tags else ():
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block begins
            if stack[k][0] == "p":
                pop_to(k)
                break
            if stack[k][0] in SCOPE:
                break
        if name in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[name]:
                    pop_to(k)
                    break
                if stack[k][0] in ("ul", "ol", "table", "dl", "select"):
                    break
        if name not in VOID:
            push(name, attribute_words(attrs) if attrs else ())
    flush()
    return blocks
