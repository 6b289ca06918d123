"""Markup to prose. Nesting is beyond regular expressions, so these run as Arrow functions over whole batches.

Wiki markup is read in four steps, each one walk over the text: what is shut
away between tags, the tree of sections, brackets by a stack, and at last
lines and what is left inline. HTML becomes a list of events, which are folded
with the depth of silent elements.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import TRAILING_SECTIONS

# Link targets, HTML elements and wiki elements without prose; what stands for elements that leave a trace.
MEDIA = ("File:", "Image:", "Category:", "media:", "Media:")
SILENT = frozenset(("script", "style", "nav", "footer", "noscript", "table", "figure", "aside"))
SHUT = ("ref", "gallery", "imagemap", "timeline", "mapframe", "graph", "syntaxhighlight")
TRACES = {"+br": "\n", "-li": "\n", "-p": "\n\n", "-h1": "\n\n", "-h2": "\n\n", "-h3": "\n\n", "-h4": "\n\n", "+sub": "_", "+sup": "^"}
BULLETS = frozenset("*#|:;-")

_SHUTTER = re.compile(rf"<(?:!--|({'|'.join(SHUT)})\b[^>]*>)", re.I)
_ENDS = {None: re.compile("-->"), **{name: re.compile(f"</{name}>", re.I) for name in SHUT}}
_OUTER_LINK = re.compile(r"\[https?://[^\s\]]+(?:\s+([^\]]+))?\]")
_QUOTES = re.compile("'{2,}")
_INLINE = re.compile(r"<(/?[A-Za-z][^>]*)>|\[\d+\]")


def without_shut(text: str) -> str:
    """Text outside comments, references and displays, from whichever opens first to its end; one without an end stays."""
    kept, at, look = [], 0, 0
    while m := _SHUTTER.search(text, look):
        name = m.group(1) and m.group(1).lower()
        end = m if name == "ref" and m.group().endswith("/>") else _ENDS[name].search(text, m.end())
        look = m.end() if end is None else end.end()
        if end is not None:
            kept.append(text[at : m.start()])
            at = look
    return "".join(kept) + text[at:]


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a line between equal runs of two to six signs; None for any other line."""
    s = line.rstrip(" \t")
    left, right = len(s) - len(s.lstrip("=")), len(s) - len(s.rstrip("="))
    level = min(left, right, 6, len(s) // 2)
    return (level, s[level : len(s) - level].strip(" \t")) if level > 1 else None


def without_templates(text: str) -> str:
    """Text outside all {{...}}; one that never closes takes the rest along."""
    kept, depth, start = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}", text):
        if m.group() == "{{":
            if not depth:
                kept.append(text[start : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            start = m.end()
    return "".join(kept) + ("" if depth else text[start:])


def with_link_labels(text: str) -> str:
    """[[target|label]] as its label, innermost first; media links vanish, unclosed ones stay."""

    def label(inside: str) -> str:
        if inside.startswith(MEDIA):
            return ""
        return inside.rpartition("|")[2] if "|" in inside else inside.partition("#")[0]

    stack: list[list[str]] = [[]]
    at = 0
    for m in re.finditer(r"\[\[|\]\]", text):
        stack[-1].append(text[at : m.start()])
        at = m.end()
        if m.group() == "[[":
            stack.append([])
        elif len(stack) > 1:
            inside = "".join(stack.pop())
            stack[-1].append(label(inside))
        else:
            stack[-1].append("]]")
    stack[-1].append(text[at:])
    while len(stack) > 1:
        rest = "".join(stack.pop())
        stack[-1].append("[[" + rest)
    return "".join(stack[0])


def without_sections(text: str, names=frozenset(TRAILING_SECTIONS)) -> str:
    """Text without the sections of these names and all sections within them: a section lies in the nearest one before it of a lesser level."""
    within: list[tuple[int, bool]] = [(0, False)]
    kept = []
    for line in text.splitlines():
        if found := heading(line):
            level, title = found
            while within[-1][0] >= level:
                within.pop()
            within.append((level, within[-1][1] or title.lower() in names))
        if not within[-1][1]:
            kept.append(line)
    return "\n".join(kept)


def plain_line(line: str) -> str | None:
    """The line, a heading as its title; None for lines of tables and of bullets alone."""
    s = line.strip()
    if s.startswith(("{|", "|", "!")) or s and BULLETS.issuperset(s):
        return None
    found = heading(line)
    return found[1] if found else line


def _traced(m: re.Match) -> str:
    return TRACES[f"+{m[1]}"] if m[1] in ("sub", "sup") else ""


def prose_of_wikitext(text: str) -> str:
    shown = without_templates(without_sections(without_shut(text)))
    linked = with_link_labels(_OUTER_LINK.sub(lambda m: m[1] or "", shown))
    lines = map(plain_line, _QUOTES.sub("", linked).splitlines())
    return _INLINE.sub(_traced, "\n".join(x for x in lines if x is not None))


class _Events(HTMLParser):
    """What the parser meets, as (sign, name or text): + opens, - closes, nothing is text."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.met: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, _: self.met.append(("+", tag))
        self.handle_endtag = lambda tag: self.met.append(("-", tag))
        self.handle_data = lambda data: self.met.append(("", data))
        self.feed(page)


def prose_of_html(page: str) -> str:
    out, depth = [], 0
    for sign, what in _Events(page).met:
        if sign and what in SILENT:
            depth = max(0, depth + (1 if sign == "+" else -1))
        elif not depth:
            out.append(TRACES.get(sign + what, "") if sign else what)
    return "".join(out)


def _wikitext(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else prose_of_wikitext(t))


def _html(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else prose_of_html(t))


def wikitext_prose(text: Column) -> Column:
    """Wiki markup as prose; null stays null."""
    return F.pandas_udf(_wikitext, "string")(text)


def html_prose(text: Column) -> Column:
    """HTML as prose; null stays null."""
    return F.pandas_udf(_html, "string")(text)
