"""Running English prose of a text: code, tables, log lines and headings left out, other languages too."""

from __future__ import annotations

import html
import re

from tallymill.llm.language import FUNCTION_WORDS

_INVISIBLE = re.compile("[­​‌‍⁠﻿]")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_BULLET = re.compile(r"^\s*(?:[-*+•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
_LABEL = re.compile(r"^\*{0,2}(?:[A-Z][\w-]*\s?(?:\([A-Z]+\))?)\*{0,2}\s*:\s+(?=\S)")
_BOLD = re.compile(r"\*\*[^*]{1,60}\*\*")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={2,}\s|-{3,}\s*$|\*{3,}\s*$|={3,}\s*$)")
_STAMP = re.compile(r"^\s*[\[(]?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|^\s*\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b|^\s*\d\d:\d\d:\d\d\b")
_CODE = re.compile(
    r"^\s*(?:def |class |import |from \S+ import |return\b|for \w+ in .*:$|while .*:$|if .*:$|elif .*:$|else:$|try:$|except\b.*:$|with .*:$|"
    r"const |let |var |function |public |private |fn |func |package |#include|using |SELECT |INSERT |UPDATE |CREATE |\$ |>>> |@\w+$|//|/\*|[}\])]+[;,]?$|<\?|</?\w+[^>]*>$)"
)
_MARKED = re.compile(r"[=<>{}\[\]|_;/\\@$%^&~`]|\w\.\w|\w\(|::")
_TABLE = re.compile(r"^\s*\|.*\|?\s*$|^[^|]*\|[^|]*\|")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_OTHERS = frozenset(w for k, v in FUNCTION_WORDS.items() if k != "en" for w in v.split())
#: Words of English only, and of other languages only: what both have, like "a" or "no", tells nothing.
_ENGLISH = frozenset(FUNCTION_WORDS["en"].split()) - _OTHERS
_FOREIGN = _OTHERS - frozenset(FUNCTION_WORDS["en"].split())
_OTHER_SCRIPT = re.compile(r"[぀-ヿ一-鿿ऀ-ॿ가-힯؀-ۿ֐-׿Ѐ-ӿ]")


def _is_data(line: str) -> bool:
    """Whether a line is of a log, of code or of a table."""
    if _STAMP.match(line) or _CODE.match(line) or _TABLE.match(line) or "\t" in line.strip():
        return True
    if not _MARKED.search(line):
        return False
    tokens = line.split()
    odd = sum(1 for t in tokens if _MARKED.search(t.strip(".,;:!?()\"'*_`[]<>/")))
    return odd * 3 >= len(tokens)


def paragraphs(text: str) -> list[tuple[bool, str]]:
    """(whether it is a bullet, text) of the pieces of running text, each line-wrapped paragraph or bullet joined again."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    out: list[tuple[bool, str]] = []
    current: list[str] = []
    fenced = listed = False

    def close():
        if current:
            out.append((listed, " ".join(current)))
            current.clear()

    for line in text.splitlines():
        if _FENCE.match(line):
            close()
            fenced = not fenced
            continue
        if fenced:
            continue
        bare = line.strip()
        if not bare:
            close()
            continue
        bullet = _BULLET.match(line)
        body = line[bullet.end() :].strip() if bullet else bare.lstrip("> ").strip()
        if _HEADING.match(line) or _is_data(body):
            close()
            continue
        if bullet:
            close()
        if not current:
            listed = bool(bullet)
        current.append(body)
    close()
    return out


def english_words(text: str) -> list[str]:
    """The words (numbers count) of the text's running English prose, in lower case."""
    words: list[str] = []
    for listed, paragraph in paragraphs(text):
        if "**" in paragraph:
            paragraph = _BOLD.sub(" ", paragraph)
        paragraph = _LABEL.sub("", paragraph)
        found = [t.strip(".,;:!?()\"'“”’‘*_`[]<>…").lower() for t in paragraph.split()]
        found = [t for t in found if t]
        # headings are short and end like no sentence; bullets may be short
        if not found or _HEADING.match(paragraph) or (not listed and len(found) <= 6 and paragraph.rstrip(" \"'”’)*_")[-1:] not in ".!?…;,:"):
            continue
        if _OTHER_SCRIPT.search(paragraph):
            continue
        english, foreign = sum(t in _ENGLISH for t in found), sum(t in _FOREIGN for t in found)
        if foreign > english:
            continue
        words.extend(found)
    return words
