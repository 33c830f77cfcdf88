"""Plain words of a text: layout, markup, invisible and look-alike characters taken away."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters without width.
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿᠎͏"
#: Letters that look like Latin ones, and the Latin ones.
LOOK_ALIKE = "АВЕЅІЈКМНОРСТУХавеѕіјкмнорстухһԁԛԝցոսνοιαρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧɡıⅼ"
LATIN = "ABESIJKMHOPCTYXabesijkmhopctyxhdqwgnuvoiapkABEZHIKMNOPTYXgil"
#: Tags that stand inside words.
INLINE = "b|i|u|s|em|strong|span|a|code|mark|sub|sup|font|small|big|tt|kbd|ins|del"

_TABLE = {**dict.fromkeys(map(ord, INVISIBLE)), **{ord(a): b for a, b in zip(LOOK_ALIKE, LATIN)}}
_INLINE = re.compile(rf"</?(?:{INLINE})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", re.S)
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\r?\n[ \t>#*|/]*(?=[^\W\d_])")
_MARKS = re.compile(r"(?<=\w)(?:\*\*?|__?|~~|`)(?=\w)|[*_~`]{1,3}(?=\w)|(?<=\w)[*_~`]{1,3}")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """text in one letter case, without what isn't seen or is only markup."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_TABLE)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "-\n" in text or "-\r" in text or "- \n" in text or "‐" in text:
        text = _HYPHEN.sub("", text)
    if "*" in text or "_" in text or "`" in text or "~" in text:
        text = _MARKS.sub("", text)
    return text.lower()


#: The maximal runs of letters and digits of a text that is plain already.
runs_of_letters = _WORD.findall


def words(text: str) -> list[str]:
    """The maximal runs of letters and digits of plain(text)."""
    return runs_of_letters(plain(text))
