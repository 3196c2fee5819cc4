"""The splitting patterns of the public tokenizers, also as plain patterns for texts of common letters.

Python's own ``re`` is faster than a matcher of Unicode classes. For texts of ASCII and of the Latin
letters À to ſ the classes can be written out; other texts take the general pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import regex

_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ſ]*").fullmatch
_SPACE = r"\t-\r "
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: The splitting pattern of word_bpe_49k.json.
WORD_PATTERN = rf"{_SUFFIXES}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
#: By general pattern: what it is for plain texts.
WRITTEN_OUT = {
    public_tokenizers.PATTERN: rf"{_SUFFIXES}| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+",
    WORD_PATTERN: rf"{_SUFFIXES}|[{_LETTERS}]+|[0-9]|[^{_SPACE}{_LETTERS}0-9]+",
}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    general = regex.compile(pattern).findall
    if pattern not in WRITTEN_OUT:
        return general
    plain = re.compile(WRITTEN_OUT[pattern]).findall
    return lambda text: plain(text) if _PLAIN(text) else general(text)
