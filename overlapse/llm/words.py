"""Normalised words: runs of letters and digits, whatever their case, accents or compatibility form."""

from __future__ import annotations

import unicodedata

import regex

_DROPPED = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def folded(text: str) -> str:
    """Compatibility-decomposed, without marks and invisible characters, case-folded."""
    if text.isascii():
        return text.lower()
    return _DROPPED.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()))


def words(text: str) -> list[str]:
    return _WORD.findall(folded(text))
