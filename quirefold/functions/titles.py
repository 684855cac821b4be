"""Titles in Python, for the per-book logic of sections and navigation. The Column functions of ``text`` give the same results."""

from __future__ import annotations

import re
import unicodedata

from quirefold.functions import text as T

SPACE = re.compile(r"\s+")
NOT_KEY = re.compile(r"[^\w]|_")
KINDS = [(kind, level, on, re.compile(pattern.removeprefix("(?i)"), re.I if on == "raw" else 0)) for kind, level, on, pattern in T.TITLE_KINDS]
CHAPTER, PART = re.compile(T.CHAPTER_TITLE, re.I), re.compile(T.PART_TITLE, re.I)
NUMBERED = re.compile(f"^{T.NUMBER}(?:\\.\\d+)*[.:]?\\s+(\\w)")
PROSE_END = re.compile(T.PROSE_END)
# What navigation entries are called.
NAV_NUMBER = r"(?:\d{1,3}|[IVXLCDM]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)"
EXPLICIT = re.compile(rf"^(chapter|habit|part|book)\s+({NAV_NUMBER})(?:\s*[:.\-–—]\s*(.*))?$", re.I)
SPECIAL = re.compile(r"^(?:introduction|prologue|epilogue|preface|foreword|afterword|conclusion)$", re.I)
FRONT = re.compile(r"^(?:cover|title page|copyright|dedication|contents|table of contents|also (?:by|from)|acknowledge?ments?|with appreciation)\b", re.I)
BACK = re.compile(r"^(?:appendix|glossary|notes|endnotes|references|bibliography|index|illustration credits|about the author|abbreviations in)\b", re.I)
WORD_CHAPTER = re.compile(rf"^({NAV_NUMBER})\s*[:.]\s+[^\W\d_]", re.I)
CONTENTS = re.compile(r"^(?:table of )?contents$", re.I)


def clean(text: str | None) -> str:
    return SPACE.sub(" ", re.sub("[\x00\x08�]", " ", re.sub("[­﻿​]", "", text or ""))).strip()


def key(text: str | None) -> str:
    return SPACE.sub(" ", NOT_KEY.sub(" ", unicodedata.normalize("NFKC", clean(text)).lower())).strip()


def navigation(text: str | None) -> str:
    t = SPACE.sub(" ", re.sub("\x08|�+", " ", text or "")).strip()
    t = re.sub(r"C\s+H\s+A\s+P\s+T\s+E\s+R", "CHAPTER", t, flags=re.I)
    t = re.sub(r"P\s+A\s+R\s+T", "PART", t, flags=re.I)
    return re.sub(r"^(CHAPTER\s+)(\d)\s+(\d)\b", r"\1\2\3", t, flags=re.I)


def nav_key(text: str | None) -> str:
    return SPACE.sub(" ", NOT_KEY.sub(" ", unicodedata.normalize("NFKC", navigation(text)).lower())).strip()


def heading(text: str | None) -> str:
    return re.sub(r"[\s:;,.]+$", "", re.sub(r"\s+[.·…]{2,}\s*\d+\s*$", "", clean(text)))


def similarity(a: str | None, b: str | None) -> float:
    return key_similarity(key(a), key(b))


def key_similarity(x: str, y: str) -> float:
    """``similarity`` of texts from their keys."""
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if x in y or y in x:
        return min(len(x), len(y)) / max(len(x), len(y))
    p, q = set(x.split(" ")), set(y.split(" "))
    return 2 * len(p & q) / (len(p) + len(q))


def title_kind(text: str) -> tuple[str, int] | None:
    k = key(text)
    return next(((kind, level) for kind, level, on, pattern in KINDS if pattern.search(k if on == "key" else text)), None)


def capitalised(text: str) -> bool:
    if not 2 <= len(text) <= 150 or text.isdigit():
        return False
    words = [w for w in text.split() if any(c.isalpha() for c in w)]
    first = [next(c for c in w if c.isalpha()) for w in words]
    return 0 < len(words) <= 20 and sum(c.isupper() for c in first) >= 0.55 * len(words)


def plausible(text: str) -> bool:
    t = clean(text)
    if not 3 <= len(t) <= 180 or re.fullmatch(r"(?i)untitled|unknown|document|ebook|book", t) or re.match(r"(?i)(?:copyright|contents|table of contents|isbn|published by|chapter|part)\b", t):
        return False
    return not re.search(r"(?i)\.(?:pdf|indd|docx?|ps|eps)$|^(?:microsoft word|untitled[-\s\d]|\d{5,}[_-])", t) and len(t.split(" ")) <= 28 and not re.search(r"\.\s|\.$", t)


def entry_kind(title: str) -> str:
    return "frontMatter" if FRONT.match(title) else "backMatter" if BACK.match(title) else "part" if re.match(r"(?i)(part|book)\s", title) else "chapter"


def context(text: str | None) -> str:
    """Letters and digits in small letters, without NFKC."""
    return SPACE.sub(" ", NOT_KEY.sub(" ", (text or "").lower())).strip()
