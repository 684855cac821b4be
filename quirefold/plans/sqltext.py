"""The text functions in SQL for the oracle, which has no NFKC: the compatibility characters of the data are named."""

from __future__ import annotations

from quirefold.functions.text import NUMBER, TITLE_KINDS

WS = "[\\t\\n\\x0b\\f\\r\\p{Z}]"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "".join(map(chr, range(0x1D400, 0x1D434))) + "".join(map(chr, range(0x1D7CE, 0x1D7D8))) + "²³¹"
PLAIN = "".join(map(chr, range(0x21, 0x7F))) + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "0123456789" + "231"
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "™": "TM", "…": "...", "ำ": "ํา", "ª": "a", "º": "o"}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, new: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, '{flags}')"


def nfkc(x: str) -> str:
    for a, b in JOINED.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize(translate({x}, {lit(WIDE)}, {lit(PLAIN)}))"


def squeeze(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def clean_line(x: str) -> str:
    return squeeze(sub(sub(x, "[­﻿​]"), "[\\x00\\x08�]", " "))


def key(x: str) -> str:
    return f"trim({sub(f'lower({nfkc(clean_line(x))})', '[^\\p{L}\\p{N}]+', ' ')})"


def context_key(x: str) -> str:
    return f"trim({sub(f'lower({nfkc(x)})', '[^\\p{L}\\p{N}]+', ' ')})"


def word_key(x: str) -> str:
    folded = f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"
    return f"trim({sub(folded, '[^\\p{L}\\p{N}_]+', ' ')})"


def furniture_key(x: str) -> str:
    numbered = sub(key(x), "\\b(?:page\\s+)?\\d+(?:\\s+of\\s+\\d+)?\\b", "#")
    return f"trim({sub(numbered, '\\b[ivxlcdm]+\\b', '#')})"


def count_words(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {squeeze(x)} = '' THEN 0 ELSE len(string_split({squeeze(x)}, ' ')) END"


def title_kind(x: str) -> str:
    """CASE giving 'kind level'."""
    arms = []
    for kind, level, on, pattern in TITLE_KINDS:
        flags = ", 'i'" if on == "raw" else ""
        pattern = pattern.removeprefix("(?i)").replace("(?![a-z0-9_])", "\\b")
        arms.append(f"WHEN regexp_matches({x if on == 'raw' else key(x)}, {lit(pattern)}{flags}) THEN '{kind} {level}'")
    return f"CASE {' '.join(arms)} END"


__all__ = ["NUMBER"]
