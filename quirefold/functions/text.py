"""Text functions as Column expressions; they stay in the JVM except for NFKC, which has no built-in.

Two families of keys must not be mixed: ``key`` (NFKC, letters and digits only) for layout and navigation, and
``word_key`` (case folded, word characters) for catalogue and scorecard. Null gives null throughout.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WS = "[\\t\\n\\x0b\\f\\r\\p{Z}]"
GLUE = "[­﻿​]"
CONTROLS = "[\\x00\\x08�]"
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"  # word edges that count ASCII only

# Numbers in words, names of section kinds by title, in the order in which they are tried.
NUMBER = "(?:\\d{1,4}|[IVXLCDM]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)"
CHAPTER_TITLE = f"^(?:chapter|ch\\.?|habit)\\s+{NUMBER}(?:\\s*[:.\\-–—]\\s*.+)?$"
PART_TITLE = f"^(?:part|book)\\s+{NUMBER}(?:\\s*[:.\\-–—]\\s*.+)?$"
PROSE_END = "[.!?…][\"'”’»）)\\]}]*$"
TITLE_KINDS = [
    ("unknownFront", 0, "key", "^(?:also by|other (?:books|works) by|books by)(?![a-z0-9_])"),
    ("cover", 0, "key", "^cover$"),
    ("titlePage", 0, "key", "^title page$"),
    ("copyright", 0, "key", "^(?:copyright|imprint|license|publication details?)$"),
    ("dedication", 0, "key", "^dedication$"),
    ("contents", 0, "key", "^(?:table of )?contents$"),
    ("foreword", 1, "key", "^foreword(?![a-z0-9_])"),
    ("preface", 1, "key", "^preface(?![a-z0-9_])"),
    ("acknowledgments", 1, "key", "^acknowledge?ments?(?![a-z0-9_])"),
    ("introduction", 1, "key", "^(?:introduction|prologue)(?![a-z0-9_])"),
    ("part", 0, "raw", f"(?i){PART_TITLE}"),
    ("chapter", 1, "raw", f"(?i){CHAPTER_TITLE}"),
    ("conclusion", 1, "key", "^conclusion(?![a-z0-9_])"),
    ("epilogue", 1, "key", "^(?:epilogue|afterword)(?![a-z0-9_])"),
    ("appendix", 1, "key", "^(?:appendix|appendices)(?![a-z0-9_])"),
    ("glossary", 1, "key", "^(?:glossary|list of abbreviations|abbreviations in (?:the )?notes)(?![a-z0-9_])"),
    ("notes", 1, "key", "^(?:notes|endnotes|footnotes)(?: to (?:chapter|part) .+)?$"),
    ("bibliography", 1, "key", "^(?:(?:selected )?bibliography|references|works cited|further reading)$"),
    ("index", 1, "key", "^(?:(?:subject|author|name) )?index$"),
    ("aboutAuthor", 1, "key", "^(?:about (?:the )?author|contributors?|author biography)(?![a-z0-9_])"),
    ("colophon", 1, "key", "^(?:colophon|(?:illustration|photo|photograph|image) credits|credits)$"),
]
# Groups of section kinds.
FRONT_KINDS = ("cover", "titlePage", "copyright", "dedication", "contents", "unknownFront")
BACK_KINDS = ("conclusion", "epilogue", "appendix", "glossary", "notes", "bibliography", "index", "aboutAuthor", "colophon", "unknownBack")
BODY_KINDS = ("foreword", "preface", "introduction", "part", "chapter", "section", "body")
UNCOUNTED_KINDS = (*FRONT_KINDS, "notes", "bibliography", "index", "aboutAuthor", "colophon", "unknownBack")
FULL_TEXT_KINDS = (*FRONT_KINDS, "notes", "bibliography", "index", "glossary", "colophon", "unknownBack")


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t), na_action="ignore")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def clean_line(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, GLUE, ""), CONTROLS, " "))


def key(c: Column, composed: bool = False) -> Column:
    """Letters and digits in small letters, one space between words. ``composed``: the text is in NFKC already."""
    own = clean_line(c) if composed else nfkc(clean_line(c))
    return F.trim(F.regexp_replace(F.lower(own), "[^\\p{L}\\p{N}]+", " "))


def context_key(c: Column) -> Column:
    """As ``key`` but without cleaning the line first: invisible characters part words."""
    return F.trim(F.regexp_replace(F.lower(nfkc(c)), "[^\\p{L}\\p{N}]+", " "))


def word_key(c: Column) -> Column:
    """Case folded, runs of other than word characters as one space."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(c), "ß", "ss"), "ς", "σ")
    return F.trim(F.regexp_replace(folded, "[^\\p{L}\\p{N}_]+", " "))


def furniture_key(c: Column) -> Column:
    """A running line's key: page numbers, also roman ones, and what looks like one, become #."""
    numbered = F.regexp_replace(key(c), f"{LEFT}(?:page\\s+)?\\d+(?:\\s+of\\s+\\d+)?{RIGHT}", "#")
    return F.trim(F.regexp_replace(numbered, f"{LEFT}[ivxlcdm]+{RIGHT}", "#"))


def clean_heading(c: Column) -> Column:
    bare = F.regexp_replace(clean_line(c), "\\s+[.·…]{2,}\\s*\\d+\\s*$", "")
    return F.regexp_replace(bare, "[\\s:;,.]+$", "")


def navigation_title(c: Column) -> Column:
    """A heading as navigation shows it: spaced-out words and split numbers are mended."""
    t = squeeze(F.regexp_replace(c, "\\x08|\ufffd+", " "))
    t = F.regexp_replace(t, "(?i)C\\s+H\\s+A\\s+P\\s+T\\s+E\\s+R", "CHAPTER")
    t = F.regexp_replace(t, "(?i)P\\s+A\\s+R\\s+T", "PART")
    return F.regexp_replace(t, "(?i)^(CHAPTER\\s+)(\\d)\\s+(\\d)(?![A-Za-z0-9_])", "$1$2$3")


def count_words(c: Column) -> Column:
    """Words between white space."""
    t = squeeze(c)
    return F.when(t.isNull(), None).when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def looks_tabular(c: Column) -> Column:
    gaps = F.regexp_count(c, F.lit(f"{WS}{{2,}}")) >= 2
    pipes = F.regexp_count(c, F.lit("\\|")) >= 2
    return gaps | pipes | c.rlike("^(?:[^\\s]+\\s+){0,2}\\d+(?:[.,]\\d+)?(?:\\s+\\d+(?:[.,]\\d+)?){2,}$")


def is_page_number(c: Column) -> Column:
    return clean_line(c).rlike("(?i)^(?:page\\s+)?(?:\\d{1,5}|[ivxlcdm]{1,12})(?:\\s+(?:of|/)\\s+\\d{1,5})?$")


def is_plausible_title(c: Column) -> Column:
    t = clean_line(c)
    stop = t.rlike("(?i)^(?:untitled|unknown|document|ebook|book)$") | t.rlike("(?i)^(?:copyright|contents|table of contents|isbn|published by|chapter|part)(?![A-Za-z0-9_])")
    file = t.rlike("(?i)\\.(?:pdf|indd|docx?|ps|eps)$|^(?:microsoft word|untitled[-\\s\\d]|\\d{5,}[_-])")
    return (F.length(t) >= 3) & (F.length(t) <= 180) & ~stop & ~file & (F.size(F.split(t, " ")) <= 28) & ~t.rlike("\\.\\s|\\.$")


def looks_capitalised(c: Column) -> Column:
    """At most 150 characters and 20 words, of which at least 55 % of those with letters start with a capital."""
    words = F.filter(F.split(clean_line(c), " "), lambda w: w.rlike("\\p{L}"))
    capital = F.filter(words, lambda w: w.rlike("^[^\\p{L}]*\\p{Lu}"))
    return (F.length(c) <= 150) & (F.size(words) <= 20) & (F.size(words) > 0) & (F.size(capital) >= F.size(words) * 0.55)


def title_kind(c: Column) -> Column:
    """struct(kind, level) of a section title, null if it names none."""
    k, raw, found = key(c), c, F.lit(None).cast("struct<kind:string,level:int>")
    for kind, level, on, pattern in reversed(TITLE_KINDS):
        found = F.when((k if on == "key" else raw).rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"))).otherwise(found)
    return found


NAMED_KEY = "|".join(f"(?:{pattern})" for _, _, on, pattern in TITLE_KINDS if on == "key")


def names_section(key_: Column, raw: Column) -> Column:
    """Whether a title names a section kind, from its key: one pattern instead of a ladder."""
    return key_.rlike(NAMED_KEY) | raw.rlike(f"(?i){PART_TITLE}") | raw.rlike(f"(?i){CHAPTER_TITLE}")


def _dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def title_similarity(a: Column, b: Column) -> Column:
    """For layout: equal 1, one inside the other the ratio of their lengths, else shared words (Dice)."""
    return key_similarity(key(a), key(b))


def key_similarity(x: Column, y: Column) -> Column:
    """``title_similarity`` of texts from their keys."""
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), ratio).otherwise(_dice(_words(x), _words(y)))


def word_similarity(a: Column, b: Column) -> Column:
    """For the scorecard: shared words (Dice), nothing else."""
    return _dice(_words(word_key(F.coalesce(a, F.lit("")))), _words(word_key(F.coalesce(b, F.lit("")))))


def context_grams(c: Column) -> Column:
    """Distinct runs of three words of a context key; its words if there are fewer."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, 3)))
    return F.array_distinct(F.when(F.size(words) < 3, words).otherwise(runs))


def gram_similarity(a: Column, b: Column) -> Column:
    return _dice(a, b)


@pandas_udf(StringType())
def context_hash(texts: pd.Series) -> pd.Series:
    """FNV-1a of 32 bits over UTF-16 code units, eight hex digits."""

    def one(text: str) -> str:
        value = 0x811C9DC5
        raw = text.encode("utf-16-le", "surrogatepass")
        for low, high in zip(raw[::2], raw[1::2]):
            value = ((value ^ (low | high << 8)) * 0x01000193) & 0xFFFFFFFF
        return f"{value:08x}"

    return texts.map(one, na_action="ignore")


def join_lines(lines: Column) -> Column:
    """Lines of a block as one text; a hyphen before a small letter at a line's start goes."""
    kept = F.filter(F.transform(lines, clean_line), lambda x: x != "")
    marked = F.array_join(kept, "\u0001")
    return F.regexp_replace(F.regexp_replace(marked, "-\u0001(?=\\p{Ll})", ""), "\u0001", " ")


def page_tier(pages: Column) -> Column:
    return F.when(pages < 150, "short").when(pages <= 350, "medium").when(pages.isNotNull(), "long")


def stable_id(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-256 of the parts' word keys that are not empty."""
    keys = F.filter(F.array(*[F.when(F.coalesce(p, F.lit("")) != "", word_key(p)) for p in parts]), lambda k: k.isNotNull())
    return F.substring(F.sha2(F.array_join(keys, "\u001f"), 256), 1, 20)


def needs_second_review(id_: Column, split: Column) -> Column:
    number = F.conv(F.substring(id_, 1, 8), 16, 10).cast("long")
    return F.coalesce(split.isin("development", "locked-test") & (number % 5 == 0), F.lit(False))


def strip_extension(c: Column) -> Column:
    return F.regexp_replace(c, "\\.[^.]+$", "")


def file_name(uri: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_extract(uri, "([^/?#]*)(?:[?#].*)?$", 1), "\\+", "%2B"))


def navigation_kind(kind: Column) -> Column:
    """The five kinds of navigation entries behind the kinds of sections."""
    return F.when(kind.isin(*FRONT_KINDS), "frontMatter").when(kind.isin(*BACK_KINDS), "backMatter").when(kind == "part", "part").when(kind == "section", "section").when(kind.isNotNull(), "chapter")


def half_up(c: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: Column, high: Column) -> Column:
    """NaN and null count as zero."""
    own = F.coalesce(F.when(F.isnan(c.cast("double")), None).otherwise(c), F.lit(0))
    return F.greatest(low, F.least(own, high))
