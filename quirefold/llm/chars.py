"""Visually identical text in one form (problem 5).

The text of an Arrow batch is copied once to a numpy array of code points. Every step after that is a gather
or a scan over the whole array: lookup tables give each code point's replacement and its length, expansion
offsets place the replacements, marks are ordered and composed by table, and letters of a word that mixes
scripts are exchanged for their look-alikes of the script that the word is in. No string call is made per row.

Plain form: no invisible characters, no space but U+0020, composed accents (NFC), ordinary letters and digits
(no variants of width or style, no joined letters), every word in one script. Superscripts, fractions, dashes,
curly quotes, ellipses and the punctuation of Chinese and Japanese stay as they are.

Nulls stay null and empty texts empty; runs of ordinary spaces are kept, and so is the line feed unless a text is one line; other line ends
count as invisible (carriage return) or as spaces (tab, form feed, separators).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LIMIT = 0x110000
LATIN, GREEK, CYRILLIC, OTHER = 1, 2, 3, 4

# Letters of Greek and Cyrillic that look like Latin ones, in natural order.
CYRILLIC_LOOK_ALIKES = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ѵv кk"
GREEK_LOOK_ALIKES = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa γy ιi κk νv οo ρp τt υu χx ϲc ϳj"
# Cf characters that are visible, and invisible characters outside Cf.
VISIBLE_FORMAT = (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2065, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
STYLE_TAGS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
KEPT_COMPAT = (0x00B5, 0x03F2, 0x03F9, 0x0E33, 0x0EB3)  # micro sign, lunate sigma (a look-alike of c), Thai and Lao AM: usual spellings


def _plain(cp: int) -> str:
    """What one code point becomes, canonically decomposed."""
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cp == 10:
        return ch
    if cp in INVISIBLE or (cat == "Cf" and cp not in VISIBLE_FORMAT):
        return ""
    if cat == "Cc":
        return " " if cp in (9, 11, 12, 0x85) else ""
    if cat in ("Zs", "Zl", "Zp"):
        return " "
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0][0] == "<":
        tag = parts[0]
        letterlike = cat[0] == "L" or cat in ("Nd", "Nl") or 0x2E80 <= cp <= 0x2FDF
        joined = tag == "<compat>" and cp not in KEPT_COMPAT and not 0x3131 <= cp <= 0x318E
        if letterlike and (tag in STYLE_TAGS or joined):
            return unicodedata.normalize("NFKD", ch)
        return ch
    return unicodedata.normalize("NFD", ch)


class Tables:
    """Lookup tables over all code points, built by rule from the Unicode data of the interpreter."""

    def __init__(self) -> None:
        self.length = np.ones(LIMIT, np.uint8)
        self.offset = np.arange(LIMIT, dtype=np.uint32)
        self.klass = np.zeros(LIMIT, np.uint8)
        self.script = np.zeros(LIMIT, np.uint8)
        self.wordy = np.zeros(LIMIT, bool)
        self.attention = np.zeros(LIMIT, bool)
        self.accented = np.zeros(LIMIT, bool)
        extra: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        for cp in range(LIMIT):
            if 0xD800 <= cp < 0xE000 or 0xE1000 <= cp or 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or 0x20000 <= cp <= 0x2F7FF or 0x30000 <= cp < 0xE0000:
                continue
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat == "Cn":
                continue
            if ccc := unicodedata.combining(ch):
                self.klass[cp] = ccc
            self.wordy[cp] = cat[0] in "LM" or cat == "Nd"
            if cat[0] == "L":
                name = unicodedata.name(ch, "")
                self.script[cp] = LATIN if name.startswith("LATIN") else GREEK if name.startswith("GREEK") else CYRILLIC if name.startswith("CYRILLIC") else OTHER
            out = _plain(cp)
            if out != ch:
                self.length[cp] = len(out)
                self.offset[cp] = LIMIT + len(extra)
                extra.extend(map(ord, out))
            self.accented[cp] = any(map(unicodedata.combining, out))
            if unicodedata.normalize("NFC", out) != ch or ccc:
                self.attention[cp] = True
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                pairs[int(parts[0], 16), int(parts[1], 16)] = cp
        self.wordy[0x3400:0xA000] = self.wordy[0xAC00:0xD7A4] = self.wordy[0x20000:0x2F800] = self.wordy[0x30000:0x33480] = True
        self.script[0x3400:0xA000] = self.script[0xAC00:0xD7A4] = self.script[0x20000:0x2F800] = self.script[0x30000:0x33480] = OTHER
        self.attention[0x1100:0x1200] = True
        for _, second in pairs:
            self.attention[second] = True
        self.flat = np.concatenate([np.arange(LIMIT, dtype=np.uint32), np.array(extra, np.uint32)])
        keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_values = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        self.second = np.zeros(LIMIT, bool)
        self.second[[b for _, b in pairs]] = True
        self.second[0x1161:0x1176] = self.second[0x11A8:0x11C3] = True
        self.swap = {s: np.arange(LIMIT, dtype=np.uint32) for s in (LATIN, GREEK, CYRILLIC)}
        for script, words in ((CYRILLIC, CYRILLIC_LOOK_ALIKES), (GREEK, GREEK_LOOK_ALIKES)):
            for theirs, latin in words.split():
                self.swap[LATIN][ord(theirs)] = ord(latin)
                if self.swap[script][ord(latin)] == ord(latin):
                    self.swap[script][ord(latin)] = ord(theirs)
        for script, other in ((GREEK, CYRILLIC), (CYRILLIC, GREEK)):
            for a in np.flatnonzero(self.script == other):
                if (latin := self.swap[LATIN][a]) != a and self.swap[script][latin] != latin:
                    self.swap[script][a] = self.swap[script][latin]
        self.look_alike = np.zeros(LIMIT, bool)
        for table in self.swap.values():
            self.look_alike |= table != np.arange(LIMIT)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array, and where each row starts (one more than there are rows). Nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = memoryview(data)[starts[0] : starts[-1]] if data is not None else b""
    cps = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=heads[1:])
    return cps, heads[starts - starts[0]]


def to_arrow(cps: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The inverse of code_points()."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    offsets = ends[starts].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string() if len(data) < 2**31 else pa.large_string())


def _rows_with(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows have a code point in the mask."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[starts[1:]] > total[starts[:-1]]


def _expand(cps: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    length = t.length[cps].astype(np.int64)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    source = np.repeat(t.offset[cps].astype(np.int64) - ends[:-1], length) + np.arange(ends[-1])
    return t.flat[source], ends[starts]


def _order_marks(cps: np.ndarray, starts: np.ndarray, t: Tables) -> np.ndarray:
    """Canonical order: within a run of marks of one row, stable by class."""
    klass = t.klass[cps]
    if not ((klass[1:] < klass[:-1]) & (klass[1:] > 0)).any():
        return cps
    first = np.zeros(len(cps) + 1, bool)
    first[starts] = True
    run = np.cumsum((klass == 0) | first[:-1])
    return cps[np.lexsort((np.arange(len(cps)), klass, run))]


def _one_script(cps: np.ndarray, starts: np.ndarray, t: Tables, context: bool) -> np.ndarray:
    script = t.script[cps]
    present = np.stack([_rows_with(script == s, starts) for s in (LATIN, GREEK, CYRILLIC)])
    mixed = present.sum(0) > 1
    if not mixed.any():
        return cps
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    wordy = t.wordy[cps]
    begins = np.zeros(len(cps), bool)
    begins[starts[:-1][starts[:-1] < len(cps)]] = True
    begins[1:] |= wordy[1:] & ~wordy[:-1]
    word = np.cumsum(begins) - 1
    at = np.flatnonzero(mixed[row] & (script > 0) & (script < OTHER))
    firm = ~t.look_alike[cps[at]]
    n = int(word[-1]) + 1
    total = np.bincount(word[at] * 4 + script[at], minlength=4 * n).reshape(n, 4)[:, 1:]
    strong = np.bincount(word[at[firm]] * 4 + script[at[firm]], minlength=4 * n).reshape(n, 4)[:, 1:]
    rows = np.bincount(row[at[firm]] * 4 + script[at[firm]], minlength=4 * len(mixed)).reshape(-1, 4)[:, 1:]
    whose = np.zeros(n, np.int64)
    whose[word[at]] = row[at]
    # Letters without a look-alike decide; else the script of the row's other words; else the script with more letters.
    weight = strong * 1e9 + np.where(strong.sum(1, keepdims=True) == 0, np.minimum(rows[whose], 1e5) * 1e3, 0) + np.minimum(total, 999)
    target = weight.argmax(1) + 1
    several = (total > 0).sum(1) > 1
    if context:
        several |= (total.sum(1) > 0) & (strong.sum(1) == 0)
    out = cps.copy()
    for s in (LATIN, GREEK, CYRILLIC):
        hit = at[several[word[at]] & (target[word[at]] == s) & (script[at] != s)]
        out[hit] = t.swap[s][cps[hit]]
    return out


def _compose(cps: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Join starters and marks until nothing joins any more."""
    first = np.zeros(len(cps) + 1, bool)
    first[starts] = True
    first = first[:-1]
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    while len(cps):
        klass = t.klass[cps]
        index = np.arange(len(cps))
        starter = np.maximum.accumulate(np.where((klass == 0) | first, index, 0))
        before = np.empty_like(starter)
        before[0], before[1:] = 0, starter[:-1]  # the last starter before each place
        gap = np.zeros(len(cps), np.uint8)
        gap[1:] = klass[:-1]
        open_ = (before == index - 1) | ((klass > 0) & (gap > 0) & (gap < klass))
        at = np.flatnonzero(t.second[cps] & open_ & ~first & (klass[before] == 0))
        if not len(at):
            break
        a, b = cps[before[at]].astype(np.int64), cps[at].astype(np.int64)
        key = (a << 21) | b
        place = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        made = np.where(t.pair_keys[place] == key, t.pair_values[place], 0).astype(np.int64)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        made = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, made)
        lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b < 0x11C3)
        made = np.where(lvt, a + b - 0x11A7, made)
        ok = np.flatnonzero(made)
        if not len(ok):
            break
        _, once = np.unique(before[at[ok]], return_index=True)  # one mark for each starter and round
        ok = ok[once]
        cps = cps.copy()
        cps[before[at[ok]]] = made[ok]
        keep = np.ones(len(cps), bool)
        keep[at[ok]] = False
        cps, first, row = cps[keep], first[keep], row[keep]
    ends = np.zeros(len(starts), np.int64)
    np.cumsum(np.bincount(row, minlength=len(starts) - 1), out=ends[1:])
    return cps, ends


def plain_texts(texts: pa.Array, context: bool = False, marks: bool = True, lines: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Plain form of every text, and which texts changed. Without ``marks``, letters lose their accents; without ``lines``,
    a line feed is a space like the others, as in titles and other texts of one line.

    With ``context``, a word made of look-alikes only also goes to the script of its row's other words; this is
    for comparing texts, not part of the plain form.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    t = tables()
    cps, starts = code_points(texts)
    script = t.script[cps]
    need = _rows_with(t.attention[cps], starts)
    need |= np.stack([_rows_with(script == s, starts) for s in (LATIN, GREEK, CYRILLIC)]).sum(0) > 1
    changed = np.zeros(len(texts), bool)
    if not marks:
        need |= _rows_with(t.accented[cps], starts)
    if not lines and (feeds := cps == 10).any():
        need |= _rows_with(feeds, starts)
        cps = np.where(feeds, np.uint32(32), cps)
    if not need.any():
        return texts, changed
    part = cps[np.repeat(need, np.diff(starts))]
    bounds = np.concatenate([[0], np.cumsum(np.diff(starts)[need])])
    part, bounds = _expand(part, bounds, t)
    part = _order_marks(part, bounds, t)
    part = _one_script(part, bounds, t, context)
    if not marks:
        bare = t.klass[part] == 0
        kept = np.concatenate([[0], np.cumsum(bare)])
        part, bounds = part[bare], kept[bounds]
    part, bounds = _compose(part, bounds, t)
    new = to_arrow(part, bounds)
    if new.type != texts.type:
        new = new.cast(texts.type)
    differs = pc.fill_null(pc.not_equal(new, texts.filter(pa.array(need))), False).to_numpy(zero_copy_only=False)
    changed[np.flatnonzero(need)[differs]] = True
    if changed.any():
        texts = pc.replace_with_mask(texts, pa.array(changed), new.filter(pa.array(differs)))
    return texts, changed


def bounded(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes each (one long text is a slice by itself), as the arrays made of them are many times larger."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // most
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def with_plain(df: DataFrame, column: str, out: str = "plain", changed: str | None = None, context: bool = False, marks: bool = True, lines: bool = True) -> DataFrame:
    """``df`` with the plain form of ``column`` and, if named, whether it differs. Existing columns of these names are replaced."""
    base = df.drop(*[c for c in (out, changed) if c and c != column])
    place = base.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, place)):
            new, differs = plain_texts(batch.column(place), context, marks, lines)
            columns, names = list(batch.columns), list(batch.schema.names)
            if out == column:
                columns[place] = new
            else:
                columns.append(new)
                names.append(out)
            if changed:
                columns.append(pa.array(differs))
                names.append(changed)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    target = StructType(list(base.schema.fields))
    if out != column:
        target = target.add(out, "string")
    if changed:
        target = target.add(changed, "boolean")
    return base.mapInArrow(run, target)


def not_plain(spans: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows of text_span and of annotation whose text is not in plain form; repeated rows count once, nulls are plain."""
    a = with_plain(spans.select("bookid", "pageindex", "spanindex", "text").where(F.col("text").isNotNull()), "text", changed="_differs", lines=False)
    b = with_plain(annotations.select("bookid", F.col("title").alias("text")).where(F.col("text").isNotNull()), "text", changed="_differs", lines=False)
    a = a.where("_differs").select(F.lit("span").alias("reckind"), "bookid", F.col("pageindex").cast("int").alias("pageindex"), F.col("spanindex").cast("int").alias("spanindex"))
    b = b.where("_differs").select(F.lit("annotation").alias("reckind"), "bookid", F.lit(-1).alias("pageindex"), F.lit(-1).alias("spanindex"))
    return a.unionByName(b).distinct()
