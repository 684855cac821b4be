"""Sentence boundaries across languages and scripts (problem 2).

A text is cut at blank lines into blocks. Blocks without sentence structure are one unit. In the others every place
after a sentence sign (and after a space in Thai) is a candidate boundary, and a semi-Markov dynamic programme selects
the whole spans: a span's score sums the cue it opens with, the cue it closes with, what the two cues at a boundary say together, its
length and whether its quotations are balanced, and the best sequence of spans that tiles the block is taken. No cue decides
alone; the weights are in ``sentence_weights``, fitted on gold sentence ends. A place is left out beforehand only if its cues lose
more than length and quotations can give back, so that no best sequence has it. Offsets count code points of the stored text; a unit
runs from its first to its last visible character.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import sentence_weights
from quirefold.llm.chars import CYRILLIC_LOOK_ALIKES, GREEK_LOOK_ALIKES

# Abbreviations, without their last full stop, by what may follow them.
BEFORE_NAMES = "mr mrs ms messrs dr prof st ste mme mlle mm sr sra srta dra d. dña don fr rev hon gen col maj capt lt sgt gov pres sen rep hr fr. frl hl проф д-р г-н г-жа акад им ул κ κα δρ डॉ श्री प्रो د أ mt ft"
BEFORE_NUMBERS = "fig figs vol vols no nos nr nrn p pp pg pgs ch chap sec sect art eq eqs ed eds tab pl ca c circa approx b d fl r s bd abb anm núm núms pág págs cap t lám рис стр с гл табл т № см ст п σελ τόμ αρ εικ βλ ص ج ف जि पृ av apr janv feb mar jun jul aug sep sept oct nov dec jan"
INSIDE = "e.g i.e cf vs viz al ibid op cit loc z z.b d.h bzw vgl ggf evtl sog u.a u z.t usf. p.ex ex c.-à-d env p.ej ej напр т.е т.н тыс млн др. π.χ δηλ βλ. см dt engl bes inkl zzgl ca. approx v resp bl ebd"
MAY_END = "etc usw u.s.w co inc ltd corp bros jr sr. esq a.m p.m am pm a.d b.c b.c.e c.e t.d т.д т.п т.д д др г гг в вв н.э u.s u.k d.c ph.d m.d j.-c i.e. κ.λπ κλπ κ.ά π.χ. م هـ"
SINGLE_INSIDE = set("bdzpfrnvthecsтсгпрκσзнр")
MONTHS = "januar|jänner|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jahrhundert|kapitel|auflage|band|stock|klasse"
OPENERS = "the|a|an|it|they|he|she|we|in|on|at|as|but|and|although|when|while|if|after|before|behind|near|there|this|that|these|those|had|has|have|what|who|where|why|how|der|die|das|ein|eine|im|am|es|er|sie|wer|le|la|les|un|une|il|elle|qui|el|los|las|una|quién"
SPEECH_NAMED = "said|says|asked|cried|wrote|replied|answered|shouted|whispered|added|exclaimed|called|murmured|remarked|rief|fragte|sagte|dijo|preguntó|demanda|dit"
INNER = re.compile(r"[^\W\d_]{2}[.!?][”“»’\")]*\s+[^\W\d_]")
LETTERED = set("plan type class group vitamin grade section point option version hepatitis model case schedule route line platform variant category theory letter plans".split())
SPEECH = {
    "zh": re.compile(r"[^“”「」『』。！？]{0,80}(?:说|道|问|喊|答|叫|写|说道|问道|喊道|答道|叫道)[。！？]"),
    "ja": re.compile(r"と"),
    "hi": re.compile(r"[^।“”!?]{0,120}(?:कहा|पूछा|बोला|बोली|बोले|चिल्लाया|चिल्लाई|पुकारा|लिखा|सोचा|कहता|कहती|पूछता|पूछती)[^।“”!?]{0,20}[।]"),
    "ar": re.compile(r"(?:قال|قالت|سأل|سألت|صاح|صاحت|هتف|هتفت|أجاب|أجابت|كتب|كتبت|نادى|همس|رد)\b"),
    "th": re.compile(r"[^“”]{0,60}?(?:กล่าว|พูดว่า|ถาม|ร้อง|ตะโกน|ตอบ)"),
    "am": re.compile(r"(?:[^።“”«»]{0,80}(?:አለ|አለች|ጠየቀ|ጠየቀች|ብሎ|ብላ|ጮኸ|መለሰ)\s*።)|(?:ሲል|ብሎ)"),
}
LATIN_FOR = {ord(p[0]): p[1] for p in f"{CYRILLIC_LOOK_ALIKES} {GREEK_LOOK_ALIKES}".split()}
CYRILLIC_FOR = {ord(p[1]): p[0] for p in reversed(CYRILLIC_LOOK_ALIKES.split())}
LABEL = re.compile(
    r"\W*(?:fig(?:ure|s|\.)?|tab(?:le|\.|elle)?|plate|pl\.|chart|map|photo|illustration|ill\.|box|scheme|chapter|part|appendix|section|note|abb(?:ildung|\.)|figura|cuadro|tabla|tableau|capítulo|chapitre|kapitel|teil|рис\.|рисунок|таблица|глава|часть|εικόνα|πίνακας|κεφάλαιο|图|表|図|第)\s*"
    r"(?:[0-9]+(?:[.-][0-9]+)*|[ivxlcdm]+|[a-z](?:-?[0-9]+)?)\b\s*[.:)–—-]?",
    re.I,
)
NUMBERED = re.compile(r"\W{0,3}(?:[0-9]{1,4}(?:\.[0-9]+)*|[ivxlcdm]{1,6}|[a-z](?:-[0-9]+)?)[.):]\s", re.I)
INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
BLANK = re.compile(r"\n(?:[^\S\n]|[­​-‏⁠﻿])*(?=\n)")
SIGNS = ".!?…؟።፧।॥。！？｡"
WIDE = "。！？｡"
CLOSING = "”’\"'»›)]}」』）】》〉］"
TERM = {german: re.compile(rf"[{SIGNS};;]+(?:\s?[»›]|[{re.escape(CLOSING)}{'“‘' if german else ''}])*") for german in (False, True)}
OPENING_QUOTES, CLOSING_QUOTES = "“„«「『‘", "”»」』"
OPENS = "“„«‘¿¡「『("
COUNTED = re.compile(r"[ivxlcdm]+\b|[A-Z]-?\d", re.I)
INITIAL = re.compile(r"\w\.(?!\w)")
SPACES = re.compile(r"\s+")
ODD_SPACE = re.compile(r"[^\S\n ]")
THAI = re.compile("[ก-๎]")
WORD_BEFORE = re.compile(r"[^\s(\[{«“„\"‘—–/]*$")
BREAKS_LEFT = re.compile(r"[\w]")
_names, _numbers, _inside, _may_end = (set(x.split()) for x in (BEFORE_NAMES, BEFORE_NUMBERS, INSIDE, MAY_END))
_months, _opener, _named = re.compile(rf"(?:{MONTHS})\b", re.I), re.compile(rf"\W*(?:{OPENERS})\b", re.I), re.compile(rf"(?:[^\W\d_][\w’'-]*\s){{1,2}}(?:{SPEECH_NAMED})\b(?!\W{{0,3}}[“\"‘«„])")
CJK = re.compile("[぀-ヿ㐀-鿿]")


def _lower(c: str) -> bool:
    return unicodedata.category(c) == "Ll"


def _folded(word: str) -> str:
    """A word in ordinary letters, composed, look-alikes of Latin letters exchanged if it has Latin ones."""
    word = unicodedata.normalize("NFKC", word)
    latin = word.translate(LATIN_FOR)
    if not re.search("[A-Za-z]", word) or latin == word:
        return word
    return word.translate(CYRILLIC_FOR) if re.search("[а-яА-Я]", latin) else latin


def structureless(block: str) -> bool:
    """Headings, captions, running lines, page numbers: no sentence signs at the end and mostly names, capitals or a label."""
    lines = block.count("\n") + 1
    flat = SPACES.sub(" ", INVISIBLE.sub("", block)).strip()
    if not flat:
        return True
    bare = flat.rstrip(CLOSING + "“‘ ")
    ends = bool(bare) and bare[-1] in SIGNS
    if LABEL.match(flat) and lines <= 3 and not ends:
        return True
    words = [w for w in re.findall(r"[^\W\d_][\w’'-]*", flat)]
    if not words:
        return not THAI.search(flat)
    if lines > 3 or len(flat) > 260:
        return False
    cased = [w for w in words if w[0].upper() != w[0].lower()]
    if len(cased) * 2 < len(words):
        return False
    long = [w for w in cased if len(w) > 3] or cased
    capital = sum(w[0].isupper() for w in long)
    if all(w.isupper() for w in cased) and len(flat) > 3:
        return True
    inner = INNER.search(flat)
    if not ends and capital >= 0.75 * len(long) and (not inner or LABEL.match(flat, inner.end() - 1)):
        return True
    return bool(not ends and lines == 1 and len(words) <= 16 and not inner)


def _cues(text: str, at: int, end: int) -> tuple[str, str]:
    """How a span closes at the sign text[at:end] (closers included), and how one opens behind it."""
    nxt, n = end, len(text)
    while nxt < n and text[nxt].isspace():
        nxt += 1
    if nxt >= n:
        return "edge", "edge"
    c, sign, run = text[nxt], text[at], text[at:end]
    quoted = any(q in "”’\"'»“‘」』" for q in run)
    head = run.rstrip(CLOSING + "“‘ ")
    after = text[nxt : nxt + 60].lstrip("“”„\"'«‘’([{¿¡—–- \n「『（") if not c.isalnum() else text[nxt : nxt + 40]
    first = after[:1]
    close = _closing_cue(text, at, end, nxt, head, quoted, first, after)
    return close, _opening_cue(text, nxt, c, first, after, quoted, close)


def _opening_cue(text: str, nxt: int, c: str, first: str, after: str, quoted: bool, close: str) -> str:
    """What stands where a span would open."""
    if c in ",;:.!?…؟،؛、，；：)]}’”»」』）" and c != "’":
        return "sign"
    if first and _lower(first):
        return "small"
    if quoted:
        rest = text[nxt : nxt + 160]
        key = "ja" if rest[:1] == "と" else "zh" if CJK.match(rest) else "hi" if "ऀ" <= c <= "ॿ" else "ar" if "؀" <= c <= "ۿ" else "th" if "฀" <= c <= "๿" else "am" if "ሀ" <= c <= "፿" else ""
        if key and SPEECH[key].match(rest):
            return "speaker"
        if not key and _named.match(rest):
            return "named"
    if close == "number" and _months.match(after):
        return "month"
    if first.isdigit() or (close.startswith("counting") and COUNTED.match(after)):
        return "digit"
    if _opener.match(after):
        return "opener"
    return "capital" if c.isupper() else "uncased" if first and first.upper() == first.lower() and c not in "“«「『" else "other"


def _closing_cue(text: str, at: int, end: int, nxt: int, head: str, quoted: bool, first: str, after: str) -> str:
    """What stands where a span would close: the kind of sign, and of the word before a single full stop."""
    sign, c, n = text[at], text[nxt], len(text)
    if sign == ";":
        before = next((x for x in reversed(text[max(0, at - 3) : at]) if x.isalpha()), "")
        if not "Ͱ" <= before <= "Ͽ" and not "ἀ" <= before <= "῿":
            return "semicolon"
    if any(s in WIDE or s in "።፧።॥।" for s in head):
        return "wide"
    pause = set(head) <= {".", "…", "‥"} and head != "."
    if nxt == end:
        # Two sentences may lack a gap: a small letter, the sign, a capital; no address around it.
        back = text[max(0, at - 2) : at]
        token = text[max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1 : n if text.find(" ", at) < 0 else text.find(" ", at)]
        word = len(back) == 2 and back.isalpha() and (_lower(back[1]) or back[1].upper() == back[1])
        opens = c in OPENS or c.isalpha()
        address = "/" in token or "@" in token or token.lower().startswith("www") or (token.count(".") > 1 and "..." not in token and not quoted)
        large = c.isupper() or c in OPENS or first.upper() == first.lower()
        if not (word and opens and not address and large) or (head != "." and set(head) == {"."} and not c.isupper()):
            return "inside"
        return "gapless pause" if pause and not quoted else "gapless"
    if head != ".":
        return "pause" if pause and not quoted else "mark"
    word = WORD_BEFORE.search(text[max(0, at - 24) : at])[0]
    if quoted or not word:
        return "quoted" if quoted or text[at - 1 : at] in CLOSING else "bare"
    if not word.isascii() and len(word) < 12:
        word = _folded(word)
    low = word.lower()
    before = text[max(0, at - len(word) - 14) : at - len(word)].rstrip()
    if word.isdigit():
        return "number" if len(word) <= 2 else "large number"
    joined = WORD_BEFORE.search(before)[0].lower() + low if len(low) == 1 and before.endswith(".") else low
    initials = joined != low and word.isupper() and not re.search(r"\d\s*$", before[: -len(joined) + len(low)])
    if (joined in _may_end and not initials) or (low in _may_end and len(low) > 1):
        return "may end"
    if len(word) == 1 and word.isalpha():
        if word.isupper() or word == word.upper() != word.lower():
            tail = WORD_BEFORE.search(before)[0]
            if tail and _lower(tail[0]) and before[-1:].isalpha() and c not in "—–-" and not INITIAL.match(after):
                return "lettered" if tail.lower() in LETTERED else "late initial"
            return "initial"
        return "abbreviation" if low in SINGLE_INSIDE else "single"
    if low in _names or low in _inside or joined in _inside:
        return "abbreviation"
    if low in _numbers:
        return "counting" if len(low) > 2 else "counting short"
    if "." in word and word.replace(".", "").isalpha() and max(map(len, word.split("."))) <= 2:
        return "dotted"
    return "stop"


def _thai_gaps(text: str) -> list[tuple[int, str, str]]:
    """Spaces between Thai words, none beside a number, with their cues."""
    found = []
    for m in re.finditer(r"[^\S\n]+", text):
        a, b = m.span()
        if a == 0 or b >= len(text):
            continue
        left, right = text[a - 1], text[b]
        if left == "\n" or right == "\n" or left.isdigit() or right.isdigit():
            continue
        thai_left = "฀" <= left <= "๿" or (left in CLOSING + "“" and THAI.search(text[max(0, a - 6) : a]))
        thai_right = "฀" <= right <= "๿" or (right in "“‘«(\"" and THAI.match(text[b + 1 : b + 2]))
        if thai_left and thai_right and left not in "“‘«(" and right not in "ๆฯ”’»)":
            speaks = left in CLOSING and SPEECH["th"].match(text[b : b + 90].split(" ")[0])
            found.append((a, "space", "speaker" if speaks else "uncased"))
    return found


def _balance(text: str, places: list[int]) -> list[int]:
    """Open quotations at each place."""
    if not any(q in text for q in "“„«」」『”»"):
        return [0] * len(places)
    low9 = "„" in text
    depth, out, at = 0, [], 0
    for p in places:
        for c in text[at:p]:
            if c in "„«「『" or (c == "“" and not low9):
                depth += 1
            elif c in "”»」』" or (c == "“" and low9):
                depth -= 1
        out.append(depth)
        at = p
    return out


def candidates(text: str) -> list[tuple[int, str, str]]:
    """(place, closing cue, opening cue) of every place in a block where a span may end, but its end."""
    label = LABEL.match(text) or NUMBERED.match(text)
    shut, last = label.end() if label else 0, len(text.rstrip())
    found = []
    german = "„" in text or "‚" in text
    quotes, seen = 0, 0  # straight quotes so far
    for m in TERM[german].finditer(text):
        at, end = m.span()
        if '"' in m[0] and end < len(text) and not text[end].isspace():
            q = text.index('"', at)
            quotes, seen = quotes + text.count('"', seen, q), q
            if quotes % 2 == 0 and text[q + 1 : q + 2].isalnum():
                end = q
        if shut < end < last:
            found.append((end, *_cues(text, at, end)))
    if THAI.search(text):
        found = sorted(found + [x for x in _thai_gaps(text) if x[0] < last])
    return found


class Scores:
    """The weights as the programme reads them."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.lengths = [weights[f"length {b}"] for b in sentence_weights.LENGTHS]
        self.balance = [weights[f"quotes {b}"] for b in sentence_weights.QUOTES]
        self.known: dict[tuple[str, str], tuple[float, float]] = {}
        self.most = max(self.lengths) + max(self.balance)  # what length and quotations give a span at most
        self.slack = 2 * self.most - min(self.lengths) - min(self.balance)

    def at(self, close: str, open_: str) -> tuple[float, float]:
        """What a boundary gives the span that closes there and the one that opens."""
        if (close, open_) not in self.known:
            w = self.weights
            self.known[close, open_] = w.get(f"close {close}", 0.0) + w.get(f"close {close} open {open_}", 0.0) + w["span"], w.get(f"open {open_}", 0.0)
        return self.known[close, open_]


def balance_of(before: int, behind: int) -> int:
    """Number in QUOTES: none open at either end of a span, opened in it, closed in it, open at both ends."""
    return (before != 0) * 2 + (behind != 0) if before != behind or not before else 3


def length_of(size: int) -> int:
    return bisect_right(sentence_weights.BOUNDS, size)


def best_spans(text: str, places: list[tuple[int, str, str]], scores: Scores, extra: list[float] | None = None) -> list[tuple[int, int]]:
    """The spans that tile a block with the best sum of scores; ``places`` are its candidates, ``extra`` what else each of them is worth."""
    at = [(p, *scores.at(close, open_)) for p, close, open_ in places]
    if extra:
        at = [(p, c + x, o) for (p, c, o), x in zip(at, extra)]
    at = [x for x in at if x[1] + x[2] + scores.slack >= 0]
    if not at:
        return [(0, len(text))]
    ends = [0, *(x[0] for x in at), len(text)]
    close = [0.0, *(x[1] for x in at), 0.0]
    opening = [0.0, *(x[2] for x in at), 0.0]
    depth = _balance(text, ends)
    content = [0]
    for a, b in zip(ends, ends[1:]):
        content.append(content[-1] + (1 if BREAKS_LEFT.search(text, a, b) else 0))
    best, back = [0.0] + [float("-inf")] * (len(ends) - 1), [0] * len(ends)
    most = [0.0]  # the best start up to each place
    for j in range(1, len(ends)):
        for i in range(j - 1, -1, -1):
            if most[i] + close[j] + scores.most < best[j]:
                break  # nothing further back can beat what is found
            score = best[i] + opening[i] + close[j] + scores.lengths[length_of(ends[j] - ends[i])] + scores.balance[balance_of(depth[i], depth[j])]
            if content[j] == content[i]:
                score -= 20.0  # nothing to read in it
            if score >= best[j]:
                best[j], back[j] = score, i
        most.append(max(most[-1], best[j] + opening[j]))
    out, j = [], len(ends) - 1
    while j > 0:
        out.append((ends[back[j]], ends[j]))
        j = back[j]
    return out[::-1]


SCORES = Scores(sentence_weights.WEIGHTS)


def _spans(text: str) -> list[tuple[int, int]]:
    """The spans of one block with sentence structure, as places in it."""
    return best_spans(text, candidates(text), SCORES)


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in code points; none for a null, empty or invisible text."""
    if not text:
        return []
    found: list[tuple[int, int]] = []
    start = 0
    bounds = []
    for m in BLANK.finditer(text):
        bounds.append((start, m.start()))
        start = m.end()
    bounds.append((start, len(text)))
    for a, b in bounds:
        block = text[a:b]
        if not block.strip():
            continue
        where = None
        clean = block
        if INVISIBLE.search(block):
            where = [i for i, c in enumerate(block) if not INVISIBLE.match(c)]
            clean = "".join([block[i] for i in where])
        if not clean.strip():
            continue
        if ODD_SPACE.search(clean):
            clean = ODD_SPACE.sub(" ", clean)
        spans = [(0, len(clean))] if structureless(clean) else _spans(clean)
        for s, e in spans:
            while s < e and clean[s].isspace():
                s += 1
            while e > s and clean[e - 1].isspace():
                e -= 1
            if s < e:
                found.append((a + s, a + e) if where is None else (a + where[s], a + where[e - 1] + 1))
    return found


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        rows, starts, ends = [], [], []
        for i, text in enumerate(texts):
            for s, e in sentence_units(text):
                rows.append(i)
                starts.append(s)
                ends.append(e)
        take = batch.select(range(batch.num_columns - 1)).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*take.columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*take.schema.names, "sentstart", "sentend"])


def with_sentences(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, sentstart, sentend: one row per sentence unit. Null and empty texts have none; repeated rows repeat theirs."""
    own = docs.where(F.length(text) > 0).select(*keys, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(_run, f"{kinds}, sentstart int, sentend int")


def page_and_unit_texts(pages: DataFrame, predictions: DataFrame) -> DataFrame:
    """itemkind, bookid, itemno, text of every page and every reading unit that has one."""
    a = pages.select(F.lit("page").alias("itemkind"), "bookid", F.col("pageindex").cast("int").alias("itemno"), "text")
    b = predictions.select("bookid", F.posexplode("readingunits").alias("itemno", "u")).select(F.lit("unit").alias("itemkind"), "bookid", "itemno", F.col("u.text").alias("text"))
    return a.unionByName(b).where(F.length("text") > 0)


def page_and_unit_sentences(pages: DataFrame, predictions: DataFrame) -> DataFrame:
    """The sentence units of every page's text and of every reading unit."""
    # Repeated rows are few; their sentences are dropped at the end, so that no text is shuffled.
    return with_sentences(page_and_unit_texts(pages, predictions), ["itemkind", "bookid", "itemno"], "text").distinct()
