"""Smaller operators on lines, units and chapters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators.scans import map_groups
from quirefold.session import cut

CLOSED = re.compile(r"(?:[”’»）)\]}]+|[\"']+(?=\s|$))")
ENDED = re.compile(r"[.!?…][\"'”’»）)\]}]*$")
DOTS = re.compile(r"[\"'“‘]?\.{1,2}$")
GLYPH_RUNS = "bookid string, pageindex int, lineindex int, runno int, text string, sourcestart int, sourceend int, x double, y double, width double, height double, fontname string, fontsize double"


def move_closing_quotes(texts: list[str]) -> list[str]:
    """Closing quotes at the start of a text go to the end of the one before, if that ends a sentence; from the first on."""
    out = list(texts)
    for i in range(1, len(out)):
        m = CLOSED.match(out[i] or "")
        if m and ENDED.search(out[i - 1] or "") and (rest := out[i][m.end() :].lstrip()):
            out[i - 1] += m[0]
            out[i] = rest
    return out


def repaired_units(units: DataFrame, chunk: int = 2048) -> DataFrame:
    """bookid, unitno, text after the repair. A unit depends on the repaired one before only through its end, so a chunk with one unit on either side decides its own."""
    own = units.select("bookid", "unitno", F.coalesce("text", F.lit("")).alias("text"))
    cut_ = own.withColumn("chunk", F.floor(F.col("unitno") / chunk))
    first = F.col("unitno") % chunk == 0
    last = F.col("unitno") % chunk == chunk - 1
    copies = cut_.unionByName(cut_.where(first).withColumn("chunk", F.col("chunk") - 1)).unionByName(cut_.where(last).withColumn("chunk", F.col("chunk") + 1))

    def run(columns: dict[str, list]) -> dict[str, list]:
        return {"bookid": columns["bookid"], "chunk": columns["chunk"], "unitno": columns["unitno"], "text": move_closing_quotes(columns["text"])}

    fixed = map_groups(copies, ["bookid", "chunk"], ["unitno"], run, "bookid string, chunk long, unitno int, text string")
    return fixed.where(F.floor(F.col("unitno") / chunk) == F.col("chunk")).select("bookid", "unitno", "text")


def joined_dots(lines: list[dict]) -> list[dict]:
    """Runs of lines of one or two dots that begin an ellipsis, joined with the line they lead to."""
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) - 1 and DOTS.fullmatch(lines[j]["text"]):
            j += 1
        text = " ".join(r["text"] for r in lines[i : j + 1])
        if j > i and re.match(r"(?:[\"'“‘]?\.\s*){3}", text):
            out.append({**lines[j], "text": text, "sourcestart": lines[i]["sourcestart"]})
            i = j + 1
        else:
            out.append(lines[i])
            i += 1
    return out


def glyph_runs(glyphs: DataFrame) -> DataFrame:
    """GLYPH_RUNS from single characters (bookid, pageindex, glyphno, char, x, y, width, height, fontname, fontsize).

    A glyph joins one of the last four rows whose baseline is within 2.5 points; a row is cut where font or size changes or a gap opens.
    A page is one unit of work, in the order of its glyphs.
    """

    def run(columns: dict[str, list]) -> dict[str, list]:
        rows: list[dict] = []
        for g in (dict(zip(columns, r)) for r in zip(*columns.values())):
            row = next((r for r in reversed(rows[-4:]) if abs(r["y"] - g["y"]) <= 2.5), None)
            if row is None:
                row = {"y": g["y"], "glyphs": []}
                rows.append(row)
            row["glyphs"].append(g)
        out: dict[str, list] = {c.split(" ")[0]: [] for c in GLYPH_RUNS.split(", ")}
        at = 0
        for n, row in enumerate(sorted(rows, key=lambda r: r["y"])):
            runs: list[list[dict]] = []
            for g in sorted(row["glyphs"], key=lambda g: g["x"]):
                p = runs[-1][-1] if runs else None
                if p is None or p["fontname"] != g["fontname"] or abs(p["fontsize"] - g["fontsize"]) > 0.1 or g["x"] - p["x"] - p["width"] > max(1.0, g["fontsize"] * 0.25):
                    runs.append([])
                runs[-1].append(g)
            for k, own in enumerate(runs):
                text = "".join(g["char"] for g in own)
                x, y = own[0]["x"], min(g["y"] for g in own)
                values = (own[0]["bookid"], own[0]["pageindex"], n, k, text, at, at + len(text), x, y, own[-1]["x"] + own[-1]["width"] - x, max(g["height"] for g in own), own[0]["fontname"], own[0]["fontsize"])
                for c, v in zip(out, values):
                    out[c].append(v)
                at += len(text) + (k < len(runs) - 1)
            at += 1
        return out

    return map_groups(glyphs, ["bookid", "pageindex"], ["glyphno"], run, GLYPH_RUNS)


def distinct_nested(blocks: DataFrame) -> DataFrame:
    """Blocks (file, blockno, kind, text) without those that repeat the kept block before, or are prose that it ends with. A file is one unit of work."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        keep: list[int] = []
        for i, (kind, text) in enumerate(zip(columns["kind"], columns["text"])):
            if keep:
                k, t = columns["kind"][keep[-1]], columns["text"][keep[-1]]
                if text == t or kind == k == "prose" and (t or "").endswith(text or ""):
                    continue
            keep.append(i)
        return {c: [v[i] for i in keep] for c, v in columns.items()}

    return map_groups(blocks.select("file", "blockno", "kind", "text"), ["file"], ["blockno"], run, "file string, blockno int, kind string, text string")


def without_prefix_twins(chapters: DataFrame) -> DataFrame:
    """Chapters without those of which an earlier one on the page has the same title or one that begins with theirs, or the other way round; parts stay."""
    keyed = chapters.withColumn("_k", T.key(F.col("title")))
    a = keyed.where("kind <> 'part'").select("bookid", "pageindex", F.col("chapterno").alias("_no"), F.col("_k").alias("_a"))
    clash = (F.col("_no") < F.col("chapterno")) & ((F.col("_a") == F.col("_k")) | F.startswith("_a", F.concat("_k", F.lit(" "))) | F.startswith("_k", F.concat("_a", F.lit(" "))))
    gone = keyed.where("kind <> 'part'").join(a, ["bookid", "pageindex"]).where(clash).select("bookid", "chapterno").distinct()
    return keyed.drop("_k").join(gone, ["bookid", "chapterno"], "left_anti")


def only_known_families(chapters: DataFrame, known: DataFrame) -> DataFrame:
    """Chapters whose family (chapter, part, book, habit) the book's outline (bookid, title) numbers too; all of them for books with fewer than two numbered entries."""
    family = lambda c: F.lower(F.regexp_extract(c, "(?i)^(chapter|habit|part|book)\\s", 1))
    named = known.select("bookid", family(F.col("title")).alias("family")).where("family <> ''")
    series = named.where("family not in ('part', 'book')").groupBy("bookid").agg(F.count("*").alias("n")).where("n >= 2").select("bookid")
    kept = chapters.withColumn("family", family(F.col("title")))
    inside = kept.join(series, "bookid", "left_semi").join(named.distinct(), ["bookid", "family"], "left_semi").select(kept.columns)
    return kept.join(series, "bookid", "left_anti").unionByName(inside).drop("family")


def supplements(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """bookid, pageindex, blockno, kind, text, unitno: notes, captions, tables and references, each with the unit nearest by page; null in books without units.

    Where blocks and units have a sectionno, the nearest unit of the block's own section comes before that of the whole book. Units with sourcepages are near by each of these.
    """
    from quirefold.operators.scans import nearest

    sectioned = "sectionno" in blocks.columns and "sectionno" in units.columns
    section = [F.coalesce("sectionno", F.lit(-1)).alias("sectionno")] if sectioned else []
    aside = blocks.where(F.col("kind").isin("footnote", "caption", "table", "reference")).select("bookid", *section, "pageindex", "blockno", "kind", "text")
    page = F.explode("sourcepages").alias("pageindex") if "sourcepages" in units.columns else F.col("pageindex")
    own = units.select("bookid", *section, page, "unitno").where(F.col("pageindex").isNotNull())
    found = nearest(aside, own.select("bookid", "pageindex", "unitno"), ["bookid"], "pageindex", "unitno")
    if sectioned:  # each search reads its left side several times, so the first is written before the second
        found = nearest(cut(found).withColumnRenamed("unitno", "_whole"), own, ["bookid", "sectionno"], "pageindex", "unitno").withColumn("unitno", F.coalesce("unitno", "_whole"))
    return found.select("bookid", "pageindex", "blockno", "kind", "text", "unitno")


def reading_starts(sections: DataFrame) -> DataFrame:
    """bookid, startunit: where reading begins, from sections (bookid, sectionno, kind, startunit; -1 for none): the first body section other than foreword and preface, else the first of any body kind, else the start."""
    body = F.col("kind").isin(*T.BODY_KINDS) & (F.col("startunit") >= 0)
    strict = body & ~F.col("kind").isin("foreword", "preface")
    per = sections.groupBy("bookid").agg(F.min(F.when(strict, F.struct("sectionno", "startunit"))).alias("a"), F.min(F.when(body, F.struct("sectionno", "startunit"))).alias("b"))
    return per.select("bookid", F.coalesce("a.startunit", "b.startunit", F.lit(0)).alias("startunit"))


def unit_ranges(sections: DataFrame, units: DataFrame, most_depth: int = 1000) -> DataFrame:
    """``sections`` (bookid, sectionno, parentno) with startunit and endunit over their own units (bookid, unitno, sectionno) and those of the sections inside them; -1 for none.

    Ranges climb a level a round until none has a parent, so a round for each level of nesting; sections that contain each other raise an error.
    """
    level = units.groupBy("bookid", "sectionno").agg(F.min("unitno").alias("a"), F.max("unitno").alias("b"))
    parents = sections.where(F.col("parentno").isNotNull()).select("bookid", "sectionno", "parentno")
    reach = level
    if not parents.isEmpty():
        reach = level = cut(level)
        for _ in range(most_depth):
            level = cut(level.join(parents, ["bookid", "sectionno"]).groupBy("bookid", F.col("parentno").alias("sectionno")).agg(F.min("a").alias("a"), F.max("b").alias("b")))
            if level.isEmpty():
                break
            reach = reach.unionByName(level)
        else:
            raise RuntimeError("sections contain each other")
    whole = reach.groupBy("bookid", "sectionno").agg(F.min("a").alias("startunit"), F.max("b").alias("endunit"))
    return sections.join(whole, ["bookid", "sectionno"], "left").withColumns({"startunit": F.coalesce("startunit", F.lit(-1)), "endunit": F.coalesce("endunit", F.lit(-1))})


def gold_violations(gold: DataFrame) -> DataFrame:
    """bookid, rule: what is wrong with gold records: no title, a start before the first page, sections with an unknown kind or a page or level below zero, blocks without text, words below zero."""
    kinds = (*T.FRONT_KINDS, *T.BACK_KINDS, *T.BODY_KINDS, "acknowledgments")
    bad = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "title": F.coalesce(F.trim("title"), F.lit("")) == "", "readingstartpage": F.col("readingstartpage").isNull() | (F.col("readingstartpage") < 0), "bodywordcount": bad(F.col("bodywordcount") < 0),
        "sectionkind": bad(F.exists("sections", lambda s: ~F.coalesce(s["kind"].isin(*kinds), F.lit(False)))), "sectionplace": bad(F.exists("sections", lambda s: (s["startpage"] < 0) | (s["level"] < 0))),
        "blocktext": bad(F.exists("blocks", lambda b: F.coalesce(F.trim(b["text"]), F.lit("")) == "")),
    }
    failed = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())
    return gold.select("bookid", F.explode(failed).alias("rule")).distinct()


def unsteady_progress(progress: DataFrame) -> DataFrame:
    """Units at which a book's progress (bookid, unitno, fraction) falls, or leaves 0 to 1."""
    before = F.lag("fraction").over(Window.partitionBy("bookid").orderBy("unitno"))
    return progress.withColumn("before", before).where((F.col("before") > F.col("fraction")) | (F.col("fraction") < 0) | (F.col("fraction") > 1))
