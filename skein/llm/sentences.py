"""Sentence units of texts in many scripts, in SQL expressions alone.

What looks like an end but is none (initials, abbreviations, ordinals,
whatever stands in quotes, brackets or list lines) is masked with private-use
placeholders, one for one, so that positions stay; the points of decimals and
addresses have no blank behind them and are left as they are. A marker is then
put after every end that is left, by rules for each script, and the text is
cut at the markers. Positions of the original text are what comes out, so it
is restored without a pass of its own.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import let

ENDS = ".!?…。！？।॥։؟۔;;"
#: Placeholders for ENDS and for the marks of list lines, and the marker of a cut; a text's own of these (PRIVATE) are replaced by OTHER first.
MASKS, MARKS = "".join(chr(0xE000 + i) for i in range(len(ENDS))), "•*)"
MARK_MASKS, CUT, OTHER, PRIVATE = "".join(chr(0xE0F0 + i) for i in range(len(MARKS))), chr(0xE0FE), chr(0xE0FF), f"{chr(0xE000)}-{chr(0xE0FF)}"
#: Abbreviations after which a sentence goes on, whatever follows.
ALWAYS = ["Dr", "Prof", "Mr", "Mrs", "Ms", "Mt", "St", "Sr", "Jr", "vs", "cf", "vgl", "approx", "aprox", "env", "ca", "bzw", "Sra", "Dra", "Hr", "Fr", "Mme", "Mlle", "прибл", "им", "см", "Δρ", "κ", "π.χ", "प्रो", "डॉ", "श्री", "أ", "د", "e.g", "i.e", "z. B", "z.B", "d. h", "u. a", "p. ej", "p. ex", "т. е", "т.е", "a. C", "d. C", "av. J.-C", "apr. J.-C"]
#: Those that do so only before a number.
NUMBERED = ["No", "Nos", "Nr", "Fig", "fig", "Figs", "Abb", "Tab", "p", "pp", "Vol", "vol", "S", "Bd", "núm", "Núm", "рис", "стр", "αρ", "क्र", "sec", "Sec", "ch", "Eq", "eq"]
MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember", "Jahrhundert", "Jahrhunderts", "Jh", "Jan", "Feb", "Aug", "Sept", "Okt", "Nov", "Dez"]
#: Parts of a text that one fold adds up.
CHUNK = 256
HIDDEN = "­​‌‍⁠﻿"
CLOSERS = "\"”’'»)\\]」』）】》"


def _loose(words: list[str], plain: bool) -> str:
    """An alternation of the words with any blank for a blank; unless plain, in composed and decomposed spelling and with invisible characters anywhere."""
    gap = "" if plain else f"[{HIDDEN}]{{0,2}}"

    def one(w: str) -> str:
        return gap.join(r"\s{0,3}" if ch == " " else f"\\{ch}" if ch in ".-" else ch for ch in w)

    forms = {unicodedata.normalize(f, w) for w in words for f in (("NFC",) if plain else ("NFC", "NFD"))}
    return "|".join(sorted(map(one, forms), key=lambda x: (-len(x), x)))


def _apart(words: list[str]) -> str:
    """A class of what only texts in other than the plain spelling of the words have: invisible characters, and marks that composed spelling has none of."""
    composed, parted = ({ord(ch) for w in words for ch in unicodedata.normalize(f, w)} for f in ("NFC", "NFD"))
    ranges: list[list[int]] = []
    for c in sorted({*map(ord, HIDDEN), *(parted - composed)}):
        if ranges and c - ranges[-1][1] <= 16:  # few ranges are fast; one more character only takes the patterns for all
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


_run = lambda close: rf"(?:[^{close}\n]++|\n(?!\s*?\n))++"  # noqa: E731  a run inside one paragraph; possessive, so that long ones need neither stack nor a second look
QUOTED = "|".join(
    [
        rf"“{_run('”“')}”",
        rf"„{_run('“”„')}[“”]",
        rf"«{_run('»«')}»",
        rf"「{_run('」「')}」",
        rf"『{_run('』『')}』",
        rf'(?<![\p{{L}}\p{{N}}])"(?=\S){_run(chr(34))}(?<=\S)"(?![\p{{L}}\p{{N}}])',
        rf"\({_run('()')}\)",
        rf"（{_run('（）')}）",
        rf"\[{_run('\\[\\]')}\]",
    ]
)
#: The mark of a list line, at the start of the text or a line.
ITEM = r"(?:[•*]|\d{1,9}\))(?=\s)"
OPENERS = "“„«「『\"(（["
#: What a text must have for one of the pieces below.
OPENING = r"[“„«「『\"(（\[•*]|\d\)"
#: A quoted or bracketed remark, or a list line.
PIECES = rf"(?Us)((?=[“„«「『\"(（\[])(?:{QUOTED})|(?:\A|\n)[^\S\n]*{ITEM}[^\n]*)"


def _masks(plain: bool) -> list[tuple[str, str]]:
    """Patterns of marks that end nothing, and what they are masked with.

    Only a point with a blank behind it, closing marks aside, could end
    anything. Each pattern starts at the point itself and looks back from
    there, so it costs nothing elsewhere.
    """
    dot = MASKS[0]
    few = "" if plain else f"[{HIDDEN}]{{0,2}}"
    hidden = "" if plain else f"[{HIDDEN}]*"
    point = rf"\.(?=[{CLOSERS}{HIDDEN}{ENDS}{MASKS}]*\s)"
    before = rf"(?<=(?<![\p{{L}}\p{{N}}\p{{M}}]){few}"
    return [
        (rf"(?U){point}{before}(?:{_loose(ALWAYS, plain)}){few}\.)", dot),
        (rf"(?U)\.(?=\s*\p{{N}}){before}(?:{_loose(NUMBERED, plain)}){few}\.)", dot),
        (rf"(?U)\.(?=\s*(?:ej|ex|д|е|п|B|a|h|C|J|g){few}[.{dot}]){before}(?:p|т|z|u|d|a|av|apr|i|e){few}\.)", dot),
        (rf"(?U)\.(?=\s*\(){before}al\.)", dot),
        # initials before a name, and ordinals
        (rf"(?U)\.(?=\s+[\p{{Lu}}{dot}]){before}\p{{Lu}}[\p{{M}}{HIDDEN}]{{0,3}}\.)", dot),
        (rf"(?U)\.(?=\s+(?:{_loose(MONTHS, plain)})(?!\p{{L}}))(?<=(?<![\p{{L}}\p{{N}}.,])\d{{1,2}}{few}\.)", dot),
        # a point or dots before a small letter
        (rf"(?U)\.(?={hidden}[{CLOSERS}]*{hidden}\s+{hidden}\p{{Ll}})", dot),
        (rf"(?U)…(?=…*[{CLOSERS}]*{hidden}\s+{hidden}\p{{Ll}})", MASKS[3]),
    ]


def masked(text: Column) -> Column:
    """The text with every mark masked that is no end; of the same length.

    Texts in plain spelling, without invisible or parted characters, are
    matched with patterns that know of none.
    """
    used = CUT + OTHER + MASKS + MARK_MASKS
    t = F.when(text.rlike(f"[{PRIVATE}]"), F.translate(text, used, OTHER * len(used))).otherwise(text)
    inside = lambda p: F.when(F.substring(p, 1, 1).isin(*OPENERS), F.translate(p, ENDS, MASKS)).otherwise(F.translate(p, ENDS + MARKS, MASKS + MARK_MASKS))
    whole = F.zip_with(F.split(t, PIECES), F.regexp_extract_all(t, F.lit(PIECES), F.lit(1)), lambda gap, p: F.concat(gap, F.coalesce(inside(p), F.lit(""))))
    t = F.when(t.rlike(OPENING), F.array_join(whole, "")).otherwise(t)

    def all_masks(t: Column, plain: bool) -> Column:
        for pattern, put in _masks(plain):
            t = F.regexp_replace(t, pattern, put)
        return t

    return let(t, lambda t: F.when(t.rlike(_apart(ALWAYS + NUMBERED + MONTHS)), all_masks(t, False)).otherwise(all_masks(t, True)))


def cut(text: Column) -> Column:
    """The masked text with CUT after every unit. Rules of a script are looked at where the text has what they begin with."""
    only = lambda t, where, f: f(t) if where is None else let(t, lambda t: F.when(t.rlike(where), f(t)).otherwise(t))
    t = masked(text)
    closers = f"[{CLOSERS}{HIDDEN}]*"
    clause, greek = ".!?…;;\\n", r"\p{IsGreek}"
    other = rf"[^{clause}{greek}]"
    for pattern, put, where in (
        (r"(?U)\n(?=[^\S\n]*\n)", f"\n{CUT}", None),
        (rf"(\A|\n)([^\S\n]*(?:[{MARK_MASKS[:2]}]|\d{{1,9}}{MARK_MASKS[2]})[^\n]*)", f"$1{CUT}$2{CUT}", f"[{MARK_MASKS[0]}-{MARK_MASKS[2]}]"),
        # scripts whose marks need no blank
        (rf"((?:[。！？]+|…(?<=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]…)…*)[”’」』）》】{HIDDEN}]*)", f"$1{CUT}", "[…。！？]"),
        (rf"(?U)([.!?…]+{closers})(?=\s)", f"$1{CUT}", None),
        (rf"(?U)([।॥։؟۔]+{closers})(?=\s)", f"$1{CUT}", r"[\x{580}-\x{970}]"),
        # the Greek question mark, where a Greek word came before it in the same clause; every clause is looked at once
        (rf"(?U)((?<![^{clause}]){other}*+(?:{greek}{other}++)*+{greek}{{2}}[^{clause}]*+[;;]{closers})(?=\s)", f"$1{CUT}", r"[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}][^\n]*[;;]"),
        (rf"(?U)(\p{{IsThai}}[{HIDDEN}]*)(\s+)(?=[{HIDDEN}]*\p{{IsThai}})", f"$1{CUT}$2", r"[\x{E01}-\x{E5B}]"),
    ):
        t = only(t, where, lambda t: F.regexp_replace(t, pattern, put))
    return t


def _placed(parts: Column) -> Column:
    """(start_pos, end_pos) of the parts that hold anything, from their lengths: a fold within chunks of parts, from where the fold over the chunks before has come to."""
    long = F.lit(0).cast("long")
    kind = "array<struct<start_pos:bigint,end_pos:bigint>>"
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda i: F.slice(parts, i * CHUNK + 1, F.lit(CHUNK)))
    total = lambda c: F.aggregate(c, long, lambda a, p: a + p["n"])
    begun = F.aggregate(
        chunks,
        F.struct(long.alias("at"), F.array().cast("array<struct<at:bigint,parts:array<struct<n:int,lead:int,core:int>>>>").alias("out")),
        lambda a, c: F.struct((a["at"] + total(c)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), c.alias("parts")))).alias("out")),
    )["out"]

    def units(c: Column) -> Column:
        one = lambda at, p: F.struct((at + p["lead"]).alias("start_pos"), (at + p["lead"] + p["core"]).alias("end_pos"))
        return F.aggregate(
            c["parts"],
            F.struct(c["at"].alias("at"), F.array().cast(kind).alias("out")),
            lambda a, p: F.struct((a["at"] + p["n"]).alias("at"), F.when(p["core"] > 0, F.concat(a["out"], F.array(one(a["at"], p)))).otherwise(a["out"]).alias("out")),
        )["out"]

    return F.flatten(F.transform(begun, units))


def sentence_units(df: DataFrame, id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, start_pos, end_pos[, unit]) of every unit of every row's text.

    Positions are code points, from 0, the end exclusive. Units neither start
    nor end with whitespace, and every other character is in exactly one. Null,
    empty and blank texts have none. A row given twice yields its units twice;
    other columns are not looked at. Nothing is shuffled: lengths are added up
    within the row.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    blank = lambda u: F.length(F.regexp_extract(u, r"(?U)^\s*", 0))
    part = lambda u: let(blank(u), lambda lead: F.struct(F.length(u).alias("n"), lead.alias("lead"), F.greatest(F.lit(0), F.length(u) - lead - blank(F.reverse(u))).alias("core")))
    parts = F.transform(F.split(cut(F.col("text")), CUT), part)
    unit = rows.select("id", *(["text"] if keep_text else []), parts.alias("parts")).select("id", *(["text"] if keep_text else []), F.explode(_placed(F.col("parts"))).alias("p"))
    out = unit.select("id", "p.start_pos", "p.end_pos", *(["text"] if keep_text else []))
    if keep_text:
        out = out.select("id", "start_pos", "end_pos", F.expr("substring(text, cast(start_pos + 1 as int), cast(end_pos - start_pos as int))").alias("unit"))
    return out
