"""Text expressions: words, n-grams, blocks, scores, plain-text clean-up."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space as a character class body that Java and RE2 read alike.
WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Function words of the language score.
FUNCTION_WORDS = """
a an the of and to in is that for with as on by from at are was were be been being
it this these those or if then than not no nor but into over after before about
between under above out up down its his her their our your my we you they he she
which who whom whose what when where while during without within across per
has have had do does did can may will would should could also such other only
""".split()

# Names of trailing sections, and two more in plain-text dumps.
TRAILING_SECTIONS = [
    "see also", "references", "notes", "external links", "external link", "further reading",
    "bibliography", "sources", "citations", "footnotes", "gallery", "notes and references",
    "references and notes", "works cited", "explanatory notes", "general references",
    "cited sources", "literature", "bibliographies",
]
PLAIN_TRAILING_SECTIONS = [*TRAILING_SECTIONS, "related pages", "other websites"]


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of non-whitespace, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def word_ngrams(text: Column, n: int = 5) -> Column:
    """Runs of n lower-cased words; a text of fewer words is one run, an empty one none."""
    return let(words(F.lower(text)), lambda w: ngrams(w, n))


def ngrams(w: Column, n: int) -> Column:
    whole = F.array(F.array_join(w, " "))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= n, whole).otherwise(runs)


def blocks(text: Column) -> Column:
    """Paragraphs: non-blank, stripped parts between blank lines."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda x: x != "")


def lines(text: Column) -> Column:
    """Stripped, non-empty lines."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 1 for two empty ones."""
    return let(F.size(F.array_union(a, b)), lambda union: F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union))


def alpha_ratio(text: Column) -> Column:
    """Letters among visible characters; 0 if nothing is visible."""
    visible = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    return F.when(visible > 0, F.length(F.regexp_replace(text, r"\P{L}+", "")) / visible).otherwise(0.0)


def markup_ratio(text: Column) -> Column:
    """Markup marks per character; 1 for an empty text."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[<>{}]|\[\[|\]\]")) / F.length(text)).otherwise(1.0)


def repeated_line_ratio(text: Column) -> Column:
    return let(lines(text), lambda found: F.when(F.size(found) > 0, 1 - F.size(F.array_distinct(found)) / F.size(found)).otherwise(0.0))


def language_score(text: Column, least_words: int = 20, full_rate: float = 0.35) -> Column:
    """Share of function words among ASCII words, over the full rate, at most 1; 0 for too few words."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), F.lit("([a-z]+)"), F.lit(1))
    rate = lambda w: F.size(F.filter(w, lambda x: x.isin(*FUNCTION_WORDS))) / F.size(w)
    return let(found, lambda w: F.when(F.size(w) >= least_words, F.least(F.lit(1.0), rate(w) / full_rate)).otherwise(0.0))


def quality_score(text: Column, language: Column) -> Column:
    """Language score, share of letters and log length, multiplied."""
    return language * alpha_ratio(text) * F.log(F.greatest(F.length(text), F.lit(2)).cast("double"))


def safe_id(source: Column, record: Column) -> Column:
    """doc_{source}_{record} of safe characters; an empty part makes the query fail."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    a, b = F.lower(safe(source)), safe(record)
    return F.when((a == "") | (b == ""), F.raise_error(F.lit("an id needs a source and a record"))).otherwise(F.concat(F.lit("doc_"), a, F.lit("_"), b))


def cut_trailing_sections(text: Column) -> Column:
    """Plain text up to the first line that names a trailing section and is the first or follows a blank line."""
    bare = lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))
    names = lambda low: F.array_min(F.filter(F.transform(low, lambda x, i: F.when(x.isin(*PLAIN_TRAILING_SECTIONS) & ((i == 0) | (F.get(low, i - 1) == "")), i)), lambda i: i.isNotNull()))
    at = let(F.transform(F.split(text, "\n"), bare), names)
    return let(at, lambda n: F.when(n.isNull(), text).otherwise(F.array_join(F.slice(F.split(text, "\n"), F.lit(1), F.coalesce(n, F.lit(0))), "\n")))


def drop_table_lines(text: Column) -> Column:
    """Text without lines of table markup and lines of bullets only."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(\{\||\|\}|\|-|\|\+|!|\|)") & ~x.rlike(r"^\s*[*#|:;-]+\s*$")), "\n")


def _decode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", html.unescape(t)))


def decoded(text: Column) -> Column:
    """Character references decoded once, then composed form (NFC): the two steps Spark has no function for."""
    return F.pandas_udf(_decode, "string")(text)


def tidy(text: Column) -> Column:
    """Line ends as newline, blanks collapsed, lines and text stripped, at most one blank line in a row."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    t = F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def normalized(text: Column) -> Column:
    """Decoding and tidying: applied twice, the second changes nothing that holds no reference."""
    return tidy(decoded(text))
