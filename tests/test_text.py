"""Text, hash and markup functions on small inputs."""

from __future__ import annotations

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from skein.functions import hashes as H
from skein.functions import markup as M
from skein.functions import text as X
from skein.operators import quality as Q


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ngrams_blocks_and_counts(spark):
    assert column(spark, ["", "A b", "a B c d E", "a b c d e f"], X.word_ngrams) == [[], ["a b"], ["a b c d e"], ["a b c d e", "b c d e f"]]
    assert column(spark, [" a \n \n b\nc \n\n\n", "", None], X.blocks) == [["a", "b\nc"], [], None]
    assert column(spark, ["a b  c d", "", None], X.word_count) == [4, 0, None]


def test_jaccard_of_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [round(1 / 3, 6), 1.0]


def test_normalising_is_idempotent_and_decodes_once(spark):
    raw = ["A &amp;lt; B\r\n\r\n\r\n\r\nC\t\tD  \r e", "é", " x ", None]
    once = column(spark, raw, X.normalized)
    assert once == ["A &lt; B\n\nC D\ne", "é", "x", None]
    assert column(spark, [once[1], "A b\n\nC"], X.normalized) == [once[1], "A b\n\nC"]


def test_trailing_sections_are_cut_at_standalone_headings(spark):
    texts = ["References\nx", "a\n\nSee also\nb", "a\nSee also\nb", "a\n\n other websites \nb", "plain", None]
    assert column(spark, texts, X.cut_trailing_sections) == ["", "a\n", "a\nSee also\nb", "a\n", "plain", None]


def test_safe_ids(spark):
    df = spark.createDataFrame([("My Src", " a/b c ")], "s string, r string")
    assert df.select(X.safe_id(F.col("s"), F.col("r"))).first()[0] == "doc_my_src_a_b_c"
    with pytest.raises(Exception, match="an id needs"):
        spark.createDataFrame([("?", "x")], "s string, r string").select(X.safe_id(F.col("s"), F.col("r"))).collect()


def test_table_lines(spark):
    assert column(spark, ["a\n{| x\n| y\n|}\n***\nb"], X.drop_table_lines) == ["a\nb"]


def test_hmac_and_splits(spark):
    words = [f"doc {i} é" for i in range(300)]
    got = column(spark, words, lambda c: H.unit_interval("key", c), "string")
    for w, u in zip(words, got):
        want = int.from_bytes(hmac.new(b"key", w.encode(), hashlib.sha256).digest()[:8], "big") / 2**64
        assert math.isclose(u, want, abs_tol=1e-15)
    pools = column(spark, [str(i) for i in range(20_000)], lambda c: H.keyed_split("key", "v1", c))
    for name, low, high in (("train", 0.90, 0.92), ("validation", 0.02, 0.04), ("probe", 0.01, 0.03), ("cloze_reserve", 0.005, 0.015)):
        assert low < pools.count(name) / 20_000 < high


def test_minhash_estimates_similarity(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" if i < 180 else f"v{i}" for i in range(200))
    x, y, none, short, null = column(spark, [a, b, "", "one two", None], lambda c: H.minhash(c, n=256))
    true = 176 / (196 + 20)
    assert abs(sum(p == q for p, q in zip(x, y)) / 256 - true) < 0.12
    assert none == [0xFFFFFFFF] * 256 and len(short) == 256 and null is None


def test_wikitext(spark):
    raw = "'''Ring'''<ref>x</ref> of [[Comet|comets]]{{box|{{in}}}} and [[Halo#Top]] [[File:a.png|[[b]]]]H<sub>2</sub> m<sup>3</sup> [http://x.y label] [http://z]<!-- c --> [1]\n{| t\n| c\n|}\n== See also ==\n* a\n=== Deeper ===\nb\n== Kept ==\nend"
    assert M.prose_of_wikitext(raw).split("\n") == ["Ring of comets and Halo H_2 m^3 label  ", "Kept", "end"]
    assert M.without_templates("a {{b}} c {{d {{e}} f") == "a  c "
    assert M.with_link_labels("a [[b c") == "a [[b c" and M.with_link_labels("a ]] b") == "a ]] b"
    assert column(spark, ["a [[b|c]]", None, ""], M.wikitext_prose) == ["a c", None, ""]


def test_html(spark):
    page = "<nav>no</nav><h1>Title</h1><p>A &amp; B<br>c<sub>2</sub></p><table><tr><td>x</td></tr></table><ul><li>one</li></ul><script>s</script>"
    assert M.prose_of_html(page) == "Title\n\nA & B\nc_2\n\none\n"
    assert column(spark, [page, None], M.html_prose)[1] is None


GOOD = "The ring of the moon was seen by the crew, and it is one of the arcs that they had found before. " * 3


def test_reasons_in_order(spark):
    rows = [("ok", GOOD + "\n\n" + "It was also seen from the tower by all of us in the night. " * 3), ("short", "The moon."), ("null", None), ("digits", "12 34 56 78 " * 40), ("markup", "<a>{b}" * 60), ("lines", "same line of the text\n" * 30)]
    got = {r.id: r for r in Q.assess(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got["ok"].accepted and got["ok"].reasons == [] and got["ok"].quality_score > 0
    assert got["null"].reasons == ["too_short", "too_few_paragraphs", "low_alpha_ratio", "markup_contamination", "low_language_score"]
    assert "low_alpha_ratio" in got["digits"].reasons and "markup_contamination" in got["markup"].reasons and "repeated_lines" in got["lines"].reasons
    assert all(got[k].quality_score == 0 for k in got if k != "ok")
    counts = {r.reason: r.documents for r in Q.reason_counts(spark.createDataFrame(list(got.values()))).collect()}
    assert counts["too_short"] == 2


def test_cutoff_is_inclusive(spark):
    times = ["2023-11-01T00:00:00Z", "2023-11-01T00:00:01Z", "2023-10-31T23:59:59+00:00", None, "never"]
    assert column(spark, times, lambda c: Q.within_cutoff(c, "2023-11-01T00:00:00Z")) == [True, False, True, False, False]
    assert column(spark, times, lambda c: Q.within_cutoff(c, "2023-11-01T00:00:00Z", F.lit(True)))[3:] == [True, True]


def test_unknown_source_fails(spark):
    dim = spark.createDataFrame([("a", True)], "source string, approved boolean")
    df = spark.createDataFrame([("a",), ("b",)], "source string")
    with pytest.raises(Exception, match="unknown source: b"):
        Q.checked_source(df, dim).collect()


def test_markup_that_never_ends_stays():
    assert M.without_shut("a <!-- b <ref>c</ref> d") == "a <!-- b  d" and M.without_shut("a <ref name=x /> b <REF>c</Ref>d <gallery>e") == "a  b d <gallery>e"
    assert M.without_shut("<!-- <ref> -->x<ref><!-- -->y</ref>z") == "xz"
    assert M.prose_of_html("<nav><p>x</nav>a<nav>b<table>c</table>d</nav></nav>e<br/>f<sup>2</sup>") == "ae\nf^2"


def test_sections_are_a_tree():
    text = "lead\n== Notes ==\na\n==== Deep ====\nb\n=== Less ===\nc\n== Kept ==\nd\n=== SEE ALSO ===\ne\n== == \nf\n= x =\ng"
    assert M.without_sections(text).split("\n") == ["lead", "== Kept ==", "d", "== == ", "f", "= x =", "g"]
    assert M.heading("=== a == b ===  ") == (3, "a == b") and M.heading("== a") is None and M.heading("====") == (2, "")
    assert [M.plain_line(x) for x in ("{| x", " | y", "! z", "**", "* a", "", "== T ==")] == [None, None, None, None, "* a", "", "T"]
