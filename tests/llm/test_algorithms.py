"""The operators on small made-up tables, against brute force."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import boilerplate, evalleak, groupsplit, meeting, mixing, neardup, quality, sentences, spans, splitleak
from skein.llm import textarrays as ta
from skein.llm.classes import corpus_of

SCHEMA = "document_id string, text string, split string, source string, id int, class string, h string, band string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def make_texts(seed=5):
    """Texts with copies, edits, shared passages, rearrangements, blanks, nulls, repeats and one very long one."""
    rng = random.Random(seed)
    texts = {f"d{i:02d}": " ".join(words(rng, rng.randrange(20, 120))) for i in range(30)}
    passage = " ".join(words(rng, 70))
    texts["p1"], texts["p2"] = "start " + passage + " end one", "other " + passage + " tail two"
    texts["short_share"] = passage[:120]
    base = texts["d03"].split()
    base = base + words(rng, 80)
    texts["e0"] = " ".join(base)
    for k in (1, 4, 9, 20):
        edited = list(base)
        for i in rng.sample(range(len(edited)), k):
            edited[i] = "changed"
        texts[f"e{k}"] = " ".join(edited)
    half = len(base) // 2
    texts["moved"] = " ".join(base[half:] + base[:half])
    texts["copy1"] = texts["copy2"] = texts["copy3"] = texts["d05"]
    texts["same_words"] = texts["d05"].upper().replace(" ", ", ")
    texts["empty"], texts["blank"], texts["null"] = "", " \n ", None
    texts["long"] = " ".join(words(rng, 6000, 10**6))
    texts["long2"] = texts["long"][3000:] + " and more"
    texts["aaaa"], texts["aaab"] = "a" * 900, "b" + "a" * 700 + "b"
    return texts


def table(spark, texts, split=None, repeat=True):
    rows = [(k, v, (split or {}).get(k), "s", 1, "x", "y", "z") for k, v in texts.items()]
    rows += rows[:4] if repeat else []
    rows.append((None, "a row without an id " * 20, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    got = [tuple(r)[:2] for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def shingle_set(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 20 else set()


def test_shared_spans_find_every_pair(spark):
    texts = make_texts()
    made = corpus_of(table(spark, texts), "document_id", "text", least=160)
    grams = {k: {t[i : i + 160] for i in range(len(t) - 159)} for k, t in texts.items() if t}
    truth = {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    assert pairs(spans.sharing_pairs(made)) == truth


def test_shared_coverage_counts_characters(spark):
    texts = make_texts()
    got = {r.id: r for r in spans.shared_coverage(corpus_of(table(spark, texts), "document_id", "text")).collect()}
    for k, t in texts.items():
        seen = [False] * len(t or "")
        others = [o for j, o in texts.items() if j != k and o]
        for i in range(len(t or "") - 159):
            if any(t[i : i + 160] in o for o in others):
                seen[i : i + 160] = [True] * 160
        assert got[k].shared_chars == sum(seen), k
        assert got[k].n_chars == len(t or "")


def test_a_repeated_passage_is_one_span_however_often_it_stands_there():
    rng = random.Random(9)
    passage = " ".join(words(rng, 60, 10**6))[:170]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    x = "a b c " + passage + " d e f"
    for times in (1, 3, 20, 300):
        y = " | ".join([passage] * times) + " | " + passage + " d e"
        ((i, j, n),) = spans.factors(codes(x), codes(y), 160)
        assert x[i : i + n] == y[j : j + n] and n == len(" " + passage + " d e") and j == times * 173 - 1


def test_common_passages_cost_no_pairs(spark):
    rng = random.Random(6)
    notice = " ".join(words(rng, 80))[:230]
    texts = {f"n{i:04d}": " ".join(words(rng, 20, 10**6)) + " | " + notice + " | " + " ".join(words(rng, 20, 10**6)) for i in range(spans.MOST * 3)}
    texts["other"] = " ".join(words(rng, 60, 10**6))
    made = corpus_of(table(spark, texts), "document_id", "text")
    pairs_made, windows = spans.routes(made.texts, 160)
    assert pairs_made.count() <= 8 * len(texts) and windows.count() <= len(texts) * 240
    got = {r.id: r for r in spans.shared_coverage(made).collect()}
    assert got["other"].shared_chars == 0
    windows_of = {k: [t[i : i + 160] for i in range(len(t) - 159)] for k, t in texts.items()}
    holders = Counter(w for ws in windows_of.values() for w in set(ws))
    for k, ws in windows_of.items():
        assert got[k].shared_chars == len({i + d for i, w in enumerate(ws) if holders[w] > 1 for d in range(160)}), k
    found = pairs(spans.sharing_pairs(made))
    n = spans.MOST * 3
    assert len(found) == n * (n - 1) // 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 40)), max_size=120), st.integers(1, 5), st.integers(1, 40), st.integers(1, 30))
def test_meetings_are_exact(rows, most, buffer, size):
    rows = sorted(set(rows))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], names=["h", "member"])
    shuffled = random.Random(size).sample(rows, len(rows))
    parts = [batch(shuffled[i : i + size]) for i in range(0, len(rows), size)]
    cut = [r for b in meeting.cut_down(lambda batches: batches, most, buffer)(iter(parts)) for r in zip(b["h"].to_pylist(), b["member"].to_pylist())]
    assert all(sum(r[0] == h and r[1] != meeting.MARK for r in cut) <= most * (len(rows) // buffer + 2) for h in range(7))
    cut.sort()
    met = [tuple(r.values()) for b in meeting._walk(most)(batch(cut[i : i + size]) for i in range(0, len(cut), size)) for r in b.to_pylist()]
    by = {}
    for h, m in rows:
        by.setdefault(h, []).append(m)
    assert sorted(h for h, _, _ in met if h is not None) == [h for h in by if len(by[h]) > most]
    assert sorted((a, b) for h, a, b in met if h is None) == sorted((a, b) for l in by.values() if len(l) <= most for a in l for b in l if a < b)


def test_hot_blocks_are_joined_on_windows(spark):
    rng = random.Random(1)
    notice = " ".join(words(rng, 22))[:100]
    common = " ".join(words(rng, 60))[:200]
    texts = {f"n{i:03d}": " ".join(words(rng, 30, 10**6)) + notice + " ".join(words(rng, 30, 10**6)) for i in range(200)}
    texts |= {f"m{i}": f"{i} " + common + " ".join(words(rng, 20, 10**6)) for i in range(3)}
    made = corpus_of(table(spark, texts), "document_id", "text", least=160)
    assert pairs(spans.sharing_pairs(made)) == {("m0", "m1"), ("m0", "m2"), ("m1", "m2")}


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.text("abc", min_size=12, max_size=30))
def test_factors_cover_all_common_windows(left, right, common):
    x, y = left + common + right, right + common + left
    cx, cy = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (x, y))
    covered = [False] * len(x)
    for i, j, n in spans.factors(cx, cy, 12):
        assert n >= 12 and x[i : i + n] == y[j : j + n]
        covered[i : i + n] = [True] * n
    for i in range(len(x) - 11):
        if x[i : i + 12] in y:
            assert all(covered[i : i + 12])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcdé ", max_size=200), min_size=1, max_size=5), st.integers(2, 9), st.integers(2, 9))
def test_winnowing_guarantee(texts, k, w):
    text, pos, h = ta.anchors(texts, k, w)
    chosen = {(int(t), texts[t][p : p + k]) for t, p in zip(text, pos)}
    for i, a in enumerate(texts):
        for s in range(len(a) - (k + w - 1) + 1):
            assert any((i, a[q : q + k]) in chosen for q in range(s, s + w))
    assert all(p + k <= len(texts[t]) for t, p in zip(text, pos))


def test_near_duplicates_and_groups(spark):
    texts = make_texts()
    made = corpus_of(table(spark, texts), "document_id", "text")
    sets = {k: shingle_set(t) for k, t in texts.items()}
    sim = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    assert pairs(neardup.near_duplicate_pairs(made, 0.7)) == {p for p, s in sim.items() if s >= 0.7}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), s in sim.items():
        if s >= 0.8:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r for r in neardup.near_duplicate_groups(made, 0.8).collect()}
    assert {k: got[k].group_id for k in texts if sets[k]} == {k: find(k) for k in texts if sets[k]}
    assert sum(r.is_representative for r in got.values()) == len({r.group_id for r in got.values()})
    assert got["null"].group_id == "null" and got["empty"].group_size == 1


def test_split_leaks(spark):
    texts = make_texts()
    split = {k: ("train" if n % 3 else ("test", "validation", "probe", "cloze_reserve")[n % 4]) for n, k in enumerate(texts)}
    split["e9"], split["copy2"] = None, "excluded"
    made = corpus_of(table(spark, texts, split), "document_id", "text", extra={"split": F.col("split")})
    sets = {k: shingle_set(t) for k, t in texts.items()}
    ev = set(splitleak.EVALUATION)
    truth = {(e, t) for e in sets for t in sets if split[e] in ev and split[t] == "train" and sets[e] and sets[t] and len(sets[e] & sets[t]) / len(sets[e]) >= 0.7}
    found = splitleak.leaking_pairs(made)
    rows = found.collect()
    assert {(r.eval_id, r.train_id) for r in rows} == truth and len(rows) == len(truth) > 3
    assert all(r.aligned_words <= r.eval_words for r in rows)
    report = splitleak.leak_report(found, made.members.withColumn("source", F.lit("s")).select("id", "split", "source")).collect()
    assert sum(r.pairs for r in report) == len(truth)


def test_split_leaks_of_repeated_passages(spark):
    rng = random.Random(11)
    texts, split = {}, {}
    for k, (size, times) in enumerate(((30, 8), (60, 6), (100, 8), (40, 5), (200, 8), (50, 3), (50, 2))):
        passage = words(rng, size, 10**6)
        lead = words(rng, 40, 10**6)
        texts[f"e{k}"] = " ".join(lead + passage * times)
        texts[f"t{k}"] = texts[f"e{k}"] + " one more"
        edited = []  # every copy edited every eight words, elsewhere in each
        for c in range(times):
            edited += [w if (i + c) % 8 else f"x{k}" for i, w in enumerate(passage)]
        texts[f"s{k}"] = " ".join(lead + edited)
        texts[f"o{k}"] = " ".join(lead + passage)
        split |= {f"e{k}": "test", f"t{k}": "train", f"s{k}": "train", f"o{k}": "train"}
    made = corpus_of(table(spark, texts, split), "document_id", "text", extra={"split": F.col("split")})
    sets = {k: shingle_set(t) for k, t in texts.items()}
    truth = {(e, t) for e in sets for t in sets if split[e] == "test" and split[t] == "train" and len(sets[e] & sets[t]) / len(sets[e]) >= 0.7}
    assert {("e0", "t0"), ("e2", "s2"), ("e4", "t4")} <= truth
    rows = splitleak.leaking_pairs(made).collect()
    assert {(r.eval_id, r.train_id) for r in rows} == truth and len(rows) == len(truth)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    made = corpus_of(empty, "document_id", "text", extra={"split": F.col("split")})
    for df in (spans.sharing_pairs(made), spans.shared_coverage(made), neardup.near_duplicate_pairs(made), neardup.near_duplicate_groups(made), splitleak.leaking_pairs(made)):
        assert df.count() == 0
    assert groupsplit.components_by_keys(empty, "document_id", [F.col("class")]).count() == 0
    assert sentences.sentence_units(empty, "document_id").count() == 0
    rows = boilerplate.line_rows(empty, "document_id", "text", "source")
    assert boilerplate.repeated_lines(rows).count() == 0
    assert quality.text_statistics(empty, "document_id", "text", {"en": ["the"]}).count() == 0


def test_latest_delivery_counts(spark):
    df = spark.createDataFrame([("a", "old text", 1), ("a", "new text", 2), ("a", "new text", 2), ("b", None, 1)], "i string, t string, at int")
    got = {r.id: r for r in corpus_of(df, "i", "t", F.col("at")).members.collect()}
    assert set(got) == {"a", "b"} and got["a"].chars == 8 and got["b"]["class"] is None
    assert [r.text for r in corpus_of(df, "i", "t", F.col("at")).texts.collect()] == ["new text"]


def test_statistics_rules_and_percentiles(spark):
    common = {"en": ["the", "of", "and"], "de": ["der", "und"]}
    prose = "The crew of the tower and the dish saw the arc. " * 6
    rows = [("prose", prose), ("list", "\n".join(f"Name {i}: 12" for i in range(15))), ("junk", "@@ ## $$ %% ^^ &&"), ("null", None), ("blank", "  \n"), ("de", "Der Turm und der Berg und der Bogen.")]
    stats = quality.text_statistics(spark.createDataFrame(rows, "id string, text string"), "id", "text", common)
    got = {r.id: r for r in stats.collect()}
    n = len(prose.split())
    assert got["prose"].n_words == n and got["prose"].lang == "en" and got["de"].lang == "de" and got["junk"].lang == "und"
    assert got["prose"].mean_word_length == pytest.approx(len(prose.replace(" ", "")) / n)
    assert got["prose"].common_share == pytest.approx(36 / n)
    assert got["null"].blank and got["blank"].blank and got["null"].mean_word_length is None
    assert {r.id for r in quality.not_prose(stats).collect()} == {"list", "junk"}
    sk = quality.statistic_sketches(stats)
    twice = quality.merge_sketches(sk, sk)
    assert {r.lang: r.n for r in twice.collect()} == {"en": 2, "de": 2, "und": 4}
    out = {r.id: r for r in quality.percentiles_and_tails(stats, sk).collect()}
    assert out["prose"].p_n_words == 1.0 and out["null"].p_n_words is None and out["null"].tails == []


def test_tails_of_a_distribution(spark):
    rng = random.Random(3)
    rows = [(str(i), " ".join(["the"] * rng.randrange(90, 110))) for i in range(300)] + [("far", " ".join(["the"] * 2000))]
    stats = quality.text_statistics(spark.createDataFrame(rows, "id string, text string"), "id", "text", {"en": ["the"]})
    out = {r.id: r.tails for r in quality.percentiles_and_tails(stats, quality.statistic_sketches(stats)).collect()}
    assert "n_words" in out["far"] and sum("n_words" in t for t in out.values()) < 12


def test_repeated_lines(spark):
    notice, rare = "All rights reserved here!", "Another line that is rare"
    rows = [(f"d{i}", "s", f"own line number {chr(97 + i)} of text\n{notice if i % 2 else notice.upper()}\n{notice}", f"2020-01-0{i % 3 + 1}") for i in range(6)]
    rows += [("copy1", "s", rows[0][2], "2020-01-01"), ("null", "s", None, None), ("short", "s", "ok\nok\nok", None), ("r", "s", rare, None), ("other", None, notice, None), ("empty", "s", "", None)]
    df = spark.createDataFrame(rows, "id string, source string, text string, day string")
    lines = boilerplate.line_rows(df, "id", "text", "source", F.col("day"))
    found = boilerplate.repeated_lines(lines)
    (r,) = found.collect()
    assert (r.source, r.n_records, r.n_texts, r.n_days, r.source_records) == ("s", 7, 6, 3, 11)
    at = {tuple(x) for x in boilerplate.line_occurrences(lines, found).collect()}
    assert at == {(d, n) for d in [*(f"d{i}" for i in range(6)), "copy1"] for n in (2, 3)}
    clean = {x.id: x for x in boilerplate.without_lines(df, found, "id", "text", "source").collect()}
    assert clean["d1"].text == "own line number b of text" and clean["d1"].removed == 2
    assert clean["null"].text is None and clean["other"].text == notice and clean["empty"].text == "" and clean["short"].text == "ok\nok\nok"


def test_near_copies_are_collapsed_before_lines_are_counted(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    article, notice = words(200) + "\nthe headline of the article", "all rights are reserved here"
    rows = [(f"a{i}", "s", article + (f"\nedit {i % 4} of it" if i else ""), f"2020-01-0{i % 2 + 1}") for i in range(6)]
    rows += [(f"n{i}", "s", words(60) + "\n" + notice, f"2020-02-0{i + 1}") for i in range(4)] + [("null", "s", None, None)]
    df = spark.createDataFrame(rows, "id string, source string, text string, day string")
    groups = neardup.near_duplicate_groups(corpus_of(df, "id", "text"), 0.8).select("id", F.col("group_id").alias("cluster"))
    lines = boilerplate.clustered(boilerplate.line_rows(df, "id", "text", "source", F.col("day")), groups)
    found = {(r.n_records, r.n_clusters, r.n_texts, r.n_days, r.source_records) for r in boilerplate.repeated_lines(lines).collect()}
    assert found == {(6, 1, 5, 2, 11), (4, 4, 4, 4, 11)}
    (r,) = boilerplate.repeated_lines(lines, least_clusters=2).collect()
    assert r.n_records == 4 and {x.id for x in boilerplate.line_occurrences(lines, boilerplate.repeated_lines(lines, least_clusters=2)).collect()} == {f"n{i}" for i in range(4)}


def test_group_splits_keep_related_rows_together(spark):
    rng = random.Random(2)
    rows = [(f"r{i:04d}", f"k{rng.randrange(900)}" if rng.random() < 0.7 else None, f"m{rng.randrange(1200)}", rng.choice(["train", "train", "train", "test", None, "excluded"])) for i in range(1000)]
    rows += [(f"chain{i:02d}", f"c{i}", f"z{i // 2}" if i % 2 else f"z{(i - 1) // 2}", None) for i in range(30)] + [rows[0]]
    rows += [(f"chain{i:02d}", f"c{i + 1}", None, None) for i in range(29)]
    df = spark.createDataFrame(rows, "id string, k string, m string, split string")
    comp = {r.id: r.component for r in groupsplit.components_by_keys(df, "id", [F.col("k"), F.col("m")]).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for i, k, m, _ in rows:
        for key in (("k", k), ("m", m)):
            if key[1] is not None:
                a, b = find(seen.setdefault(key, i)), find(i)
                root[max(a, b)] = min(a, b)
    assert comp == {i: find(i) for i in root}
    table = groupsplit.components_by_keys(df, "id", [F.col("k"), F.col("m")]).join(df.select("id", "split").dropDuplicates(["id"]), "id")
    out = groupsplit.assign_splits(table).collect()
    assert len(out) == len(root)
    by = {}
    for r in out:
        by.setdefault(r.component, set()).add(r.split)
        assert r.state != "kept" or r.old_split in (None, "excluded", r.split)
    assert all(len(s) == 1 and s <= set(groupsplit.PROPORTIONS) for s in by.values())
    # a later run keeps what the first one put together
    old = spark.createDataFrame([("x1", "x0"), ("r0001", "x0"), ("x0", "x0")], "id string, component string")
    again = {r.id: r.component for r in groupsplit.components_by_keys(df, "id", [F.col("k"), F.col("m")], old).collect()}
    assert again["x1"] == again["x0"] == again["r0001"] == min(again["r0001"], "x0")


def test_deliveries_give_what_one_run_gives(spark):
    rng = random.Random(12)
    rows = [(f"r{i:03d}", f"k{rng.randrange(260)}" if rng.random() < 0.6 else None, f"m{rng.randrange(300)}", rng.choice(["train", "train", "test", None])) for i in range(300)]
    rng.shuffle(rows)
    kind = "id string, k string, m string, split string"
    keys = [F.col("k"), F.struct(F.lit("s"), "m")]
    table_of = lambda df: {r.id: (r.component, r.split) for r in df.collect()}
    once = groupsplit.updated(spark.createDataFrame(rows, kind), "id", keys, "split")
    state = None
    for part in (rows[:150], rows[150:240], rows[240:]):
        state = groupsplit.updated(spark.createDataFrame(part, kind), "id", keys, "split", state).written()
        assert state.records.count() == state.records.select("id").distinct().count()
    assert table_of(state.records) == table_of(once.records)
    assert sorted(map(tuple, state.keys.collect())) == sorted(map(tuple, once.keys.collect()))
    again = groupsplit.updated(spark.createDataFrame([(rows[0][0], "fresh", None, "probe"), (None, "fresh", None, None)], kind), "id", keys, "split", state)
    got = table_of(again.records)
    assert got[rows[0][0]] == (table_of(once.records)[rows[0][0]][0], "probe") and len(got) == 300


def test_new_components_follow_the_proportions(spark):
    df = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("id"), F.concat(F.lit("c"), "id").alias("component"), F.lit(None).cast("string").alias("split"))
    n = {r.split: r["count"] for r in groupsplit.assign_splits(df).groupBy("split").count().collect()}
    for s, p in groupsplit.PROPORTIONS.items():
        assert abs(n[s] - 4000 * p) <= 2


ITEMS = [(1, "Which body keeps one face to the outer ring, and which of the two moons was found first by the crew?"), (2, "Ｗｈｉｃｈ body keeps one face to the outer ring, and which of the two moons was found first by the crew?"), (3, "How warm is the inner arc?? Very"), (4, "too short"), (5, None), (6, "An item of just over forty-eight letters and digits stands here.")]


def test_leaked_passages(spark):
    long = "".join(chr(97 + i % 26) for i in range(50_000))
    docs = [(10, "x " + ITEMS[0][1].upper() + " y"), (11, "keeps one face to the outer-ring, and which of the two moons was"), (12, "keeps one face to the outer ring and which"), (13, "So: how warm is THE inner arc? Very!"), (14, None), (15, ""), (16, long + ITEMS[5][1] + long), (17, "too short"), (10, "x " + ITEMS[0][1].upper() + " y"), (None, ITEMS[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r for r in evalleak.leaked_passages(d, i).collect()}
    norm = {k: evalleak.normal(t or "") for k, t in ITEMS}
    truth = set()
    for k, t in docs:
        for n, f in norm.items():
            whole = evalleak.normal(t or "")
            if k is not None and (len(f) >= 48 and any(f[q : q + 48] in whole for q in range(len(f) - 47)) or 24 <= len(f) < 48 and f in whole):
                truth.add((k, n))
    assert set(got) == truth and (11, 1) in truth and (12, 1) not in truth
    r = got[16, 6]
    assert docs[6][1][r.start : r.end] == ITEMS[5][1].rstrip(".") and r.item_share == 1.0
    assert evalleak.leaked_passages(d.limit(0), i).count() == 0 and evalleak.leaked_passages(d, i.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("aé ﬁ①ﾊﾞび̈́İ한글한.-", max_size=20), st.text("한゙́ab ", max_size=20))
def test_places_stay_near_their_passage(before, after):
    item = "An item of just over forty eight letters and digits stands here."
    text = before + " " + item + " " + after
    (where,) = evalleak.leaks_in(text, [(1, evalleak.normal(item))], evalleak.automaton([(1, evalleak.normal(item))])).values()
    assert abs(where[0] - text.index(item)) <= 3 and abs(where[1] - (text.index(item) + len(item) - 1)) <= 3


@settings(max_examples=60, deadline=None)
@given(st.text("aéÉ ﬁ①ﾊﾞび゙̈́İ한글ᄒ.-", max_size=30))
def test_origins_have_a_place_for_every_character(text):
    place = evalleak.origins(text)
    if len(place) == len(evalleak.normal(text)):
        assert place == sorted(place) and all(0 <= p < len(text) for p in place)


def mix_tables(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"] + ["none"]), " ".join(["star"] * rng.randrange(1, 60))) for i in range(900)]
    docs += [(docs[0][0], docs[0][1], docs[0][2]), (None, "big", "star"), (5000, None, "star"), (5001, "big", None), (5002, "big", "")]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame([("big", 2.0, 1), ("mid", 1.0, None), ("small", 1.0, 4), ("absent", 3.0, 2), ("zero", 0.0, 1)], "source string, target_weight double, max_repeats long")


def test_mixing_reaches_the_shares(spark):
    docs, targets = mix_tables(spark)
    chosen, report = mixing.mixed(docs, targets)
    rows, shares = chosen.collect(), {r.source: r for r in report.collect()}
    assert len({r.id for r in rows}) == len(rows) and all(r.source in ("big", "mid", "small") for r in rows)
    cap = {"big": 1, "small": 4}
    assert all(r.repeats <= cap.get(r.source, 10**9) for r in rows)
    total = sum(r.tokens * r.repeats for r in rows)
    for s, want in (("big", 0.5), ("mid", 0.25), ("small", 0.25)):
        got = sum(r.tokens * r.repeats for r in rows if r.source == s)
        assert shares[s].tokens == got and shares[s].share == pytest.approx(got / total, abs=1e-6)
        assert abs(got / total - want) <= 60 / total + 1e-9
    assert shares["absent"].tokens == 0 and shares["absent"].target_share == 0


def test_mixing_to_a_budget(spark):
    docs, targets = mix_tables(spark)
    for budget in (0, 500, 4000, 10**7):
        chosen, _ = mixing.mixed(docs, targets, budget=budget)
        total = sum(r.tokens * r.repeats for r in chosen.collect())
        assert total <= budget and (total >= budget - 60 or budget == 0)
    assert mixing.mixed(docs.limit(0), targets)[0].count() == 0


CASES = [
    'Dr. K. Vel saw 5.3 mag, cf. Fig. 7 of No. 12. It was late?! “Did it fade again?” asked P. C. Rak at the console.|Dr. K. Vel saw 5.3 mag, cf. Fig. 7 of No. 12.|It was late?!|“Did it fade again?” asked P. C. Rak at the console.',
    "Wait... was it up? The plate (it was worn. We kept it.) is here. See archive.x.invalid/15 for all.|Wait... was it up?|The plate (it was worn. We kept it.) is here.|See archive.x.invalid/15 for all.",
    "Notes on X\n \n\nIt ended at 9 p.m. The rest; it went\non to Arn Inc. for storage.|Notes on X|It ended at 9 p.m.|The rest; it went\non to Arn Inc. for storage.",
    "Im 1. Jahrhundert hieß er A, vgl. Abb. 4. Am 15.\nMärz war z. B. Ruhe. „Er kam nie. Nie“, sagte Prof. H. V. leise.|Im 1. Jahrhundert hieß er A, vgl. Abb. 4.|Am 15.\nMärz war z. B. Ruhe.|„Er kam nie. Nie“, sagte Prof. H. V. leise.",
    "• A plate. Two\n* B\n12) C. D\r\n\r\nEnd.|• A plate. Two|* B|12) C. D|End.",
    "云来了，什么也看不见……“丢了。又回来了。”值班的说道。日志（写于1930年。有副本。）里记着。真的吗？|云来了，什么也看不见……|“丢了。又回来了。”值班的说道。|日志（写于1930年。有副本。）里记着。|真的吗？",
    "Είναι το X μεταβλητό; Ο κ. Γ το είπε, π.χ. το 1999.|Είναι το X μεταβλητό;|Ο κ. Γ το είπε, π.χ. το 1999.",
    "กล้องถ่าย VEL 10 ไว้ 5 ครั้ง ความสว่างลดลง 38.83 เปอร์เซ็นต์|กล้องถ่าย VEL 10 ไว้ 5 ครั้ง|ความสว่างลดลง 38.83 เปอร์เซ็นต์",
    "डॉ. M ने मापा। \"हमने खो दिया। वह लौटा,\" प्रो. R ने कहा। क्या?|डॉ. M ने मापा।|\"हमने खो दिया। वह लौटा,\" प्रो. R ने कहा।|क्या?",
    "На снимках 2009 г. видны дуги и т. д. вокруг. С 2018 г. Спектр им. М. Г. Арн (см. рис. 7). Да!|На снимках 2009 г. видны дуги и т. д. вокруг.|С 2018 г.|Спектр им. М. Г. Арн (см. рис. 7).|Да!",
    "L'an 1977 av. J.-C. par erreur. Est-ce vrai ? « Perdu. Revenu », a dit le Dr H. Oph.|L'an 1977 av. J.-C. par erreur.|Est-ce vrai ?|« Perdu. Revenu », a dit le Dr H. Oph.",
    "Արդյո՞ք դա է։ Թիվ 1973 թ. ձմռանից։|Արդյո՞ք դա է։|Թիվ 1973 թ. ձմռանից։",
    "هل هو متغير حقا؟ «فقدنا. ثم عاد»، قال أ. Ril.|هل هو متغير حقا؟|«فقدنا. ثم عاد»، قال أ. Ril.",
]


def test_sentences_by_script(spark):
    rows = [(n, c.split("|")[0]) for n, c in enumerate(CASES)]
    got = {}
    for r in sentences.sentence_units(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect():
        assert rows[r.id][1][r.start_pos : r.end_pos] == r.unit
        got.setdefault(r.id, []).append((r.start_pos, r.unit))
    for n, c in enumerate(CASES):
        assert [u for _, u in sorted(got[n])] == c.split("|")[1:]


def test_sentences_cover_every_character(spark):
    rng = random.Random(8)
    pieces = ["Ab", "cd", ".", "!", "?", "…", " ", "  ", "\n", "\n\n", "\r\n", "“", "”", "(", ")", '"', "«", "»", "5.3", "No.", "1)", "• ", "。", "字", "ไทย", ";", " ", "\U0001f600", "", "", "​", "J."]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, " \n "), (903, "word " * 40_000 + "end. " + "(" * 3000)]
    by = {}
    for r in sentences.sentence_units(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        by.setdefault(r.id, []).append((r.start_pos, r.end_pos))
    for i, t in rows:
        seen = [0] * len(t or "")
        for a, b in by.get(i, []):
            assert a < b and not re.match(r"\s", t[a]) and not re.match(r"\s", t[b - 1])
            for k in range(a, b):
                seen[k] += 1
        assert all(n == 1 or n == 0 and ch.isspace() for n, ch in zip(seen, t or "")), (i, t)


def test_sentence_rules_have_no_lengths(spark):
    words_ = "λέξη " * 400
    texts = [f"{words_}τέλος; Μετά.", "Head\n" + " " * 30 + "12) One. Two\nmore (" + "a " * 200 + "\n 12) kept. here) end. Last.", "(a. " * 2000 + "End. Last."]
    got = {}
    for r in sentences.sentence_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_text=True).collect():
        got.setdefault(r.id, []).append((r.start_pos, r.unit))
    assert [u for _, u in sorted(got[0])] == [words_ + "τέλος;", "Μετά."]
    assert [u for _, u in sorted(got[1])][:2] == ["Head", "12) One. Two"] and sorted(got[1])[-1][1] == "Last." and len(got[1]) == 4
    assert sorted(got[2])[-1][1] == "Last."
    many = " ".join(f"Sentence number {i} is here." for i in range(3000))
    places = sorted((r.start_pos, r.end_pos) for r in sentences.sentence_units(spark.createDataFrame([(1, many)], "doc_id long, text string")).collect())
    assert len(places) == 3000 and all(many[a:b] == f"Sentence number {i} is here." for i, (a, b) in enumerate(places))


def test_normal_form():
    assert evalleak.normal("Ｗhy: “ﬁve” É 5½?") == "".join(c for c in unicodedata.normalize("NFKC", "Ｗhy: “ﬁve” É 5½?").lower() if c.isalnum())


def test_bands_that_many_share_lose_no_pair(spark):
    rng = random.Random(11)
    base = words(rng, 60, 10**6)
    texts = {f"v{i:03d}": " ".join([*base[:59], f"n{i}"]) for i in range(150)} | {f"o{i}": " ".join(words(rng, 40, 10**6)) for i in range(20)}
    sets = {k: shingle_set(t) for k, t in texts.items()}
    truth = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    made = corpus_of(table(spark, texts), "document_id", "text")
    assert len(truth) == 150 * 149 // 2 and pairs(neardup.near_duplicate_pairs(made, 0.7)) == truth
    groups = {r.group_id for r in neardup.near_duplicate_groups(made, 0.8).collect() if r.id[0] == "v"}
    assert groups == {"v000"}


def test_long_quotations_stay_whole(spark):
    inner = "One is here. Two is there! " * 40
    texts = [f"{a}{inner.strip()} End{b} he said. Then more came." for a, b in ("“”", "„“", "«»", "「」", "『』", '""', "()", "（）", "[]")]
    texts += ["A ( " + "word. " * 50_000 + "\n" + ")x. Last one.", "An open (one. Two.\n\nThree) four."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sentences.sentence_units(df, keep_text=True).collect():
        got.setdefault(r.id, []).append((r.start_pos, r.unit))
    for i in range(10):
        assert len(got[i]) == 2, (i, sorted(got[i])[0])
    assert [u for _, u in sorted(got[10])] == ["An open (one.", "Two.", "Three) four."]


def test_every_block_of_items_has_its_automaton():
    class Shared:
        pass

    found = 0
    for n in range(300):  # a list that is freed leaves its address to the next
        form = f"item{n:04d}" * 10
        shared = Shared()
        shared.value = [(n, form)]
        batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([form])], names=["doc_id", "text"])
        found += sum(b["item_id"].to_pylist() == [n] for b in evalleak._scan(shared, 48)(iter([batch])))
        del shared
    assert found == 300
