"""Graph, dedup, ingest, access, probes, packing, shards and streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import dedup, ingest, packing, probes
from skein.operators.components import connected_components
from skein.operators.latest import latest_per_key, utc_instant
from skein.sources import jsonl, shards
from skein.sources.manifest import MANIFEST, SplitReader, contract_violations
from skein.streaming import ingest as streams


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), (None, "y"), ("p", "q"), ("p", "q")]
    edges += [(f"r{rng.randrange(200)}", f"r{rng.randrange(200)}") for _ in range(150)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_latest_delivery_in_any_spelling(spark):
    rows = [("a", "2025-01-01T00:00:00Z", 1), ("a", "2025-01-01T00:00:01.000Z", 2), ("a", "2024-12-31T23:00:00+00:00", 3), ("b", None, 4), ("b", "bad", 5), (None, "2025-01-01T00:00:00Z", 6)]
    df = spark.createDataFrame(rows, "id string, at string, n int")
    got = {r.id: r.n for r in latest_per_key(df, "id", utc_instant("at").desc_nulls_last()).collect()}
    assert got["a"] == 2 and got["b"] in (4, 5) and len(got) == 2


def test_clusters_and_manifest(spark):
    rng = random.Random(0)
    base = [f"w{rng.randrange(999)}" for _ in range(120)]
    edited = base[:60] + ["new"] + base[61:]
    rows = [("a", " ".join(base), "Mars"), ("b", " ".join(edited), "Moons of Mars"), ("c", " ".join(base), "Other"), ("d", " ".join(f"v{rng.randrange(999)}" for _ in range(90)), "Comet (body)"), ("e", "", "comet"), ("f", "x y", None)]
    df = spark.createDataFrame(rows, "document_id string, text string, title string")
    links = {tuple(r) for r in dedup.entity_links(df).collect()}
    assert links == {("b", "a"), ("d", "e")}
    near = dedup.near_pairs(dedup.signatures(df.where("text <> ''")))
    exact = dedup.exact_edges(df.select("document_id", F.sha2("text", 256).alias("sha")))
    members = dedup.clusters(df, [near, exact, dedup.entity_links(df)])
    assert {r.document_id: r.root for r in members.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    scored = df.select("document_id", F.lit(1.0).alias("score"), F.length("text").alias("chars"))
    by = {tuple(r.member_ids): r for r in dedup.cluster_manifest(members, scored).collect()}
    assert by["a", "b", "c"].representative_id == max((("a", len(rows[0][1])), ("b", len(rows[1][1]))), key=lambda x: x[1])[0]
    assert all(r.dedup_cluster_id.startswith("cluster_") and len(r.dedup_cluster_id) == 24 for r in by.values())


def test_a_large_group_of_copies_makes_a_star(spark):
    df = spark.range(300).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("document_id"), F.lit("one two three four five six seven").alias("text"))
    assert dedup.band_pairs(dedup.signatures(df)).count() == 299


def test_shared_paragraphs_stay_with_their_owner(spark):
    p, q = "p" * 90, "q" * 90
    rows = [("a", f"{p}\n\nx\n\n{p}"), ("b", f"{p}\n\n{q}\n\n{'own ' * 60}"), ("c", f"{q}"), ("d", None), ("e", f" {'z' * 90} ")]
    got = {r.id: r for r in dedup.keep_one_owner(spark.createDataFrame(rows, "document_id string, text string")).collect()}
    assert got["a"].text == rows[0][1] and got["a"].removed == 0
    assert got["b"].text == f"{q}\n\n{('own ' * 60).strip()}" and got["b"].removed == 1 and not got["b"].collapsed
    assert got["c"].text == "" and got["c"].collapsed
    assert got["d"].text is None and got["e"].text == rows[4][1]


def test_overlaps_between_splits(spark):
    rows = spark.createDataFrame([("train", "c1"), ("test", "c1"), ("test", "c2"), ("probe", None)], "split string, cluster string")
    blocks = spark.createDataFrame([("train", "h1", 90), ("probe", "h1", 90), ("train", "h2", 500), ("probe", "h2", 500), ("test", "h3", 100)], "split string, hash string, chars int")
    got = {(r.pool_a, r.pool_b): r for r in dedup.split_overlaps(rows, blocks).collect()}
    assert got["test", "train"].leaked and got["test", "train"].clusters == "c1"
    assert got["probe", "train"].leaked and got["probe", "train"].block_overlap == 2 and got["probe", "train"].substantial_overlap == 1
    assert len(got) == 2


def test_nearest_agreement(spark):
    rows = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [1, 2, 3, 9]), ("c", [7, 7, 7, 7])], "document_id string, sig array<long>")
    q = spark.createDataFrame([("q", [1, 2, 3, 5]), ("z", [8, 8, 8, 8])], "document_id string, sig array<long>")
    assert {r.id: r.nearest for r in dedup.nearest_agreement(q, rows, bands=2).collect()} == {"q": 0.75, "z": 0.0}


def test_category_walk_breadth_first(spark):
    rows = [("R", 14, "A", 1), ("R", 14, "B", 2), ("A", 14, "R", 1), ("A", 0, "page", 1), ("B", 0, "page", 1), ("R", 0, "top", 9), ("A", 14, "bad list", 3), ("bad list", 0, "hidden", 1), ("B", 14, "C", 1), ("C", 14, "D", 1), ("C", 0, "deep", 1), ("A", 0, "page", 5)]
    df = spark.createDataFrame(rows, "parent_category string, ns long, title string, list_position long")
    seen, pages = ingest.category_walk(df, "R", 2, F.col("title").rlike("(?i)LIST"))
    assert {tuple(r) for r in seen.collect()} == {("R", 0), ("A", 1), ("B", 1), ("C", 2)}
    assert {tuple(r) for r in pages.collect()} == {("top", 1, "R"), ("page", 2, "A")}


def test_dump_selection_and_snapshot(spark):
    dump = spark.createDataFrame([("1", "u", "A", "t"), ("2", "u", "B", "t"), ("3", "u", "C", "t")], "id string, url string, title string, text string")
    ids, titles = dump.where("id = '1'").select("id"), dump.where("title in ('A', 'B')").select("title")
    ids_of = lambda df: sorted(r.id for r in df.collect())
    assert ids_of(ingest.select_dump(dump, ids, titles)) == ["1", "2"]
    assert ids_of(ingest.select_dump(dump)) == ["1", "2", "3"] and ids_of(ingest.select_dump(dump, ids)) == ["1"] and ids_of(ingest.select_dump(dump, None, titles)) == ["1", "2"]
    r = ingest.dump_records(dump, "w", "20231101.en", "a" * 40, "now").where("source_record_id = '2'").first()
    assert r.document_id == "doc_w_2_20231101" and r.published_at == "2023-11-01T00:00:00Z" and r.revision_id == "dump@" + "a" * 12 + ":20231101.en"


def test_contents_tree(spark):
    tree = {"id": "b", "title": "Book", "contents": [{"id": "c1", "title": "<b>One</b>\nA"}, {"id": "u", "title": "U", "contents": [{"id": "c2", "title": "Two"}]}]}
    rows = ingest.sections(spark.createDataFrame([(json.dumps(tree),)], "t string"), "t").collect()
    assert [(r.id, r.title) for r in sorted(rows, key=lambda r: r.position)] == [("c1", "One A"), ("c2", "Two")]


def test_as_of(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 9, "z"), ("b", 9, "w")], "k string, at int, v string")
    assert [tuple(r) for r in ingest.latest_before(rows, "k", "at", F.lit(5), ["v"]).collect()] == [("a", 5, "y")]


def test_reader_keeps_held_out_splits_shut(spark):
    rows = spark.createDataFrame([("a", "Train ", "xé"), ("b", "test", "y"), ("c", "probe", "z"), ("d", "train", None)], "document_id string, split string, text string")
    r = SplitReader(rows.where("document_id <> 'd'"))
    assert [x.document_id for x in r.training_texts().collect()] == ["a"] and tuple(r.training_bytes().first()) == (1, 3)
    for call in (lambda: r.texts_of("test", allow_eval=True), lambda: r.texts_of("probe"), lambda: r.texts_of("excluded", allow_final_eval=True)):
        with pytest.raises(PermissionError):
            call()
    assert r.texts_of("test", allow_final_eval=True).count() == 1 and r.texts_of("probe", allow_eval=True).count() == 1
    with pytest.raises(ValueError):
        r.texts_of("dev")
    with pytest.raises(Exception, match="no text: d"):
        SplitReader(rows).training_texts().collect()


def test_contract(spark):
    good = {f.name: "x" for f in MANIFEST} | {"document_id": "doc_a_1", "raw_sha256": "0" * 64, "clean_sha256": "a" * 64, "language_score": 0.5, "split": "train", "author_attribution": [], "quality_flags": [], "rejection_reasons": [], "is_representative": True, "quality_score": 1.0}
    bad = good | {"document_id": "a", "language_score": 1.5, "split": "dev", "title": None, "raw_sha256": "ABC"}
    rows = spark.createDataFrame([tuple(x[f.name] for f in MANIFEST) for x in (good, bad)], MANIFEST)
    assert {r.rule: r.violations for r in contract_violations(rows).collect()} == {"document_id_form": 1, "raw_sha256_form": 1, "clean_sha256_form": 0, "language_score_range": 1, "split_name": 1, "missing_required": 1}


def test_probe_groups_are_equal(spark):
    df = spark.range(200).select(F.concat(F.lit("d"), "id").alias("id"), (F.col("id") % 4 == 0).alias("sib"))
    got = probes.deal_groups(df, "id", "sib", 20, 5, 1)
    n = {r.group: r["count"] for r in got.groupBy("group").count().collect()}
    assert n == {g: 20 for g in probes.GROUPS} | {"spare": 60}
    sib = {r.id for r in df.where("sib").collect()}
    assert all(r.id in sib for r in got.where("`group` = 'A'").collect())
    few = probes.deal_groups(df.withColumn("sib", F.lit(False)), "id", "sib", 500, 5, 1)
    n = {r.group: r["count"] for r in few.groupBy("group").count().collect()}
    assert "A" not in n and len({v for g, v in n.items() if g != "spare"}) == 1


@pytest.mark.parametrize("target", [0.9, 0.8, 0.65, 0.5])
def test_edits_reach_their_target(target):
    rng = random.Random(7)
    text = "  ".join(f"w{rng.randrange(5000)}" for _ in range(300)) + "\n"
    made, score, n = probes.edited(text, target, ["alpha", "beta", "gamma"], "s|1")
    a, b = probes.shingles(text), probes.shingles(made)
    assert abs(len(a & b) / len(a | b) - target) <= 0.02 and score == len(a & b) / len(a | b)
    assert len(made.split()) == 300 and made.count("  ") == 299 and made.endswith("\n")
    assert probes.edited(text, target, ["alpha", "beta", "gamma"], "s|1") == (made, score, n)
    assert probes.edited("", 0.5, ["x"], "s")[0] == ""


def test_numbering_and_canaries(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    rows = probes.numbered(df, probes.seeded(3, "k"), "k").collect()
    assert sorted(r.n for r in rows) == list(range(1000))
    order = [r.k for r in sorted(rows, key=lambda r: r.n)]
    assert [r.k for r in df.orderBy(F.shiftrightunsigned(probes.seeded(3, "k"), 1), "k").collect()] == order
    made = probes.canaries(spark, ["a", "b"], [1, 3], 2, 4, 8, 5)
    assert made.count() == 8 and probes.canary_copies(made).count() == 8
    assert probes.set_digest(df, "k").first() == probes.set_digest(df.orderBy(F.desc("k")), "k").first()


def packed(spark, docs, eos=-1, pad=-2):
    df = spark.createDataFrame(docs, "id string, tokens array<int>, bytes long")
    return sorted(packing.pack(df, "id", "tokens", "bytes", eos, pad).collect(), key=lambda r: r.window)


@pytest.mark.parametrize(("n", "pads"), [(254, 1), (255, 0), (256, 255)])
def test_packing_edges(spark, n, pads):
    rows = packed(spark, [("a", list(range(1, n + 1)), 1000)])
    assert rows[-1].input_ids.count(-2) == pads and all(len(r.input_ids) == len(r.loss_mask) == len(r.segment_ids) == 256 for r in rows)
    assert sum(r.byte_count for r in rows) == 1000
    assert all(r.loss_mask[0] == 0 for r in rows) and sum(sum(r.loss_mask) for r in rows) == n + 1 - len(rows)


def test_packing_many_documents(spark):
    rng = random.Random(9)
    docs = [(f"d{i:03d}", [rng.randrange(100) for _ in range(rng.randrange(0, 300))], rng.randrange(0, 900)) for i in range(60)] + [("null", None, 5)]
    rows = packed(spark, docs)
    stream = [t for _, ids, _ in sorted(docs) for t in [*(ids or []), -1]]
    assert [t for r in rows for t in r.input_ids if t != -2] == stream
    assert sum(r.byte_count for r in rows) == sum(b for _, ids, b in docs if ids)
    for r in rows:
        real = [s for s in r.segment_ids if s >= 0]
        assert real == sorted(real) and real[0] == 0 and [s for s in r.segment_ids if s < 0] == list(range(-1, -1 - (256 - len(real)), -1))
    df = packing.token_stream(packing.pack(spark.createDataFrame(docs, "id string, tokens array<int>, bytes long"), "id", "tokens", "bytes", -1, -2))
    assert df.count() == len(stream)


def test_chunks_share_one_token(spark):
    df = spark.createDataFrame([("a", list(range(10))), ("b", [1]), ("c", [])], "id string, t array<int>")
    rows = sorted(packing.overlapping_chunks(df, "id", "t", 4).collect(), key=lambda r: r.chunk)
    assert [r.ids for r in rows] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]


def test_shards_round_trip(spark, tmp_path):
    rows = packed(spark, [(f"d{i}", [i] * 200, 400 + i) for i in range(12)])
    df = spark.createDataFrame(rows)
    manifest = shards.write_folder(df, str(tmp_path), 4).collect()
    assert sum(r.windows for r in manifest) == len(rows) and len(manifest) == -(-len(rows) // 4)
    back = sorted(shards.read_folder(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.window))
    assert [(r.input_ids, r.loss_mask, r.segment_ids, r.byte_count) for r in back] == [(r.input_ids, r.loss_mask, r.segment_ids, r.byte_count) for r in rows]
    data = next(tmp_path.glob("*.bin")).read_bytes()
    for broken in (data[:-1], b"XXXX" + data[4:], data[:8], b""):
        with pytest.raises(ValueError):
            shards.decode(broken)


def test_json_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"b": 1, "a": "x"}\n\nnot json\n{"a": "y"}\n')
    assert sorted(r.a for r in jsonl.read_tolerant(spark, str(path), "a string, b int").collect()) == ["x", "y"]
    assert jsonl.read_tolerant(spark, str(tmp_path / "none.jsonl"), "a string").count() == 0
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(path), "a string, b int").collect()
    df = spark.createDataFrame([("1", "train"), ("2", "test")], "document_id string, split string")
    jsonl.write_by_split(df, str(tmp_path / "open"), str(tmp_path / "sealed"))
    assert not (tmp_path / "open" / "split=test").exists() and (tmp_path / "sealed" / "split=test").exists()
    assert jsonl.pending(df, df.where("document_id = '1'"), "document_id").count() == 1


def test_streams(spark, tmp_path):
    rows = [("a", "2025-01-01T00:00:00Z"), ("a", "2025-01-01T00:00:05Z"), ("b", "2025-01-01T00:01:00Z")]
    df = spark.createDataFrame(rows, "document_id string, retrieved_at string")
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once = lambda: streams.run_to_end(streams.delivered_once(streams.arriving(spark, str(tmp_path / "in"), df.schema), ["document_id"], "retrieved_at"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.document_id for r in once().collect()) == ["a", "b"]
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.document_id for r in once().collect()) == ["a", "b"]


def test_siblings_and_bundles(spark):
    p = spark.createDataFrame([("a", "T", "one two three"), ("b", "U", "x y"), ("c", None, "z"), ("d", "V", "q r s t"), ("e", "W", "same words here")], "document_id string, title string, text string")
    s = spark.createDataFrame([("s1", "T", "old", True), ("s2", "T", "one four", True), ("s3", "U", "m n", False), ("s4", "W", "here same words", True)], "document_id string, title string, text string, accepted boolean")
    got = {r.document_id: r for r in probes.sibling_audit(p, s).collect()}
    assert {k: r.reason for k, r in got.items()} == {"a": "accepted", "b": "quality", "c": "missing", "d": "missing", "e": "overlap"}
    assert got["a"].sibling_id == "s2" and got["a"].overlap == pytest.approx(0.25)
    x = spark.createDataFrame([("a", "1"), ("b", "2")], "document_id string, sha256 string")
    one = {r.section: r.digest for r in probes.bundle({"v": x, "t": x.limit(0)}).collect()}
    again = {r.section: r.digest for r in probes.bundle({"v": x.orderBy(F.desc("document_id")), "t": x.limit(0)}).collect()}
    other = {r.section: r.digest for r in probes.bundle({"v": x.withColumn("sha256", F.lit("3")), "t": x.limit(0)}).collect()}
    assert one == again and one["v"] != other["v"] and set(one) == {"v", "all"}


def test_siblings_of_every_group(spark):
    text = " ".join(f"word{i}" for i in range(200))
    groups = ("A", "C", "B90", "B50", "Z", "spare")
    assigned = spark.createDataFrame([(f"d{g}", g, text) for g in groups], "id string, group string, text string")
    got = {r.group: r for r in probes.sibling_sets(assigned, spark.createDataFrame([("dA", "a match")], "id string, text string"), ["there", "which"], 1).collect()}
    assert set(got) == {"A", "C", "B90", "B50"} and got["B90"].sibling_id == "sib_b90_dB90"
    assert (got["A"].text, got["C"].text, got["C"].jaccard) == ("a match", text, 1.0)
    assert got["B90"].within_tolerance and abs(got["B90"].jaccard - 0.9) <= 0.02 and got["B50"].text != text


def test_copies_among_shuffled_documents_and_fractions(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", "t") for i in range(100)], "id string, text string")
    copies = spark.createDataFrame([("canary_m04_000", "c", k) for k in (1, 2, 3, 4)], "canary_id string, text string, copy int")
    rows = sorted((r.position, r.id) for r in probes.packing_order(docs, copies, 7).collect())
    assert [p for p, _ in rows] == list(range(104)) and sum(i.startswith("canary_m04_000_copy0") for _, i in rows) == 4
    alone = [i for _, i in sorted((r.position, r.id) for r in probes.packing_order(docs, copies.limit(0), 7).collect())]
    assert [i for _, i in rows if i[0] == "d"] == alone != sorted(alone)
    assert {r.id for r in probes.fraction_subset(docs, 4, 7).collect()} == set(alone[:25])
    assert {r.id for r in probes.fraction_subset(docs, 8, 7).collect()} == set(alone[:12])
    assert probes.fraction_subset(docs.limit(3), 8, 7).count() == 1


def test_sections_of_any_depth_and_their_records(spark):
    tree = {"id": "leaf", "title": "<b>Deep</b>\nend"}
    for n in range(12):
        tree = {"id": f"n{n}", "title": f"Level {n}", "contents": [json.dumps({"id": f"l{n}", "title": f"Leaf {n}"}), json.dumps(tree)]}
    leaves = ingest.sections(spark.createDataFrame([(json.dumps(tree),)], "t string"), "t")
    got = {r.id: r for r in leaves.collect()}
    assert set(got) == {"leaf", *(f"l{n}" for n in range(12))} and got["leaf"].title == "Deep end"
    assert [r.id for r in sorted(got.values(), key=lambda r: r.position)][0] == "l11"
    pages = spark.createDataFrame([("leaf", "u", "<p>x</p>"), ("l0", "v", None)], "id string, url string, html string")
    (r,) = ingest.section_records(leaves, pages, "book", "2e", "2024-01-01T00:00:00Z").collect()
    assert r.document_id == "doc_book_leaf_2e" and r.raw_text == "<p>x</p>"


def test_latest_revision_by_requested_title(spark):
    page = lambda rev, at: json.dumps({"query": {"pages": {"7": {"pageid": 7, "title": "Comet", "revisions": [{"revid": rev, "timestamp": at, "content": f"text {rev}"}]}}, "redirects": [{"from": "Comets", "to": "Comet"}], "normalized": [{"from": "comets", "to": "Comets"}]}})
    df = spark.createDataFrame([(page(71, "2023-01-02T00:00:00Z"),), (page(72, "2023-02-02T00:00:00Z"),)], "p string")
    titles = spark.createDataFrame([("comets",), ("Comet",), ("Nowhere",)], "title string")
    got = {r.requested: r.revision_id for r in ingest.latest_by_title(df, "p", titles, "wiki", "now").collect()}
    assert got == {"comets": "72", "Comet": "72"}


def test_epochs_keep_the_order_of_documents(spark):
    docs = spark.range(200).select(F.col("id").cast("string").alias("id"))
    extras = spark.range(20).select(F.concat(F.lit("x"), "id").alias("id"))
    order = lambda *a, **k: [r.id for r in sorted(probes.epoch_order(docs, *a, **k).collect(), key=lambda r: r.position)]
    one, more = order(1, 5), order(1, 5, extras)
    assert one == [i for i in more if not i.startswith("x")] and len(more) == 220
    assert order(2, 5) != one and sorted(order(2, 5)) == sorted(one) and order(1, 5, extras, cursor=50) == more[50:]


def test_offsets_over_rows_of_any_order(spark):
    from skein.operators import packing

    df = spark.createDataFrame([(i % 7, str(i), i) for i in range(300)], "a int, b string, n long")
    got = packing.offsets(df.select(F.struct("a", "b").alias("k"), "n"), "k", F.col("n"), 16).collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.k.a, r.k.b)):
        assert r.offset == total
        total += r.n


def test_written_tables_end_with_their_scope(spark):
    import os

    from skein import storage

    with storage.scope(spark):
        t = storage.bucketed(spark.range(100).select("id", F.col("id").cast("string").alias("v")), "id")
        w = storage.written(spark.range(5))
        files = [f.removeprefix("file:").replace("//", "/") for f in t.inputFiles() + w.inputFiles()]
        assert t.where("id = 7").first().v == "7" and w.count() == 5 and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))


def test_mean_by_resampling(spark):
    from skein.operators import statistics as ST

    df = spark.range(400).select("id", F.when(F.col("id") < 390, (F.col("id") % 10).cast("double")).alias("v"))
    r = ST.bootstrap_mean(df, "id", "v").first()
    assert r.n == 390 and r.mean == pytest.approx(4.5) and r.low < 4.5 < r.high and 0.4 < r.high - r.low < 0.8
