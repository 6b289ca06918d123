"""What must hold of the registered queries that have no SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def run(spark, name):
    return entry.queries()[name](spark, FOLDER).collect()


def test_no_group_is_torn(spark):
    rows = run(spark, "p6_assignment")
    by = {}
    for r in rows:
        by.setdefault(r.group_id, set()).add((r.split, r.state))
        assert r.group_id <= r.document_id
    assert all(len(s) == 1 for s in by.values()) and len({r.document_id for r in rows}) == len(rows)
    torn = {r.group_id for r in run(spark, "p6_found")}
    assert torn == {g for g, s in by.items() if next(iter(s))[1] == "quarantined"}


def test_units_are_apart_and_begin_and_end_with_text(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by = {}
    for r in run(spark, "p9_found"):
        by.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for i, units in by.items():
        units.sort()
        assert all(a < b and not texts[i][a].isspace() and not texts[i][b - 1].isspace() for a, b in units)
        assert all(b <= c for (_, b), (c, _) in zip(units, units[1:]))
        left = "".join(texts[i][b:c] for (_, b), (c, _) in zip([(0, 0), *units], [*units, (len(texts[i]), 0)]))
        assert not left.strip()


def test_the_mix_keeps_its_caps_and_shares(spark):
    chosen, shares = run(spark, "p8_mix"), {r.source: r for r in run(spark, "p8_shares")}
    caps = {s: r.max_repeats for s, r in shares.items()}
    assert all(1 <= r.repeats <= (caps[r.source] or 10**9) for r in chosen)
    total = sum(r.tokens * r.repeats for r in chosen)
    largest = max(r.tokens for r in chosen)
    for s, r in shares.items():
        assert r.tokens == sum(c.tokens * c.repeats for c in chosen if c.source == s)
        assert abs(r.tokens - r.target_share * total) <= largest * (len(shares) + 1)
