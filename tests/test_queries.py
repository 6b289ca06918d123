"""Every registered query runs at the smallest scale, and equals its SQL where it has one."""

from __future__ import annotations

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    one = lambda v: "null" if v is None or pd.isna(v) else f"{float(v):.6f}" if isinstance(v, float) or "float" in type(v).__name__ else str(v)
    return sorted(tuple(one(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    numbers = lambda x: [tuple(v.removesuffix(".000000") for v in r) for r in x]
    assert numbers(a) == numbers(b)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    got = [tuple(map(str, r)) for r in df.collect()]
    assert len(set(got)) == len(got) and (got or name == "epoch_positions")  # rows are distinct; the cursor lies beyond the smallest table


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_order_sweep_goes_up_to_six(spark):
    got = {r.order: r for r in entry.queries()["kneser_ney_order_sweep"](spark, FOLDER).collect()}
    assert sorted(got) == [3, 4, 5, 6] and len({r.targets for r in got.values()}) == 1
    five = entry.queries()["kneser_ney_registered_nll"](spark, FOLDER).agg({"nll": "sum"}).first()[0]
    assert five == pytest.approx(got[5].nll, abs=0.01)


def test_order_sweep_writes_less_than_twice_its_input(spark):
    from skein.storage import shared_folder

    def size(folder):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder.removeprefix("file:")) for f in files if f.endswith(".parquet"))

    before = size(shared_folder(spark))
    entry.queries()["kneser_ney_order_sweep"](spark, FOLDER).collect()
    assert size(shared_folder(spark)) - before < 2 * os.path.getsize(f"{FOLDER}/astronomy_sample.parquet")


def test_canary_words_come_from_the_whole_vocabulary(spark, monkeypatch):
    from skein.operators import probes

    words, seen, make = [f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(2500)], [], probes.canaries
    monkeypatch.setattr(probes, "vocabulary", lambda df, least: spark.createDataFrame([(w, 3000 - i) for i, w in enumerate(words)], "word string, n long"))
    monkeypatch.setattr(probes, "canaries", lambda spark, drawn, *a: seen.append(drawn) or make(spark, drawn, *a))
    assert entry.queries()["canary_copies"](spark, FOLDER).count() == 8 * (1 + 4 + 16)
    assert seen == [sorted(words)]
