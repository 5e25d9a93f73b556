"""The per-diet table of the model queries: what it reads and stages, on rows of its own."""

import pytest

from tallyframe.operators.composition import GROUP
from tallyframe.plans import queries, tables
from tallyframe.sources import star

WORDS = ("red", "big")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three suppliers, 16 parts, and line items of every part for every supplier."""
    d = str(tmp_path_factory.mktemp("star"))
    nouns = sorted(star.ORDER_OF_NOUN)
    parts = [(k, f"{WORDS[k % 2]} {nouns[k // 2]}", "B", f"T{k % 3}", 1 + k, 10.0 * k) for k in range(16)]
    lines = [(s * 100 + k, k, s, 1 + (k + s) % 7, float(1 + (k * s) % 5), 1.0, 0.0, 0.0, "N", "O", None)
             for s in (1, 2, 3) for k in range(16)]
    data = {"part": parts, "lineitem": lines, "nation": [(0, "N0", 0)], "region": [(0, "R0")],
            "supplier": [(s, f"S{s}", 0, 1.0) for s in (1, 2, 3)],
            "customer": [(k, f"C{k}", 0, 1.0, star.SEGMENTS[k % 5]) for k in range(10)]}
    for name, rows in data.items():
        spark.createDataFrame(rows, star.SCHEMAS[name]).write.parquet(f"{d}/{name}.parquet")
    return d


def test_items_are_made_from_the_line_items_once(spark, folder, monkeypatch):
    calls = []
    made = star.diet_items
    monkeypatch.setattr(star, "diet_items", lambda *a: calls.append(a) or made(*a))
    table = queries.model_table(spark, folder)
    assert len(calls) == 1
    assert {r[GROUP] for r in table.collect()} <= {1, 2, 3}


def test_staged_prey_is_not_written_again(spark, folder, monkeypatch):
    prey, meta = queries.prey(spark, folder), star.diet_meta(spark, folder)
    written = []
    monkeypatch.setattr(tables, "cut_lineage", lambda df, *a: written.append(df) or df)
    table = tables.foraging_table(meta, prey, star.diet_items(spark, folder), min_obs=0)
    assert written == [] and table.count() == 3


def test_class_follows_from_the_order(spark, folder):
    items = star.diet_items(spark, folder)
    assert items.columns == ["DataSet", "IDLevel", "PreyClass", "PreyOrder", "PreyScientificName", "CountInt"]
    rows = items.collect()
    assert {(r.PreyOrder, r.PreyClass) for r in rows} == set(star.CLASS_OF_ORDER.items())
    assert len({(r.DataSet, r.IDLevel, r.PreyScientificName) for r in rows}) == len(rows)
    assert sum(r.CountInt for r in rows) == sum(1 + (k * s) % 5 for s in (1, 2, 3) for k in range(16))
