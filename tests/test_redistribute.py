"""Genus words in names, by rolling hashes, and what unknown counts do."""

import random

from conftest import by_key

from tallyframe.operators import redistribute
from tallyframe.operators.redistribute import genus_vocabulary, redistribute_genus, window_hashes


def test_equal_windows_have_equal_hashes():
    rng = random.Random(5)
    text = "".join(rng.choice("ab\U0001F989é") for _ in range(300))
    seen = {}
    for n, hashes in window_hashes(text, [0, 1, 2, 7, 300, 301]):
        assert len(hashes) == len(text) - n + 1
        for at, h in enumerate(hashes):
            assert seen.setdefault((n, int(h)), text[at:at + n]) == text[at:at + n]
    assert {n for n, _ in seen} == {1, 2, 7, 300}
    assert len(seen) == len({text[i:i + n] for n in (1, 2, 7, 300) for i in range(len(text) - n + 1)})


def _brute(rows):
    names = {r[1] for r in rows if r[1] is not None}
    words = {r[1].split(" ")[0] for r in rows if r[4] == "Genus" and r[1] is not None}
    return {(n, w) for n in names for w in words if w in n}


def test_words_are_found_anywhere_in_names(make_items, monkeypatch):
    rng = random.Random(8)
    genera = ["Mus", "Musimon", "us", "É", "\U0001F989\U0001F989", "Rattus"]
    rows = [(1, "".join(rng.choice(["Mus", "imon", "Rat", "tus", " ", "É", "\U0001F989", "x" * 40]) for _ in range(rng.randint(1, 9))), 1, 1.0, "Species")
            for _ in range(200)]
    rows += [(2, f"{g} sp", 3, None, "Genus") for g in genera] + [(2, None, 3, None, "Genus"), (1, None, 1, 1.0, "Species")]
    for windows in (redistribute.WINDOWS, 50):
        monkeypatch.setattr(redistribute, "WINDOWS", windows)
        found = genus_vocabulary(make_items(rows, 5)).collect()
        assert len(found) == len(set(found)) and {tuple(r) for r in found} == _brute(rows)
    # Every hash alike: the texts decide.
    monkeypatch.setattr(redistribute, "_BASE", 0)
    monkeypatch.setattr(redistribute, "_INVERSE", 0)
    assert {tuple(r) for r in genus_vocabulary(make_items(rows, 5)).collect()} == _brute(rows)


def test_plan_has_no_array_per_name(make_items):
    items = make_items([(1, "Mus a", 3, 1.0), (1, "Mus sp", 4, None, "Genus")])
    for df in (genus_vocabulary(items), redistribute_genus(items)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(word in plan for word in ("collect_list", "transform(", "flatten(", "explode("))


def test_unknown_counts_and_repeated_rows(make_items):
    rows = [(1, "Mus a", 3, 1.0), (1, "Mus a", 3, 1.0), (1, "Mus b", 6, 1.0), (1, "Mus c", None, 1.0), (1, "Mus sp", 12, None, "Genus")]
    rows += [(2, "Mus a", 5, 1.0), (2, "Mus sp", None, None, "Genus"), (3, "Rattus sp", 2, None, "Genus"), (3, "Mus a", 0, 1.0), (3, "Mus sp", 9, None, "Genus")]
    found = sorted(redistribute_genus(make_items(rows, 3)).select("DataSet", "PreyScientificName", "CountInt").collect(), key=str)
    assert sorted(map(tuple, found), key=str) == sorted([
        (1, "Mus a", 6), (1, "Mus a", 6), (1, "Mus b", 12), (1, "Mus c", None), (2, "Mus a", None), (3, "Rattus sp", 2), (3, "Mus a", 0), (3, "Mus sp", 9)], key=str)
    assert redistribute_genus(make_items(rows).filter("false")).collect() == []
    assert by_key(redistribute_genus(make_items([(1, "Mus a", 2)])))[1].CountInt == 2
