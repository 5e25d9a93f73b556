import pytest
from conftest import by_key

from tallyframe.operators import lookup, names
from tallyframe.plans.tables import phylo_ready_table
from tallyframe.sources import files


def test_parse_na(spark):
    df = spark.createDataFrame([("NA",), ("12",), (None,), ("x",)], "Count string")
    assert [r.CountInt for r in files.parse_na(df, "Count", "CountInt").collect()] == [None, 12, None]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", None), (2, "c", 3.5)], "id bigint, name string, x double")
    path = files.write_table(df, str(tmp_path / "t"), "csv")
    assert sorted(files.read_table(spark, path, df.schema).collect()) == sorted(df.collect(), key=lambda r: r.id)
    (tmp_path / "quoted.csv").write_text('"POLYFID","species"\r\n1,45\r\n3,NA\r\n')
    (tmp_path / "plain.csv").write_text("POLYFID,species\n1,7\n")
    layers = files.read_richness_layers(spark, {"m": str(tmp_path / "quoted.csv"), "b": str(tmp_path / "plain.csv")})
    assert {(r.layer, r.POLYFID, r.species) for r in layers.collect()} == {("m", 1, 45), ("m", 3, None), ("b", 1, 7)}
    stage = files.write_table(df, str(tmp_path / "s"))
    assert files.reload_stage(spark, stage).count() == 2


def test_duplicate_policies(spark):
    trait = spark.createDataFrame([("a", 2, 10.0), ("a", 1, 20.0), ("b", 1, None), ("b", 2, 5.0)], "k string, o int, v double")
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "name string")

    def run(policy):
        return sorted(((r.name, r.m) for r in lookup.lookup(df, trait, "name", "k", {"v": "m"}, policy, "o").collect()),
                      key=str)

    assert run("first") == [("a", 20.0), ("a", 20.0), ("b", 5.0), ("z", None)]
    assert run("mean") == [("a", 15.0), ("a", 15.0), ("b", 5.0), ("z", None)]
    with pytest.raises(Exception, match="duplicate key"):
        run("unique")


def test_chain_prefers_the_later_source(spark):
    df = spark.createDataFrame([("Mus sp",), ("Mus musculus",), ("Rattus sp",)], "PreyScientificName string")
    trait = spark.createDataFrame(
        [("Mus musculus", "Mus", 20.0), ("Mus spretus", "Mus", 10.0), ("Rattus sp", "Rattus", 7.0)],
        "SciName string, Genus string, BodyMassValue double")
    found = by_key(lookup.prey_mass(df, trait), "PreyScientificName")
    assert found["Mus sp"].PreyMass == 15.0 and found["Mus musculus"].PreyMass == 20.0
    assert found["Rattus sp"].PreyMass == 7.0


def test_cell_richness_keeps_the_other_layers(spark):
    cells = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, 99)], "DataSet int, POLYFID int")
    layers = spark.createDataFrame([("m", 10, 5), ("b", 10, 7), ("m", 11, 2)], "layer string, POLYFID int, species int")
    found = by_key(lookup.cell_richness(cells, layers, ["m", "b"]))
    assert [(found[k].m, found[k].b) for k in (1, 2, 3, 4)] == [(5, 7), (None, None), (2, None), (None, None)]
    filled = by_key(lookup.cell_richness(cells, layers, ["m", "b"], fill=0))
    assert (filled[3].m, filled[3].b) == (2, 0)


def test_filters_keep_nulls_where_the_reference_does(spark):
    df = spark.createDataFrame([("a", 1), (None, 0), ("b", 5)], "o string, n int")
    assert names.exclude_values(df, "o", ["a"]).count() == 2
    assert names.drop_missing(df, "o").count() == 2
    assert names.thresholds(df, above={"n": 0}, nonzero=["n"]).count() == 2


def test_level_codes(spark):
    df = spark.createDataFrame([("Mix",), ("Birds",), ("Other",), (None,)], "d string")
    explicit = by_key(names.level_codes(df, "d", ["Mix", "Birds", "Mamms"]), "d")
    assert (explicit["Mix"].level, explicit["Birds"].level, explicit["Other"].level, explicit[None].level) == (1, 2, None, None)
    for hot in (10**6, 1):
        found = by_key(names.level_codes(df, "d", hot_rows=hot), "d")
        assert (found["Birds"].level, found["Mix"].level, found["Other"].level, found[None].level) == (1, 2, 3, None)


def test_renames_merge_taxa_and_take_one_step(spark):
    df = spark.createDataFrame([("Circus_hudsonius",), ("Circus_cyaneus",), ("Tyto_alba",)], "sp string")
    renamed = [r.sp for r in names.remap_names(df, "sp", names.DIET_RENAMES).collect()]
    assert renamed == ["Circus_cyaneus", "Circus_cyaneus", "Tyto_alba"]
    chain = spark.createDataFrame([("Tyto_alba", "x"), ("x", "y")], "old string, new string")
    assert "x" in [r.sp for r in names.remap_names(df, "sp", chain).collect()]
    assert len(names.DIET_RENAMES) == 9 and len(names.TRAIT_RENAMES) == 7


def test_phylo_ready_table(spark):
    diets = spark.createDataFrame(
        [("Circus hudsonius", 5.0, 1.0, 4), ("Circus cyaneus", 6.0, 1.2, 4), ("Tyto alba", 9.0, 2.0, 1)],
        "Species string, rare_NT double, rare_SE double, Biome int")
    traits = spark.createDataFrame([("Circus cyaneus", 400.0), ("Aquila fasciata", 2000.0)], "Species1 string, Mass double")
    table = phylo_ready_table(diets, traits, names.DIET_RENAMES, names.TRAIT_RENAMES)
    assert {(r.sp, r.rare_NT, r.Mass) for r in table.collect()} == {("Circus_cyaneus", 5.0, 400.0), ("Circus_cyaneus", 6.0, 400.0)}
    tips = spark.createDataFrame([("Tyto_alba",), ("Bubo_bubo",)], "sp string")
    kept = spark.createDataFrame([("Tyto_alba",)], "sp string")
    assert [r.sp for r in lookup.names_not_in(tips, kept, "sp").collect()] == ["Bubo_bubo"]
    assert [r.sp for r in lookup.names_in(tips, kept, "sp").collect()] == ["Tyto_alba"]
