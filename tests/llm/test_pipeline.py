import shutil

import pytest

import corpus_pipeline
from tallyframe.llm import decontamination, mixing, simhash, substrings, toxicity
from tallyframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, out[-1][1], SF).cache()
        out.append((name, done))
    return out


def test_stages_keep_the_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_decontamination", "source_mix"]
    for _, frame in results[:-1]:
        assert frame.dtypes == results[0][1].dtypes


def test_each_decision_takes_effect(spark, results):
    frames = dict(results)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = {n: sorted(r.doc_id for r in f.select("doc_id").collect()) for n, f in results}
    scored = toxicity.score_toxicity(frames["documents"], labels.filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) <> 2"))
    assert ids["toxicity"] == sorted(r.doc_id for r in scored.filter("predicted = 0").collect())
    groups = simhash.simhash_components(frames["toxicity"]).collect()
    assert ids["near_duplicates"] == sorted({r.component_id for r in groups})
    cut = {r.doc_id: r for r in substrings.dedup_substrings(frames["near_duplicates"]).collect()}
    before = {r.doc_id: r for r in frames["near_duplicates"].collect()}
    for r in frames["repeated_passages"].collect():
        assert r.text == (cut[r.doc_id].kept_text if cut[r.doc_id].n_removed else before[r.doc_id].text)
        assert r.n_chars == (len(r.text) if cut[r.doc_id].n_removed else before[r.doc_id].n_chars)
    bad = {r.doc_id for r in decontamination.contaminated(frames["repeated_passages"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids["benchmark_decontamination"] == sorted(set(ids["repeated_passages"]) - bad)
    mixed = mixing.mix_sources(frames["benchmark_decontamination"]).collect()
    assert sorted(mixed) == sorted(frames["source_mix"].collect())


def test_stages_take_odd_documents(spark, make_docs, edges, prose):
    docs = make_docs([*edges, (50, prose(50, 1)), (51, prose(50, 1)), (50, prose(50, 1))])
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        done = stage(spark, docs, SF)
        if name != "source_mix":
            assert sorted(done.columns) == sorted(docs.columns)
        assert 0 < done.count() <= docs.count()


def test_eleven_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and "pipeline" in names
    assert set(QUERIES) < set(names) and set(ORACLES) <= set(QUERIES)


def test_the_rest_works_without_this_subpackage(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "tallyframe", tmp_path / "tallyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 100, done.stderr
