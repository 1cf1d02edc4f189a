"""The pipeline stage by stage, the registry and the oracle of the mix."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gridtally.llm import near_dedup, pii, registry, toxicity
from tests.llm.test_links import slow_classes
from tests.test_oracles import compared

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), f"test-{name}")
        found.append((name, docs))
    return dict(found)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]
    columns = stages["documents"].columns
    assert all(stages[n].columns == columns for n in ("toxicity", "near_dedup", "pii", "mixing"))


def test_toxicity_stage(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train(stages["documents"], labels)
    rows = stages["documents"].collect()
    scores = model.scores([r["text"] for r in rows])
    kept = {r["doc_id"] for r, s in zip(rows, scores) if s < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in stages["toxicity"].collect()} == kept
    assert len(kept) >= 0.8 * len(rows)


def test_dedup_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["toxicity"].collect()]
    kept = {i for i, c in slow_classes(rows).items() if i == c}
    found = [r["doc_id"] for r in stages["near_dedup"].collect()]
    assert sorted(found) == sorted(kept)


def test_pii_stage(stages):
    own = pii.Cipher(pii.DEMO_KEY)
    before = {r["doc_id"]: r["text"] for r in stages["near_dedup"].collect()}
    after = {r["doc_id"]: r["text"] for r in stages["pii"].collect()}
    assert after == {i: pii.pseudonymised(t, own)[0] for i, t in before.items()}


def test_mixing_stage(stages):
    before = {r["doc_id"]: r for r in stages["pii"].collect()}
    words = Counter()
    for r in stages["mixing"].collect():
        words[r["doc_id"]] += len(r["text"].split())
        own = before[r["doc_id"]]
        assert (r["source"], r["lang"]) == (own["source"], own["lang"])
        assert Counter(r["text"].split()) <= Counter(own["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert all(n <= 3 * len(before[i]["text"].split()) for i, n in words.items())


def test_bpe_stage(stages):
    rows = stages["bpe"]
    assert rows.count() == stages["mixing"].count()
    assert rows.where(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).count() == stages["bpe"].count()


def test_stages_on_awkward_rows(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, toxicity string"
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, "w " * 5000, "en", None, 1, None)]
    rows += [(3, "w " * 5000, "en", None, 1, None), (None, "card 4111111111111111", "en", "s", 5, None), (4, "x", "de", "s", 1, "b")]
    docs = spark.createDataFrame(rows, shape)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).collect()
        assert all("4111111111111111" not in (r["text"] or "") for r in out) or name != "pii"
        if name in ("toxicity", "pii"):
            assert len(out) == len(rows)
        assert {r["toxicity"] for r in out} <= {"a", "b", None}
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert Counter(r["doc_id"] for r in kept) == {1: 1, 3: 1, None: 1, 4: 1}


def test_registry():
    names = {n.split("_")[0] for n in registry.queries()}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, tmp_path, name):
    compared(spark, name, registry.queries(), registry.oracle_sql(), SMALL, tmp_path)


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.__file__).parent / "gridtally"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "gridtally.llm" not in path.read_text()


def test_entry_without_the_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    package = tmp_path / "gridtally"
    package.mkdir()
    for path in (root / "gridtally").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (package / path.name).symlink_to(path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(entry.registry.queries())), "False"], said.stderr


def test_near_dedup_is_in_the_pipeline():
    assert corpus_pipeline.near_dedup is near_dedup and corpus_pipeline.ORACLE_SQL is None
