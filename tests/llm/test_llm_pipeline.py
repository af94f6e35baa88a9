import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ROOT = Path(__file__).resolve().parents[2]


def test_stages_keep_columns_and_take_effect(spark, awkward, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, counts = awkward, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == awkward.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[2] <= counts[1] <= counts[0] and counts[4] == counts[3]


def test_empty_table(spark, no_docs, no_labels, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_entry_without_the_subpackage():
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tracewarden.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
assert e.llm is None and "pipeline" not in e.queries() and e.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
