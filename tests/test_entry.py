import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_belong_together():
    q = entry.queries()
    assert len(q) > 60 and set(entry.oracle_sql()) <= set(q)


def test_nothing_outside_imports_the_subpackage():
    for p in (ROOT / "sievework").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "sievework.llm" not in p.read_text(encoding="utf-8"), p


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['sievework.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout) >= 60


def test_streamed_ingest(spark, tmp_path):
    from sievework.sources import files
    from sievework.streaming import ingest

    base = f"file://{tmp_path}"
    spark.createDataFrame([(1, "Erster Satz. " * 60), (2, None)], "id long, text string").write.parquet(f"{base}/landing")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_stream(spark, f"{base}/landing", "id bigint, text string", f"{base}/store", f"{base}/cp").awaitTermination()
        rows = files.current_chunks(spark, f"{base}/store", ingest.CHUNKS).collect()
        assert sorted(r["chunk_index"] for r in rows) == list(range(1, len(rows) + 1)) and {r["document_id"] for r in rows} == {1}


