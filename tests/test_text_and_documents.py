import datetime

import pytest
from pyspark.sql import functions as F

from sievework.config import Bm25, Retrieval
from sievework.functions import text as tx
from sievework.operators import documents as docs
from sievework.sources import files


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_clean(spark):
    assert one(spark, tx.clean(F.col("t")), t="first   line\r\n\r\n\r\nsecond\tline") == "first line\n\nsecond line"
    assert one(spark, tx.clean(F.col("t")), t=" \t\r\n ") == ""


@pytest.mark.parametrize("line,yes", [("# a", 1), ("第二章 JVM", 1), ("3.14 is pi", 1), ("（一）x", 1), ("plain", 0), ("", 0), ("#a", 0)])
def test_heading(spark, line, yes):
    assert bool(one(spark, tx.is_heading(F.col("t")), t=line)) == bool(yes)


def test_occurrences_do_not_overlap(spark):
    assert one(spark, tx.occurrences(F.col("t"), F.lit("aa")), t="aaaaa") == 2
    assert one(spark, tx.occurrences(F.col("t"), F.lit("")), t="aaaaa") == 0


def test_settings_out_of_range():
    assert Bm25(k1=-1, b=2, average_length=0).checked() == Bm25()
    assert Retrieval(vector_weight=-1).weights() == (0.6, 0.4)
    assert Retrieval(vector_weight=0, keyword_weight=0).weights() == (0.6, 0.4)


def test_transitions(spark):
    s = F.lit(2)
    assert one(spark, docs.transition(s, "retry")) == 0
    assert one(spark, docs.transition(F.lit(1), "retry")) is None
    assert one(spark, docs.transition(F.lit(0), "reject")) == 2
    assert one(spark, docs.status_name(F.lit(None).cast("int"))) == "UNKNOWN"


@pytest.mark.parametrize(
    "name,size,kind,code",
    [
        ("a.txt", 5, "text/plain; charset=utf-8", 200), ("a.exe", 5, None, 415), ("a/b.txt", 5, None, 400), (None, 5, None, 400),
        ("a.pdf", 5, "text/plain", 415), ("a.md", 0, None, 400), ("a.md", 60 * 1024 * 1024, None, 413), ("noending", 5, None, 415),
    ],
)
def test_upload(spark, name, size, kind, code):
    row = spark.createDataFrame([(name, size, kind)], "name string, size long, kind string")
    assert row.select(docs.upload_code(F.col("name"), F.col("size"), F.col("kind"))).first()[0] == code


def test_signatures_and_parsing(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("[Content_Types].xml", "<x/>")
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<d xmlns:w="{w}"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p></d>')
    pdf = b"%PDF-1.4\n1 0 obj\nstream\nBT (Hello \\(you\\)) Tj T* (there) Tj ET\nendstream\n"
    rows = [("a.docx", buffer.getvalue()), ("b.pdf", pdf), ("c.txt", "x  y\r\n".encode() + b"\xff"), ("d.pdf", b"no"), ("e.txt", b"\0"), ("f.txt", None), ("g.docx", b"PK")]
    df = spark.createDataFrame(rows, "name string, content binary")
    out = {r["name"]: (r["t"], r["ok"]) for r in df.select("name", files.parsed_text(F.col("name"), F.col("content")).alias("t"), docs.signature_ok(F.col("name"), F.col("content")).alias("ok")).collect()}
    assert out["a.docx"] == ("one\ntwo", True)
    assert out["b.pdf"] == ("Hello (you)\nthere", True)
    assert out["c.txt"] == ("x y\n�", False)
    assert out["d.pdf"][1] is False and out["e.txt"][1] is False and out["f.txt"][0] is None and out["g.docx"] == (None, False)


def test_object_key_and_scope(spark):
    key = docs.object_key(F.lit("A.B.PDF"), F.lit(None).cast("long"), F.lit(7), F.lit(datetime.date(2024, 3, 5)), F.lit("t"))
    assert one(spark, key) == "documents/unknown/7/2024/03/05/t.pdf"
    assert docs._union(7, [1, None, 7]) == [7, 1]


def test_newest_version(spark):
    rows = [(1, "a", datetime.datetime(2024, 1, 1), 1, 1), (1, "b", datetime.datetime(2024, 2, 1), 1, 2), (1, "c", None, 1, 3)]
    df = spark.createDataFrame(rows, "id long, name string, update_time timestamp_ntz, file_size long, status int")
    assert [r["name"] for r in docs.newest(df).collect()] == ["b"]


CHUNK = "document_id long, chunk_index int, content string"


def test_versions_replace_documents(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    make = lambda rows: spark.createDataFrame(rows, CHUNK)
    done = lambda ids, status=1, error=None: spark.createDataFrame([(i, status, error) for i in ids], "document_id long, status int, process_error string")
    now = lambda: sorted((r["document_id"], r["content"]) for r in files.current_chunks(spark, store, CHUNK).collect())
    assert now() == [] and files.current_documents(spark, store).count() == 0
    files.write_version(done([1, 2, 3]), make([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")]), store, 0)
    files.write_version(done([1]), make([(1, 1, "new")]), store, 1)
    files.write_version(done([3], 2, "bad file"), None, store, 2)
    files.write_version(done([2]), make([]), store, 3)  # now without chunks
    assert now() == [(1, "new")]
    files.write_version(done([1]), make([(1, 1, "again")]), store, 1)  # the same batch once more
    assert now() == [(1, "again")]
    assert files.compact(spark, store, CHUNK) == 4 and files.compact(spark, store, CHUNK) == 0
    assert now() == [(1, "again")]
    states = {r["document_id"]: (r["status"], r["process_error"]) for r in files.current_documents(spark, store).collect()}
    assert states == {1: (1, None), 2: (1, None), 3: (2, "bad file")}


def test_failed_documents_have_no_chunks(spark, tmp_path):
    from sievework.streaming import ingest

    store = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, "# T\n\nSome text."), (2, None)], "id long, text string")
    ingest.replace_documents(rows, store, 0)
    assert [r["document_id"] for r in files.current_chunks(spark, store, ingest.CHUNKS).collect()] == [1]

    def broken(_):
        raise RuntimeError("no model")

    ingest.replace_documents(rows.where("id = 1"), store, 1, broken)
    states = {r["document_id"]: (r["status"], r["process_error"]) for r in files.current_documents(spark, store).collect()}
    assert states == {1: (2, "no model"), 2: (1, None)} and files.current_chunks(spark, store, ingest.CHUNKS).count() == 0


def test_objects_are_put_and_deleted(spark, tmp_path):
    base = f"file://{tmp_path}/bucket"
    objects = spark.createDataFrame([("a/k.txt", b"xyz"), ("b.bin", None), (None, b"q")], "key string, content binary")
    assert {r["key"]: r["n"] for r in files.put_objects(objects, base).collect()} == {"a/k.txt": 3, "b.bin": 0}
    read = {r["name"]: bytes(r["content"]) for r in files.read_files(spark, base).select("name", "content").collect()}
    assert read == {"k.txt": b"xyz"}  # readers leave empty files out
    keys = spark.createDataFrame([("a/k.txt",), ("missing",), ("a/k.txt",)], "key string")
    assert {r["key"]: r["n"] for r in files.delete_objects(keys, base).collect()} == {"a/k.txt": 1, "missing": 0}
    assert files.read_files(spark, base).count() == 0 and (tmp_path / "bucket/b.bin").exists()


def test_a_zip_file_that_only_names_the_parts_is_no_docx(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("notes.txt", "[Content_Types].xml word/document.xml")
    rows = [("a.docx", buffer.getvalue()), ("b.docx", b"PK[Content_Types].xml word/document.xml"), ("c.docx", b""), ("d.docx", None)]
    df = spark.createDataFrame(rows, "name string, content binary")
    assert [r[0] for r in df.select(docs.signature_ok(F.col("name"), F.col("content"))).collect()] == [False, False, False, None]
