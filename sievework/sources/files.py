"""Files in and out: parsing by ending, object storage, replaceable chunk tables."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.operators.documents import extension

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, content, length, modificationTime) of the files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a DOCX file, None if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for p in root.iter(f"{_W}p"):
        parts = [t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")]
        lines.append("".join(parts))
    return "\n".join(lines)


def pdf_text(content: bytes) -> str | None:
    """Text that a PDF's content streams show with literal strings, None if it isn't a PDF.

    Covers uncompressed and Flate streams with simple encodings; fonts with
    their own encodings need a PDF library, which can be passed to parse().
    """
    if not content.startswith(b"%PDF-"):
        return None
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m.group(1)
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            for show in re.finditer(rb"\((?:\\.|[^\\()])*\)|T\*|Td|TD|'", block):
                token = show.group()
                if token.startswith(b"("):
                    out.append(re.sub(rb"\\([()\\])", rb"\1", token[1:-1]).decode("latin-1"))
                elif out and out[-1] != "\n":
                    out.append("\n")
        out.append("\n")
    return "".join(out)


def parsed_text(name: Column, content: Column, pdf=pdf_text) -> Column:
    """The cleaned text of a file by its ending; everything but PDF and DOCX is UTF-8 text with bad bytes replaced."""

    def batch(function):
        @F.pandas_udf("string")
        def run(contents: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else function(bytes(c)) for c in contents], dtype=object)

        return run

    ending = extension(name)
    plain = F.make_valid_utf8(content.cast("string"))
    other = F.when(ending == "docx", batch(docx_text)(F.when(ending == "docx", content))).when(
        ending == "pdf", batch(pdf)(F.when(ending == "pdf", content))
    )
    return tx.clean(F.when(ending.isin("docx", "pdf"), other).otherwise(plain))


STORE_DOCUMENTS = "document_id bigint, version bigint, status int, process_error string"


def write_version(documents: DataFrame, chunks: DataFrame | None, path: str, version: int) -> None:
    """Append a version of documents (document_id, status, process_error) and of their chunks to a store.

    Nothing stored is read or rewritten, however large the store: the newest
    version of a document counts. A version that is written again (a batch that
    is run again) replaces itself. Documents go last, so chunks of a version
    that failed in between stay unseen.
    """
    if chunks is not None:
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/version={version}")
    documents.select("document_id", "status", "process_error").write.mode("overwrite").parquet(f"{path}/documents/version={version}")


def _stored(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def current_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, version, status, process_error) of each document's newest version."""
    if not _stored(spark, f"{path}/documents"):
        return spark.createDataFrame([], STORE_DOCUMENTS)
    every = spark.read.schema(STORE_DOCUMENTS).parquet(f"{path}/documents")
    newest = F.max_by(F.struct("version", "status", "process_error"), "version").alias("d")
    return every.groupBy("document_id").agg(newest).select("document_id", "d.*")


def current_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The chunks of the documents whose newest version succeeded; schema: DDL of the chunks' columns."""
    if not _stored(spark, f"{path}/chunks"):
        return spark.createDataFrame([], schema)
    every = spark.read.schema(f"{schema}, version bigint").parquet(f"{path}/chunks")
    good = current_documents(spark, path).where("status = 1").select("document_id", "version")
    return every.join(good, ["document_id", "version"], "left_semi").drop("version")


def compact(spark: SparkSession, path: str, schema: str) -> int:
    """Write what is current as one version and drop those before it; the number of dropped versions. For quiet hours."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/documents")
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(int(s.getPath().getName().removeprefix("version=")) for s in files.listStatus(hadoop) if s.isDirectory()) if _stored(spark, f"{path}/documents") else []
    if len(old) < 2:
        return 0
    write_version(current_documents(spark, path), current_chunks(spark, path, schema), path, old[-1] + 1)
    for version in old:
        for part in ("documents", "chunks"):  # documents first: chunks without them are unseen
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/version={version}"), True)
    return len(old)


def _per_object(objects: DataFrame, base: str, schema: str, action) -> DataFrame:
    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            contents = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * len(keys)
            done = [action(system, f"{root.rstrip('/')}/{k}", c) for k, c in zip(keys, contents) if k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k in keys if k], pa.string()), pa.array(done, pa.int64())], names=["key", "n"])

    return objects.mapInArrow(run, schema)


def put_objects(objects: DataFrame, base: str) -> DataFrame:
    """Write rows (key, content) as objects below base, creating folders, where the rows lie: (key, n) with the bytes written.

    Lazy: evaluate it once. Null keys are left out, null contents are empty objects, a key written before is replaced.
    """

    def put(system, path, content):
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(content or b"")
        return len(content or b"")

    return _per_object(objects.select("key", "content"), base, "key string, n bigint", put)


def delete_objects(objects: DataFrame, base: str) -> DataFrame:
    """Delete the objects named by `key` below base where the rows lie: (key, n), n being 1 for those that existed. Lazy."""

    def delete(system, path, _):
        from pyarrow import fs

        if system.get_file_info(path).type != fs.FileType.File:
            return 0
        system.delete_file(path)
        return 1

    return _per_object(objects.select("key").distinct(), base, "key string, n bigint", delete)
