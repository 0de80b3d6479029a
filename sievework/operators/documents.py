"""Document records: scope, state changes, storage fields, upload checks, deletion."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.config import Upload
from sievework.functions import text as tx

# --- Fixed values ---------------------------------------------------------------
STATUS = {0: "PENDING", 1: "SUCCESS", 2: "FAILED", 3: "PROCESSING"}
CONTENT_TYPES = {
    "pdf": ["application/pdf", "application/octet-stream"],
    "docx": [
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/zip",
        "application/octet-stream",
    ],
    "text": ["text/plain", "text/markdown", "text/x-markdown", "application/octet-stream"],
}
# --------------------------------------------------------------------------------


def _union(one, many) -> list:
    return list(dict.fromkeys(x for x in [one, *(many or [])] if x is not None))


@dataclass(frozen=True)
class Scope:
    """Which documents a question may be answered from; single values and lists add up, nulls are left out."""

    user_id: int | None = None
    knowledge_base_id: int | None = None
    knowledge_base_ids: tuple[int, ...] = ()
    document_id: int | None = None
    document_ids: tuple[int, ...] = ()
    status: int = 1
    type: str | None = None
    types: tuple[str, ...] = ()

    def condition(self) -> Column:
        where = F.col("status") == self.status
        if self.user_id is not None:
            where &= F.col("user_id") == self.user_id
        for column, values in (
            ("knowledge_base_id", _union(self.knowledge_base_id, self.knowledge_base_ids)),
            ("id", _union(self.document_id, self.document_ids)),
            ("type", _union(self.type, self.types)),
        ):
            if values:
                where &= F.col(column).isin(values)
        return where


def newest(documents: DataFrame) -> DataFrame:
    """The newest version of each document (by update time, then file size, then state)."""
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("update_time"), F.desc_nulls_last("file_size"), F.desc_nulls_last("status"))
    return documents.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def in_scope(chunks: DataFrame, documents: DataFrame, scope: Scope) -> DataFrame:
    """Chunks of the documents in scope: filter and project the documents, then a semi join."""
    ids = documents.where(scope.condition()).select(F.col("id").alias("document_id"))
    return chunks.join(ids, "document_id", "left_semi")


def status_name(status: Column) -> Column:
    name = F.lit("UNKNOWN")
    for code, text in STATUS.items():
        name = F.when(status == code, text).otherwise(name)
    return name


def transition(status: Column, action: str) -> Column:
    """The state after a guarded change, null where the change isn't allowed from this state."""
    allowed = {"claim": (0, 3), "retry": (2, 0), "reject": (0, 2), "recover": (3, 0), "finish": (3, 1), "fail": (3, 2)}
    before, after = allowed[action]
    return F.when(status == before, after)


def extension(name: Column) -> Column:
    """The lower-case ending of a file name without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def object_key(name: Column, user_id: Column, base_id: Column, day: Column, token: Column) -> Column:
    """documents/{user}/{base}/{yyyy/MM/dd}/{token}{.ending}; null ids become "unknown"."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    ending = extension(name)
    suffix = F.when(ending != "", F.concat(F.lit("."), ending)).otherwise("")
    path = F.concat_ws("/", F.lit("documents"), known(user_id), known(base_id), F.date_format(day, "yyyy/MM/dd"), token)
    return F.concat(path, suffix)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.length(tx.trim_all(c)) == 0)


def resolved_key(object_key: Column, file_url: Column) -> Column:
    return F.when(_blank(object_key), file_url).otherwise(object_key)


def is_object_storage(storage_type: Column, object_key: Column) -> Column:
    return F.coalesce(F.lower(storage_type) == "minio", F.lit(False)) | ~_blank(object_key)


def backfilled_storage(documents: DataFrame, bucket: str) -> DataFrame:
    """Records whose url is an object key become objects, other urls without a type local files."""
    stored = F.coalesce(F.col("file_url").startswith("documents/"), F.lit(False))
    return documents.withColumns(
        {
            "storage_type": F.when(stored, "MINIO")
            .when(F.col("storage_type").isNull() & (F.col("file_url") != ""), "LOCAL")
            .otherwise(F.col("storage_type")),
            "object_key": F.when(stored, F.col("file_url")).otherwise(F.col("object_key")),
            "bucket_name": F.when(stored, bucket).otherwise(F.col("bucket_name")),
        }
    )


def upload_code(name: Column, size: Column, content_type: Column, config: Upload = Upload()) -> Column:
    """The answer to an upload by its record: 200, 400 (empty, bad name), 413 (too large), 415 (ending, content type)."""
    ending = extension(name)
    plain = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("application/octet-stream")), ";", 1)))
    fits = (
        F.when(ending == "pdf", plain.isin(CONTENT_TYPES["pdf"]))
        .when(ending == "docx", plain.isin(CONTENT_TYPES["docx"]))
        .otherwise(plain.isin(CONTENT_TYPES["text"]))
    )
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, 400)
        .when(size > config.max_bytes, 413)
        .when(_blank(name) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), 400)
        .when(~ending.isin(*config.extensions), 415)
        .when(~fits, 415)
        .otherwise(200)
    )


def _has_docx_parts(content: bytes | None) -> bool | None:
    """Whether the bytes are a ZIP file with the two parts that make it a DOCX file."""
    if content is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return {"[Content_Types].xml", "word/document.xml"} <= set(z.namelist())
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return False


def signature_ok(name: Column, content: Column) -> Column:
    """Whether the bytes are what the ending says: PDF mark, the DOCX parts of a ZIP file, or UTF-8 without NUL."""
    ending = extension(name)

    @F.pandas_udf("boolean")
    def is_docx(contents: pd.Series) -> pd.Series:
        return pd.Series([_has_docx_parts(c) for c in contents], dtype=object)

    docx = is_docx(F.when(ending == "docx", content))
    text = ~F.contains(content, F.unhex(F.lit("00"))) & F.is_valid_utf8(content.cast("string"))
    return F.when(ending == "pdf", F.substring(content, 1, 5) == F.unhex(F.lit("255044462D"))).when(ending == "docx", docx).otherwise(text)


def owner_code(user_id: Column, base_id: Column, owner_id: Column) -> Column:
    """400 for ids that aren't positive, 404 for no such base, 403 for someone else's, else 200."""
    positive = (F.coalesce(user_id, F.lit(0)) > 0) & (F.coalesce(base_id, F.lit(0)) > 0)
    return F.when(~positive, 400).when(owner_id.isNull(), 404).when(owner_id != user_id, 403).otherwise(200)


def delete_code(status: Column) -> Column:
    """409 while a document waits or is being processed, else 200."""
    return F.when(status.isin(0, 3), 409).otherwise(200)


def duplicate_files(documents: DataFrame) -> DataFrame:
    """(knowledge_base_id, file_hash, first_id, n) of files that a base holds more than once."""
    return (
        documents.where("file_hash is not null")
        .groupBy("knowledge_base_id", "file_hash")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
    )


def cascade_delete(documents: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks that stay, and per deleted document the chunks and vectors that go."""
    ids = doomed.select(F.col("id").alias("document_id")).distinct()
    kept_documents = documents.join(ids, documents["id"] == ids["document_id"], "left_anti")
    kept_chunks = chunks.join(ids, "document_id", "left_anti")
    gone = ids.join(chunks, "document_id", "left").groupBy("document_id").agg(
        F.count("id").alias("n_chunks"), F.count("vector_id").alias("n_vectors")
    )
    return kept_documents, kept_chunks, gone
