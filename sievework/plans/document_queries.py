"""Queries over document records and chunks: sources, filters, deduplication, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.config import Dedup
from sievework.functions import text as tx
from sievework.operators import dedup, documents, split, vector, vector_index
from sievework.plans import sql as q
from sievework.session import spread
from sievework.sources import files
from sievework.sources.tables import delivered_once, table


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return delivered_once(table(spark, sf_dir, "document_chunk"), *columns)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.newest(table(spark, sf_dir, "document"))


def s02_parse_text(spark, d):
    """Text and Markdown bytes with cleaning."""
    rows = table(spark, d, "documents").where("text is not null")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return rows.select("doc_id", F.sha2(files.parsed_text(name, F.col("text").cast("binary")), 256).alias("text_hash"))


def s05_clean_text(spark, d):
    return chunks(spark, d, "content").select("id", F.sha2(tx.clean(F.col("content")), 256).alias("clean_hash"))


def s09_object_key(spark, d):
    key = documents.object_key(F.col("name"), F.col("user_id"), F.col("knowledge_base_id"), F.col("create_time"), F.substring("file_hash", 1, 32))
    return docs(spark, d).where("file_hash is not null and create_time is not null").select("id", key.alias("object_key"))


def s10_document_list(spark, d):
    """All documents with their names and types, one row per id."""
    return docs(spark, d).select("id", "name", "type", "knowledge_base_id", "status")


def s11_scan(spark, d):
    """Chunks and characters per document in one parallel scan."""
    rows = chunks(spark, d, "document_id", "content")
    return rows.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


def s12_chunk_index(spark, d):
    """Chunk numbers from 1 in each document after deduplication."""
    kept = dedup.exact(chunks(spark, d, "document_id", "content", "chunk_index"), ["chunk_index", "id"]).where("kept")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "id"))
    return kept.select("id", "document_id", n.alias("new_index"))


def s14_index_delete(spark, d):
    """Vector rows that stay when failed documents are deleted from the index."""
    failed = docs(spark, d).where("status = 2").select(F.col("id").alias("document_id"))
    rows = chunks(spark, d, "document_id", "vector_id").where("vector_id is not null")
    return rows.join(failed, "document_id", "left_anti").select("id", "document_id")


def s15_vector_sizes(spark, d):
    """Vectors by size, for the check against the configured size."""
    rows = chunks(spark, d, "vector_id").select(vector.parse(F.col("vector_id")).alias("v")).where("v is not null and size(v) > 0")
    return rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))


def s14_upsert(spark, d):
    """The index after the vectors of finished documents were written again, doubled."""
    v = vector.parse(F.col("vector_id"))
    stored = chunks(spark, d, "document_id", "vector_id").select("id", "document_id", v.alias("vector")).where("vector is not null and size(vector) > 0")
    done = docs(spark, d).where("status = 1").select(F.col("id").alias("document_id"))
    fresh = stored.join(done, "document_id", "left_semi").withColumn("vector", F.transform("vector", lambda x: x * 2))
    return vector_index.upsert(stored, fresh).select("id", "document_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def s15_collection_check(spark, d):
    """Sizes of the stored vectors and how they differ from the configured size."""
    sizes = s15_vector_sizes(spark, d)
    return sizes.select("dim", "n", vector_index.collection_check(F.col("dim"), 32).alias("error"))


def s16_prefix_delete(spark, d):
    """Keys that stay when those below a prefix are deleted."""
    rows = docs(spark, d).where("object_key is not null")
    return rows.where(~F.col("object_key").startswith("kb/7/")).select("id", "object_key")


def s18_cascade_delete(spark, d):
    doomed = docs(spark, d).where(documents.delete_code(F.col("status")) == 200).where("status = 2")
    return documents.cascade_delete(docs(spark, d), chunks(spark, d, "document_id", "vector_id"), doomed)[2]


def s19_hash_backfill(spark, d):
    """Missing content hashes from the blank-trimmed text."""
    rows = chunks(spark, d, "content", "content_hash").where("content_hash is null or content_hash = ''")
    return rows.select("id", F.sha2(F.trim("content"), 256).alias("content_hash"))


def s19_storage_backfill(spark, d):
    return documents.backfilled_storage(docs(spark, d), "kbfiles").select("id", "storage_type", "object_key", "bucket_name")


def s20_json(spark, d):
    rows = chunks(spark, d, "document_id", "chunk_index").where("document_id is not null and chunk_index is not null")
    cell = F.struct(F.col("document_id").alias("documentId"), F.col("chunk_index").alias("chunkIndex"))
    return rows.select("id", F.to_json(F.array(cell)).alias("golden"))


def s21_upload_check(spark, d):
    code = documents.upload_code(F.col("name"), F.col("file_size"), F.col("content_type"))
    return docs(spark, d).select("id", code.alias("code"))


def s21_signature(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    content = F.col("text").cast("binary")
    ok = lambda n: documents.signature_ok(F.lit(n), content).cast("int")
    return rows.select("doc_id", ok("x.txt").alias("as_text"), ok("x.pdf").alias("as_pdf"))


def s22_duplicate_files(spark, d):
    return documents.duplicate_files(docs(spark, d))


def s23_storage(spark, d):
    key = documents.resolved_key(F.col("object_key"), F.col("file_url"))
    remote = documents.is_object_storage(F.col("storage_type"), F.col("object_key")).cast("int")
    return docs(spark, d).select("id", key.alias("key"), remote.alias("is_object"))


def f01_scope_filter(spark, d):
    scope = documents.Scope(knowledge_base_id=7, knowledge_base_ids=(1, 7, 12))
    return documents.in_scope(chunks(spark, d, "document_id"), docs(spark, d), scope).select("id", "document_id")


def f02_parameter_union(spark, d):
    rows = docs(spark, d)
    ids = F.array_distinct(F.array_compact(F.array("knowledge_base_id", "user_id", "knowledge_base_id")))
    return rows.select("id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


def f05_keyword_prefilter(spark, d):
    words = ["snapshot", "缓存", "retriever", "filtro"]
    hit = F.lit(False)
    for w in words:
        hit |= F.contains(F.lower("content"), F.lit(w))
    return chunks(spark, d, "content").where(hit).select("id")


def f08_vector_fit(spark, d):
    """Chunks whose vector can be read and has 32 components."""
    v = vector.parse(F.col("vector_id"))
    return chunks(spark, d, "vector_id").where(v.isNotNull() & (F.size(v) == 32)).select("id")


def f11_unfinished(spark, d):
    return docs(spark, d).where("status in (0, 3)").select("id", "status")


def f12_transitions(spark, d):
    rows = docs(spark, d)
    return rows.select("id", *[documents.transition(F.col("status"), a).alias(a) for a in ("claim", "retry", "reject", "recover")])


def f13_status_name(spark, d):
    return docs(spark, d).select("id", documents.status_name(F.col("status")).alias("status_name"))


def f14_access(spark, d):
    """Answer codes for access by the base's owner list and for deletion."""
    bases = table(spark, d, "knowledge_base").select(F.col("id").alias("knowledge_base_id"), F.col("user_id").alias("owner_id"))
    rows = docs(spark, d).join(bases, "knowledge_base_id", "left")
    code = documents.owner_code(F.col("user_id"), F.col("knowledge_base_id"), F.col("owner_id"))
    return rows.select("id", code.alias("access_code"), documents.delete_code(F.col("status")).alias("delete_code"))


def c01_heading(spark, d):
    return chunks(spark, d, "content").select("id", tx.is_heading(tx.first_line(F.col("content"))).cast("int").alias("is_heading"))


def c02_topics(spark, d):
    """Topic sections of every document."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(split.topic_sections(F.col("text"))).alias("pos", "section"))
    return rows.select("doc_id", "pos", F.sha2("section", 256).alias("section_hash"))


def c05_titles(spark, d):
    """The last line of every chunk below the title that its first line may be."""
    text = tx.clean(F.col("content"))
    last = tx.trim_all(F.substring_index(text, "\n", -1))
    rows = chunks(spark, d, "content").where("content is not null")
    return rows.select("id", F.sha2(split.titled(text, last), 256).alias("titled_hash"))


def c07_paragraphs(spark, d):
    """Paragraphs of every document before long ones are cut and short ones merged."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(split.raw_paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return rows.select("doc_id", "pos", F.sha2("paragraph", 256).alias("paragraph_hash"))


def c06_rule_split(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.posexplode(split.split_by_rules(F.col("text"))).alias("pos", "chunk"))


def c11_semantic_split(spark, d):
    return split.semantic_chunks(table(spark, d, "documents"), "doc_id", "text", vector.hashed_embedding)


def d01_content_hash(spark, d):
    return chunks(spark, d, "content").select("id", dedup.content_hash(F.col("content")).alias("hash"))


def d02_exact_dedup(spark, d):
    out = dedup.exact(chunks(spark, d, "document_id", "content", "chunk_index"), ["chunk_index", "id"], Dedup(body_hash=False))
    return out.select("id", F.col("kept").cast("int").alias("kept"))


def d03_body_dedup(spark, d):
    out = dedup.exact(chunks(spark, d, "document_id", "content", "chunk_index"), ["chunk_index", "id"])
    return out.select("id", "body_hash", F.col("kept").cast("int").alias("kept"))


def _classes(spark, d):
    """Classes of the chunks as delivered: copies of a row are dropped on the way, without moving the texts for it."""
    return dedup.body_classes(spread(table(spark, d, "document_chunk").select("id", "document_id", "content")))


def d05_similar_pairs(spark, d):
    pairs = dedup.similar_pairs(None, classes=_classes(spark, d))
    return pairs.select("document_id", "a", "b", F.round("jaccard", 6).alias("jaccard"))


def d05_classes(spark, d):
    """Every chunk with the first chunk of its document that has the same shingles."""
    return _classes(spark, d).select("document_id", "id", "rep")


def d05_greedy(spark, d):
    classes = _classes(spark, d)
    return dedup.greedy_kept(dedup.similar_pairs(None, classes=classes), classes).where("document_id is not null")


def d06_embedding_reuse(spark, d):
    return dedup.reusable(chunks(spark, d, "document_id", "content", "vector_id"), docs(spark, d))


def a11_dedup_counts(spark, d):
    out = dedup.exact(chunks(spark, d, "document_id", "content", "chunk_index"), ["chunk_index", "id"])
    kept = F.count_if("kept")
    return out.groupBy("document_id").agg(F.count("*").alias("n"), kept.alias("n_kept"), (F.count("*") - kept).alias("n_removed"))


QUERIES = {
    f.__name__: f
    for f in (
        s02_parse_text, s05_clean_text, s09_object_key, s10_document_list, s11_scan, s12_chunk_index, s14_index_delete,
        s15_vector_sizes, s16_prefix_delete, s18_cascade_delete, s19_hash_backfill, s19_storage_backfill, s20_json,
        s21_upload_check, s21_signature, s22_duplicate_files, s23_storage, f01_scope_filter, f02_parameter_union,
        f05_keyword_prefilter, f08_vector_fit, f11_unfinished, f12_transitions, f13_status_name, f14_access, c01_heading,
        c02_topics, c05_titles, c07_paragraphs, s14_upsert, s15_collection_check, c06_rule_split, c11_semantic_split, d01_content_hash, d02_exact_dedup, d03_body_dedup, d05_similar_pairs,
        d05_classes, d05_greedy, d06_embedding_reuse, a11_dedup_counts,
    )
}

_BODY_LINES = f"list_transform(string_split({q.cleaned('content')}, chr(10)), lambda l: {q.trimmed('l')})"
_BODY = q.cleaned(
    "array_to_string(list_filter(ls, lambda l, i: i <> coalesce(list_position(list_transform(ls, lambda h: "
    + q.heading("h")
    + "), true), 0)), chr(10))"
)
_DEDUP = f"""with {q.CHUNKS},
base as (select *, {q.cleaned('content')} as c, {_BODY_LINES} as ls from chunks where length({q.trimmed("coalesce(content, '')")}) > 0),
bodies as (select *, {_BODY} as b, sha256(c) as hash, length(c) < 30 as short from base),
hashed as (select *, case when length(b) < 30 then '' else sha256(b) end as body_hash from bodies),
marked as (select *,
  row_number() over (partition by document_id, hash, short order by chunk_index nulls first, id) = 1 as first,
  row_number() over (partition by document_id, body_hash, short order by chunk_index nulls first, id) = 1 as body_first from hashed),
kept as (select *, short or (first and (body_hash = '' or body_first)) as kept from marked)
"""
_SIMILAR = (
    _DEDUP
    + rf""", compact as (select id, document_id, regexp_replace(b, '{q.BLANK}', '', 'g') as s from bodies),
grams as (select distinct id, document_id, unnest(case when length(s) < 5 then [s] else list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5)) end) as g
  from compact where length(s) > 0),
sizes as (select id, count(*) as n from grams group by id),
classes as (select document_id, id, min(id) over (partition by document_id, gs) as rep from (select document_id, id, list_sort(list(g)) as gs from grams group by document_id, id)),
shared as (select x.document_id, x.id as a, y.id as b, count(*) as m from grams x join grams y on x.document_id = y.document_id and x.g = y.g and x.id < y.id group by 1, 2, 3),
similar_pairs as (select document_id, a, b, round(m / (p.n + r.n - m), 6) as jaccard from shared join sizes p on p.id = a join sizes r on r.id = b where m / (p.n + r.n - m) >= 0.9)
"""
)
_VECTOR = """vectors as (select id, list_transform(list_filter(list_transform(string_split(vector_id, ','), lambda x: trim(x)), lambda x: length(x) > 0),
  lambda x: try_cast(x as double)) as v from chunks),
parsed as (select id, v from vectors where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null)) = 0)"""
_EXT = r"lower(regexp_extract(name, '\.([^.]+)$', 1))"

ORACLE = {
    "s02_parse_text": f"select doc_id, sha256({q.cleaned('text')}) as text_hash from documents where text is not null",
    "s05_clean_text": f"with {q.CHUNKS} select id, sha256({q.cleaned('content')}) as clean_hash from chunks",
    "s09_object_key": f"""with {q.DOCS} select id, 'documents/' || coalesce(user_id::varchar, 'unknown') || '/' ||
  coalesce(knowledge_base_id::varchar, 'unknown') || '/' || strftime(create_time, '%Y/%m/%d') || '/' || substr(file_hash, 1, 32) ||
  case when {_EXT} <> '' then '.' || {_EXT} else '' end as object_key from docs where file_hash is not null and create_time is not null""",
    "s10_document_list": f"with {q.DOCS} select id, name, type, knowledge_base_id, status from docs",
    "s11_scan": f"with {q.CHUNKS} select document_id, count(*) as n_chunks, sum(length(content))::bigint as n_chars from chunks group by document_id",
    "s12_chunk_index": _DEDUP
    + "select id, document_id, row_number() over (partition by document_id order by chunk_index nulls first, id) as new_index from kept where kept",
    "s14_index_delete": f"""with {q.CHUNKS}, {q.DOCS} select id, document_id from chunks where vector_id is not null
  and (document_id is null or document_id not in (select id from docs where status = 2))""",
    "s15_vector_sizes": f"with {q.CHUNKS}, {_VECTOR} select len(v) as dim, count(*) as n from parsed group by 1",
    "s14_upsert": f"""with {q.CHUNKS}, {q.DOCS}, {_VECTOR} select c.id, c.document_id, round(v[1] * case when d.id is null then 1 else 2 end, 6) as first
  from parsed join chunks c using (id) left join docs d on d.id = c.document_id and d.status = 1""",
    "s15_collection_check": f"""with {q.CHUNKS}, {_VECTOR} select len(v) as dim, count(*) as n,
  case when len(v) <> 32 then 'vector size mismatch: configured=32, actual=' || len(v) end as error from parsed group by 1""",
    "c02_topics": f"""with parts as (select doc_id, unnest(list_filter(list_transform(string_split({q.cleaned('text')}, chr(10) || chr(10)), lambda p: {q.trimmed('p')}), lambda p: length(p) > 0)) as p,
    generate_subscripts(list_filter(list_transform(string_split({q.cleaned('text')}, chr(10) || chr(10)), lambda p: {q.trimmed('p')}), lambda p: length(p) > 0), 1) as i
  from documents where text is not null),
marked as (select *, sum(case when i = 1 or {q.heading(q.trimmed("string_split(p, chr(10))[1]"))} then 1 else 0 end) over (partition by doc_id order by i) as section from parts)
select doc_id, (section - 1)::int as pos, sha256(string_agg(p, chr(10) || chr(10) order by i)) as section_hash from marked group by doc_id, section""",
    "c05_titles": f"""with {q.CHUNKS}, t as (select id, {q.cleaned('content')} as t from chunks where content is not null),
l as (select id, {q.trimmed('string_split(t, chr(10))[1]')} as title, {q.trimmed('string_split(t, chr(10))[-1]')} as last from t)
select id, sha256(case when {q.heading('title')} and last <> title then title || chr(10) || chr(10) || last else last end) as titled_hash from l""",
    "c07_paragraphs": f"""with split as (select doc_id, list_transform(string_split({q.cleaned('text')}, chr(10)), lambda l: {q.trimmed('l')}) as ls from documents where text is not null),
lines as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as i from split),
kinds as (select *, case when l = '' then 0 when {q.heading('l')} then 1 else 2 end as kind from lines),
breaks as (select *, case when kind = 2 and lag(kind) over (partition by doc_id order by i) = 2 then 0 else 1 end as starts from kinds),
islands as (select *, sum(starts) over (partition by doc_id order by i) as island from breaks),
joined as (select doc_id, island, string_agg(l, chr(10) order by i) as paragraph from islands where kind > 0 group by doc_id, island)
select doc_id, (row_number() over (partition by doc_id order by island) - 1)::int as pos, sha256(paragraph) as paragraph_hash from joined""",
    "s16_prefix_delete": f"with {q.DOCS} select id, object_key from docs where object_key not like 'kb/7/%'",
    "s18_cascade_delete": f"""with {q.CHUNKS}, {q.DOCS} select docs.id as document_id, count(chunks.id) as n_chunks, count(vector_id) as n_vectors
  from docs left join chunks on chunks.document_id = docs.id where status = 2 group by docs.id""",
    "s19_hash_backfill": f"with {q.CHUNKS} select id, sha256(trim(content, ' ')) as content_hash from chunks where content_hash is null or content_hash = ''",
    "s19_storage_backfill": f"""with {q.DOCS} select id,
  case when file_url like 'documents/%' then 'MINIO' when storage_type is null and file_url <> '' then 'LOCAL' else storage_type end as storage_type,
  case when file_url like 'documents/%' then file_url else object_key end as object_key,
  case when file_url like 'documents/%' then 'kbfiles' else bucket_name end as bucket_name from docs""",
    "s20_json": f"""with {q.CHUNKS} select id, '[{{"documentId":' || document_id || ',"chunkIndex":' || chunk_index || '}}]' as golden
  from chunks where document_id is not null and chunk_index is not null""",
    "s21_upload_check": f"""with {q.DOCS}, e as (select *, {_EXT} as ext,
  lower(trim(string_split(coalesce(content_type, 'application/octet-stream'), ';')[1])) as plain from docs)
select id, case when coalesce(file_size, 0) <= 0 then 400 when file_size > 52428800 then 413
  when name is null or trim(name) = '' or contains(name, '/') or contains(name, chr(92)) then 400
  when ext not in ('txt', 'md', 'docx', 'pdf') then 415
  when ext = 'pdf' and plain not in ('application/pdf', 'application/octet-stream') then 415
  when ext = 'docx' and plain not in ('application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/zip', 'application/octet-stream') then 415
  when ext in ('txt', 'md') and plain not in ('text/plain', 'text/markdown', 'text/x-markdown', 'application/octet-stream') then 415
  else 200 end as code from e""",
    "s21_signature": """select doc_id, case when contains(text, chr(0)) then 0 else 1 end as as_text,
  case when starts_with(text, '%PDF-') then 1 else 0 end as as_pdf from documents where text is not null""",
    "s22_duplicate_files": f"""with {q.DOCS} select knowledge_base_id, file_hash, min(id) as first_id, count(*) as n from docs
  where file_hash is not null group by 1, 2 having count(*) > 1""",
    "s23_storage": f"""with {q.DOCS} select id, case when object_key is null or {q.trimmed('object_key')} = '' then file_url else object_key end as key,
  case when lower(coalesce(storage_type, '')) = 'minio' or {q.trimmed("coalesce(object_key, '')")} <> '' then 1 else 0 end as is_object from docs""",
    "f01_scope_filter": f"""with {q.CHUNKS}, {q.DOCS} select id, document_id from chunks
  where document_id in (select id from docs where status = 1 and knowledge_base_id in (7, 1, 12))""",
    "f02_parameter_union": f"""with {q.DOCS} select id, concat_ws(',', knowledge_base_id, case when user_id <> knowledge_base_id or knowledge_base_id is null
  then user_id end) as ids from docs""",
    "f05_keyword_prefilter": f"""with {q.CHUNKS} select id from chunks where contains(lower(content), 'snapshot') or contains(lower(content), '缓存')
  or contains(lower(content), 'retriever') or contains(lower(content), 'filtro')""",
    "f08_vector_fit": f"with {q.CHUNKS}, {_VECTOR} select id from parsed where len(v) = 32",
    "f11_unfinished": f"with {q.DOCS} select id, status from docs where status in (0, 3)",
    "f12_transitions": f"""with {q.DOCS} select id, case when status = 0 then 3 end as claim, case when status = 2 then 0 end as retry,
  case when status = 0 then 2 end as reject, case when status = 3 then 0 end as recover from docs""",
    "f13_status_name": f"""with {q.DOCS} select id, case status when 0 then 'PENDING' when 1 then 'SUCCESS' when 2 then 'FAILED' when 3 then 'PROCESSING'
  else 'UNKNOWN' end as status_name from docs""",
    "f14_access": f"""with {q.DOCS} select docs.id, case when not (coalesce(docs.user_id, 0) > 0 and coalesce(knowledge_base_id, 0) > 0) then 400
  when k.user_id is null then 404 when k.user_id <> docs.user_id then 403 else 200 end as access_code,
  case when status in (0, 3) then 409 else 200 end as delete_code
  from docs left join knowledge_base k on k.id = docs.knowledge_base_id""",
    "c01_heading": f"""with {q.CHUNKS} select id, {q.heading(q.trimmed('string_split(content, chr(10))[1]'))}::int as is_heading from chunks""",
    "d01_content_hash": f"with {q.CHUNKS} select id, case when content is null then '' else sha256({q.cleaned('content')}) end as hash from chunks",
    "d02_exact_dedup": _DEDUP + "select id, (short or first)::int as kept from kept",
    "d03_body_dedup": _DEDUP + "select id, body_hash, kept::int as kept from kept",
    "d05_classes": _SIMILAR + "select document_id, id, rep from classes",
    "d05_similar_pairs": _SIMILAR
    + "select p.document_id, a, b, jaccard from similar_pairs p join classes x on x.id = a and x.rep = a join classes y on y.id = b and y.rep = b",
    "d05_greedy": _SIMILAR
    + """, earlier as (select document_id, b, list(a) as before from similar_pairs group by document_id, b),
runs as (select document_id, list_reduce(list({'b': b, 'before': before, 'gone': []::bigint[]} order by b),
  lambda x, y: {'b': y.b, 'before': y.before, 'gone': case when len(list_filter(y.before, lambda a: not list_contains(x.gone, a))) > 0 then list_append(x.gone, y.b) else x.gone end},
  {'b': 0::bigint, 'before': []::bigint[], 'gone': []::bigint[]}) as r from earlier group by document_id)
select document_id, unnest(r.gone) as id from runs""",
    "d06_embedding_reuse": f"""with {q.CHUNKS}, {q.DOCS},
keyed as (select c.id, c.document_id, d.knowledge_base_id, d.status, sha256({q.cleaned('content')}) as hash, vector_id from chunks c join docs d on d.id = c.document_id
  where length({q.trimmed('content')}) >= 30)
select k.id, min(s.id) as source_id from keyed k join keyed s on s.knowledge_base_id = k.knowledge_base_id and s.hash = k.hash and s.document_id <> k.document_id
  and s.status = 1 and length(coalesce(s.vector_id, '')) > 0 group by k.id""",
    "a11_dedup_counts": _DEDUP
    + "select document_id, count(*) as n, count(*) filter (kept) as n_kept, count(*) filter (not kept) as n_removed from kept group by document_id",
}
