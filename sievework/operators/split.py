"""Splitting documents into chunks: topics, paragraphs, semantic sections, lengths, inherited titles.

The walk along one text is sequential, so it runs in Arrow batches; documents
are independent and nothing is shuffled. Only the semantic boundary compares
paragraphs through embeddings of distinct paragraphs.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.config import Splitting
from sievework.functions import text as tx
from sievework.operators.models import embed_distinct
from sievework.operators.vector import cosine

# --- Fixed values ---------------------------------------------------------------
SENTENCE_ENDS = "。！？.!?"
LENGTH_ENDS = SENTENCE_ENDS + "\n\r"
# --------------------------------------------------------------------------------

_HEADING = re.compile(tx.HEADING)
_ENDS = re.compile(f"[{re.escape(LENGTH_ENDS)}]")
_TRIM = "".join(map(chr, range(0x21)))


def is_topic_boundary(paragraph: str) -> bool:
    """Whether the first line is a heading."""
    return bool(_HEADING.match(paragraph.split("\n", 1)[0].strip(_TRIM)))


def topics(text: str) -> list[str]:
    """Sections that start at heading paragraphs; paragraphs are trimmed and joined by an empty line."""
    sections: list[list[str]] = []
    for p in filter(None, (p.strip(_TRIM) for p in text.split("\n\n"))):
        if not sections or is_topic_boundary(p):
            sections.append([])
        sections[-1].append(p)
    return ["\n\n".join(s) for s in sections]


def lengths(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most `size` characters.

    A chunk ends after the last sentence end in its second half, else at the
    limit. The next one starts at the sentence around the overlap point: after
    the nearest sentence end at most `overlap` before it, else after the next
    one behind it, else right there.
    """
    size = max(1, size)
    overlap = max(0, min(overlap, size - 1))
    ends = [m.end() for m in _ENDS.finditer(text)]

    def last_end(low: int, high: int) -> int | None:
        i = bisect.bisect_right(ends, high)
        return ends[i - 1] if i and ends[i - 1] > low else None

    chunks, start, n = [], 0, len(text)
    while start < n:
        stop = n if start + size >= n else last_end(start + size // 2, start + size) or start + size
        piece = text[start:stop].strip(_TRIM)
        if piece:
            chunks.append(piece)
        if stop == n:
            break
        start = min(_overlap_start(text, ends, last_end, start, stop, overlap), stop)
    return chunks


def _overlap_start(text, ends, last_end, start, stop, overlap) -> int:
    if not overlap:
        return stop
    wanted = max(start, stop - overlap)
    at = last_end(max(start, wanted - overlap), wanted)
    if at is None:
        i = bisect.bisect_right(ends, wanted)
        if i == len(ends) or ends[i] > stop:
            return wanted
        at = ends[i]
    while at < stop and text[at].isspace():
        at += 1
    return at


def with_title(section: str, chunks: list[str]) -> list[str]:
    """Chunks of a section below its heading, unless they start with it."""
    title = section.split("\n", 1)[0].strip(_TRIM)
    if not _HEADING.match(title):
        return chunks
    has = lambda c: c == title or c.startswith((title + "\n", title + "\r"))
    return [c if has(c) else f"{title}\n\n{c}" for c in chunks]


def rule_chunks(text: str | None, config: Splitting = Splitting()) -> list[str]:
    """Topics, then lengths, then titles, of a cleaned text; none for null and blank ones."""
    if not text:
        return []
    return [c for s in topics(text) for c in with_title(s, lengths(s, config.chunk_size, config.overlap))]


def line_paragraphs(text: str | None) -> list[str]:
    """Lines between blank ones joined, headings on their own."""
    raw: list[str] = []
    open_lines: list[str] = []

    def close():
        if open_lines:
            raw.append("\n".join(open_lines))
            open_lines.clear()

    for line in (l.strip(_TRIM) for l in (text or "").split("\n")):
        if line and not is_topic_boundary(line):
            open_lines.append(line)
            continue
        close()
        if line:
            raw.append(line)
    close()
    return raw


def paragraphs(text: str | None, config: Splitting = Splitting()) -> list[str]:
    """Headings on their own, long paragraphs cut at sentence ends, short ones merged."""
    raw = line_paragraphs(text)
    merged: list[str] = []
    buffer = ""
    for p in (q for r in raw for q in _cut_long(r, config)):
        if is_topic_boundary(p):
            merged += [buffer, p]
            buffer = ""
            continue
        buffer = f"{buffer}\n{p}" if buffer else p
        if len(buffer) >= config.min_paragraph:
            merged.append(buffer)
            buffer = ""
    return [p for p in (m.strip(_TRIM) for m in [*merged, buffer]) if p]


def _cut_long(paragraph: str, config: Splitting) -> list[str]:
    if len(paragraph) <= config.max_paragraph or is_topic_boundary(paragraph):
        return [paragraph]
    out, start = [], 0
    for m in re.finditer(f"[{re.escape(SENTENCE_ENDS)}]", paragraph):
        if m.end() - start >= config.min_paragraph:
            out.append(paragraph[start : m.end()].strip(_TRIM))
            start = m.end()
    rest = paragraph[start:].strip(_TRIM)
    return [*out, rest] if rest else out


def _per_text(function: Callable[[str | None], list[str]]):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([function(t) for t in texts], dtype=object)

    return run


def split_by_rules(text: Column, config: Splitting = Splitting()) -> Column:
    """array<string> of rule_chunks()."""
    return _per_text(lambda t: rule_chunks(t, config))(tx.clean(text))


def topic_sections(text: Column) -> Column:
    """array<string> of topics() of the cleaned text; none for null."""
    return _per_text(lambda t: topics(t) if t else [])(tx.clean(text))


def raw_paragraphs(text: Column) -> Column:
    """array<string> of line_paragraphs() of the cleaned text."""
    return _per_text(line_paragraphs)(tx.clean(text))


def titled(section: Column, chunk: Column) -> Column:
    """The chunk below its section's heading, as with_title() but in expressions."""

    def below(title: Column) -> Column:
        has = (chunk == title) | F.startswith(chunk, F.concat(title, F.lit("\n"))) | F.startswith(chunk, F.concat(title, F.lit("\r")))
        return F.when(tx.is_heading(title) & ~has, F.concat(title, F.lit("\n\n"), chunk)).otherwise(chunk)

    return tx.let(tx.first_line(section), below)


def semantic_chunks(
    df: DataFrame, key: str, text: str, embed: Callable[[Column], Column], config: Splitting = Splitting()
) -> DataFrame:
    """(key, chunk_no, chunk): sections end where neighbouring paragraphs differ or a heading starts.

    embed gives the vector of a paragraph column. Distinct paragraphs are
    embedded once; the order within a document is restored by its own window.
    """
    listed = df.select(key, F.posexplode(_per_text(lambda t: paragraphs(t, config))(tx.clean(F.col(text)))).alias("n", "p"))
    order = Window.partitionBy(key).orderBy("n")
    seq = embed_distinct(listed, "p", embed, "v").withColumn("heading", tx.is_heading(tx.first_line(F.col("p"))))
    previous = F.lag("v").over(order)
    far = previous.isNotNull() & ~F.lag("heading").over(order) & (cosine(previous, F.col("v")) < config.similarity_threshold)
    # headings need no embedding to start a section
    starts = F.col("heading") | F.coalesce(far, F.lit(False))
    seq = seq.withColumn("starts", starts.cast("int"))
    seq = seq.withColumn("section", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("n", "p")))
    sections = seq.groupBy(key, "section").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("s"))
    cut = _per_text(lambda s: with_title(s, lengths(s, config.chunk_size, config.overlap)))
    pieces = sections.select(key, "section", F.posexplode(cut(F.col("s"))).alias("i", "chunk"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("section", "i"))
    return pieces.select(key, number.alias("chunk_no"), "chunk")
