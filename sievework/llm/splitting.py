"""Cut oversized texts at natural boundaries, with overlap.

Separators form a hierarchy: section, paragraph, line, sentence, word,
character. A span above the limit less the overlap is cut at the coarsest
separators it has and what is still too long at the next finer ones; the spans
are then packed greedily up to the limit, and each piece but the first repeats
the end of the one before, from the first word boundary within the overlap.

Pieces are slices of the text: without their overlaps they make up the text
again, character by character.

Defined results: null and empty texts have no pieces; a text within the limit
is one piece; a word above the limit is cut between characters, in steps that
leave room for the whole overlap, and marks the text as forced; a word that fits
the limit is never cut for the overlap's sake, so only before one longer than
limit - overlap less is repeated; where the overlap lies inside one word, a
piece that starts at a boundary repeats nothing. Lengths count code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- Fixed values ---------------------------------------------------------------
#: Characters after which a word ends.
BOUNDARIES = " \t\n\r　。！？"
# --------------------------------------------------------------------------------

#: Where a new span may start, coarsest first.
LEVELS = [
    re.compile(r"\n(?=(?:#{1,6} |={2,6} ?\S|\\(?:chapter|section|subsection)\b|<h[1-6][ >]|第[^\s章节]{1,12}[章节]))"),
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\r?\n"),
    re.compile(r"[.!?…][\"'”’»)\]]*[ \t　]+|[。！？][”’」』）]*"),
]
_WORDS = re.compile(f"[^{BOUNDARIES}]+[{BOUNDARIES}]?|[{BOUNDARIES}]")


@dataclass(frozen=True)
class Limits:
    limit: int = 800
    overlap: int = 100


def spans(text: str, limit: int, overlap: int = 0) -> tuple[list[tuple[int, int]], bool]:
    """Consecutive spans, and whether a cut between characters was needed.

    Spans have at most limit - overlap characters, single words up to `limit`.
    """
    step = max(1, limit - overlap)
    out: list[tuple[int, int]] = []
    forced = False
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= step:
            if b > a:
                out.append((a, b))
            continue
        if level < len(LEVELS):
            cuts = [m.end() for m in LEVELS[level].finditer(text, a, b) if a < m.end() < b]
            edges = [a, *cuts, b]
            todo.extend((s, e, level + 1) for s, e in reversed(list(zip(edges, edges[1:]))))
            continue
        for m in _WORDS.finditer(text, a, b):
            s, e = m.span()
            if e - s > limit and text[e - 1] in BOUNDARIES:
                e -= 1
            if e - s > limit:
                forced = True
                out.extend((i, min(i + step, e)) for i in range(s, e, step))
            elif s < e:
                out.append((s, e))
            if e < m.end():
                out.append((e, m.end()))
    return out, forced


def split(text: str | None, limits: Limits = Limits()) -> tuple[list[tuple[int, int, int]], bool]:
    """((start, new, end) of each piece, forced): text[start:end] is the piece, text[start:new] its overlap."""
    if not text:
        return [], False
    if len(text) <= limits.limit:
        return [(0, 0, len(text))], False
    units, forced = spans(text, limits.limit, limits.overlap)
    pieces = []
    start = new = end = 0
    for s, e in units:
        if e - start > limits.limit:
            pieces.append((start, new, end))
            room = min(limits.overlap, limits.limit - (e - s), s - start)
            new = s
            start = s - room
            if room:
                at = start
                while at < s and (at == 0 or text[at - 1] not in BOUNDARIES):
                    at += 1
                if at < s:
                    start = at
                elif text[s - 1] in BOUNDARIES:  # the last word is longer than the overlap
                    start = s
        end = e
    pieces.append((start, new, end))
    return pieces, forced


def split_text(text: Column, limits: Limits = Limits()) -> Column:
    """struct(pieces array<struct<piece, overlap>>, forced) of each text, in Arrow batches."""

    @F.pandas_udf("pieces array<struct<piece:string,overlap:int>>, forced boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        pieces, flags = [], []
        for t in texts:
            found, forced = split(t, limits)
            pieces.append([{"piece": t[a:b], "overlap": n - a} for a, n, b in found])
            flags.append(forced)
        return pd.DataFrame({"pieces": pieces, "forced": flags})

    return run(text)


def oversized(df: DataFrame, text: str, limits: Limits = Limits()) -> DataFrame:
    """Rows above the limit with `split`, the struct of split_text()."""
    return df.where(F.char_length(text) > limits.limit).withColumn("split", split_text(F.col(text), limits))


def numbered_pieces(cut_rows: DataFrame, place: list[str], key: str) -> DataFrame:
    """One row per piece, numbered from 1 within `place`; rows of one place follow each other by key."""
    rows = cut_rows.select(*place, key, F.posexplode("split.pieces").alias("_n", "_p"))
    order = Window.partitionBy(*place).orderBy(key, "_n")
    return rows.select(
        *place, key, F.row_number().over(order).alias("piece_no"), F.col("_p.piece").alias("piece"), F.col("_p.overlap").alias("overlap")
    )
