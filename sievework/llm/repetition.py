"""Repetition inside a single document.

Tokeniser fertility first: a public vocabulary with byte fallback gives, of the
document's words, characters per token, the share of byte-fallback tokens and the entropy of the
tokens, which are compared with rejection bands of the text's own script; they
tell broken or monotonous text but not which part of it is repeated. They do
bound it: every character of a repeated word lies in a token that occurs twice,
so the entropy that the document's words lose against all tokens being
different, weighted by characters (`entropy_loss`), is at least the repeated
share in bits. Documents below the bound need no further look. For the others
passages decide: the document's words without case, digits, punctuation and
spacing, in passages of five words or ten Chinese characters; a passage that
stood before marks its words, and the share is the marked characters among all
characters of words.

Words are tokenised one by one and remembered, in a memory of a bounded number
of words, so a text costs little more than finding its words.

Defined results: null, empty and wordless texts have share 0; without tokens
there are no characters per token and the entropy is 0; a document shorter than
one passage has share 0; texts under 64 tokens are within every band. Memory of
a text grows with its length only; documents are never compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.tokenizer import place_of

PIECES = "piece_bpe_32k.model"
#: Units of a passage: a word weighs two, a Chinese character one.
PASSAGE = 10
#: Share of repeated text from which a document is rejected.
REPEATED = 0.4
# --- Fixed values: rejection bands by script (lowest and highest characters per
# token, highest byte-fallback share, lowest entropy per token in bits)
BANDS = {
    "latin": (1.5, 8.0, 0.05, 3.5),
    "han": (0.3, 2.5, 0.75, 3.5),
    "other": (0.3, 8.0, 0.75, 3.0),
}
# --------------------------------------------------------------------------------

#: Tokens from which a text has to lie within the bands.
LEAST_TOKENS = 64
#: Words whose tokens a worker remembers, and the longest of them.
MOST_WORDS, LONGEST_WORD = 200_000, 40

_IDEOGRAPH = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_ASCII_WORD = re.compile("[a-z]+")
_LATIN = re.compile("[A-Za-zªºÀ-ÖØ-öø-ɏ]")
_UNIT = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]|[^\\W\\d_぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+")


@lru_cache(maxsize=1)
def _unseen():
    import regex

    return regex.compile(r"[\p{Cf}\p{Mn}\p{Cc}&&[^\s]]+|(?<=\p{L})[\p{Cf}]+(?=\p{L})", regex.V1)


def units_of(text: str) -> list[str]:
    """The words and Chinese characters of a text, without what doesn't count."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    if not text.isprintable():
        text = _unseen().sub("", text)
    return _UNIT.findall(text.lower())


def _is_ideograph(unit: str) -> bool:
    return len(unit) == 1 and unit > "⿿"


def repeated_share(text: str | None) -> float:
    """Share of the words' characters in passages that stood earlier in the text."""
    return share_of(units_of(text)) if text else 0.0


def share_of(units: list[str]) -> float:
    """The share among given words and Chinese characters."""
    joined = "".join(units)
    if not joined:
        return 0.0
    n = len(units)
    if joined.isascii() or not _IDEOGRAPH.search(joined):
        spans = _even_spans(units, PASSAGE // 2)
    elif n == len(joined) and not _IDEOGRAPH.sub("", joined):
        spans = _even_spans(units, PASSAGE)
    else:
        spans = _uneven_spans(units)
    covered = bytearray(n)
    for start, end in spans:
        covered[start:end] = b"\1" * (end - start)
    return sum(len(u) for u, c in zip(units, covered) if c) / len(joined)


def _even_spans(units: list[str], width: int) -> list[tuple[int, int]]:
    """Passages of `width` units that stood before."""
    passages = list(zip(*(units[i:] for i in range(width))))
    if len(set(passages)) == len(passages):
        return []
    seen: set[tuple[str, ...]] = set()
    spans = []
    for at, passage in enumerate(passages):
        if passage in seen:
            spans.append((at, at + width))
        else:
            seen.add(passage)
    return spans


def _uneven_spans(units: list[str]) -> list[tuple[int, int]]:
    """Passages that stood before, in a mix of words and Chinese characters."""
    weight = [1 if _is_ideograph(u) else 2 for u in units]
    seen: set[tuple[str, ...]] = set()
    spans = []
    end = load = 0
    for start in range(len(units)):
        while end < len(units) and load < PASSAGE:
            load += weight[end]
            end += 1
        if load < PASSAGE:
            break
        passage = tuple(units[start:end])
        if passage in seen:
            spans.append((start, end))
        else:
            seen.add(passage)
        load -= weight[start]
    return spans


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    fallback = frozenset(i for i in range(model.get_piece_size()) if model.is_byte(i))
    return model, fallback


@lru_cache(maxsize=2)
def _remembered(path: str) -> dict[str, list[int]]:
    return {}


def token_counts(words: Iterable[str], path: str) -> Counter[int]:
    """How often each token occurs in the words, each tokenised on its own."""
    model, _ = _pieces(path)
    known = _remembered(path)
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        ids = known.get(word)
        if ids is None:
            ids = model.encode(word, num_threads=1)
            if len(word) <= LONGEST_WORD:
                if len(known) >= MOST_WORDS:
                    known.clear()
                known[word] = ids
        for i in ids:
            counts[i] += n
    return counts


def fertility(words: list[str], path: str) -> tuple[float, float | None, float, float, int]:
    """(entropy loss, characters per token, share of byte-fallback tokens, token entropy in bits, tokens) of the words.

    The entropy loss is what the tokens fall short of all being different, in bits per character.
    """
    sizes, (_, fallback) = _piece_sizes(path), _pieces(path)
    chars = n = from_bytes = 0
    loss = spent = 0.0
    for i, c in token_counts(words, path).items():
        n += c
        chars += sizes[i] * c
        if i in fallback:
            from_bytes += c
        if c > 1:
            bits = c * math.log2(c)
            spent += bits
            loss += sizes[i] * bits
    if not n:
        return 0.0, None, 0.0, 0.0, 0
    return loss / chars if chars else 0.0, sum(map(len, words)) / n, from_bytes / n, math.log2(n) - spent / n + 0.0, n


@lru_cache(maxsize=2)
def _piece_sizes(path: str) -> list[int]:
    """Characters of each piece without its blank mark; a fallback byte counts as one."""
    model, fallback = _pieces(path)
    return [1 if i in fallback else len(model.id_to_piece(i).replace("▁", "")) for i in range(model.get_piece_size())]


def script_of(units: list[str]) -> str:
    """latin, han or other: what most of the words' characters are."""
    joined = "".join(units)
    if joined.isascii():
        return "latin"
    if len(_IDEOGRAPH.sub("", joined)) * 2 < len(joined):
        return "han"
    return "latin" if len(_LATIN.sub("", joined)) * 2 < len(joined) else "other"


def in_band(measures: Sequence, script: str) -> bool:
    """Whether the measures lie within the script's bands; texts under LEAST_TOKENS tokens always do."""
    per_token, bytes_share, entropy, n = measures
    if n < LEAST_TOKENS:
        return True
    low, high, most_bytes, least_entropy = BANDS[script]
    return low <= per_token <= high and bytes_share <= most_bytes and entropy >= least_entropy


_MEASURES = {
    "entropy_loss": "double", "repeated_share": "double", "chars_per_token": "double", "byte_share": "double",
    "token_entropy": "double", "n_tokens": "bigint", "script": "string", "in_band": "boolean",
}


def measures_of(text: Column, path: str, least: float = 0.0) -> Column:
    """struct of _MEASURES of each text. repeated_share is 0 where the tokens' bound is below `least`."""

    @F.pandas_udf(", ".join(f"{c} {t}" for c, t in _MEASURES.items()))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            units = units_of(t) if t else []
            (bound, *m), script = fertility(units, path), script_of(units)
            rows.append((bound, share_of(units) if bound >= least else 0.0, *m, script, in_band(m, script)))
        return pd.DataFrame(rows, columns=list(_MEASURES))

    return run(text)


def repetition(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, repeated_share, fertility measures, script, in_band) of each document; narrow, no shuffle."""
    found = df.select(key, measures_of(F.col(text), path or place_of(PIECES)).alias("m"))
    return found.select(key, "m.*")


def repeated_documents(df: DataFrame, key: str, text: str, least: float = REPEATED, path: str | None = None) -> DataFrame:
    """The rows of repetition() of the documents whose repeated share is at least `least`.

    The tokens' bound comes first, passages are compared only where it allows
    the share; as it is never below the share, no document is missed.
    """
    found = df.select(key, measures_of(F.col(text), path or place_of(PIECES), least).alias("m")).select(key, "m.*")
    return found.where(F.col("repeated_share") >= least)
