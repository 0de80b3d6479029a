"""Byte-level BPE of whole corpora as a lazily determinised transducer.

The merges of a rank file say for any two tokens whether they may stand side
by side (BPE of their joint bytes gives just them). Of a prefix of a word, the
last token is therefore the longest suffix in the vocabulary that may follow
the last token of what is before it, so one pass over the bytes finds the
tokens, without a queue of merges. What the next step depends on, the bytes and
last tokens of the last W positions (W: longest token that can still match),
is a state; states and their arcs are built when a text first needs them and
shared by all words of a worker. A word's tokens are emitted once the word is
known to have ended, which takes one character of lookahead.

Decoding is streaming as well: bytes go through an incremental UTF-8 state
machine, so a character whose bytes are spread over tokens comes out whole.

Defined results: null and empty texts have an empty list; strings that look
like special tokens are plain text; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public vocabularies, unless the environment names another.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# --- Fixed value: how the vocabulary's authors split text into words -------------
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ---------------------------------------------------------------------------------


class Vocabulary:
    """Tokens of a rank file and which of them may be neighbours; at most `most_pairs` of those are remembered."""

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = 500_000):
        self.rank = ranks
        self.most_pairs = most_pairs
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._beside: dict[tuple[int, int], bool] = {}
        #: proper prefixes of tokens: how long a suffix can still grow into a token
        self.prefixes = {b[:n] for b in ranks for n in range(1, len(b) + 1)}

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, word: bytes) -> list[int]:
        """BPE by its definition: merge the neighbours of lowest rank until none is left. For short words."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(
                ((self.rank.get(a + b, None), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are."""
        known = self._beside.get((left, right))
        if known is None:
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self._beside) >= self.most_pairs:
                self._beside.clear()
            self._beside[left, right] = known
        return known


class _State:
    """What the tokens to come depend on: the last bytes and the last token at each of their positions."""

    __slots__ = ("window", "lasts", "arcs")

    def __init__(self, window: bytes, lasts: tuple):
        self.window = window
        self.lasts = lasts
        self.arcs: dict[int, tuple] = {}


class Transducer:
    """Encodes words; states are built on demand and dropped when there are more than `most_states`."""

    def __init__(self, vocabulary: Vocabulary, most_states: int = 200_000, most_words: int = 200_000):
        self.vocabulary = vocabulary
        self.most_states = most_states
        self.most_words = most_words
        self._known_words: dict[str, list[int]] = {}
        self._reset()

    def _reset(self):
        self._start = _State(b"", (None,))
        self._states: dict[tuple, _State] = {(b"", (None,)): self._start}

    def _arc(self, state: _State, byte: int) -> tuple:
        """(next state, last token) after one more byte."""
        v = self.vocabulary
        window = state.window + bytes((byte,))
        # lasts[i] is the last token of what ends before window[i]; None at a word's start, -1 if out of reach
        token = -1
        for i in range(len(window)):
            before = state.lasts[i]
            if before == -1:
                continue
            t = v.rank.get(window[i:])
            if t is not None and (before is None or v.beside(before, t)):
                token = t
                break
        lasts = (*state.lasts, token)
        # keep the longest suffix that some token continues
        cut = 0
        while cut < len(window) and window[cut:] not in v.prefixes:
            cut += 1
        key = (window[cut:], lasts[cut:])
        following = self._states.get(key)
        if following is None:
            following = self._states[key] = _State(*key)
        return following, token

    def word(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        state, lasts = self._start, []
        for byte in word:
            arc = state.arcs.get(byte)
            if arc is None:
                arc = state.arcs[byte] = self._arc(state, byte)
            state, token = arc
            lasts.append(token)
        if len(self._states) > self.most_states:
            self._reset()
        out, at = [], len(lasts)
        lengths = self.vocabulary.bytes_of
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= len(lengths[token])
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens."""
        if not text:
            return []
        known, out = self._known_words, []
        for w in _word_pattern().findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8", "replace"))
                if len(w) <= 40:
                    if len(known) >= self.most_words:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


class Decoder:
    """Incremental UTF-8: feed bytes, get the characters that are complete."""

    def __init__(self):
        self._value = self._need = self._low = self._high = 0

    def feed(self, data: Iterable[int]) -> str:
        out = []
        for b in data:
            if self._need:
                if self._low <= b <= self._high:
                    self._value = self._value << 6 | b & 0x3F
                    self._low, self._high = 0x80, 0xBF
                    self._need -= 1
                    if not self._need:
                        out.append(chr(self._value))
                    continue
                out.append("�")
                self._need = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self._begin(b & 0x1F, 1, 0x80, 0xBF)
            elif 0xE0 <= b <= 0xEF:
                self._begin(b & 0x0F, 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self._begin(b & 0x07, 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def _begin(self, value, need, low, high):
        self._value, self._need, self._low, self._high = value, need, low, high

    def end(self) -> str:
        """What is left of a character that was cut off."""
        cut, self._need = self._need, 0
        return "�" if cut else ""


@lru_cache(maxsize=1)
def _word_pattern():
    import regex

    return regex.compile(WORD_PATTERN)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """The worker's transducer for the rank file at `path`."""
    return Transducer(Vocabulary.read(path))


def place_of(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARIES, name)


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> Iterator[str]:
    """The text of `ids`, piece by piece."""
    d = Decoder()
    for i in ids:
        yield d.feed(vocabulary.bytes_of[i])
    yield d.end()


def token_ids(text: Column, path: str) -> Column:
    """array<int> of each text's ids."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        encode = transducer(path).encode
        return pd.Series([encode(t) for t in texts], dtype=object)

    return run(text)


def token_count(text: Column, path: str) -> Column:
    """Number of each text's ids."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        encode = transducer(path).encode
        return pd.Series([len(encode(t)) for t in texts], dtype="int64")

    return run(text)


def decoded(text: Column, path: str) -> Column:
    """What decoding the ids of each text gives: the text again, empty for null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        t = transducer(path)
        return pd.Series(["".join(decode(t.encode(x), t.vocabulary)) for x in texts], dtype=object)

    return run(text)
