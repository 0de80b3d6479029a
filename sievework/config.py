"""Parameters that change results, with the values in force."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    vector_top_k: int = 50
    keyword_top_k: int = 50
    hybrid_top_k: int = 80
    final_top_k: int = 3
    min_final_score: float = 0.2
    vector_weight: float = 0.6
    keyword_weight: float = 0.4

    def weights(self) -> tuple[float, float]:
        """Invalid weights (negative or summing to nothing) fall back to 0.6 and 0.4."""
        v, k = self.vector_weight, self.keyword_weight
        return (v, k) if v >= 0 and k >= 0 and v + k > 0 else (0.6, 0.4)


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    average_length: float = 500.0
    phrase_boost: float = 0.5
    title_boost: float = 0.3

    def checked(self) -> Bm25:
        """Values out of range fall back to the defaults."""
        d = Bm25()
        return Bm25(
            self.k1 if self.k1 > 0 else d.k1,
            self.b if 0 <= self.b <= 1 else d.b,
            self.average_length if self.average_length > 0 else d.average_length,
            self.phrase_boost if self.phrase_boost >= 0 else d.phrase_boost,
            self.title_boost if self.title_boost >= 0 else d.title_boost,
        )


@dataclass(frozen=True)
class Splitting:
    semantic: bool = True
    similarity_threshold: float = 0.65
    chunk_size: int = 500
    overlap: int = 100
    min_paragraph: int = 80
    max_paragraph: int = 500


@dataclass(frozen=True)
class Dedup:
    body_hash: bool = True
    near_duplicates: bool = False
    threshold: float = 0.9
    shingle_size: int = 5
    min_length: int = 30


@dataclass(frozen=True)
class Compression:
    enabled: bool = False
    max_sentences: int = 4
    max_chars: int = 800
    fallback_chars: int = 200
    min_keyword_length: int = 2


@dataclass(frozen=True)
class Rewrite:
    enabled: bool = True
    expand_keywords: bool = True
    max_expanded: int = 8
    max_growth: int = 3


@dataclass(frozen=True)
class Upload:
    max_bytes: int = 50 * 1024 * 1024
    extensions: tuple[str, ...] = ("txt", "md", "docx", "pdf")
