"""Settings of the operators, as plain values with checks. Model outputs (embeddings, rerank scores, generated text) come as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What requests may hold, from least to most: characters of texts, sizes of numbers.
LIMITS = {"query": (1, 2000), "top_k": (1, 20), "limit": (1, 100), "user_answer": (0, 4000), "conversation_id": (0, 64), "action": (0, 32), "response_time_ms": (0, None)}
#: Of these, what may be missing.
OPTIONAL = ("conversation_id", "action", "response_time_ms")


@dataclass(frozen=True)
class RetrievalConfig:
    """top_k results from at least `candidates` of each ranking; at most as many as requests may ask for."""

    top_k: int = 5
    candidates: int = 20
    k_rrf: int = 60

    def __post_init__(self) -> None:
        least, most = LIMITS["top_k"]
        if not least <= self.top_k <= most:
            raise ValueError(f"top_k must be {least} to {most}")
        if self.candidates < 1 or self.k_rrf < 1:
            raise ValueError("candidates and k_rrf must be positive")

    @property
    def depth(self) -> int:
        """How deep each ranking goes."""
        return max(3 * self.top_k, self.candidates)


def violations(**arguments: tuple[Column, bool]) -> Column:
    """name=(column, whether it is a text) -> array of the names whose values lie outside LIMITS, in the order given."""

    def wrong(name: str, value: Column, text: bool) -> Column:
        least, most = LIMITS[name]
        size = F.length(value) if text else value
        outside = size < least if most is None else (size < least) | (size > most)
        return F.coalesce(outside, F.lit(name not in OPTIONAL))

    found = F.array(*(F.when(wrong(n, c, text), F.lit(n)) for n, (c, text) in arguments.items()))
    return F.filter(found, lambda n: n.isNotNull())
