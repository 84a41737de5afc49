"""Parameters with their defaults, checked where they enter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of retrieval and answering; out-of-range values raise ValueError."""

    environment: str = "development"
    embedding_dimension: int = 1536
    embedding_key: str = ""
    model_key: str = ""
    dense_k: int = 20
    lexical_k: int = 20
    hybrid_k: int = 20
    final_n: int = 5
    rrf_k: int = 60
    context_budget: int = 4000
    abstention_threshold: float = 0.1

    def __post_init__(self) -> None:
        if self.embedding_dimension <= 0:
            raise ValueError("the embedding dimension must be positive")
        if self.environment == "production" and not (self.embedding_key and self.model_key):
            raise ValueError("production needs both keys")


def check_request(query: str, top_n: int = 5, top_k: int = 20, rrf_k: int = 60, dense_k: int = 20, lexical_k: int = 20) -> None:
    """Raise ValueError unless the query has text, 1 <= top_n <= 20, 1 <= top_k <= 50 and the others are positive."""
    if not query:
        raise ValueError("the query is empty")
    if not 1 <= top_n <= 20:
        raise ValueError("top_n must be from 1 to 20")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be from 1 to 50")
    if min(rrf_k, dense_k, lexical_k) <= 0:
        raise ValueError("rrf_k and the branch sizes must be positive")


def session(app: str = "lexloom", shuffle_partitions: int | None = None, **options: str) -> SparkSession:
    """A session with what the operators count on: adaptive plans, UTC, Arrow. Partitions follow the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in options.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
