"""Search requests: validation and the split into tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed import (
    DEFAULT_SIZE,
    INVALID_SIZE,
    INVALID_SIZE_MESSAGE,
    MAX_SIZE,
    MIN_SIZE,
    QUERY_REQUIRED,
    QUERY_REQUIRED_MESSAGE,
)
from shelfmark.functions.parsing import clean_text
from shelfmark.functions.text import TOKEN, tokens


def judge_requests(requests: DataFrame) -> DataFrame:
    """(query_id, query, size, code, message): code and message are null for valid requests.

    The query is trimmed, a missing size becomes the default, and a blank query is
    reported before a bad size.
    """
    size = F.coalesce("size", F.lit(DEFAULT_SIZE))
    code = F.when(clean_text("query") == "", QUERY_REQUIRED).when(
        ~size.between(MIN_SIZE, MAX_SIZE), INVALID_SIZE
    )
    judged = requests.select("query_id", clean_text("query").alias("query"), size.alias("size"), code.alias("code"))
    message = F.when(F.col("code") == QUERY_REQUIRED, QUERY_REQUIRED_MESSAGE).when(
        F.col("code") == INVALID_SIZE, INVALID_SIZE_MESSAGE
    )
    return judged.withColumn("message", message)


def valid_requests(requests: DataFrame) -> DataFrame:
    return judge_requests(requests).where("code IS NULL").select("query_id", "query", "size")


def refused_requests(requests: DataFrame) -> DataFrame:
    return judge_requests(requests).where("code IS NOT NULL").select("query_id", "code", "message")


def query_tokens(requests: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(query_id, qpos, n, qterm) for (query_id, text)."""
    words = requests.select("query_id", tokens("text", pattern).alias("w"))
    return words.select("query_id", F.size("w").alias("n"), F.posexplode("w").alias("qpos", "qterm"))
