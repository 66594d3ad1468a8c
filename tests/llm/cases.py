"""Helpers of these tests."""

from pyspark.sql import functions as F

WORDS = [f"w{i * 7919 % 997}x{i % 13}" for i in range(400)]


def prose(start: int, n: int = 80) -> str:
    return " ".join(WORDS[(start * 31 + i * (start % 7 + 1)) % 400] for i in range(n))


def clashing(docs, names):
    """``docs`` with extra columns of the given names."""
    return docs.withColumns({n: F.lit("clash") for n in names}).withColumn("extra", F.col("doc_id"))
