import pytest
from pyspark.sql import types as T

WORDS = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "ist")]


def prose(seed: int, n: int) -> list[str]:
    """``n`` words of invented prose, the same for every run."""
    x, out = seed * 2654435761 % 2**31 + 1, []
    for _ in range(n):
        x = x * 1103515245 % 2**31 + 12345
        out.append(WORDS[x // 65536 % len(WORDS)] + WORDS[x // 7 % len(WORDS)])
    return out


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` or longer rows, with columns whose names the operators use themselves."""

    def build(rows):
        schema = T.StructType([T.StructField(n, t) for n, t in (
            ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
            ("size", T.StringType()), ("row", T.StringType()), ("kept", T.StringType()), ("label", T.StringType()), ("__key", T.StringType()))])
        full = [(*r, *[None] * (2 - len(r)), *(r[2:4] if len(r) > 2 else ("en", "s")), "x", "y", "z", "w", "k")[:9] if len(r) == 2
                else (*r, "x", "y", "z", "w", "k") for r in rows]
        return spark.createDataFrame(full, schema)

    return build
