from __future__ import annotations

import random
import re
import zlib

DOC = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII = str.maketrans(UPPER, UPPER.lower())


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, blanks only, repeated rows, an id with two texts."""
    long = prose(1, 30_000)
    return [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 3), (4, long, "en", "a", len(long)), (None, prose(2, 40), None, None, None),
        (None, prose(2, 40), None, None, None), (5, prose(3, 50), "fr", "b", 1), (5, prose(3, 50), "fr", "b", 1), (5, prose(4, 60), "fr", "b", 1), (6, "one", "de", "", 3),
    ]


def frame(spark, rows, schema: str = DOC):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """Extra columns that bear names used inside the operators."""
    from pyspark.sql import functions as F

    for name in ("size", "target", "rank", "key", "did", "th", "c", "shard", "slot", "_th", "words", "n", "class", "weight", "kept_text"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))


def remainder(doc_id, folds: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds
