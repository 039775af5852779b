"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled document in Spark tasks, into hashed buckets by language; only
the table of languages times ``BUCKETS`` counts reaches the driver, becomes a matrix of log probabilities and
is broadcast. Its size is bounded: ``BUCKETS`` times at most ``MOST_LANGUAGES`` 32-bit numbers; more languages
raise an error. Scoring takes a batch of texts as sparse rows of bucket ids and adds up the matrix rows that
they name.

The score is the posterior with log-likelihoods divided by the root of the number of n-grams, as neighbouring
n-grams are not independent. Null texts and texts without a letter give ``und`` and score 0, also when
nothing could be learned. Labels that are null teach nothing. Repeated rows are counted and predicted as
often as they occur; ties go to the first language by name; an empty table gives an empty result; further
columns stay (``lang_pred`` and ``score`` are replaced). Whole texts are read, in slices of ``SLICE`` code
points, so a very long one does not need more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 512
SLICE = 1 << 18
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _slices(text: str) -> Iterator[np.ndarray]:
    """Bucket ids of all n-grams, each once, slice by slice."""
    longest = max(ORDERS)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(codes), SLICE):
        part = codes[at : at + SLICE + longest - 1].astype(np.uint32)
        ids = []
        hashed = np.zeros(len(part), np.uint32)
        for k in range(longest):
            hashed = (hashed[: len(part) - k] ^ part[k:]) * np.uint32(0x9E3779B1)
            if k + 1 in ORDERS:
                # The overlap with the next slice counts there.
                own = hashed[:SLICE]
                mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                ids.append((mixed >> np.uint32(13)) & np.uint32(BUCKETS - 1))
        yield np.concatenate(ids)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for ids in _slices(text):
                own += np.bincount(ids, minlength=BUCKETS)
        if len(counts) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    for lang, own in counts.items():
        used = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": own[used]})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name, and the matrix of log probabilities (a row per bucket, a column per language)."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).dropna()
    counts = (
        rows.mapInPandas(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    # At most MOST_LANGUAGES * BUCKETS small rows, however large the corpus.
    table = counts.toPandas()
    languages = sorted(table["lang"].unique())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    seen = np.ones((BUCKETS, max(1, len(languages))))
    if languages:
        seen[table["bucket"], table["lang"].map({name: k for k, name in enumerate(languages)})] += table["n"]
    return languages, np.log(seen / seen.sum(axis=0)).astype(np.float32)


def _has_letter(text: str) -> bool:
    """Numerals such as ``²`` or ``Ⅷ`` are word characters, but no letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def classify(text: str | None, languages: list[str], matrix: np.ndarray) -> tuple[str, float]:
    if not languages or text is None or not _has_letter(text):
        return UNKNOWN, 0.0
    total, n = np.zeros(len(languages)), 0
    for ids in _slices(text):
        total += matrix[ids].sum(axis=0, dtype=np.float64)
        n += len(ids)
    weights = np.exp((total - total.max()) / np.sqrt(n))
    best = int(weights.argmax())
    return languages[best], float(weights[best] / weights.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text column goes to Python."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        languages, matrix = shared.value
        return pd.DataFrame([classify(t, languages, matrix) for t in texts], columns=["lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    return docs.withColumn("__langid", scored(F.col(f"`{text}`"))).select(*[f"`{c}`" for c in docs.columns], "__langid.*")
