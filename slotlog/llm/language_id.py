"""Language ID (10): rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words padded by a mark) of
a language in order of frequency. A document's own list is compared with each profile by the out-of-place distance: for each of
its n-grams the difference of the two places, or the length of the profile where it is not in there. The nearest language is
taken. An n-gram is packed into one integer of 21 bits a letter, so lists are made by sorting arrays.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or when nothing could be learned; equally near
languages: the first by name; n-grams of equal frequency in a document share one place; repeated rows are judged each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotlog.llm.common import held_out, id_text, keep_texts, per_document, sampled, slices

if TYPE_CHECKING:  # a worker that reads texts only does without it
    import pandas as pd

PROFILE = 300
MARK = ord("_")


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Packed n-grams of one to three letters over the whole text, in lower case; marks stand between words."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[a]
    if not is_letter.any():
        return np.empty(0, np.int64)
    before = np.empty_like(is_letter)
    before[0], before[1:] = False, is_letter[:-1]
    a = np.where(is_letter, a, MARK)[is_letter | before].astype(np.int64)  # one mark after each word
    a = np.concatenate([[MARK], a] if a[-1] == MARK else [[MARK], a, [MARK]])
    two = a[:-1] << 21 | a[1:]
    three = two[:-1] << 21 | a[2:]
    return np.concatenate([a[a != MARK], two, three])


def ranked(codes: np.ndarray, most: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams whose place is below ``most``, with their places: the number of n-grams that are more frequent."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(starts, len(codes)))
    by_count = np.cumsum(np.bincount(counts)[::-1])[::-1]  # n-grams at least as frequent
    place = np.append(by_count, 0)[counts + 1]
    kept = place < most
    return codes[starts[kept]], place[kept]


class Profiles:
    """Languages in order of name, all their n-grams in order, and each n-gram's place in each language."""

    def __init__(self, profiles: pd.DataFrame, most: int = PROFILE):
        self.languages = sorted(profiles["lang"].unique())
        self.codes = np.unique(profiles["gram"].to_numpy(np.int64)) if len(profiles) else np.empty(0, np.int64)
        self.most = most
        self.places = np.full((len(self.codes), len(self.languages)), -1, np.int32)
        if len(profiles):
            column = profiles["lang"].map({x: i for i, x in enumerate(self.languages)}).to_numpy()
            self.places[np.searchsorted(self.codes, profiles["gram"]), column] = profiles["place"]

    def predict(self, text: str) -> tuple[str, float]:
        codes = grams(text)
        if not len(codes) or not self.languages:
            return "und", 0.0
        own, place = ranked(codes, self.most)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == own
        theirs = self.places[at[known]]
        far = np.where(theirs < 0, self.most, np.abs(theirs - place[known][:, None]))
        total = far.sum(axis=0) + self.most * (len(own) - known.sum())
        best = int(np.argmin(total))
        return self.languages[best], float(1 - total[best] / (self.most * len(own)))


def learn(docs: DataFrame, lang_col: str = "lang", max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """Profiles (lang, gram, place) from rows that are not held out and have a language.

    ``max_rows`` bounds the labelled rows that are learned from, chosen by a hash of their id. Each task counts its
    rows per language and only the sums are shuffled. What comes back has PROFILE rows per language.
    """
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    plain = sampled(plain.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))), max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):  # a character makes three numbers, which are sorted
                found: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found.setdefault(lang, []).append(grams(text))
                for lang, codes in found.items():
                    gram, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())],
                                                     names=["lang", "gram", "n"])

    counts = plain.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counts.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < PROFILE)
            .select("lang", "gram", "place").toPandas())


def predict(docs: DataFrame, profiles: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (1 for a distance of nought, 0 for the greatest) of every row."""
    model = Profiles(profiles)

    def make():
        def work(texts: list[str]):
            found = [model.predict(t) for t in texts]
            return [f[0] for f in found], [f[1] for f in found]

        return work

    plain = id_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    return per_document(plain, "lang_pred string, score double", make, keep=("doc_id", "held_out"))


def keep(docs: DataFrame, profiles: pd.DataFrame, min_score: float = 0.2, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language with a score of at least ``min_score``."""
    model = Profiles(profiles)

    def accepted(texts: list[str]) -> list[bool]:
        found = [model.predict(t) for t in texts]
        return [lang != "und" and score >= min_score for lang, score in found]

    return keep_texts(docs, accepted, text_col)
