"""Toxicity (2): subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (three to five, with marks at both ends) and itself, each hashed to a row of an
embedding table. A document is the average of its words' vectors and goes into a linear softmax over the two labels. Table and
softmax are trained jointly in numpy by AdaGrad on the cross entropy. A misspelt word that was never seen shares most of its
n-grams with the right one and so lands near it. A token of more than ``LONG`` characters is no word but a text without blanks or a chain
of words: it is cut at its punctuation, and what is still longer is read in stretches that overlap, so that each of
its n-grams is counted and each stretch weighs as a word.

As everything after the table is linear up to the softmax, one number per table row is all that scoring
needs: the part the row adds to the log odds. Scoring is one pass over whole texts without a shuffle.

Defined results: a null or empty text gets the score of the constant alone; if the labels to learn from hold one class only,
or none, the score is their smoothed share; a document labelled twice counts as toxic if one label says so; repeated rows
are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlog.llm.bpe import Table
from slotlog.llm.common import fetched, held_out, id_text, labelled_sample, per_document

ROWS = 1 << 17
#: Averages are small numbers when one word in fifty tells the label; a fixed factor brings them to the order of one.
SCALE = 100.0
#: Tokens of more characters are cut. A stretch of one starts every ``STRETCH`` characters and has the four after them as well.
LONG = 40
STRETCH = 20
#: Marks that join words to a chain; those that stand for letters of a masked word (*, @, #, %, ! and ') do not.
JOINTS = regex.compile(r"[[\p{P}<>=+|~]--[*@#%!']]+", regex.V1)


def words_of(text: str) -> list[str]:
    """The words of a whole text. A stretch of a longer token starts with a line feed, which no word has."""
    words = text.split()
    if not words or max(map(len, words)) <= LONG:
        return words
    out = []
    for word in words:
        if len(word) <= LONG:
            out.append(word)
            continue
        for run in JOINTS.split(word.lower()):
            if len(run) > LONG:
                padded = f"<{run}>"
                out.extend("\n" + padded[i:i + STRETCH + 4] for i in range(0, len(padded) - 4, STRETCH))
            elif run:
                out.append(run)
    return out


def subwords(token: str) -> list[int]:
    """Table rows of a word of a text: itself and its n-grams, in lower case without the marks around it; of a stretch its n-grams."""
    if token.startswith("\n"):
        parts = {token[i:i + n] for n in (3, 4, 5) for i in range(1, len(token) - n + 1)}
        return [crc32(p.encode("utf-8", "surrogatepass")) % ROWS for p in parts]
    word = token.lower().strip(".,;:!?\"'()[]{}*#$%&|-_")
    if not word:
        return []
    padded = f"<{word}>"
    parts = {padded[i:i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)} | {padded}
    return [crc32(p.encode("utf-8", "surrogatepass")) % ROWS for p in parts]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # what each table row adds to the log odds
    constant: float


def word_rows() -> Table:
    return Table(lambda w: np.array(subwords(w), np.int32), most=80_000)


def bag(text: str, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of a whole text, each once, and their weights in its average."""
    words = words_of(text)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    bags = [(table[w], n) for w, n in counts.items()]
    bags = [(b, n) for b, n in bags if len(b)]
    if not bags:
        return np.zeros(1, np.int32), np.zeros(1, np.float32)
    ids = np.concatenate([b for b, _ in bags])
    sizes = np.array([len(b) for b, _ in bags])
    part = np.repeat(np.array([n for _, n in bags]) / sizes * (SCALE / len(words)), sizes)
    uniq, inverse = np.unique(ids, return_inverse=True)
    return uniq.astype(np.int32), np.bincount(inverse, part).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, **settings) -> Model:
    """Embeddings and softmax from whole texts and 0/1 labels."""
    table = word_rows()
    return fit([bag(t, table) for t in texts], labels, **settings)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 0.15, min_docs: int = 3,
        seed: int = 7) -> Model:
    """Embeddings and softmax from the ``bag`` of each text and 0/1 labels. The list of bags is used up, so that it is not held twice."""
    labels = np.asarray(labels, np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(ROWS, np.float32), prior)
    # Rows of very few documents can't be told from noise; they add nothing, nor do rows that no document has.
    spread = sum(np.bincount(r, minlength=ROWS) for r, _ in bags) >= min_docs
    rows, weights = [], []
    for i, (r, w) in enumerate(bags):
        rows.append(np.append(r[spread[r]], np.int32(0)))
        weights.append(np.append(w[spread[r]], np.float32(0)))
        bags[i] = None
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (ROWS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    seen_e, seen_s, seen_b = np.full((ROWS, 1), 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    size = 32
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            batch = order[at:at + size]
            ids = np.concatenate([rows[i] for i in batch])
            w = np.concatenate([weights[i] for i in batch])[:, None]
            starts = np.cumsum([0, *(len(rows[i]) for i in batch[:-1])])
            x = np.add.reduceat(emb[ids] * w, starts, axis=0)
            z = x @ soft + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            gx = np.repeat(p @ soft.T, np.diff(np.append(starts, len(ids))), axis=0) * w
            gs, gb = x.T @ p + 1e-4 * soft, p.sum(axis=0)
            seen_s += gs**2
            seen_b += gb**2
            soft -= rate * gs / np.sqrt(seen_s)
            bias -= rate * gb / np.sqrt(seen_b)
            uniq, inverse = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(inverse, gx[:, d]) for d in range(dim)], axis=1).astype(np.float32)
            seen_e[uniq] += (g**2).mean(axis=1, keepdims=True)
            emb[uniq] -= rate * g / np.sqrt(seen_e[uniq])
    return Model((emb @ (soft[:, 1] - soft[:, 0]) * SCALE * spread).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model):
        weights, self.constant = model.weights.tolist(), model.constant
        self.words = Table(lambda w: sum(weights[i] for i in ids) / len(ids) if (ids := subwords(w)) else 0.0)

    def score(self, text: str) -> float:
        words = words_of(text)
        odds = self.constant + (sum(map(self.words.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 12_000) -> Model:
    """Model from at most about ``max_rows`` labelled rows that are not held out, chosen by a hash of their id.

    Tasks turn each text into its bag, so no text comes to the driver.
    """

    def make():
        table = word_rows()

        def work(texts: list[str]):
            found = [bag(t, table) for t in texts]
            return [r.tobytes() for r, _ in found], [w.tobytes() for _, w in found]

        return work

    sample = labelled_sample(docs, labels, label_col, max_rows)
    rows = fetched(per_document(sample, "rows binary, weights binary", make, keep=("doc_id", "label")), "toxicity-bags")
    classes = np.array([y for _, y, _, _ in rows])
    bags = [(np.frombuffer(r, np.int32), np.frombuffer(w, np.float32)) for _, _, r, w in rows]
    del rows
    return fit(bags, classes)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (probability of the label) and predicted of every row."""

    def make():
        scorer = Scorer(model)

        def work(texts: list[str]):
            found = [scorer.score(t) for t in texts]
            return found, np.array([int(s >= threshold) for s in found], np.int32)

        return work

    plain = id_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    return per_document(plain, "score double, predicted int", make, keep=("doc_id", "held_out"))
