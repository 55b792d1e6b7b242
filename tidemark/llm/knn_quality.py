"""Text quality by nearest labelled neighbours in a latent-semantic space.

Terms are trigrams of character classes and levels of a text's repetition.
Their weights (square root of the frequency times inverse document frequency)
are projected to the leading singular directions of a labelled sample. Each
document's cosines with all labelled vectors are computed in blocks, exactly; the labels
of its `k` nearest (and of all that tie with the last of them) are averaged with the
similarities as weights.

The space and the labelled vectors come from at most `sample_size` labelled rows
in hash order, so what is broadcast has a fixed bound.

Defined cases: a NULL or empty text has no terms and gets the sample's mean
label; labels that contradict each other for one id are not used; without
labelled rows every score is 0.5; repeated rows give repeated results; texts of any
length are read whole; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.quality_rules import labelled_sample
from tidemark.llm.text_map import map_texts

SAMPLE_SIZE = 5000
RANK = 48
NEIGHBOURS = 15
BLOCK = 512
LEVELS = 8

#: Character classes of bytes, in this order; all others are one more class.
_CLASSES = (b" \t\x0b\x0c\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?", b"!",
            b"|", b"#", b"*", b"$", b"%&", b"<>", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)))
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _i
_N_CLASSES = len(_CLASSES) + 1
N_TERMS = _N_CLASSES ** 3 + 3 * LEVELS


def text_terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text and their square-root frequencies; none for an empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    classes = _CLASS_OF[np.frombuffer(b" " + data + b" ", np.uint8)]
    grams = (classes[:-2] * _N_CLASSES + classes[1:-1]) * _N_CLASSES + classes[2:]
    counts = np.bincount(grams, minlength=N_TERMS).astype(np.float32)
    lines = data.split(b"\n")
    shares = (sum(map(eq, words, words[1:])) / len(words), 1 - len(set(lines)) / len(lines),
              1 - len(set(words)) / len(words))
    values = np.sqrt(counts / len(grams))
    for i, share in enumerate(shares):
        level = min(LEVELS - 1, int(share * LEVELS * 2))
        values[_N_CLASSES ** 3 + i * LEVELS + level] = 0.25
    terms = np.flatnonzero(values)
    return terms, values[terms]


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), N_TERMS), np.float32)
    for i, (terms, values) in enumerate(rows):
        out[i, terms] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass(frozen=True)
class NeighbourModel:
    projection: np.ndarray  # terms to latent directions, with the terms' weights
    vectors: np.ndarray     # one unit vector per labelled row
    labels: np.ndarray
    k: int

    @staticmethod
    def fit(terms: np.ndarray, labels: np.ndarray, rank: int = RANK, k: int = NEIGHBOURS) -> NeighbourModel:
        seen = (terms > 0).sum(axis=0)
        idf = np.where(seen > 0, np.log((1 + len(terms)) / (1 + seen)) + 0.05, 0.0).astype(np.float32)
        used = np.flatnonzero(seen)
        weighted = (terms[:, used] * idf[used]).astype(np.float64)
        _, directions = np.linalg.eigh(weighted.T @ weighted)
        projection = np.zeros((terms.shape[1], min(rank, len(used))), np.float32)
        projection[used] = directions[:, ::-1][:, :rank] * idf[used, None]
        return NeighbourModel(projection, _unit(terms @ projection), labels.astype(np.float32), k)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        found = _unit(terms @ self.projection)
        likeness = found @ self.vectors.T
        k = min(self.k, likeness.shape[1])
        last = np.partition(likeness, likeness.shape[1] - k, axis=1)[:, -k, None]
        weight = np.where(likeness >= last, np.maximum(likeness, 0), 0)
        total = weight.sum(axis=1)
        score = np.divide(weight @ self.labels, total, out=np.full(len(terms), self.labels.mean()), where=total > 0)
        score[~found.any(axis=1)] = self.labels.mean()
        return np.clip(np.round(score.astype(float), 6), 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """One fifth of the ids, and all rows without an id, never taught."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_neighbours(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE_SIZE, id_col: str = "doc_id",
                   text: str = "text", label: str = "quality", **options) -> NeighbourModel:
    chosen = F.broadcast(labelled_sample(labels.filter(~held_out(id_col)), sample_size, id_col, label))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(chosen, "id")

    def start():
        def terms(texts):
            found = [text_terms(t) for t in texts]
            return {"terms": [t.tolist() for t, _ in found], "weights": [w.tolist() for _, w in found]}
        return terms

    known = (map_texts(rows, "id", "text", start, "terms array<int>, weights array<float>").join(chosen, "id")
             .dropDuplicates(["id"]).toPandas().sort_values("id"))
    dense = _dense([(np.asarray(t, np.int64), w) for t, w in zip(known["terms"], known["weights"])])
    return NeighbourModel.fit(dense, known["label"].to_numpy(float), **options)


def quality_scores(docs: DataFrame, model: NeighbourModel, id_col: str = "doc_id", text: str = "text",
                   carry: bool = False) -> DataFrame:
    """`id` and score of every whole text; with `carry` also `row`, the input's columns."""
    # Bounded by the model's sample and rank.
    shared = docs.sparkSession.sparkContext.broadcast((model.projection, model.vectors, model.labels, model.k))

    def start():
        fitted = NeighbourModel(*shared.value)

        def scores(texts):
            blocks = [fitted.scores(_dense([text_terms(t) for t in texts[i:i + BLOCK]]))
                      for i in range(0, len(texts), BLOCK)]
            return {"score": np.concatenate(blocks)}
        return scores

    return map_texts(docs, id_col, text, start, "score double", carry=carry)
