"""Toxicity by averaged subword embeddings and a linear softmax.

A text is the bag of its words' character n-grams, the ends of words included, each
hashed to one of `BUCKETS` embeddings. The average of the embeddings, with `PADDING` zero
vectors, goes through a linear softmax. Embeddings and softmax are trained together, so that a misspelt word
that no labelled text holds shares most of its vectors with the word that it stands for.

As averaging and the linear layer commute, a gradient step sums the errors of a
batch by bucket first, and a trained model scores texts by one number per bucket
and class.

Training takes at most `SAMPLE` labelled texts of each class, in hash order, and
sees them whole; both classes weigh the same. The softmax's bias is the classes'
shares among all labels that may be learned from; the scale of the scores comes from a
part of the texts and a model that has not seen it. What is broadcast is bounded by the number of buckets.

Defined cases: a text without words (NULL, empty, white space) has no n-grams and
gets the share of toxic labels; labels that contradict each other for one
id are not used; with labels of one class only, or none, every score is
(1 + toxic labels) / (2 + labels); repeated rows give repeated results; long texts are
read piece by piece, to their end; an empty table gives an empty result; other columns
do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.text_map import map_texts

#: Characters of an n-gram.
SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSIONS = 8
#: Labelled texts of each class.
SAMPLE = 1500
#: Gradient steps, however many texts there are.
STEPS = 250
TEXTS_A_STEP = 100
RATE = 0.05
SEED = 42
#: One in so many training texts is kept aside to calibrate the scores.
TEXTS_ASIDE = 5
#: Training texts that an n-gram must be in.
LEAST_TEXTS = 3
#: Zero vectors averaged in, so that few n-grams say little.
PADDING = 100
#: Characters hashed at a time.
PIECE = 1 << 16

_FACTORS = np.random.default_rng(12).integers(1, 1 << 62, max(SIZES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _grams(chars: np.ndarray, starts: int) -> list[np.ndarray]:
    """Buckets of the n-grams that begin at the first `starts` of these characters."""
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars = np.where(space, np.uint64(32), chars.astype(np.uint64))
    spaces_before = np.append(0, np.cumsum(space))
    found, hashes = [], chars * _FACTORS[0]
    for n in range(2, max(SIZES) + 1):
        hashes = hashes[:len(chars) - n + 1] + chars[n - 1:] * _FACTORS[n - 1]
        m = min(starts, len(hashes))
        if n in SIZES and m:
            inner = spaces_before[n - 1:n - 1 + m] == spaces_before[1:1 + m]  # white space at the ends only
            mixed = hashes[:m][inner]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _FACTORS[n % len(_FACTORS)]
            found.append((mixed >> _SHIFT).astype(np.int32))
    return found


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and their parts in its average: square roots of the
    n-grams' counts, so that a word said over and over does not stand for the text."""
    chars = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if len(chars) <= PIECE:
        ids, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *_grams(chars, PIECE)]), return_counts=True)
    else:
        every = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(chars), PIECE):
            every += np.bincount(np.concatenate([np.zeros(0, np.int32), *_grams(
                chars[at:at + PIECE + max(SIZES) - 1], PIECE)]), minlength=BUCKETS)
        ids = np.flatnonzero(every).astype(np.int32)
        counts = every[ids]
    weight = np.sqrt(counts)
    return ids, (weight / (weight.sum() + PADDING)).astype(np.float32)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class _Descent:
    """Gradient descent with momentum, each array's steps scaled by the recent size of its
    whole gradient; within an array, n-grams that matter more move further."""

    def __init__(self, *parameters: np.ndarray, rate: float) -> None:
        self.parameters, self.rate, self.steps = parameters, rate, 0
        self.moments, self.squares = [np.zeros_like(p) for p in parameters], [0.0 for _ in parameters]

    def step(self, *gradients: np.ndarray) -> None:
        self.steps += 1
        for i, (p, g, m) in enumerate(zip(self.parameters, gradients, self.moments)):
            m += 0.1 * (g - m)
            self.squares[i] += 0.02 * (float((g * g).mean()) - self.squares[i])
            size = np.sqrt(self.squares[i] / (1 - 0.98 ** self.steps))
            p -= self.rate * (m / (1 - 0.9 ** self.steps)) / (size + 1e-12)


def _calibration(logits: np.ndarray, filled: np.ndarray, labels: np.ndarray, shares: np.ndarray, pull: float = 0.01):
    """Scale, and what an n-gram of any kind adds to each class, that fit the logits of texts not
    trained on, the classes weighed by `shares`. `filled` is what is no padding of each text: one
    without n-grams keeps the classes' shares. A small pull towards scale 1 keeps both finite."""
    scale, added = 1.0, np.zeros(len(shares))
    weight = (shares / np.bincount(labels, minlength=len(shares)))[labels]
    centred = logits - logits.mean(axis=1, keepdims=True)
    for _ in range(2000):
        error = _softmax(scale * centred + filled[:, None] * added + np.log(shares)) - np.eye(len(shares))[labels]
        error *= weight[:, None]
        scale = max(scale - 0.5 * ((error * centred).sum() / max(1.0, float((centred ** 2).mean()))
                                   + pull * (scale - 1)), 0.01)
        added = added - 0.5 * filled @ error
    return scale, added


@dataclass(frozen=True)
class SubwordModel:
    """What each bucket adds to the classes' scores: its embedding through the linear layer."""

    weights: np.ndarray  # bucket by class
    bias: np.ndarray

    @staticmethod
    def constant(share: float) -> SubwordModel:
        return SubwordModel(np.zeros((BUCKETS, 2)), np.log([1 - share, share]))

    @staticmethod
    def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray,
            seed: int = SEED, **options) -> SubwordModel:
        """`shares` are those of the classes where the model is to be used."""
        order = np.random.default_rng(seed).permutation(len(bags))
        aside = np.sort(order[:len(bags) // TEXTS_ASIDE])
        taught = np.sort(order[len(aside):])
        model = SubwordModel._trained(bags, labels, len(shares), seed, **options)
        if np.unique(labels[aside]).size < len(shares) or np.unique(labels[taught]).size < len(shares):
            return SubwordModel(model.weights, np.log(shares))
        trial = SubwordModel._trained([bags[i] for i in taught], labels[taught], len(shares), seed, **options)
        seen = [bags[i] for i in aside]
        filled = np.array([share.sum() for _, share in seen])
        scale, added = _calibration(trial.logits(seen), filled, labels[aside], shares)
        return SubwordModel(scale * model.weights + added, np.log(shares))

    @staticmethod
    def _trained(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, seed: int,
                 dimensions: int = DIMENSIONS, steps: int = STEPS, rate: float = RATE,
                 least_texts: int = LEAST_TEXTS) -> SubwordModel:
        rng = np.random.default_rng(seed)
        texts_with = np.zeros(BUCKETS, np.int64)
        for ids, _ in bags:
            texts_with[ids] += 1
        used = np.flatnonzero(texts_with >= least_texts)
        place_of = np.full(BUCKETS, -1)
        place_of[used] = np.arange(len(used))
        kept = [place_of[ids] >= 0 for ids, _ in bags]
        ends = np.cumsum([0, *(int(k.sum()) for k in kept)])
        places = np.concatenate([place_of[ids[k]] for (ids, _), k in zip(bags, kept)])
        weight = np.concatenate([share[k] for (_, share), k in zip(bags, kept)])
        vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (len(used), dimensions))
        layer = np.zeros((dimensions, n_classes))
        optimizer = _Descent(vectors, layer, rate=rate)
        balance = len(labels) / n_classes / np.bincount(labels, minlength=n_classes)
        turns = -(-len(bags) // TEXTS_A_STEP)
        for _ in range(-(-steps // turns)):
            for texts in np.array_split(rng.permutation(len(bags)), turns):
                at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in texts])
                owner = np.repeat(np.arange(len(texts)), ends[texts + 1] - ends[texts])
                place, share = places[at], weight[at]
                per_bucket = vectors @ layer
                logits = np.stack([np.bincount(owner, share * per_bucket[place, k], len(texts))
                                   for k in range(n_classes)], axis=1)
                error = (_softmax(logits) - np.eye(n_classes)[labels[texts]]) / len(texts)
                error *= balance[labels[texts], None]
                # Errors by bucket and class; both layers' gradients follow from these.
                met = np.stack([np.bincount(place, share * error[owner, k], len(used))
                                for k in range(n_classes)], axis=1)
                optimizer.step(met @ layer.T, vectors.T @ met)
        weights = np.zeros((BUCKETS, n_classes))
        weights[used] = vectors @ layer
        return SubwordModel(weights, np.zeros(n_classes))

    def logits(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.stack([share @ self.weights[ids] for ids, share in bags]) + self.bias

    def scores(self, texts: list) -> np.ndarray:
        """Probability of the last class, rounded so that equal texts' scores are equal anywhere."""
        return np.round(_softmax(self.logits([bag(text) for text in texts]))[:, -1], 6) if texts else np.zeros(0)


def held_out(id_col: str = "doc_id") -> Column:
    """One quarter of the ids, and all rows without an id, never taught."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text",
                 label: str = "toxic", **options) -> SubwordModel:
    """Learn from at most `sample` labelled texts of each class that are not held out."""
    taught = labels.filter(~held_out(id_col) & F.col(label).isin(0, 1))
    agreed = (taught.groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
              .filter("label = other"))
    counts = {row["label"]: row["count"] for row in agreed.groupBy("label").count().collect()}
    shares = np.array([1 + counts.get(0, 0), 1 + counts.get(1, 0)]) / (2 + sum(counts.values()))
    chosen = [agreed.filter(F.col("label") == k).select("id", "label").orderBy(F.xxhash64("id"), "id").limit(sample)
              for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # bounded by the sample
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(chosen, "id")

    def start():
        return lambda texts: dict(zip(("ids", "shares"), zip(*((ids.tobytes(), share.tobytes())
                                                               for ids, share in map(bag, texts)))))

    known = (map_texts(rows, "id", "text", start, "ids binary, shares binary").join(chosen, "id")
             .dropDuplicates(["id"]).toPandas().sort_values("id"))
    known = known[known["ids"].str.len() > 0]
    if known["label"].nunique() < 2:
        return SubwordModel.constant(shares[1])
    bags = [(np.frombuffer(ids, np.int32), np.frombuffer(share, np.float32))
            for ids, share in zip(known["ids"], known["shares"])]
    return SubwordModel.fit(bags, known["label"].to_numpy(np.int64), shares, **options)


def toxicity_scores(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text: str = "text",
                    carry: bool = False) -> DataFrame:
    """`id` and score of every whole text; with `carry` also `row`, the input's columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # bounded by BUCKETS

    def start():
        fitted = SubwordModel(*shared.value)
        return lambda texts: {"score": fitted.scores(texts)}

    return map_texts(docs, id_col, text, start, "score double", carry=carry)
