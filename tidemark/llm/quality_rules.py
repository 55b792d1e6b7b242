"""Learned decision lists over statistics of a text.

Sequential covering: a rule for low quality grows on two thirds of the labelled
rows, one threshold at a time by information gain, is pruned from its end on the
last third, and what it covers is set aside before the next rule grows. The list
comes out as one ordered Spark conditional expression.

The rules are learned from at most `sample_size` labelled rows, taken in hash
order; statistics are computed over every whole text.

Defined cases: a NULL or empty text has zero in every statistic and fails the
base rule for its length; labels that contradict each other for one id are not
used; without labels of both kinds the list is empty and keeps everything;
repeated rows give repeated results; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.text_map import map_texts

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims",
              "n_bars", "n_adjacent", "n_distinct", "n_lines")
#: What rules may test: a name and its SQL over the statistics.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "adjacent_share": "n_adjacent / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
}


def repeated_words(words: list) -> int:
    """Words in windows of WINDOW words that occur twice or more, overlapping ones once."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    covered, ones = bytearray(len(words)), b"\x01" * WINDOW
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            covered[i:i + WINDOW] = ones
            covered[j:j + WINDOW] = ones
    return sum(covered)


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The values of STATISTICS."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at ASCII white space only
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(data.translate(None, _NOT_UPPER)),
            text.count("!"), text.count("|"), sum(map(eq, words, words[1:])), len(set(words)), len(lines))


def statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` and STATISTICS of every whole text."""
    def start():
        return lambda texts: dict(zip(STATISTICS, zip(*map(text_statistics, texts))))

    return map_texts(docs, id_col, text, start, ", ".join(f"{name} long" for name in STATISTICS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def covers(self, features: dict[str, np.ndarray]) -> np.ndarray:
        values = features[self.feature]
        return values >= self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


def _best_condition(features, rows: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest FOIL gain over `rows`."""
    p, n = bad[rows].sum(), (~bad[rows]).sum()
    base, best = np.log2(p / (p + n)), (1e-9, None)
    for name, values in features.items():
        order = np.argsort(values[rows], kind="stable")
        v, b = values[rows][order], bad[rows][order]
        last = np.append(np.flatnonzero(v[1:] != v[:-1]), len(v) - 1)  # the last row of each value
        below_p, below_n = np.cumsum(b)[last], np.cumsum(~b)[last]
        for above in (False, True):
            # Of ">= threshold": everything beyond the values before it.
            cut = last[:-1]
            got_p = p - below_p[:-1] if above else below_p[:-1]
            got_n = n - below_n[:-1] if above else below_n[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(got_p > 0, got_p * (np.log2(got_p / (got_p + got_n)) - base), -1.0)
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def _covered(rule, features, n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.covers(features) for c in rule), np.ones(n, bool))


def learn_rules(features: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4,
                least: int = 5, seed: int = 42) -> list[tuple[Condition, ...]]:
    """Ordered conjunctions that single out the bad rows."""
    n = len(bad)
    grows = np.random.default_rng(seed).random(n) < 2 / 3
    left, rules = np.ones(n, bool), []
    while len(rules) < max_rules and (left & grows & bad).sum() >= least and (left & grows & ~bad).any():
        rule, rows = [], np.flatnonzero(left & grows)
        while len(rule) < max_conditions and not bad[rows].all():
            _, condition = _best_condition(features, rows, bad)
            if condition is None:
                break
            rule.append(condition)
            rows = rows[condition.covers({k: v[rows] for k, v in features.items()})]

        def worth(r):
            hit = _covered(r, features, n) & left & ~grows
            p, m = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - m) / (p + m) if p + m else -1.0

        if not rule:
            break
        rule = max((tuple(rule[:k]) for k in range(len(rule), 0, -1)), key=worth)
        hit = _covered(rule, features, n) & left
        if worth(rule) <= 0.5 or (hit & bad).sum() < least:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rules_column(rules) -> Column:
    """True for a text that no rule singles out."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(False)).otherwise(verdict)
    return verdict


def labelled_sample(labels: DataFrame, size: int, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """At most `size` ids with one label each, in hash order."""
    agreed = (labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
              .agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other"))
    return agreed.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(size)


def fit_rules(docs: DataFrame, labels: DataFrame, sample_size: int = 20_000, id_col: str = "doc_id",
              text: str = "text", **options) -> list[tuple[Condition, ...]]:
    """The list learned from at most `sample_size` labelled rows."""
    chosen = F.broadcast(labelled_sample(labels, sample_size, id_col))  # bounded by sample_size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(chosen, "id")
    known = statistics(rows, "id", "text").join(chosen, "id").dropDuplicates(["id"])
    found = known.select("label", *[F.expr(e).alias(k) for k, e in FEATURES.items()]).toPandas()
    features = {k: found[k].to_numpy(float) for k in FEATURES}
    return learn_rules(features, found["label"].to_numpy() == 0, **options)


def quality_verdicts(docs: DataFrame, rules, id_col: str = "doc_id", text: str = "text", least_words: int = 20,
                     most_repeated_percent: int = 30) -> DataFrame:
    """`id`, STATISTICS, base_failed, kept."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words")
                                               > most_repeated_percent * F.col("n_words"))
    return (statistics(docs, id_col, text).withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & rules_column(rules)))
