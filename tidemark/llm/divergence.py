"""How the sources of a language differ in their words, by hash-consed segment trees.

Every (lang, source) group has a count for each kept term of its language, and
from it a smoothed share p, an integer of `SCALE`. Two groups differ by the sum
of |p - q| over all kept terms. All of it is integer arithmetic.

A language's terms are cut into blocks of a bounded number of terms. Within a
block, every group's counts are the leaves of a segment tree over the terms'
numbers, which follow their frequency so that equal counts adjoin. Nodes are
hash-consed over all groups of the task: a subtree is the pair of its halves'
numbers, and equal pairs are one number, 0 for a subtree without occurrences.
Two trees are priced by walking both at once from the roots; at each level equal
pairs of nodes are met once, priced once, and the price is used wherever they
occur. Prices are counted beyond those of two zero counts, so that two empty
subtrees cost nothing whatever their size; what they cost is added at the end,
once for all kept terms. Spark's sum over blocks is the upper part of the trees.

With many sources a block's groups are cut into chunks by hash, and each task
prices one pair of chunks; no task meets more than two chunks of one block.

Defined cases: NULL text, lang and source are empty texts, and the empty lang is
a language; groups without terms are compared like others; without kept terms
all differences are 0; repeated rows count each time; an empty table gives an
empty result; whole texts are read, whatever their length; other columns do not
matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import saved

#: Documents of a language that a term must be in.
LEAST_DOCS = 30
#: Added to every count.
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Terms of a block, and groups of a chunk, about.
BLOCK = 1024
CHUNK = 64
#: Entries that a task counts before it hands them on.
_HELD = 300_000

#: ASCII letters, lower-cased, and all bytes of other characters; the rest parts terms.
_TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters and of anything beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term; and for each
    group a row with a NULL term. Counted within tasks, then summed."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()),
                     pa.array([0, *map(docs.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
            counts.clear()

        for batch in batches:
            for group, data in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()),
                                   batch.column("text")):
                if group not in counts:
                    counts[group] = Counter(), Counter()
                    held += 1
                n, in_docs = counts[group]
                before = len(n)
                found = terms_of(data.as_py())
                n.update(found)
                in_docs.update(set(found))
                held += len(n) - before
                if held > _HELD:
                    yield from handed_on()
                    held = 0
        yield from handed_on()

    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return (found.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, denominator: Column, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(SCALE * (count + smoothing) / denominator), in decimals: counts may be beyond 2^63 / SCALE."""
    numerator = F.lit(SCALE) * (count.cast("decimal(19,0)") + F.lit(smoothing))
    return 1 + F.call_function("div", numerator, denominator.cast("decimal(19,0)"))


class Trees:
    """Segment trees over the columns of `counts`, one per row; equal subtrees are one node."""

    def __init__(self, counts: np.ndarray) -> None:
        n_rows, n_terms = counts.shape
        width = 1 << max(n_terms - 1, 0).bit_length()
        leaves = np.zeros((n_rows, width), np.int64)
        leaves[:, :n_terms] = counts
        # 0 is put in front, so that node 0 is the empty subtree at every level.
        self.values, nodes = np.unique(np.append(0, leaves), return_inverse=True)
        nodes = nodes[1:].reshape(leaves.shape)
        self.sizes, self.halves = [len(self.values)], []
        while nodes.shape[1] > 1:
            m = self.sizes[-1]
            pairs, ids = np.unique(np.append(0, nodes[:, ::2] * m + nodes[:, 1::2]), return_inverse=True)
            nodes = ids[1:].reshape(n_rows, -1)
            self.halves.append((pairs // m, pairs % m))
            self.sizes.append(len(pairs))
        self.roots = nodes[:, 0]

    def price(self, a: int, b: int, prices_a: np.ndarray, prices_b: np.ndarray) -> int:
        """Sum over all leaves of rows `a` and `b` of |prices_a - prices_b| beyond that of two zeros;
        `prices_*` belong to `values`."""
        pairs, uses = np.array([self.roots[a] * self.sizes[-1] + self.roots[b]]), []
        for level in range(len(self.halves) - 1, -1, -1):
            (left, right), m, below = self.halves[level], self.sizes[level + 1], self.sizes[level]
            x, y = pairs // m, pairs % m
            pairs, where = np.unique(np.concatenate([left[x] * below + left[y], right[x] * below + right[y]]),
                                     return_inverse=True)
            uses.append(where)
        x, y = pairs // self.sizes[0], pairs % self.sizes[0]
        cost = np.abs(prices_a[x] - prices_b[y]) - abs(prices_a[0] - prices_b[0])
        for where in reversed(uses):
            cost = cost[where[:len(where) // 2]] + cost[where[len(where) // 2:]]
        return int(cost[0])


def _shares(values: np.ndarray, denominator: int, smoothing: int) -> np.ndarray:
    exact = values if not len(values) or int(values.max()) + smoothing < (1 << 62) // SCALE else values.astype(object)
    return (1 + (exact + smoothing) * SCALE // denominator).astype(np.int64)


def _priced(smoothing: int):
    """Prices of all pairs of a block's groups, of one chunk or across two."""
    def price(rows: pa.Table) -> pa.Table:
        out = {"lang": [], "a": [], "b": [], "excess": []}
        groups = {}
        for source, chunk, denominator in zip(*(rows.column(c).to_pylist() for c in ("source", "chunk", "denominator"))):
            groups[source] = chunk, denominator
        names = sorted(groups)
        row_of = {name: i for i, name in enumerate(names)}
        cells = rows.filter(rows.column("term").is_valid())
        terms = sorted({(-often, term) for often, term in zip(cells.column("often").to_pylist(),
                                                              cells.column("term").to_pylist())})
        column_of = {term: i for i, (_, term) in enumerate(terms)}
        if terms:
            counts = np.zeros((len(names), len(terms)), np.int64)
            counts[[row_of[s] for s in cells.column("source").to_pylist()],
                   [column_of[t] for t in cells.column("term").to_pylist()]] = cells.column("n").to_numpy()
            trees = Trees(counts)
            prices = [_shares(trees.values, groups[name][1], smoothing) for name in names]
            across = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
            for i, a in enumerate(names):
                for j in range(i + 1, len(names)):
                    if (trees.roots[i] or trees.roots[j]) and not (across and groups[a][0] == groups[names[j]][0]):
                        out["a"].append(a)
                        out["b"].append(names[j])
                        out["excess"].append(trees.price(i, j, prices[i], prices[j]))
        out["lang"] = rows.column("lang").to_pylist()[:1] * len(out["a"])
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "a": pa.array(out["a"], pa.string()),
                         "b": pa.array(out["b"], pa.string()), "excess": pa.array(out["excess"], pa.int64())})
    return price


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                      least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, top: int = TOP_TERMS,
                      block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: the group's difference to each other source of its language, all
    ranks. Part `term`: the terms that the group has more of than its language, by
    that difference, the first `top` of them.
    """
    counts = saved(term_counts(docs, lang, source, text), "terms")
    kept = saved(counts.filter("term IS NOT NULL").groupBy("lang", "term")
                 .agg(F.sum("n").alias("often"), F.sum("docs").alias("docs"))
                 .filter(F.col("docs") >= least_docs).select("lang", "term", "often"), "kept")
    cells = saved(counts.drop("docs").filter("n > 0").join(kept, ["lang", "term"]), "cells")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("often").alias("lang_total"))
    everyone = counts.select("lang", "source").distinct()
    langs = (everyone.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
             .fillna(0, ["v", "lang_total"]))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = saved(everyone.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
                   .select("lang", "source", "v", (F.col("total") + smoothing * F.col("v")).alias("denominator"),
                           (F.col("lang_total") + smoothing * F.col("v")).alias("lang_denominator"),
                           F.ceil(F.col("v") / block).cast("int").alias("blocks"),
                           F.ceil(F.col("sources") / chunk).cast("int").alias("chunks")), "groups")

    shared = cells.join(groups, ["lang", "source"])
    more = (share(F.col("n"), F.col("denominator"), smoothing)
            - share(F.col("often"), F.col("lang_denominator"), smoothing))
    terms = shared.select("lang", "source", F.col("term").alias("item"), more.alias("value")).filter("value > 0")

    # Every group is a row in each block, also one without terms there.
    present = groups.filter("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    leaves = (shared.withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
              .select("lang", "source", "block", "chunks", "denominator", "term", "n", "often")
              .unionAll(present.select("lang", "source", "block", "chunks", "denominator",
                                       F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(0).cast("long"))))
    chunked = leaves.withColumn("chunk", F.pmod(F.xxhash64("source"), "chunks").cast("int"))
    met = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = met.select("lang", "block", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
                       "source", "chunk", "denominator", "term", "n", "often")
    excess = (tiles.groupBy("lang", "block", "low", "high")
              .applyInArrow(_priced(smoothing), "lang string, a string, b string, excess long")
              .groupBy("lang", "a", "b").agg(F.sum("excess").alias("excess")))

    nothing = share(F.lit(0), F.col("denominator"), smoothing)
    mine = groups.select("lang", "source", "v", F.when(F.col("v") > 0, nothing).alias("p"))
    yours = groups.select("lang", F.col("source").alias("item"), F.when(F.col("v") > 0, nothing).alias("q"))
    pairs = (mine.join(yours, "lang").filter("source <> item")
             .withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item"))
             .join(excess, ["lang", "a", "b"], "left"))
    value = F.coalesce(F.col("v") * F.abs(F.col("p") - F.col("q")), F.lit(0)) + F.coalesce("excess", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    columns = ("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
    return (ranked(pairs).withColumn("part", F.lit("pair")).select(*columns)
            .unionAll(ranked(terms).filter(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*columns)))
