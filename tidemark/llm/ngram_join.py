"""Exact n-gram Jaccard self-join by vertical partitioning.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents
with equal sets are one node. All nodes share a global order of n-grams: those
that a mergeable frequent-items summary over the whole corpus counts come last, by
count; the rest are in hash order, so rare n-grams lead.

Candidates: two sets of the required similarity share at least `LEADING` n-grams
among the first of each in that order, where "first" ends the sooner the more
they must overlap, given their sizes.
To keep groups of near copies from emitting all their pairs, each n-gram's nodes
are first compared with one leader, the node with the most shared n-grams; then
only pairs across the components found so far are candidates, all of them.

Verification: the order is cut into `FRAGMENTS` by hash, each fragment of a pair
gives its partial overlap, and the sum per pair decides. No pair that the
threshold admits is lost between different components, so components are exact.

Defined cases: with fewer words than a shingle the whole sequence is the only
n-gram; a text without words (NULL, empty, white space) has an empty set and is
linked with nothing; repeated rows have equal sets and share a component; rows
without an id link, and link others, like any row, but name no component unless all
of it lacks ids, whose component_id is NULL; long texts are compared whole; an empty table
gives an empty result; other columns do not matter. Two n-grams with one 64-bit hash
count as equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import saved
from tidemark.llm.components import components
from tidemark.llm.text_map import SLICE
from tidemark.llm.url_filter import BloomLevel

WORDS = 5
PERCENT = 80
FRAGMENTS = 8
#: Common leading n-grams that make two nodes a candidate.
LEADING = 2
#: N-grams that the frequency summary keeps; its error is the corpus's n-grams divided by this.
SUMMARY = 1 << 18
_BUFFER = 1 << 22
_KNOWN_WORDS = 200_000
#: 8 MB at most for the filter that keeps other documents out of the verification's shuffle.
_FILTER_WORDS = 1 << 20
_FACTORS = np.random.default_rng(5).integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct n-gram hashes, as signed 64-bit numbers."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII space only
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [],
                        np.uint64).view(np.int64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    mixed = values[:n] * _FACTORS[0]
    for i in range(1, WORDS):
        mixed += values[i:i + n] * _FACTORS[i]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _FACTORS[0]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def merge_counts(hashes: np.ndarray, counts: np.ndarray, keep: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """One frequent-items summary of several: sums by hash, less the count of the first one beyond `keep`."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    hashes, counts = hashes[starts], np.add.reduceat(counts, starts) if len(starts) else counts
    if len(hashes) > keep:
        counts = counts - np.partition(counts, len(counts) - keep - 1)[len(counts) - keep - 1]
        hashes, counts = hashes[counts > 0], counts[counts > 0]
    return hashes, counts


def absorb(waiting: list[np.ndarray], summary: tuple[np.ndarray, np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """`merge_counts` of a sorted summary and n-grams, which it takes out of `waiting`; at its
    peak it holds about three times the n-grams."""
    found = np.concatenate(waiting)
    waiting.clear()
    found.sort()
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])).astype(np.int32)
    times = np.diff(starts, append=np.int32(len(found)))
    fresh = found[starts]
    del found, starts
    hashes, counts = summary[0], summary[1].copy()
    at = np.searchsorted(fresh, hashes)
    at[at == len(fresh)] = 0
    known = fresh[at] == hashes
    counts[known] += times[at[known]]
    new = np.ones(len(fresh), bool)
    new[at[known]] = False
    cut, n = 0, len(hashes) + int(new.sum())
    if n > keep:
        every = np.concatenate([counts, times[new]])
        every.partition(n - keep - 1)
        cut = every[n - keep - 1]
        del every
    new &= times > cut
    hashes, counts = hashes[counts > cut], counts[counts > cut]
    hashes, counts = np.concatenate([hashes, fresh[new]]), np.concatenate([counts, times[new]]) - cut
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task makes of a batch at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _sets_and_summaries(docs: DataFrame) -> DataFrame:
    """A row per document (id, key, n, digest), and a row per task with its summary."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, size = WordHashes(), [], 0
        summary = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        names = ["id", "key", "n", "digest", "part", "hashes", "counts"]

        id_kind = None
        for batch in _slices(batches):
            ids, sizes, digests = batch.column("id"), [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, known)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                waiting.append(found)
                size += len(found)
                if size > _BUFFER:
                    # Twice the entries until the task ends, so that its many small cuts cost little accuracy.
                    summary, size = absorb(waiting, summary, 2 * SUMMARY), 0
            id_kind, none = ids.type, [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(none, pa.int64()),
                 pa.array(none, pa.binary()), pa.array(none, pa.binary())], names)
        if id_kind is not None:
            if size:
                summary = absorb(waiting, summary, 2 * SUMMARY)
            summary = merge_counts(*summary)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([summary[0].tobytes()], pa.binary()),
                 pa.array([summary[1].tobytes()], pa.binary())], names)

    return docs.mapInArrow(run, f"id {id_type}, key long, n long, digest binary, part long, hashes binary, counts binary")


def _merged(summaries: DataFrame, fan_in: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The summary of all tasks, merged in a tree; it is bounded by SUMMARY entries."""
    n = summaries.count()
    schema = "part long, hashes binary, counts binary"

    def merge(table: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist()):
            found = merge_counts(np.concatenate([found[0], np.frombuffer(h, np.int64)]),
                                 np.concatenate([found[1], np.frombuffer(c, np.int64)]))
        return pa.table({"part": pa.array(table.column("group")[:1], pa.int64()),
                         "hashes": pa.array([found[0].tobytes()], pa.binary()),
                         "counts": pa.array([found[1].tobytes()], pa.binary())})

    while n > 1:
        groups = math.ceil(n / fan_in)
        grouped = summaries.withColumn("group", F.pmod("part", F.lit(groups)))
        summaries = saved(grouped.groupBy("group").applyInArrow(merge, schema), "summary")
        n = summaries.count() if groups > 1 else 1
    row = summaries.first()
    if row is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.frombuffer(row["hashes"], np.int64), np.frombuffer(row["counts"], np.int64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of two similar sets, whatever the other's size, the LEADING first common n-grams lie within this."""
    return min(n, n - (n * percent + 99) // 100 + LEADING)


def _prefixes(docs: DataFrame, summary, percent: int) -> DataFrame:
    """(digest, n, prefix, last): the leading n-grams of every set, and the order of the last of them."""
    shared = docs.sparkSession.sparkContext.broadcast(summary)  # bounded by SUMMARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (hashes, counts) = WordHashes(), shared.value
        for batch in _slices(batches):
            sizes, digests, prefixes, lasts, grams = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, known)
                if not len(found):
                    continue
                at = np.searchsorted(hashes, found)
                at[at == len(hashes)] = 0
                often = np.where(hashes[at] == found, counts[at], 0) if len(hashes) else np.zeros(len(found), np.int64)
                first = np.lexsort((found, often))[:prefix_length(len(found), percent)]
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                prefixes.append(found[first])
                lasts.append(int(often[first[-1]]))
                grams.append(int(found[first[-1]]))
            if sizes:
                offsets = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(offsets, np.concatenate(prefixes)), pa.array(lasts, pa.int64()),
                     pa.array(grams, pa.int64())], ["digest", "n", "prefix", "last_count", "last_gram"])

    return docs.mapInArrow(run, "digest binary, n int, prefix array<long>, last_count long, last_gram long")


def _segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, fragment, grams): the sets of the wanted (node, id, key, digest), cut at fixed places of the hash order."""
    columns = ("text", "node", "digest")

    def fetched(rows: DataFrame, some: DataFrame, by: str) -> DataFrame:
        near = BloomLevel(some.select(F.col(by).cast("string").alias("key")), some.count(), 0, _FILTER_WORDS)
        return rows.filter(near.holds(F.col(by).cast("string")))

    named, nameless = wanted.filter("id IS NOT NULL"), wanted.filter("id IS NULL")
    rows = fetched(docs, named, "id").join(named.select("node", "id", "digest"), "id").select(*columns)
    if not nameless.isEmpty():
        # Texts that only rows without an id have are fetched by their hash, each once.
        others = fetched(docs.filter("id IS NULL"), nameless, "key").dropDuplicates(["key"])
        rows = rows.unionAll(others.join(nameless.select("node", "key", "digest"), "key").select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in _slices(batches):
            out = {"node": [], "fragment": [], "grams": []}
            for text, node, digest in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "digest"))):
                found = shingle_set(text, known)
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() != digest:
                    continue  # another text under the same id or hash
                parts = (found >> 61) + FRAGMENTS // 2
                for fragment in np.unique(parts).tolist():
                    out["node"].append(node)
                    out["fragment"].append(fragment)
                    out["grams"].append(found[parts == fragment])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["node"], pa.int64()), pa.array(out["fragment"], pa.int32()),
                 pa.array(out["grams"], pa.list_(pa.int64()))], list(out))

    found = rows.select("text", "node", "digest").mapInArrow(run, "node long, fragment int, grams array<long>")
    return found.dropDuplicates(["node", "fragment"])


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough: partial overlaps by fragment, summed."""
    pairs = saved(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = saved(wanted.join(nodes.select("node", "id", "key", "digest"), "node"), "wanted")
    parts = saved(_segments(docs, wanted), "segments")
    of = lambda side: parts.select(F.col("node").alias(side), "fragment", F.col("grams").alias(f"g{side}"))
    overlaps = (pairs.join(of("a"), "a").join(of("b"), ["b", "fragment"])
                .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("overlap")))
    total = overlaps.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return saved(total.filter(F.col("overlap") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))
                 .select("a", "b"), "linked")


def _overlap(a: str, b: str, percent: int) -> str:
    """The overlap that two nodes of these sizes need, in SQL."""
    return f"(({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent})"


def _leads(node: str, a: str, b: str, percent: int) -> str:
    """Whether a common n-gram can be among the LEADING first of a similar pair: past this place in
    either set too few are left for the overlap. A pair needs least(LEADING, overlap) of these."""
    need = _overlap(a, b, percent)
    return f"{node}.place < {node}.n - {need} + least({LEADING}, {need})"


def _missing(a: str, b: str, percent: int) -> Column:
    """Common leading n-grams that a pair needs at least.

    All n-grams up to the earlier of the two last ones are in both prefixes, so beyond
    the common ones only what follows that set's own prefix can add to the overlap.
    """
    need = F.expr(_overlap(a, b, percent))
    earlier = F.struct(f"{a}.last_count", f"{a}.last_gram") < F.struct(f"{b}.last_count", f"{b}.last_gram")
    return F.greatest(need - F.when(earlier, F.col(f"{a}.rest")).otherwise(F.col(f"{b}.rest")), F.lit(1))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                      percent: int = PERCENT) -> DataFrame:
    """`id`, n_shingles, component_id (the smallest id reachable by links), and of the row's
    text: text_key (its hash), class_key (equal for texts that are linked, NULL without words)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    found = saved(_sets_and_summaries(docs), "sets")
    sets = found.filter("digest IS NOT NULL").select("id", "key", "n", "digest")
    summary = _merged(found.filter("hashes IS NOT NULL").select("part", "hashes", "counts"))

    leading = (_prefixes(docs, summary, percent).groupBy("digest")
               .agg(*[F.first(c).alias(c) for c in ("n", "prefix", "last_count", "last_gram")]))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key")).alias("first")
    least = sets.filter("n > 0").groupBy("digest").agg(first).select("digest", "first.id", "first.key")
    nodes = saved(leading.join(least, "digest").withColumn("node", F.monotonically_increasing_id())
                  .withColumn("rest", F.col("n") - F.size("prefix")), "nodes")

    grams = nodes.select("node", "n", F.posexplode("prefix").alias("place", "gram"))
    several = grams.groupBy("gram").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("gram")
    shared = saved(grams.join(several, "gram"), "shared")
    degree = shared.groupBy("node").agg(F.count("*").alias("degree"))
    info = nodes.select("node", "n", "last_count", "last_gram", "rest").join(degree, "node")
    member = F.struct("degree", "node", "n", "last_count", "last_gram", "rest", "place")
    shared = saved(shared.drop("n").join(info, "node").select("gram", member.alias("m")), "members")

    # One leader a gram. Pairs that this filter drops for want of grams under the
    # same leader are candidates again below.
    leaders = shared.groupBy("gram").agg(F.max("m").alias("l"))
    stars = (shared.join(leaders, "gram").filter("m.node <> l.node")
             .filter(f"least(m.n, l.n) * 100 >= {percent} * greatest(m.n, l.n)")
             .select(F.col("m.node").alias("a"), F.col("l.node").alias("b"), F.col("m.n").alias("na"),
                     F.col("l.n").alias("nb"), _missing("m", "l", percent).alias("need")))
    enough = lambda rows: (rows.groupBy("a", "b", "na", "nb", "need").agg(F.count("*").alias("common"))
                           .filter("common >= need").select("a", "b", "na", "nb"))
    links = _linked(docs, nodes, enough(stars), percent)

    found_so_far = saved(components(links), "components")
    placed = saved(shared.withColumn("node", F.col("m.node")).join(found_so_far, "node", "left")
                   .select("gram", "m", F.coalesce("component", "node").alias("c")), "placed")
    x, y = placed.alias("x"), placed.alias("y")
    across = (x.join(y, F.expr("x.gram = y.gram AND x.c <> y.c AND (x.m.n < y.m.n OR x.m.n = y.m.n AND "
                               f"x.m.node < y.m.node) AND y.m.n * {percent} <= x.m.n * 100 AND "
                               f"{_leads('x.m', 'x.m', 'y.m', percent)} AND {_leads('y.m', 'x.m', 'y.m', percent)}"))
              .select(F.col("x.m").alias("s"), F.col("y.m").alias("t"))
              .select(F.col("s.node").alias("a"), F.col("t.node").alias("b"), F.col("s.n").alias("na"),
                      F.col("t.n").alias("nb"), F.expr(f"least({LEADING}, {_overlap('s', 't', percent)})").alias("need")))
    links = links.unionAll(_linked(docs, nodes, enough(across), percent))

    of_node = nodes.select("digest", "node", "id").join(saved(components(links), "components"), "node", "left")
    of_node = of_node.select("digest", "id", F.coalesce("component", "node").alias("component"))
    names = of_node.groupBy("component").agg(F.min("id").alias("component_id"), F.min("digest").alias("class_key"))
    classes = of_node.join(names, "component").select("digest", "component_id", "class_key")
    return sets.join(classes, "digest", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        F.col("key").alias("text_key"), "class_key")
