"""Near-duplicate vectors by spherical-cap filters.

After a seeded random rotation a vector is cut into blocks, and each block has
its own code of random directions; a filter direction is one choice from every
block's code. Decoding lists all filters whose cosine with a vector exceeds the
cap's threshold. Vectors meet in the filters they share, and every pair that
meets is verified in double precision.

The threshold follows from the number of vectors, so that a filter expects about
`OCCUPANCY` of them at any size. The number of filters grows until `RECALL` of
simulated pairs share one; after the rotation every pair is as random as these, so
that is the chance to find a pair just at the wanted cosine, whatever the data.
Closer pairs are found more often.

Two rounds keep vectors out of the wide shuffle. The first joins on filters with a
vector's number and a sketch of `SKETCH_BITS` signs of random projections: pairs whose
signs differ more than six standard deviations beyond what the wanted cosine
lets expect are too far. What is left of a filter falls into groups of
vectors that sketches connect, and a group is named by its smallest vector, so that the
many filters a near pair shares leave one group. The second round fetches the vectors of these
groups, once a group, and verifies in double precision.

A filter's or group's vectors are dealt over blocks of `BLOCK` rows and compared block by
block, so none is gathered whole; a filter larger than a block is a group as it is.
A pair counts only in the smallest group that both vectors share; what leaves a
block is a count per vector and a spanning forest, never the pairs.

Vectors of one length are compared with each other: each length that two different
vectors have gets filters of its own.

Defined cases: vectors that are NULL, empty, zero, or hold a NULL or non-finite
number link with nothing; equal vectors are one
node, linked with each other; repeated rows count as vectors of their own; an
empty table gives an empty result; other columns do not matter. Rows without an
id are linked, but give no component its name.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved
from tidemark.llm.components import components

OCCUPANCY = 192
RECALL = 0.95
BLOCK = 1024
SKETCH_BITS = 128
_TRIALS = 600
_LARGEST_CODE = 1 << 14


@dataclass(frozen=True)
class CapFilters:
    """A random product code over vectors of length `dim`."""

    dim: int
    n_blocks: int
    code_size: int
    threshold: float
    seed: int = 42

    @staticmethod
    def plan(n_vectors: int, dim: int, cosine: float, seed: int = 42) -> CapFilters:
        normal = NormalDist()
        p = min(0.05, OCCUPANCY / max(n_vectors, 1))
        z = normal.inv_cdf(1 - p)
        # How often the second vector of a pair is in a filter of the first, which is about 1/z beyond the cap.
        stays = 1 - normal.cdf((z - cosine * (z + 1 / z)) / math.sqrt(1 - cosine ** 2))
        first, second = _pairs_at(cosine, dim, _TRIALS, seed + 1)
        n_filters = 8 / stays / p
        for step in itertools.count():
            # Short vectors are not cut: their blocks would differ too much in length.
            n_blocks = 1 if dim < 16 else max(2, math.ceil(math.log(n_filters) / math.log(_LARGEST_CODE)))
            plan = CapFilters(dim, n_blocks, math.ceil(n_filters ** (1 / n_blocks)), z / math.sqrt(dim), seed)
            prepared = plan.prepared()
            names = zip(plan.decode(first, prepared), plan.decode(second, prepared))
            if np.mean([len(np.intersect1d(a, b)) > 0 for a, b in names]) >= RECALL:
                return plan
            if step % 3 == 2:  # more filters alone do not help for ever
                z *= 0.96
            else:
                n_filters *= 1.3

    def prepared(self):
        rng = np.random.default_rng(self.seed)
        rotation, _ = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))
        codes = []
        for part in np.array_split(np.arange(self.dim), self.n_blocks):
            code = rng.standard_normal((self.code_size, len(part)))
            # Blocks of unequal length get their share of a filter's unit length.
            code *= math.sqrt(len(part) / self.dim) / np.linalg.norm(code, axis=1, keepdims=True)
            codes.append((part, code))
        return rotation, codes

    def decode(self, units: np.ndarray, prepared) -> list[np.ndarray]:
        """The sorted filters of each unit vector."""
        rotation, codes = prepared
        turned = units @ rotation
        scores = [turned[:, part] @ code.T for part, code in codes]
        best_after = [np.zeros(len(units))]
        for s in reversed(scores[1:]):
            best_after.insert(0, best_after[0] + s.max(axis=1))
        found = []
        for i in range(len(units)):
            names, sums = np.zeros(1, np.int64), np.zeros(1)
            for s, best in zip(scores, best_after):
                sums = sums[:, None] + s[i]
                row, choice = np.nonzero(sums >= self.threshold - best[i])  # others cannot reach the cap
                names, sums = names[row] * self.code_size + choice, sums[row, choice]
            found.append(np.sort(names))
        return found


def _pairs_at(cosine: float, dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and others at exactly this cosine from them."""
    rng = np.random.default_rng(seed)
    a, off = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    return a, cosine * a + math.sqrt(1 - cosine ** 2) * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)


def _unit(rows: np.ndarray) -> np.ndarray:
    """In double precision; scaled first, so that squares neither vanish nor overflow."""
    rows = rows.astype(np.float64)
    if len(rows):
        rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _usable(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the vectors that can link and their places."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == dim)
        found = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)  # NULL comes as NaN
        found = found.astype(np.float64).reshape(-1, dim)
        good = np.isfinite(found).all(axis=1) & found.any(axis=1)
        yield found[good], places[good]


def _nodes(vectors: DataFrame, number: str) -> DataFrame:
    """(id, dim, digest, raw): the digest names equal directions and is NULL where nothing can
    link; `raw` has the numbers as the column's type."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            dims = pc.fill_null(pc.list_value_length(vectors), 0)
            digests, rows = [None] * len(vectors), [None] * len(vectors)
            for found, places in _usable(vectors):
                for i, row, unit in zip(places, found.astype(number), _unit(found) + 0.0):
                    digests[i], rows[i] = hashlib.blake2b(unit.tobytes(), digest_size=16).digest(), row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), dims.cast(pa.int32()), pa.array(digests, pa.binary()),
                                              pa.array(rows, pa.binary())], ["id", "dim", "digest", "raw"])

    return vectors.mapInArrow(run, f"id {id_type}, dim int, digest binary, raw binary")


def _sketches(units: np.ndarray, seed: int) -> np.ndarray:
    """Two 64-bit words of signs for each vector."""
    planes = np.random.default_rng(seed).standard_normal((units.shape[1], SKETCH_BITS))
    return np.packbits(units @ planes > 0, axis=1).view(np.int64)


def _most_signs(cosine: float) -> int:
    """Signs in which a pair at this cosine may differ, six standard deviations beyond the mean."""
    p = math.acos(min(1.0, cosine)) / math.pi
    return math.ceil(SKETCH_BITS * p + 6 * math.sqrt(SKETCH_BITS * p * (1 - p))) + 2


def _filtered(nodes: DataFrame, filters: CapFilters, number: str) -> DataFrame:
    """(node, s0, s1, filters)"""
    small = filters.code_size ** filters.n_blocks < 1 << 31
    kind, name = (pa.int32(), "int") if small else (pa.int64(), "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = filters.prepared()
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("raw").to_pylist()), number).reshape(-1, filters.dim)
            units = _unit(raw)
            names = [n.tolist() for n in filters.decode(units, prepared)]
            signs = _sketches(units, filters.seed + 2)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(signs[:, 0]), pa.array(signs[:, 1]),
                                              pa.array(names, pa.list_(kind))], ["node", "s0", "s1", "filters"])

    return nodes.mapInArrow(run, f"node long, s0 long, s1 long, filters array<{name}>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Runs of equal `place`, also across batches; one run is in memory at a time."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        place = now["place"]
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:]):
            if end - start > 1:
                yield int(place[start]), {c: v[start:end] for c, v in now.items()}
        held = {c: v[cuts[-1]:] for c, v in now.items()}
    if held is not None and len(held["place"]) > 1:
        yield int(held["place"][0]), held


def _sketched(entries: DataFrame, most: int) -> DataFrame:
    """(group, node) from (place, node, s0, s1), places together: who is near someone by sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, nodes = [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(roots)), pa.array(np.concatenate(nodes))],
                                             ["group", "node"])
            roots.clear(), nodes.clear()
            return out

        for _, run_of in _groups(batches):
            # Unsigned, as numpy counts the bits of absolute values.
            node, s0, s1 = run_of["node"], run_of["s0"].view(np.uint64), run_of["s1"].view(np.uint64)
            differ = np.bitwise_count(s0[:, None] ^ s0) + np.bitwise_count(s1[:, None] ^ s1)
            near = differ <= most
            met = near.sum(axis=1) > 1  # the vector itself is one
            if not met.any():
                continue
            node, near = node[met], near[np.ix_(met, met)]
            root, far = node.copy(), np.iinfo(np.int64).max
            while True:
                new = np.where(near, root, far).min(axis=1)
                if (new == root).all():
                    break
                root = new
            roots.append(root)
            nodes.append(node)
            if len(roots) >= 1000:
                yield flush()
        if roots:
            yield flush()

    return entries.mapInArrow(run, "group long, node long")


def _shares_earlier(name: int, left: list, right: list) -> np.ndarray | None:
    """Which pairs share a filter smaller than `name`."""
    earlier = [[f for f in row if f < name] for row in left], [[f for f in row if f < name] for row in right]
    both = {f for row in earlier[0] for f in row} & {f for row in earlier[1] for f in row}
    if not both:
        return None
    column = {f: i for i, f in enumerate(both)}
    has = [np.zeros((len(rows), len(both)), np.float32) for rows in earlier]
    for marks, rows in zip(has, earlier):
        for i, row in enumerate(rows):
            marks[i, [column[f] for f in row if f in column]] = 1
    return has[0] @ has[1].T > 0


def _compare(name: int, rows: list[dict], cosine: float, number: str) -> tuple[list, list, list]:
    """node, links, root of the rows of one pair of blocks; side 0 against side 1, or side 2 with itself."""
    left = [r for r in rows if r["side"] != 1]
    right = [r for r in rows if r["side"] != 0]
    if not left or not right:
        return [], [], []
    units = [_unit(np.frombuffer(b"".join([r["raw"] for r in side]), number).reshape(len(side), -1))
             for side in (left, right)]
    near = units[0] @ units[1].T >= cosine
    same = left[0]["side"] == 2
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return [], [], []
    counted = near
    earlier = _shares_earlier(name, [r["filters"] for r in left], [r["filters"] for r in right])
    if earlier is not None:
        counted = near & ~earlier
    weight = [np.array([r["copies"] for r in side], np.int64) for side in (left, right)]
    nodes = [np.array([r["node"] for r in side], np.int64) for side in (left, right)]
    root, far = nodes[1].copy(), np.iinfo(np.int64).max
    own = nodes[0].copy()
    while True:  # the smallest node reachable within the block
        new = np.minimum(own, np.where(near, root[None], far).min(axis=1, initial=far))
        back = np.minimum(root, np.where(near, new[:, None], far).min(axis=0, initial=far))
        if (new == own).all() and (back == root).all():
            break
        own, root = new, back
    links = np.where(counted, weight[1][None], 0).sum(axis=1)
    if same:
        return nodes[0].tolist(), links.tolist(), own.tolist()
    other = np.where(counted, weight[0][:, None], 0).sum(axis=0)
    return (np.concatenate(nodes).tolist(), np.concatenate([links, other]).tolist(),
            np.concatenate([own, root]).tolist())


def _verified(dealt: DataFrame, cosine: float, number: str) -> DataFrame:
    """(node, links, root) from rows sorted by (filter, i, j); one pair of blocks is in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key, rows):
            node, links, root = _compare(key[0], rows, cosine, number)
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()),
                                               pa.array(root, pa.int64())], ["node", "links", "root"])

        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = row["filter"], row["i"], row["j"]
                if now != key:
                    if len(rows) > 1:
                        yield emit(key, rows)
                    key, rows = now, []
                rows.append(row)
        if len(rows) > 1:
            yield emit(key, rows)

    return dealt.mapInArrow(run, "node long, links long, root long")


def _hot(entries: DataFrame, key: str, block: int, label: str) -> DataFrame:
    """Keys with more entries than a block, and over how many blocks they are dealt."""
    counts = entries.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > block)
    return saved(counts.select(key, F.ceil(F.col("n") / block).cast("int").alias("blocks")), label)


def _met(nodes: DataFrame, filters: CapFilters, cosine: float, number: str, block: int) -> DataFrame:
    """(group, node): a pair that shares a filter and whose sketches are near shares a group."""
    decoded = saved(_filtered(nodes.select("node", "raw"), filters, number), "filtered")
    names = decoded.select(F.explode("filters").alias("place"))
    hot = _hot(names, "place", block, "hot_filters")
    entries = decoded.select(F.explode("filters").alias("place"), "node", "s0", "s1")
    cold = entries.join(hot, "place", "left_anti")
    # Together with what precedes it in the sort of its task, a place is whole.
    cold = cold.repartition("place").sortWithinPartitions("place")
    whole = entries.select("place", "node").join(hot, "place", "left_semi")
    return saved(_sketched(cold, _most_signs(cosine)).distinct().unionAll(
        whole.select((-1 - F.col("place").cast("long")).alias("group"), "node")), "met")


def _met_and_verified(nodes: DataFrame, filters: CapFilters, cosine: float, number: str, block: int) -> DataFrame:
    """(node, links, root) of the nodes of one length."""
    met = _met(nodes, filters, cosine, number, block)
    hot = _hot(met, "group", block, "hot_groups")
    # At most a group per filter of a vector, so the list is bounded.
    lists = met.groupBy("node").agg(F.collect_list("group").alias("filters"))
    rows = lists.join(nodes.select("node", "copies", "raw"), "node").withColumn("filter", F.explode("filters"))
    dealt = (rows.join(hot.withColumnRenamed("group", "filter"), "filter", "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    # Side 2: both blocks are the same one.
    dealt = dealt.select("filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         F.expr("CASE WHEN own = other THEN 2 WHEN own < other THEN 0 ELSE 1 END").alias("side"),
                         "node", "copies", "raw", "filters")
    dealt = dealt.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    return saved(_verified(dealt, cosine, number), "verified")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector: str = "embedding",
                 block: int = BLOCK, seed: int = 42) -> DataFrame:
    """`id`, n_links, component_id, kept."""
    number = "f4" if vectors.select(vector).dtypes[0][1] == "array<float>" else "f8"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    named = saved(_nodes(rows, number), "vectors")
    nodes = (named.filter("digest IS NOT NULL").groupBy("dim", "digest")
             .agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("raw").alias("raw")))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lengths = nodes.groupBy("dim").agg(F.count("*").alias("n")).filter("n > 1").orderBy("dim").collect()
    verified = nodes.sparkSession.createDataFrame([], "node long, links long, root long")
    for dim, n in lengths:
        filters = CapFilters.plan(n, dim, cosine, seed)
        verified = verified.unionAll(_met_and_verified(nodes.filter(F.col("dim") == dim), filters, cosine, number, block))

    classes = saved(components(verified.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.select("node", "digest", "copies", "id").join(classes, "node", "left").join(links, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    known = known.join(least, "component").select(
        "digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.coalesce("component_id", "id")
    return named.select("id", "digest").join(known, "digest", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
