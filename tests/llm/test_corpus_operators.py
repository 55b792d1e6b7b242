"""Operators over whole tables, against brute force and SQL."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import differences, duck
from tidemark.llm import queries as Q, url_filter
from tidemark.llm.cap_filters import CapFilters, _most_signs, _pairs_at, _sketches, near_vectors
from tidemark.llm.common import table
from tidemark.llm.components import components
from tidemark.llm.mixing import mix_plan, mixed_documents
from tidemark.llm.ngram_join import absorb, merge_counts, similar_documents
from tidemark.llm.sharding import stratified_shards
from tidemark.llm.url_filter import RULES, Cascade, url_verdicts

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", Q.SQL)
def test_sql(spark, name):
    assert differences(Q.QUERIES[name](spark, SF_DIR), duck(SF_DIR), Q.SQL[name]) is None


# Components

def roots(pairs, nodes=()):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in nodes:
        find(x)
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    expected = roots([p for p in pairs if p[0] != p[1]])
    assert sorted(found.collect()) == sorted(expected.items())
    assert components(spark.createDataFrame([(5, 5)], "a long, b long")).collect() == []


# Cap filters

def vectors_table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "x")
                                  for i, v in vectors], "vec_id long, embedding array<float>, label string, node string")


def planted(seed, n=300, dim=32, groups=20, cosine=0.96):
    """Random vectors, and groups of vectors about the cosine away from a random centre."""
    rng = np.random.default_rng(seed)
    out = list(rng.standard_normal((n, dim)))
    for size in range(2, groups + 2):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            off = rng.standard_normal(dim)
            off -= off @ centre * centre
            out.append(centre * cosine + off / np.linalg.norm(off) * math.sqrt(1 - cosine ** 2))
    return np.array(out, np.float32)


@pytest.mark.parametrize("block", [7, 1024])
def test_links_by_brute_force(spark, block):
    found_links = all_links = 0
    for seed in (1, 2):
        x = planted(seed, cosine=0.98)
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        near = unit @ unit.T >= 0.95
        np.fill_diagonal(near, False)
        rows = near_vectors(vectors_table(spark, enumerate(x)), block=block).orderBy("id").collect()
        links = np.array([r.n_links for r in rows])
        assert (links <= near.sum(axis=1)).all()
        found_links += links.sum()
        all_links += near.sum()
        names = roots(np.argwhere(near).tolist(), range(len(x)))
        agree = np.mean([r.component_id == names[r.id] for r in rows])
        assert agree > 0.95 and all(r.kept == (r.id == r.component_id) for r in rows)
    assert found_links >= 0.95 * all_links > 0


@pytest.mark.parametrize("block", [100, 1024])
def test_pairs_planted_into_the_given_table(spark, block):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.array(given["embedding"].tolist(), np.float32)
    rng = np.random.default_rng(11)
    of = np.repeat(np.arange(0, 400, 4), 3)  # three near copies of each of a hundred vectors
    off = rng.standard_normal((len(of), x.shape[1]))
    size = np.linalg.norm(x[of], axis=1, keepdims=True) * 0.15 / np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([x, (x[of] + off * size).astype(np.float32)])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    names = roots(np.argwhere(near).tolist(), range(len(x)))
    rows = near_vectors(vectors_table(spark, enumerate(x)), block=block).orderBy("id").collect()
    assert near.sum() >= 600
    assert sum(r.n_links for r in rows) >= 0.97 * near.sum() and all(r.n_links <= near[r.id].sum() for r in rows)
    assert np.mean([r.component_id == names[r.id] for r in rows]) > 0.99


def test_sketches_lose_no_pair_at_the_cosine():
    a, b = _pairs_at(0.95, 64, 20_000, 3)
    signs = [_sketches(v, 44).view(np.uint64) for v in (a, b)]
    assert np.bitwise_count(signs[0] ^ signs[1]).sum(axis=1).max() <= _most_signs(0.95) < 40


@pytest.mark.parametrize("n", [10 ** 6, 10 ** 8])
def test_filters_of_a_vector_grow_slowly(n):
    filters = CapFilters.plan(n, 64, 0.95)
    x, _ = _pairs_at(0.95, 64, 200, 9)
    assert np.mean([len(names) for names in filters.decode(x, filters.prepared())]) < 100


@pytest.mark.parametrize("n", [2_000, 50_000])
def test_recall_at_the_threshold(n):
    rng = np.random.default_rng(7)
    filters = CapFilters.plan(n, 64, 0.95)
    prepared = filters.prepared()
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal((400, 64))
    off -= (off * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95 ** 2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    met = [bool(set(x) & set(y)) for x, y in zip(map(list, filters.decode(a, prepared)),
                                                   map(list, filters.decode(b, prepared)))]
    assert np.mean(met) >= 0.92


def test_decoding_lists_all_filters():
    filters = CapFilters(8, 2, 6, 0.3)
    rotation, codes = prepared = filters.prepared()
    x = np.random.default_rng(1).standard_normal((20, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for row, names in zip(x, filters.decode(x, prepared)):
        expected = [i * 6 + j for i in range(6) for j in range(6)
                    if np.concatenate([codes[0][1][i], codes[1][1][j]]) @ (row @ rotation) >= 0.3]
        assert names.tolist() == expected


def test_odd_vectors(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, base), (2, None), (3, [0.0] * 4), (4, [1.0, None, 3.0, 4.0]), (5, [float("nan"), 2, 3, 4]), (6, []),
            (7, [float("inf"), 2, 3, 4]), (8, [2 * v for v in base]), (9, base), (9, base), (None, base),
            (10, [1.0, 2.0]), (11, [-v for v in base]), (12, [v * 1e-38 for v in base])]
    found = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors_table(spark, rows)).collect()),
                   key=repr)
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 10, 11)]
    group = [(1, 5, 1, True)] + [(i, 5, 1, False) for i in (8, 9, 9, None, 12)]
    assert found == sorted(alone + group, key=repr)
    assert near_vectors(vectors_table(spark, [(1, base)]).filter("false")).collect() == []


def test_vectors_of_several_lengths(spark):
    base = [[1.0, 2.0, 3.0, 4.0], [1.0, 2.0], [5.0, 1.0, 0.0, 0.0, 0.0]]
    rows = [(10 * k + i, v) for k, v in enumerate(base) for i in range(2)]
    rows += [(10 * k + 5, [*v[:-1], v[-1] + 0.001]) for k, v in enumerate(base)] + [(40, [1.0] * 7), (41, [1.0] * 7)]
    found = {r.id: (r.n_links, r.component_id) for r in near_vectors(vectors_table(spark, rows)).collect()}
    assert found == {**{10 * k + i: (2, 10 * k) for k in range(3) for i in (0, 1, 5)}, 40: (1, 40), 41: (1, 40)}


def test_hot_group_of_copies(spark):
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(500)] + [(500 + i, [math.cos(i), math.sin(i), 3.0]) for i in range(3)]
    found = near_vectors(vectors_table(spark, rows))
    assert found.filter("id < 500 AND n_links >= 499 AND component_id = 0").count() == 500


# Mixing

def slow_targets(sizes, weights=(5, 2, 1)):
    """Share by weight, again and again, until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= above


def test_targets_and_budgets(spark, documents):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "a", "a", "b", "c", "é", "\U0001d538", None]))
            for i in range(400)]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += text.count("w")
    expected, source_of = slow_targets(sizes), {i: s for i, _, s in rows}
    plan = mix_plan(documents(*rows)).collect()
    assert sorted(r.id for r in plan) == list(range(400))
    taken = defaultdict(int)
    for r in plan:
        source = source_of[r.id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(expected[source])
        assert r.size == rows[r.id][1].count("w") and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(taken[s] == math.floor(expected[s] + 1e-6) for s in sizes)
    assert sorted(plan) == sorted(mix_plan(documents(*reversed(rows)).repartition(5)).collect())


def test_mixed_documents_hold_what_is_taken(documents):
    rng = random.Random(6)
    rows = [(i, " ".join(f" d{i}w{j}\n" for j in range(rng.randrange(30))), rng.choice("abc")) for i in range(120)]
    docs = documents(*rows)
    plan, mixed = {r.id: r.taken for r in mix_plan(docs).collect()}, mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        got = WORD.findall(r.text)
        assert got == WORD.findall(dict((i, t) for i, t, _ in rows)[r.doc_id])[:len(got)] and r.n_chars == len(r.text)
        words[r.doc_id] += len(got)
    assert words == Counter({i: n for i, n in plan.items() if n})


def test_mixing_odd_rows(odd_documents):
    found = mix_plan(odd_documents).collect()
    assert sum(r.copies for r in found) == odd_documents.count()
    assert mix_plan(odd_documents.filter("false")).collect() == []
    assert mix_plan(odd_documents.filter("text IS NULL")).first().taken == 0
    mixed_documents(odd_documents).collect()


# Sharding

@pytest.mark.parametrize("n, shards", [(1000, 8), (5, 8), (1, 8), (777, 3)])
def test_shards(spark, documents, n, shards):
    rng = random.Random(n)
    docs = documents(*[(i, f"t{i % 50}", rng.choice(["hot"] * 5 + ["b", "c", None])) for i in range(n)])
    rows = stratified_shards(docs, shards).collect()
    assert sorted(r.id for r in rows) == list(range(n))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mixture = Counter((r.shard, r.source) for r in rows)
    for source, size in Counter(r.source for r in rows).items():
        for shard in range(shards):
            assert abs(mixture[shard, source] - size / shards) <= 5
    assert sorted(rows, key=repr) == sorted(stratified_shards(docs.repartition(7), shards).collect(), key=repr)


def test_shards_of_odd_rows(odd_documents):
    rows = stratified_shards(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {(r.size, r.text_crc32) for r in rows if r.id in (2, 3)} == {(1, 0)}
    assert stratified_shards(odd_documents.filter("false")).collect() == []


# N-gram join

def slow_components(rows):
    sets = []
    for _, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and
             100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    names = roots(pairs, range(len(rows)))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(names[i], []).append(doc_id)
    return sorted((rows[i][0], len(sets[i]), min(least[names[i]])) for i in range(len(rows)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similar_documents(documents, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(90)}" for _ in range(rng.choice([3, 5, 30, 120, 200]))]
        base += passage if group % 3 == 0 else []
        for _ in range(rng.choice([1, 2, 9, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
            text = rng.choice([" ", "\n", "\t "]).join(words)
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else text))
    rng.shuffle(rows)
    found = similar_documents(documents(*rows)).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in found) == slow_components(rows)


def test_similarity_of_odd_rows(odd_documents):
    found = {r.id: (r.n_shingles, r.component_id) for r in similar_documents(odd_documents).collect()}
    assert found[1] == found[5] == (3, 1) and found[7][1] == found[8][1] == 7
    assert found[2] == (0, 2) and found[3] == (0, 3) and found[4] == (0, 4) and found[9] == (1, 9)
    assert similar_documents(odd_documents).count() == odd_documents.count()
    assert similar_documents(odd_documents.filter("false")).collect() == []


def test_links_through_rows_without_an_id(documents):
    words = [f"w{i}" for i in range(100)]
    near = lambda *edits: " ".join(f"e{i}" if i in edits else w for i, w in enumerate(words))
    first, bridge, last = near(), near(20, 21), near(20, 21, 95, 96)
    rows = [(1, first), (None, bridge), (None, bridge), (3, last), (None, "nobody else has this text at all")]
    assert {p for *_, p in slow_components([(9, first), (8, last)])} == {8, 9}
    found = similar_documents(documents(*rows)).collect()
    assert Counter((r.id, r.component_id) for r in found) == Counter(
        {(1, 1): 1, (None, 1): 2, (3, 1): 1, (None, None): 1})


@pytest.mark.parametrize("seed", [4, 5])
def test_similar_documents_without_ids(documents, seed):
    rng = random.Random(seed)
    rows = []
    for group in range(10):
        base = [f"g{group}w{i}" for i in range(rng.choice([40, 80, 150]))]
        for _ in range(rng.choice([2, 5, 9])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    named = [(None if rng.random() < 0.5 else i, text) for i, text in rows]
    group_of = {rows[i][1]: name for i, (_, _, name) in enumerate(sorted(slow_components(rows)))}
    found = similar_documents(documents(*named)).collect()
    least = {}
    for i, text in named:
        if i is not None:
            least[group_of[text]] = min(i, least.get(group_of[text], i))
    assert Counter((r.id, r.component_id) for r in found) == Counter(
        (i, least.get(group_of[text])) for i, text in named)


def test_one_id_with_two_texts(documents):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    found = similar_documents(documents((1, a), (1, b), (2, b + " c"), (3, a))).collect()
    assert sorted((r.id, r.component_id) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_frequency_summary_bound():
    rng = np.random.default_rng(3)
    stream = np.concatenate([rng.integers(0, 10_000, 20_000), np.repeat(-1, 900), np.repeat(-2, 500)])
    rng.shuffle(stream)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in np.array_split(stream, 30):
        h, c = np.unique(part, return_counts=True)
        found = merge_counts(np.concatenate([found[0], h]), np.concatenate([found[1], c]), keep=200)
    counts = dict(zip(found[0].tolist(), found[1].tolist()))
    assert len(counts) <= 200
    for value, true in ((-1, 900), (-2, 500)):
        assert true - len(stream) / 200 <= counts[value] <= true


def test_sources_that_are_null_and_empty_stay_apart(documents):
    docs = documents((1, "w w w w", None), (1, "w w w w", ""), (1, None, "a"), (1, "", "a"))
    plan = mix_plan(docs).collect()
    taken = sum(r.taken * r.copies for r in plan)
    mixed = mixed_documents(docs).collect()
    assert len(plan) == 4 and taken == sum(len(r.text.split()) for r in mixed) == 12


def test_parts_of_a_key_do_not_run_together(spark):
    docs = spark.createDataFrame([("1:a", "b", "w w"), ("1", "a:b", "w w"), ("11", "a", "w"), ("1", "1a", "w")],
                                 "doc_id string, source string, text string")
    assert mix_plan(docs).select("key").distinct().count() == 4


def test_too_many_sources_are_refused(documents, monkeypatch):
    monkeypatch.setattr("tidemark.llm.mixing.MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mix_plan(documents((1, "a", "x"), (2, "b", "y"), (3, "c", None)))


# URL filter

def slow_verdict(url, listed, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), h + p, act) for act, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if host and listed(host) else "allow"


URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/?q", "http://x.www.example.com/en/z#f",
        "http://notexample.com/en/", "http://com", "http://b.net/es/", "http://b.net/es", "ftp://net/fr/a?b#c", "", None,
        "no scheme/com/", "://", "http://?q", "http://ads.x.org/a://b", "http://É.org/é", "http://h.org\n/x", "http://com/"]


@pytest.mark.parametrize("keys_per_pass", [1 << 22, 40])
def test_verdicts(spark, keys_per_pass):
    rng = random.Random(9)
    urls = URLS + [f"http://h{rng.randrange(600)}.org/{i}" for i in range(900)] + URLS
    listed = lambda h: h[-5] in "13" or h.startswith("ads")
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, key string")
    column = lambda h: F.substring(h, -5, 1).isin("1", "3") | h.startswith("ads")
    found = url_verdicts(pages, column, keys_per_pass=keys_per_pass).collect()
    assert {r.id: tuple(r)[1:] for r in found} == \
        {i: slow_verdict(u, lambda h: len(h) >= 5 and listed(h) or h.startswith("ads")) for i, u in enumerate(urls)}
    assert url_verdicts(pages.filter("false"), column).collect() == []


def test_filters_are_bounded_with_many_other_hosts(spark, monkeypatch):
    sizes = []

    class Counted(url_filter.BloomLevel):
        def __init__(self, keys, n_keys, *rest):
            sizes.append(n_keys)
            super().__init__(keys, n_keys, *rest)

    monkeypatch.setattr(url_filter, "BloomLevel", Counted)
    pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".org/")).alias("url"))
    listed = spark.range(0, 40_000, 200).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"))
    found = url_verdicts(pages, listed.unionAll(listed), keys_per_pass=200)
    assert found.filter((F.col("id") % 200 == 0) != (F.col("verdict") == "block")).count() == 0
    assert found.count() == 40_000 and max(sizes) <= 1.5 * 200


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = Cascade(keys)
    assert len(cascade.levels) > 1
    assert keys.filter(cascade.listed(F.col("key")) != F.col("listed")).count() == 0


def test_cascade_without_listed_keys(spark):
    keys = spark.range(5).select(F.col("id").cast("string").alias("key"), F.lit(False).alias("listed"))
    assert keys.filter(Cascade(keys).listed(F.col("key"))).count() == 0


# Summary of frequent n-grams

def test_absorbed_grams_are_merged_counts():
    rng = np.random.default_rng(1)
    for keep in (5, 50, 10 ** 6):
        found = expected = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for _ in range(6):
            grams = [rng.integers(-60, 60, k) for k in (0, 30, 90)]
            fresh, times = np.unique(np.concatenate(grams), return_counts=True)
            expected = merge_counts(np.concatenate([expected[0], fresh]), np.concatenate([expected[1], times]), keep)
            found = absorb(grams, found, keep)
            assert not grams and all(np.array_equal(*pair) for pair in zip(found, expected))


def test_absorbing_holds_few_copies_of_the_grams():
    rng = np.random.default_rng(2)
    grams = [rng.integers(-1 << 62, 1 << 62, 4096) for _ in range(256)]
    size = sum(g.nbytes for g in grams)
    tracemalloc.start()
    absorb(grams, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 4 * size
