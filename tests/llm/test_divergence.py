"""Source divergence against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.divergence import Trees, _shares, source_divergence, terms_of

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs=30, smoothing=5, top=50):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall((text or "").translate(FOLD))
        counts[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = []
    for lang in in_docs:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        groups = {s: c for (l, s), c in counts.items() if l == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + smoothing) // (n + smoothing * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


@given(st.text(st.sampled_from("aZ@[`{~9 \x00\x7féÉ漢İ"), max_size=30))
def test_terms(text):
    assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(text.translate(FOLD))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 20), st.integers(0, 2**32 - 1))
def test_trees_price_all_pairs(n_rows, n_terms, seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 3, (n_rows, n_terms)) * rng.integers(0, 2, n_terms)
    trees = Trees(counts)
    denominators = rng.integers(60, 1000, n_rows).tolist()
    prices = [_shares(trees.values, d, 5) for d in denominators]
    for a in range(n_rows):
        for b in range(n_rows):
            p = [[1 + 10**9 * (int(c) + 5) // denominators[r] for c in [*counts[r], 0]] for r in (a, b)]
            zero = abs(p[0][-1] - p[1][-1])
            wanted = sum(abs(x - y) - zero for x, y in zip(p[0][:-1], p[1][:-1]))
            assert trees.price(a, b, prices[a], prices[b]) == wanted


def test_equal_subtrees_are_one_node():
    trees = Trees(np.tile([1, 2, 3, 4], (50, 256)))
    assert trees.sizes[0] == 5 and trees.sizes[-1] == 2 and sum(trees.sizes[2:]) == 2 * len(trees.sizes[2:])


def test_counts_beyond_64_bits_when_scaled():
    values = np.array([0, 10**12])
    assert _shares(values, 10**13, 5).tolist() == [1 + 5 * 10**9 // 10**13, 1 + 10**9 * (10**12 + 5) // 10**13]


@pytest.mark.parametrize("options", [{}, {"block": 4, "chunk": 2}, {"block": 1, "chunk": 1, "top": 2}])
def test_random_groups(spark, options):
    random.seed(7)
    words = [f"w{chr(97 + i)}{'é' * (i % 3)}" for i in range(20)]
    rows = [(random.choice(["en", "fr", None, ""]), random.choice(["a", "b", "B", "é", None, ""]),
             " ".join(random.choices(words, [1 / (i + 1) for i in range(20)], k=random.randrange(15))))
            for _ in range(200)]
    rows += [("de", "x", None), ("de", "y", "once only"), ("it", "alone", "one " * 3)] + rows[:5]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n int, term int")
    found = source_divergence(docs, least_docs=8, **options)
    top = options.get("top", 50)
    assert sorted(map(tuple, found.collect())) == plain(rows, 8, top=top)


def test_odd_rows(spark, odd_documents):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_documents.collect()]
    found = source_divergence(odd_documents, least_docs=2)
    assert sorted(map(tuple, found.collect())) == plain(rows, 2)


def test_empty_table(documents):
    assert source_divergence(documents()).collect() == []
