"""Each stage of the pipeline against a plain version over its own input."""

from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from tidemark.llm import queries as Q, stages
from tidemark.llm.common import saved, table
from tidemark.llm.mixing import mix_plan
from tests.llm.test_corpus_operators import WORD, slow_components
from tests.llm.test_text_operators import slow_base

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passed(spark):
    docs = [table(spark, SF_DIR, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(saved(stage(spark, docs[-1], SF_DIR), name))
    return docs


def test_all_but_the_last_keep_the_columns(passed):
    for docs in passed[1:-1]:
        assert docs.columns == passed[0].columns and docs.count() > 0


def test_quality(spark, passed):
    kept = {r.doc_id for r in passed[1].collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF_DIR, "labels").collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.93 * len(right)
    assert passed[1].exceptAll(passed[0]).count() == 0


def test_one_of_each_group_stays(passed):
    rows = [(r.doc_id, r.text) for r in passed[1].collect()]
    expected = {name for _, _, name in slow_components(rows)}
    assert Counter(r.doc_id for r in passed[2].collect()) == Counter(expected)
    assert passed[2].exceptAll(passed[1]).count() == 0


def test_no_secret_stays(passed):
    expected = [r for r in passed[2].collect() if not slow_base(r.text)]
    assert sorted(passed[3].collect()) == sorted(expected)


def test_the_mix_meets_its_plan(passed):
    taken = {r.id: r.taken for r in mix_plan(passed[3]).collect() if r.taken}
    words = defaultdict(int)
    for r in passed[4].collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == taken


def test_pieces(passed):
    library = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    expected = Counter((r.doc_id, tuple(library.encode(r.text))) for r in passed[4].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in passed[5].collect()) == expected


def test_run_is_the_stages_in_order(spark, passed):
    found = corpus_pipeline.run(spark, SF_DIR)
    key = lambda d: sorted((r.doc_id, r.n_tokens) for r in d.select("doc_id", "n_tokens").collect())
    assert key(found) == key(passed[5])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd_documents, name, stage):
    found = stage(spark, odd_documents, SF_DIR)
    if name != "pieces":
        assert found.columns == odd_documents.columns
    found.collect()
    assert stage(spark, odd_documents.filter("false"), SF_DIR).collect() == []


def test_repeated_rows_leave_one(documents, spark):
    a = " ".join(f"a{i}" for i in range(40))
    docs = documents((1, a), (1, a), (2, a), (None, a), (None, None), (None, None), (3, None), (4, ""))
    kept = stages.keep_one_of_similar(spark, docs, SF_DIR)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, a), (None, a), (None, None), (3, None), (4, "")])


def test_an_id_with_two_texts_counts_by_text(documents, spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    kept = stages.keep_one_of_similar(spark, documents((1, a), (1, b), (0, b), (5, a)), SF_DIR)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, b), (1, a)]


def test_survivor_does_not_depend_on_the_order_of_rows(documents, spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a, source) for source in ("x", "y", None, "z", "")] + [(1, a + " more", "q"), (2, a, "w")]
    kept = [stages.keep_one_of_similar(spark, documents(*order).repartition(n), SF_DIR).collect()
            for order, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0].doc_id == 1
