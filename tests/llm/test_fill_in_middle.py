"""Fill-in-middle against slices of the text, and back."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import queries as Q
from tidemark.llm.fill_in_middle import (SENTINELS, checked, exchange, fill_in_middle, line_ends, n_chars, rearranged,
                                         restored, restored_texts)

SF_DIR = "/root/testdata/sf0.01"
MARKS = [mark.encode() for mark in SENTINELS]
TEXTS = st.text(st.sampled_from("ab<P>SM \n\r\x00é漢\U0001d538"), max_size=40)


def plain(doc_id, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(m in text for m in SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.binary(max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_blocks_are_exchanged_in_place(data, a, b):
    start, middle = sorted((min(a, len(data)), min(b, len(data))))
    buffer = np.frombuffer(bytearray(data), np.uint8)
    exchange(buffer, start, middle, len(data))
    assert buffer.tobytes() == data[:start] + data[middle:] + data[start:middle]


@settings(max_examples=300)
@given(TEXTS, st.data())
def test_round_trip(text, data):
    raw = text.encode()
    ends = [0, *line_ends(raw).tolist()]
    assert len(ends) - 1 == len(re.findall(r"[^\n]*\n|[^\n]+", text)) and n_chars(raw) == len(text)
    if any(mark in text for mark in SENTINELS):
        return
    first, second = sorted((data.draw(st.sampled_from(ends)), data.draw(st.sampled_from(ends))))
    prefix, middle, suffix = raw[:first], raw[first:second], raw[second:]
    assert rearranged(raw, first, second, "psm", MARKS) == b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle
    assert rearranged(raw, first, second, "spm", MARKS) == b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle
    for form in ("psm", "spm"):
        assert restored(rearranged(raw, first, second, form, MARKS), form, MARKS) == raw


def test_blocks_longer_than_the_scratch():
    raw = np.random.default_rng(1).integers(97, 123, 1_000_003, dtype=np.uint8).tobytes()
    out = rearranged(raw, 200_001, 700_000, "psm", MARKS)
    assert out == b"<P>" + raw[:200_001] + b"<S>" + raw[700_000:] + b"<M>" + raw[200_001:700_000]
    assert restored(out, "psm", MARKS) == raw


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 40, "suffix_first": 100}])
def test_odd_rows_against_slices(odd_documents, options):
    rows = restored_texts(fill_in_middle(odd_documents, **options)).collect()
    given_rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    wanted = sorted(((i, *plain(i, text, **options), text or "") for i, text in given_rows), key=repr)
    assert sorted((tuple(r) for r in rows), key=repr) == wanted


def test_sentinels_in_the_text(documents):
    rows = fill_in_middle(documents((1, "a\n<S>\nb"), (2, "<P"), (3, "M>\n<"))).collect()
    assert {r["id"]: r["form"] == "plain" for r in rows} == {1: True, 2: False, 3: False}


def test_empty_table(documents):
    assert restored_texts(fill_in_middle(documents())).collect() == []


def test_sentinels_that_could_be_confused():
    for bad in (("<P>", "<P>x", "<M>"), ("<P>", "<<S", "<M>"), ("a", "b", "c"), ("<P>", "<P>", "<M>"), ("", "", "")):
        with pytest.raises(ValueError):
            checked(bad)


def test_query_restores_every_text(spark):
    rows = Q.op13_fill_in_middle(spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(rows) == len(docs) and {r["form"] for r in rows} >= {"psm", "spm"}
    for r in rows:
        n, form, prefix, middle, output = plain(r["doc_id"], docs[r["doc_id"]])
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        assert tuple(r)[1:] == (n, form, prefix, middle, sha(output), sha(docs[r["doc_id"]] or ""))
