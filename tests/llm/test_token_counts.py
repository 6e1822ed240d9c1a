"""Token counts against the model's own library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paritas.llm import token_counts
from paritas.llm.queries import op12_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    return token_counts.load(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [
        len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)
    ]


def mixed(n):
    """Texts of what word patterns tell apart, in every order."""
    parts = [
        *("a", "b", "é", "the", "ing", "中", "՘", "\U000323b0", "́", "😀"),
        *("1", "٣", "²", "!", "--", "'s", "'ll", "'S", "<|", "<|endoftext|>"),
        *(" ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "​", "﻿"),
    ]
    chosen = random.Random(3)
    return ["".join(chosen.choices(parts, k=chosen.randrange(24))) for _ in range(n)]


def test_mixed_texts(merges, library):
    texts = mixed(20_000)
    counter = token_counts.Counter(merges)
    assert [counter.count(t) for t in texts] == library(texts)


def test_stretches_change_nothing(merges, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 3)
    texts = mixed(5_000)
    counter = token_counts.Counter(merges)
    assert [counter.count(t) for t in texts] == library(texts)


def test_full_memory_changes_nothing(merges, library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    texts = mixed(2_000)
    counter = token_counts.Counter(merges)
    assert [counter.count(t) for t in texts] == library(texts)
    assert len(counter.words) <= 2 and len(counter.runs) <= 2


def test_newer_letters_are_no_letters(merges, library):
    texts = [f"a{c}1 {c}{c}b" for c in merges.unknown[::7]]
    counter = token_counts.Counter(merges)
    assert [counter.count(t) for t in texts] == library(texts)


def test_words_without_end(merges, library):
    texts = ["ab" * 100_000, "x" * 70_001, "qzjv" * 30_000, "中" * 50_000, " " * 100_000]
    counter = token_counts.Counter(merges)
    assert [counter.count(t) for t in texts] == library(texts)


def test_ties_go_to_the_left():
    """Of two overlapping pairs of one rank the left one is merged."""
    a = ord("a")
    merges = token_counts.Merges({a << 32 | a: 0, 256 << 32 | 256: 1}, [256, 257], (), "")
    assert [len(b"a" * n) - token_counts.merges_in(b"a" * n, merges) for n in range(9)] == [
        0, 1, 1, 2, 1, 2, 2, 3, 2,
    ]


def test_nulls_empties_repeats_and_clashes(spark, merges):
    rows = [(1, None, 7), (2, "", 7), (3, "one two", 7), (3, "one two", 7), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = token_counts.with_token_counts(docs, merges, limit=1)
    assert sorted(map(tuple, found.select("n_bytes", "n_tokens", "over_limit").collect())) == [
        (0, 0, False), (0, 0, False), (1, 1, False), (7, 2, True), (7, 2, True),
    ]
    assert token_counts.document_token_counts(docs.limit(0), merges).count() == 0


def test_bytes_that_are_no_utf8(spark, merges, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    (row,) = token_counts.document_token_counts(docs, merges).collect()
    assert (row.n_bytes, row.n_tokens) == (3, library(["a�b"])[0])


def test_documents(spark, small, library):
    found = op12_token_counts(spark, small)
    assert found.columns == ["doc_id", "n_tokens", "n_bytes", "over_limit"]
    rows = {r.doc_id: r for r in found.collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    counts = library([d.text or "" for d in docs])
    assert len(rows) == len(docs)
    for doc, count in zip(docs, counts, strict=True):
        size = len((doc.text or "").encode())
        assert tuple(rows[doc.doc_id])[1:] == (count, size, count > 512)


def test_plan_has_no_shuffle(spark, small, merges):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = token_counts.document_token_counts(docs, merges)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
