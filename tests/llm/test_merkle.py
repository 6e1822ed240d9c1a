"""The Merkle manifest against a plain tree, built level by level in one list."""

import hashlib
import zlib

import duckdb
import pytest

from paritas.llm import merkle
from paritas.llm.merkle_sql import manifest_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha(*map(field, (row[0], row[3], row[2], row[4], text)))


def folding(nodes):
    """The top of a list of nodes, and each node's siblings as (before, after) pairs."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, spot in zip(paths, spots, strict=True):
            run, at = runs[spot // 16], spot % 16
            path.append(("".join(run[:at]), "".join(run[at + 1 :])))
        spots = [spot // 16 for spot in spots]
        nodes = [sha(*run) for run in runs]
    return nodes[0], paths


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        members = sorted(
            sources[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))
        )
        trees[source] = members, *folding([leaf(r, r[1]) for r in members])
    root, upper = folding([trees[s][1] for s in order]) if order else ("", [])
    found = []
    for source, above in zip(order, upper, strict=True):
        members, subroot, paths = trees[source]
        for row, path in zip(members, paths, strict=True):
            path = path + above
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(b"%d" % row[0]) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(row, text)
            for before, after in path:
                fold = sha(before, fold, after)
            proof = sha(*(b + a for b, a in path))
            found.append(
                (row[0], leaf(row, row[1]), subroot, root, proof, fold, fold == root)
            )
    return sorted(found, key=repr)


def result(docs):
    return sorted(map(tuple, merkle.verified_documents(docs).collect()), key=repr)


def rows_of(n, source):
    return [(i, f"Text {i} É", "de" if i % 3 else None, source, i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 272, 273, 1100])
def test_sizes_around_runs_and_blocks(spark, n):
    rows = rows_of(n, "a") + rows_of(3, "B") + rows_of(1, None)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_more_rounds(spark, monkeypatch):
    """Blocks of one level, so every level is a round of its own."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = rows_of(300, "a") + [(i, "T", None, f"s{i}", None) for i in range(40)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nulls_empties_ties_repeats_and_order_of_sources(spark):
    rows = [
        (1, "Same", "en", "s", 4), (1, "Same", "en", "s", 4), (1, "Other", "en", "s", 5),
        (None, "No id", "en", "s", None), (None, None, None, None, None),
        (5, "", "", "", 0), (10, "ABC", None, "é", 3), (11, "abc", "en", "z", 3),
        (-7, "Negative", "en", "Z", 3), (10**12, "A" * 300_000, "en", "😀", 3),
    ]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    rows = rows_of(20, "a")
    docs = spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows], f"{SCHEMA}, pos int, root string, tree int"
    )
    assert result(docs) == brute(rows)


def test_documents_and_sql(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = list(map(tuple, docs.select(*names).collect()))
    expected = brute(rows)
    assert result(docs) == expected
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    assert sorted(con.execute(manifest_sql()).fetchall(), key=repr) == expected


def test_an_uppercase_letter_breaks_the_proof(spark):
    """Ids whose crc32 five divides are tampered; without A-Z that changes nothing."""
    hit = [i for i in range(50) if zlib.crc32(b"%d" % i) % 5 == 0]
    rows = [(i, "ÉÀ ab" if i == hit[0] else "Ab", "en", "s", 2) for i in range(50)]
    found = merkle.verified_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in found if not r.verified} == set(hit[1:])


def test_sweeps():
    known = merkle.sweep([str(i) for i in range(18)], 2)
    assert [len(level) for level in known] == [18, 2, 1]
    proofs = merkle.reverse_sweep(known, ["x"], ["y"])
    assert proofs[17] == (["16", known[1][0], "x"], ["", "", "y"])
    assert merkle.sweep(["a"], 0) == [["a"]]
    assert merkle.reverse_sweep([["a"]], [], []) == [([], [])]
