"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered, so case and
punctuation do not hide a passage. A seed is a run of ``MATCH`` words. Documents and
benchmark items that share a seed are joined; then the longest runs of words that both
have and no earlier tile covers are marked, again and again, by running Karp-Rabin, down
to runs of ``MATCH`` words. Tiles may lie anywhere in the document, so a reordered
passage is covered too. A document is contaminated by an item when tiles cover
``COVERAGE`` of the item's words or more.

Documents drop the words that no benchmark seed covers before anything is shuffled: a
Bloom filter of fixed size over all seeds finds them. More seeds than it was made for
let more words through, never fewer.

Null and empty texts share nothing. Items of fewer than ``MATCH`` words have no seed and
contaminate nothing. Repeated items and rows are compared once each; a document without
an id is reported with a null id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm import texts
from paritas.session import written

MATCH = 5
COVERAGE = 0.5
#: Bits of the filter over seeds; its size does not depend on the data.
FILTER_BITS = 1 << 23
#: Parts that the documents sharing one seed or item are dealt into.
SALTS = 16

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_WORD[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _hashed(piece: texts.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice, and each text's range of them."""
    data = texts.lowered(piece.data)
    starts, ends = texts.runs(_WORD[data], piece.offsets)
    return texts.substring_hashes(data, starts, ends), np.searchsorted(starts, piece.offsets)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in texts.slices(batch["text"]):
            hashes, ranges = _hashed(piece)
            seeds, owner, _ = texts.ngrams(hashes, ranges, MATCH)
            cuts = np.searchsorted(owner, np.arange(piece.rows + 1))
            signed, seeds = hashes.view(np.int64), seeds.view(np.int64)
            yield pa.record_batch(
                [
                    batch["item_id"].slice(piece.first, piece.rows),
                    pa.ListArray.from_arrays(ranges.astype(np.int32), signed),
                    pa.ListArray.from_arrays(cuts.astype(np.int32), seeds),
                ],
                names=["item_id", "words", "seeds"],
            )


def item_table(items: DataFrame) -> DataFrame:
    """(item_id, item_print, words, seeds) of every item that has a seed, written; equal
    words have an equal print."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = rows.mapInArrow(_item_rows, "item_id long, words array<long>, seeds array<long>")
    found = found.where(F.size("seeds") > 0).withColumn("item_print", F.xxhash64("words"))
    return written(found.distinct(), "items")


def _slots(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of every seed."""
    last = np.uint64(FILTER_BITS - 1)
    return seeds & last, (seeds >> np.uint64(32)) & last


def seed_filter(items: DataFrame) -> np.ndarray:
    """One byte per eight filter bits; the driver gets at most one row per 64 bits."""
    seed = items.select(F.explode("seeds").alias("seed"))
    slots = seed.select(
        F.explode(
            F.array(
                F.col("seed").bitwiseAND(FILTER_BITS - 1),
                F.shiftrightunsigned("seed", 32).bitwiseAND(FILTER_BITS - 1),
            )
        ).alias("slot")
    )
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out.view(np.uint8)


def _seen(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def seeded_words(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, print, at, words, seeds): the words that a benchmark seed may cover, where
    they stand, and the seeds; only documents that have any."""
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(items))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in texts.slices(batch["text"]):
                hashes, ranges = _hashed(piece)
                seeds, owner, first = texts.ngrams(hashes, ranges, MATCH)
                one, two = _slots(seeds)
                hit = np.flatnonzero(_seen(bits.value, one) & _seen(bits.value, two))
                if not len(hit):
                    continue
                rows = np.unique(owner[hit])
                word = np.unique((first[hit][:, None] + np.arange(MATCH)).ravel())
                words = np.searchsorted(word, ranges)
                found = np.searchsorted(owner[hit], np.arange(piece.rows + 1))
                part = batch.slice(piece.first, piece.rows).take(pa.array(rows))
                cut = lambda at, rows=rows: np.append(at[rows], at[-1]).astype(np.int32)
                at = (word - ranges[texts.owners(words)]).astype(np.int64)
                signed = hashes[word].view(np.int64)
                yield pa.record_batch(
                    [
                        part["doc_id"],
                        part["print"],
                        pa.ListArray.from_arrays(cut(words), at),
                        pa.ListArray.from_arrays(cut(words), signed),
                        pa.ListArray.from_arrays(cut(found), seeds[hit].view(np.int64)),
                    ],
                    names=["doc_id", "print", "at", "words", "seeds"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text"
    )
    return written(
        rows.mapInArrow(
            covered,
            "doc_id long, print long, at array<long>, words array<long>, seeds array<long>",
        ),
        "seeded-words",
    )


def _windows(words: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Hash and first place of every run of ``length`` free words; the hash rolls on."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top = pow(base, length - 1, modulus)
    value = held = 0
    for i, word in enumerate(words):
        if not free[i]:
            value = held = 0
            continue
        if held == length:
            value -= words[i - length] * top
            held -= 1
        value = (value * base + word) % modulus
        held += 1
        if held == length:
            yield value, i - length + 1


def tiles(
    item: list[int], text: list[int], at: list[int], minimum: int = MATCH
) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the tiles, longest first.

    ``text`` are words standing at ``at`` in the document; a gap ends a match. Of equally
    long matches the first in the item, then the first in the text is marked.
    """
    words, place = [], []
    for i, word in enumerate(text):
        if i and at[i] != at[i - 1] + 1:
            words.append(0)
            place.append(-1)
        words.append(word)
        place.append(at[i])
    free_item, free_text = [True] * len(item), [p >= 0 for p in place]
    out: list[tuple[int, int, int]] = []
    length = max(minimum, len(item))
    while True:
        where: dict[int, list[int]] = {}
        for value, j in _windows(words, free_text, length):
            where.setdefault(value, []).append(j)
        matches = []
        for value, i in _windows(item, free_item, length):
            for j in where.get(value, ()):
                n = 0
                while (
                    i + n < len(item)
                    and j + n < len(words)
                    and free_item[i + n]
                    and free_text[j + n]
                    and item[i + n] == words[j + n]
                ):
                    n += 1
                if n >= length:
                    matches.append((-n, i, j))
        overlapping = False
        for n, i, j in sorted(matches):
            if all(free_item[i : i - n]) and all(free_text[j : j - n]):
                free_item[i : i - n] = [False] * -n
                free_text[j : j - n] = [False] * -n
                out.append((i, place[j], -n))
            else:
                overlapping = True
        if overlapping:
            continue  # what a tile left of a match may still be long enough
        if length == minimum:
            return out
        length = max(minimum, length // 2)


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            found = tiles(row["item"], row["words"], row["at"])
            lengths = [n for _, _, n in found]
            rows.append((len(found), max(lengths, default=0), sum(lengths), len(row["item"])))
        counts = [pa.array([row[i] for row in rows], pa.int64()) for i in range(4)]
        yield pa.record_batch(
            [batch["doc_id"], batch["print"], batch["item_id"], *counts],
            names=["doc_id", "print", "item_id", "n_tiles", "longest", "covered", "item_words"],
        )


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, print, item_id, n_tiles, longest, covered, item_words, coverage) of every
    document and item whose coverage reaches the threshold; ``print`` is the hash of the
    document's text."""
    listed = item_table(items)
    found = seeded_words(docs, listed)
    salt = F.pmod(F.xxhash64("print", "doc_id"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = found.select("doc_id", "print", F.explode("seeds").alias("seed")).distinct()
    seeds = listed.select("item_print", F.explode("seeds").alias("seed")).distinct()
    pairs = (
        asked.withColumn("salt", salt)
        .join(seeds.withColumn("salt", every), ["seed", "salt"])
        .select("doc_id", "print", "item_print", "salt")
        .distinct()
    )
    texts_ = found.groupBy("doc_id", "print").agg(
        F.first("at").alias("at"), F.first("words").alias("words")
    )
    same_id = pairs["doc_id"].eqNullSafe(texts_["doc_id"])
    met = (
        pairs.join(texts_, same_id & (pairs["print"] == texts_["print"]))
        .select(pairs["doc_id"], pairs["print"], "item_print", "salt", "at", "words")
        .join(
            listed.select("item_id", "item_print", F.col("words").alias("item")).withColumn(
                "salt", every
            ),
            ["item_print", "salt"],
        )
        .select("doc_id", "print", "item_id", "at", "words", "item")
    )
    return (
        met.mapInArrow(
            _tiled,
            "doc_id long, print long, item_id long, n_tiles long, longest long, covered long, "
            "item_words long",
        )
        .withColumn("coverage", F.col("covered") / F.col("item_words"))
        .where(F.col("coverage") >= coverage)
    )


def keep_clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    bad = contaminated(docs, items, coverage).select(
        F.col("doc_id").alias("bad_id"), F.col("print").alias("bad_print")
    )
    bad = written(bad.distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(F.col("bad_id")) & (
        F.xxhash64(docs["text"]) == F.col("bad_print")
    )
    return docs.join(bad, same, "left_anti")
