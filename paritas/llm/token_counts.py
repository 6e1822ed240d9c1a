"""Token counts: byte-pair merging with a heap of pairs and a linked list of symbols.

A word starts as its bytes, one symbol each, in a doubly linked list. A heap holds every
adjacent pair that has a rank, lowest rank first and of equal ranks the leftmost. The
lowest pair is popped and, if its two symbols still are what they were, becomes one
symbol; the pairs it forms with its neighbours are pushed. A word of n bytes takes
O(n log n) steps whatever it holds, and has as many tokens as it had bytes less the
merges. No identifier is made.

A text is first cut at the special strings of the model, which are one token each, and
what lies between into words by the model's pattern. Blanks before a word belong to it,
so a text without odd blanks is cut at them and each blank-to-blank run is counted once
and remembered; the table of remembered runs is emptied when it is full. Other texts are
matched whole, a stretch at a time.

Only the merges of the model file are used, read on the driver and broadcast; they are as
many as the file lists, whatever the corpus. What counts as a letter or a digit must be
what it is to the model's library, whose Unicode version may be older than the pattern
matcher's; characters on which they differ are found when the model is loaded.

Null and empty texts have no tokens. Very long texts are matched in stretches that end
before a blank; a text without any is one word or few, which the heap takes in linear
memory. Repeated rows are counted each, in a table without rows nothing is. Bytes that
are no UTF-8 count as the replacement character. Columns of the names ``n_bytes``,
``n_tokens`` or ``over_limit`` are replaced by :func:`with_token_counts`.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens beyond which a document is over the limit of the query.
LIMIT = 512
#: Runs remembered by one worker, and the longest that is worth it.
REMEMBERED, LONGEST = 1 << 19, 64
#: Characters of a text that are matched at a time, if it has blanks.
STRETCH = 1 << 20

# Fixed value: the pattern of byte-level byte-pair models, with letters and digits to fill in.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+"
)

_BITS = 32
_MASK = (1 << _BITS) - 1


@dataclass(frozen=True)
class Merges:
    """What a model file says: symbols are numbered, the bytes from 0 to 255 first."""

    #: Rank of a pair, by ``left << 32 | right``.
    ranks: dict[int, int]
    #: The symbol that a rank's merge makes.
    made: list[int]
    #: Strings that are one token wherever they stand.
    special: tuple[str, ...]
    #: Letters and digits of newer Unicode versions, which the library does not know.
    unknown: str


def byte_letters() -> list[str]:
    """The letter by which a byte-level model file writes each byte: printable bytes of
    Latin-1 stand for themselves, the others for the letters from 256 on."""
    letters, n = [], 0
    for byte in range(256):
        shown = 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte <= 0xFF
        letters.append(chr(byte if shown else 256 + n))
        n += not shown
    return letters


def _unknown(pre_tokenizer) -> str:
    """Characters that only the pattern matcher takes for letters or digits.

    Those that Python's own tables know are known to the library; for the few newer ones
    it is asked whether they join a letter or a digit.
    """
    known = regex.compile(r"[\p{L}\p{N}]")
    found = []
    for code in range(0x110000):
        letter = chr(code)
        if unicodedata.category(letter) != "Cn" or not known.match(letter):
            continue
        kin = "a" if regex.match(r"\p{L}", letter) else "1"
        if len(pre_tokenizer.pre_tokenize_str(kin + letter)) > 1:
            found.append(letter)
    return "".join(found)


def load(path: str | None = None) -> Merges:
    """The merges of a byte-level byte-pair model file, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, added = content["model"], content["added_tokens"]
    plain = content["pre_tokenizer"] or {}
    if (
        plain.get("type") != "ByteLevel"
        or plain.get("add_prefix_space")
        or not plain.get("use_regex", True)
        or content["normalizer"]
        or model["ignore_merges"]
        or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
    ):
        raise ValueError(f"{path} is no plain byte-level model")
    symbols = {letter: byte for byte, letter in enumerate(byte_letters())}
    ranks, made = {}, []
    for rank, (left, right) in enumerate(model["merges"]):
        made.append(symbols.setdefault(left + right, len(symbols)))
        ranks[symbols[left] << _BITS | symbols[right]] = rank
    special = sorted((a["content"] for a in added), key=len, reverse=True)
    return Merges(ranks, made, tuple(special), _unknown(Tokenizer.from_file(path).pre_tokenizer))


def merges_in(word: bytes, merges: Merges) -> int:
    """How many merges the symbols of a word go through."""
    n = len(word)
    if n < 2:
        return 0
    ranks, made = merges.ranks, merges.made
    symbol = list(word)
    before = list(range(-1, n - 1))
    after = list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbol[i] << _BITS | symbol[i + 1])
        if rank is not None:
            heap.append(rank << _BITS | i)
    heapq.heapify(heap)
    merged = 0
    while heap:
        entry = heapq.heappop(heap)
        rank, i = entry >> _BITS, entry & _MASK
        j = after[i]
        # A symbol that is gone is -1, and so no pair.
        if j == n or symbol[i] < 0 or ranks.get(symbol[i] << _BITS | symbol[j]) != rank:
            continue
        symbol[i], symbol[j] = made[rank], -1
        merged += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(symbol[i] << _BITS | symbol[k])
            if rank is not None:
                heapq.heappush(heap, rank << _BITS | i)
        h = before[i]
        if h >= 0:
            rank = ranks.get(symbol[h] << _BITS | symbol[i])
            if rank is not None:
                heapq.heappush(heap, rank << _BITS | h)
    return merged


class _Words(dict):
    """Tokens of a word, counted when first asked for."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> int:
        content = word.encode()
        count = len(content) - merges_in(content, self.merges)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count


class _Runs(dict):
    """Tokens of a run between blanks, the blank before it included."""

    def __init__(self, counter: Counter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, run: str) -> int:
        # A run of letters alone is one word.
        word = " " + run
        count = self.counter.words[word] if run.isalpha() else self.counter.matched(word)
        if len(run) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = count
        return count


class Counter:
    """Counts the tokens of texts; remembers words it has met."""

    def __init__(self, merges: Merges) -> None:
        def pattern(unknown: str) -> regex.Pattern:
            less = f"--[{regex.escape(unknown)}]" if unknown else ""
            letter, digit = (rf"[\p{{{kind}}}{less}]" for kind in "LN")
            filled = PATTERN.format(letter=letter, digit=digit, letters=letter, digits=digit)
            return regex.compile(filled, regex.V1)

        self.usual, self.careful = pattern(""), pattern(merges.unknown)
        self.newer = frozenset(merges.unknown)
        special = "|".join(map(regex.escape, merges.special))
        self.special = regex.compile(special) if special else None
        self.blank = regex.compile(r"(?<=\S)\s")
        #: A blank that no word follows.
        self.odd = regex.compile(r" (?:\s|$)")
        self.words = _Words(merges)
        self.runs = _Runs(self)

    def _stretches(self, text: str) -> Iterator[str]:
        """Parts of a text that end before a blank after a word, where words end too."""
        first = 0
        while len(text) - first > STRETCH:
            cut = self.blank.search(text, first + STRETCH)
            if cut is None:
                break
            yield text[first : cut.start()]
            first = cut.start()
        yield text[first:] if first else text

    def matched(self, text: str) -> int:
        """Tokens of a text without special strings, from the words of the pattern."""
        usual = text.isascii() or self.newer.isdisjoint(text)
        words = (self.usual if usual else self.careful).findall(text)
        return sum(map(self.words.__getitem__, words))

    def count(self, text: str) -> int:
        """Tokens of a text."""
        total = 0
        parts = [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total += len(parts) - 1
        for part in parts:
            for stretch in self._stretches(part):
                if self.odd.search(stretch):
                    total += self.matched(stretch)
                else:
                    first, *runs = stretch.split(" ")
                    total += self.matched(first) + sum(map(self.runs.__getitem__, runs))
        return total


#: The counter of this worker, with what it remembers from task to task.
_kept: list[Counter] = []


def _counter(merges: Merges) -> Counter:
    if not _kept or _kept[0].words.merges is not merges:
        _kept[:] = [Counter(merges)]
    return _kept[0]


def token_count(text: Column, merges: Merges, spark: SparkSession) -> Column:
    """The number of tokens of a text column."""
    shared = spark.sparkContext.broadcast(merges)

    @F.arrow_udf("long")
    def counted(column: pa.Array) -> pa.Array:
        count = _counter(shared.value).count
        return pa.array(
            [count(t.as_py().decode("utf-8", "replace")) if t.is_valid else 0 for t in column],
            pa.int64(),
        )

    return counted(text.cast("binary"))


def with_token_counts(
    docs: DataFrame, merges: Merges, text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """The documents with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    counted = docs.withColumn("n_tokens", token_count(F.col(text), merges, docs.sparkSession))
    return counted.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "over_limit": F.col("n_tokens") > limit,
        }
    )


def document_token_counts(docs: DataFrame, merges: Merges, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_token_counts(rows, merges, limit=limit).drop("text")
