"""A Merkle manifest of a table, by time-forward processing.

Every row is a leaf, every 16 consecutive nodes of a source become one, down to one
``subroot`` per source; the subroots, in the order of their sources, become one ``root``
in the same way. A leaf's proof is the digests beside its path.

A node is labelled (tree, level, index). The sweep visits nodes in the order of their
labels and sends each digest forward to the label of its parent, through a priority queue
that gives a node all its messages when its turn comes. The queue is external: what a node
receives from another block of 256 nodes is a row that Spark shuffles and sorts by label,
and only messages inside a block, two levels of the tree, wait in memory. So a task holds
one block whatever the size of a source, and a source of n rows takes log256(n) rounds,
each 256 times smaller than the one before. A second sweep takes the labels in reverse:
a node receives the siblings of all its ancestors, adds its children's own siblings, and
sends the longer proof on, until it reaches the leaves. Each round is a written table, so
lost executors cost a task, not the sweep.

Places of leaves come from one range shuffle by (source, doc_id, digest): a place in the
sorted partition plus the rows of the same source in earlier partitions. Digests, not
texts, are shuffled.

Null is written as ``-``, so it differs from an empty value. A null source is a source,
the first; null ids come first in it. Rows with equal ids are ordered by their digests;
rows equal in everything are leaves of their own with equal digests. An empty table has no
leaf and no root. Long texts are hashed where they are read. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import string
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paritas.session import written

#: Children of a node, and the levels between a block's nodes and its top.
FAN, DEPTH = 16, 2
BLOCK = FAN**DEPTH
#: One in so many documents is presented tampered.
TAMPERED = 5

_PLACE_BITS = 33  # of monotonically_increasing_id


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    size = F.octet_length(text).cast("string")
    return F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a document with this text."""
    others = [_field(F.col(name)) for name in ("doc_id", "source", "lang", "n_chars")]
    return digest(*others, _field(text))


def _tampered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, shown): every document's digest, and the one it is presented
    with. One in five by crc32 of the id has the A-Z of its text in lower case."""
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    leaf = leaf_digest(F.col("text"))
    return rows.select(
        F.col("source").alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf.alias("digest"),
        F.when(hit, leaf_digest(_tampered(F.col("text")))).otherwise(leaf).alias("shown"),
    )


def placed(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``pos``, the place of a row within its ``tree`` in this order, and ``n``, the
    rows of the tree. However long a tree is, it is spread over the range's partitions."""
    keys = ["tree", *order]
    part = F.shiftright("_place", _PLACE_BITS)
    place = F.col("_place") - F.shiftleft("_part", _PLACE_BITS)
    ranged = written(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        name,
    ).withColumn("_part", part)
    # One row per partition and tree that begins or goes on in it.
    runs = ranged.groupBy("tree", "_part").agg(
        F.min(place).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    tree = W.partitionBy("tree")
    earlier = tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        F.col("tree").alias("_tree"),
        F.col("_part").alias("_in"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(tree).alias("n"),
    )
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_in"))
    return ranged.join(runs, same).select(
        *rows.columns, (place + F.col("_shift")).alias("pos"), "n"
    )


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sweep(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of a block by level, from its nodes, ``levels`` levels up.

    The queue holds (level, index, slot, digest), the label of the receiver first. A node
    has all its messages when its label is the least.
    """
    known = [digests, *([] for _ in range(levels))]
    queue = [(1, i // FAN, i % FAN, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        level, index = label = queue[0][:2]
        received = []
        while queue and queue[0][:2] == label:
            received.append(heapq.heappop(queue)[3])
        made = _hash("".join(received))
        known[level].append(made)
        if level < levels:
            heapq.heappush(queue, (level + 1, index // FAN, index % FAN, made))
    return known


def reverse_sweep(
    known: list[list[str]], before: list[str], after: list[str]
) -> list[tuple[list[str], list[str]]]:
    """What stands before and after the path of each node of a block, level by level from
    the node up to the root, given the same of the block's top.

    Labels are taken from the top down; each node sends its proof, lengthened by a
    child's siblings, to that child.
    """
    levels = len(known) - 1
    queue = [(-levels, 0, before, after)]
    proofs = []
    while queue:
        level, index, before, after = heapq.heappop(queue)
        if level == 0:
            proofs.append((before, after))
            continue
        first = index * FAN
        children = known[-level - 1][first : first + FAN]
        size = len(children[0])
        run = "".join(children)
        for slot in range(len(children)):
            lower = [run[: size * slot], *before], [run[size * (slot + 1) :], *after]
            heapq.heappush(queue, (level + 1, first + slot, *lower))
    return proofs


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[range]]]:
    """Sorted rows in tables that end with a block, and the rows of each block in them."""
    rest: pa.Table | None = None

    def blocks(table: pa.Table) -> list[range]:
        keys = zip(table["tree"].to_pylist(), table["block"].to_pylist(), strict=True)
        runs = [list(run) for _, run in groupby(enumerate(keys), lambda item: item[1])]
        return [range(run[0][0], run[-1][0] + 1) for run in runs]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        found = blocks(table)
        whole = found[-1].start
        if whole:
            yield table.slice(0, whole), found[:-1]
        rest = table.slice(whole)
    if rest is not None:
        yield rest, blocks(rest)


def _delivered(messages: DataFrame, order: Sequence[str]) -> DataFrame:
    """The external queue: messages in the order of the labels they go to, all of a block
    in one task."""
    return messages.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def raised(nodes: DataFrame) -> DataFrame:
    """The tops of the blocks of ``nodes (tree, pos, n, digest)``, in the same form. The
    one node of a tree stays."""
    kind = nodes.schema["tree"].dataType.simpleString()

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, blocks in _whole_blocks(batches):
            digests, sizes = table["digest"].to_pylist(), table["n"].to_pylist()
            first = [rows.start for rows in blocks]
            made, counts = [], []
            for rows in blocks:
                levels = min(DEPTH, height(sizes[rows.start]))
                made.append(sweep(digests[rows.start : rows.stop], levels)[-1][0])
                counts.append(-(-sizes[rows.start] // BLOCK))
            chosen = table.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    chosen["tree"].combine_chunks(),
                    chosen["block"].combine_chunks(),
                    pa.array(counts, pa.int64()),
                    pa.array(made, pa.string()),
                ],
                names=["tree", "pos", "n", "digest"],
            )

    rows = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest")
    return _delivered(rows, ["pos"]).mapInArrow(
        tops, f"tree {kind}, pos long, n long, digest string"
    )


def lowered(nodes: DataFrame, proofs: DataFrame) -> DataFrame:
    """Add ``before`` and ``after`` to ``nodes``, from ``proofs (tree, pos, before, after,
    ...)`` of their blocks' tops; further columns of ``proofs`` are handed down as well."""
    handed = [c for c in proofs.columns if c not in ("tree", "pos", "before", "after")]
    kept = [c for c in nodes.columns if c not in handed]
    schema = ", ".join(
        [
            *(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in kept),
            "before array<string>, after array<string>",
            *(f"`{c}` {proofs.schema[c].dataType.simpleString()}" for c in handed),
        ]
    )

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, blocks in _whole_blocks(batches):
            digests, sizes = table["digest"].to_pylist(), table["n"].to_pylist()
            above = {c: table[c] for c in ("before", "after", *handed)}
            before, after, sources, rows = [], [], [], []
            for block in blocks:
                # The message of the top stands before the nodes.
                top, first = block.start, block.start + 1
                known = sweep(digests[first : block.stop], min(DEPTH, height(sizes[first])))
                ends = (above[c][top].as_py() for c in ("before", "after"))
                for own_before, own_after in reverse_sweep(known, *ends):
                    before.append(own_before)
                    after.append(own_after)
                rows.extend(range(first, block.stop))
                sources.extend([top] * (block.stop - first))
            own = table.select(kept).take(pa.array(rows, pa.int64())).combine_chunks()
            tags = [above[c].take(pa.array(sources, pa.int64())) for c in handed]
            lists = [pa.array(x, pa.list_(pa.string())) for x in (before, after)]
            columns = [*own.columns, *map(pa.chunked_array, ([x] for x in lists)), *tags]
            names = [*kept, "before", "after", *handed]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()

    below = nodes.select(
        *kept, F.expr(f"pos div {BLOCK}").alias("block"), F.lit(1).alias("kind")
    )
    tops = proofs.withColumnRenamed("pos", "block").withColumn("kind", F.lit(0))
    both = below.unionByName(tops, allowMissingColumns=True)
    return _delivered(both, ["kind", "pos"]).mapInArrow(extended, schema)


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` and the tops of their blocks, until every tree has one node."""
    rounds = [nodes]
    while not rounds[-1].where("n > 1").isEmpty():
        rounds.append(written(raised(rounds[-1]), name))
    return rounds


def _proven(rounds: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """``rounds[0]`` with its proofs, from those of the single nodes of all trees."""
    proofs = tops
    for k in reversed(range(1, len(rounds))):
        if k < len(rounds) - 1:
            proofs = written(lowered(rounds[k], proofs).drop("n", "digest"), name)
    return lowered(rounds[0], proofs) if len(rounds) > 1 else _beside(rounds[0], tops)


def _beside(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The single nodes of all trees and their proofs."""
    other = tops.withColumnRenamed("tree", "_tree").drop("pos")
    return nodes.join(other, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")


def manifest(leaves: DataFrame, order: Sequence[str] = ("doc_id", "digest")) -> DataFrame:
    """``leaves (tree, digest, ...)`` with ``subroot``, ``root`` and the proof as the lists
    ``before`` and ``after``: what stands left and right of the path on each level."""
    nothing = F.array().cast("array<string>")
    nodes = written(placed(leaves, order, "merkle-sorted"), "merkle-leaves")
    rounds = _rounds(nodes, "merkle-nodes")
    # The subroots are the leaves of one more tree.
    subroots = rounds[-1].select("tree", F.col("digest"))
    upper = placed(
        subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest"),
        ["source"],
        "merkle-sources",
    )
    upper = _rounds(written(upper, "merkle-subroots"), "merkle-nodes")
    top = upper[-1].select(
        "tree", "pos", nothing.alias("before"), nothing.alias("after"), F.col("digest").alias("root")
    )
    proven = _proven(upper, top, "merkle-proofs").select(
        F.col("source").alias("tree"),
        F.lit(0).cast("long").alias("pos"),
        "before",
        "after",
        F.col("digest").alias("subroot"),
        "root",
    )
    return _proven(rounds, written(proven, "merkle-proofs"), "merkle-proofs").drop("pos", "n")


def _levels() -> Column:
    return F.arrays_zip("before", "after")


def folded(leaf: Column) -> Column:
    """The root that a digest and the proof beside it lead to."""
    return F.aggregate(
        _levels(), leaf, lambda d, level: digest(level["before"], d, level["after"])
    )


def proof_digest() -> Column:
    """The digest of all siblings on the way, left to right, from the leaf up."""
    runs = F.transform(_levels(), lambda level: F.concat(level["before"], level["after"]))
    return F.sha2(F.array_join(runs, ""), 256)


def verified_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of
    all documents, and whether the digest each is presented with leads to its root."""
    proven = manifest(document_leaves(docs))
    return proven.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest().alias("proof_sha256"),
        folded(F.col("shown")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
