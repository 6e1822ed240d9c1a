"""The trie of conversations that share their first turns, by Z-fast tries.

A Z-fast trie is a compacted trie, whose nodes stand where conversations part or end. A
node covers the depths from below its parent's to its own, and is found in a hash table by
its handle: the prefix whose depth, of those it covers, two divides most often. Where a
conversation leaves the trie is found by fat binary search, a look-up for each bit of its
length. A batch is located first and then inserted, each conversation from where it was
located downwards. In the end every edge is expanded to one node per depth.

Equal conversations are one class before that. Classes are sorted by their turns into
ranges, and each task builds the trie of its range, so a task holds a range whatever first
turn, or first thousand turns, most conversations share. Only the paths of a range's first
and last conversation can have nodes in other ranges. These border nodes come out of each
task as partial counts, are summed up by the hash of their prefix, and the small tree they
form gets its subtree sums from the same paths: a border node is counted on one of the
paths that hold it, and each path hands its running sums to all nodes on it.

The members of a class are sorted, too, into runs of ids that are written out as text;
runs are then hashed one after the other, so a class may hold a third of all conversations.
A turn is known by 128 bits of its SHA-256, a prefix by as many of its turns. What is
gathered in one place is a conversation's turns, as hashes and sizes: about 50 bytes each.

Turns are taken in the order of ``turn``, null first, and of equal numbers by their hashes.
Repeated rows are repeated turns. A null role or text is empty; an empty turn is a turn.
Rows without a conversation are left out. An empty table has no node, not even a root.
Long texts are hashed where they are read. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paritas.session import written

#: Conversations with one base, and the lengths of what they take from it.
BASE_OF, SHARED = 5, 9
#: Turns of the conversations in one range.
TURNS_PER_RANGE = 200_000
#: Ids in one run of a class.
RUN = 20_000

#: The hash over the ids of no conversation.
NO_ENDS = hashlib.sha256(b"").hexdigest()

_DIGEST = 32  # hex digits


def _turn_digest(role: Column, text: Column) -> Column:
    size = F.octet_length(role).cast("string")
    return F.substring(F.sha2(F.concat(size, F.lit(":"), role, text), 256), 1, _DIGEST)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as hash and bytes of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            "turn",
            _turn_digest(role, text).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).alias("turn"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, digests, bytes): every conversation c, its first turns taken from the
    conversation c - c % 5. How many is its crc32 modulo 9, fewer if that is shorter."""
    own = written(turn_lists(conversations), "trie-turns")
    base = own.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_turns"))
    none = F.array().cast(own.schema["turns"].dataType)
    shared = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    first = F.slice(F.coalesce("_turns", none), F.lit(1), shared)
    rest = F.slice("turns", shared + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = (
        own.join(base, F.col("conv_id") - F.col("conv_id") % BASE_OF == F.col("_base"), "left")
        .select("conv_id", F.concat(first, rest).alias("turns"))
    )
    return turns.select(
        "conv_id", F.col("turns.digest").alias("digests"), F.col("turns.bytes").alias("bytes")
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) as runs of ids of one key."""
    key, ids = None, []

    def run() -> pa.RecordBatch:
        joined = ",".join(map(str, ids))
        return pa.RecordBatch.from_pydict(
            {"key": [key], "first": [ids[0]], "n": [len(ids)], "ids": [joined]}
        )

    for batch in batches:
        for next_key, conv_id in zip(*(batch[c].to_pylist() for c in ("key", "conv_id")), strict=True):
            if ids and (next_key != key or len(ids) == RUN):
                yield run()
                ids = []
            key = next_key
            ids.append(conv_id)
    if ids:
        yield run()


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as (conv_id, n, ends_sha256), one row per key."""
    key, first, n, state = None, 0, 0, None

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"conv_id": [first], "n": [n], "ends_sha256": [state.hexdigest()]}
        )

    for batch in batches:
        for row in batch.to_pylist():
            if state is not None and row["key"] != key:
                yield ended()
                state = None
            if state is None:
                key, first, n, state = row["key"], row["first"], 0, hashlib.sha256()
            state.update(("," if n else "").encode() + row["ids"].encode())
            n += row["n"]
    if state is not None:
        yield ended()


def classes(rows: DataFrame) -> DataFrame:
    """(conv_id, n, ends_sha256, digests, bytes): one row per distinct conversation, by its
    smallest id, with how many there are and the hash of all their ids."""
    key = F.sha2(F.array_join("digests", ""), 256).alias("key")
    runs = (
        rows.select(key, "conv_id")
        .repartitionByRange("key", "conv_id")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(_runs, "key string, first long, n long, ids string")
    )
    found = (
        runs.repartition("key")
        .sortWithinPartitions("key", "first")
        .mapInArrow(_hashed_runs, "conv_id long, n long, ends_sha256 string")
    )
    return found.join(rows, "conv_id")


def two_fattest(low: int, high: int) -> int:
    """The number above ``low`` and up to ``high`` that two divides most often."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of conversations, with a hash table of handles.

    A node is a place in the lists below; 0 is the root. It covers the depths above
    ``start`` and up to ``extent`` of the conversation ``owner``.
    """

    def __init__(self) -> None:
        self.start, self.extent, self.owner, self.parent = [0], [0], [-1], [-1]
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int | None] = [None]
        self.handles: dict[bytes, int] = {}
        #: By conversation: its turns, and the hash of each of its prefixes.
        self.turns: list[Sequence[str]] = []
        self.prefixes: list[list[bytes]] = []

    def _prefix(self, node: int, depth: int) -> bytes:
        return self.prefixes[self.owner[node]][depth]

    def _handle(self, node: int) -> bytes:
        return self._prefix(node, two_fattest(self.start[node], self.extent[node]))

    def _add(self, parent: int, extent: int, owner: int) -> int:
        node = len(self.start)
        self.start.append(self.extent[parent])
        self.extent.append(extent)
        self.owner.append(owner)
        self.parent.append(parent)
        self.children.append({})
        self.end.append(None)
        self.children[parent][self.turns[owner][self.extent[parent]]] = node
        self.handles[self._handle(node)] = node
        return node

    def locate(self, item: int, node: int = 0) -> tuple[int, int | None]:
        """The deepest node below ``node`` that a conversation passes whole, and the child
        on whose edge it leaves the trie, if it leaves on one."""
        prefixes = self.prefixes[item]
        low, high = self.extent[node], len(prefixes) - 1
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get(prefixes[depth])
            if found is None:
                high = depth - 1
                continue
            extent = self.extent[found]
            if extent >= len(prefixes) or prefixes[extent] != self._prefix(found, extent):
                return self.parent[found], found
            node, low = found, extent
        turns = self.turns[item]
        at = self.extent[node]
        return node, self.children[node].get(turns[at]) if at < len(turns) else None

    def _split(self, node: int, depth: int) -> int:
        """A new node on the edge to ``node``."""
        del self.handles[self._handle(node)]
        above = self._add(self.parent[node], depth, self.owner[node])
        self.start[node], self.parent[node] = depth, above
        self.children[above][self.turns[self.owner[node]][depth]] = node
        self.handles[self._handle(node)] = node
        return above

    def _insert(self, item: int, node: int) -> None:
        prefixes = self.prefixes[item]
        node, leaves_on = self.locate(item, node)
        if leaves_on is not None:
            # The depth to which they agree: at least one turn beyond the parent.
            low = self.extent[node] + 1
            high = min(len(prefixes) - 1, self.extent[leaves_on])
            while low < high:
                middle = (low + high + 1) // 2
                if prefixes[middle] == self._prefix(leaves_on, middle):
                    low = middle
                else:
                    high = middle - 1
            node = self._split(leaves_on, low)
        if self.extent[node] < len(prefixes) - 1:
            node = self._add(node, len(prefixes) - 1, item)
        self.end[node] = item

    def insert(self, batch: Sequence[Sequence[str]]) -> None:
        """Add distinct conversations: all are located, then inserted below."""
        first = len(self.turns)
        for turns in batch:
            prefix, prefixes = b"", [b""]
            for turn in turns:
                prefix = hashlib.blake2b(prefix + turn.encode(), digest_size=16).digest()
                prefixes.append(prefix)
            self.turns.append(turns)
            self.prefixes.append(prefixes)
        items = range(first, len(self.turns))
        located = [self.locate(item)[0] for item in items]
        for item, node in zip(items, located, strict=True):
            self._insert(item, node)

    def path(self, item: int) -> list[int]:
        """The nodes from the root to where a conversation ends."""
        node, _ = self.locate(item)
        found = [node]
        while node:
            node = self.parent[node]
            found.append(node)
        return found[::-1]


_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
_SWEPT = f"{_NODES}, part int, side int, digest binary, above binary, bytes long"
_NAMES = [field.split()[0] for field in _SWEPT.split(", ")]


def _expanded(trie: ZFastTrie, ids: list, counts: list, ends: list, sizes: list, part: int):
    """Rows of all nodes, edges expanded; see :func:`swept`."""
    sums = []
    for own in sizes:
        total, sum_ = 0, [0]
        for size in own:
            total += size
            sum_.append(total)
        sums.append(sum_)
    paths = [trie.path(0), trie.path(len(ids) - 1)]
    border = set(paths[0]) | set(paths[1])
    count = len(trie.start)
    least, members = [None] * count, [0] * count
    # Of the whole subtree; for border nodes, of what hangs below them inside the range.
    leaves, saved = [0] * count, [0] * count
    for v in sorted(range(count), key=trie.extent.__getitem__, reverse=True):
        below = trie.children[v].values()
        end = trie.end[v]
        members[v] = sum(members[c] for c in below) + (counts[end] if end is not None else 0)
        first = [least[c] for c in below] + ([ids[end]] if end is not None else [])
        least[v] = min(first)
        leaves[v] = sum(leaves[c] for c in below)
        saved[v] = sum(saved[c] for c in below)
        if v not in border:
            leaves[v] += not below
            own = sums[trie.owner[v]]
            saved[v] += (members[v] - 1) * (own[trie.extent[v]] - own[trie.start[v]])

    def rows_of(v: int) -> Iterator[tuple]:
        """The nodes of an edge, from the top, as they are within the range."""
        start, extent, owner, parent = (
            x[v] for x in (trie.start, trie.extent, trie.owner, trie.parent)
        )
        inner, end = v not in border, trie.end[v]
        own_ends = ends[end] if end is not None else NO_ENDS if inner else None
        prefixes = trie.prefixes[owner] if owner >= 0 else [b""]
        rest = saved[v]
        for depth in range(start + 1, extent + 1) if v else (0,):
            last = depth == extent
            top = depth == start + 1
            if inner:
                kids = len(trie.children[v]) if last else 1
                over = least[v] if not top else None if parent in border else least[parent]
                above = prefixes[start] if top and parent in border else None
                size = digest = None
            else:
                inside = [c for c in trie.children[v].values() if c not in border]
                kids = len(inside) if last else 0
                over = None
                above = prefixes[depth - 1] if depth else None
                digest = prefixes[depth]
                size = sizes[owner][depth - 1] if depth else 0
            ends_here = own_ends if last else NO_ENDS if inner else None
            yield (least[v], depth, over, members[v], kids, leaves[v], rest, ends_here, digest, above, size)
            if inner:
                rest -= (members[v] - 1) * sizes[owner][depth - 1]

    for v in range(count):
        if v not in border:
            for *node, digest, above, size in rows_of(v):
                yield (*node, part, None, digest, above, size)
    for v in paths[0]:
        for *node, digest, above, size in rows_of(v):
            yield (*node, part, 0, digest, above, size)
    if len(ids) > 1:
        both = set(paths[0])
        for v in paths[1]:
            for *node, digest, above, size in rows_of(v):
                # Counted on the first path, here it is but a place.
                if v in both:
                    node = [None, node[1], None, 0, 0, 0, 0, None]
                yield (*node, part, 1, digest, above, size)


def swept(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of every range of ``classes``.

    Where ``side`` is null a node is complete, but for the parent's id if ``above`` names
    the parent, a border node. Otherwise it is a border node, on the path of the first (0)
    or last (1) conversation of the range ``part``: its counts are partial, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` those of the complete nodes below it.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        ids, counts, ends, sizes, part = [], [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids += batch["conv_id"].to_pylist()
            counts += batch["n"].to_pylist()
            ends += batch["ends_sha256"].to_pylist()
            sizes += batch["bytes"].to_pylist()
            part = batch["part"][0].as_py()
            trie.insert(batch["digests"].to_pylist())
        if not ids:
            return
        found = []
        for row in _expanded(trie, ids, counts, ends, sizes, part):
            found.append(row)
            if len(found) == 50_000:
                yield _batch(found)
                found = []
        yield _batch(found)

    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = rows.agg(F.sum(F.size("digests"))).first()[0] or 0
    return (
        rows.repartitionByRange(max(ranges, turns // TURNS_PER_RANGE + 1), "digests")
        .sortWithinPartitions("digests")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(sweep, _SWEPT)
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in _SWEPT.split(", ")]
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _border_nodes(paths: DataFrame) -> DataFrame:
    """Border nodes with their whole counts, from their parts in all ranges."""
    place = F.struct("part", "side")
    merged = paths.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inside"),
        F.sum("n_leaves").alias("leaves_inside"),
        F.sum("saved_tokens").alias("saved_inside"),
        F.max("ends_sha256").alias("ends_sha256"),
        F.max("above").alias("above"),
        F.max("bytes").alias("bytes"),
        F.min(place).alias("counted_in"),
    )
    merged = written(merged, "trie-border")
    kids = merged.groupBy(F.col("above").alias("digest")).agg(F.count("*").alias("border_kids"))
    n_children = F.col("inside") + F.coalesce("border_kids", F.lit(0))
    nodes = merged.join(kids.where("digest IS NOT NULL"), "digest", "left").select(
        *merged.columns,
        n_children.alias("n_children"),
        (n_children == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    # Each node counts on one path, and there for all nodes above it.
    here = F.col("counted_in") == place
    down = W.partitionBy("part", "side").orderBy(F.desc("depth"))
    sums = (
        paths.select("part", "side", "digest")
        .join(nodes.select("digest", "depth", "counted_in", "leaf", "saved"), "digest")
        .select(
            "digest",
            *[
                F.sum(F.when(here, F.col(c)).otherwise(0)).over(down).alias(f"{c}_sum")
                for c in ("leaf", "saved")
            ],
        )
        .groupBy("digest")
        .agg(F.sum("leaf_sum").alias("leaf_sum"), F.sum("saved_sum").alias("saved_sum"))
    )
    over = merged.select(F.col("digest").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, "digest")
        .join(over, "above", "left")
        .select(
            "digest",
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("leaves_inside") + F.col("leaf_sum")).alias("n_leaves"),
            (F.col("saved_inside") + F.col("saved_sum")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rows (conv_id, digests, bytes)``: smallest member,
    depth, parent, members, children, leaves, bytes that sharing saves, and the hash of
    the ids that end there."""
    nodes = written(swept(written(classes(rows), "trie-classes")), "trie-nodes")
    inner = nodes.where("side IS NULL")
    paths = nodes.where("side IS NOT NULL")
    border = written(_border_nodes(paths), "trie-border")
    names = [field.split()[0] for field in _NODES.split(", ")]
    # A parent's id is looked up by range and hash: a border node may have any number of
    # children, but those in one range are bounded.
    known = border.select("digest", F.col("conv_id").alias("_over"))
    over = (
        paths.select("part", "digest")
        .distinct()
        .join(known, "digest")
        .withColumnRenamed("digest", "above")
    )
    tops = inner.where("above IS NOT NULL").join(over, ["part", "above"])
    tops = tops.withColumn("parent_conv_id", F.col("_over"))
    return (
        inner.where("above IS NULL")
        .select(names)
        .union(tops.select(names))
        .union(border.select(names))
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of the rebuilt conversations."""
    return prefix_trie(written(rebuilt(conversations), "trie-rebuilt"))
