"""The trie of conversations against a plain one, held as a dictionary of prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest

from paritas.llm import prefix_trie
from paritas.llm.queries import ORACLE
from paritas.llm.prefix_trie import ZFastTrie, two_fattest

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_hash(role, text):
    content = f"{len(role.encode())}:{role}{text}"
    return hashlib.sha256(content.encode()).hexdigest()[:32]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, turn_hash(*t[1:])))
        own[conv] = [t[1:] for t in turns]
    found = {}
    for conv, turns in own.items():
        h = zlib.crc32(b"%d" % conv) % 9
        # A remainder has the sign of the id, as in SQL.
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        found[conv] = own.get(base, [])[:h] + turns[h:]
    return found


def brute(rows):
    members = {}
    conversations = rebuilt(rows)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in below)
    found = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(conversations[c]) == len(node))
        found.append(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                len(kids.get(node, [])), leaves[node], saved[node],
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(found, key=repr)


def result(spark, rows, ranges="8"):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        table = spark.createDataFrame(rows, SCHEMA)
        return sorted(map(tuple, prefix_trie.conversation_trie(table).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def mixed(n, seed, letters="ab"):
    chosen = random.Random(seed)
    return [
        (conv, turn, chosen.choice(["user", "bot"]), chosen.choice(letters) * chosen.randrange(3))
        for conv in range(n)
        for turn in range(chosen.randrange(1, 12))
    ]


@pytest.mark.parametrize(("n", "seed", "ranges"), [(60, 1, "8"), (300, 2, "8"), (40, 3, "40")])
def test_mixed_conversations(spark, n, seed, ranges):
    rows = mixed(n, seed)
    assert result(spark, rows, ranges) == brute(rows)


def test_one_range(spark):
    rows = mixed(80, 4)
    assert result(spark, rows, "1") == brute(rows)


def test_common_turns_and_copies(spark):
    """Most conversations share thirty turns and differ in the last; many are equal."""
    start = [(t, "user", f"turn {t}") for t in range(30)]
    rows = [(5 * c, *t) for c in range(120) for t in start]
    rows += [(5 * c, 30, "user", f"end {c}") for c in range(60)]
    assert result(spark, rows) == brute(rows)


def test_runs_of_a_class(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(5 * c, t, "user", "same") for c in range(50) for t in range(2)]
    assert result(spark, rows) == brute(rows)


def test_nulls_empties_ties_and_long_texts(spark):
    rows = [
        (0, None, "user", "null is first"), (0, 1, None, None), (0, 2, "", ""),
        (1, 0, "a", "tie"), (1, 0, "b", "tie"), (1, 0, "b", "tie"), (1, None, "c", "x"),
        (2, 0, "ab", "c"), (7, 0, "a", "bc"), (12, 0, "user", "ü" * 200_000),
        (-3, 0, "u", "v"), (-5, 0, "u", "v"), (-5, 1, "u", "w"), (10**15, 5, "u", "v"),
        (None, 0, "no", "conversation"), (4, 9, "u", "few"),
    ]
    rows += [(100 + c, t, "u", f"{t}") for c in range(6) for t in range(400 if c == 3 else 2)]
    assert result(spark, rows) == brute(rows)


def test_turnless(spark):
    """Conversations of one turn without a base have no turn left."""
    rows = [(c, 0, "u", "x") for c in range(20) if c % 5]
    found = result(spark, rows)
    assert found == brute(rows)
    assert any(row[1] == 0 and row[7] != prefix_trie.NO_ENDS for row in found)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    rows = mixed(20, 5)
    clash = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, digests int, part int, n int"
    )
    found = sorted(map(tuple, prefix_trie.conversation_trie(clash).collect()), key=repr)
    assert found == brute(rows)


def test_conversations_and_sql(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    rows = list(map(tuple, table.select("conv_id", "turn", "role", "text").collect()))
    expected = brute(rows)
    found = prefix_trie.conversation_trie(table)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    sql = con.execute(ORACLE["op11_prefix_trie"]).fetchall()
    assert sorted(sql, key=repr) == expected


def test_two_fattest():
    for low in range(70):
        for high in range(low + 1, 70):
            best = max(range(low + 1, high + 1), key=lambda n: n & -n)
            assert two_fattest(low, high) == best


def test_search_finds_where_a_conversation_leaves():
    """Every handle names its node, and every search ends at the plain walk's node."""
    chosen = random.Random(6)
    items = {tuple(chosen.choices("ab", k=chosen.randrange(20))) for _ in range(300)}
    items = sorted(items)
    trie = ZFastTrie()
    for first in range(0, len(items), 37):
        trie.insert(items[first : first + 37])
    assert len(trie.handles) == len(trie.start) - 1
    for i, item in enumerate(items):
        node = 0
        while trie.extent[node] < len(item):
            node = trie.children[node][item[trie.extent[node]]]
        assert trie.locate(i) == (node, None)
        assert trie.end[node] == i
    for node in range(1, len(trie.start)):
        assert len(trie.children[node]) != 1 or trie.end[node] is not None
