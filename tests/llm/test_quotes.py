"""Quotation linking: parsing, links, threads, and a mailbox made from conversations."""

import duckdb
from pyspark.sql import functions as F

from paritas.llm import quotes as Q
from paritas.llm.queries import ORACLE, op6_quotes


def test_parsing():
    own, passages = Q.parsed("Hi\nOn Monday X wrote:\n> a\n>b\n>> c\n> > d\n  > e\n\nend > not")
    assert own == "Hi\n\nend > not"
    assert passages == [(1, "a\nb"), (2, "c\nd"), (1, "e")]
    assert Q.parsed("On Monday X wrote:\nno quote") == ("On Monday X wrote:\nno quote", [])
    assert Q.parsed("") == ("", [])


MAILS = [
    (1, 0, "u", "First   Line\nsecond line"),
    (1, 1, "a", "> first line\nI agree"),
    (1, 2, "u", "> second LINE\n> first line\nme too"),
    (1, 3, "a", ">> first line\n> i agree\nto turn one"),
    (1, 4, "u", ">> unknown\n> unknown\n>> me too\nby the lower level that is known"),
    (1, 5, "a", "nothing quoted"),
    (1, 6, "u", "> nowhere\nlost"),
    (2, 0, "u", "first line"),
    (2, 1, "a", "> second line\nother conversation"),
    (3, 0, "u", "yes"),
    (3, 1, "a", "> yes\nyes"),
    (3, 2, "u", "> yes\nyes"),
    (3, 3, "a", "> yes"),
    (4, 5, "u", None),
    (4, 6, "u", ""),
    (4, 7, "u", "> later\nx"),
    (4, 8, "u", "later"),
    (None, 1, "u", "> yes\nno conversation"),
    (3, None, "u", "> yes\nno turn"),
    (3, 0, "u", "a second row of the turn"),
    (3, 4, "u", "> a second row of the turn"),
]


def test_links_and_threads(spark):
    df = spark.createDataFrame(MAILS, "conv_id long, turn long, role string, text string")
    df = df.withColumn("line", F.lit(1)).withColumn("level", F.lit("x"))
    rows = Q.conversations(df).collect()
    assert len(rows) == len(MAILS)
    found = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in rows}
    assert found == {
        (1, 0): (None, 0, 0),
        (1, 1): (0, 0, 1),
        (1, 2): (0, 0, 1),
        (1, 3): (1, 0, 2),
        (1, 4): (2, 0, 2),
        (1, 5): (None, 5, 0),
        (1, 6): (None, 6, 0),
        (2, 0): (None, 0, 0),
        (2, 1): (None, 1, 0),
        (3, 0): (None, 0, 0),
        (3, 1): (0, 0, 1),
        (3, 2): (1, 0, 2),
        (3, 3): (2, 0, 3),
        (3, 4): (0, 0, 1),
        (4, 5): (None, 5, 0),
        (4, 6): (None, 6, 0),
        (4, 7): (None, 7, 0),
        (4, 8): (None, 8, 0),
        (None, 1): (None, 1, 0),
        (3, None): (None, None, 0),
    }
    texts = {(r.conv_id, r.turn): r.text for r in rows}
    assert texts[1, 3] == "to turn one" and texts[4, 5] is None and texts[3, 3] == ""
    assert Q.conversations(df.limit(0)).count() == 0


def test_long_thread(spark):
    rows = [(7, i, "u", f"turn {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = Q.conversations(Q.quoting(df)).collect()
    assert all((r.root_turn, r.depth, r.text) == (0, r.turn, f"turn {r.turn}") for r in found)
    assert len(found) == 300


def test_mailbox_against_sql(spark, mini):
    db = duckdb.connect()
    db.sql(f"create view conversations as from '{mini}/conversations.parquet'")
    columns = "conv_id, turn, role, text, parent_turn, root_turn, depth"
    expected = db.sql(f"select {columns} from ({ORACLE['op6_quotes']})").fetchall()
    assert sorted(map(tuple, op6_quotes(spark, mini).collect())) == sorted(expected)
