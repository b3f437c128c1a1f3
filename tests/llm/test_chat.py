import duckdb
import pytest

from textmill.llm import chat

ROWS = [
    (1, 0, "user", "Hello all.\nHow is the weather today?\n\nSecond paragraph\nis here."),
    (1, 1, "assistant", "> How is the  weather TODAY?\nIt rains."),
    (1, 2, "user", "On Monday, A wrote:\n>> how is the weather today?\n> It rains.\nThanks"),
    (1, 3, "user", "> second paragraph\n> is here.\nThat one.\n> nowhere to be found"),
    (1, 4, "user", "> hello all.\n> changed line\nmixed"),
    (1, 5, "user", "> thanks\n\n\n\n\nok"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 2, "user", ">\n> \nempty quotes"),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "user", "> same\nrepeat"), (3, 1, "user", "> same\nrepeat"),
    (None, 1, "user", "> same"), (4, None, "user", "> same"),
]
COLUMNS = "conv_id long, turn long, role string, text string"


def rows(frame):
    return sorted((tuple(r) for r in frame), key=str)


def test_links_levels_and_order(spark):
    got = {(r.conv_id, r.turn): r for r in chat.without_quotes(spark.createDataFrame(ROWS, COLUMNS)).collect()}
    assert got[1, 1].parent_turn == 0 and got[1, 1].clean_text == "It rains." and got[1, 1].depth == 1
    assert (got[1, 2].parent_turn, got[1, 2].root_turn, got[1, 2].depth, got[1, 2].max_level) == (1, 0, 2, 2)
    assert got[1, 2].clean_text == "Thanks" and got[1, 2].n_linked == 2
    assert (got[1, 3].parent_turn, got[1, 3].n_passages, got[1, 3].n_linked) == (0, 2, 1)
    assert got[1, 4].parent_turn == 0
    assert (got[1, 5].parent_turn, got[1, 5].depth, got[1, 5].root_turn) == (2, 3, 0)
    assert got[2, 0].clean_text == "" and got[2, 2].n_passages == 0 and got[2, 2].root_turn == 2
    assert [got[1, t].position for t in range(6)] == [0, 1, 2, 3, 4, 5] and got[3, 0].position == 0 and got[3, 1].position == 1
    assert got[3, 1].parent_turn == 0 and got[None, 1].parent_turn is None


def test_same_as_sql(spark):
    ours = chat.without_quotes(spark.createDataFrame(ROWS, COLUMNS))
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    theirs = con.execute(chat.SQL).fetchall()
    assert len(theirs) == len(ROWS)
    assert rows(ours.collect()) == rows(theirs)


@pytest.mark.parametrize("n", [0, 40])
def test_long_chain_and_empty(spark, n):
    data = [(7, i, "user", f"> message {i - 1}\nmessage {i}") for i in range(n)]
    got = {r.turn: r for r in chat.without_quotes(spark.createDataFrame(data, COLUMNS)).collect()}
    assert len(got) == n
    assert all(got[i].depth == i and got[i].root_turn == 0 for i in got)


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, 0, "a", "x", 9)], "conv_id long, turn long, clean_text string, body string, depth long")
    assert chat.without_quotes(frame, text="body", keep=("clean_text", "depth")).first().clean_text == "x"


def test_positions_go_on_over_ranges(spark):
    data = [(7, i, "user", f"message {i}" if i % 3 else f"> message {i - 2}\nnew {i}") for i in range(300)] + [(8, 0, "user", "x")]
    out = chat.without_quotes(spark.createDataFrame(data, COLUMNS).repartition(7))
    got = sorted((r.root_turn, r.turn, r.position) for r in out.collect() if r.conv_id == 7)
    assert [p for *_, p in got] == list(range(300)) and len({r for r, *_ in got}) < 300
