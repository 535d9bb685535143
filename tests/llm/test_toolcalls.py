import json

from ledgerloom.llm import toolcalls
from ledgerloom.llm.common import table

from .helpers import DATA

CALLS = "conv_id long, call_id string, parent_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False), "note": ("string", False)}}


def linked(spark, calls, results):
    rows = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    return {(r.conv_id, r.call_id): r for r in rows}


def test_links_levels_and_faults(spark):
    calls = [
        (1, "x", None, 0, "add", '{"b": 2.5, "a": 1}'),
        (1, "y", "x", 2, "add", '{"a": "one", "z": {"q": [1, {"c": 1, "b": 2}]}}'),
        (1, "z", "y", 4, "sub", "{}"),
        (1, "w", "gone", 5, "add", "not json"),
        (1, "w", "gone", 6, "add", '{"a": 1}'),
        (1, "p", "q", 7, "add", None),
        (1, "q", "p", 8, "add", "{}"),
        (2, "x", None, 9, "add", '{"a": 3}'),
        (None, "x", None, 9, "add", "{}"),
        (3, None, None, 9, "add", "{}"),
    ]
    results = [(1, "x", 1, 'say "hi"\n'), (1, "x", 3, "later"), (2, "x", 1, "too soon"), (4, "none", 1, None)]
    got = linked(spark, calls, results)
    assert len(got) == 8
    assert {k[1]: (r.status, r.depth) for k, r in got.items() if k[0] == 1} == {
        "x": ("linked", 0), "y": ("no_result", 1), "z": ("no_result", 2), "w": ("no_result", 0), "p": ("cycle", None),
        "q": ("cycle", None),
    }
    assert got[2, "x"].status == "early_result" and got[4, "none"].status == "orphan_result"
    assert got[1, "x"].violations == "" and got[1, "x"].n_results == 2 and got[1, "w"].n_calls == 2
    assert got[1, "y"].violations == "a not integer,z unknown"
    assert got[1, "z"].violations == "unknown tool" and got[1, "w"].violations == "not an object"
    assert got[1, "p"].violations == "not an object" and got[1, "q"].violations == "a missing"
    for r in got.values():
        record = json.loads(r.record)
        assert r.record == json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "x"].record)["result"] == 'say "hi"\n'


def test_a_long_chain_and_empty_tables(spark):
    calls = [(1, str(i), str(i - 1), i, "add", "{}") for i in range(300)]
    got = linked(spark, calls, [])
    assert all(r.depth == int(k[1]) for k, r in got.items())
    assert linked(spark, [], []) == {}


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "user", "bé"), (2, 5, "assistant", "z"), (None, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in toolcalls.link(*toolcalls.from_conversations(frame)).collect()}
    assert {k: (r.status, r.depth, r.violations) for k, r in got.items()} == {
        "1-0": ("linked", 0, "chars not integer,prompt not string"),
        "1-2": ("no_result", 1, ""),
        "2-4": ("orphan_result", None, None),
    }


def test_turns_of_other_roles_give_no_row(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "tool", "t"), (1, 2, None, "n"), (1, 3, "assistant", "a"), (1, None, "user", "x")]
    got = toolcalls.link(*toolcalls.from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {(r.call_id, r.status) for r in got.collect()} == {("1-0", "no_result"), ("1-2", "orphan_result")}


def test_long_texts_and_extra_columns(spark):
    long = "é\n" * 200_000
    own = "depth long, status string, c long, r long, known long, up long, n_calls long, x long"
    calls = spark.createDataFrame([(1, "x", None, 0, "add", json.dumps({"a": 1, "note": long}), *[7] * 2, *[7] * 6)][:1], f"{CALLS}, {own}".replace("status string", "status long"))
    results = spark.createDataFrame([(1, "x", 1, long, 7, 7)], RESULTS + ", content_ long, record long")
    (row,) = toolcalls.link(calls, results, SCHEMAS).collect()
    assert (row.status, row.depth, row.violations) == ("linked", 0, "")
    assert json.loads(row.record) == {"arguments": {"a": 1, "note": long}, "id": "x", "name": "add", "result": long}


def test_query_columns(spark):
    found = toolcalls.op10_chat_tool_calls(spark, DATA)
    assert [k for _, k in found.dtypes] == ["bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint", "string", "string", "string"]
    turns = table(spark, DATA, "conversations")
    assert found.agg({"n_calls": "sum"}).first()[0] == turns.where("role IN ('user', 'system')").count()
