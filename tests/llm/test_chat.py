import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stratatile.llm import chat

ODD = ["", "</s>", "[INST] a [/INST]", "\\", "\\\\</s>\\", "<s>[ROLE]user[/ROLE]", "<<SYS>> <|im_end|>", "a\nb\r", "é𝒳 $1 \\$", "<", "[", "[/ROLE"]


def back(spark, turns):
    df = spark.createDataFrame([(1, "x", turns)], f"k long, layout string, turns {chat.TURNS}")
    done = chat.format_turns(df)
    r = done.select("formatted", "mask", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert sum(m["chars"] for m in r["mask"]) == len(r["formatted"])
    return r["formatted"], [tuple(t) for t in r["t"]], r["loss"]


def test_round_trip_of_control_strings(spark):
    turns = [(role, text) for text in ODD for role in ("user", "assistant", text)]
    formatted, got, loss = back(spark, turns)
    assert got == turns
    assert loss == "".join(t for r, t in turns if r == "assistant")
    assert formatted.count("</s>") == len(turns) and formatted.count("[ROLE]") == len(turns) and "[INST]" not in formatted


def test_no_control_string_stays(spark):
    for control in ("<<SYS>>", "<</SYS>>", "<SYS>", "<|im_start|>", "[[INST]]", "<s>", "</s>", "<<s>", "[/ROLE]"):
        formatted, got, loss = back(spark, [("user", control), (control, control), ("assistant", control + "\\" + control)])
        assert got == [("user", control), (control, control), ("assistant", control + "\\" + control)] and loss == got[2][1]
        inside = formatted.replace("<s>[ROLE]", "").replace("[/ROLE]", "").replace("</s>", "")
        assert not any(x in inside for x in ("<SYS", "<<", "</", "<|", "<s", "[I", "[/", "[["))


def test_no_turns_and_columns_of_the_caller(spark):
    df = spark.createDataFrame([(1, None, 5), (2, [], 6), (3, [(None, None), ("assistant", None)], 7)], f"k long, turns {chat.TURNS}, _escaped int")
    done = chat.format_turns(df)
    assert done.columns == ["k", "turns", "_escaped", "formatted", "mask"]
    got = {r["k"]: r for r in done.select("*", chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss"), chat.read_turns(F.col("formatted")).alias("back")).collect()}
    assert [got[k]["_escaped"] for k in (1, 2, 3)] == [5, 6, 7] and all(got[k]["loss"] == "" for k in got)
    assert got[1]["formatted"] == got[2]["formatted"] == "" and got[1]["mask"] == [] and [tuple(t) for t in got[3]["back"]] == [("", ""), ("assistant", "")]


def test_records_that_break_parsers(spark):
    deep = '{"prompt": "p", "response": "r", "more": ' + '{"a": ' * 900 + "1" + "}" * 901
    deeper = '{"prompt": ' + "[" * 200_000 + "]" * 200_000 + ', "response": "r"}'
    rows = [(1, r'{"prompt": "\ud800x", "response": "\ud83d\ude00"}'), (2, deep), (3, deeper), (4, '{"messages": []}'), (5, r'{"\udfff": 1}'), (6, '{"conversations": []}'), (7, '{"messages": {}}'), (8, "{}"), (9, '{"messages": [null, 3]}')]
    got = {r["id"]: r for r in chat.canonical_records(spark.createDataFrame(rows, "id long, record string"), "id", "record").collect()}
    turns = lambda k: [tuple(t) for t in got[k]["turns"]]
    assert turns(1) == [("user", "\ufffdx"), ("assistant", "\U0001f600")]
    assert turns(2) == [("user", "p"), ("assistant", "r")] and got[2]["layout"] == "prompt_response"
    assert got[3]["layout"] is None and turns(3) == []
    assert got[4]["layout"] == "messages" and got[6]["layout"] == "conversations" and turns(4) == turns(6) == []
    assert got[5]["fingerprint"] and got[5]["layout"] is None and all(turns(k) == [] for k in (5, 7, 8, 9))


def test_a_conversation_of_many_turns(spark):
    turns = [("assistant" if i % 2 else "user", f"[{i}]") for i in range(20_000)]
    formatted, got, loss = back(spark, turns)
    assert got == turns and loss == "".join(t for r, t in turns if r == "assistant")


def test_rows_by_turn(spark):
    rows = [(1, 2, "assistant", "b", 9), (1, 1, "user", None, 9), (1, 2, "assistant", "a", 9), (1, 2, "assistant", "a", 9), (2, None, None, "x", 9), (None, 1, "user", "y", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical_turns(df, "conv_id").collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], 2: [("", "x")], None: [("user", "y")]}
    assert chat.canonical_turns(df.limit(0), "conv_id").count() == 0


def test_layouts_of_typed_tables(spark):
    lists = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)]), (2, None)], "id long, conversations array<struct<from:string,value:string>>")
    assert [[tuple(t) for t in r["turns"]] for r in chat.canonical_turns(lists, "id").orderBy("id").collect()] == [[("user", "q"), ("assistant", "")], []]
    pair = spark.createDataFrame([(1, "i", "n", "o", 5)], "id long, instruction string, input string, output string, other int")
    r = chat.canonical_turns(pair, "id").first()
    assert r["layout"] == "instruction_input" and [tuple(t) for t in r["turns"]] == [("user", "i"), ("user", "n"), ("assistant", "o")]
    nested = spark.createDataFrame([(1, ("q", "a"))], "id long, data struct<question:string,answer:string>")
    assert chat.canonical_turns(nested, "id").first()["layout"] == "question_answer"
    with pytest.raises(ValueError, match="fingerprint"):
        chat.canonical_turns(spark.range(1), "id")


def test_records_of_mixed_layouts(spark):
    given = [{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "extra": 1}]}, {"prompt": "p", "response": "r"}, {"conversations": [{"from": "human", "value": "h"}]}, {"x": 1}, {"prompt": None, "completion": "c", "meta": {"a": [1]}}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(given)] + [(9, "{bad"), (10, None), (11, "[1]")]
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_records(spark.createDataFrame(rows, "id long, record string"), "id", "record").collect()}
    assert got[0] == ("messages", [("user", "a"), ("assistant", "b")]) and got[1] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert got[2] == ("conversations", [("user", "h")]) and got[4] == ("prompt_completion", [("user", ""), ("assistant", "c")])
    assert got[3] == got[9] == got[10] == got[11] == (None, [])


def test_fingerprints_tell_layouts_apart():
    assert len({m.fingerprint for m in chat.MAPPINGS}) == len(chat.MAPPINGS)
    assert chat.path_hash(["b", "a", "a"]) == chat.path_hash(["a", "b"])


def test_query(spark):
    rows = {r["conv_id"]: r for r in chat.op1_schema_fingerprint_chat(spark, "/root/testdata/sf0.001").collect()}
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    said = "</s>[INST] ok [/INST]"
    by = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in table:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    assert set(rows) == set(by)
    for k, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert rows[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (rows[k]["n_turns"], rows[k]["loss_chars"], rows[k]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
