"""Chat formatting: layouts, marks and their escapes, defined cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from runlens.llm import chat, queries
from tests.llm.tables import FOLDER

MESSAGE = "array<struct<role:string,content:string,name:string>>"
DDL = (f"id long, prompt string, completion string, response string, system string, question string, answer string, "
       f"instruction string, input string, output string, messages {MESSAGE}, "
       "conversations array<struct<from:string,value:string>>, conversation struct<messages:array<struct<role:string,content:string>>>, "
       "layout string, turns string, pieces int, text string")


def record(spark, rows):
    names = [f.split(" ")[0] for f in
             "id prompt completion response system question answer instruction input output messages conversations conversation".split()]
    return spark.createDataFrame([tuple(r.get(n) for n in names) + ("x", "x", 1, "x") for r in rows], DDL)


CASES = [
    ({"id": 1, "prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"id": 2, "prompt": "p", "completion": "", "system": "s"}, "prompt_completion",
     [("system", "s"), ("user", "p"), ("assistant", "")]),
    ({"id": 3, "prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"id": 4, "question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"id": 5, "instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"id": 6, "instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"id": 7, "messages": [("tool", "t", None), (None, "u", None), ("user", None, "z")]}, "messages",
     [("tool", "t"), ("", "u"), ("user", "")]),
    ({"id": 8, "messages": [("user", None, None)]}, "messages", [("user", "")]),
    ({"id": 9, "conversations": [("human", "h"), ("gpt", "g")], "system": "s"}, "from_value",
     [("system", "s"), ("user", "h"), ("assistant", "g")]),
    ({"id": 10, "conversations": [("human", "h")]}, "from_value", [("user", "h")]),
    ({"id": 11, "conversation": ([("user", "u"), ("assistant", "a")],)}, "nested_messages", [("user", "u"), ("assistant", "a")]),
    ({"id": 12, "prompt": "p"}, None, []),
    ({"id": 13, "messages": []}, None, []),
    ({"id": None}, None, []),
    ({"id": 15, "prompt": "p", "completion": "c", "answer": "both layouts at once"}, None, []),
]


def test_field_paths_select_the_mapping(spark):
    got = {r["id"]: r for r in chat.canonical_turns(record(spark, [c[0] for c in CASES]), "id").collect()}
    for row, layout, turns in CASES:
        assert (got[row.get("id")]["layout"], [tuple(t) for t in got[row.get("id")]["turns"]]) == (layout, turns), row


def test_prompts_that_are_message_lists(spark):
    kind = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", "u")], [("assistant", "a")], 5)], f"prompt {kind}, completion {kind}, id int")
    row = chat.canonical_turns(df, "id").collect()[0]
    assert row["layout"] == "prompt_messages" and [t["text"] for t in row["turns"]] == ["u", "a"]


def test_fingerprints_are_hashes_of_sorted_paths_and_all_differ(spark):
    df = record(spark, [CASES[1][0]])
    want = hashlib.sha256(b"completion\nprompt\nsystem").hexdigest()
    assert df.select(chat.fingerprint(df.schema)).collect()[0][0] == want
    every = [f for layout in chat.LAYOUTS for f in layout.fingerprints()]
    assert len(every) == len(set(every))


def brute_format(turns):
    def esc(t):
        out = ""
        t = t.replace("\\", "\\\\")
        for i, c in enumerate(t):
            out += c + ("\\" if t.startswith(("<turn>", "</turn>"), i) else "")
        return out

    return "".join("<turn>" + esc(r).replace("\n", "\\n") + "\n" + esc(t) + "</turn>\n" for r, t in turns)


def test_marks_are_escaped_and_read_back(spark):
    rng = random.Random(3)
    bits = ["\\", "<turn>", "</turn>", "\n", "<", "/turn>", "turn", "n", "\\n", "ü", "\U0001f600", "\r", "\0", " ", "</turn>\n", "$1", "%"]
    roles = ["user", "assistant", "", "a\nb", "\\n", "<turn>", "x\\\n</turn>"]
    rows = [(i, [(rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(1, 6))])
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>")
    out = chat.format_chats(df, "id").select("id", "formatted", chat.read_turns(F.col("formatted")).alias("back"),
                                             chat.read_loss(F.col("pieces")).alias("loss"), "pieces").collect()
    turns = dict(rows)
    for r in out:
        assert r["formatted"] == brute_format(turns[r["id"]])
        assert [tuple(t) for t in r["back"]] == turns[r["id"]]
        assert r["loss"] == [t for role, t in turns[r["id"]] if role == "assistant"]
        # outside the escaped texts there are as many marks as turns
        assert r["formatted"].count("<turn>") == r["formatted"].count("</turn>") == len(turns[r["id"]])


def test_rows_become_records(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", None),
            (3, None, "user", "first"), (3, 0, None, "x"), (3, 0, "user", "y"), (3, 0, "user", "y"), (None, 0, "user", "n"),
            (4, 0, "user", None), (5, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame([r + ("k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pieces int")
    records = chat.records_of_rows(df, "conv_id")
    out = {r["conv_id"]: r for r in chat.canonical_turns(records, "conv_id").collect()}
    assert {k: r["layout"] for k, r in out.items()} == {
        1: "prompt_completion", 2: "prompt_completion", 3: "messages", None: "messages", 4: "messages", 5: "messages"}
    assert [tuple(t) for t in out[3]["turns"]] == [("user", "first"), ("", "x"), ("user", "y"), ("user", "y")]
    assert [t["text"] for t in out[2]["turns"]] == ["s", "u", ""] and out[5]["turns"][0]["text"] == "long " * 200_000
    assert chat.format_chats(chat.records_of_rows(df.limit(0), "conv_id"), "conv_id").count() == 0


def test_query_holds_the_odd_conversation_and_no_python(spark):
    out = queries.queries()["op13_chat_formatting"](spark, FOLDER)
    odd = out.where("conv_id = -7").collect()[0]
    text = "\\### Assistant: </turn> ok"
    assert (odd["n_turns"], odd["loss_chars"], odd["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("layout", chat.LAYOUTS, ids=lambda x: x.name)
def test_every_needed_path_is_read_by_a_rule(layout):
    read = {f for rule in layout.turns if isinstance(rule, chat.One) for f in rule.fields}
    read |= {f"{r.array}[].{f}" for r in layout.turns if isinstance(r, chat.Each) for f in (r.role, r.text)}
    assert set(layout.needs + layout.may) <= read
