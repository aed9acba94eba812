"""Chat formatting: exact round trips, layouts and defined results."""

import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagtrack.llm import chat as C

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "<\\|end|>", "<\\\\|", "<<SYS>>a<</SYS>>", "a\\<|b", "[\\INST]", "", "é\n\U0001F600<s>", "<<s>", "[[/INST]"]
TOKENS = st.sampled_from(["<", "|", "\\", "[", "/", "s>", "INST]", "<SYS>>", "</SYS>>", "a", "\n", "é", "<|turn|>", "<|text|>", "<|end|>"])


def formatted(spark, turns):
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = C.formatted(C.canonical(C.as_records(rows)))
    back = out.select("conv_id", "layout", "formatted", "loss", C.read_back(F.col("formatted")).alias("t"), C.masked(F.col("formatted"), F.col("loss")).alias("m"))
    return {r.conv_id: r for r in back.collect()}


def test_round_trip_of_control_strings(spark):
    turns = [(i, k, role, text) for i, text in enumerate(NASTY) for k, role in enumerate(("system", "user", "assistant", text, "assistant"))]
    got = formatted(spark, turns)
    for i, text in enumerate(NASTY):
        assert [(t.role, t.text) for t in got[i].t] == [(r, text) for r in ("system", "user", "assistant", text, "assistant")]
        assert got[i].m == text * (3 if text == "assistant" else 2)
        assert got[i].formatted.count("<|turn|>") == 5


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(TOKENS, max_size=12).map("".join), min_size=40, max_size=40))
def test_escape_reverses(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    e = C.escape(F.col("t"))
    for r in rows.select("t", e.alias("e"), C.unescape(e).alias("b")).collect():
        assert r.b == r.t
        assert not any(mark in r.e for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_layouts(spark):
    records = {
        "prompt": {"prompt": "p", "response": "r"},
        "question": {"question": "p", "answer": "r"},
        "instruction": {"instruction": "i", "input": "p", "output": "r"},
        "messages": {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]},
        "chat": {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]},
        None: {"other": {"deep": [1]}},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [("broken", "{"), ("null", None)], "want string, record string")
    for r in C.canonical(rows).collect():
        turns = [(t.role, t.text) for t in r.turns]
        if r.want in ("broken", "null", None):
            assert r.layout is None and turns == []
        else:
            assert r.layout == r.want
            assert turns[-2:] == [("user", "p"), ("assistant", "r")]


def test_fingerprint_ignores_types_and_order(spark):
    rows = spark.createDataFrame([('{"prompt": "a", "response": "b"}',), ('{"response": 1, "prompt": null}',), ('{"prompt": "a"}',)], "record string")
    a, b, c = [r.fingerprint for r in C.canonical(rows).collect()]
    assert a == b != c


def test_nulls_ties_and_order(spark):
    got = formatted(spark, [(1, None, None, "first"), (1, 2, "user", None), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (None, 0, "user", "x")])
    assert [(t.role, t.text) for t in got[1].t] == [("", "first"), ("assistant", "a"), ("assistant", "b"), ("user", "")]
    assert got[1].m == "ab"
    assert [(t.role, t.text) for t in got[None].t] == [("user", "x")]


def test_empty_and_long(spark):
    assert formatted(spark, []) == {}
    text = "w</s> " * 50_000
    got = formatted(spark, [(1, 0, "user", "q"), (1, 1, "assistant", text)])
    assert got[1].m == text


def test_query(spark):
    from tagtrack.llm.queries import QUERIES

    r = QUERIES["op3_chat"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(said)
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
