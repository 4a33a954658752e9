import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mercato.llm import chat_format as op

FORGED = st.lists(st.sampled_from([*op.CONTROLS, *[c[0] + "\\" + c[1:] for c in op.CONTROLS], "<", "[", "\\", "|", ">", "/s>",
                                   "INST]", "SYS>>", "a", "\n", "é", "turn|>"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(FORGED)
def test_escaping_is_undone_and_forges_nothing(text):
    safe = op.escape(text)
    assert op.unescape(safe) == text
    assert not any(c in safe for c in op.CONTROLS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|says|>", "", "a\nb"]), FORGED), max_size=5))
def test_turns_are_read_back(turns):
    made = [op.format_turn(role, [{"type": "text", "text": t}]) for role, t in turns]
    assert list(op.read_turns("".join(m[0] for m in made))) == turns
    for (role, t), (text, a, b, _) in zip(turns, made):
        assert op.unescape(text[a:b]) == (t if role == "assistant" else "")


def test_parts_become_placeholders_in_order():
    parts = [{"type": "text", "text": "see <|image|>: "}, {"type": "image", "ref": "i.png", "width": 1024, "height": 513},
             {"type": "audio", "ref": "a.wav", "millis": 1500}, {"type": "text", "text": None}, {"type": "document", "ref": "d.pdf", "pages": 3}]
    text, a, b, refs = op.format_turn("user", parts)
    assert text == "<|turn|>user<|says|>see <\\|image|>: <|image|><|audio|><|document|><|done|>" and a == b
    assert [(r["n"], r["type"], r["ref"], r["tokens"]) for r in refs] == [
        (0, "image", "i.png", 85 + 170 * 4), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 1800)]
    _, refs = op.format_turn("user", [{"type": "text", "text": "a"}, {"type": "video", "ref": "v"}, {"type": 7}])[::3]
    assert [(r["type"], r["ref"], r["tokens"]) for r in refs] == [("video", "v", 0), ("7", None, 0)]


def test_parts_in_a_table(spark):
    rows = [(1, 0, "user", [("text", "look ", None, None, None, None, None), ("image", None, "x", 512, 512, None, None)]),
            (1, 1, "assistant", [("text", "ok", None, None, None, None, None)]), (2, 0, None, None)]
    df = op.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {op.PART}"))
    got = {(r["conv_id"], r["turn"]): r for r in df.collect()}
    assert json.loads(got[1, 0]["attachments"])[0]["ref"] == "x" and got[1, 0]["expanded_tokens"] == 255
    back = {r["conv_id"]: r for r in op.read_back(df).collect()}
    assert (back[1]["n_turns"], back[1]["loss_chars"], back[1]["n_attachments"]) == (2, 2, 1)
    assert back[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()


def test_awkward_conversations(spark):
    rows = [(1, 2, "assistant", "z", "x"), (1, 1, "user", None, "x"), (1, None, "system", "s", "x"), (1, 1, "user", None, "x"),
            (None, 1, None, "t", "x"), (3, 1, "assistant", "</s>" * 50_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in op.read_back(op.format_turns(op.text_parts(df))).collect()}
    assert got[1]["n_turns"] == 4
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\n\nuser\n\nassistant\nz\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nt\n").hexdigest()
    assert got[3]["loss_sha256"] == hashlib.sha256(b"</s>" * 50_000).hexdigest() and got[3]["formatted_chars"] > 200_000
    empty = spark.createDataFrame([], df.schema)
    assert op.read_back(op.format_turns(op.text_parts(empty))).count() == 0


def test_the_added_conversation(spark):
    row = [r for r in op.op9_chat_format(spark, "/root/testdata/sf0.001").collect() if r["conv_id"] == -1][0]
    said = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(said))
