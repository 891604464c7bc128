"""Chat formatting against a plain machine and plain escapes."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat_format as C
from gristmill.llm import queries

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, turns INT, number STRING"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
MOVES = {(None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}


def run(spark, rows, template=C.Template()):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = C.format_conversations(df, template).withColumn("formatted", C.formatted())
    out = out.withColumn("back", C.turns_back(F.col("formatted"), template)).withColumn("loss", C.loss_text(template=template))
    return {r.conv_id: r for r in out.collect()}


def escape(text, controls=("### ", "</turn>")):
    text = text.replace("\\", "\\\\")
    for k, c in enumerate(controls):
        text = text.replace(c, f"\\{k}")
    return text


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        before, text, late = None, "", 0
        for *_, role, said in turns:
            ok = (before, role) in MOVES
            late += not ok
            name = NAMES.get(role) or "=" + escape(role, ("### ", "</turn>", ":", "("))
            text += f"### {name}{'' if ok else ' (out of turn)'}: {escape(said)}</turn>\n"
            before = role if role in NAMES else before
        out[conv] = (len(turns), late == 0 and before == "assistant", late, text, [(r, x) for *_, r, x in turns],
                     "".join(x for *_, r, x in turns if r == "assistant"))
    return out


def check(spark, rows):
    got, want = run(spark, rows), plain(rows)
    assert set(got) == set(want)
    for conv, r in got.items():
        assert (r.n_turns, r.valid, r.n_late, r.formatted, [(b.role, b.text) for b in r.back], r.loss) == want[conv]
        assert "".join(s.text for s in r.segments) == r.formatted and len(r.segments) == 3 * r.n_turns
        assert sum(b.late for b in r.back) == r.n_late


def test_hostile_texts_and_roles(spark):
    pieces = ["\\", "### ", "</turn>", "\n", "###", " ", "0", "\\0", "\\1", "User: ", "é😀", "</turn", ">", ": ", "=", "(", " (out of turn)", ""]
    r = random.Random(1)
    said = lambda: "".join(r.choice(pieces) for _ in range(r.randrange(9)))
    roles = ["user", "assistant", "system", "User", "tool: x", "=", "a (out of turn)", "\\2", "", None]
    rows = [(k % 90, r.randrange(6), r.choice(roles), r.choice([None, said(), said()])) for k in range(700)]
    rows += [(200, t, ["user", "assistant"][t % 2], said()) for t in range(300)]
    check(spark, rows)


def test_ties_nulls_and_repeats(spark):
    rows = [(None, None, None, None), (None, 0, "user", "b"), (None, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 0, "user", "u")]
    check(spark, rows)
    assert run(spark, []) == {}


def test_long_conversation_and_long_text(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], str(t)) for t in range(5000)] + [(2, 0, "user", "\\### </turn> é" * 100_000), (2, 1, "assistant", "")]
    check(spark, rows)


def test_a_template_of_ones_own(spark):
    moves = {"start": {"user": "asked"}, "asked": {"assistant": "said", "tool": "used"}, "used": {"assistant": "said", "tool": "used"}, "said": {"user": "asked"}}
    own = C.Template(names={"user": "<u", "assistant": "<a"}, opening="<|", closing="|>", late="!", other="~", stop="<end>", gap="", in_loss=frozenset({"assistant", "tool"}),
                     accepting=frozenset({"said"}), moves=moves, resume={})
    rows = [(1, 0, "user", "<|u|>"), (1, 1, "tool", "<end>"), (1, 2, "tool", "t"), (1, 3, "assistant", "a"), (2, 0, "assistant", "early"), (2, 1, "user", "q")]
    got = run(spark, rows, own)
    assert got[1].valid and got[1].loss == "<end>ta" and got[1].formatted.count("<end>") == 4
    assert [(b.role, b.text, b.late) for b in got[2].back] == [("assistant", "early", True), ("user", "q", False)] and not got[2].valid
    for bad in ({"stop": "a0"}, {"opening": "</turn>x"}, {"stop": "aba"}, {"closing": ""}, {"names": {"user": "x", "tool": "x"}}, {"accepting": frozenset({"nowhere"})}):
        with pytest.raises(ValueError):
            C.Template(**{"names": own.names, "moves": moves, "resume": {}, "accepting": frozenset({"said"}), **bad})


def test_plan_is_native_with_one_shuffle(spark):
    text = queries.op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text and text.count("Exchange hashpartitioning") == 1
