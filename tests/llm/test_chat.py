import random

from codeloom.llm import chat
from codeloom.plans.oracle import compare, duck
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_matches_sql(spark):
    from codeloom.llm.queries import ORACLE, QUERIES

    ok, msg = compare(QUERIES["op5_chat_formatting"](spark, SF), ORACLE["op5_chat_formatting"], duck(SF))
    assert ok, msg


def test_plan_is_native(spark):
    from codeloom.llm.queries import QUERIES

    plan = QUERIES["op5_chat_formatting"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_valid(roles):
    state = "start"
    moves = {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
    for r in roles:
        if r not in moves.get(state, ()):
            return False
        state = r
    return state == "assistant"


def test_round_trip_of_odd_texts_and_roles(spark):
    rng = random.Random(14)
    bits = ["\\", "\\\\", "#", "### ", "<", "</turn>\n", " </turn>\n", "\\h", "\\l", "\\c", "h", "l", ":", "@", "é", "🙂", "\n", "### Assistant: ", "User"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "User", "", "a:b", "#<\\:", "@x"])
            rows.append((conv, turn, role, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))))
    rows += [(100, 0, "user", "x" * 300_000), (100, 1, "assistant", "<#\\" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA + ", place int, segment string")
    out = chat.assemble(chat.segments(df)).select(
        "conv_id", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_texts(F.col("formatted"), F.col("spans")).alias("learned")
    )
    got = {r.conv_id: r for r in out.collect()}
    assert len(got) == 61
    for conv, r in got.items():
        own = [(role, text) for c, _, role, text in sorted(rows, key=lambda x: (x[0], x[1])) if c == conv]
        assert [(t.role, t.text) for t in r.turns] == own
        assert list(r.learned) == [text for role, text in own if role == "assistant"]
        assert r.valid == brute_valid([role for role, _ in own])
        assert r.formatted.count("### ") == r.formatted.count(" </turn>\n") == len(own)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, 0, "user", None), (None, 1, "assistant", "a"), (1, None, None, "t"), (1, 0, "user", "q"), (1, 0, "user", "q"), (2, 0, "assistant", None)]
    got = {r.conv_id: r for r in chat.assemble(chat.segments(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[None].formatted == "### User:  </turn>\n### Assistant: a </turn>\n" and got[None].valid
    assert got[1].formatted == "### @: t </turn>\n" + "### User: q </turn>\n" * 2 and not got[1].valid
    assert got[2].formatted == "### Assistant:  </turn>\n" and not got[2].valid and len(got[2].spans) == 1
    assert chat.assemble(chat.segments(spark.createDataFrame([], SCHEMA))).collect() == []
