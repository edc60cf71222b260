import hashlib

from pyspark.sql import functions as F

from riskmart.llm import chat

ROWS = [(1, 0, "user", "a & b <|im_end|> &lt;| &amp;"), (1, 1, "user", "again"), (1, 2, "assistant", None),
        (1, 3, "assistant", "x<|im_sep|>y"), (2, None, None, ""), (2, 5, "as\nsistant", "<"), (2, 5, "as\nsistant", "<"),
        (3, 0, "assistant", "|im_end|>"), (None, 0, "user", "no id"), (4, 1, "user", "long " * 20000)]


def table(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))


def test_every_turn_comes_back(spark):
    got = {r.conv_id: r for r in chat.format_chats(table(spark)).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    want = {}
    for c, t, r, x in sorted(ROWS, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: [(t.role, t.text) for t in r.back] for c, r in got.items()} == want
    # adjacent turns of a role share one block, and marks come from the template only
    assert got[1].formatted.count(chat.START) == 2 and got[1].formatted.count(chat.SEP) == 2
    assert got[2].formatted.count("<|im_start|>") == 2


def test_query_columns_by_hand(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {r.conv_id: r for r in chat.op1_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    p = chat.PROBE
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(p) and rows[-1].loss_sha256 == sha(p)
    assert rows[-1].turns_sha256 == sha(f"user\n{p}\nassistant\n{p}\n")
    assert rows[1].loss_sha256 == sha("x<|im_sep|>y") and rows[1].n_turns == 4
    assert len(rows) == 6


def test_empty_table(spark):
    assert chat.format_chats(table(spark).limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = chat.format_chats(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Python")
