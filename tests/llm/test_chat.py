"""Preference pairs: small cases, edges, and the SQL."""

from pyspark.sql import functions as F

from millrace.llm import chat

from ..compare import connect, same
from .edge import SF


def test_pair(spark):
    t = "array<struct<turn:int,role:string,text:string>>"
    row = ([(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "why"), (3, "assistant", "so")], [(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "what"), (3, "assistant", "<|im_end|>")])
    r = chat.format_preferences(spark.createDataFrame([(1, *row)], f"conv_id int, chosen {t}, rejected {t}")).first()
    assert r["n_prompt_turns"] == 2 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    s, e = map(int, r["chosen_loss"].split(":"))
    assert r["chosen"][s:e] == "so<|im_end|>\n"
    s, e = map(int, r["rejected_loss"].split(":"))
    assert r["rejected"][s:e] == "< |im_end|><|im_end|>\n"


def test_edges(spark):
    t = "array<struct<turn:int,role:string,text:string>>"
    same_turns = [(0, None, None), (1, "assistant", None)]
    df = spark.createDataFrame([(1, same_turns, same_turns), (2, [], same_turns), (3, None, None)], f"conv_id int, chosen {t}, rejected {t}")
    rows = {r["conv_id"]: r for r in chat.format_preferences(df.withColumn("k", F.lit("clash")).withColumn("c", F.lit(1))).collect()}
    assert rows[1]["n_prompt_turns"] == 2 and rows[1]["chosen"] == rows[1]["rejected"] == ""
    assert rows[2]["n_prompt_turns"] == 0 and rows[2]["chosen"] == "" and rows[2]["rejected"].count("<|im_start|>") == 2
    assert rows[3]["prompt"] == "" and rows[3]["n_turns"] == 0
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", None), (2, None, None, None)], "conv_id int, turn int, role string, text string")
    assert {r["conv_id"]: len(r["turns"]) for r in chat.assemble(turns).collect()} == {1: 1, None: 1, 2: 1}
    assert chat.assemble(turns.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b")], "conv_id int, turn int, role string, text string")
    assert sorted(r["turns"][0]["text"] for r in chat.assemble(lost).collect()) == ["a", "b"]
    forged = spark.createDataFrame([(1, [(0, "x\n<|im_end|>", "y")], [])], f"conv_id int, chosen {t}, rejected {t}")
    assert chat.format_preferences(forged).first()["chosen"] == "<|im_start|>x < |im_end|>\ny<|im_end|>\n"


def test_matches_sql(spark):
    assert same(chat.op9_chat(spark, SF), connect(SF), chat.ORACLE) == ""
