import hashlib
import random

import duckdb

from corpusgraph.llm import chat
from corpusgraph.llm.all_queries import QUERIES, SQL

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS] ", " [/SYS]", "[ROLE 41]", " [/ROLE]", "[ANS+] ", "<\\/s>", "[\\\\INST]", "\\",
         " ", "\n", "é😀", "ok", "[", "]"]


def test_every_conversation_comes_back(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool]", "", None]),
             rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 9)))]))
            for c in range(80) for t in range(rng.randint(1, 6))]
    rows += [(500, None, "user", "late " * 20000), (None, 1, "assistant", "x </s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.conversations(df.repartition(3)).collect()}
    assert got == want
    for r in chat.report(df).collect():
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(want[r.conv_id]), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()


def test_repeated_rows_ties_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")],
                               "conv_id long, turn long, role string, text string")
    assert [t.text for t in chat.conversations(df).first().turns] == ["a", "a", "b"]
    assert chat.report(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = QUERIES["op5_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    df = QUERIES["op5_chat_format"](spark, folder)
    rel = con.execute(SQL["op5_chat_format"])
    at = [[d[0] for d in rel.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
