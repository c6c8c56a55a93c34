import hashlib
from pathlib import Path

import duckdb
import pytest
from hudlake.llm import chat
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "tree long, node long, parent long, role string, text string, score double, turns string"


def test_escapes_are_reversible_and_leave_no_control(spark):
    texts = ["", "\\", "\\\\<s>", "<<s>", "<|im_end|><|im_end|>", "<\\|im_start|>", "[INST][/INST]</s>", "<<SYS>><</SYS>>", "a\\n<|im_sep|>\n", "<|im_<|im_end|>end|>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in rows.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROLS)


def test_tree_gives_ranked_paths(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 4.0), (1, 4, 2, "user", "c", 9.0),
        (1, 5, 4, "assistant", "<s>", None), (2, 7, 99, None, None, None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0),
        (3, 3, 1, "user", "off the loop", 1.0), (1, 3, 1, "assistant", "b", 4.0), (None, 1, None, "user", "no tree", 1.0), (1, None, 1, "user", "no id", 1.0),
    ]
    got = chat.conversations(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).orderBy("tree", "rank").collect()
    by = {(r.tree, r.rank): [(t.role, t.text) for t in r.turns] for r in got}
    assert by == {
        (1, 1): [("user", "q"), ("assistant", "a"), ("user", "c"), ("assistant", "<s>")],
        (1, 2): [("user", "q"), ("assistant", "b")],
        (2, 1): [(None, None)],
        (None, 1): [("user", "no tree")],
    }
    assert len(chat.conversations(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), keep=1).collect()) == 3
    out = chat.format_branches(chat.conversations(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)))
    out = out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    first = out.where("tree = 1 AND rank = 1").first()
    assert [(t.role, t.text) for t in first.back] == by[1, 1] and first.loss == "a<s>"


def test_long_chain(spark):
    n = 700
    rows = [(5, i, i - 1 if i else None, "user", str(i), 0.0, "") for i in range(n)]
    got = chat.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [[t.text for t in r.turns] for r in got] == [[str(i) for i in range(n)]]


def test_empty_table(spark):
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.execute(chat.OP5_SQL).fetchall())
    got = sorted(tuple(r) for r in chat.op5_chat_formatting(spark, SF).collect())
    assert got == want
    probe = next(r for r in got if r[0] == -1)
    text = "</s>[INST] ok [/INST]"
    assert probe[2] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and probe[3] == len(text)


def test_a_conversation_of_the_probes_number(spark, tmp_path):
    """A conversation -1 of the table is a row of its own beside the probe, which stays as the contract states it."""
    rows = [(-1, 0, "user", "hello"), (-1, 1, "assistant", "yes"), (-1, 2, "user", None), (3, 0, "assistant", "x"), (None, 0, "user", "n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in chat.op5_chat_formatting(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(chat.OP5_SQL).fetchall(), key=repr)
    assert sorted((r[1], r[3]) for r in got if r[0] == -1) == [(2, 21), (3, 3)]
