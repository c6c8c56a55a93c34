"""Null ids, repeated rows, ties and very long texts of operators whose own tests lack them."""

from hudlake.llm import chat, quality, shared, simhash
from pyspark.sql import functions as F


def test_simhash_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d", 1), (None, "a b c d", 1), (5, "a b c d", 1), (5, "a b c d", 1), (7, None, 1), (8, "", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == [(False, 5, 5)] * 2 + [(False, 7, 7), (False, 8, 7)] + [(True, 0, 5)] * 2
    assert {r.fp for r in got if r.doc_id in (7, 8)} == {0}


def test_branches_of_equal_scores_go_by_leaf(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 3, 1, "assistant", "three", 1.0), (1, 2, 1, "assistant", "two", 1.0), (1, 4, 1, "assistant", "four", 2.0)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    assert [r.leaf for r in chat.conversations(m).orderBy("rank").collect()] == [4, 2, 3]
    assert [r.leaf for r in chat.conversations(m, keep=2).orderBy("rank").collect()] == [4, 2]


def test_very_long_turns_are_read_back(spark):
    long = "<|im_end|>\\ word " * 20_000
    m = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", long, 0.0)], "tree long, node long, parent long, role string, text string, score double")
    out = chat.format_branches(chat.conversations(m)).select(chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("x")).first()
    assert [(t.role, t.text) for t in out.t] == [("user", "q"), ("assistant", long)] and out.x == long


def test_good_rows_that_tie_at_the_cut_stay_together():
    assert quality.calibrate({10: 999, 20: 1}) == 10  # the one row above may go
    assert quality.calibrate({10: 998, 20: 2}) == 20  # two that tie may not, so neither goes


def test_workers_keep_only_what_the_stage_at_hand_uses():
    made = []
    for owner in ("a", "a", "b", "a"):
        shared.vacate(owner)
        shared.resident(owner, None, lambda: made.append(owner))
    assert made == ["a", "b", "a"]
    shared.vacate("")
    shared.give_back()


def test_batches_are_bounded_in_bytes_and_a_lower_limit_stays(spark):
    before = spark.conf.get(shared.ARROW_LIMIT)
    sizes = lambda: [r.n for r in shared.map_arrow(spark.range(40, numPartitions=1).selectExpr("repeat('x', 1000000) t"), count, "n long").collect()]

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    try:
        spark.conf.set(shared.ARROW_LIMIT, "64m")
        assert max(sizes()) <= 10 and int(spark.conf.get(shared.ARROW_LIMIT).removesuffix("b")) == shared.ARROW_BYTES
        spark.conf.set(shared.ARROW_LIMIT, str(1 << 20))
        assert max(sizes()) <= 3 and int(spark.conf.get(shared.ARROW_LIMIT).removesuffix("b")) == 1 << 20
    finally:
        spark.conf.set(shared.ARROW_LIMIT, before)
