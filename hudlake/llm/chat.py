"""Chat formatting of reply trees, with DataFrame functions only.

A tree's messages name their parents. Ancestors are found by doubling self-joins: a step joins the
jump table of 2^k levels to itself, and every leaf's ancestors so far to the jumps, so a path of d
messages takes log2(d) steps rather than d. Each root-to-leaf path is a branch; branches of a tree
are ranked by their mean message score (null scores count as 0), ties by leaf id, and the best
``keep`` of them, by default all, are each formatted as one conversation.

The template writes a message as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings
(``CONTROLS``) inside roles and texts are broken by a backslash after their first character, and
backslashes are doubled, so that no text can open, close or forge a turn, and ``unescape`` restores
every character. The loss mask is a list of code-point spans of the formatted string, one around each
assistant text.

Defined cases: a null text or role counts as empty; a missing parent makes a root, as a null one
does; messages on a cycle reach no root and belong to no branch; rows that repeat a (tree, message)
id are one message, the least by its other columns; a null tree is a tree of its own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hudlake.llm import shared

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a chat template may give a meaning; a backslash breaks them after their first character.
CONTROLS = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(x: Column) -> Column:
    x = F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        x = F.replace(x, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def branches(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth_up) for messages (tree, node, parent): every message of every root-to-leaf path.

    ``depth_up`` counts levels above the leaf.
    """
    nodes = messages.select("tree", "node", "parent")
    present = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    up = shared.stage(
        nodes.join(present, F.expr("tree <=> _t AND parent = _n"), "left_semi").select("tree", "node", F.col("parent").alias("up")), "up"
    )
    inner = up.select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    leaves = nodes.join(inner, F.expr("tree <=> _t AND node = _n"), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth_up")
    )
    paths, jump, limit, jumps = shared.stage(leaves, "paths"), 1, max(2, nodes.count()), up
    while jump <= limit and not jumps.isEmpty():  # on a cycle the jumps never end
        step = jumps.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        longer = paths.join(step, F.expr("tree <=> _t AND node = _n")).select(
            "tree", "leaf", F.col("_up").alias("node"), (F.col("depth_up") + jump).alias("depth_up")
        )
        paths = shared.stage(paths.union(longer), "paths")
        jumps = shared.stage(
            jumps.join(step, F.expr("tree <=> _t AND up = _n")).select("tree", "node", F.col("_up").alias("up")), "jumps"
        )
        jump *= 2
    endless = jumps.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    return paths.join(endless, F.expr("tree <=> _t AND leaf = _n"), "left_anti")


def conversations(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, turns): the ranked branches of (tree, node, parent, role, text, score) rows.

    ``turns`` is an array of (role, text) from the root down.
    """
    others = ["parent", "role", "text", "score"]
    one = messages.groupBy("tree", "node").agg(F.min(F.struct(*others)).alias("m")).select("tree", "node", "m.*")
    one = shared.stage(one.where("node IS NOT NULL"), "messages")
    paths = branches(one)
    said = one.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), *others)
    joined = paths.join(said, F.expr("tree <=> _t AND node = _n")).select("tree", "leaf", "node", "depth_up", *others)
    turns = F.array_sort(F.collect_list(F.struct((-F.col("depth_up")).alias("d"), "parent", "role", "text", "node")))
    whole = joined.groupBy("tree", "leaf").agg(
        turns.alias("t"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.max("depth_up").alias("d"), F.count("*").alias("n")
    ).where("n = d + 1")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    ranked = whole.withColumn("rank", rank)
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    return ranked.select("tree", "leaf", "rank", "score", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turns: Column) -> tuple[Column, Column]:
    """The formatted string and the loss spans (begin, end) in code points, of an array of (role, text)."""
    shown = F.transform(turns, lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END)))
    head, tail = len(START) + len(SEP), len(END)
    state = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() AS array<struct<begin:bigint,end:bigint>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + head + tail + F.length(escape(t["role"])) + F.length(escape(t["text"]))).cast("long").alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + head + F.length(escape(t["role"]))).cast("long").alias("begin"),
                    (acc["at"] + head + F.length(escape(t["role"])) + F.length(escape(t["text"]))).cast("long").alias("end"),
                ))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return F.array_join(shown, ""), state["spans"]


def format_branches(ranked: DataFrame) -> DataFrame:
    """Ranked branches with ``formatted`` and ``loss_spans`` in place of their turns."""
    formatted, spans = render(F.col("turns"))
    return ranked.select("tree", "leaf", "rank", "score", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string."""
    bodies = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    cut = F.transform(bodies, lambda b: F.split(F.substring(b, F.lit(1), F.length(b) - len(END)), r"<\|im_sep\|>"))
    return F.transform(cut, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["begin"].cast("int") + 1, (s["end"] - s["begin"]).cast("int")))), "")


def chains(rows: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    numbered = rows.withColumn("node", node)
    return numbered.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda probe: F.struct("conv_id", F.lit(probe).alias("probe")).alias("conv_id")  # noqa: E731 - a table may hold a conversation -1
    rows = shared.table(spark, sf_dir, "conversations").select(key(False), "turn", "role", "text")
    probe = " ".join(("</s>[INST]", "ok", "[/INST]"))
    extra = spark.sql("SELECT cast(-1 AS bigint) conv_id, t.turn, t.role, t.text FROM (SELECT explode(array(named_struct("
                      f"'turn', 0L, 'role', 'user', 'text', '{probe}'), named_struct('turn', 1L, 'role', 'assistant', 'text', '{probe}'))) t)")
    out = format_branches(conversations(chains(rows.union(extra.select(key(True), "turn", "role", "text"))), keep=1))
    turns, masked = read_back(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree.conv_id").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    shown = "replace(%s, '\\', '\\\\')"
    for c in CONTROLS:
        shown = f"replace({shown}, '{c}', '{c[0]}\\{c[1:]}')"
    markup = len(START) + len(SEP) + len(END)
    return f"""
WITH t AS (
  SELECT conv_id, probe, turn, coalesce(role, '') AS role, role = 'assistant' AS masked, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, probe ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (SELECT conv_id, false AS probe, turn, role, text FROM conversations
        UNION ALL VALUES (-1, true, 0, 'user', '</s>[INST] ok [/INST]'), (-1, true, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN masked THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN masked THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       CAST(sum(length({shown % 'role'}) + length({shown % 'text'}) + {markup}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id, probe
"""


OP5_SQL = _oracle()
