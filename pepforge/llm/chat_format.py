"""Operator 4, chat formatting in budgeted windows, with DataFrame functions only.

Every conversation is cut into windows of whole turns. Prefix sums of the turns' tokens choose the spans: a span takes turns while
they fit in what the budget leaves beside the system turn and the history. A later window repeats the system turn (the first turn,
if its role is ``system``) and before its span as many of the turns just before as fit in ``history`` tokens. Targets are the
assistants' texts of the span; repeated ones are masked, so each is a target once. Turns are never cut: a turn larger than the
budget gets a span of its own.

Template: a window is ``<s>`` and its turns; a turn is ``[INST] role[/INST]text</s>``. In roles and texts, ``~`` becomes ``~0``, the
``<`` of ``<s>`` and ``</s>`` becomes ``~1``, the ``[`` of ``[INST]`` and ``[/INST]`` becomes ``~2``; ``unescaped`` turns that back.

The turns are numbered and kept as a table. Spans are chosen from their numbers alone (some 50 bytes a turn); the texts then join
the windows turn by turn, so no row holds more text than a window's budget and its largest turn, however long a conversation is.

Defined results: null role or text is the empty string; turns are ordered by (turn, role, text), nulls first; repeated rows are
turns of their own; rows with a null conv_id are one conversation; no rows give no windows. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Tokens that a turn's marks count.
MARKS = 3
#: Starts of windows that are gathered before they are put away, so that many windows aren't copied for each new one.
CHUNK = 1000


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("~"), F.lit("~0")), r"<(?=/?s>)", "~1"), r"\[(?=/?INST\])", "~2")


def unescaped(c: Column) -> Column:
    for code, mark in (("~1", "<"), ("~2", "["), ("~0", "~")):
        c = F.replace(c, F.lit(code), F.lit(mark))
    return c


def word_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 192, tokens=word_tokens) -> DataFrame:
    """A row for each window: conv_id, window (from 0), text, n_repeated (turns at its front that earlier windows hold already),
    loss (array of first, n: the code points of the targets in text, from 0), n_tokens. tokens: counts those of a text column."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit("[INST] "), escaped(role), F.lit("[/INST]"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumns({"head": F.length(head), "body": F.length(escaped(text)), "piece": F.concat(head, escaped(text), F.lit("</s>")), "tokens": (tokens(text) + MARKS).cast("long")})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("i", F.row_number().over(order) - 1)
    order = Window.partitionBy("conv_id").orderBy("i")
    turns = turns.withColumns({"end": F.sum("tokens").over(order), "char_end": F.sum(F.length("piece")).over(order)})
    turns = turns.withColumn("begin", F.col("end") - F.col("tokens")).withColumn("char", F.col("char_end") - F.length("piece"))
    turns = saved(turns.withColumn("back", F.min("i").over(Window.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, 0))), "chat-turns")
    one = F.struct("i", (F.col("role") == "system").alias("is_system"), "begin", "end", "char", "char_end", "back")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    system = F.when(F.col("t")[0]["is_system"], 1).otherwise(0)
    whole = whole.withColumn("system", system).withColumn("room", F.lit(budget - history) - F.when(F.col("system") == 1, F.col("t")[0]["end"]).otherwise(0))

    def step(a: Column, x: Column) -> Column:
        new = (x["i"] == 0) | ((x["end"] - a["base"] > F.col("room")) & (x["i"] > F.col("system")))
        full = new & (F.size(a["last"]) >= CHUNK)
        full_chunks = F.when(full, F.concat(a["chunks"], F.array(a["last"]))).otherwise(a["chunks"])
        last = F.when(full, F.array(x["i"])).when(new, F.concat(a["last"], F.array(x["i"]))).otherwise(a["last"])
        return F.struct(full_chunks.alias("chunks"), last.alias("last"), F.when(new, x["begin"]).otherwise(a["base"]).alias("base"))

    first = F.struct(F.array().cast("array<array<int>>").alias("chunks"), F.array().cast("array<int>").alias("last"), F.lit(0).cast("long").alias("base"))
    chosen = F.aggregate("t", first, step, lambda a: F.flatten(F.concat(a["chunks"], F.array(a["last"]))))
    whole = whole.withColumn("starts", chosen)

    def window(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(F.col("starts"), k + 1), F.size("t"))
        again = F.when(k == 0, 0).otherwise(F.col("system"))  # the system turn, repeated
        back = F.when(k == 0, 0).otherwise(F.least(start, F.greatest(F.get("t", start)["back"], F.col("system"))))
        lead = F.length(F.lit("<s>")) + F.when(again == 1, F.col("t")[0]["char_end"]).otherwise(0) - F.get("t", back)["char"]
        used = F.when(again == 1, F.col("t")[0]["end"]).otherwise(0) + F.get("t", stop - 1)["end"] - F.get("t", back)["begin"]
        return F.struct(k.alias("window"), start.alias("start"), stop.alias("stop"), back.alias("back"), again.alias("again"), lead.alias("lead"), used.alias("n_tokens"))

    spans = whole.select("conv_id", F.inline(F.transform("starts", window)))
    own = F.concat(F.when(F.col("again") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.sequence("back", F.col("stop") - 1))
    held = spans.withColumn("i", F.explode(own)).alias("s").join(turns.alias("t"), F.expr("s.conv_id <=> t.conv_id AND s.i = t.i"))
    piece = F.struct(F.col("s.i").alias("i"), "piece", (F.col("role") == "assistant").alias("said"), "char", "head", "body")
    once = [F.first(f"s.{c}").alias(c) for c in ("start", "back", "again", "lead", "n_tokens")]
    windows = held.groupBy("s.conv_id", "s.window").agg(F.array_sort(F.collect_list(piece)).alias("p"), *once)
    text = F.concat(F.lit("<s>"), F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    targets = F.filter("p", lambda x: (x["i"] >= F.col("start")) & x["said"])
    loss = F.transform(targets, lambda x: F.struct((F.col("lead") + x["char"] + x["head"]).cast("long").alias("first"), x["body"].cast("long").alias("n")))
    return windows.select("conv_id", "window", text.alias("text"), (F.col("again") + F.col("start") - F.col("back")).alias("n_repeated"), loss.alias("loss"), "n_tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """windows with turns (array of role, text: those that it doesn't repeat) and loss_text, both parsed from the formatted text."""
    pieces = F.split(F.substr(F.col("text"), F.lit(4)), "</s>")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def parsed(piece: Column) -> Column:
        head = F.substring_index(piece, "[/INST]", 1)
        return F.struct(unescaped(F.substr(head, F.lit(8))).alias("role"), unescaped(F.substr(piece, F.length(head) + 8)).alias("text"))

    under = F.array_join(F.transform("loss", lambda x: F.substr(F.col("text"), (x["first"] + 1).cast("int"), x["n"].cast("int"))), "")
    return windows.withColumns({"turns": F.transform(new, parsed), "loss_text": unescaped(under)})


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    marked = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), marked.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = read_back(format_windows(rows))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    parts = done.select("conv_id", F.struct("window", said.alias("said"), F.col("loss_text").alias("loss"), F.length("text").alias("chars"), F.size("turns").alias("n")).alias("w"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[f])
    digest = lambda f: F.sha2(F.encode(joined(f), "UTF-8"), 256)
    return whole.select("conv_id", total("n").alias("n_turns"), digest("said").alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), total("chars").alias("formatted_chars"), F.size("w").cast("long").alias("n_windows"))


def _sql_escaped(c: str) -> str:
    for mark, code in (("~", "~0"), ("<s>", "~1s>"), ("</s>", "~1/s>"), ("[INST]", "~2INST]"), ("[/INST]", "~2/INST]")):
        c = f"replace({c}, '{mark}', '{code}')"
    return c


ORACLE_OP4 = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, len(regexp_extract_all(text, '\S+')) + {MARKS} AS tokens,
  length('[INST] ' || {_sql_escaped('role')} || '[/INST]' || {_sql_escaped('text')} || '</s>') AS n FROM c),
p AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS stop, CAST(sum(tokens) OVER w AS BIGINT) - tokens AS begin_at FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
s AS (SELECT conv_id, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys, 1024 - 192 - max(CASE WHEN i = 0 AND role = 'system' THEN tokens ELSE 0 END) AS room,
  max(CASE WHEN i = 0 AND role = 'system' THEN n ELSE 0 END) AS sys_n, max(i) + 1 AS n_turns FROM p GROUP BY conv_id),
r(conv_id, first_i) AS (SELECT conv_id, CAST(0 AS BIGINT) FROM s UNION ALL
  SELECT r.conv_id, min(p.i) FROM r JOIN s ON s.conv_id = r.conv_id JOIN p b ON b.conv_id = r.conv_id AND b.i = r.first_i JOIN p ON p.conv_id = r.conv_id AND p.i > greatest(r.first_i, s.sys)
  WHERE p.stop - b.begin_at > s.room GROUP BY r.conv_id, r.first_i),
w AS (SELECT conv_id, first_i, coalesce(lead(first_i) OVER (PARTITION BY conv_id ORDER BY first_i), s.n_turns) AS end_i, sys, sys_n FROM r JOIN s USING (conv_id)),
k AS (SELECT w.*, CASE WHEN w.first_i = 0 THEN 0 ELSE least(w.first_i, greatest(min(h.i), w.sys)) END AS back FROM w JOIN p b ON b.conv_id = w.conv_id AND b.i = w.first_i
  JOIN p h ON h.conv_id = w.conv_id AND h.begin_at BETWEEN b.begin_at - 192 AND b.begin_at GROUP BY w.conv_id, w.first_i, w.end_i, w.sys, w.sys_n),
f AS (SELECT k.conv_id, k.first_i, 3 + CASE WHEN k.first_i > 0 THEN k.sys_n ELSE 0 END + sum(p.n) AS chars FROM k JOIN p ON p.conv_id = k.conv_id AND p.i >= k.back AND p.i < k.end_i GROUP BY k.conv_id, k.first_i, k.sys_n),
g AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) AS n_windows FROM f GROUP BY conv_id)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(p.role || chr(10) || p.text || chr(10), '' ORDER BY p.i)) AS turns_sha256,
  length(coalesce(string_agg(p.text, '' ORDER BY p.i) FILTER (WHERE p.role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(p.text, '' ORDER BY p.i) FILTER (WHERE p.role = 'assistant'), '')) AS loss_sha256, any_value(g.formatted_chars) AS formatted_chars, any_value(g.n_windows) AS n_windows
FROM p JOIN g USING (conv_id) GROUP BY p.conv_id
"""
