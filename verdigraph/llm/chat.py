"""Chat formatting: conversations as turn-aligned windows within a token budget, each target under the loss mask exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: The template of a turn is OPEN role MID text END. Inside roles and texts a backslash is doubled, then each mark gets one after its first character.
OPEN, MID, END = "[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, MID, END):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_windows(turns: DataFrame, budget: int = 512, history: int = 2, history_budget: int = 128, overhead: int = 3) -> DataFrame:
    """conv_id, window, formatted, n_context, n_tokens, spans for ``turns(conv_id, turn, role, text)``: one row for each window of a conversation.

    Tokens are words plus ``overhead`` for a turn's marks. A window takes the next turns while all it holds stays within ``budget``; a turn that is
    beyond it on its own has a window of its own, without context. Any other window from the second on begins with ``n_context`` turns that earlier
    windows had, as far as they leave room for its first new turn: the system turn, if the conversation starts with one, then of the turns before it the
    last ``history`` or fewer that have ``history_budget`` tokens at most. ``spans`` are the code point ranges of ``formatted`` under the loss mask: the
    escaped texts of the assistant turns that are new in this window.
    Turns go by number; equal numbers by role and text, repeated rows are turns of their own. Null roles and texts are empty, a null conv_id is one
    conversation, null turns come first. An empty table gives an empty result. Other columns are not read, whatever their names. A conversation's turns
    meet in one row, so a conversation may have as many code points as one value can, some hundred million.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + overhead)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "before", "role", "text", "tokens"))).alias("turns"))
    t = F.col("turns")
    system = F.get(t, F.lit(0))
    convs = convs.withColumn("n", F.size(t)).withColumn("first", F.when(system["role"] == "system", 1).otherwise(0)).withColumn("system_tokens", F.when(F.col("first") == 1, system["tokens"]).otherwise(F.lit(0)))
    sums = F.col("sums")
    convs = convs.withColumn("sums", F.concat(F.transform(t, lambda x: x["before"]), F.array(F.element_at(t, -1)["before"] + F.element_at(t, -1)["tokens"])))
    turn_tokens = lambda i: F.get(sums, i + 1) - F.get(sums, i)
    keeps = lambda i: (i > 0) & (F.col("first") == 1) & (F.col("system_tokens") + turn_tokens(i) <= budget)
    room = lambda i: F.least(F.lit(history_budget), F.greatest(F.lit(0), budget - turn_tokens(i) - F.when(keeps(i), F.col("system_tokens")).otherwise(F.lit(0))))
    reach = lambda i: F.greatest(F.least(i, F.col("first")), i - history)
    opened = lambda i: F.struct(keeps(i).alias("system"), F.get(F.filter(F.sequence(reach(i), i), lambda j: F.get(sums, i) - F.get(sums, j) <= room(i)), F.lit(0)).alias("from"))
    convs = convs.withColumn("opened", F.transform(F.sequence(F.lit(0), F.col("n") - 1), opened))

    def step(acc, i):
        o = F.get("opened", i)
        again = F.when(o["system"], F.col("system_tokens")).otherwise(F.lit(0)) + F.get(sums, i) - F.get(sums, o["from"])
        opens = (i == 0) | (acc["used"] + turn_tokens(i) > budget)
        return F.struct((F.when(opens, again).otherwise(acc["used"]) + turn_tokens(i)).alias("used"), F.when(opens, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"))

    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))
    convs = convs.withColumn("starts", F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), zero, step, lambda acc: acc["starts"]))
    part = lambda x, new: F.struct(F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(MID)).alias("head"), escaped(x["text"]).alias("body"), (F.lit(new) & (x["role"] == "assistant")).alias("learn"))

    def window(start, number):
        end, past, kept = F.coalesce(F.get("starts", number + 1), F.col("n")), F.get("opened", start)["from"], F.get("opened", start)["system"]
        context = F.concat(F.slice(t, F.lit(1), kept.cast("int")), F.slice(t, past + 1, start - past))
        tokens = F.get(sums, end) - F.get(sums, past) + F.when(kept, F.col("system_tokens")).otherwise(F.lit(0))
        parts = F.concat(F.transform(context, lambda x: part(x, False)), F.transform(F.slice(t, start + 1, end - start), lambda x: part(x, True)))
        return F.struct(number.alias("window"), F.size(context).alias("n_context"), tokens.alias("n_tokens"), parts.alias("parts"))

    cuts = convs.select("conv_id", F.transform("starts", window).alias("windows")).select("conv_id", F.inline_outer("windows"))

    def span(acc, p):
        at = acc["at"] + F.length(p["head"])
        to = at + F.length(p["body"])
        return F.struct((to + len(END)).alias("at"), F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(at.alias("start"), to.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return cuts.select("conv_id", "window", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), "n_context", "n_tokens", F.aggregate("parts", none, span, lambda acc: acc["spans"]).alias("spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns, loss, n_turns, formatted_chars: what ``chat_windows`` wrote, parsed from ``formatted``, its context count and spans."""
    pieces = F.split("formatted", END, -1)
    new = windows.withColumn("_pieces", pieces).withColumn("_new", F.slice("_pieces", F.col("n_context") + 1, F.size("_pieces") - 1 - F.col("n_context")))
    read = lambda p: F.split(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), r"\[/INST\]", 2)
    text = F.array_join(F.transform("_new", lambda p: F.concat(unescaped(F.get(read(p), F.lit(0))), F.lit("\n"), unescaped(F.get(read(p), F.lit(1))), F.lit("\n"))), "")
    loss = F.array_join(F.transform("spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    each = new.select("conv_id", F.struct("window", text.alias("turns"), loss.alias("loss")).alias("w"), F.size("_new").alias("n"), F.length("formatted").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    join = lambda k: F.array_join(F.transform("w", lambda x: x[k]), "")
    return whole.select("conv_id", join("turns").alias("turns"), join("loss").alias("loss"), "n_turns", "formatted_chars")


def op7_chat(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    back = read_back(chat_windows(table.unionByName(own)))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, (row_number() OVER o - 1)::BIGINT AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS tokens,
         17 + length(replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>'))
            + length(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')) AS chars
  FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
kept AS (
  SELECT conv_id, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS first, max(CASE WHEN i = 0 AND role = 'system' THEN tokens ELSE 0 END) AS tokens,
         max(CASE WHEN i = 0 AND role = 'system' THEN chars ELSE 0 END) AS chars FROM sized GROUP BY conv_id),
turns AS (SELECT s.*, k.first, k.tokens AS kept_tokens, k.chars AS kept_chars, coalesce(sum(s.tokens) OVER (PARTITION BY s.conv_id ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM sized s JOIN kept k USING (conv_id)),
fits AS (
  SELECT *, CASE WHEN i > 0 AND first = 1 AND kept_tokens + tokens <= 512 THEN 1 ELSE 0 END AS keeps FROM turns),
room AS (SELECT *, least(128, greatest(0, 512 - tokens - keeps * kept_tokens)) AS room FROM fits),
past AS (
  SELECT t.conv_id, t.i, min(p.i) AS j FROM room t JOIN turns p ON p.conv_id = t.conv_id AND p.i <= t.i AND p.i >= greatest(least(t.i, t.first), t.i - 2) AND t.before - p.before <= t.room GROUP BY t.conv_id, t.i),
context AS (
  SELECT t.conv_id, t.i, t.keeps * t.kept_tokens + coalesce(sum(p.tokens), 0) AS tokens, t.keeps * t.kept_chars + coalesce(sum(p.chars), 0) AS chars
  FROM room t JOIN past USING (conv_id, i) LEFT JOIN turns p ON p.conv_id = t.conv_id AND p.i >= past.j AND p.i < t.i GROUP BY t.conv_id, t.i, t.keeps, t.kept_tokens, t.kept_chars),
walk AS (
  SELECT conv_id, i, (c.tokens + t.tokens)::BIGINT AS used, true AS opens FROM turns t JOIN context c USING (conv_id, i) WHERE i = 0
  UNION ALL
  SELECT t.conv_id, t.i, (CASE WHEN w.used + t.tokens > 512 THEN c.tokens ELSE w.used END + t.tokens)::BIGINT, w.used + t.tokens > 512
  FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.i = w.i + 1 JOIN context c ON c.conv_id = t.conv_id AND c.i = t.i)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(t.chars) + sum(CASE WHEN opens THEN c.chars ELSE 0 END))::BIGINT AS formatted_chars
FROM turns t JOIN walk USING (conv_id, i) JOIN context c USING (conv_id, i) GROUP BY t.conv_id"""
