"""Quotation linking: conversations in reply order, without the quotes in them.

Each line of a message has a quote level, the number of > before it. Runs of lines of one level
are passages; passages and single lines are normalised and hashed. What a message quotes is
joined to the first message of the conversation that wrote it, which makes replies out of turns.
Threads are found by doubling pointers, so that a chain of n replies takes log2(n) joins and
no conversation is ever gathered in one task. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import stored, table

QUOTE = r"^(?:[ \t]*>)+"
#: A line that only introduces a quote, in the languages of the corpus.
ATTRIBUTION = r"(?i)^(on|am|le|el)\b.*(wrote|schrieb|écrit|escribió)\s*:$"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds lines (level, body) and text without quotes."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda s: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(s, QUOTE, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(s, QUOTE, "").alias("body")))
    out = messages.withColumn("lines", lines)
    # kept together with a row id, so that filters on the lines don't parse the text again
    out = out.withColumn("row", F.monotonically_increasing_id())
    marked = F.transform("lines", lambda x, i: F.struct(
        x.level.alias("level"), x.body.alias("body"),
        ((x.level == 0) & (F.coalesce(F.get("lines", i + 1).level, F.lit(0)) > 0)
         & F.trim(x.body).rlike(ATTRIBUTION)).alias("intro")))
    own = F.transform(F.filter(marked, lambda x: (x.level == 0) & ~x.intro), lambda x: x.body)
    return out.withColumn("own", F.regexp_replace(F.trim(F.regexp_replace(
        F.array_join(own, "\n"), r"\n{3,}", "\n\n")), r"^\n+|\n+$", ""))


def units(lines: DataFrame) -> DataFrame:
    """One row per message, level and different passage or line: level, hash, chars."""
    # a passage begins where the level changes or a blank line stands
    joined = F.array_join(F.transform("lines", lambda x, i: F.concat(
        F.when((i == 0) | (x.level != F.get("lines", i - 1).level) | (F.trim(x.body) == ""),
               F.concat(F.lit("\x02"), x.level.cast("string"), F.lit("\x01"))).otherwise(F.lit("")),
        x.body)), "\n")
    passages = F.transform(F.filter(F.split(joined, "\x02"), lambda s: s != ""), lambda s: F.struct(
        F.split(s, "\x01")[0].cast("int").alias("level"), _normal(F.split(s, "\x01")[1]).alias("text")))
    single = F.transform("lines", lambda x: F.struct(x.level.alias("level"), _normal(x.body).alias("text")))
    each = lines.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(passages, single))).alias("u"))
    return each.filter("u.text != ''").select(
        "conv_id", "turn", "u.level", F.md5("u.text").alias("hash"), F.length("u.text").alias("chars"))


def replies(lines: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_linked for messages that quote an earlier one."""
    quoting = lines.filter(F.exists("lines", lambda x: x.level > 0) & F.col("conv_id").isNotNull()
                           & F.col("turn").isNotNull())
    quotes = units(quoting).filter("level > 0").groupBy("conv_id", "turn", "hash").agg(
        F.min("level").alias("level"), F.max("chars").alias("chars"))
    written = units(lines.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")).filter(
        "level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("parent_turn"))
    linked = quotes.join(written, ["conv_id", "hash"]).filter("parent_turn < turn")
    each = linked.groupBy("conv_id", "turn", "parent_turn").agg(
        F.min("level").alias("level"), F.sum("chars").alias("chars"), F.count("*").alias("k"))
    best = each.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("near"), "chars", "parent_turn")).alias("best"),
        F.sum("k").alias("n_linked"))
    return best.select("conv_id", "turn", F.col("best.parent_turn").alias("parent_turn"), "n_linked")


def threads(links: DataFrame) -> DataFrame:
    """root_turn and reply_depth of links (conv_id, turn, parent_turn), by pointer doubling."""
    links = links.withColumn("at", F.col("parent_turn")).withColumn("depth", F.lit(1))
    done, going = None, stored(links.withColumn("end", F.lit(False)), "replies")
    while True:
        ahead = going.select("conv_id", F.col("turn").alias("at"), F.col("at").alias("next"),
                             F.col("depth").alias("more"), F.col("end").alias("ended"))
        going = stored(going.join(ahead, ["conv_id", "at"], "left").select(
            "conv_id", "turn", "parent_turn", "n_linked",
            F.when(F.col("end"), F.col("at")).otherwise(F.coalesce("next", "at")).alias("at"),
            F.when(F.col("end"), F.col("depth")).otherwise(
                F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            (F.col("end") | F.col("next").isNull() | F.col("ended")).alias("end")), "replies")
        if not going.filter("NOT end").limit(1).count():
            return going.select("conv_id", "turn", "parent_turn", "n_linked",
                                F.col("at").alias("root_turn"), F.col("depth").alias("reply_depth"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) as replies, one row per message.

    conv_id, turn, role, text (without quotes and the lines that introduce them), parent_turn (the
    message that it answers, null if it quotes none), root_turn, reply_depth, n_quoted (quoted
    lines), n_linked (quoted passages and lines found in earlier messages), chat (the message under
    its role). Sorted by conv_id, root_turn, turn the rows are the conversations in reply order:
    threads one after the other, answers after what they answer.

    The parent is the message with the most quoted characters at the lowest quote level, ties to
    the latest turn. Passages written by several messages belong to the first. A null text is
    empty; with a null conv_id or turn a message is on its own. Rows that repeat conv_id and turn
    share their quotes and keep their own text. An empty table gives no rows; other columns
    are not looked at.
    """
    lines = parsed(messages.select("conv_id", "turn", "role", "text"))
    found = threads(replies(lines))
    out = lines.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size(
        F.filter("lines", lambda x: x.level > 0)).cast("long").alias("n_quoted"))
    return out.join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"), "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "text").alias("chat"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role,
         regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
l AS (SELECT r, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM m),
x AS (SELECT r, conv_id, turn, p, regexp_replace(line, '^(?:[ \t]*>)+', '') AS body,
             length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS lv FROM l),
y AS (SELECT *, lag(lv) OVER w AS pl, coalesce(lead(lv) OVER w, 0) AS nl FROM x
      WINDOW w AS (PARTITION BY r ORDER BY p)),
own AS (
  SELECT r, regexp_replace(trim(regexp_replace(string_agg(body, chr(10) ORDER BY p), '\n{3,}', chr(10) || chr(10), 'g'), ' '),
                           '^\n+|\n+$', '', 'g') AS text
  FROM y WHERE lv = 0 AND NOT (nl > 0 AND regexp_matches(trim(body, ' '),
                               '(?i)^(on|am|le|el)\b.*(wrote|schrieb|écrit|escribió)\s*:$')) GROUP BY r),
run AS (SELECT *, sum(CASE WHEN p = 1 OR lv <> pl OR trim(body, ' ') = '' THEN 1 ELSE 0 END)
               OVER (PARTITION BY r ORDER BY p) AS run FROM y),
said AS (
  SELECT r, conv_id, turn, any_value(lv) AS lv, string_agg(body, chr(10) ORDER BY p) AS s FROM run GROUP BY r, conv_id, turn, run
  UNION ALL SELECT r, conv_id, turn, lv, body FROM y),
unit AS (SELECT conv_id, turn, lv, s FROM (
  SELECT conv_id, turn, lv, lower(trim(regexp_replace(s, '\s+', ' ', 'g'), ' ')) AS s FROM said) WHERE s <> ''),
quote AS (SELECT conv_id, turn, s, min(lv) AS lv FROM unit WHERE lv > 0 GROUP BY ALL),
written AS (SELECT conv_id, s, min(turn) AS parent FROM unit WHERE lv = 0 GROUP BY ALL),
link AS (SELECT q.conv_id, q.turn, w.parent, min(q.lv) AS lv, sum(length(q.s)) AS chars, count(*) AS k
         FROM quote q JOIN written w ON w.conv_id = q.conv_id AND w.s = q.s AND w.parent < q.turn GROUP BY ALL),
best AS (SELECT conv_id, turn, arg_max(parent, (-lv, chars, parent)) AS parent, sum(k)::BIGINT AS n_linked
         FROM link GROUP BY ALL),
climb AS (
  SELECT conv_id, turn, parent AS up, 1 AS depth FROM best
  UNION ALL
  SELECT c.conv_id, c.turn, b.parent, c.depth + 1 FROM climb c JOIN best b ON b.conv_id = c.conv_id AND b.turn = c.up),
root AS (SELECT conv_id, turn, arg_max(up, depth) AS root_turn, max(depth) AS reply_depth FROM climb GROUP BY ALL),
marks AS (SELECT r, count(*) FILTER (lv > 0) AS n_quoted FROM y GROUP BY r)
SELECT m.conv_id, m.turn, role, coalesce(text, '') AS text, best.parent AS parent_turn,
       coalesce(root_turn, m.turn) AS root_turn, coalesce(reply_depth, 0) AS reply_depth, n_quoted,
       coalesce(n_linked, 0) AS n_linked, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') AS chat
FROM m JOIN marks USING (r) LEFT JOIN own USING (r)
LEFT JOIN best ON best.conv_id = m.conv_id AND best.turn = m.turn
LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
"""
