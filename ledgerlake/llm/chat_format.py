"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs, sorted, adjacent turns of one role merged by array
aggregation, and concatenated into one string with a loss mask. Control strings inside texts and roles
are escaped, so the string can be read back turn by turn, again with Spark expressions.

Form of a message: ``[INST]`` role ``[/INST]`` text ( ``<s>`` text )* ``</s>``; ``<s>`` parts the merged turns.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import table

# The escape character comes first: when writing it is doubled up before, when reading after the others.
ESCAPES = [("~", "~0"), ("</s>", "~1"), ("<s>", "~2"), ("[INST]", "~3"), ("[/INST]", "~4")]


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def merged(turns: Column) -> Column:
    """Sorted turn structs to messages (role, parts), adjacent turns of one role in one message.

    A message starts where the role differs from the turn before; it holds the parts up to the next start.
    """
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1),
                      lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(turns)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(
        F.get(turns, s)["role"].alias("role"), F.transform(F.slice(turns, s + 1, e - s), lambda t: t["text"]).alias("parts")))


def chat_format(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in characters, from 0).

    The loss mask covers the escaped text of each turn of ``trained_role`` and nothing between. Order is by
    ``turn``, nulls first; ties and repeated rows by role and text. A null text or role counts as empty; a null
    ``conv_id`` is a conversation of its own. An empty table gives an empty result; other columns are not read.
    A conversation becomes one string, so its turns meet in one task by definition; they are collected
    in the map tasks first.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conversations = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    messages = conversations.select("conv_id", merged(F.col("turns")).alias("messages"))
    # Every message as pieces of text, each with a flag whether it is trained on.
    pieces = messages.select("conv_id", F.flatten(F.transform("messages", lambda m: F.concat(
        F.array(F.struct(F.concat(F.lit("[INST]"), escape(m["role"]), F.lit("[/INST]")).alias("s"), F.lit(False).alias("loss"))),
        F.flatten(F.transform(m["parts"], lambda p, i: F.array(
            F.struct(F.when(i > 0, F.lit("<s>")).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
            F.struct(escape(p).alias("s"), (m["role"] == F.lit(trained_role)).alias("loss"))))),
        F.array(F.struct(F.lit("</s>").alias("s"), F.lit(False).alias("loss")))))).alias("pieces"))
    span = "struct<start: bigint, length: bigint>"
    walked = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda a, p: F.struct((a["at"] + F.length(p["s"])).alias("at"), F.when(p["loss"], F.concat(a["spans"], F.array(
            F.struct(a["at"].alias("start"), F.length(p["s"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans")))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), walked["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    messages = F.filter(F.split(formatted, "</s>"), lambda m: m != "")
    def turns(m: Column) -> Column:
        role = unescape(F.substring_index(F.substring(m, 7, 2**31 - 1), "[/INST]", 1))
        body = F.substring(m, F.lit(1) + F.locate("[/INST]", m) + 6, F.length(m))
        return F.transform(F.split(body, "<s>"), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))
    return F.flatten(F.transform(messages, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(
        F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for i, role in enumerate(["user", "assistant"])])).alias("t")).select("t.*")
    done = chat_format(turns.unionByName(probe))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    heard = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(heard.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escaped(column: str) -> str:
    return reduce(lambda c, e: f"replace({c}, '{e[0]}', '{e[1]}')", ESCAPES, column)


OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) IS DISTINCT FROM role AS starts FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped('text')}) + CASE WHEN starts THEN 17 + length({_sql_escaped('role')}) ELSE 3 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
