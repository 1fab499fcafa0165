"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply is trainable. A conversation whose last turn is no assistant's gets one more example, without a
trainable part, so that no turn is lost. A turn is written as ``[INST role]text[/INST]</s>``, after a
leading ``<s>`` for the conversation. Inside roles and texts ``&``, ``<``, ``[`` and ``]`` are written
as ``&amp;``, ``&lt;``, ``&#91;`` and ``&#93;``: then no text can hold a control string, and undoing it is exact.

Cases: null text or role counts as empty; turns in order of (turn, role, text), null turns first, and
repeated rows are turns of their own; rows with a null conversation id form one conversation, which one task
writes, as it does any conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BEGIN, OPEN, SHUT, CLOSE, END = "<s>", "[INST ", "]", "[/INST]", "</s>"
TRICK = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in (("]", "&#93;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, formatted, loss_start and loss_chars
    (the trainable span in code points of `formatted`; null in an example that only carries the last turns)."""
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # (turn, role, text) sorts as a struct; the head and the text of each turn are made once.
    made = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT)).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == "assistant").alias("ours"),
            ),
        ).alias("turns"),
    )
    last = F.size("turns") - 1
    ends = F.filter(
        F.sequence(F.lit(0), last),
        lambda k: F.get("turns", k)["ours"] | (k == last),
    )
    each = made.select("conv_id", "turns", F.posexplode(ends).alias("example", "k"))
    full = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + END))
    before = F.concat(F.lit(BEGIN), F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("k")), full), ""))
    return each.select(
        "conv_id",
        "example",
        (F.col("k") + 1).alias("n_turns"),
        before.alias("before"),
        F.get("turns", F.col("k")).alias("t"),
    ).select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("before", full(F.col("t"))).alias("formatted"),
        F.when(F.col("t.ours"), F.length("before") + F.length("t.head")).alias("loss_start"),
        F.when(F.col("t.ours"), F.length("t.body")).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    inner = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    parts = F.split(inner, CLOSE.replace("[", r"\[") + END)
    # The text ends with a mark, so the last part is empty.
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), SHUT, 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, SHUT) + 1, F.lit(2**31 - 1))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: the turns from the longest, the trainable texts
    from the span of each."""
    loss = unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))
    one = examples.select(
        "conv_id",
        F.struct("example", F.coalesce(loss, F.lit("")).alias("loss")).alias("part"),
        F.struct("n_turns", "formatted").alias("longest"),
        F.length("formatted").cast("long").alias("chars"),
    )
    out = one.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["loss"]), "").alias("loss"),
        F.max("longest").alias("longest"),
        F.sum("chars").alias("example_chars"),
    )
    turns = read_turns(F.col("longest.formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("longest.formatted").cast("long").alias("formatted_chars"),
        "example_chars",
    )


def with_trick(conversations: DataFrame) -> DataFrame:
    """The table's four columns and conversation -1, whose texts look like control strings."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").cast("long").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICK).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(format_examples(with_trick(read_table(spark, sf_dir, "conversations"))))


_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')"
OP3_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICK}' UNION ALL SELECT -1, 1, 'assistant', '{TRICK}'
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS total,
    length('{OPEN}' || {_ESC.format('role')} || '{SHUT}' || {_ESC.format('text')} || '{CLOSE}{END}') AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), r AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM n
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(chars) + {len(BEGIN)} AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN role = 'assistant' OR k = total THEN upto + {len(BEGIN)} ELSE 0 END) AS BIGINT) AS example_chars
FROM r GROUP BY conv_id
"""
