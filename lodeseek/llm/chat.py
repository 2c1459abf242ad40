"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one row per event of a message: ``conv_id, message, role, seq, kind,
text``. Kinds: ``delta`` appends its text, ``edit`` sets the whole text anew,
``regenerate`` empties it for the deltas that follow, ``retract`` removes the
message unless something follows. Messages are folded first, each from its last
reset on; then each conversation's messages, in order, are rendered.

The template is ``<|turn|>ROLE<|text|>TEXT<|end|>``. Inside roles and texts a
backslash is doubled, and one is put after the first character of each control
string (this template's and the common ones below), so a marker never occurs
inside a text and read-back is exact.

Nulls and ties: a null text or role counts as empty, and events with a null kind
as deltas; null conversations form one of their own. Rows of equal position are
ordered by sequence, role and text, so repeated rows are repeated turns. An
unbounded number of rows of one conversation meets only as the final string that
the contract asks for; offsets come from a window that can spill. A conversation is as
long as Spark's strings allow. Further columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BACKSLASH = "\\"
DELTA_CHARS = 400


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit(BACKSLASH), F.lit(BACKSLASH * 2))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + BACKSLASH + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def log_of(rows: DataFrame) -> DataFrame:
    """An event log whose fold is the given turns, with events of every kind.

    By a hash of its place, a turn is streamed as deltas of DELTA_CHARS characters alone; or after a
    start that a regeneration throws away; or after one that an edit replaces by the first
    stretch of the text; or is followed by a message that is retracted.
    """
    parts = F.expr(f"sequence(0, greatest(length(coalesce(text, '')) - 1, 0) div {DELTA_CHARS})")
    twins = W.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("twin", F.row_number().over(twins))
    t = numbered.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_how", F.pmod(F.xxhash64("conv_id", "turn", "twin"), F.lit(4)))
    event = lambda ghost, seq, kind, text: F.struct(F.lit(ghost).alias("ghost"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    stretch = lambda i: F.col("_t").substr(i * DELTA_CHARS + 1, F.lit(DELTA_CHARS))
    at = lambda n: F.lit(n)
    deltas = F.transform(parts, lambda i: event(0, i + 2, "delta", stretch(i)))
    start = F.array(event(0, at(0), "delta", F.lit("a false start")))
    events = (
        F.when(F.col("_how") == 1, F.concat(start, F.array(event(0, at(1), "regenerate", F.lit(None).cast("string"))), deltas))
        .when(F.col("_how") == 2, F.concat(start, F.array(event(0, at(2), "edit", stretch(F.lit(0)))), F.slice(deltas, 2, 1_000_000_000)))
        .when(F.col("_how") == 3, F.concat(deltas, F.array(event(1, at(0), "delta", F.lit("never said")), event(1, at(1), "retract", F.lit(None).cast("string")))))
        .otherwise(deltas)
    )
    e = t.select("conv_id", "turn", "twin", "role", F.explode(events).alias("e"))
    return e.select("conv_id", F.struct("turn", "twin", F.col("e.ghost").alias("ghost")).alias("message"), "role", "e.seq", "e.kind", "e.text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text of the messages that are left; a message's role is its first event's."""
    resets = F.col("kind").isin("edit", "regenerate", "retract")
    last = F.max(F.when(resets, F.struct("seq", "kind", "text"))).alias("_reset")
    tail = F.collect_list(F.when(~F.coalesce(resets, F.lit(False)), F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("_deltas")
    m = log.groupBy("conv_id", "message").agg(F.min(F.struct("seq", "role"))["role"].alias("role"), last, tail)
    after = F.filter(F.array_sort("_deltas"), lambda d: F.col("_reset").isNull() | (d["seq"] > F.col("_reset.seq")))
    start = F.when(F.col("_reset.kind") == "edit", F.coalesce("_reset.text", F.lit(""))).otherwise("")
    gone = F.coalesce(F.col("_reset.kind") == "retract", F.lit(False)) & (F.size(after) == 0)
    return m.where(~gone).select("conv_id", "message", "role", F.concat(start, F.array_join(F.transform(after, lambda d: d["text"]), "")).alias("text"))


def render(messages: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, and loss_mask: start and length, in code points of formatted, of each text to be learnt."""
    m = messages.withColumn("_head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))).withColumn("_body", escape(F.col("text")))
    m = m.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("_at", F.coalesce(F.sum(F.length("_piece").cast("long")).over(order), F.lit(0)))
    span = F.when(F.col("role").isin(*learn_roles), F.struct((F.col("_at") + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length")))
    c = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"), F.array_sort(F.collect_list(span)).alias("loss_mask"))
    return c.select("conv_id", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("formatted"), "loss_mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt text, taken from nothing but the formatted strings and their masks."""
    turns = F.transform(
        F.filter(F.split("formatted", r"<\|end\|>", -1), lambda t: t != ""),
        lambda t: F.split(F.substring(t, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", -1),
    )
    told = F.array_join(F.transform("_turns", lambda t: F.concat(unescape(t[0]), F.lit("\n"), unescape(t[1]), F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_mask", lambda s: F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int"))), "")
    return formatted.withColumn("_turns", turns).select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), told.alias("turns"), unescape(learnt).alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    got = read_back(render(fold(log_of(rows.unionByName(added)))))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return got.select("conv_id", "n_turns", sha("turns").alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), sha("learnt").alias("loss_sha256"), "formatted_chars")


def _oracle() -> str:
    escaped = lambda c: escape_sql(f"coalesce({c}, '')")

    def escape_sql(c: str) -> str:
        c = f"replace({c}, '{BACKSLASH}', '{BACKSLASH * 2}')"
        for s in CONTROL:
            c = f"replace({c}, '{s}', '{s[0] + BACKSLASH + s[1:]}')"
        return c

    fixed = len(TURN) + len(TEXT) + len(END)
    return f"""
    WITH r AS (
      SELECT conv_id, turn, role, text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), g AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS turns,
        coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS learnt,
        CAST(sum({fixed} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
      FROM r GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g
    """


ORACLE = _oracle()
