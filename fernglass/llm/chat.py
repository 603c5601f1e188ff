"""Chat formatting from event logs: fold events into final messages, render them with a loss mask, and read that back.

Only DataFrame functions. Events (conversation, seq, event, turn, role, text) of kinds
- message: the turn has this role and text,
- delta: the text is appended,
- edit: the text is replaced,
- regenerate: the turn starts anew with this text, and what later turns held before is gone,
are dealt by conversation once and folded by turn there; rendering, reading back and digests keep that dealing, so that texts are shuffled
once. A conversation's final messages meet in one row, which is what formatting asks for: a rendering must fit into a row (2 GB).

The rendering is `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts `<`, any backslashes and `|`
in a row get one more backslash, so that no control string is left, and line ends and backslashes in roles are escaped; both are
undone on reading. The loss mask is a sorted list of [start, end) code-point ranges of the rendering, one for each assistant text.

Null roles and texts count as empty; a null conversation or turn is a key of its own and sorts first; events of one turn with the
same seq are taken by kind, then text; an empty log gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
PROBE = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv, turn, role, text of the final messages of events (conv, seq, event, turn, role, text)."""
    kind = F.coalesce(F.col("event"), F.lit("message"))
    rows = events.select("conv", "seq", kind.alias("event"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The last regeneration of an earlier turn.
    again = F.when((F.col("event") == "regenerate") & F.col("turn").isNotNull(), F.col("seq"))
    rows = rows.withColumn("gone", F.max(again).over(Window.partitionBy("conv").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))).where("gone is null or seq > gone")
    whole = F.col("event") != "delta"
    start = F.max(F.when(whole, F.col("seq"))).over(Window.partitionBy("conv", "turn"))
    parts = rows.withColumn("start", start)
    last_part = F.col("start").isNull() | (F.col("seq") >= F.col("start"))
    ordered = F.array_sort(F.collect_list(F.when(last_part, F.struct("seq", F.when(whole, 0).otherwise(1).alias("k"), "text"))))
    named = F.max_by(F.col("role"), F.when(F.col("role") != "", F.col("seq")))
    return parts.groupBy("conv", "turn").agg(F.coalesce(named, F.lit("")).alias("role"), F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv, formatted and mask (sorted ranges) of final messages (conv, turn, role, text)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("part", F.concat("head", "body", F.lit(STOP + "\n")))
    before = F.coalesce(F.sum(F.char_length("part")).over(Window.partitionBy("conv").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.char_length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.char_length("body")).alias("end")))
    parts = parts.select("conv", "turn", "part", span.alias("span"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda p: p["part"]), "")
    return parts.groupBy("conv").agg(text.alias("formatted"), F.array_sort(F.collect_list("span")).alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv, turn (from 0), role, text, loss (the text under the mask, unescaped; null where there is none) and size (characters) from the rendering alone."""
    # Pieces and mask ranges become rows together: a range meets the piece whose body starts where it does.
    rows = F.concat(
        F.transform(F.slice("pieces", F.lit(2), F.size("pieces")), lambda p, i: F.struct(i.cast("long").alias("turn"), p.alias("piece"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"))),
        F.transform("mask", lambda m: F.struct(F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("piece"), m["start"].cast("int").alias("s"), m["end"].cast("int").alias("e"))),
    )
    row = rendered.select("conv", "mask", F.split(F.col("formatted"), r"<\|im_start\|>").alias("pieces")).select("conv", F.explode(rows).alias("r")).select("conv", "r.*")
    size = F.when(F.col("piece").isNotNull(), F.char_length("piece") + len(START))
    at = F.coalesce(F.sum(size).over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    role = F.substring_index("piece", "\n", 1)
    body = F.expr(f"substring(piece, char_length(substring_index(piece, '\\n', 1)) + 2, char_length(piece) - char_length(substring_index(piece, '\\n', 1)) - {len(STOP) + 2})")
    row = row.select("conv", "turn", role.alias("raw"), body.alias("body"), size.alias("size"), F.coalesce("s", at + len(START) + F.char_length(role) + 1).alias("start"), "e")
    both = row.withColumn("end", F.max("e").over(Window.partitionBy("conv", "start"))).where("turn is not null")
    loss = F.when(F.col("end").isNotNull(), unescape(F.expr("substring(body, 1, cast(end - start as int))")))
    return both.select("conv", "turn", unescape_role(F.col("raw")).alias("role"), unescape(F.col("body")).alias("text"), loss.alias("loss"), "size")


def digest(rendered: DataFrame) -> DataFrame:
    """What `op7_chat` returns, read back from the rendering."""
    turn = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    sorted_ = lambda column: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", column.alias("x")))), lambda p: p["x"]), "")
    return read_back(rendered).groupBy(F.col("conv").alias("conv_id")).agg(
        F.count("*").alias("n_turns"), F.sha2(sorted_(turn), 256).alias("turns_sha256"), F.coalesce(F.sum(F.char_length("loss")), F.lit(0)).cast("long").alias("loss_chars"),
        F.sha2(sorted_(F.coalesce("loss", F.lit(""))), 256).alias("loss_sha256"), F.sum("size").cast("long").alias("formatted_chars"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """A log of the rows, turns numbered by turn, then role and text: each begins with a draft of up to 16 characters, then an edit (of an
    assistant: a regeneration) brings half of the text, and a delta the rest."""
    number = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), number.alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = (F.char_length("text") / 2).cast("int")
    event = lambda k, kind, role, text: F.struct((3 * F.col("turn") + k).alias("seq"), kind.alias("event"), role.alias("role"), text.alias("text"))
    events = F.array(
        event(2, F.lit("delta"), F.lit(None).cast("string"), F.substring("text", half + 1, F.char_length("text"))),
        event(0, F.lit("message"), F.col("role"), F.concat(F.lit("draft "), F.substring("text", 1, 10))),
        event(1, F.when(F.col("role") == "assistant", "regenerate").otherwise("edit"), F.col("role"), F.substring("text", F.lit(1), half)),
    )
    return rows.select("conv", "turn", F.explode(events).alias("e")).select("conv", "e.seq", "e.event", "turn", "e.role", "e.text")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest(render(fold(events_of(rows.unionByName(probe)))))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS esc,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS erole FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(erole) + 1 + length(esc) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
