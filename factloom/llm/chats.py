"""Chat formatting from event logs.

A log has events (conv_id, seq, kind, message, role, payload):

* open: the message begins; its role is the event's;
* delta: the payload is appended to the message's text;
* edit: the payload replaces the text;
* regenerate: the text is dropped, and the deltas after build a new one.

Logs are partitioned by conversation and sorted by sequence. Of a message only
what comes from its last edit or regeneration on is folded, so a log is never
replayed event by event; one shuffle, by conversation, serves the whole plan. The
final messages, in the order of their first events, are rendered with role marks.

Defined results: events without conversation, sequence number or message are
ignored; of events with the same number in a conversation (as repeated delivery
gives) the smallest by kind, message, role and payload counts. A null payload is
empty, a null role is "unknown" (of several roles, the first event's that has
one), an unknown kind does nothing but open. Marks within texts and roles are
defused, and line ends within roles are blanks, so that neither can open a turn.
An empty log has no conversations. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a streamed delta, in logs made from whole messages.
DELTA = 64


def event_log(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log that yields (conv_id, turn, role, text) messages: streamed in deltas; every third user message first sent as a draft and then edited, every other assistant message regenerated after a draft.

    Rows without conv_id or turn are ignored; rows with the same ones are messages of their own, ordered by role and text.
    """
    rows = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    most = F.floor(F.length("text") / delta) + 4  # events of a message
    rows = rows.withColumn("first", F.coalesce(F.sum(most).over(before), F.lit(0)))

    def event(kind: str, payload: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))

    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), 0), lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("payload")))
    draft = event("delta", F.reverse(F.substring("text", 1, delta)))
    edited = (F.col("role") == "user") & (F.col("turn") % 3 == 0)
    again = (F.col("role") == "assistant") & (F.col("turn") % 2 == 1)
    body = F.when(edited, F.array(draft, event("edit", F.col("text")))).when(again, F.concat(F.array(draft, event("regenerate", F.lit(None))), deltas)).otherwise(deltas)
    events = rows.select("conv_id", "first", "role", F.posexplode(F.concat(F.array(event("open", F.lit(None))), body)).alias("i", "e"))
    return events.select("conv_id", (F.col("first") + F.col("i")).alias("seq"), "e.kind", F.col("first").alias("message"), F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.payload")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, place, role, content): the final messages, place being the sequence number of the first event."""
    log = events.where("conv_id is not null and seq is not null and message is not null").select("conv_id", "seq", "kind", "message", "role", "payload")
    # everything after asks for rows partitioned by conversation at most, so nothing is shuffled again
    again = F.lag("seq").over(Window.partitionBy("conv_id").orderBy("seq", "kind", "message", "role", "payload")) == F.col("seq")
    log = log.withColumn("again", F.coalesce(again, F.lit(False))).where("not again").drop("again")
    own = Window.partitionBy("conv_id", "message")
    log = log.withColumn("from", F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(own))
    said = F.when((F.col("from").isNull() | (F.col("seq") >= F.col("from"))) & F.col("kind").isin("delta", "edit"), F.struct("seq", F.coalesce("payload", F.lit("")).alias("text")))
    return log.groupBy("conv_id", "message").agg(
        F.min("seq").alias("place"),
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("unknown")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["text"]), "").alias("content"),
    )


def render(events: DataFrame) -> DataFrame:
    """(conv_id, n_messages, rendered) of every conversation."""
    def safe(c: str) -> F.Column:
        return F.replace(c, F.lit("<|im_"), F.lit("<| im_"))

    role = F.regexp_replace(safe("role"), r"[\r\n]", " ")
    text = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe("content"), F.lit("<|im_end|>\n"))
    lines = messages(events).select("conv_id", F.struct("place", "message", text.alias("text")).alias("m"))
    folded = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("all"))
    return folded.select("conv_id", F.size("all").alias("n_messages"), F.array_join(F.transform("all", lambda x: x["text"]), "").alias("rendered"))


RENDER_SQL = r"""
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages,
  string_agg('<|im_start|>' || regexp_replace(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), '[\r\n]', ' ', 'g') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY turn, role NULLS FIRST, coalesce(text, '')) AS rendered
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id
"""
