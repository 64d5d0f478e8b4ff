"""Conversations formatted for training: event logs folded into final messages, rendered by a reversible template.

DataFrame functions only. A turn is ``<turn ROLE>TEXT</turn>`` and a line end. Inside texts and roles a backslash is written
``\\s`` and ``<`` ``\\l``, in roles also ``>`` ``\\g`` and a line end ``\\n``, so a text can hold anything, also the marks
themselves, and every formatted conversation reads back to its messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: kinds of events
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
#: the role whose texts are learned
LEARNED = "assistant"
_OPEN, _CLOSE = "<turn ", "</turn>\n"
_TEXT = (("\\", "\\s"), ("<", "\\l"))
_ROLE = (*_TEXT, (">", "\\g"), ("\n", "\\n"))


def escape(value: Column, pairs: tuple = _TEXT) -> Column:
    for plain, safe in pairs:
        value = F.replace(value, F.lit(plain), F.lit(safe))
    return value


def unescape(value: Column, pairs: tuple = _TEXT) -> Column:
    for plain, safe in reversed(pairs):
        value = F.replace(value, F.lit(safe), F.lit(plain))
    return value


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): what the event log ``events`` (conv_id, seq, kind, turn, role, text) comes to.

    Events are taken by conversation in the order of ``seq``, those of one ``seq`` by kind, turn, role and text:

    * ``message`` begins turn ``turn`` with a role and a text, in place of what it held;
    * ``delta`` appends to the turn's text, also where no message began it;
    * ``edit`` puts a text in place of the turn's text, ``regenerate`` empties it for the deltas that follow; both take back
      all later turns as they stand, as these answered what is gone.

    A turn's role is the last one that its events name since it was last taken back. Null texts count as empty, null roles
    as not named; other kinds are refused. A turn of which nothing is left has no row. Null conv_ids are one conversation.

    The log is dealt by conversation and sorted; a turn's pieces meet where they lie, so there is one shuffle.
    """
    known = F.col("kind").isin(MESSAGE, DELTA, EDIT, REGENERATE)
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("not a kind of event: "), F.coalesce("kind", F.lit("null")))))
    place = F.struct("seq", "kind", "turn", "role", "text")
    text = F.when(F.col("kind") == REGENERATE, "").otherwise(F.coalesce("text", F.lit("")))
    log = events.select("conv_id", "turn", "role", text.alias("text"), kind.alias("kind"), place.alias("place"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    taken_back = F.coalesce(F.min(F.when(F.col("kind").isin(EDIT, REGENERATE), F.col("turn"))).over(later) < F.col("turn"), F.lit(False))
    alive = log.withColumn("gone", taken_back).where("NOT gone")
    in_turn = Window.partitionBy("conv_id", "turn").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    replaced = F.coalesce(F.max(F.col("kind") != DELTA).over(in_turn), F.lit(False))
    pieces = F.collect_list(F.when(~F.col("replaced"), F.struct("place", "text")))
    text = F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), "")
    role = F.max(F.when(F.col("role").isNotNull(), F.struct("place", "role")))["role"]
    return alive.withColumn("replaced", replaced).groupBy("conv_id", "turn").agg(role.alias("role"), text.alias("text"))


def format_messages(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation of ``messages`` (conv_id, turn, role, text), by turn.

    ``loss`` is the mask of what is learned: per text of the ``learned`` role (turn, start, length), the turn's number from 0 and code
    points from the beginning of its ``<turn``. Empty texts have a span of length 0; null roles and texts count as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(_OPEN), escape(role, _ROLE), F.lit(">")), escape(text)
    rendered = messages.select("conv_id", "turn", head.alias("head"), body.alias("body"), (role == learned).alias("learn"), role.alias("role"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head", "learn")))
    spans = F.transform(
        F.col("turns"),
        lambda t, i: F.when(t["learn"], F.struct(i.alias("turn"), F.char_length(t["head"]).alias("start"), F.char_length(t["body"]).alias("length"))),
    )
    return (
        rendered.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(_CLOSE))), "").alias("formatted"),
            F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
        )
    )


def read_formatted(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``messages``, an array of (role, text), and ``learned``, the texts under the loss mask, in order."""
    parts = F.split("formatted", _CLOSE, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    head = lambda p: F.substring_index(p, ">", 1)
    message = lambda p: F.struct(
        unescape(F.substr(head(p), F.lit(len(_OPEN) + 1)), _ROLE).alias("role"),
        unescape(F.substr(p, F.char_length(head(p)) + 2)).alias("text"),
    )
    learned = F.transform("loss", lambda s: unescape(F.substr(F.element_at(F.col("parts"), s["turn"] + 1), s["start"] + 1, s["length"])))
    return formatted.withColumn("parts", parts).withColumn("messages", F.transform("parts", message)).withColumn("learned", learned).drop("parts")


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished messages (conv_id, turn, role, text): each is begun, then its text streamed to it.

    Rows are numbered by turn, role and text, so rows of one turn, and repeated rows, are messages of their own.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", "role", "text", number.alias("number"))
    nothing = F.lit(None).cast("string")
    begun = F.struct((2 * F.col("number")).alias("seq"), F.lit(MESSAGE).alias("kind"), "role", nothing.alias("text"))
    streamed = F.struct((2 * F.col("number") + 1).alias("seq"), F.lit(DELTA).alias("kind"), nothing.alias("role"), "text")
    events = rows.select("conv_id", F.col("number").alias("turn"), F.explode(F.array(begun, streamed)).alias("event"))
    return events.select("conv_id", "turn", "event.*")


def marked_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like marks."""
    number = F.col("id")
    text = F.lit("\\### Assistant: </turn> ok")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), number.alias("turn"), F.when(number == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Format every conversation, and one that looks like marks, read the output back, and digest it, a row per conversation.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Further columns are ignored; a null turn comes
    first, null roles and texts are empty. An empty table gives conversation -7 alone. The digest of a conversation needs all of
    its text in one value, so a conversation is one row of one task, however long.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(marked_conversation(conversations.sparkSession))
    back = read_formatted(format_messages(final_messages(as_events(rows))))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        digest(said).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        digest(learned).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def duckdb_sql() -> str:
    """The same digests from the rows themselves."""

    def size(value: str, marks: str) -> str:
        return f"length({value}) + " + " + ".join(f"(length({value}) - length(replace({value}, {m}, '')))" for m in marks.split("|"))

    return rf"""WITH given AS (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
        said AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM given),
        whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
            coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
            sum({size("role", "chr(92)|'<'|'>'|chr(10)")} + {size("text", "chr(92)|'<'")} + {len(_OPEN) + 1 + len(_CLOSE)})::BIGINT AS formatted_chars FROM said GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole"""
