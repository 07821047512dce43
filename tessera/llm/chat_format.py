"""Chat formatting: final messages rebuilt from an event log, then rendered with turn markers.

An event is (conv_id, seq, kind, message_id, role, text). Logs are partitioned by conversation, each message's events
are folded in the order of seq, and the conversation's messages rendered in the order of their first event:

- message, edit: the message's text is now this text;
- regenerate: the message's text is now empty, to be filled by the deltas that follow;
- delta: the text is added to the message's;
- delete: the message is gone, until a message, edit or regenerate event brings it back.

A fold needs the last event that isn't a delta and the deltas after it, so it is linear in the events, and a run of
events folds into one of the same kind. That is done first for each stretch of ``STRETCH`` numbers of a message's seq,
by a shuffle that spreads even a conversation, or message, that holds a third of all events; what a stretch leaves, no
superseded text among it, then meets by conversation. No task gathers more of one than its final texts and stretches.

Defined results: an event that is repeated in all its columns counts once, as logs may deliver twice. Events of equal
seq go in the order of kind, then text, then role. Events with a null conv_id, seq or kind, or an unknown kind, are left
out. A null text is empty; each event with a null message_id is a message of its own; a message's role is the first
that is not null, else "unknown". Deltas after a deletion are lost. Messages whose final text is empty are left out, and
so are conversations without messages. Messages that begin at the same seq go in the order of message_id, null first,
then of what is rendered. "<|" in a text or role gets a zero-width space in between, so that no text can forge a
marker. Other columns don't matter; an empty log has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import TMP, table

KINDS = ("message", "edit", "regenerate", "delta", "delete")
#: Numbers of seq that are folded at once; a power of two.
STRETCH = 4096
OWN, AT = TMP + "own", TMP + "at"


def from_turns(conversations: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as a log: each row is a message event."""
    turn = F.col("turn").cast("long")
    return conversations.select("conv_id", turn.alias("seq"), F.lit("message").alias("kind"), turn.alias("message_id"), "role", "text")


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as the log of a chat service: how a turn came about goes by the
    remainder of conv_id + turn by seven.

    0: a message. 1: deltas of 24 characters. 2: a draft, then an edit. 3: deltas of a first answer, a regeneration,
    deltas. 4: a message delivered twice. 5: a message, deleted. 6: deltas, a deletion, a late delta, an edit that
    brings it back, a delta.
    """
    text, turn, way = F.coalesce("text", F.lit("")), F.col("turn").cast("long"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    size = F.length(text)

    def event(kind: str, said: Column | str | None = None) -> Column:
        said = F.lit(said) if said is None or isinstance(said, str) else said
        return F.struct(F.lit(kind).alias("kind"), said.cast("string").alias("text"))

    def stream(said: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(said), F.lit(1)), F.lit(24))
        return F.transform(starts, lambda k: F.struct(F.lit("delta").alias("kind"), F.substring(said, k, F.lit(24)).alias("text")))

    ways = [
        F.array(event("message", text)),
        stream(text),
        F.array(event("message", F.concat(F.lit("draft: "), text)), event("edit", text)),
        F.concat(stream(F.reverse(text)), F.array(event("regenerate")), stream(text)),
        F.array(event("message", text), event("message", text)),
        F.array(event("message", text), event("delete")),
        F.concat(stream(text), F.array(event("delete"), event("delta", " lost"), event("edit", F.substring(text, F.lit(1), size - 1)), event("delta", F.substring(text, size, F.lit(1))))),
    ]
    events = ways[0]
    for k, these in enumerate(ways[1:], 1):
        events = F.when(way == k, these).otherwise(events)
    rows = conversations.select("conv_id", turn.alias("message_id"), "role", way.alias("way"), F.posexplode(events).alias("pos", "e"))
    # the second delivery has the number of the first
    seq = F.col("message_id") * 1_000_000 + F.when(F.col("way") == 4, F.lit(0)).otherwise(F.col("pos"))
    return rows.select("conv_id", seq.alias("seq"), "e.kind", "message_id", F.when((F.col("pos") == 0) | (F.col("way") == 4), F.col("role")).alias("role"), "e.text")


def _last(parts: Column) -> Column:
    """Place of the last part that begins anew, null if there is none."""
    return F.array_max(F.transform(parts, lambda p, i: F.when(p.anew.isNotNull(), i)))


def _joined(parts: Column, last: Column) -> Column:
    """The texts of the parts from the last on that begins anew; none if that is a deletion."""
    rest = F.when(last.isNull(), parts).otherwise(F.slice(parts, last + 1, F.size(parts)))
    return F.when(F.get(parts, last).anew.eqNullSafe(F.lit("delete")), F.lit("")).otherwise(F.array_join(F.transform(rest, lambda p: p.text), ""))


def _role(parts: Column) -> Column:
    return F.get(F.filter(parts, lambda p: p.role.isNotNull()), F.lit(0)).role


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, first_seq, role, text) of the messages that remain, partitioned by conversation."""
    known = events.where(F.col("conv_id").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isin(*KINDS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.when(F.col("message_id").isNull(), F.sha2(F.to_json(F.struct("seq", "kind", "role", text.alias("text"))), 256))
    known = known.select("conv_id", "message_id", own.alias(OWN), F.floor(F.col("seq") / STRETCH).alias(AT), F.struct("seq", "kind", text.alias("text"), "role").alias("e"))
    sorted_ = known.groupBy("conv_id", "message_id", OWN, AT).agg(F.array_sort(F.collect_set("e")).alias("e"))
    anew = lambda e: F.when(e.kind != "delta", e.kind)
    said = lambda e: F.when(e.kind.isin("message", "edit", "delta"), e.text).otherwise("")
    parts = sorted_.select("conv_id", "message_id", OWN, AT, F.col("e")[0].seq.alias("first_seq"), F.transform("e", lambda e: F.struct(anew(e).alias("anew"), said(e).alias("text"), e.role.alias("role"))).alias("p"))
    parts = parts.withColumn("last", _last(F.col("p")))
    folded = F.struct(AT, "first_seq", F.get("p", F.col("last")).anew.alias("anew"), _joined(F.col("p"), F.col("last")).alias("text"), _role(F.col("p")).alias("role"))
    stretches = parts.select("conv_id", "message_id", OWN, folded.alias("p")).repartition("conv_id")
    rows = stretches.groupBy("conv_id", "message_id", OWN).agg(F.array_sort(F.collect_list("p")).alias("p")).withColumn("last", _last(F.col("p")))
    rows = rows.select("conv_id", "message_id", F.col("p")[0].first_seq.alias("first_seq"), F.coalesce(_role(F.col("p")), F.lit("unknown")).alias("role"), _joined(F.col("p"), F.col("last")).alias("text"))
    return rows.where(F.length("text") > 0)


def _plain(c: str) -> Column:
    return F.replace(F.col(c), F.lit("<|"), F.lit("<​|"))


def chat_format(events: DataFrame) -> DataFrame:
    """(conv_id, n_messages, rendered) of each conversation."""
    turn = F.concat(F.lit("<|im_start|>"), _plain("role"), F.lit("\n"), _plain("text"), F.lit("<|im_end|>\n"))
    each = messages(events).select("conv_id", F.struct("first_seq", "message_id", turn.alias("turn")).alias("m"))
    grouped = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return grouped.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x.turn), "").alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(log_of(table(spark, sf_dir, "conversations")))


#: The same log, and the final messages by windows over it.
SQL = """
WITH turns AS (
  SELECT conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text, ((conv_id + turn) % 7 + 7) % 7 AS way
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
pieces AS (
  SELECT conv_id, turn, role, way, text, unnest(range(0, greatest((length(text) + 23) // 24, 1))) AS k FROM turns WHERE way IN (1, 3, 6)),
log AS (
  SELECT conv_id, turn, 0 AS pos, 'message' AS kind, role, CASE way WHEN 2 THEN 'draft: ' || text ELSE text END AS text FROM turns WHERE way IN (0, 2, 4, 5)
  UNION ALL SELECT conv_id, turn, 0, 'message', role, text FROM turns WHERE way = 4
  UNION ALL SELECT conv_id, turn, 1, 'edit', NULL, text FROM turns WHERE way = 2
  UNION ALL SELECT conv_id, turn, 1, 'delete', NULL, NULL FROM turns WHERE way = 5
  UNION ALL SELECT conv_id, turn, k, 'delta', CASE k WHEN 0 THEN role END, substr(CASE way WHEN 3 THEN reverse(text) ELSE text END, k * 24 + 1, 24) FROM pieces
  UNION ALL SELECT conv_id, turn, greatest((length(text) + 23) // 24, 1) + 1 + k, 'delta', NULL, substr(text, k * 24 + 1, 24) FROM pieces WHERE way = 3
  UNION ALL SELECT conv_id, turn, greatest((length(text) + 23) // 24, 1) + e.k, e.kind, NULL, CASE e.k WHEN 1 THEN ' lost' WHEN 2 THEN left(text, length(text) - 1) WHEN 3 THEN right(text, 1) END
    FROM turns, (VALUES (0, 'delete'), (1, 'delta'), (2, 'edit'), (3, 'delta')) e(k, kind) WHERE way = 6
  UNION ALL SELECT conv_id, turn, greatest((length(text) + 23) // 24, 1), 'regenerate', NULL, NULL FROM turns WHERE way = 3),
once AS (SELECT DISTINCT * FROM log),
placed AS (
  SELECT *, max(CASE WHEN kind <> 'delta' THEN pos END) OVER m AS last, min(pos) OVER m AS first_pos FROM once WINDOW m AS (PARTITION BY conv_id, turn)),
final AS (
  SELECT conv_id, turn, string_agg(CASE WHEN kind IN ('message', 'edit', 'delta') THEN text ELSE '' END, '' ORDER BY pos) FILTER (WHERE last IS NULL OR pos >= last) AS text,
    first(role ORDER BY pos) FILTER (WHERE role IS NOT NULL) AS role, bool_or(kind = 'delete' AND pos = last) AS gone
  FROM placed GROUP BY conv_id, turn)
SELECT conv_id, count(*) AS n_messages,
  string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '<' || chr(8203) || '|') || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM final WHERE NOT gone AND text <> '' GROUP BY conv_id
"""
