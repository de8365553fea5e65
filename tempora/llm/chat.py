r"""Chat formatting by event-sourced reconstruction.

Logs hold events of conversations: whole messages, streamed deltas, edits and regenerations. Events are dealt by
conversation and message, sorted by sequence number, and folded into final messages; messages are dealt by conversation,
sorted by their first sequence number, and rendered. Both passes stream over sorted partitions: a task holds one message
at a time, so a conversation with a third of all rows needs time in one task but no memory.

The template: `### role: text</turn>` and a line feed per turn. In roles and texts a backslash goes before every
backslash, `###` and `</turn>` (in roles also before every colon), which is undone by taking the first of each
backslash's two characters away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import shuffle_partitions
from tempora.shipping import shipped

#: The template's marks and the role whose text is trained on.
OPEN, CLOSE, LEARNED_ROLE = "### ", "</turn>", "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)

EVENT_KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as formatted, and where its text begins and ends there."""
    head = OPEN + _ROLE_CONTROL.sub(r"\\\g<0>", role) + ": "
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted conversation, or of any run of whole turns."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


def fold(events: Iterator[tuple[str, str | None, str | None]]) -> tuple[str, str]:
    """Role and text of one message from its events (kind, role, text) in order.

    `message` and `edit` set the text, `delta` appends to it, `regenerate` empties it; the first role given counts.
    """
    role, parts = None, []
    for kind, said_role, text in events:
        role = said_role if role is None else role
        if kind == "delta":
            parts.append(text or "")
        elif kind == "regenerate":
            parts = [text] if text else []
        else:
            parts = [text or ""]
    return role or "", "".join(parts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


_MESSAGE = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def reconstruct(logs: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the final messages of `logs` (conv_id, seq, kind, message_id, role, text).

    An event without message_id is a message of its own. Kinds that aren't known count as `message`. Null texts are
    empty, a null conv_id is a conversation of its own, null sequence numbers come first; events of one sequence number
    are taken in order of kind, role and text. Rows that repeat are separate events. Other columns are ignored.
    """
    events = logs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("message_id").cast("string").alias("message_id"), F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    single = events.where("message_id IS NULL").select("conv_id", F.col("seq").alias("position"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages():
            rows = _rows(batches)
            row = next(rows, None)
            while row is not None:
                key, first = row[:2], row[2]

                def of_message():
                    nonlocal row
                    while row is not None and row[:2] == key:
                        yield row[3:]
                        row = next(rows, None)

                role, text = fold(of_message())
                yield key[0], first, role, text

        yield from _batches(messages(), _MESSAGE)

    parts = events.where("message_id IS NOT NULL").repartition(shuffle_partitions(logs.sparkSession), "conv_id", "message_id")
    ordered = parts.sortWithinPartitions("conv_id", "message_id", "seq", "kind", "role", "text")
    return single.unionByName(ordered.mapInArrow(run, "conv_id long, position long, role string, text string"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, position, formatted, loss_start, loss_end: each message (conv_id, position, role, text) as formatted, in partitions that hold whole conversations in order.

    The formatted conversation is its rows' `formatted` in order. The loss mask is the assistants' texts; other turns
    have an empty mask (null bounds). Messages of one position are taken in order of role and text.
    """
    ordered = messages.repartition(shuffle_partitions(messages.sparkSession), "conv_id").sortWithinPartitions("conv_id", "position", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns():
            for conv_id, position, role, text in _rows(batches):
                formatted, start, end = render_turn(role or "", text or "")
                learned = role == LEARNED_ROLE
                yield conv_id, position, formatted, start if learned else None, end if learned else None

        yield from _batches(turns(), schema)

    return ordered.mapInArrow(run, "conv_id long, position long, formatted string, loss_start long, loss_end long")


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and loss mask of `rendered` (straight from `render`): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            key = state = None
            for conv_id, _, formatted, start, end in _rows(batches):
                if state is None or conv_id != key:
                    if state is not None:
                        yield (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
                    key, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(formatted[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            if state is not None:
                yield (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        yield from _batches(conversations(), schema)

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@shipped
def op5_event_sourced(spark, sf_dir: str) -> DataFrame:
    """All conversations and one more whose texts hold the template's marks, each turn as the log of events that leads to it.

    A log has a draft, then for assistants a regeneration streamed in two deltas, for others an edit.
    """
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    said = turns.select("conv_id", F.monotonically_increasing_id().alias("message_id"), F.coalesce(F.col("turn").cast("long") * 4, F.lit(-(1 << 62))).alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"))
    middle = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), middle), F.substring("text", middle + 1, F.length("text"))

    def event(k: int, kind: str, text) -> Column:
        return F.struct((F.col("seq") + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    draft, none = F.reverse(first), F.lit(None).cast("string")
    streamed = F.array(event(0, "message", draft), event(1, "regenerate", none), event(2, "delta", first), event(3, "delta", second))
    edited = F.array(event(0, "message", draft), event(1, "edit", F.col("text")))
    logs = said.select("conv_id", "message_id", "role", F.explode(F.when(F.col("role") == LEARNED_ROLE, streamed).otherwise(edited)).alias("x")).select("conv_id", "message_id", "role", "x.*")
    return read_back(render(reconstruct(logs)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS body,
         length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + head + 2 + body + 7 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
