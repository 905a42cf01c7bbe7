"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. Logs are partitioned by conversation, sorted by sequence and folded into the final
messages: `start` opens a message, `delta` appends to it, `edit` replaces its text, `regenerate` empties it for the
deltas that follow. The fold streams over sorted rows, so a task holds one conversation at a time. Then the messages are
rendered: each turn is marked, control strings inside texts are escaped, and the spans of assistant texts are noted as
the loss mask. `read_back` undoes the rendering.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm.common import table, whole

# The template's marks, and the control strings of templates in wide use, which texts must not hold bare.
TURN, DONE = "<|turn|>", "<|done|>"
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Deltas of a logged text have at most so many characters.
DELTA = 512
EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"
FORMATTED = "conv_id long, formatted string, loss_mask array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """A backslash goes before each backslash and after the first character of each control string. No `\\n` arises."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    """Like escape(); line feeds, which end a turn's head, become `\\n`."""
    return escape(role).replace("\n", "\\n")


def as_events(conversations: DataFrame) -> DataFrame:
    """The log that streaming would have left: each row of (conv_id, turn, role, text) is a start and its deltas.

    Messages are numbered by turn, then role, then text, so rows that share a turn stay apart.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), whole("role").alias("role"), whole("text").alias("text"))
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    steps = rows.select("conv_id", "message", "role", F.posexplode(F.concat(F.array(F.lit("")), parts)).alias("part", "text"))
    return steps.select(
        "conv_id",
        F.shiftleft("message", 32).bitwiseOR(F.col("part").cast("long")).alias("seq"),
        F.when(F.col("part") == 0, "start").otherwise("delta").alias("kind"),
        "message", "role", "text",
    )


def fold(events: list[tuple]) -> list[tuple[str, str]]:
    """(role, text) of the final messages of one conversation. events: (kind, message, role, text) by sequence."""
    roles: dict[int, str] = {}
    texts: dict[int, list[str]] = {}
    for kind, message, role, text in events:
        if kind == "start" or message not in texts:
            roles[message], texts[message] = role, []
        if kind in ("edit", "regenerate"):
            texts[message] = []
        if kind != "regenerate" and text:
            texts[message].append(text)
    return [(roles[m], "".join(texts[m])) for m in texts]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted conversation and the spans of its escaped assistant texts."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, DONE, "\n"]
        at += len(head) + len(body) + len(DONE) + 1
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = [x.removeprefix(TURN).partition("\n") for x in formatted.split(DONE + "\n")[:-1]]
    return [(unescape(role), unescape(text)) for role, _, text in turns]


def format_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by conversation and sequence; a conversation may go on in the next batch."""
    conv, held, out = None, [], []

    def finish():
        if held:
            out.append((conv, *render(fold(held))))

    for batch in batches:
        ids = batch["conv_id"].astype("Int64").to_list()
        for c, *event in zip(ids, batch["kind"], batch["message"], batch["role"], batch["text"]):
            c = None if c is pd.NA else c
            if held and c != conv:
                finish()
                held = []
            conv = c
            held.append(event)
        if len(out) >= 1000:
            yield frame(out)
            out = []
    finish()
    if out:
        yield frame(out)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "formatted", "loss_mask"])
    return out.astype({"conv_id": "Int64"})


def chat_format(events: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask of every conversation in a log (conv_id, seq, kind, message, role, text).

    Null roles and texts count as empty. Events with equal seq are ordered by kind, message and text. A delta, edit or
    regeneration of a message never started starts it. All events of a null conv_id are one conversation. Other columns
    are ignored; an empty log gives no rows. A conversation is one value of the result, so it must fit in a task; any
    number of them, of any shares, are dealt by hash.
    """
    rows = events.select("conv_id", "seq", "kind", "message", whole("role").alias("role"), whole("text").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", F.col("kind").desc(), "message", "text")
    return dealt.mapInPandas(format_task, FORMATTED)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def digest_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, mask in zip(batch["formatted"], batch["loss_mask"]):
            turns = read_back(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
        out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out.insert(0, "conv_id", batch["conv_id"].astype("Int64").array)
        yield out


#: Conversation -1 of the contract.
FIXTURE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    fixture = spark.createDataFrame(FIXTURE, "conv_id long, turn long, role string, text string")
    return chat_format(as_events(rows.unionByName(fixture))).mapInPandas(digest_task, DIGESTS)


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'),
    '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS esc FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + length(esc) + 8 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
