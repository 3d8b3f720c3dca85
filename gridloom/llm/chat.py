"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, turn, seq, kind, role, text). Events are partitioned by conversation
and turn, sorted by sequence and folded into the turn's final message:

* ``start``  opens the message with a role (text: its beginning);
* ``delta``  appends streamed text;
* ``edit``   replaces the text so far;
* ``regenerate`` drops the text so far; deltas that follow build the new answer.

The messages are then partitioned by conversation, sorted by turn and rendered. A turn is rendered as
``<|role|>\\n`` + escaped text + ``<|end|>\\n``. Inside texts and roles ``<|``, and every ``\\``, are
escaped by a backslash in a way that reverses exactly, so no text can forge a mark. The loss mask
covers the escaped text of assistant turns.

Folding works on turns, so one hot conversation is spread; the last step reads a conversation's
turns in order as a stream and keeps running digests only, never the group. Null text and role are
empty. Turns that repeat a number are separate messages in the order of their first sequence number
and text. Conversations without rows do not appear.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LOG = "conv_id long, turn long, part long, seq long, kind string, role string, text string"
DELTA = 400  # characters of a streamed delta


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "\\<|").replace("|>", "\\|>")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j])
        out.append(text[j + 1 : j + 2])
        i = j + 2
    out.append(text[i:])
    return "".join(out)


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}"


def read_back(rendered: str) -> tuple[str, str, tuple[int, int]]:
    """(role, text, span of the escaped text) of a rendered turn."""
    at = len(OPEN)
    while not rendered.startswith(CLOSE, at):
        at += 2 if rendered[at] == "\\" else 1
    start, stop = at + len(CLOSE), len(rendered) - len(END)
    if rendered[:2] != OPEN or rendered[stop:] != END:
        raise ValueError("not a rendered turn")
    return unescape(rendered[len(OPEN) : at]), unescape(rendered[start:stop]), (start, stop)


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): the final message of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, text, rows = None, "", [], []
        for batch in batches:
            for *k, _, kind, r, t in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "part", "seq", "kind", "role", "text")), strict=True):
                if k != key:
                    if key is not None:
                        rows.append((*key, role, "".join(text)))
                    key, role, text = k, "", []
                if kind == "start":
                    role, text = r or "", [t or ""]
                elif kind == "delta":
                    text.append(t or "")
                elif kind == "edit":
                    text = [t or ""]
                elif kind == "regenerate":
                    text = []
                else:
                    raise ValueError(f"unknown kind of event: {kind}")
            if len(rows) >= 2000:
                yield _rows(rows)
                rows = []
        if key is not None:
            rows.append((*key, role, "".join(text)))
        if rows:
            yield _rows(rows)

    keys = ["conv_id", "turn", "part"]
    return events.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, "conv_id long, turn long, part long, role string, text string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "turn", "part", "role", "text"])


def format_turns(messages: DataFrame) -> DataFrame:
    """``messages`` with each turn's rendering and the span under the loss mask (start = stop: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            spans = [read_back(x)[2] if r == "assistant" else (0, 0) for x, r in zip(out, batch.column("role").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv_id", "turn", "part")] + [pa.array(out, pa.string()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())],
                ["conv_id", "turn", "part", "rendered", "loss_start", "loss_stop"],
            )

    return messages.mapInArrow(run, "conv_id long, turn long, part long, rendered string, loss_start long, loss_stop long")


def digests(formatted: DataFrame) -> DataFrame:
    """Figures of each conversation, read back from the rendered turns in order; running state only."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []

        def close() -> None:
            rows.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, x, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_stop")), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, _ = read_back(x)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(x[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(x)
            if len(rows) >= 2000:
                yield out(rows)
                rows.clear()
        if state is not None:
            close()
        if rows:
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_log(turns: DataFrame) -> DataFrame:
    """The event log that streams each row of (conv_id, turn, role, text): a start, then deltas of DELTA characters."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # a number for rows of one turn, the same in any order of the input
    part = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).cast("long")
    cut = F.sequence(F.lit(0).cast("long"), F.ceil(F.length("text") / DELTA))
    return rows.withColumn("part", part).select(
        "conv_id", "turn", "part", F.explode(cut).alias("seq"), "role", "text"
    ).select(
        "conv_id", "turn", "part", "seq",
        F.when(F.col("seq") == 0, "start").otherwise("delta").alias("kind"),
        F.when(F.col("seq") == 0, F.col("role")).alias("role"),
        F.when(F.col("seq") == 0, F.lit("")).otherwise(F.substring(F.col("text"), ((F.col("seq") - 1) * DELTA + 1).cast("int"), F.lit(DELTA))).alias("text"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every conversation and of conversation -7, whose texts hold control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return digests(format_turns(fold(as_log(turns.unionByName(extra)))))


#: op3 in DuckDB: marks cost 13 characters a turn besides role and text, escapes one each.
OP3_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<|', '\<|'), '|>', '\|>') AS x, replace(replace(replace(role, '\', '\\'), '<|', '\<|'), '|>', '\|>') AS r FROM t)
    SELECT conv_id::bigint AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    sum(length(r) + length(x) + 13)::bigint AS formatted_chars FROM e GROUP BY 1"""
