"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it as context.

A formatted turn is ``<|im_start|>role``, a line feed, the text and ``<|im_end|>``. Roles and texts are escaped first: a
backslash is doubled, ``<|`` becomes ``<\\|`` and a line feed in a role gets a backslash before it, so neither holds a mark
of the template, and reading undoes it.
Only the reply of the example's last turn is trainable; its place is given in code points of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
# Characters of formatted text that go to Spark in one batch.
BATCH_CHARS = 4 << 20
# A null conversation id sorts behind every real one.
NO_ID = 2**63 - 1

EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_stop long, last boolean"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    """Every backslash stands for the character after it."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and stops."""
    head, body = BEGIN + escaped(role).replace("\n", "\\\n") + "\n", escaped(text)
    return head + body + END, len(head), len(head) + len(body)


def read_back(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted text."""
    turns = []
    for part in text.split(END)[:-1]:
        if not part.startswith(BEGIN):
            raise ValueError("a turn does not begin with its mark")
        role, body = re.fullmatch(r"((?:[^\\\n]|\\.)*)\n(.*)", part[len(BEGIN) :], re.S).groups()
        turns.append((unescaped(role), unescaped(body)))
    return turns


def _turns(conversations: DataFrame) -> DataFrame:
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def examples(conversations: DataFrame) -> DataFrame:
    """One row for every assistant turn, and one without a trainable part for turns that follow the last of them.

    ``text`` is the formatted prefix up to and with the turn, ``loss_start`` and ``loss_stop`` bound the reply
    in it (null: nothing is trained on), ``last`` marks the example that holds the whole conversation. Turns
    go by their number; a null number comes last, ties go by role and text, so repeated rows stay and lie
    side by side. Null roles and texts are empty, rows without a
    conversation id form one conversation, other columns are ignored. Turns stream through a task in
    order; it holds one conversation's prefix, which each of its examples holds too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size, conversation, prefix, length, number, pending = 0, None, [], 0, 0, None

        def closed():
            """The example that waited for what comes next, now the last of its conversation."""
            if pending is not None:
                return [(*pending, True)]
            return [(conversation, number, "".join(prefix), None, None, True)] if prefix else []

        def batch(rows):
            return pd.DataFrame(rows, columns=["conv_id", "example", "text", "loss_start", "loss_stop", "last"]).astype(
                {"conv_id": "int64", "example": "int64", "loss_start": "Int64", "loss_stop": "Int64", "last": bool}
            )

        for frame in frames:
            for conv, role, text in zip(frame["conv_id"].tolist(), frame["role"], frame["text"]):
                if conv != conversation:
                    rows = closed()
                    conversation, prefix, length, number, pending = conv, [], 0, 0, None
                else:
                    rows = [(*pending, False)] if pending is not None else []
                    pending = None
                out += rows
                size += sum(len(r[2]) for r in rows)
                turn, start, stop = formatted(role, text)
                prefix.append(turn)
                if role == "assistant":
                    prefix = ["".join(prefix)]
                    pending = (conv, number, prefix[0], length + start, length + stop)
                    number += 1
                length += len(turn)
                if size > BATCH_CHARS:
                    yield batch(out)
                    out, size = [], 0
        yield batch(out + closed())

    return _turns(conversations).mapInPandas(run, EXAMPLES)


def digests(found: DataFrame) -> DataFrame:
    """What the examples hold, read back from their text: a row for each conversation.

    ``turns_sha256`` is of role, line feed, text and line feed of every turn, ``loss_sha256`` of all text
    under the loss masks, ``loss_chars`` its code points, ``formatted_chars`` those of all examples.
    The examples of a conversation must come one after the other, as ``examples`` gives them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, chars, total = hashlib.sha256(), 0, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if not pd.isna(row.loss_start):
                    reply = unescaped(row.text[int(row.loss_start) : int(row.loss_stop)])
                    loss.update(reply.encode())
                    chars += len(reply)
                total += len(row.text)
                if row.last:
                    turns = read_back(row.text)
                    all_turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    out.append((row.conv_id, len(turns), all_turns, chars, loss.hexdigest(), total))
                    loss, chars, total = hashlib.sha256(), 0, 0
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return found.mapInPandas(run, kinds).withColumn("conv_id", F.when(F.col("conv_id") != NO_ID, F.col("conv_id")))
