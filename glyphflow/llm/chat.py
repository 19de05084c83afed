"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example: all turns before it are its context, and
only its own text is trainable.  A rest of turns after the last assistant turn makes one more example
without a trainable part, so nothing of a conversation is left out of the output.

A turn is written as ``[INST] role``, a line feed, its text and ``[/INST]``; the turn of the assistant
as ``[ASST] role``, a line feed, its text and ``</s>``.  Inside roles and texts a backslash is doubled
and each control string gets a backslash after its first character, so it is no control string any
more; a line feed in a role has a backslash before it.  A backslash always stands for the character
behind it, which undoes all of this.  The mask of an example is the span [loss_start, loss_end) of the
formatted string in code points: the reply's escaped text (without the end mark).

Defined cases: a null text or role is empty; rows of one conversation are ordered by turn, ties by role
and text, repeated rows are turns of their own; rows with a null conv_id form one conversation of null
id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed control strings of the template.
CONTROLS = ("[INST]", "[/INST]", "[ASST]", "<s>", "</s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"\[(INST|ASST)\] ((?:[^\\\n]++|\\.)*+)\n((?:[^\\\[<]++|\\.|\[(?!/INST\])|<(?!/s>))*+)(?:\[/INST\]|</s>)", re.S)

#: Examples leave a task in batches of about so many characters, one example at least.
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of its text."""
    asked = role != "assistant"
    head = ("[INST] " if asked else "[ASST] ") + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + ("[/INST]" if asked else "</s>"), len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of all turns of a formatted string; fails on anything else."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[2]), unescape(m[3])))
        at = m.end()
    return out


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end), the examples of a conversation one after the other."""
    kind = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        conv, context, waiting, count, out = object(), [], False, 0, []
        size, filled = 0, 0

        def rest():
            return [{"conv_id": conv, "example": count, "formatted": "".join(context), "loss_start": size, "loss_end": size}] if waiting else []

        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv:
                    out += (last := rest())
                    filled += size if last else 0
                    conv, context, waiting, count, size = c, [], False, 0, 0
                formatted, a, b = turn(role, text)
                context.append(formatted)
                waiting = role != "assistant"
                if not waiting:
                    out.append({"conv_id": c, "example": count, "formatted": "".join(context), "loss_start": size + a, "loss_end": size + b})
                    count += 1
                    filled += size + len(formatted)
                size += len(formatted)
                if filled > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out, filled = [], 0
        yield pa.RecordBatch.from_pylist(out + rest(), schema=kind)

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn"
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, "conv_id long, example long, formatted string, loss_start long, loss_end long")


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the output of examples() in its order.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_examples.  Each
    example must repeat the one before it as its beginning.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kind = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])

    def run(batches):
        conv, state = object(), None

        def done():
            if state is None:
                return []
            return [dict(zip(names, (conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["examples"]), strict=True))]

        for batch in batches:
            out = []
            for c, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if c != conv:
                    out += done()
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "before": "", "examples": 0}
                if not text.startswith(state["before"]):
                    raise ValueError(f"conversation {c}: an example doesn't begin with the one before it")
                for role, said in parse(text[len(state["before"]) :]):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                trained = unescape(text[a:b])
                state["chars"] += len(trained)
                state["loss"].update(trained.encode())
                state["all"] += len(text)
                state["examples"] += 1
                state["before"] = text
            yield pa.RecordBatch.from_pylist(out, schema=kind)
        yield pa.RecordBatch.from_pylist(done(), schema=kind)

    return formatted.mapInArrow(run, ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names))
