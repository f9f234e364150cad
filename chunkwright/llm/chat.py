"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation makes an example of its own: all turns before it as
context, and only that reply's text trainable. A conversation that does not end
with an assistant turn makes one more row, without a target, so that no turn is lost.

Template: each turn is ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a
backslash is doubled, and a backslash is put after the first character of each string that
a chat template could take for a mark; so no mark can come from a text, and reading back is exact.

Rows: turns go in the order of turn, role, text (null turn first). A null role or text is empty.
Rows with a null conv_id make one conversation. Repeated rows are turns of their own. An empty
table gives an empty result. Extra columns are ignored. A conversation is
streamed from rows sorted within its partition: a task holds one conversation at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What is escaped; the template's own marks and those of common chat templates.
_MARKS = re.compile(r"(?:<(?=\|)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>))")
SCHEMA = "conv_id long, example int, text string, loss_start long, loss_end long"
_BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in (turn.split(TEXT) for turn in formatted.removesuffix(END).removeprefix(TURN).split(END + TURN))] if formatted else []


def examples(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int | None, int | None]]:
    """(formatted prefix, loss start, loss end) for each assistant turn, then the rest without a target."""
    text = ""
    for role, said in turns:
        text += TURN + escape(role) + TEXT
        start = len(text)
        text += escape(said)
        end = len(text)
        text += END
        if role == "assistant":
            yield text, start, end
    if turns and turns[-1][0] != "assistant":
        yield text, None, None


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    now, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and conv != now:
                yield now, turns
                turns = []
            now = conv
            turns.append((role or "", text or ""))
    if turns:
        yield now, turns


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "example", "text", "loss_start", "loss_end"])

    for conv, turns in _conversations(batches):
        for k, (text, start, end) in enumerate(examples(turns)):
            rows.append((conv, k, text, start, end))
            size += len(text)
            if size > _BATCH_CHARS:
                yield flush()
                rows, size = [], 0
    if rows:
        yield flush()


def expand(conversations: DataFrame) -> DataFrame:
    """One row for each example: ``SCHEMA``; loss positions are code points of ``text``."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    by_conv = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return by_conv.mapInArrow(_expanded, SCHEMA)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now, last, loss, chars, total, started = None, "", hashlib.sha256(), 0, 0, False
    rows: list[tuple] = []

    def close() -> None:
        turns = read_back(last)
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        rows.append((now, len(turns), whole, chars, loss.hexdigest(), total))

    for batch in batches:
        for conv, k, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k == 0:
                if started:
                    close()
                now, loss, chars, total, started = conv, hashlib.sha256(), 0, 0, True
            if start is not None:
                said = unescape(text[start:end])
                loss.update(said.encode())
                chars += len(said)
            total += len(text)
            last = text
        if len(rows) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(names))
            rows.clear()
    if started:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(names))


def digests(expanded: DataFrame) -> DataFrame:
    """Reads each conversation back from its examples, which follow each other in ``expand``'s partitions."""
    return expanded.mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
