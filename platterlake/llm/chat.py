"""Conversations formatted for training, with generation markers.

The template of :data:`TURNS` marks turns; :func:`escape` breaks control strings inside
texts by a backslash and doubles backslashes, which :func:`unescape` takes back exactly.
Conversations stream through the compiled template in order of (turn, role, text), so one
of any length needs the memory of two turns.

Defined results: null texts and roles count as empty, a null turn or id sorts first and a
null id is a conversation of its own; repeated rows are turns; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .templates import Template

#: Control strings of this template and of those in wide use; none survives in a text.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TURNS = (
    "{%- for m in messages -%}" + TURN + "{{ m.role | escape }}" + TEXT
    + "{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}{%- else -%}{{ m.text | escape }}{%- endif -%}"
    + END + "{%- endfor -%}"
)
_CONTROL = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: object) -> str:
    """``text`` without control strings: ``\\`` behind their first character, ``\\`` doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", "" if text is None else str(text))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS = {"escape": escape}


class Reader:
    """Reads formatted text back piece by piece: turns, and what the loss mask covers."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self._held: list[str] = []  # of the turn not yet ended
        self._masked: list[str] = []

    def feed(self, text: str, masked: bool) -> None:
        self.chars += len(text)
        self._held.append(text)
        if masked:
            self._masked.append(text)
        if text.endswith(END):
            self._turn("".join(self._held))
            self._held.clear()

    def _turn(self, whole: str) -> None:
        role, _, rest = whole.removeprefix(TURN).partition(TEXT)
        body = rest.removesuffix(END)
        if not whole.startswith(TURN) or TEXT in body or END in body:
            raise ValueError("formatted text that cannot be read back")
        self.n_turns += 1
        self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
        loss = unescape("".join(self._masked))
        self._masked.clear()
        self.loss_chars += len(loss)
        self.loss.update(loss.encode())


def format_conversations(df: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, seq, formatted, mask): the pieces of each conversation in order; mask is
    whether the loss covers a piece.  A conversation's text is its pieces joined."""
    return _run(df, template, False)


def read_back(df: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back
    from the formatted text of each conversation."""
    return _run(df, template, True)


def _run(df: DataFrame, source: str, digest: bool) -> DataFrame:
    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, rows = Template(source, FILTERS), conversations(batches)
        ahead = next(rows, None)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        while ahead is not None:
            conv = ahead[0]

            def messages(conv=conv) -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    now, ahead = ahead, next(rows, None)
                    yield {"role": now[2] or "", "text": now[3] or ""}

            reader, held = Reader(), 0
            for seq, (text, mask) in enumerate(template.stream(messages=messages())):
                if digest:
                    reader.feed(text, mask)
                else:
                    out.append((conv, seq, text, mask))
                    held += len(text)
                    if len(out) >= 4096 or held > 1 << 24:
                        yield batch()
                        held = 0
            if digest:
                out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(out) >= 4096:
                yield batch()
        if out:
            yield batch()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long" if digest else "conv_id long, seq long, formatted string, mask boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.toDF("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


#: A conversation whose texts are control strings, beside those of the table.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, read back from their formatted text."""
    schema = "conv_id long, turn long, role string, text string"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(rows.union(spark.createDataFrame(EXTRA, schema)))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '\\', '\\\\', 'g')) - length(text)
    + len(regexp_extract_all(text, '<\||\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS text_chars,
  length(regexp_replace(role, '\\', '\\\\', 'g')) + len(regexp_extract_all(role, '<\||\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS role_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + role_chars + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
