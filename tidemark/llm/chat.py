"""Chat formatting: conversations rendered by a compiled template, and read back from its output.

A conversation becomes one text, so its turns are gathered in one row; nothing else is gathered.
Defined results: turns come by turn number (nulls first), ties by role, then text; repeated rows are
turns of their own; a null role or text is the empty string; rows with a null conv_id make up one
conversation with a null id; an empty table gives the rows of `extra` only; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table
from .template import compile_template, unescape

TEMPLATE = """
{%- set open = '<' ~ '|im_start|>' -%}
{%- for message in messages -%}
{{ open + (message.role | line) + '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
{{ '<|im_end|>' + '\\n' }}
{%- endfor -%}
"""
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendered conversation."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"not a rendered conversation at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a rendered conversation at {at}")
    return out


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, text, and the [start, end) spans of the text that a loss counts."""
    short_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))

    def render(batches):
        run = compile_template(template)
        for batch in batches:
            out = [run(messages=m) for m in batch.column(1).to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), spans], ["conv_id", "text", "loss"])

    return grouped.mapInArrow(render, "conv_id long, text string, loss array<struct<start: long, end: long>>")


def digests(rendered: DataFrame) -> DataFrame:
    """What the rendered texts hold, read back from them."""

    def run(batches):
        for batch in batches:
            n, turns, chars, loss, total = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                got = read_back(text)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                n.append(len(got))
                turns.append(hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in got).encode()).hexdigest())
                chars.append(len(under))
                loss.append(hashlib.sha256(under.encode()).hexdigest())
                total.append(len(text))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))
