"""Chat formatting: conversations rendered by a compiled template, with loss spans.

Edge cases: a null text or role is empty; a conversation with a null conv_id is one of its own;
rows of equal turn go by role and text, and repeated rows stay turns of their own; texts of any
length are formatted whole; an empty table formats nothing; other columns are ignored. A
conversation is one formatted text, so one task holds it while it is made; rows arrive sorted and
no more than one conversation is held.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm.tables import read, shuffle_partitions
from gazelark.llm.template import compile_template

TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text|escape }}[/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text|escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}[SYS]{{ m.text|escape }}[/SYS]"
    "{% else %}[ROLE]{{ m.role|escape }}[/ROLE]{{ m.text|escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)
_CONTROL = r"(?=(?:/?(?:INST|SYS|ROLE)\]|/TURN\]|/?s>))"
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*){_CONTROL}"), re.compile(rf"([<\[])\\(\\*){_CONTROL}")
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[/TURN\]", re.DOTALL)


def escape(text: str) -> str:
    """A backslash more inside every control string, so that none stands in the result."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = m["role"] if m["role"] is not None else next(k for k in ("user", "assistant", "system") if m[k] is not None)
        out.append((unescape(role), unescape(m["text"] if m["role"] is not None else m[role])))
        at = m.end()
    return out


_RENDER = {}


def render(messages: list[dict], template: str = TEMPLATE):
    if template not in _RENDER:
        _RENDER[template] = compile_template(template, {"escape": escape})
    return _RENDER[template](messages=messages)


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_starts, loss_ends (code points) of rows conv_id, turn, role, text."""
    chosen = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spread = chosen.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([chosen.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("loss_starts", T.ArrayType(T.LongType())), T.StructField("loss_ends", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, ready, chars = to_arrow_schema(schema), [], 0
        held, messages = None, []

        def finished():
            out = render(messages, template)
            return held, out.text, [a for a, _ in out.spans], [b for _, b in out.spans]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*ready), kinds)], schema=kinds)

        for batch in batches:
            for conv, _, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if messages and conv != held:
                    ready.append(finished())
                    chars += len(ready[-1][1])
                    messages = []
                    if chars > 4_000_000:
                        yield flush()
                        ready, chars = [], 0
                held = conv
                messages.append({"role": role, "text": text})
        if messages:
            ready.append(finished())
        if ready:
            yield flush()

    return spread.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts."""
    fields = [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    schema = T.StructType([formatted.schema["conv_id"], *fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for text, starts, ends in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                back = turns(text)
                said = "".join(f"{role}\n{content}\n" for role, content in back)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
                out.append((len(back), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k.type) for c, k in zip(columns, list(kinds)[1:])]], schema=kinds)

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like markers."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(format_conversations(rows.unionByName(probe)))
