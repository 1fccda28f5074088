r"""Chat formatting from event logs.

A log is partitioned by conversation and sorted by message and sequence; streamed
deltas are appended, an edit replaces what is there, a regeneration starts afresh. The
final messages are rendered one row each, in order, with the loss mask beside them. Both
steps stream over the sorted partition, so a conversation of any length needs the memory
of one message.

A turn is `<|im_start|>role`, a line break, the text and `<|im_end|>` with a line break.
In a text `<|` cannot occur: a backslash is put behind each `<` that backslashes and a `|`
follow, and taken away again on reading. In a role, `%`, the line break and `|` are percent codes.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Kinds of events; the last two drop what the message has so far.
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"
ROWS = 1000
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def escape(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text):
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role):
    return role.replace("%", "%25").replace("\n", "%0A").replace("|", "%7C")


def unescape_role(role):
    return role.replace("%7C", "|").replace("%0A", "\n").replace("%25", "%")


def parse(formatted):
    """(role, text) of each turn of a formatted text."""
    return [(unescape_role(role), unescape(text)) for role, text in TURN.findall(formatted)]


def final_messages(events):
    """(conv_id, message, role, text) of events sorted by conversation, message and sequence.

    The role is that of the last event that has one.
    """
    now, role, parts = None, "", []
    for conv, message, said, kind, text in events:
        if now != (conv, message):
            if now is not None:
                yield *now, role, "".join(parts)
            now, role, parts = (conv, message), "", []
        if kind in (EDIT, REGENERATE):
            parts = []
        if text:
            parts.append(text)
        role = said or role
    if now is not None:
        yield *now, role, "".join(parts)


def columns_of(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))


def batches_of(rows, schema):
    rows = iter(rows)
    while part := [row for _, row in zip(range(ROWS), rows)]:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)


def render(log):
    """The formatted turns of a log, one row per final message.

    `log`: conv_id, message, seq, role, kind (delta, edit or regenerate), text. Columns
    returned: conv_id, message, formatted, loss_start, loss_end. The rows of a conversation
    lie together and in order of `message`; joined they are its formatted text. The loss mask
    is the part of `formatted` between the two places (code points, end exclusive), null
    where nothing is learned; only the text of `assistant` is.

    Null roles and texts are empty, and an empty message stays a turn. Events with equal
    sequence are applied in order of kind, then text; repeated deltas are applied each
    time. A null conv_id is a conversation of its own, null messages and sequences come first,
    unknown kinds count as deltas. Only the named columns are read; an empty log gives no rows.
    """
    order = ["conv_id", "message", "seq", "kind", "text"]
    named = log.select("conv_id", "message", "seq", "role", "kind", "text")
    placed = named.repartition("conv_id").sortWithinPartitions(*order)
    ids = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    schema = pa.schema([*(as_arrow(named, c) for c in ("conv_id", "message")), ("formatted", pa.string()),
                        ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        events = columns_of(batches, ["conv_id", "message", "role", "kind", "text"])
        rows = (turn(*x) for x in final_messages(events))
        return batches_of(rows, schema)

    return placed.mapInArrow(run, f"conv_id {ids['conv_id']}, message {ids['message']}, formatted string, loss_start long, loss_end long")


def as_arrow(df, column):
    """Name and Arrow type of a column, which may be of any type that Arrow batches hold."""
    return column, to_arrow_type(df.schema[column].dataType)


def turn(conv, message, role, text):
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    learned = (len(head), len(head) + len(body)) if role == LEARNED else (None, None)
    return conv, message, head + body + END, *learned


def digests(rendered):
    """Read back from `render`: one row per conversation, digests taken turn by turn.

    conv_id, n_turns, turns_sha256 (of role, line break, text and line break of each turn),
    loss_chars and loss_sha256 (of all text under the loss mask, unescaped), formatted_chars.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([as_arrow(rendered, "conv_id"), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(batches):
        now, total = None, None
        for conv, formatted, start, end in columns_of(batches, ["conv_id", "formatted", "loss_start", "loss_end"]):
            if now is None or now[0] != conv:
                if now is not None:
                    yield result(now[0], total)
                now, total = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                total[0] += 1
                total[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                learned = unescape(formatted[start:end])
                total[2] += len(learned)
                total[3].update(learned.encode())
            total[4] += len(formatted)
        if now is not None:
            yield result(now[0], total)

    def result(conv, total):
        return conv, total[0], total[1].hexdigest(), total[2], total[3].hexdigest(), total[4]

    def run(batches):
        return batches_of(rows(batches), schema)

    return rendered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def streamed(turns, size=400):
    """A log of the finished `turns` (conv_id, turn, role, text), as a server would have streamed them.

    Each text arrives as deltas of `size` code points; a text of more than one is cut off
    after the first and regenerated. One text in three, by digest, starts with a wrong draft, which an edit replaces by
    the first of its deltas. Rows that share a turn are messages of their own, in order of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    cut = F.regexp_extract_all("text", F.lit("(?s)(.{1,%d})" % size), 1)
    again = F.array(event(DELTA, F.substring("text", 1, size)), event(REGENERATE, F.lit("")))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    drafted = (F.col("text") != "") & (F.pmod(F.xxhash64("text"), F.lit(3)) == 0)
    deltas = F.transform(cut, lambda x: event(DELTA, x))
    edited = F.array(event(DELTA, F.concat(F.lit("draft of "), F.col("text"))), event(EDIT, F.get(cut, 0)))
    events = F.concat(
        F.when(F.char_length("text") > size, again).otherwise(none),
        F.when(F.col("text") == "", F.array(event(DELTA, F.lit("")))).otherwise(none),
        F.when(drafted, F.concat(edited, F.slice(deltas, F.lit(2), F.size(deltas)))).otherwise(deltas),
    )
    out = rows.select("conv_id", "message", "role", F.posexplode_outer(events).alias("seq", "e"))
    return out.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "role", "e.kind", "e.text")
