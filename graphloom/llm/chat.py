"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths ("messages[].role").
Layouts are declared as the paths they need and where their turns are; the paths
behind a fingerprint choose the layout once, and every record of that fingerprint
is converted by it to canonical turns: conversation, turn, role, content.  A record
may be a whole conversation or a part of one with a position.  Tables with a row a turn
are recognised by the paths of their schema and stay in the JVM.

Turns are numbered by a window over their conversation.  Conversations of more than
HOT_ROWS turns are sorted by range instead and numbered with the offsets of their
partitions, so that none is gathered in one task.

Defined results: turns are numbered from 0 without gaps in the order of the
record (of parts: by position, then content and role; for turn rows: by turn, nulls
last, then content and role); null and blank contents (nothing but white space) are
no turns; roles are mapped to system, user, assistant and tool, unknown ones are
lower-cased, a null or blank role is user; each row or record with a null conversation
is a conversation of its own; ties and repeated rows are repeated turns; very long
contents are kept whole; records that are null, empty, malformed or of no declared
layout give one row without turn, whose layout says which; an empty table gives an
empty result.  Further fields and columns may be present, whatever they are called:
the most specific layout wins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ._cluster import cut, sized

ROLES = {"human": "user", "prompter": "user", "customer": "user", "question": "user", "instruction": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant", "agent": "assistant", "answer": "assistant", "developer": "system", "function": "tool", "ipython": "tool", "observation": "tool"}


#: White space, the same here and in the JVM.
BLANK = " \t\n\r\x0b\x0c\u00a0\u2028\u2029\u3000"
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """Where a layout's turns are: in a list of messages, or in fields of given roles (paths with dots)."""

    name: str
    needs: frozenset[str]
    messages: tuple[str, str, str] | None = None  # path of the list, role key, content key
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, paths joined by a blank line


def _list(name: str, path: str, role: str, content: str) -> Layout:
    return Layout(name, frozenset({f"{path}[].{role}", f"{path}[].{content}"}), (path, role, content))


def _fields(name: str, *turns: tuple[str, tuple[str, ...]], optional: tuple[str, ...] = ()) -> Layout:
    return Layout(name, frozenset(p for _, ps in turns for p in ps if p not in optional), None, turns)


LAYOUTS = (
    _list("messages", "messages", "role", "content"),
    _list("conversation_list", "conversation", "role", "content"),
    _list("from_value", "conversations", "from", "value"),
    _list("role_value", "conversations", "role", "content"),
    _list("nested_messages", "data.messages", "role", "content"),
    _list("speaker_text", "dialog", "speaker", "text"),
    _list("author_turns", "turns", "author", "text"),
    _fields("instruction_input_output", ("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)), optional=("system", "input")),
    _fields("instruction_response", ("user", ("instruction", "context")), ("assistant", ("response",)), optional=("context",)),
    _fields("prompt_completion", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)), optional=("system",)),
    _fields("prompt_response", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)), optional=("system",)),
    _fields("prompt_chosen", ("user", ("prompt",)), ("assistant", ("chosen",))),
    _fields("question_answer", ("user", ("context", "question")), ("assistant", ("answer",)), optional=("context",)),
    _fields("nested_prompt", ("user", ("input.text",)), ("assistant", ("output.text",))),
)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; lists are []."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(found)))


def choose(found: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout that needs most of these paths; the earlier of equals."""
    fit = [x for x in layouts if x.needs <= found]
    return max(fit, key=lambda x: len(x.needs)) if fit else None


def _get(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _content(value) -> str | None:
    """Text of a content: a string, or a list of parts of which the text parts count."""
    if isinstance(value, list):
        parts = [p if isinstance(p, str) else p.get("text") if isinstance(p, dict) else None for p in value]
        value = "".join(p for p in parts if isinstance(p, str))
    elif value is not None and not isinstance(value, str):
        value = json.dumps(value, ensure_ascii=False)
    return value if value and value.strip(BLANK) else None


def role_of(role) -> str:
    name = str(role).strip(BLANK).lower() if role is not None else "user"
    return ROLES.get(name, name or "user")


def turns_of(record, layout: Layout) -> list[tuple[str, str]]:
    """(role, content) of each turn."""
    if layout.messages:
        path, role, content = layout.messages
        found = _get(record, path)
        items = [(role_of(m.get(role)), _content(m.get(content))) for m in found if isinstance(m, dict)] if isinstance(found, list) else []
    else:
        items = []
        for role, fields in layout.fields:
            texts = [t for t in (_content(_get(record, f)) for f in fields) if t]
            items.append((role, "\n\n".join(texts) if texts else None))
    return [(r, c) for r, c in items if c]


def convert(text: str | None, cache: dict[str, Layout | None], layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[str | None, str, list[tuple[str, str]]]:
    """(fingerprint, layout name, turns) of one record's JSON."""
    try:
        record = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None, "malformed", []
    if not isinstance(record, dict):
        return None, "null" if record is None else "malformed", []
    found = paths(record)
    key = fingerprint(found)
    if key not in cache:
        cache[key] = choose(found, layouts)
    return (key, cache[key].name, turns_of(record, cache[key])) if cache[key] else (key, "unknown", [])


def numbered(rows: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with turn: their number from 0 in their conversation by `order`, a null conversation's 0."""
    order_by = [F.col(c).asc_nulls_last() for c in order]
    number = (F.row_number().over(Window.partitionBy("conversation").orderBy(*order_by)) - 1).cast("long")
    alone = rows.where("conversation IS NULL").withColumn("turn", F.lit(0).cast("long"))
    known = rows.where("conversation IS NOT NULL")
    hot = cut(known.groupBy("conversation").count().where(F.col("count") > hot_rows).select(F.col("conversation").alias("_hot")))
    n = hot.count()
    if not n:
        return known.withColumn("turn", number).union(alone)
    side = sized(hot, n, 200)
    usual = known.join(side, F.col("conversation") == F.col("_hot"), "left_anti").withColumn("turn", number)
    by = ["conversation", *order]
    lots = known.join(side, F.col("conversation") == F.col("_hot"), "left_semi")
    # a checkpoint keeps the partitions and their order
    placed = cut(lots.repartitionByRange(max(2, lots.sparkSession.sparkContext.defaultParallelism), *[F.col(c).asc_nulls_last() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in by])).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part", "conversation").agg(F.count("*").alias("n")).collect()  # as many rows as hot conversations and partitions
    offset, total = {}, {}
    for part, c, k in sorted(counts, key=lambda r: (r[1], r[0])):
        offset[part, c] = total.get(c, 0)
        total[c] = total.get(c, 0) + k
    shared = rows.sparkSession.sparkContext.broadcast(offset)
    schema = S.StructType([*rows.schema, S.StructField("turn", S.LongType())])
    names, last = rows.columns, len(rows.columns)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        for batch in batches:
            turns = []
            for c, part in zip(batch.column("conversation").to_pylist(), batch.column(last).to_pylist()):
                if c not in at:
                    at[c] = shared.value[part, c]
                turns.append(at[c])
                at[c] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(turns, pa.int64())], [*names, "turn"])

    return usual.union(placed.mapInArrow(make, schema)).union(alone)


def format_records(df: DataFrame, record: str, conversation: str, layouts: tuple[Layout, ...] = LAYOUTS, position: str | None = None) -> DataFrame:
    """Canonical turns of JSON records: conversation, turn, role, content, layout, fingerprint.

    With a position, records are parts of a conversation, which is numbered throughout; parts without turns give no row then.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Layout | None] = {}
        for batch in batches:
            rows = []
            for c, p, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key, name, turns = convert(text, cache, layouts)
                rows += [(c, i, r, t, name, key, p) for i, (r, t) in enumerate(turns)] or [(c, None, None, None, name, key, p)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["conversation", "at", "role", "content", "layout", "fingerprint", "position"])

    rows = df.select(F.col(conversation).cast("string").alias("c"), (F.col(position) if position else F.lit(None)).cast("long").alias("p"), F.col(record).cast("string").alias("r"))
    turns = rows.mapInArrow(make, "conversation string, at long, role string, content string, layout string, fingerprint string, position long")
    if not position:
        return turns.select("conversation", F.col("at").alias("turn"), "role", "content", "layout", "fingerprint")
    return numbered(turns.where("at IS NOT NULL"), ["position", "at", "content", "role"]).select("conversation", "turn", "role", "content", "layout", "fingerprint")


def schema_paths(kind: S.DataType, at: str = "") -> set[str]:
    if isinstance(kind, S.StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, S.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return {at}


#: Names that a turn table's columns may have, the first that is there counts.
TURN_ROWS = {"conversation": ("conv_id", "conversation_id", "dialog_id", "thread_id"), "turn": ("turn", "turn_index", "message_index", "position"), "role": ("role", "from", "speaker", "author"), "content": ("text", "content", "value", "message")}


def format_table(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of a table: of a row a turn, or of a record a row (conversation is then an ``id`` or ``conv_id`` column)."""
    found = schema_paths(df.schema)
    columns = {k: next((n for n in names if n in found), None) for k, names in TURN_ROWS.items()}
    key = fingerprint(found)
    if all(columns.values()):
        role = F.lower(F.trim(F.col(f"`{columns['role']}`").cast("string"), F.lit(BLANK)))
        known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
        role = F.when(role.isNull() | (role == ""), "user").otherwise(F.coalesce(known[role], role))
        own = df.select(F.col(f"`{columns['conversation']}`").cast("string").alias("conversation"), F.col(f"`{columns['turn']}`").cast("long").alias("at"), role.alias("role"), F.col(f"`{columns['content']}`").cast("string").alias("content"))
        rows = numbered(own.where(F.trim(F.col("content"), F.lit(BLANK)) != ""), ["at", "content", "role"])
        return rows.select("conversation", "turn", "role", "content", F.lit("turn_rows").alias("layout"), F.lit(key).alias("fingerprint"))
    name = next((n for n in ("id", *TURN_ROWS["conversation"]) if n in df.columns), None)
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]))
    return format_records(df.select((F.col(name) if name else F.xxhash64(record)).cast("string").alias("c"), record.alias("r")), "r", "c", layouts)


def as_records(turns: DataFrame) -> DataFrame:
    """(conversation, position, record) of a turn table (conv_id, turn, role, text): each turn as JSON in one of several layouts.

    What a corpus of many origins looks like: six layouts in turn, of messages, of named speakers, of prompts and of instructions.
    """
    role, text = F.col("role"), F.col("text")
    one = lambda who, what: F.array(F.struct(role.alias(who), text.alias(what)))
    user, reply, system = (F.when(F.coalesce(role, F.lit("user")) == r, text) for r in ("user", "assistant", "system"))
    of_pairs = F.coalesce(role, F.lit("user")).isin("user", "assistant", "system")
    k = F.when(of_pairs, F.pmod(F.col("conv_id").cast("long") + F.col("turn"), F.lit(6))).otherwise(F.pmod(F.col("turn"), F.lit(4)))
    layouts = [
        F.struct(one("role", "content").alias("messages"), F.lit("crawl").alias("origin")),
        F.struct(one("from", "value").alias("conversations")),
        F.struct(F.struct(one("role", "content").alias("messages")).alias("data"), F.lit(1).alias("version")),
        F.struct(one("speaker", "text").alias("dialog")),
        F.struct(system.alias("system"), user.alias("prompt"), reply.alias("completion")),
        F.struct(system.alias("system"), user.alias("instruction"), F.lit("").alias("input"), reply.alias("output")),
    ]
    write = [F.to_json(x, {"ignoreNullFields": "false"}) for x in layouts]
    record = write[0]
    for i, x in enumerate(write[1:], 1):
        record = F.when(k == i, x).otherwise(record)
    return turns.select(F.col("conv_id").cast("string").alias("conversation"), F.col("turn").cast("long").alias("position"), record.alias("record"))


CHAT_SQL = """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS conversation, turn, text AS content, coalesce(role, 'user') AS role,
                  CASE (conv_id + turn) % 6 WHEN 0 THEN 'messages' WHEN 1 THEN 'from_value' WHEN 2 THEN 'nested_messages' WHEN 3 THEN 'speaker_text' WHEN 4 THEN 'prompt_completion' ELSE 'instruction_input_output' END AS layout
           FROM conversations WHERE regexp_matches(text, '\\S'))
SELECT conversation, CAST(row_number() OVER (PARTITION BY conversation ORDER BY turn, content, role) - 1 AS BIGINT) AS turn, role, content, layout FROM t
"""
