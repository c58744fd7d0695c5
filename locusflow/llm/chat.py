"""Chat records of any layout into canonical turns, and turns into marked-up text with a loss mask.

A record is JSON. The hash of its nested field paths is the fingerprint of its schema;
for each fingerprint the first of the declared LAYOUTS whose fields are all there is
chosen, once, and says where turns, roles and texts stand. Turns are dealt by
conversation and stream through a task in order, so that only one part of a
conversation is in memory at a time.

Text and control strings are told apart by escapes: the backslash, a ``<`` that begins the end
mark and a ``#`` that begins a turn mark are replaced, so neither mark can stand inside a text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks around a turn, and what stands for the characters that could make one up.
OPEN, COLON, END = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c", "\n": "\\n"}
#: Characters of formatted text after which a conversation goes on in a further part.
PART = 1 << 20
#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a schema keeps its turns.

    ``turns`` has (role, path) pairs of single texts, taken in this order where they are
    there; or else ``each`` is the path of an array, and ``role`` and ``text`` are paths
    within its elements (with an empty ``each``, within the record, which then is one turn
    and has its number at ``order``). ``needs`` are the paths that tell the layout.
    """

    name: str
    needs: frozenset[str]
    turns: tuple[tuple[str, str], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    order: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)


def _pairs(name: str, *turns: tuple[str, str], needs: int = 2) -> Layout:
    """A layout of single texts; the last ``needs`` of them must be there."""
    return Layout(name, frozenset(p for _, p in turns[-needs:]), turns)


LAYOUTS = (
    Layout("turn rows", frozenset({"conv_id", "turn", "role", "text"}), each="", text="text", order="turn"),
    Layout("message parts", frozenset({"messages[].role", "messages[].content[].text"}), each="messages", text="content[].text"),
    Layout("messages", frozenset({"messages[].role", "messages[].content"}), each="messages"),
    Layout("from and value", frozenset({"conversations[].from", "conversations[].value"}), each="conversations", role="from", text="value", roles=ROLES),
    Layout("speakers", frozenset({"dialog.turns[].speaker", "dialog.turns[].utterance"}), each="dialog.turns", role="speaker", text="utterance", roles=ROLES),
    _pairs("instruction", ("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"), needs=3),
    _pairs("plain instruction", ("system", "system"), ("user", "instruction"), ("assistant", "output")),
    _pairs("prompt and response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _pairs("prompt and completion", ("system", "system"), ("user", "prompt"), ("assistant", "completion")),
    _pairs("question and answer", ("system", "context"), ("user", "question"), ("assistant", "answer")),
)
#: Where a record may have its conversation's id, best first.
ID_PATHS = ("conv_id", "id")


def field_paths(value, path: str = "") -> set[str]:
    """Paths of all fields of a JSON value, inner ones too; ``[]`` stands for any place of an array."""
    out = {path} if path else set()
    if isinstance(value, dict):
        for k, x in value.items():
            out |= field_paths(x, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for x in value:
            out |= field_paths(x, path + "[]")
    return out


def fingerprint(paths: frozenset[str]) -> str:
    """The schema's hash: it depends on the set of paths only, not on their order, types or values."""
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)))


@lru_cache(maxsize=4096)
def _chosen(_: str, paths: frozenset[str]) -> Layout | None:
    return next((x for x in LAYOUTS if x.needs <= paths), None)


def layout_of(paths: frozenset[str]) -> tuple[str, Layout | None]:
    """(fingerprint, layout) of a schema; no layout where none fits. Each of the last 4096 schemas is matched once."""
    mark = fingerprint(paths)
    return mark, _chosen(mark, paths)


def at_path(value, path: str) -> list:
    """All values at a path, null where an inner field is missing."""
    if not path:
        return [value]
    name, _, rest = path.partition(".")
    many = name.endswith("[]")
    inner = value.get(name.removesuffix("[]")) if isinstance(value, dict) else None
    return [y for x in (inner if many and isinstance(inner, list) else [] if many else [inner]) for y in at_path(x, rest)]


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[int | None, str, str]]:
    """(number, role, text) of a record's turns in order; null texts are empty, a null role too."""
    if layout.each is None:
        there = [(r, at_path(record, p)[0]) for r, p in layout.turns if p in layout.needs or p in record]
        return [(i, r, as_text(x)) for i, (r, x) in enumerate(there)]
    out = []
    for i, x in enumerate(at_path(record, layout.each + "[]" if layout.each else "")):
        role = as_text(at_path(x, layout.role)[0])
        number = at_path(record, layout.order)[0] if layout.order else i
        out.append((number, layout.roles.get(role, role), "".join(map(as_text, at_path(x, layout.text)))))
    return out


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, layout, fingerprint) of ``records`` (record: JSON text).

    A record that is no JSON object, or whose fields fit no layout, gives one row without
    turn and role, with a null layout and the record as text, so nothing goes unseen. A null
    record counts as such. An empty array has no turns. Ids stand in ``conv_id`` or ``id`` where
    they are whole numbers, and are null otherwise. Repeated records give repeated turns; an
    empty table gives an empty one; further columns are left out, and further fields of a
    record change its fingerprint but not its turns.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for raw in batch.column("record"):
                raw, paths = raw.as_py(), frozenset()
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                mark, layout = layout_of(paths := frozenset(field_paths(record))) if isinstance(record, dict) else (fingerprint(paths), None)
                conv = next((x for p in ID_PATHS if p in paths and isinstance(x := record[p], int) and not isinstance(x, bool)), None)
                for number, role, text in turns_of(record, layout) if layout else [(None, None, raw)]:
                    for column, x in zip(out, (conv, number, role, text, layout and layout.name, mark), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["conv_id", "turn", "role", "text", "layout", "fingerprint"])

    return records.select("record").mapInArrow(work, "conv_id bigint, turn bigint, role string, text string, layout string, fingerprint string")


def escaped(text: str) -> str:
    """Text in which neither mark can stand; only what could begin one is changed."""
    text = text.replace("\\", ESCAPES["\\"])
    return re.sub(r"<(?=/turn>)|#(?=##)", lambda m: ESCAPES[m[0]], text)


def escaped_role(role: str) -> str:
    return re.sub(r"[\\<#:\n]", lambda m: ESCAPES[m[0]], role)


_PLAIN = {v: k for k, v in ESCAPES.items()}


def plain(text: str) -> str:
    """The text before it was escaped."""
    return re.sub(r"\\.", lambda m: _PLAIN[m[0]], text)


def format_turns(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, text, mask) of ``turns`` (conv_id, turn, role, text): marked-up text, and where loss is taken.

    ``mask`` has the [start, end) places, in code points of this part, of each text of the role
    ``assistant``, without its marks. A conversation is cut between turns once a part has ``part``
    characters; its text is its parts in order. Rows are ordered by turn, null first, then
    by role and text; equal rows each make a turn. Rows with a null id make one conversation, null
    texts and roles are empty ones, an empty table gives an empty one, further columns are left out.
    Each conversation streams through one task, of which a part is in memory at a time.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        current, number, pieces, size, mask = None, 0, [], 0, []
        ready: list[tuple] = []

        def rows() -> pa.RecordBatch:
            spans = pa.array([r[3] for r in ready], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            found = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int64()), pa.array([r[2] for r in ready], pa.string()), spans], names=["conv_id", "part", "text", "mask"])
            ready.clear()
            return found

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role"), batch.column("text"), strict=True):
                if pieces and (conv != current or size >= part):
                    ready.append((current, number, "".join(pieces), mask))
                    number, pieces, size, mask = number + 1, [], 0, []
                if conv != current:
                    current, number = conv, 0
                head = f"{OPEN}{escaped_role(name := role.as_py() or '')}{COLON}"
                body = escaped(text.as_py() or "")
                if name == "assistant":
                    mask.append({"start": size + len(head), "end": size + len(head) + len(body)})
                pieces += (head, body, END)
                size += len(head) + len(body) + len(END)
                if len(ready) >= 1000:
                    yield rows()
        if pieces:
            ready.append((current, number, "".join(pieces), mask))
        yield rows()

    dealt = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(work, "conv_id bigint, part bigint, text string, mask array<struct<start:bigint,end:bigint>>")


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of marked-up text."""
    out, at = [], 0
    while at < len(text):
        colon = text.index(COLON, at)
        end = text.index(END, colon)
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn begins at character {at}")
        out.append((plain(text[at + len(OPEN) : colon]), plain(text[colon + len(COLON) : end])))
        at = end + len(END)
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """What marked-up text holds, by conversation, as ``format_turns`` gives it: its parts stand together and in order.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline a turn), loss_chars and loss_sha256 (of
    what the mask covers, unescaped), formatted_chars. Hashes run along the parts, so none of a conversation is kept.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        state, done = None, []

        def closed():
            conv, n, turns, loss, chars, size = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, number, text, mask in zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), batch.column("mask"), strict=True):
                if number == 0:
                    if state:
                        closed()
                    state = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                text = text.as_py()
                for role, said in parsed(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for span in mask.as_py():
                    said = plain(text[span["start"] : span["end"]])
                    state[3].update(said.encode("utf-8", "replace"))
                    state[4] += len(said)
                state[5] += len(text)
            rows, done = done, []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        if state:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

    return formatted.mapInArrow(work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The contract's conversation -7, in a layout of its own.
CONTROL = r"\### Assistant: </turn> ok"
EXTRA = json.dumps({"id": -7, "messages": [{"role": r, "content": CONTROL} for r in ("user", "assistant")]})


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, whose rows are records of one turn, and a record of messages: formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    records = rows.select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    extra = spark.range(1).select(F.lit(EXTRA).alias("record"))
    return read_back(format_turns(canonical_turns(records.unionByName(extra))))

#: The same in DuckDB; how many characters escapes add is counted.
SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')),
f AS (SELECT *, {len(OPEN + COLON + END)} + length(role) + length(regexp_replace(role, '[^\\<#:\n]', '', 'g')) + 2 * length(text) - length(replace(text, '\', ''))
  + (length(text) - length(replace(text, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: greatest(0, length(x) - 2))), 0) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""
