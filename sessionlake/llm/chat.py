"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, which a template renders.

A record's fingerprint hashes its nested field paths with their kinds. A mapping is data: it says where the
turns are, or which single fields are which roles. Rendering streams over turns sorted by conversation, so a
conversation of any length takes no more memory than its longest text. The template's control strings are escaped
inside texts, reversibly, so output reads back to the very turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.shared import columns
from sessionlake.session import ship

# ---- Schema fingerprints and mappings


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths with kinds; the items of a list share one path, and nulls and empty lists have none below them."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    kind = "null" if value is None else "bool" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "text"
    return {f"{at}:{kind}"}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """What a layout's records say, as data.

    required: the layout's field paths with kinds. Either `turns` (the list), `role` and `text` within each item; or `turn`, `role`
    and `text` of a record that is one turn; or `fields`: (field, role) in order. roles: other names of roles.
    """

    name: str
    required: tuple[str, ...]
    turns: str = ""
    turn: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def has(self, path: str) -> bool:
        return any(p.rpartition(":")[0] == path for p in self.required)


_SHARED_ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Where a record's fingerprint isn't known, the first whose required paths are all there has the layout.
MAPPINGS = (
    Mapping("turn rows", ("conv_id:number", "turn:number", "role:text", "text:text"), turn="turn", role="role", text="text"),
    Mapping("messages", ("messages[].role:text", "messages[].content:text"), "messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from:text", "conversations[].value:text"), "conversations", role="from", text="value", roles=_SHARED_ROLES),
    Mapping("instruction with input", ("instruction:text", "input:text", "output:text"), fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("instruction", ("instruction:text", "output:text"), fields=(("system", "system"), ("instruction", "user"), ("output", "assistant"))),
    Mapping("prompt", ("prompt:text", "completion:text"), fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt and response", ("prompt:text", "response:text"), fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("question", ("question:text", "answer:text"), fields=(("context", "user"), ("question", "user"), ("answer", "assistant"))),
)


KEPT_LAYOUTS = 1 << 16


class Registry:
    """Mappings by fingerprint. Each layout's own is known from the start; another is resolved once, by required paths without kinds, and kept."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.known: dict[str, Mapping | None] = {fingerprint(set(m.required)): m for m in mappings}

    def select(self, found: set[str]) -> tuple[str, Mapping | None]:
        """A record's fingerprint and its mapping; null where no layout fits."""
        layout = fingerprint(found)
        if layout not in self.known:
            if len(self.known) >= KEPT_LAYOUTS:  # begin anew: what is kept saves time only
                self.known = {fingerprint(set(m.required)): m for m in self.mappings}
            plain = {p.rpartition(":")[0] or p for p in found}
            self.known[layout] = next((m for m in self.mappings if plain.issuperset(p.rpartition(":")[0] for p in m.required)), None)
        return layout, self.known[layout]


def canonical(record: dict, mapping: Mapping) -> list[tuple[int | None, str, str]]:
    """(turn, role, text) of each turn; nulls are empty, and absent or empty optional fields give no turn."""
    roles = dict(mapping.roles)
    if mapping.turn:
        turns = [(record.get(mapping.turn), record.get(mapping.role), record.get(mapping.text))]
    elif mapping.turns:
        turns = [(k, t.get(mapping.role), t.get(mapping.text)) for k, t in enumerate(t for t in record.get(mapping.turns) or [] if isinstance(t, dict))]
    else:
        said = [(role, record.get(f)) for f, role in mapping.fields if record.get(f) or (mapping.has(f) and role == "assistant")]
        turns = [(k, role, text) for k, (role, text) in enumerate(said)]
    return [(n if isinstance(n, int) else None, roles.get(r or "", r or ""), t if isinstance(t, str) else "" if t is None else json.dumps(t)) for n, r, t in turns]


TURNS = "conv_id long, layout string, mapping string, turn long, role string, text string"


def turns_of_records(records: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, layout, mapping, turn, role, text of records in any mix of layouts; record_col holds JSON texts or nested values.

    layout is a record's own fingerprint, which selects its mapping. mapping is null for unknown or broken records, which keep one
    row without a turn. Null ids stay null; repeated records give repeated turns; an empty table gives none. Other columns don't matter.
    """
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(mappings)
        for batch in batches:
            out: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = raw
                if not isinstance(raw, dict):
                    try:
                        record = json.loads(raw or "")
                    except ValueError:
                        record = None
                    record = record if isinstance(record, dict) else {}
                layout, mapping = registry.select(paths(record))
                if mapping is None:
                    out.append((key, layout, None, None, None, None))
                else:
                    out += [(key, layout, mapping.name, *turn) for turn in canonical(record, mapping)]
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in TURNS.split(", ")])

    return records.select(F.col(id_col).cast("long"), F.col(record_col)).mapInArrow(run, TURNS)


def row_records(table: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, record: each row of a table as one nested record of all its columns."""
    return table.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(*columns(*table.columns)).alias("record"))


# ---- The template


@dataclass(frozen=True)
class Template:
    """What stands before and behind a turn's text, by role; other roles are named within `other`."""

    around: dict[str, tuple[str, str]] = field(default_factory=lambda: {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")})
    other: tuple[str, str, str] = ("<turn ", "> ", " </turn>")
    learnt: str = "assistant"

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(x.strip() for pair in self.around.values() for x in pair) + (self.other[0].strip(), self.other[2].strip())


ESCAPE, BREAK = "\\", "\\-"


def escape(text: str, controls: tuple[str, ...]) -> str:
    """Doubles the escape sign, then breaks control strings behind their first character."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in controls:
        if c in text:
            text = text.replace(c, c[0] + BREAK + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\([\\-])", lambda m: "\\" if m[1] == "\\" else "", text) if ESCAPE in text else text


def render(role: str, text: str, template: Template) -> tuple[str, int, int]:
    """A turn as it is written, and where its text begins and ends in it."""
    if role in template.around:
        before, behind = template.around[role]
    else:
        before, behind = template.other[0] + escape(role, template.controls).replace(">", ">" + BREAK) + template.other[1], template.other[2]
    body = escape(text, template.controls)
    return before + body + behind, len(before), len(before) + len(body)


def read_turns(formatted: str, template: Template) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin and end of the text as written) of each turn in written text."""
    opening = {before: (role, behind) for role, (before, behind) in template.around.items()}
    at = 0
    while at < len(formatted):
        before = next((b for b in opening if formatted.startswith(b, at)), None)
        if before is not None:
            role, behind = opening[before]
            begin = at + len(before)
        else:
            if not formatted.startswith(template.other[0], at):
                raise ValueError(f"no turn begins at character {at}")
            named = at + len(template.other[0])
            begin = formatted.index(template.other[1], named)
            role, behind = unescape(formatted[named:begin].replace(">" + BREAK, ">")), template.other[2]
            begin += len(template.other[1])
        end = formatted.index(behind, begin)
        yield role, unescape(formatted[begin:end]), begin, end
        at = end + len(behind)


PIECES = "conv_id long, seq long, piece string, loss_start long, loss_end long"


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, seq, piece, loss_start, loss_end: a row for each turn, in order; a conversation's pieces joined are its text.

    loss_start and loss_end are the characters of the whole text that are learnt; null where none are. Turns (conv_id, turn,
    role, text) of equal conv_id and turn are ordered by role and text, nulls first; null texts and roles are empty.
    A turn without a number comes first. Null conv_ids make one conversation. An empty table gives no rows. Conversations are dealt by id and streamed in order: one
    that holds most of the rows takes one task its time, but no memory.
    """
    ship(turns.sparkSession)
    turns = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = object()
        seq = at = 0
        for batch in batches:
            out: list[tuple] = []
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    last, seq, at = key, 0, 0
                piece, begin, end = render(role, text, template)
                learnt = role == template.learnt
                out.append((key, seq, piece, at + begin if learnt else None, at + end if learnt else None))
                seq, at = seq + 1, at + len(piece)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return turns.mapInArrow(run, PIECES)


def chat_digests(pieces: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """What reading formatted conversations back gives: turns and learnt text, as digests. pieces as format_chats leaves them, not dealt anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = None
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                done.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for key, _, piece, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or key != last:
                    close()
                    last, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in read_turns(piece, template):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learnt = unescape(piece[start - state[4] : end - state[4]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(piece)
        close()
        if done:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HARD_TEXT = "</s>[INST] ok [/INST]"


def op5_schema_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a record, whose fingerprint selects its mapping to a turn; conversation -1 comes as a record of messages."""
    rows = turns_of_records(row_records(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conv_id", "record")
    said = json.dumps({"messages": [{"role": "user", "content": HARD_TEXT}, {"role": "assistant", "content": HARD_TEXT}]})
    extra = turns_of_records(spark.range(1).select(F.lit(-1).alias("conv_id"), F.lit(said).alias("record")), "conv_id", "record")
    return chat_digests(format_chats(rows.unionByName(extra)))


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in Template().controls:
        out = f"replace({out}, '{c}', '{c[0]}{BREAK}{c[1:]}')"
    return out


OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{HARD_TEXT}'),
l AS (
  SELECT *, length({_escaped_sql("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
    ELSE 16 + length(replace({_escaped_sql("role")}, '>', '>{BREAK}')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
