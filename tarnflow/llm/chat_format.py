"""Chat formatting: schema fingerprints choose a mapping to turns; turns become templated text.

* *Fingerprint.* A JSON record's fingerprint is a hash of the sorted set of its
  nested field paths (``messages[].role`` and the like; values do not count).
* *Mappings.* The registry maps fingerprints to declarative mappings: either the
  list of turns and its role and text fields, or a list of (role, fields) whose
  texts join by blank lines. ``register`` adds a layout by an example. A record
  of unknown layout yields no turns and keeps its fingerprint for review.
* *Template.* ``Template`` writes a turn as open mark, role, separator, text and
  end mark. Control strings inside role or text are broken by a backslash after
  their first character, and backslashes are doubled, so that ``unescape``
  restores every text and no text can forge a mark.
* *Loss mask.* The code points of assistant texts (as escaped) are marked.

Turns of a conversation are formatted and read back in streams: a task holds
one turn at a time, whatever the length of the conversation.

Defined results: null text or role is empty; turns sort by turn (null first),
role and text; repeated rows are turns of their own; an empty table gives no
conversations.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm._scratch import bound_batches


def field_paths(value, prefix: str = "") -> set[str]:
    """All nested field paths of a JSON value; list elements share the path ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def fingerprint(record) -> str:
    return hashlib.blake2b("\n".join(sorted(field_paths(record))).encode(), digest_size=8).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns."""

    turns: str = ""  # path of the list of turns; "" and role set: the record is one turn
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, fields) of a layout without a list
    roles: dict = field(default_factory=dict, hash=False)

    def apply(self, record) -> list[tuple[str, str]]:
        if self.parts:
            texts = [(role, "\n\n".join(str(record[f]) for f in fields if record.get(f) not in (None, ""))) for role, fields in self.parts]
            return [(role, text) for role, text in texts if text]
        items = [record]
        if self.turns:
            items = record
            for step in self.turns.split("."):
                items = items.get(step) or []
        return [(self.roles.get(r, r), t) for r, t in ((str(i.get(self.role) or ""), str(i.get(self.text) or "")) for i in items)]


#: Names that other layouts give to roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


class Registry:
    def __init__(self):
        self.by_print: dict[str, Mapping] = {}
        chat = lambda *keys: Mapping(turns="messages", role="role", text="content", roles=ROLES)
        self.register({"messages": [{"role": "", "content": ""}]}, chat())
        self.register({"messages": [{"role": "", "content": ""}], "id": ""}, chat())
        self.register({"conversations": [{"from": "", "value": ""}]}, Mapping(turns="conversations", role="from", text="value", roles=ROLES))
        self.register({"conversations": [{"from": "", "value": ""}], "id": ""}, Mapping(turns="conversations", role="from", text="value", roles=ROLES))
        self.register({"data": {"turns": [{"speaker": "", "text": ""}]}}, Mapping(turns="data.turns", role="speaker", text="text", roles=ROLES))
        self.register({"prompt": "", "completion": ""}, Mapping(parts=(("user", ("prompt",)), ("assistant", ("completion",)))))
        self.register({"prompt": "", "response": ""}, Mapping(parts=(("user", ("prompt",)), ("assistant", ("response",)))))
        self.register({"question": "", "answer": ""}, Mapping(parts=(("user", ("question",)), ("assistant", ("answer",)))))
        for extra in ((), ("input",), ("system",), ("input", "system")):
            record = {"instruction": "", "output": "", **dict.fromkeys(extra, "")}
            self.register(record, Mapping(parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))))
        for row in ({"role": "", "text": ""}, {"role": ""}, {"text": ""}, {}):
            self.register(row, Mapping(role="role", text="text", roles=ROLES))

    def register(self, example, mapping: Mapping) -> str:
        self.by_print[fp := fingerprint(example)] = mapping
        return fp

    def turns(self, record) -> tuple[str, list[tuple[str, str]] | None]:
        """The record's fingerprint, and its turns if the layout is known."""
        fp = fingerprint(record)
        mapping = self.by_print.get(fp)
        return fp, mapping.apply(record) if mapping else None


def canonical_turns(records: DataFrame, key: Column, record: Column, registry: Registry | None = None) -> DataFrame:
    """key, fingerprint, known, position, role, text: the turns of JSON records of any known layout."""
    layouts = registry or Registry()
    bound_batches(records.sparkSession)
    names = ["key", "fingerprint", "known", "position", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    fp, turns = layouts.turns(json.loads(raw))
                except (ValueError, TypeError, AttributeError):
                    fp, turns = "", None
                rows += [(k, fp, True, i, r, t) for i, (r, t) in enumerate(turns)] if turns else [(k, fp, False, None, None, None)]
            if rows:
                kinds = [batch.column(0).type, pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    source = records.select(key.alias("key"), record.alias("record"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, fingerprint string, known boolean, position bigint, role string, text string")


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    #: Control strings of common templates, which no text may contain either.
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.sep, self.end, *self.others)

    def escape(self, text: str) -> str:
        pattern = "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True))
        text = text.replace("\\", "\\\\")
        # a control string may begin inside another one, so every start is looked at on its own
        return re.sub(f"(?=({pattern}))(.)", r"\2\\", text, flags=re.S)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """The formatted turn, and where its text begins and ends."""
        head = f"{self.open}{self.escape(role)}{self.sep}"
        body = self.escape(text)
        return f"{head}{body}{self.end}", len(head), len(head) + len(body)

    def parse(self, formatted: str) -> tuple[str, str, int, int]:
        """Role, text and the text's place in one formatted turn."""
        a, b = formatted.index(self.sep), len(formatted) - len(self.end)
        if not formatted.startswith(self.open) or formatted[b:] != self.end:
            raise ValueError("not a formatted turn")
        begin = a + len(self.sep)
        return self.unescape(formatted[len(self.open) : a]), self.unescape(formatted[begin:b]), begin, b


FORMATTED = "conv_id bigint, position bigint, formatted string, loss_start bigint, loss_end bigint"


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """FORMATTED rows of ``turns`` (conv_id, turn, role, text): segments that concatenate by position.

    ``loss_start`` and ``loss_end`` are code points of the whole conversation; both
    are null for turns that are not the assistant's.
    """
    style = template or Template()
    bound_batches(turns.sparkSession)
    names = [c.split()[0] for c in FORMATTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, at = object(), 0, 0
        for batch in batches:
            rows = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    conv, position, at = c, 0, 0
                out, a, b = style.turn(role or "", text or "")
                loss = role == "assistant"
                rows.append((c, position, out, at + a if loss else None, at + b if loss else None))
                position, at = position + 1, at + len(out)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_conversations(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """READ rows, by parsing the formatted segments and their loss mask."""
    style = template or Template()
    bound_batches(formatted.sparkSession)
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done(s) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            rows = []
            for conv, segment, start, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    if state:
                        rows.append(done(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, *_ = style.parse(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    marked = style.unescape(segment[start - state[5] : end - state[5]])
                    state[3] += len(marked)
                    state[4].update(marked.encode())
                state[5] += len(segment)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(state), kinds, strict=True)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, READ)
