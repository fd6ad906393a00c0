"""Chat formatting: records of any layout become canonical turns, and turns become escaped, masked text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested paths of a JSON value's leaves; ``[]`` stands for any element of an array."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


#: Names of fields that say something about a record or a turn but aren't said in it: they don't belong to a layout.
IGNORED = frozenset(("id", "uuid", "name", "source", "lang", "language", "model", "created", "timestamp", "date", "index", "score", "weight", "category", "topic", "tags", "split", "license", "meta", "metadata", "tool_call_id"))


def layout_paths(paths: set[str], texts: frozenset[str], calls: frozenset[str] = frozenset(), ignored: frozenset[str] = IGNORED) -> set[str]:
    """The paths that tell a layout: without ignored fields of the record or of a turn and what is below them, and with
    a text that comes as a list of strings or of parts with a ``type`` as one text, and a call as one value.

    ``texts``: paths where mappings expect texts; ``calls``: paths of calls.  A field inside a part or a call is never
    ignored, whatever its name.
    """
    out = set()
    for p in paths:
        call = next((c for c in calls if p == c or p.startswith((f"{c}[", f"{c}.", f"{c}{{"))), None)
        parts = next((t for t in texts if p == f"{t}[]" or (p.startswith(f"{t}[].") and (f"{t}[].type" in paths or p == f"{t}[].text"))), None)
        names = [n.replace("[]", "").replace("{}", "") for n in p.split(".")]
        beside = names[: 2 if p.partition(".")[0].endswith("[]") else 1]
        if call or parts or p in texts or not any(n in ignored for n in beside):
            out.add(call or parts or p)
    return out


def fingerprint(paths: set[str]) -> str:
    """Hash of the sorted paths: equal for records of one layout, whatever the order of their fields."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How records with these paths become turns.

    ``each``: the arrays whose elements are turns, one array after the other, with ``role`` and ``text`` their fields,
    and ``calls`` fields that may be there too: they are added to the text as JSON.  A text at ``lead`` is a system turn
    before them, one at ``tail`` an assistant turn after them.  Without ``each``, ``parts`` lists (role, paths) pairs:
    each gives a turn with the texts of the paths, blank ones left out, joined by an empty line; a pair without any such
    text gives none, but for the role ``assistant``.  ``role`` and ``text`` without ``each``: the record is one turn.
    ``optional`` paths may be absent.
    """

    name: str
    each: tuple[str, ...] = ()
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    lead: str | None = None
    tail: str | None = None
    calls: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=lambda: {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}, hash=False)

    def call_paths(self) -> set[str]:
        return {f"{e}[].{c}" for e in self.each for c in self.calls}

    def paths(self) -> set[str]:
        """Of texts and roles."""
        if self.each:
            return {f"{e}[].{f}" for e in self.each for f in (self.role, self.text)} | {p for p in (self.lead, self.tail) if p}
        return {self.role, self.text} if self.role else {p for _, ps in self.parts for p in ps}

    def fingerprints(self) -> Iterator[str]:
        """Of the full layout, of those without some of the optional paths, and of those whose only array is empty."""
        out = [set()]
        for p in [*self.optional, *([self.lead] if self.lead else []), *sorted(self.call_paths())]:
            out += [o | {p} for o in out]
        full = self.paths() | self.call_paths()
        yield from (fingerprint(full - o) for o in out)
        if len(self.each) == 1:
            ends = {p for p in (self.lead, self.tail) if p} | {f"{self.each[0]}[]"}
            yield from (fingerprint(ends - o) for o in ([set(), {self.lead}] if self.lead else [set()]))

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.each:
            lead = _text(_at(record, self.lead)) if self.lead else ""
            out = [("system", lead)] if lead.strip() else []
            out += [(self._role(_at(t, self.role)), self._said(t)) for e in self.each for t in _at(record, e) or []]
            return out + ([("assistant", _text(_at(record, self.tail)))] if self.tail else [])
        if self.role:
            return [(self._role(_at(record, self.role)), _text(_at(record, self.text)))]
        said = [(role, [x for p in ps if (x := _text(_at(record, p))).strip()]) for role, ps in self.parts]
        return [(role, "\n\n".join(texts)) for role, texts in said if texts or role == "assistant"]

    def _said(self, turn: dict) -> str:
        text, calls = _text(_at(turn, self.text)), [c for name in self.calls if (c := _at(turn, name))]
        return "\n\n".join([*([text] if text or not calls else []), *(_json(c) for c in calls)])

    def _role(self, role: object) -> str:
        return self.roles.get(role := _text(role), role)


def _at(record: object, path: str) -> object:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def _text(value: object) -> str:
    """A list of strings and parts is their texts, one after the other; a part that says more than its text is JSON."""
    if isinstance(value, list) and all(isinstance(x, str) or (isinstance(x, dict) and ("type" in x or "text" in x)) for x in value):
        return "".join(x if isinstance(x, str) else x["text"] if isinstance(x.get("text"), str) and x.keys() <= {"type", "text"} else _json(x) for x in value)
    return "" if value is None else value if isinstance(value, str) else _json(value)


CALLS = ("tool_calls", "function_call")
MAPPINGS = (
    Mapping("turn row", role="role", text="text", roles={}),
    Mapping("messages", each=("messages",), role="role", text="content", lead="system", calls=CALLS),
    Mapping("sharegpt", each=("conversations",), role="from", text="value", lead="system"),
    Mapping("prompt messages", each=("prompt", "completion"), role="role", text="content"),
    Mapping("prompt messages, response", each=("prompt",), role="role", text="content", tail="response"),
    Mapping("prompt messages, completion", each=("prompt",), role="role", text="content", tail="completion"),
    Mapping("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("prompt", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", parts=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)

TURNS = "layout string, fingerprint string, step int, role string, text string"


def canonical_turns(records: DataFrame, key: str, record: str, mappings: tuple[Mapping, ...] = MAPPINGS, ignored: frozenset[str] = IGNORED) -> DataFrame:
    """A row per turn: key, layout, fingerprint, step within the record (from 0), role and text.

    ``record`` holds JSON objects.  Their nested field paths, but for ``ignored`` fields, are hashed; the hash selects a
    mapping.  A record whose fingerprint no mapping has keeps one row with a null layout, role and text (an unparsable
    or null record also a null fingerprint), and a mapped record without turns one with a null role and text, so that
    nothing goes unseen; ``layouts`` counts them.  Rows that are turns are those with a role.  A null text is empty, a
    text in parts is joined, parts that are no text and tool calls are JSON in their places; repeated rows all stay; an
    empty table gives none.  Only the two columns are read, so other columns may have any name.
    """
    by = {f: m for m in mappings for f in m.fingerprints()}
    texts = frozenset(p for m in mappings for p in m.paths())
    calls = frozenset(p for m in mappings for p in m.call_paths())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, raw in zip(frame["key"], frame["record"], strict=True):
                try:
                    value = json.loads(raw)
                except (TypeError, ValueError):
                    value = None
                print_ = None if value is None else fingerprint(layout_paths(field_paths(value), texts, calls, ignored))
                m = by.get(print_)
                turns = (m.turns(value) if m else []) or [(None, None)]
                out += [(k, m.name if m else None, print_, i, *t) for i, t in enumerate(turns)]
            yield pd.DataFrame(out, columns=["key", "layout", "fingerprint", "step", "role", "text"])

    kind = records.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string(TURNS).fields])
    return records.select(F.col(key).alias("key"), F.col(record).alias("record")).mapInPandas(run, schema).withColumnRenamed("key", key)


def layouts(turns: DataFrame) -> DataFrame:
    """(layout, fingerprint, records): how often each layout was met; a null layout is one without a mapping."""
    return turns.where("step = 0").groupBy("layout", "fingerprint").agg(F.count(F.lit(1)).alias("records"))


@dataclass(frozen=True)
class Template:
    """Text around a turn; ``{role}`` is the role.  ``controls`` must not occur unescaped inside texts."""

    open: str
    close: str
    controls: tuple[str, ...]

    def escape(self, text: Column) -> Column:
        """A backslash after the first character of each control string; backslashes are doubled."""
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in sorted(self.controls, key=len, reverse=True):
            out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
        return out

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """Turns of a formatted conversation, unescaped."""
        head, tail = map(re.escape, self.open.split("{role}"))
        turn = re.compile(f"{head}(.*?){tail}(.*?){re.escape(self.close)}", re.DOTALL)
        return [(self.unescape(m[1]), self.unescape(m[2])) for m in turn.finditer(formatted)]


#: Also escapes the marks of another common template, so that texts may pass through it later.
CHATML = Template("<|im_start|>{role}<|im_sep|>", "<|im_end|>", ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def format_turns(turns: DataFrame, key: str, order: list[str], template: Template = CHATML, trained: str = "assistant") -> DataFrame:
    """A row per conversation: key, ``formatted``, and ``loss_spans``, the (start, end) code points of the texts of the
    ``trained`` role inside it, in order.

    Turns come in the order of the columns ``order``; ties by role, then text, nulls first; repeated rows all stay.  A
    null role or text is empty.  An empty table gives none.  A conversation is one value, gathered with one shuffle.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head, tail = template.open.split("{role}")
    opened = F.concat(F.lit(head), template.escape(role), F.lit(tail))
    body = template.escape(text)
    turn = F.struct(*order, role.alias("role"), text.alias("_text"), opened.alias("opened"), body.alias("body"))
    told = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    close = F.lit(len(template.close))
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array(span).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["opened"])
        end = begin + F.length(t["body"])
        own = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        spans = F.when(t["role"] == trained, F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"])
        return F.struct((end + close).cast("long").alias("at"), spans.alias("spans"))

    return told.select(
        key,
        F.array_join(F.transform("turns", lambda t: F.concat(t["opened"], t["body"], F.lit(template.close))), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda acc: F.slice(acc["spans"], 2, F.greatest(F.lit(1), F.size(acc["spans"]) - 1))).alias("loss_spans"),
    )


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, key: str, template: Template = CHATML) -> DataFrame:
    """What the formatted text itself says: turns and texts under the loss mask, unescaped, as digests.

    A null ``formatted`` has no turns; empty and very long texts, repeated rows and an empty table are read like others;
    other columns aren't read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, text, spans in zip(frame["key"], frame["formatted"], frame["loss_spans"], strict=True):
                text = text or ""
                turns = template.read(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(template.unescape(text[s["start"] : s["end"]]) for s in (() if spans is None else spans))
                out.append((k, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = T.StructType([T.StructField("key", formatted.schema[key].dataType), *T._parse_datatype_string(READ).fields])
    return formatted.select(F.col(key).alias("key"), "formatted", "loss_spans").mapInPandas(run, schema).withColumnRenamed("key", key)
