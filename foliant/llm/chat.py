"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Prefixes of a conversation are rendered one turn
longer each time; where the next output starts with the one before, the rest is the new turn's span,
and a template that rewrites its history is found by the turn at which it does not. Rendering the
same prefix with two probe texts in place of the last tells the span's frame from its content. Work grows with the
square of the turns. A template that its caller declares additive, one whose output is its turns' spans end to end, is rendered in
whole prefixes too for the first ``PREFIX_TURNS`` turns or ``PREFIX_CHARS`` characters, and each of their spans must be what the turn gives
alone; turns after them are rendered alone. The spans of every conversation, joined, must equal one rendering of all its turns
together, or of each part of ``WHOLE_CHARS`` in turn for a longer additive one, else an error is raised.

Texts are escaped before rendering: every ``<`` followed by backslashes and ``|`` gets one backslash
more, so no text can hold a control string, and taking one away restores it.

Null texts and roles count as empty; turns that tie are ordered by role and text; a null conv_id is a
conversation of its own. Conversations stream through sorted partitions: at most ``WHOLE_CHARS`` characters of turns and one turn
more are in memory, or the whole conversation for a template that is not additive.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Of an additive template: how far whole prefixes are rendered, and the characters of turns that are checked together.
PREFIX_TURNS, PREFIX_CHARS, WHOLE_CHARS = 32, 16_384, 1 << 24
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def chat_markup(turns: list[Turn]) -> str:
    """The library's template: a start mark, the role, the text and an end mark per turn."""
    return "".join(f"{START}{role}\n{text}{END}\n" for role, text in turns)


class HistoryRewritten(ValueError):
    """A template changed what it had rendered for earlier turns."""


def rewrites_at(template: Template, turns: list[Turn]) -> int | None:
    """The first turn at which ``template`` changes its earlier output, None if it never does."""
    before = template([])
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            return k - 1
        before = now
    return None


class Renderer:
    """Renders a conversation turn by turn: ``add`` gives the turn's span of the whole output, and
    where in it the text lies; ``close`` checks the spans against a rendering of all turns together. ``additive`` is the
    caller's word that a span depends on its own turn alone; it is checked as the module says."""

    def __init__(self, template: Template, additive: bool = False):
        self.template, self.additive, self.before = template, additive, template([])
        self.past: list[Turn] = []  # of the prefix that is rendered whole
        self.held: list[Turn] = []  # whose spans are not yet checked together
        self.chars, self.spans = 0, hashlib.sha256()
        self.first = self.whole = True
        if additive and self.before:
            raise HistoryRewritten("an additive template has no output without turns")

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        turn = (escape(role), escape(text))
        if self.additive and self.held and self.chars + len(turn[1]) > WHOLE_CHARS:
            self._check()
        if self.additive and self.whole and (len(self.past) >= PREFIX_TURNS or len(self.before) + len(turn[1]) > PREFIX_CHARS):
            self.whole, self.past = False, []
        past, before = (self.past, self.before) if self.whole else ([], "")
        now, x, y = (self.template([*past, (turn[0], t)]) for t in (turn[1], "x", "y"))
        if not all(out.startswith(before) for out in (now, x, y)):
            raise HistoryRewritten(f"output of earlier turns changed at a turn of role {role!r}")
        base = 0 if self.first else len(before)
        lead, n = len(os.path.commonprefix([x, y])) - base, len(turn[1])
        span = now[base:]
        if span != x[base : base + lead] + turn[1] + x[base + lead + 1 :]:
            raise ValueError(f"the template changes the text of a turn of role {role!r}")
        if self.additive and self.whole and past and self.template([turn]) != span:
            raise HistoryRewritten(f"the template is not additive at a turn of role {role!r}")
        self.first = False
        if self.whole:
            self.before = now
            self.past.append(turn)
        self.held.append(turn)
        self.chars += len(span)
        self.spans.update(span.encode("utf-8", "surrogatepass"))
        return span, lead, lead + n

    def _check(self) -> None:
        if self.held and hashlib.sha256(self.template(self.held).encode("utf-8", "surrogatepass")).digest() != self.spans.digest():
            raise HistoryRewritten("the turns' spans are not what all turns give together")
        self.held, self.chars, self.spans = [], 0, hashlib.sha256()

    def close(self) -> None:
        self._check()


def is_additive(template: Template) -> bool:
    return template is chat_markup


def format_turns(turns: Iterator[Turn], template: Template = chat_markup) -> Iterator[tuple[str, int, int]]:
    r = Renderer(template, is_additive(template))
    for role, text in turns:
        yield r.add(role, text)
    r.close()


def read_turn(span: str, begin: int, end: int) -> Turn:
    """Role and text of a rendered turn of ``chat_markup``."""
    head = span[:begin]
    return unescape(head[head.rindex(START) + len(START) : -1]), unescape(span[begin:end])


SPANS = "conv_id long, place long, span string, text_begin long, text_end long"
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "string": pa.string()}[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def render_conversations(conversations: DataFrame, template: Template = chat_markup, additive: bool | None = None) -> DataFrame:
    """(conv_id, place, span, text_begin, text_end): each turn's span of its conversation's output, in order,
    and where in the span the escaped text lies. ``additive``: known for ``chat_markup``, else False."""
    additive = is_additive(template) if additive is None else additive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, place, renderer = None, 0, None
        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if renderer is None or at != conv:
                    if renderer is not None:
                        renderer.close()
                    at, place, renderer = conv, 0, Renderer(template, additive)
                rows.append((conv, place, *renderer.add(role or "", text or "")))
                place += 1
            yield _record(rows, SPANS)
        if renderer is not None:
            renderer.close()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, SPANS)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digest of every conversation in ``chat_markup``, read back from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now = None

        def close() -> None:
            if now is not None:
                rows.append((now["id"], now["n"], now["turns"].hexdigest(), now["loss"], now["mask"].hexdigest(), now["chars"]))

        for b in batches:
            for conv, span, begin, end in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if now is None or now["id"] != conv:
                    close()
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "mask": hashlib.sha256(), "chars": 0}
                got_role, got_text = read_turn(span, begin, end)
                now["n"] += 1
                now["chars"] += len(span)
                now["turns"].update(f"{got_role}\n{got_text}\n".encode("utf-8", "replace"))
                if got_role == "assistant":
                    now["loss"] += len(got_text)
                    now["mask"].update(got_text.encode("utf-8", "replace"))
            yield _record(rows, SCHEMA)
        close()
        yield _record(rows, SCHEMA)

    return render_conversations(conversations).mapInArrow(run, SCHEMA)
