"""Chat formatting with a grammar round trip.

A conversation is rendered as marked turns, ``<|im_start|>role\\ntext<|im_end|>\\n``. A deterministic parser
reads the rendering back; where a recovered turn differs from its source, the conflicting content is escaped
and the turn rendered again, until the parser returns the source. The parser always undoes escapes, so no flag
has to travel with the text:

* in a text, ``<|im_start|>`` and ``<|im_end|>`` written with k backslashes after ``<|`` get one more, and the
  parser takes one away; only the form without a backslash is a control string;
* in a role, a backslash, a line break and ``<`` become ``\\\\``, ``\\n`` and ``\\l``.

Texts without such content are rendered unchanged.

Nulls count as empty roles and texts; a null ``conv_id`` is a conversation of its own; rows with equal turns
are ordered by role and text; repeated rows are repeated turns; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import arrow_map

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")
ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
ROLE_CODES = {"\\": "\\", "n": "\n", "l": "<"}
MAX_ESCAPES = 4


class GrammarError(ValueError):
    """The rendered text is no sequence of turns."""


def escape_text(text: str) -> str:
    return CONTROL.sub(r"<|\\\1\2|>", text)


def unescape_text(text: str) -> str:
    return ESCAPED.sub(r"<|\1\2|>", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n<]", lambda m: ROLE_ESCAPES[m.group()], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\nl])", lambda m: ROLE_CODES[m.group(1)], role)


def render_turn(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text: (role, text, first and last-plus-one position of the escaped text).

    The grammar: turns = (START role LF text END LF)*, where a role holds neither LF nor START, and a text
    neither START nor END. Anything else raises ``GrammarError``.
    """
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise GrammarError(f"no turn begins at {at}")
        body = rendered.find("\n", at)
        if body < 0:
            raise GrammarError(f"the role at {at} has no end")
        role = rendered[at + len(START) : body]
        end = rendered.find(END, body + 1)
        if end < 0 or START in role or END in role or rendered.find(START, body + 1, end) >= 0:
            raise GrammarError(f"the turn at {at} isn't closed")
        if not rendered.startswith("\n", end + len(END)):
            raise GrammarError(f"no line break after the turn at {at}")
        turns.append((unescape_role(role), unescape_text(rendered[body + 1 : end]), body + 1, end))
        at = end + len(END) + 1
    return turns


def format_turn(role: str, text: str) -> str:
    """The rendering of one turn that parses back to it."""
    shown_role, shown_text = role, text
    for _ in range(MAX_ESCAPES):
        rendered = render_turn(shown_role, shown_text)
        try:
            turns = parse(rendered)
        except GrammarError:
            turns = []
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered
        if not turns or len(turns) > 1 or turns[0][0] != role:
            shown_role = escape_role(role)
        if not turns or len(turns) > 1 or turns[0][1] != text:
            shown_text = escape_text(text)
    raise GrammarError(f"a turn of {len(text)} characters can't be rendered")


def format_conversation(turns: list[tuple[str, str]], learned: str = "assistant"):
    """Rendered text and the spans, in code points, under the loss mask (the texts of ``learned`` turns)."""
    rendered = "".join(format_turn(role, text) for role, text in turns)
    found = parse(rendered)
    if [t[:2] for t in found] != turns:
        raise GrammarError("the conversation doesn't parse back to its turns")
    spans = [(start, end) for role, _, start, end in found if role == learned]
    return rendered, spans


def conversations(df: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per conversation with its ordered turns, grouped with map-side combine.

    A conversation is the unit of output and is read by one model; it is the only thing held together.
    """
    item = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    ordered = F.array_sort(F.collect_list(item))
    return df.groupBy(F.col(conv_id).alias("conv_id")).agg(ordered.alias("turns"))


def format_chats(df: DataFrame, learned: str = "assistant", **columns: str) -> DataFrame:
    """(conv_id, formatted, loss_starts, loss_ends): the rendered conversation and its loss mask."""
    grouped = conversations(df, **columns)
    kind = grouped.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            done = [
                format_conversation([(t["role"], t["text"]) for t in turns], learned)
                for turns in batch.column(1).to_pylist()
            ]
            yield [
                batch.column(0),
                pa.array([d[0] for d in done], pa.string()),
                pa.array([[s for s, _ in d[1]] for d in done], pa.list_(pa.int64())),
                pa.array([[e for _, e in d[1]] for d in done], pa.list_(pa.int64())),
            ]

    return arrow_map(
        grouped, run, f"conv_id {kind}, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader finds in rendered conversations: turns by the parser, learned text by the loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = parse(row["formatted"])
                spans = zip(row["loss_starts"], row["loss_ends"], strict=True)
                learned = "".join(unescape_text(row["formatted"][s:e]) for s, e in spans)
                out.append((
                    len(turns),
                    digest("".join(f"{role}\n{text}\n" for role, text, *_ in turns)),
                    len(learned),
                    digest(learned),
                    len(row["formatted"]),
                ))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]

    rows = formatted.select("conv_id", "formatted", "loss_starts", "loss_ends")
    return arrow_map(
        rows,
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )
