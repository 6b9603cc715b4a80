"""Chat formatting with a grammar round trip.

A turn is a head for its role, its text and an end. The parser is deterministic: a control string
is a mark if an even number of backslashes stands before it, half of which are text; with an odd
number it is text itself. Each rendered turn is parsed again and compared with its source; if it
differs, conflicting content is escaped and the turn rendered anew, until it is identical.

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  [ANSWER] text </s>
    others     [ROLE] role [/ROLE] text </s>

A conversation begins with <s>. Turns are rendered and parsed in a stream of sorted rows, so a task
holds one turn at a time however long the conversation is; its digests need the turns in order, so
one conversation is one task's work.

Defined cases: a null text or role is empty; turns of equal number come by role, then text, and
repeated rows are turns of their own; a null conv_id is a conversation of its own; a null turn comes first;
an empty table gives no conversations but the planted one; a very long turn is held whole by one task; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Control strings.
HEADS = {"system": "<<SYS>>", "user": "[INST]", "assistant": "[ANSWER]"}
ENDS = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
ROLE, ROLE_END, START, END = "[ROLE]", "[/ROLE]", "<s>", "</s>"
MARKS = sorted({*HEADS.values(), *ENDS.values(), ROLE, ROLE_END, START, END}, key=lambda s: (-len(s), s))
MARK = re.compile(r"(\\*)(" + "|".join(map(re.escape, MARKS)) + ")")
ROLE_OF = {h: r for r, h in HEADS.items()}


def escape(text: str) -> str:
    """Control strings get a backslash, and backslashes before them are doubled. One at the end is
    doubled too, as a mark follows; its space is not part of the text."""
    return MARK.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def render_turn(role: str, text: str, level: int) -> str:
    """Level 0: as it is; level 1: escaped."""
    if level:
        role, text = escape(role) if role not in HEADS else role, escape(text)
    head = HEADS.get(role)
    return f"{head} {text} {ENDS[role]}" if head else f"{ROLE} {role} {ROLE_END} {text} {END}"


def unescape(text: str) -> str:
    """The text that escape() was given: half of the backslashes before a control string are its own."""
    return MARK.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def loss_span(role: str, rendered: str) -> tuple[int, int]:
    """Where in a rendered turn the text lies that counts for the loss, and how long it is: an assistant's text, else nothing."""
    if role != "assistant":
        return 0, 0
    return len(HEADS[role]) + 1, len(rendered) - len(HEADS[role]) - len(ENDS[role]) - 2


class Malformed(ValueError):
    pass


def _until(s: str, at: int, mark: str) -> tuple[str, int]:
    """The unescaped text from ``at`` to the next mark, which must be ``mark``, and the place behind it."""
    out = []
    for m in MARK.finditer(s, at):
        slashes = len(m[1])
        out += [s[at : m.start()], "\\" * (slashes // 2)]
        at = m.end()
        if slashes % 2:
            out.append(m[2])
        elif m[2] == mark:
            return "".join(out), at
        else:
            raise Malformed(f"{m[2]} where {mark} should be")
    raise Malformed(f"no {mark}")


def _padded(text: str) -> str:
    if len(text) < 2 or text[0] != " " or text[-1] != " ":
        raise Malformed("a text without its spaces")
    return text[1:-1]


def parse(s: str) -> list[tuple[str, str]]:
    """The turns of rendered text, the conversation's start mark or not."""
    at = len(START) if s.startswith(START) else 0
    turns = []
    while at < len(s):
        head = next((h for h in (*ROLE_OF, ROLE) if s.startswith(h, at)), None)
        if head is None:
            raise Malformed(f"no turn at {at}")
        at += len(head)
        if head == ROLE:
            role, at = _until(s, at, ROLE_END)
            role = _padded(role)
            text, at = _until(s, at, END)
        else:
            role = ROLE_OF[head]
            text, at = _until(s, at, ENDS[role])
        turns.append((role, _padded(text)))
    return turns


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The first rendering whose parse is the source, and its level."""
    for level in (0, 1):
        out = render_turn(role, text, level)
        try:
            if parse(out) == [(role, text)]:
                return out, level
        except Malformed:
            pass
    raise Malformed(f"no rendering of a turn of {role!r} is read back alike")


def format_conversation(turns: list[tuple[str, str]]) -> str:
    return START + "".join(format_turn(r, t)[0] for r, t in turns)


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long"


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.chars, self.escaped = conv_id, 0, 0, len(START), 0
        self.digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        out, level = format_turn(role, text)
        for r, t in parse(out if self.turns else START + out):  # digests are of what is read back
            self.digest.update(f"{r}\n{t}\n".encode())
            self.turns += 1
        start, length = loss_span(role, out)
        under = unescape(out[start : start + length]) if level else out[start : start + length]
        self.loss += len(under)
        self.loss_digest.update(under.encode())
        self.chars += len(out)
        self.escaped += level

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.digest.hexdigest(), self.loss, self.loss_digest.hexdigest(), self.chars, self.escaped


def _sorted(rows: DataFrame) -> DataFrame:
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text)."""

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(role, text)
            if done:
                yield _rows(done)
        if now is not None:
            yield _rows([now.row()])

    return _sorted(rows).mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_length of each turn: its rendering, and where in it
    the text lies that counts for the loss (length 0 for all but assistants)."""

    def run(batches):
        for batch in batches:
            out, start, length = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s, _ = format_turn(role, text)
                own = loss_span(role, s)
                out.append(s)
                start.append(own[0])
                length.append(own[1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(out), pa.array(start, pa.int64()), pa.array(length, pa.int64())], names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_length"])

    return _sorted(rows).mapInArrow(run, "conv_id long, turn long, role string, formatted string, loss_start long, loss_length long")


#: A planted conversation of nothing but control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return digests(rows.unionByName(planted))
