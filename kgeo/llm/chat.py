"""Chat formatting: a state machine over roles checks the order of turns, a declarative template makes the text.

The output is a row per segment: its text and whether it counts in the loss. Joined in order, the segments are the
formatted conversation, from which ``turns_of`` reads roles and texts back."""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgeo.llm.storage import width


@dataclass(frozen=True)
class Template:
    """``marks``: what stands before and after a role's text. ``other``: the same for roles without marks, with the role's
    (escaped) name between the first two strings. ``learned``: roles whose text counts in the loss. ``follows``: the
    machine, from the role before ("" at the start) to the roles that may come next."""

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    learned: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})

    def controls(self) -> list[str]:
        return sorted({x for pair in self.marks.values() for x in pair} | set(self.other), key=lambda x: (-len(x), x))


class Formatter:
    """Escaping: a backslash is doubled; in a control string that stands in a text, a single backslash follows the first
    character. Control strings hold no backslash, so both are undone by dropping every first backslash."""

    def __init__(self, template: Template):
        self.t = template
        each = "|".join(map(re.escape, template.controls()))
        if "\\" in "".join(template.controls()):
            raise ValueError("a control string may not hold a backslash")
        self._inside = re.compile(f"(?=(?:{each}))(.)", re.S)
        ways = [f"{re.escape(a)}(?P<t{k}>(?:(?!{each}).)*){re.escape(b)}" for k, (a, b) in enumerate(template.marks.values())]
        a, b, c = map(re.escape, template.other)
        ways.append(f"{a}(?P<role>(?:(?!{each}).)*){b}(?P<t>(?:(?!{each}).)*){c}")
        self._turn = re.compile("|".join(ways), re.S)
        self.roles = [*template.marks]

    def escape(self, text: str) -> str:
        return self._inside.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        learned = role in self.t.learned
        if role in self.t.marks:
            before, after = self.t.marks[role]
            return [(before, False), (self.escape(text), learned), (after, False)]
        a, b, c = self.t.other
        return [(a + self.escape(role) + b, False), (self.escape(text), learned), (c, False)]

    def turn(self, text: str) -> tuple[str, str, int] | None:
        """Role, text and length of the complete turn that ``text`` begins with, if it does."""
        m = self._turn.match(text)
        if not m:
            return None
        if m["role"] is not None:
            return self.unescape(m["role"]), self.unescape(m["t"]), m.end()
        k = next(k for k in range(len(self.roles)) if m[f"t{k}"] is not None)
        return self.roles[k], self.unescape(m[f"t{k}"]), m.end()

    def turns_of(self, text: str) -> list[tuple[str, str]]:
        """All turns of a formatted conversation; ValueError if it isn't one."""
        out, at = [], 0
        while at < len(text):
            found = self.turn(text[at:])
            if not found:
                raise ValueError(f"no turn at {at}")
            out.append(found[:2])
            at += found[2]
        return out


SEGMENTS = "conv_id long, segment long, text string, loss boolean, problem string"


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments (SEGMENTS) of every conversation, each conversation's in order and in one partition.

    Rows are taken by turn; null turns first, equal turns by role and text, repeated rows each as a turn. Null text is
    empty, a null role is the role "". ``problem`` says, on a turn's first segment, that the machine doesn't allow that
    role there; all turns are formatted all the same. Rows with null conv_id make one conversation. Rows stream through:
    a conversation of any length needs the memory of one turn. Other columns are ignored."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now, last, no = Formatter(template), (None,), "", 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                if (conv,) != now:
                    now, last, no = (conv,), "", 0
                role, text = role or "", text or ""
                first = f"{role or 'no role'} after {last or 'start'}" if role not in template.follows.get(last, ()) else None
                for k, (s, loss) in enumerate(f.segments(role, text)):
                    out.append((conv, no, s, loss, None if k else first))
                    no += 1
                last = role
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["conv_id", "segment", "text", "loss", "problem"])

    one = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return one.repartition(width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, parsed from the segments of ``format_conversations`` in their order: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, valid (the machine allowed every turn), problem (the first one)."""
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "problem"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, state = Formatter(template), None

        def done(s: dict) -> tuple:
            if s["rest"]:
                raise ValueError(f"conversation {s['conv']} ends inside a turn")
            return s["conv"], s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["problem"] is None, s["problem"]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for conv, text, loss, problem in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if state is None or conv != state["conv"]:
                    if state:
                        out.append(done(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "rest": "", "problem": None}
                state["chars"] += len(text)
                state["rest"] += text
                state["problem"] = state["problem"] or problem
                if loss:
                    plain = f.unescape(text)
                    state["loss_n"] += len(plain)
                    state["loss"].update(plain.encode())
                if found := f.turn(state["rest"]):
                    role, said, used = found
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                    state["rest"] = state["rest"][used:]
            if out:
                yield table(out)
        if state:
            yield table([done(state)])

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, problem string")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table and one whose texts are control strings."""
    odd = spark.sql("SELECT -7L conv_id, t turn, r role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    return read_back(format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(odd)))
