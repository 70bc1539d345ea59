"""Operator 5: chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its assistant
spans are intersected with the token spans by binary search: both are sorted,
so the tokens of a span are those between two searched places.

Each turn starts and ends with a control string of the template; these are added
to the tokenizer as special tokens, so a token never reaches over a mark. A
control string that occurs inside a text is escaped by one backslash after its
first character, and a text that already has backslashes there gets one more, so
taking one away restores every text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, processors

from .common import materialize, table
from .token_store import tokenizer_file

#: Characters of a rendered conversation that are encoded at once. Marks are hard token boundaries, so a longer one gives the same ids in several calls.
SEGMENT_CHARS = 4_000_000


@dataclass
class Template:
    """Marks before and after a turn of a role; a role without marks of its own is spelled out between `named`."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss_roles: tuple[str, ...] = ("assistant",)
    escape_mark: str = "\\"

    def __post_init__(self) -> None:
        self.controls = [*{m: None for pair in self.marks.values() for m in pair}, *self.named]
        esc, rests = f"(?:{re.escape(self.escape_mark)})", {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        # alternatives begin with plain characters, so that the search skips to one of these
        any_of = lambda some: re.compile("|".join(f"{re.escape(first)}{esc}{some}(?:{'|'.join(rest)})" for first, rest in rests.items()))
        self._plain, self._escaped = any_of("*"), any_of("+")
        self._opens = {pair[0]: (role, pair[1]) for role, pair in self.marks.items()}
        self._token = re.compile("|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True)))

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0][0] + self.escape_mark + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][0] + m[0][1 + len(self.escape_mark) :], text)

    def turn(self, role: str | None, text: str | None) -> tuple[str, str, str]:
        """(what stands before the text, the escaped text, what stands behind)."""
        role, text = role or "", text or ""
        if role in self.marks:
            return self.marks[role][0], self.escape(text), self.marks[role][1]
        return self.named[0] + self.escape(role) + self.named[1], self.escape(text), self.named[2]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) of a rendered conversation."""
        out, at = [], 0
        while at < len(formatted):
            mark = self._token.match(formatted, at)
            if not mark:
                raise ValueError(f"no turn begins at character {at}")
            at = mark.end()
            if mark[0] == self.named[0]:
                end = formatted.index(self.named[1], at)
                role, close, at = self.unescape(formatted[at:end]), self.named[2], end + len(self.named[1])
            else:
                role, close = self._opens[mark[0]]
            end = formatted.index(close, at)
            out.append((role, self.unescape(formatted[at:end])))
            at = end + len(close)
        return out


def chat_tokenizer(tokenizer_json: str, template: Template) -> Tokenizer:
    """The tokenizer with the template's control strings as special tokens behind its own ids, and untrimmed offsets."""
    return _chat_tokenizer(tokenizer_json, tuple(template.controls))


@functools.cache
def _chat_tokenizer(tokenizer_json: str, controls: tuple[str, ...]) -> Tokenizer:
    """One for each process, so that a worker's later tasks needn't load it again."""
    t = Tokenizer.from_str(tokenizer_json)
    t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in controls])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for tokens that share a character with a span; tokens and spans are sorted, spans don't overlap."""
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(starts, spans[:, 1], "left")
    change = np.zeros(len(starts) + 1, np.int64)
    some = (spans[:, 1] > spans[:, 0]) & (last > first)
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some], -1)
    return (np.cumsum(change[:-1]) > 0).astype(np.int8)


class _Conversation:
    """One conversation as its rows come: rendered in segments of whole turns."""

    def __init__(self, conv_id, template: Template, tokenizer: Tokenizer):
        self.conv_id, self.template, self.tokenizer = conv_id, template, tokenizer
        self.parts, self.spans, self.size, self.before = [], [], 0, 0
        self.text, self.ids, self.starts, self.ends, self.mask = [], [], [], [], []

    def add(self, role: str | None, text: str | None) -> None:
        head, body, tail = self.template.turn(role, text)
        if (role or "") in self.template.loss_roles:
            self.spans.append((self.size + len(head), self.size + len(head) + len(body)))
        self.parts += [head, body, tail]
        self.size += len(head) + len(body) + len(tail)
        if self.size >= SEGMENT_CHARS:
            self.encode()

    def encode(self) -> None:
        text = "".join(self.parts)
        e = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        self.text.append(text)
        self.ids.append(np.array(e.ids, np.int32))
        self.mask.append(loss_mask(at[:, 0], at[:, 1], np.array(self.spans, np.int64).reshape(-1, 2)))
        self.starts.append(at[:, 0] + self.before)
        self.ends.append(at[:, 1] + self.before)
        self.before += self.size
        self.parts, self.spans, self.size = [], [], 0

    def row(self) -> dict:
        self.encode()
        join = lambda x: np.concatenate(x)
        return {"conv_id": self.conv_id, "formatted": "".join(self.text), "input_ids": join(self.ids), "loss_mask": join(self.mask), "token_starts": join(self.starts), "token_ends": join(self.ends)}


_OUT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8())), ("token_starts", pa.list_(pa.int64())), ("token_ends", pa.list_(pa.int64()))])


def format_chats(spark: SparkSession, rows: DataFrame, tokenizer_path: str, template: Template | None = None) -> DataFrame:
    """(conv_id, formatted, input_ids, loss_mask, token_starts, token_ends), a row for each conversation.

    Turns go by turn, nulls first, then by role and text, so ties and repeated
    rows have one order and each row is a turn. Null role or text: empty. Rows
    with a null conv_id are one conversation of that id. Offsets count code
    points of formatted. An empty table gives an empty result. A task streams
    the sorted turns and holds one conversation at a time.
    """
    template = template or Template()
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now, done, size = chat_tokenizer(tokenizer_json, template), None, [], 0
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                        size += len(done[-1]["formatted"])
                    now = _Conversation(conv, template, tokenizer)
                    if size > SEGMENT_CHARS // 4:
                        yield pa.RecordBatch.from_pylist(done, _OUT)
                        done, size = [], 0
                now.add(role, text)
        if now is not None:
            yield pa.RecordBatch.from_pylist([*done, now.row()], _OUT)

    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, formatted string, input_ids array<int>, loss_mask array<tinyint>, token_starts array<bigint>, token_ends array<bigint>")


def masked_text(formatted: str, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, template: Template) -> str:
    """All text under the mask, unescaped span by span: runs of masked tokens, from the first one's start to the last one's end."""
    on = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return "".join(template.unescape(formatted[starts[a] : ends[b - 1]]) for a, b in on.reshape(-1, 2))


def read_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens), read back from formatted conversations."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                formatted = r.column("formatted")[0].as_py()
                mask, starts, ends = (r.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("loss_mask", "token_starts", "token_ends"))
                sha, turns = hashlib.sha256(), template.parse(formatted)
                for role, text in turns:
                    sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = masked_text(formatted, mask, starts, ends, template)
                out.append((r.column("conv_id")[0].as_py(), len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted), len(mask), int(mask.sum())))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_chats(materialize(spark, format_chats(spark, rows, tokenizer_file()), "chats"))
    return back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP5_SQL = """
with rows as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, regexp_replace(text, '([<\\[])(\\\\*)(s>|/s>|<SYS>>|</SYS>>|INST\\]|/INST\\]|ROLE\\]|/ROLE\\]|/TURN\\])', '\\1\\2\\\\\\3', 'g') as escaped from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(escaped) + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 20 + length(role) end)::bigint as formatted_chars
from sized group by conv_id
"""
