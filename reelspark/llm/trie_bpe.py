"""Operator 12: BPE encoding over a trie of distinct words, and decoding.

The distinct words of a block of texts are put into a trie. A depth-first walk finds
at each node the last token of the encoding of the node's prefix: of the tokens that
end there it is the one that stays beside the last token of the prefix before it, and
there is exactly one. So what words share at their front is encoded once, and a word's
ids are read backwards from its leaf. Two tokens stay side by side if undoing their
merges, the later first, never shows an earlier merge across the place where they meet.

A tokenizer's word end (as </w>) is part of a word's last symbol, so that a word's
last node differs from that of a longer word. Normalizer and pre-tokenizer are the
library's; only words between plain ASCII marks are told apart here.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, sized, table
from .token_store import tokenizer_file

#: Pairs of tokens whose fit is remembered before a worker starts afresh; bounds memory, never results.
PAIRS_KEPT = 1 << 20
#: Words whose ids are remembered likewise.
WORDS_KEPT = 400_000
#: Bytes of text that are encoded at once, whole texts at least, and rows at most.
TEXT_BYTES, ROWS = 12 << 20, 20_000
# Fixed value: the pattern of words for which plain ASCII has rules of its own below.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Key of what ends at a node of a trie: a token's id, or a word. Symbols are never empty.
_HERE = ""


class TrieBPE:
    """ids of texts, and texts of ids, from a tokenizers file in JSON: bytes or characters merged in words, with or without a word end.

    Words are what normalizer and pre-tokenizer leave of runs between white space,
    which must not reach over it: the pre-tokenizer has to drop white space.
    """

    def __init__(self, tokenizer_json: str):
        how = json.loads(tokenizer_json)
        model = how["model"]
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("a BPE of known symbols with plain merges is needed")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Of each merge's token: its rank, and the two tokens it is made of.
        self.rank, self.left, self.right, self.merged = {}, {}, {}, {}
        for k, (a, b) in enumerate(merges):
            made = vocab[a + b]
            if made in self.rank:
                raise ValueError(f"{a + b} is made by two merges")
            self.rank[made], self.left[made], self.right[made] = k, vocab[a], vocab[b]
            self.merged[vocab[a], vocab[b]] = k
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        usable = [(self._symbols(t), i) for t, i in vocab.items()]
        self._automaton([(x, i) for x, i in usable if (self._fit(self.left[i], self.right[i], self.rank[i]) if i in self.rank else len(x) == 1)])
        self.text_of = {i: t for t, i in vocab.items()}
        added = how.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens must be plain strings without white space")
        self.text_of |= {t["id"]: t["content"] for t in added}
        self.added = {t["content"]: t["id"] for t in added}
        self.at_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        steps = (how.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if not steps or steps[0].get("type") != "Split" or steps[0].get("behavior") != "Removed" or not steps[0].get("invert"):
            raise ValueError("a pre-tokenizer is needed that keeps words alone")
        lowers = [x.get("type") for x in (how.get("normalizer") or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
        self.plain = lowers and steps[0]["pattern"].get("Regex") == WORD_PATTERN and [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        self.joined = how.get("decoder") is None

    def _symbols(self, text: str) -> list[str]:
        """A word's or token's symbols; the word end belongs to the last character."""
        if self.suffix and text.endswith(self.suffix) and len(text) > len(self.suffix):
            body = text[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(text)

    def _automaton(self, tokens: list[tuple[list[str], int]]) -> None:
        """Tells the tokens that end at a symbol, the longest first, from the state at the symbol before."""
        self.step, self.fall, self.ends = [{}], [0], [()]
        own = {}
        for symbols, i in tokens:
            state = 0
            for s in symbols:
                below = self.step[state].get(s)
                if below is None:
                    below = self.step[state][s] = len(self.step)
                    self.step.append({})
                state = below
            own[state] = (i, len(symbols))
        self.fall, self.ends = [0] * len(self.step), [()] * len(self.step)
        level = [0]
        while level:
            below = []
            for state in level:
                for s, t in self.step[state].items():
                    if state:
                        self.fall[t] = self._next(self.fall[state], s)
                    self.ends[t] = ((own[t],) if t in own else ()) + self.ends[self.fall[t]]
                    below.append(t)
            level = below

    def _next(self, state: int, symbol: str) -> int:
        while True:
            found = self.step[state].get(symbol)
            if found is not None or not state:
                return found or 0
            state = self.fall[state]

    def _fit(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no merge earlier than limit crosses from token a to token b, if these stand side by side."""
        rank, merged = self.rank, self.merged
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            of_a, of_b = rank.get(a, -1), rank.get(b, -1)
            if of_a > of_b:
                limit, a = of_a, self.right[a]
            elif of_b < 0:
                return True
            else:
                # of two equal pairs that overlap, the left one is merged first
                limit, b = of_b + 1, self.left[b]

    def words(self, run: str) -> list[str | int]:
        """The words of a run between white space, as the model's symbols, and the ids of added tokens."""
        if self.plain and run.isascii() and run.isprintable() and not (self.at_added and "<" in run):
            low = run.lower()
            return [low] if low.isalpha() else _ASCII_WORDS.findall(low)
        out: list[str | int] = []
        for part in self.at_added.split(run) if self.at_added else [run]:
            if self.at_added and part in self.added:
                out.append(self.added[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def ids_of(self, words: set[str]) -> dict[str, list[int]]:
        """ids of distinct words, and of others that this process met lately: what is new goes through a trie."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = words.difference(self.known)
        # a trie's nodes are many small dicts without cycles, which the collector would visit again and again
        on = gc.isenabled()
        gc.disable()
        try:
            self.known.update(self.encode_words(new))
        finally:
            if on:
                gc.enable()
        return self.known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """ids of distinct words: one walk over their trie."""
        root: dict = {}
        for w in words:
            node = root
            for c in w[:-1]:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            end = w[-1] + self.suffix
            if end in node:
                node[end][_HERE] = w
            else:
                node[end] = {_HERE: w}
        if len(self.fits) > PAIRS_KEPT:
            self.fits.clear()
        fits, fall, step, ends, out = self.fits, self.fall, self.step, self.ends, {}
        # of each depth of the path: the automaton's state, the last token, and where it starts
        states, last, start = [0], [-1], [0]
        todo = [(1, s, n) for s, n in root.items()]
        while todo:
            depth, symbol, node = todo.pop()
            del states[depth:], last[depth:], start[depth:]
            while True:
                state = states[-1]
                below = step[state].get(symbol)
                while below is None and state:
                    state = fall[state]
                    below = step[state].get(symbol)
                if below is None:
                    raise ValueError(f"no token ends with {symbol}")
                for token, size in ends[below]:
                    begun = depth - size
                    if not begun:
                        break
                    pair = (last[begun], token)
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = self._fit(*pair)
                    if fit:
                        break
                states.append(below)
                last.append(token)
                start.append(begun)
                word = node.get(_HERE)
                if word is not None:
                    ids, d = [], depth
                    while d:
                        ids.append(last[d])
                        d = start[d]
                    ids.reverse()
                    out[word] = ids
                    todo += [(depth + 1, s, n) for s, n in node.items() if s]
                    break
                if len(node) > 1:
                    todo += [(depth + 1, s, n) for s, n in node.items()]
                    break
                ((symbol, node),) = node.items()
                depth += 1
        return out

    def ids_of_runs(self, runs: list[str]) -> list[list[int]]:
        parts = [self.words(r) for r in runs]
        ids = self.ids_of({w for p in parts for w in p if isinstance(w, str)})
        return [[i for w in p for i in (ids[w] if isinstance(w, str) else [w])] for p in parts]

    def encode(self, text: str | None) -> list[int]:
        codes, _, runs = split_runs(pa.array([text], pa.string()))
        ids = self.ids_of_runs(runs)
        return [i for c in codes.tolist() for i in ids[c]]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode with all special tokens: without a decoder, the tokens with a space between them; ids that no token has are left out."""
        if self.joined:
            return " ".join(self.text_of[i] for i in ids if i in self.text_of)
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)


def split_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all texts in one: which of the distinct runs between white space stands at each place, where each text's places end, and the runs. A null text has an empty one."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    found = split.flatten().dictionary_encode()
    return found.indices.to_numpy(), split.offsets.to_numpy(), found.dictionary.to_pylist()


@functools.cache
def encoder(tokenizer_json: str) -> TrieBPE:
    """One for each process."""
    return TrieBPE(tokenizer_json)


def _joined(parts: list[bytes], codes: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The parts that codes name, one after another, for each text."""
    taken = pa.array(parts, pa.large_binary()).take(pa.array(codes))
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][ends]
    raw = memoryview(taken.buffers()[2] or b"")
    return [raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]


def _map(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, columns: str, types: list[pa.DataType], work: Callable[[TrieBPE, pa.Array], list]) -> DataFrame:
    """The id, and what work makes of each block of texts."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_json)
        for b in sized(blocks(batches, ROWS), TEXT_BYTES):
            if b.num_rows:
                yield pa.record_batch([b.column(0), *[pa.array(x, t) for x, t in zip(work(bpe, b.column(1)), types)]], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ids (array<int>) of every whole text of docs.

    Null and empty texts have no ids. Rows of one id stay rows, and a null id
    stays. The id keeps its type; other columns, whatever their names, play no part.
    """

    def work(bpe: TrieBPE, texts: pa.Array) -> list:
        codes, ends, runs = split_runs(texts)
        ids = bpe.ids_of_runs(runs)
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = pa.array([i for x in ids for i in x], pa.int32())
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], sizes.cumsum()]), flat).take(pa.array(codes))
        at = lists.offsets.to_numpy()[ends]
        return [pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), lists.flatten())]

    return _map(docs, tokenizer_path or tokenizer_file("word_bpe_49k.json"), id_col, text_col, "ids array<int>", [pa.list_(pa.int32())], work)


def decoded(rows: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and text of arrays of ids; a null array gives an empty text."""
    with open(tokenizer_path or tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_json)
        for b in blocks(batches):
            yield pa.record_batch([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    own = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, and the SHA-256 of the decimal ids with a space between them and of the decoded text, as encoded and decoded give these."""

    def work(bpe: TrieBPE, texts: pa.Array) -> list:
        codes, ends, runs = split_runs(texts)
        ids = bpe.ids_of_runs(runs)
        n = np.concatenate([[0], np.array([len(x) for x in ids], np.int64)[codes].cumsum()])[ends]
        said = _joined([b"".join([b" %d" % i for i in x]) for x in ids], codes, ends)
        if bpe.joined:
            text_of = {i: b" " + t.encode() for i, t in bpe.text_of.items()}
            meant = [m[1:] for m in _joined([b"".join([text_of[i] for i in x]) for x in ids], codes, ends)]
        else:
            meant = [bpe.decode([i for c in codes[a:b].tolist() for i in ids[c]]).encode() for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return [np.diff(n), [hashlib.sha256(m[1:]).hexdigest() for m in said], [hashlib.sha256(m).hexdigest() for m in meant]]

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _map(docs, tokenizer_path or tokenizer_file("word_bpe_49k.json"), id_col, text_col, columns, [pa.int64(), pa.string(), pa.string()], work)


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
