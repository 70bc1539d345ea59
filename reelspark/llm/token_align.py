"""Operator 11: alignment of two tokenizers' tokens by the bytes that they own.

Tokenizer A is byte-level BPE over a space and the text, B a sentencepiece model over
the text, before which it puts a space of its own, so that both cut the same bytes.
np.repeat of token numbers over their lengths gives each byte's owner in A and in B.
Where the pair of owners changes, an overlap begins; where both owners change at once,
both have a token end, and the bytes are cut into groups. All tokens of A and of B in
a group are linked.

Neither tokenizer joins what a space parts from a word before it, so the distinct runs
between spaces of a block of texts are encoded and aligned once, and a text takes its
runs' groups in order; texts where that isn't sure are one run as a whole.

How many documents hold a pair linked is counted over the corpus: a block lists each
of its pairs once, with its documents; these lists, not documents, are shuffled to be
summed and to fetch the sums, and a block's documents then meet the block's sums.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, materialize, sized, table
from .token_store import tokenizer_file

#: Bytes of text in a block, whole texts at least, and rows at most; and bytes of distinct runs that are aligned at once.
BLOCK_BYTES, BLOCK_ROWS, ALIGN_BYTES = 8 << 20, 1 << 15, 1 << 17
#: Linked pairs of texts, repeats included, that are sorted at once, and whose texts' groups are written at once, or those of one text.
SLICE = 1 << 18
#: Ids of B in a pair's number, a * IDS_B + b; also more than any id of either tokenizer.
IDS_B = 1 << 16
_SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that are one run: a space after white space, at the start, or at the end.
_WHOLE = f"[{_SPACES}] |^ | $"


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for one in byte-level vocabularies: printable Latin-1 for itself, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class _Bytes:
    """Bytes of ids, as one buffer with starts and lengths."""

    def __init__(self, of_id: list[bytes]):
        self.length = np.array([len(x) for x in of_id], np.int32)
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length
        self.data = np.frombuffer(b"".join(of_id), np.uint8)

    def joined(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another; owner is the place in ids of each byte."""
        size = self.length[ids].astype(np.int64)
        return self.data[(self.start[ids] - (np.cumsum(size) - size))[owner] + np.arange(len(owner))]


class Aligned:
    """Distinct runs: which agree with their text, their sizes in tokens, groups and links, their groups as text, and their linked pairs with how often each is linked."""

    def __init__(self, fine: np.ndarray, sizes: np.ndarray, said: pa.Array, pair_ends: np.ndarray, pairs: np.ndarray, times: np.ndarray):
        self.fine, self.sizes, self.said, self.pair_ends, self.pairs, self.times = fine, sizes, said, pair_ends, pairs, times


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    def __init__(self, json_a: str, model_b: bytes):
        self.a = Tokenizer.from_str(json_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(n_a, n_b) > IDS_B:
            raise ValueError(f"ids must be below {IDS_B}")
        alphabet = byte_alphabet()
        self.bytes_a = _Bytes([bytes(alphabet.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(n_a)])
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = _Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        how = json.loads(json_a)
        split = how.get("pre_tokenizer") or {}
        plain_a = not how.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.by_run = plain_a and not any("▁" in p.lstrip("▁") for p in pieces)
        #: What is said of an id: of A within and at the end of a group, then of B.
        self.words = pa.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b",", b";") for i in range(IDS_B)], pa.large_binary())

    def ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids and number of ids of each run, of A and of B; runs come without the space before them."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)]
        b = self.b.encode(runs, num_threads=1)
        out = []
        for x in (a, b):
            counts = np.fromiter(map(len, x), np.int64, len(x))
            out += [np.fromiter(itertools.chain.from_iterable(x), np.int32, int(counts.sum())), counts]
        return tuple(out)

    def align(self, runs: list[str]) -> Aligned:
        """All runs, some ALIGN_BYTES at a time, or one longer run."""
        sizes = np.fromiter((len(r) for r in runs), np.int64, len(runs))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // ALIGN_BYTES)) + 1
        parts = [self._align(runs[i:j]) for i, j in itertools.pairwise([0, *cuts.tolist(), len(runs)])]
        pair_ends = _ends(np.concatenate([np.diff(p.pair_ends) for p in parts]))
        join = lambda name: np.concatenate([getattr(p, name) for p in parts])
        return Aligned(join("fine"), join("sizes"), pa.concat_arrays([p.said for p in parts]), pair_ends, join("pairs"), join("times"))

    def _align(self, runs: list[str]) -> Aligned:
        ids_a, n_a, ids_b, n_b = self.ids(runs)
        text = [b" " + r.encode() for r in runs]
        size = np.fromiter(map(len, text), np.int64, len(text))
        run_a, run_b = np.repeat(np.arange(len(runs)), n_a), np.repeat(np.arange(len(runs)), n_b)
        long_a, long_b = self.bytes_a.length[ids_a], self.bytes_b.length[ids_b]
        # runs whose tokens have another number of bytes can't agree; the rest is compared byte by byte
        fine = (np.bincount(run_a, long_a, len(runs)) == size) & (np.bincount(run_b, long_b, len(runs)) == size)
        for again in (True, False):
            if not fine.all():
                keep_a, keep_b = fine[run_a], fine[run_b]
                ids_a, run_a, long_a, ids_b, run_b, long_b = ids_a[keep_a], run_a[keep_a], long_a[keep_a], ids_b[keep_b], run_b[keep_b], long_b[keep_b]
            owner_a, owner_b = np.repeat(np.arange(len(ids_a), dtype=np.int32), long_a), np.repeat(np.arange(len(ids_b), dtype=np.int32), long_b)
            if again:
                said = np.frombuffer(b"".join(itertools.compress(text, fine.tolist())), np.uint8)
                wrong = (self.bytes_a.joined(ids_a, owner_a) != said) | (self.bytes_b.joined(ids_b, owner_b) != said)
                if not wrong.any():
                    break
                fine[run_a[owner_a[wrong]]] = False
        return self._groups(len(runs), fine, ids_a, run_a, owner_a, ids_b, run_b, owner_b)

    def _groups(self, n: int, fine: np.ndarray, ids_a: np.ndarray, run_a: np.ndarray, owner_a: np.ndarray, ids_b: np.ndarray, run_b: np.ndarray, owner_b: np.ndarray) -> Aligned:
        new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
        # where either owner changes, an overlap begins, and where both do, a group; tokens end with runs, so that no group holds two
        overlap = np.flatnonzero(new_a | new_b)
        group = np.cumsum((new_a & new_b)[overlap], dtype=np.int64) - 1
        group_a, group_b = group[new_a[overlap]], group[new_b[overlap]]
        n_groups = int(group[-1]) + 1 if len(group) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        run_of = np.zeros(n_groups, np.int64)
        run_of[group_a] = run_a
        per_run = lambda of, values=None: np.bincount(of, values, n).astype(np.int64)
        sizes = np.stack([per_run(run_a), per_run(run_b), per_run(run_of), per_run(run_of, in_a * in_b)], 1)
        # the groups as text: tokens in order of group, side and place
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        codes = np.concatenate([ids_a + IDS_B * last_a, ids_b + IDS_B * (2 + last_b)])[order]
        taken = self.words.take(pa.array(codes))
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
        said = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at[_ends(sizes[:, 0] + sizes[:, 1])]), taken.buffers()[2] or pa.py_buffer(b"")])
        # pairs: each distinct id of A in a group with each of B, so that a long group of few ids has few
        a, times_a = np.unique(group_a * IDS_B + ids_a, return_counts=True)
        b, times_b = np.unique(group_b * IDS_B + ids_b, return_counts=True)
        first_b = _ends(np.bincount(b // IDS_B, minlength=n_groups))
        of = a // IDS_B
        many = np.diff(first_b)[of]
        left, right = np.repeat(np.arange(len(a)), many), _spread(first_b[of], many)
        pairs, times = (a[left] % IDS_B) * IDS_B + b[right] % IDS_B, times_a[left] * times_b[right]
        return Aligned(fine, sizes, said, _ends(np.bincount(run_of[of[left]], minlength=n)), pairs, times)


@functools.cache
def aligner(json_a: str, model_b: bytes) -> Aligner:
    return Aligner(json_a, model_b)


def _runs(texts: pa.Array, by_run: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Run codes of all texts in one, where each text's codes end, and the distinct runs; null and empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    whole = pc.match_substring_regex(texts, _WHOLE) if by_run else pa.array([True] * len(texts), pa.bool_())
    split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    flat, ends = split.flatten(), split.offsets.to_numpy()
    # a whole text stands at the place that its empty stand-in has
    at = np.full(len(flat), -1, np.int64)
    rows = np.flatnonzero(whole)
    at[ends[rows]] = np.arange(len(rows))
    kept = pc.if_else(pa.array(at >= 0), pc.take(texts, pa.array(rows[at] if len(rows) else np.zeros(len(at), np.int64), mask=at < 0)), flat)
    empty = np.asarray(pc.equal(pc.binary_length(kept), 0))
    found = kept.filter(pa.array(~empty)).dictionary_encode()
    return found.indices.to_numpy(), _ends(~empty)[ends], found.dictionary


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 1 on, a byte each; 255 stands for one of those that follow in full."""
    big = values >= 255
    return np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype(np.int64).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, offset=n)
    return out


#: A row for each document, with the places of its pairs in its block's list and how often each is linked; and a row for each block with that list and the documents of each pair.
_PART = "block long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, places binary, times binary, pairs array<long>, docs array<int>"


def _block(aligner_: Aligner, ids: pa.Array, texts: pa.Array, number: int, with_groups: bool) -> dict[str, pa.Array]:
    """Columns of _PART for a block."""
    codes, ends, names = _runs(texts, aligner_.by_run)
    n, runs = len(texts), aligner_.align(names.to_pylist())
    doc = np.repeat(np.arange(n), np.diff(ends))
    bad = np.zeros(n, bool)
    bad[doc[~runs.fine[codes]]] = True
    kept = ~bad[doc]
    sizes = np.stack([np.bincount(doc[kept], runs.sizes[codes[kept], k], n) for k in range(4)], 1).astype(np.int64)
    # pairs of runs by their place in the block's list of distinct pairs, then of documents, some documents at a time
    listed, place = np.unique(runs.pairs, return_inverse=True)
    place, held = place.astype(np.int32), np.zeros(len(listed), np.int64)
    placed, counts, times, said, digests = [], [], [], [], []
    for i, j in _slices(np.bincount(doc, np.diff(runs.pair_ends)[codes], n)):
        at = slice(ends[i], ends[j])
        for raw, w in zip(_groups_of(runs, codes[at], ends[i : j + 1] - ends[i]), bad[i:j].tolist(), strict=True):
            m = b"" if w else raw
            digests.append(hashlib.sha256(m).hexdigest() if len(m) else "")
            if with_groups:
                said.append(str(m, "ascii"))
        of, places, linked = _pairs_of(runs, place, codes[at][kept[at]], doc[at][kept[at]] - i)
        cuts = _ends(np.bincount(of, minlength=j - i))
        held += np.bincount(places, minlength=len(listed))
        placed.append(places)
        counts.append(np.diff(cuts))
        times += [_packed(linked[a:b]) for a, b in itertools.pairwise(cuts.tolist())]
    places, cuts = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (placed, counts))
    cuts = _ends(cuts).tolist()
    del placed, doc, kept
    one = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(1, kind)])
    lists = lambda values, kind: pa.concat_arrays([pa.nulls(n, pa.list_(kind)), pa.array([values], pa.list_(kind))])
    seen = held > 0
    # only pairs of documents that agree are listed; places follow
    shorter = np.cumsum(seen) - 1
    places = shorter[places].astype(np.uint32)
    return {
        "block": pa.array(np.full(n + 1, number, np.int64)),
        "id": pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
        **{name: one(sizes[:, k], pa.int64()) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups": one(said, pa.string()) if with_groups else pa.nulls(n + 1, pa.string()),
        "groups_sha256": one(digests, pa.string()),
        "places": one([places[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary()),
        "times": one(times, pa.binary()),
        "pairs": lists(listed[seen], pa.int64()),
        "docs": lists(held[seen], pa.int32()),
    }


def _groups_of(runs: Aligned, codes: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
    """The groups of texts that have these runs, without the last mark; ends tells where each text's runs end."""
    taken = runs.said.take(pa.array(codes))
    at = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist() if len(codes) else [0] * len(ends)
    raw = memoryview(taken.buffers()[2] or b"")
    for a, b in itertools.pairwise(at):
        yield raw[a : b - 1] if b > a else raw[:0]


def _slices(weights: np.ndarray) -> list[tuple[int, int]]:
    """Successive ranges of about SLICE in weight, or of one place."""
    cuts = np.flatnonzero(np.diff(np.cumsum(weights) // SLICE)) + 1
    return list(itertools.pairwise([0, *cuts.tolist(), len(weights)])) if len(weights) else []


def _pairs_of(runs: Aligned, place: np.ndarray, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of texts: the text, the pair's place, and how often it is linked, from which runs stand in which text."""
    has = np.diff(runs.pair_ends)[codes]
    from_run = _spread(runs.pair_ends[codes], has)
    n = int(place.max()) + 1 if len(place) else 1
    keys = np.repeat(doc.astype(np.int64) * n, has) + place[from_run]
    order = np.argsort(keys)
    keys, times = keys[order], runs.times[from_run[order]]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    of, places = np.divmod(keys[first], n)
    return of.astype(np.int32), places.astype(np.int32), np.add.reduceat(times, first) if len(first) else times


def _blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    with open(path_a, encoding="utf-8") as f:
        json_a = f.read()
    with open(path_b, "rb") as f:
        model_b = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, task = aligner(json_a, model_b), TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for b in _filled(batches):
            out = _block(it, b.column(0), b.column(1), number, with_groups)
            number += 1
            yield pa.record_batch(list(out.values()), list(out))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PART.format(id=rows.schema["id"].dataType.simpleString()))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BLOCK_BYTES of text: small ones are put together, large ones split."""
    held, size = [], 0
    for b in sized(blocks(batches, BLOCK_ROWS), BLOCK_BYTES):
        if not b.num_rows:
            continue
        more = pc.sum(pc.binary_length(b.column(1))).as_py() or 0
        if held and (size + more > BLOCK_BYTES or sum(x.num_rows for x in held) + b.num_rows > BLOCK_ROWS):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, n, best) of all linked pairs: in how many documents it is, and whether no pair of its id of A is in more."""
    lists = parts.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = lists.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    of_a = F.shiftright("pair", IDS_B.bit_length() - 1)
    # an id of A has at most IDS_B pairs, however large the corpus is
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(of_a)))


def align(spark: SparkSession, docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Alignment of each row of docs, and the corpus' linked pairs (a, b, n, best).

    The first has the id, n_a and n_b (tokens), n_groups, n_links (linked pairs of
    tokens), n_best (links whose pair no other of its id of A is in more documents),
    count_sum (documents of each link's pair, summed), groups ('a1,a2|b1;a3|b2,b3',
    null unless with_groups) and groups_sha256. Null and empty texts, and those whose
    bytes in A or B differ from a space and the text, have no tokens: zeros and ''.
    Rows of one id are documents of their own; the id keeps its type, null stays.
    An empty table gives empty results. Other columns play no part.
    """
    parts = materialize(spark, _blocks(docs, path_a or tokenizer_file(), path_b or tokenizer_file("piece_bpe_32k.model"), id_col, text_col, with_groups), "aligned")
    counts = materialize(spark, pair_counts(parts), "pair-counts")
    asked = parts.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(counts, "pair").select(F.col("block").alias("asker"), "place", "n", "best")
    texts = parts.where(F.col("pairs").isNull()).drop("pairs", "docs")
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"

    def meet(docs_: pa.Table, sums: pa.Table) -> pa.Table:
        order = sums.column("place").to_numpy()
        n, best = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        n[order], best[order] = sums.column("n").to_numpy(), sums.column("best").to_numpy()
        total, top = [], []
        for places, times in zip(docs_.column("places").to_pylist(), docs_.column("times").to_pylist()):
            at = np.frombuffer(places, np.uint32)
            t = _unpacked(times, len(at))
            total.append(int((n[at] * t).sum()))
            top.append(int(t[best[at]].sum()))
        kept = {c: docs_.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(kept | {"n_best": pa.array(top, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups": docs_.column("groups"), "groups_sha256": docs_.column("groups_sha256")})

    # a block's documents and its list of sums: both bounded by BLOCK_BYTES, or by one text
    out = texts.groupBy("block").cogroup(found.groupBy("asker")).applyInArrow(meet, schema)
    a_b = counts.select(F.shiftright("pair", IDS_B.bit_length() - 1).alias("a"), F.col("pair").bitwiseAND(IDS_B - 1).alias("b"), "n", "best")
    return out.withColumnRenamed("id", id_col), a_b


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = align(spark, table(spark, sf_dir, "documents"), with_groups=False)
    return out.drop("groups")
