"""Operators 11 to 13 against brute force, the tokenizers' libraries and SQL."""

import bisect
import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelspark.llm import resample, token_align, trie_bpe
from reelspark.llm.token_store import tokenizer_file

from .helpers import SF, duck, same_rows

ODD = "日本 ́é😀‍ßİΣςǅ½²٣'’.,<>|\\ \n\t\r\x00\x1c\x85  　▁"
TEXTS = st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "</s>", "<0x41>", "the", "The", "ing", " the", "  ", "'re", "2024", "aaaa"]), st.sampled_from(list(ODD)), st.text("abcdefghijABC ", max_size=6))).map("".join)
SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


# operator 12


@pytest.fixture(scope="module")
def word_bpe():
    path = tokenizer_file("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return trie_bpe.TrieBPE(f.read()), Tokenizer.from_file(path)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_trie_gives_the_librarys_ids_and_text(word_bpe, text):
    mine, library = word_bpe
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merged_by_rank(word, merges):
    """BPE as it is defined: the pair of the smallest rank, the leftmost first, again and again."""
    parts = [*word[:-1], word[-1] + "</w>"]
    while len(parts) > 1:
        rank, at = min((merges.get((a, b), math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == math.inf:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=8), st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=30))
def test_trie_against_merging_by_rank(word_bpe, pairs, words):
    made = ["a", "b", "a</w>", "b</w>"]
    merges = {}
    for i, j in pairs:
        a, b = made[i % len(made)], made[j % len(made)]
        if not a.endswith("</w>") and a + b not in made:
            merges[a, b] = len(merges)
            made.append(a + b)
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        import json

        how = json.load(f)
    how["model"] |= {"vocab": {t: i for i, t in enumerate(made)}, "merges": [list(m) for m in merges]}
    how["added_tokens"] = []
    bpe = trie_bpe.TrieBPE(json.dumps(how))
    got = bpe.encode_words(set(words))
    assert {w: [bpe.text_of[i] for i in ids] for w, ids in got.items()} == {w: merged_by_rank(w, merges) for w in words}


def test_trie_query_against_the_library(spark, word_bpe):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = trie_bpe.op12_trie_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = word_bpe[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), SHA(" ".join(map(str, ids))), SHA(word_bpe[1].decode(ids, skip_special_tokens=False)))


def test_trie_with_odd_rows(spark, word_bpe, monkeypatch):
    rows = [(None, None, 1, "x"), (1, "", 2, None), (1, "a <|endoftext|>b", 3, "y"), (2, " \n ", 4, "z"), (3, "long" * 60_000, 5, "z"), (4, "ab " * 50_000, 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = trie_bpe.encoded(docs)
    want = [(i, word_bpe[1].encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows]
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sorted(r.text for r in trie_bpe.decoded(got).collect()) == sorted(word_bpe[1].decode(i, skip_special_tokens=False) for _, i in want)
    assert sorted(r.n_tokens for r in trie_bpe.digests(docs).collect()) == sorted(len(i) for _, i in want)
    assert trie_bpe.encoded(docs.limit(0)).collect() == [] == trie_bpe.digests(docs.limit(0)).collect()


def test_known_words_and_pairs_may_be_forgotten(word_bpe, monkeypatch):
    monkeypatch.setattr(trie_bpe, "WORDS_KEPT", 1)
    monkeypatch.setattr(trie_bpe, "PAIRS_KEPT", 1)
    for text in ("one two three", "two three four", "one", "thirteen threads"):
        assert word_bpe[0].encode(text) == word_bpe[1].encode(text, add_special_tokens=False).ids


# operator 11


@pytest.fixture(scope="module")
def two():
    a = Tokenizer.from_file(tokenizer_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def groups_of(two, text):
    """(ids of A, ids of B) of each group, from whole texts through the libraries; None where there are no tokens."""
    a, b = two
    if not text:
        return None
    alphabet = token_align.byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in cuts]
    for side, ids in enumerate((ids_a, ids_b)):
        for i, end in zip(ids, ends[side]):
            out[bisect.bisect_left(cuts, end)][side].append(i)
    return out


def aligned(two, docs):
    found = [(k, groups_of(two, t)) for k, t in docs]
    count = Counter(p for _, g in found if g for p in {(i, j) for a, b in g for i in a for j in b})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for k, g in found:
        links = [(i, j) for a, b in g or [] for i in a for j in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        sizes = [sum(len(x[side]) for x in g or []) for side in (0, 1)]
        out.append((k, *sizes, len(g or []), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), said, SHA(said) if said else ""))
    return out, {(i, j, n, n == best[i]) for (i, j), n in count.items()}


def same_alignment(spark, two, docs, df=None):
    got, pairs = token_align.align(spark, df or spark.createDataFrame(docs, "doc_id long, text string"))
    want, counts = aligned(two, docs)
    same_rows(got, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"], want)
    assert {tuple(r) for r in pairs.collect()} == counts


@settings(max_examples=12, deadline=None)
@given(st.lists(TEXTS, max_size=60))
def test_alignment_against_whole_texts(spark, two, texts):
    same_alignment(spark, two, list(enumerate(texts)))


def test_alignment_query(spark, two):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    want = [x[:7] + x[8:] for x in aligned(two, docs)[0]]
    same_rows(token_align.op11_token_align(spark, SF), ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"], want)


def test_alignment_with_odd_rows_and_small_blocks(spark, two, monkeypatch):
    rows = [(None, None, 1), (1, "", 2), (1, "</s> a▁b", 3), (1, "</s> ab", 3), (2, " \n " * 900, 4), (3, "a" * 9_000, 5), (4, "ab " * 6_000, 6), (5, "the the  the", 7), (5, "the the  the", 7)]
    monkeypatch.setattr(token_align, "ALIGN_BYTES", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string, block int")
    same_alignment(spark, two, [r[:2] for r in rows], df)
    out, pairs = token_align.align(spark, df.limit(0))
    assert out.collect() == [] == pairs.collect()


def test_alignment_by_blocks_of_one_text_is_the_same(two):
    texts = pa.array(["one two", None, "two  three", "x" * 300, "a\nb c", ""], pa.string())
    with open(tokenizer_file(), encoding="utf-8") as a, open(tokenizer_file("piece_bpe_32k.model"), "rb") as b:
        it = token_align.aligner(a.read(), b.read())
    whole = token_align._block(it, pa.array(range(6)), texts, 0, True)
    for k in range(6):
        part = token_align._block(it, pa.array([k]), texts.slice(k, 1), 0, True)
        assert [part[c][0].as_py() for c in ("n_a", "n_b", "n_groups", "n_links", "groups")] == [whole[c][k].as_py() for c in ("n_a", "n_b", "n_groups", "n_links", "groups")]


@pytest.mark.parametrize("values", [[], [1, 2, 254], [255, 3, 1_000_000, 1]])
def test_packed_numbers(values):
    import numpy as np

    assert token_align._unpacked(token_align._packed(np.array(values, np.int64)), len(values)).tolist() == values


def test_token_align_works_on_some_texts_of_a_block_at_once(monkeypatch):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    docs = pa.concat_tables([docs] * -(-(16 << 20) // docs.nbytes)).combine_chunks()
    block = max(token_align._filled(docs.to_batches()), key=lambda b: b.nbytes)
    with open(tokenizer_file(), encoding="utf-8") as a, open(tokenizer_file("piece_bpe_32k.model"), "rb") as b:
        it = token_align.aligner(a.read(), b.read())
    tracemalloc.start()
    try:
        token_align._block(it, block.column(0), block.column(1), 0, False)
        assert tracemalloc.get_traced_memory()[1] < 90 << 20
    finally:
        tracemalloc.stop()
    few = block.slice(0, 40)
    whole = token_align._block(it, few.column(0), few.column(1), 0, True)
    monkeypatch.setattr(token_align, "SLICE", 1)
    assert token_align._block(it, few.column(0), few.column(1), 0, True) == whole


# operator 13


def resampled(docs, target, share=25, least=20):
    """The contract, row by row."""

    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        return len(w), [zlib.crc32(r.encode()) % 10_000 for r in runs]

    of = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in of for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for (k, _), (n, f) in zip(docs, of):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(SHA(f"7:{'null' if k is None else k}")[:8], 16)
        rows.append([k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((i for i, r in enumerate(rows) if r[1] >= least), key=lambda i: (-rows[i][4], rows[i][0] is not None, rows[i][0]))
    rank = {i: p + 1 for p, i in enumerate(fit[: share * len(fit) // 100])}
    return [(*r, rank.get(i)) for i, r in enumerate(rows)]


COLUMNS = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_resampling_matches_sql(spark):
    columns, rows = duck(resample.OP13_SQL, ["documents", "benchmark"])
    same_rows(resample.op13_importance_resample(spark, SF), columns, rows)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text("abcABC é-1 ", max_size=80)), max_size=40), st.lists(TEXTS, max_size=5), st.integers(0, 100), st.integers(0, 4))
def test_resampling_against_brute_force(spark, texts, target, share, least):
    docs = list(enumerate(texts))
    got = resample.resample(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), share=share, least_words=least)
    same_rows(got, COLUMNS, resampled(docs, target, share, least))


def test_resampling_with_odd_rows(spark):
    rows = [(None, "a b c", 1), (2, None, 2), (3, "", 3), (4, "Ab É été" * 9_000, 4), (5, "x y z", 5), (5, "x y z", 5), (6, "x y z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    target = spark.createDataFrame([("été x y",), (None,)], "text string")
    got = resample.resample(spark, docs, target, share=60, least_words=1)
    want = resampled([r[:2] for r in rows], ["été x y", None], 60, 1)
    same_rows(got, COLUMNS, want)
    unique = docs.dropDuplicates(["doc_id"])
    drawn = resample.draw(spark, unique, target, share=60, least_words=1)
    want = [r[0] for r in resampled([tuple(r)[:2] for r in unique.collect()], ["été x y", None], 60, 1) if r[5] and r[0] is not None]
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(want)
    assert resample.resample(spark, docs.limit(0), target).collect() == []
    assert [r.weight for r in resample.resample(spark, docs.limit(0).unionByName(docs.where("doc_id = 3")), target.limit(0)).collect()] == [0]


def test_ranks_over_many_equal_scores(spark):
    scored = spark.range(1000).selectExpr("id as doc_id", "25L as n_words", "cast(id % 3 as long) * 300 as score")
    got = {r.doc_id: r.rank for r in resample.with_ranks(scored, share=50).collect()}
    order = sorted(range(1000), key=lambda i: (-(i % 3), i))
    assert got == {i: (p + 1 if p < 500 else None) for p, i in enumerate(order)}


def test_scoring_shuffles_no_features(spark):
    import numpy as np

    plan = resample.with_scores(spark.read.parquet(f"{SF}/documents.parquet"), np.zeros(10_000, np.int64))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
