import hashlib
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelspark.llm.chat import OP5_SQL, Template, format_chats, loss_mask, op5_chat_format, read_chats
from reelspark.llm.token_store import PerfectHash, Store, encoder, key_hash, lookup, op8_token_store, read_tokens, tokenizer_file, write_tokens

from .helpers import SF, duck, same_rows

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\\\/INST]", "[ROLE]", "[/TURN]", " ok ", "é", "<<SYS>>", "\n"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[/ROLE]", ""]), PIECES), max_size=5))
def test_rendering_parses_back(turns):
    t = Template()
    assert t.parse("".join("".join(t.turn(r, x)) for r, x in turns)) == turns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=5))
def test_loss_mask_against_every_pair(sizes, gaps):
    ends = np.cumsum(sizes).astype(np.int64)
    starts = ends - np.array(sizes, np.int64)
    spans, at = [], 0
    for gap, size in gaps:
        spans.append((at + gap, at + gap + size))
        at += gap + size
    want = [int(any(a < e and s < b and a < b for a, b in spans)) for s, e in zip(starts, ends)]
    assert loss_mask(starts, ends, np.array(spans, np.int64).reshape(-1, 2)).tolist() == want


def test_chats_match_sql(spark):
    columns, rows = duck(OP5_SQL, ["conversations"])
    same_rows(op5_chat_format(spark, SF), columns, rows)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b"), (1, 1, "assistant", "a</s>b"), (2, None, None, None), (2, 0, "assistant", None), (3, 0, "tool", "x" * 50_000), (3, 1, "assistant", "<\\s> é🙂" * 9000), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in read_chats(format_chats(spark, df, tokenizer_file())).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        row = got.pop(conv)
        assert row.n_turns == len(mine) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert not got
    assert format_chats(spark, df.limit(0), tokenizer_file()).collect() == []


def plain_store(docs):
    t, out, at = Tokenizer.from_file(tokenizer_file()), [], 0
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_store_against_the_plain_tokenizer(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = op8_token_store(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == plain_store(docs)
    # the index finds each document where the scan met it
    first = {}
    for r in got.orderBy("start").collect():
        first.setdefault(r.shard, r.start)
        assert r.index_start == r.start - first[r.shard]


def test_odd_documents_and_lookups(spark):
    docs = [(None, "n"), (-5, "neg"), (1, None), (2, ""), (3, "same"), (3, "same"), (3, "zebra"), (4, "日本語 \x1c\x00 it's 12,5  \n\n x" * 50), (9, "long words " * 30_000)]
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, key string")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    write_tokens(spark, df, folder + "/a", tokenizer_file())
    rows = [tuple(r) for r in read_tokens(spark, folder + "/a").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(rows, key=lambda r: r[1]) == plain_store(docs)
    t = Tokenizer.from_file(tokenizer_file())
    assert lookup(spark, folder + "/a", 3, 2).tolist() == [*t.encode("zebra").ids, 0]
    assert lookup(spark, folder + "/a", 1).tolist() == [0]
    assert lookup(spark, folder + "/a", 7) is None and lookup(spark, folder + "/a", 3, 9) is None
    write_tokens(spark, df.limit(0), folder + "/b", tokenizer_file())
    assert read_tokens(spark, folder + "/b").collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z9é'stll \n\t.,-\x1f\x0b日ǅßÿ_"), max_size=60)))
def test_runs_encode_like_whole_texts(texts):
    with open(tokenizer_file(), encoding="utf-8") as f:
        e = encoder(f.read())
    assert e.by_run
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(pa.array(texts, pa.string()))] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards_roll_over_by_size_also_within_the_rows_of_one_id(spark):
    docs = [(i // 40, f"word {i:04d}") for i in range(120)]
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    write_tokens(spark, spark.createDataFrame(docs, "doc_id long, text string"), folder + "/a", tokenizer_file(), shard_bytes=64)
    store = Store(spark, folder + "/a")
    assert len(store.shards) >= 9
    rows = [tuple(r) for r in read_tokens(spark, folder + "/a").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(rows, key=lambda r: r[1]) == plain_store(docs)
    t = Tokenizer.from_file(tokenizer_file())
    for i, (d, text) in enumerate(docs):
        assert store.get(d, i % 40).tolist() == [*t.encode(text).ids, 0]


def test_added_tokens_in_texts_are_encoded_as_the_library_does(spark):
    docs = [(1, "a <|endoftext|> b"), (2, "after it"), (3, "<|endoftext|>"), (4, "x<|endoftext|><|endoftext|>y <|endoftext"), (5, "日<|endoftext|>本"), (6, "end")]
    t = Tokenizer.from_file(tokenizer_file())
    assert 50256 in t.encode(docs[0][1], add_special_tokens=False).ids
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    write_tokens(spark, spark.createDataFrame(docs, "doc_id long, text string"), folder + "/a", tokenizer_file())
    rows = [tuple(r) for r in read_tokens(spark, folder + "/a").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(rows, key=lambda r: r[1]) == plain_store(docs)


def test_perfect_hash_is_minimal_and_knows_strangers():
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.stack([np.arange(n), np.zeros(n, np.int64)], 1)
        index = PerfectHash.build(key_hash(keys))
        assert sorted(index.slots(key_hash(keys)).tolist()) == list(range(n))
        strangers = np.stack([np.arange(10**9, 10**9 + 1000), np.ones(1000, np.int64)], 1)
        assert (index.slots(key_hash(strangers)) == -1).all()
