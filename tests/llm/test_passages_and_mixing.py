import hashlib
import math
import random
import re
from collections import Counter

from reelspark.llm.mixing import OP7_SQL, RATE_STEP, SEED, TERMS, op7_poisson_mix, replicate
from reelspark.llm.substring_dedup import GEAR, GRAM, WINDOW, WORDS, chunk_ends, whole_passages, without_passages

from .helpers import SF, duck, same_rows

DOCS = "doc_id long, text string, seq string, owner string, run string, a string"


def plain_ends(data):
    h, hashes = 0, []
    for i, byte in enumerate(data):
        h = (2 * h + int(GEAR[byte])) & 0xFFFF
        if i >= GRAM - 1:
            hashes.append(h)
    found = set()
    for i in range(len(hashes) - WINDOW + 1):
        least = min(hashes[i : i + WINDOW])
        found |= {j + GRAM for j in range(i, i + WINDOW) if hashes[j] == least}
    return sorted(found)


def passages_corpus():
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["straße", "night", "Über"]) + str(r.randrange(5000)) for _ in range(n))
    shared, inner = say(70), say(60)
    docs = [(i, say(40)) for i in range(20)]
    docs += [(20 + i, f"{say(25)} {shared} {say(25)}") for i in range(6)]
    docs += [(40, f"{inner} {say(20)} {inner}"), (41, say(20_000)), (42, None), (43, ""), (44, "a"), (45, "a"), (None, shared)]
    return docs


def test_chunk_ends_against_a_byte_by_byte_hash():
    r = random.Random(1)
    for n in (0, 1, 15, 16, 57, 58, 59, 100, 400, 3000):
        for data in (bytes(r.randrange(256) for _ in range(n)), b"ab " * (n // 3)):
            ends = chunk_ends(data).tolist()
            assert ends == plain_ends(data)
            assert all(b - a <= WINDOW for a, b in zip(ends, ends[1:]))


def test_chunks_resist_insertions_and_99_bytes_share_one():
    r = random.Random(6)
    say = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    data = say(20_000)
    other = data[:9000] + b"inserted" + data[9000:]
    cut = lambda x: Counter(x[a:b] for a, b in zip(chunk_ends(x).tolist(), chunk_ends(x).tolist()[1:]))
    assert sum((cut(data) - cut(other)).values()) <= 8
    for _ in range(500):
        shared, left, right = say(99), say(70), say(300)
        places = []
        for x, shift in ((left + shared + right, 70), (right + shared + left, 300)):
            ends = [e - shift for e in chunk_ends(x).tolist()]
            places.append({(a, b) for a, b in zip(ends, ends[1:]) if a >= GRAM and b <= 99})
        both = sorted(places[0] & places[1])
        assert both and both[0][0] <= WINDOW + GRAM - 1 and both[-1][1] >= 99 - WINDOW + 1


def test_passages_are_cut_out(spark):
    docs = passages_corpus()
    df = spark.createDataFrame([(d, t, "1", "2", "3", "4") for d, t in docs], DOCS)
    found = whole_passages(df)
    assert {r.doc_id for r in found.collect()} == {*range(21, 26), 40}
    cut = without_passages(df, found)
    assert cut.columns == df.columns
    texts, given = {r.doc_id: r.text for r in cut.collect()}, dict(docs)
    assert all(texts[d] == given[d] for d in given if d not in {*range(21, 26), 40})
    assert all(len(texts[d]) < len(given[d]) - 100 for d in (*range(21, 26), 40))


def test_rows_given_twice_keep_their_passages(spark):
    r = random.Random(4)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    shared = say(80)
    docs = [(1, f"{say(20)} {shared} {say(20)}"), (2, f"{say(30)} {shared} {say(10)}"), (3, say(100)), (3, f"{say(40)} {shared}"), (4, say(200))]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    once = sorted(tuple(x) for x in whole_passages(df(docs)).collect())
    assert [x[0] for x in once] == [2, 3] and all(x[-1] == 1 for x in once)
    assert sorted(tuple(x) for x in whole_passages(df(docs + docs)).collect()) == once


def plain_stretches(docs):
    """(doc_id, start, end) of all stretches of WORDS words that occurred before, joined where they overlap."""
    found, first = {}, {}
    for d, text in docs:
        bounds = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())] if d is not None and text else []
        found[d] = [(tuple(text.encode()[a:b] for a, b in bounds[i : i + WORDS]), bounds[i][0], bounds[i + WORDS - 1][1]) for i in range(len(bounds) - WORDS + 1)]
        for w, *_ in found[d]:
            first[w] = min(first.get(w, d), d)
    out = []
    for d, mine in found.items():
        seen, spans = set(), []
        for w, a, b in mine:
            if first[w] != d or w in seen:
                if spans and a < spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            seen.add(w)
        out += [(d, a, b) for a, b in spans]
    return sorted(out)


def test_whole_passages_have_their_real_ends(spark):
    """Passages of just over and under 50 words in other surroundings, short words, a stretch without variety, and repeats of repeats."""
    r = random.Random(11)
    say = lambda n, k=5000: " ".join(r.choice(["straße", "night", "Über", "a"]) + str(r.randrange(k)) for _ in range(n))
    short = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    docs = [*passages_corpus(), (60, "z " * 300), (61, f"{say(9)} {'z ' * 70} {say(9)}")]
    for n in range(300):
        shared = short(51) if n % 3 == 0 else say(49 + n % 5)
        docs += [(1000 + 2 * n, f"{say(12)} {shared} {say(7)}"), (1001 + 2 * n, f"{say(5)}\n{shared}  {say(20)}")]
    df = spark.createDataFrame([(d, t, "1", "2", "3", "4") for d, t in docs], DOCS)
    got = whole_passages(df).collect()
    want = plain_stretches(docs)
    assert sorted((x.doc_id, x.start, x.end) for x in got) == want
    assert {1001 + 2 * n for n in range(300) if n % 3 == 0 or n % 5} <= {d for d, *_ in want}
    assert all(x.n_bytes == x.end - x.start and x.first_doc_id <= x.doc_id for x in got)
    assert whole_passages(df.limit(0)).collect() == []


def test_frequent_keys_that_are_dealt_out_change_nothing(spark, monkeypatch):
    docs = [*passages_corpus(), *passages_corpus()[:30], *((d + 100, t) for d, t in passages_corpus() if d is not None)]
    df = spark.createDataFrame([(d, t, "1", "2", "3", "4") for d, t in docs], DOCS)
    plain = sorted(tuple(x) for x in whole_passages(df).collect())
    monkeypatch.setattr("reelspark.llm.substring_dedup.SAMPLE", 1)
    monkeypatch.setattr("reelspark.llm.substring_dedup.HOT_LEAST", 2)
    assert sorted(tuple(x) for x in whole_passages(df).collect()) == plain
    monkeypatch.setattr("reelspark.llm.substring_dedup.HOT", 3)
    assert sorted(tuple(x) for x in whole_passages(df).collect()) == plain


def test_passages_of_an_empty_table(spark):
    assert whole_passages(spark.createDataFrame([], DOCS)).collect() == []


def test_mix_matches_sql(spark):
    columns, rows = duck(OP7_SQL, ["documents"])
    same_rows(op7_poisson_mix(spark, SF), columns, rows)


def plain_count(key, rate):
    draws = max(1, math.ceil(rate / RATE_STEP))
    step = rate / draws
    p, total, all_ = math.exp(-step), 0.0, []
    for k in range(TERMS + 1):
        total += p
        all_.append(total)
        p = p * step / (k + 1)
    u = [int(hashlib.md5(f"{SEED}:{key}:{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in range(draws)]
    return sum(sum(c <= x for c in all_) for x in u)


def test_mix_with_given_weights(spark):
    sources = ["a"] * 40 + ["b"] * 30 + ["c"] * 20 + [None] * 10 + ["rare"]
    docs = [(i if i != 3 else None, "t" * (i % 3), s, "x", "y", 7) for i, s in enumerate(sources)] + [(5, "again", "a", "x", "y", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copy string, weight string, rows int")
    weights = [("a", 1.0), ("a", 2.0), ("b", -1.0), ("c", None), ("c", float("nan")), (None, 1.0), ("rare", 4.0), ("absent", 2.0)]
    got = replicate(df, spark.createDataFrame(weights, "source string, weight double"))
    assert sorted(got.columns) == sorted([*df.columns, "shuffle_key"])
    rows, n = Counter(s for _, _, s, *_ in docs), len(docs)
    given = {"a": 3.0, None: 1.0, "rare": 4.0}
    want = Counter()
    for d, _, s, *_ in docs:
        want[(d, s)] += plain_count("null" if d is None else d, given[s] / 8 * n / rows[s]) if s in given else 0
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +want
    assert plain_count(100, 4 / 8 * n) > 20


def test_mix_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert replicate(df).collect() == [] and replicate(df, spark.createDataFrame([], "source string, weight double")).collect() == []
    one = spark.createDataFrame([(1, "a", "s")], df.schema)
    assert replicate(one, spark.createDataFrame([], "source string, weight double")).collect() == []


def test_mix_with_shuffled_rates_and_clashing_names(spark, monkeypatch):
    names = "doc_id long, source string, text string, mix_source string, MIX_DRAWS int, mix_distribution int"
    df = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}", "x", 1, 2) for i in range(60)] + [(70, None, None, None, None, None)], names)
    few = sorted((tuple(r) for r in replicate(df).collect()), key=str)
    monkeypatch.setattr("reelspark.llm.mixing.BROADCAST_SOURCES", 1)
    assert sorted((tuple(r) for r in replicate(df).collect()), key=str) == few and few
