import random

import numpy as np

from reelspark.llm.common import WordHashes, shingles
from reelspark.llm.components import components
from reelspark.llm.near_dup import SKETCH, keep_one_each, near_duplicates, sketch

from .helpers import near_components, shingle_set, smallest_reachable

SCHEMA = "doc_id long, text string, bucket string, component string, set_key string"


def corpus():
    """Random texts with edited and exact copies, a chain of overlapping windows, a passage that many texts share, ties and odd rows."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: r.choices(vocabulary, k=n)
    texts = []
    for _ in range(12):
        base = say(r.randint(30, 90))
        texts.append(base)
        for edits in (0, 1, 1, 3, 6):
            copy = list(base)
            for i in r.sample(range(len(copy)), edits):
                copy[i] = r.choice(vocabulary)
            texts.append(copy)
    long = say(60 + 6 * 14)
    texts += [long[6 * i : 6 * i + 60] for i in range(14)]
    shared = say(40)
    texts += [say(15) + shared + say(15) for _ in range(25)]
    seven = say(7)
    texts += [seven, [*seven, "more"], ["one", "two"], ["ONE", "Two"], say(20_000)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(docs)
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "one  two"), (903, "one  two"), (None, "one two"), (904, "é É"), (905, "é é")]
    return docs


def test_against_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "a", "b", "c") for d, t in docs], SCHEMA).repartition(5)
    got = near_duplicates(spark, df).collect()
    assert len(got) == len(docs)
    want, size = near_components(docs), {d: len(shingle_set(t)) for d, t in docs}
    for row in got:
        assert row.n_shingles == size[row.doc_id]
        assert row.component_id == want.get(row.doc_id)
        assert row.kept == (row.doc_id is None or row.component_id == row.doc_id)
    kept = keep_one_each(spark, df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({d for d, _ in docs if d is not None and want[d] == d})


def test_repeated_rows_leave_one(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l"), (2, None), (2, "A other"), (3, "g h i j k l"), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(d, t, 7, 8) for d, t in docs], "doc_id long, text string, nth int, component_id int")
    got = sorted((tuple(r) for r in keep_one_each(spark, df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f", 7, 8), (2, None, 7, 8), (None, "x", 7, 8), (None, "x", 7, 8)], key=str)


def test_an_id_with_several_texts_is_one_node(spark):
    docs = [(1, "a b c d e f"), (2, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_empty_table(spark):
    assert near_duplicates(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_fills_and_estimates():
    hashes, r = WordHashes(), random.Random(2)
    for n in (1, 3, 50, 2000):
        ws = [str(r.random()) for _ in range(n + 4)]
        a, b = shingles(" ".join(ws), hashes), shingles(" ".join(ws + [str(r.random()) for _ in range(n // 3)]), hashes)
        x, y = sketch(a), sketch(b)
        assert len(x) == SKETCH and (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert (x == sketch(a[::-1].copy())).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 0.2


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 7), (8, None)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(u, v) for u, v in edges if u is not None and v is not None and u != v]
    assert got == smallest_reachable({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
