import random

import numpy as np

from reelspark.llm.decontaminate import GAP, MATCH, MISMATCH, THRESHOLD, align, item_words, keep_clean, leaks

DOCS = "doc_id long, text string, item_id string, score string"


def plain_alignment(item, passage):
    """Best Smith-Waterman score, cell by cell."""
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if a == b else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
    return max(map(max, h))


def test_alignment_against_the_full_matrix():
    r = np.random.default_rng(1)
    for _ in range(200):
        item, passage = r.integers(0, 6, r.integers(0, 15)), r.integers(0, 6, r.integers(0, 30))
        score, first, end = align(item, passage)
        assert score == plain_alignment(item, passage)
        assert plain_alignment(item, passage[first:end]) == score


def fixture():
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(i, r.choices(vocabulary, k=r.randint(12, 40))) for i in range(15)]
    docs = [(i, r.choices(vocabulary, k=r.randint(5, 120))) for i in range(40)]
    for n, (i, item) in enumerate(items):
        copy = list(item)
        for at in r.sample(range(len(copy)), (0, 1, len(copy) // 4)[n % 3]):
            copy[at] = r.choice(vocabulary)
        if n % 4 == 3:
            del copy[len(copy) // 2]
        docs.append((100 + n, [*r.choices(vocabulary, k=30), *copy, *r.choices(vocabulary, k=30)]))
    docs.append((200, r.choices(vocabulary, k=20_000) + items[0][1]))
    docs = [(d, " ".join(w).upper() if d % 2 else ", ".join(w)) for d, w in docs]
    docs += [(300, None), (301, ""), (302, "..."), docs[-1], (None, " ".join(items[1][1]))]
    return docs, [(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (None, "v1 v2 v3 v4"), (52, "zyx")]


def test_against_every_pair(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(spark, d, b).collect()
    want = []
    for doc, text in docs:
        for item, said in items:
            w = item_words(said)
            if item is not None and w:
                # long texts by align, which test_alignment_against_the_full_matrix holds against plain_alignment
                words_, code = item_words(text), {}
                of = lambda x: np.array([code.setdefault(y, len(code)) for y in x], np.int64)  # noqa: B023, E731
                score = plain_alignment(w, words_) if len(words_) < 1000 else align(of(w), of(words_))[0]
                if score >= THRESHOLD * MATCH * len(w):
                    want.append((doc, item, score))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.item_id, r.score) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[1])) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert len(want) > 15 and key
    # every planted copy is among them, those with a quarter of their words edited too
    assert {(100 + n, n) for n in range(15) if n % 4 != 3} <= {x[:2] for x in want}
    for r in got:
        assert r.share >= THRESHOLD and 0 <= r.first_word < r.end_word
    kept = keep_clean(spark, d, b)
    assert kept.columns == d.columns
    bad = {x[0] for x in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_short_items_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "say zyx now", "", ""), (2, "nothing", "", "")], DOCS)
    b = spark.createDataFrame([(1, "ZYX!"), (2, "absent words")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.share) for r in leaks(spark, d, b).collect()] == [(1, 1, 1.0)]
    assert leaks(spark, d, b.limit(0)).collect() == [] and keep_clean(spark, d, b.limit(0)).count() == 2
    assert leaks(spark, spark.createDataFrame([], DOCS), b).collect() == []
