import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import ann, lm_score, quality
from reelspark.llm.common import WordHashes

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, n_chars long, y string, score string"


def area(score, label):
    """Chance that a row of label 1 scores above one of label 0."""
    good, bad = score[label == 1], score[label == 0]
    return (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2


def test_machine_against_all_pairs():
    r = np.random.default_rng(0)
    m = quality.Machine(0.3, r.normal(size=20), r.normal(size=(20, 4)))
    x = r.normal(size=(5, 20))
    want = [0.3 + row @ m.weights + sum(row[i] * row[j] * (m.factors[i] @ m.factors[j]) for i in range(20) for j in range(i + 1, 20)) for row in x]
    assert np.allclose(m.margin(x), want)


def test_quality_on_held_out_labels(spark):
    got = quality.op10_quality(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    tested = rows[rows.held_out & rows.quality.notna()]
    assert area(tested.score.to_numpy(), tested.quality.to_numpy()) > 0.8


def test_scores_use_neither_labels_nor_metadata_columns(spark):
    docs = spark.createDataFrame([(1, "Good text here.", 15, "a", "b"), (2, "Good text here.", 15, "c", "d"), (3, None, None, "", ""), (4, "", 0, "", ""), (None, "x " * 50_000, 100_000, "", ""), (1, "Good text here.", 15, "a", "b")], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (4, 7), (8, 0), (8, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    by_id = {r.doc_id: r.score for r in rows}
    assert len(rows) == 6 and by_id[1] == by_id[2] and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 6
    assert quality.keep_good(docs, model, threshold=1.1).count() == 0
    empty = quality.fit(docs.limit(0), labels)
    assert quality.score(docs.limit(0), empty).collect() == []
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


def test_a_repeated_id_leaves_room_for_others(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality.Machine, "fit", lambda x, y: fitted.append(y))
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5][:6]
    docs = spark.createDataFrame([(ids[0], f"copy {i}") for i in range(200)] + [(i, "other text") for i in ids[1:]], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id long, quality int"), sample=6)
    assert sorted(fitted[0].tolist()) == [0] * 5 + [1] * 2


def plain_losses(texts, good, asked):
    """Mean losses of asked texts under counts by whole words, with a vocabulary that may outgrow VOCABULARY."""
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for i, text in enumerate(texts):
        for side in (0, 1) if i in good else (1,):
            one[side].update(text.split())
            two[side].update(zip(text.split(), text.split()[1:]))
    n = [sum(c.values()) for c in one]
    mass, out = 0.1 * max(lm_score.VOCABULARY, len(one[1])), []
    for text in asked:
        tokens, loss = text.split(), [[], []]
        for side, scale in enumerate((1.0, n[0] / n[1])):
            for h, w in zip([None, *tokens], tokens):
                p = (one[side][w] * scale + 0.1) / (n[0] + mass)
                loss[side].append(-np.log(p if h is None else (two[side][h, w] * scale + lm_score.BETA * p) / (one[side][h] * scale + lm_score.BETA)))
        out.append([float(np.mean(x)) for x in loss])
    return out


def test_counts_grow_with_the_corpus(spark, monkeypatch):
    """More distinct words and bigrams than any fixed table of a model held, and a word that is everywhere."""
    monkeypatch.setattr(lm_score, "PACK_TOKENS", 5000)
    r = np.random.default_rng(3)
    texts = [" ".join(x for w in r.integers(0, 10**7, 250).tolist() for x in ("the", f"w{w}")) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    target = docs.where("doc_id < 200").select("doc_id")
    models = lm_score.train(docs, target)
    assert models.vocabulary > lm_score.VOCABULARY and len(models.hot) == 1
    for asked in (docs, spark.createDataFrame(list(enumerate(texts[:50] + ["never seen the words"])), "doc_id long, text string")):
        got = {x.doc_id: x for x in lm_score.score(asked, models).collect()}
        of = [x.text for x in asked.orderBy("doc_id").collect()]
        for i, want in enumerate(plain_losses(texts, set(range(200)), of)):
            assert np.allclose([got[i].target_loss, got[i].background_loss], want, rtol=1e-9)


@pytest.mark.parametrize("bound", [lm_score.BROADCAST_IDS, 1])
def test_losses_against_plain_counts(spark, monkeypatch, bound):
    monkeypatch.setattr(lm_score, "BROADCAST_IDS", bound)
    texts = [(1, "a b a b c"), (2, "a c c"), (3, None), (4, ""), (5, "b"), (6, "z " * 20_000), (6, "a b"), (None, "c a")]
    docs = spark.createDataFrame([(d, t, 0, "y", "s") for d, t in texts], DOCS)
    target = spark.createDataFrame([(1,), (1,), (5,), (None,), (99,)], "doc_id long")
    got = sorted((tuple(r) for r in lm_score.score(docs, lm_score.train(docs, target)).collect()), key=str)
    hashes = WordHashes()
    ids = [lm_score.token_ids(t, hashes).tolist() for _, t in texts]
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for (d, _), tokens in zip(texts, ids):
        for side in (0, 1) if d in (1, 5) else (1,):
            one[side].update(tokens)
            two[side].update(zip(tokens, tokens[1:]))
    n = [sum(c.values()) for c in one]
    scale = [1.0, n[0] / n[1]]
    want = []
    for (d, _), tokens in zip(texts, ids):
        loss = [[], []]
        for side in (0, 1):
            word = lambda w: (one[side][w] * scale[side] + lm_score.ALPHA / lm_score.VOCABULARY) / (n[0] + lm_score.ALPHA)  # noqa: B023, E731
            for i, w in enumerate(tokens):
                p = word(w) if i == 0 else (two[side][tokens[i - 1], w] * scale[side] + lm_score.BETA * word(w)) / (one[side][tokens[i - 1]] * scale[side] + lm_score.BETA)
                loss[side].append(-np.log(p))
        a, b = (float(np.mean(x)) if x else 0.0 for x in loss)
        want.append((d, len(tokens), a, b, a - b))
    want.sort(key=str)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-5)
    assert lm_score.score(docs.limit(0), lm_score.train(docs.limit(0), target)).collect() == []


def test_good_documents_score_lower(spark):
    rows = lm_score.op6_lm_score(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("n_tokens > 0").toPandas()
    assert area(-rows.score.to_numpy(), rows.quality.to_numpy()) > 0.6


def plain_nearest(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found.get(q, set()) & {i for i, _ in near}) / max(1, len(near)) for q, near in want.items()])


def test_search_is_exact_at_factor_one_and_near_at_the_default(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = ann.usable(vectors, "vec_id", "embedding").toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.v.to_numpy())
    want = plain_nearest(ids, x, 20, ann.K)
    exact = ann.nearest(spark, vectors, factor=1.0, shard_vectors=170).collect()
    assert recall(exact, want) == 1.0
    for q, near in want.items():
        mine = sorted((r for r in exact if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(near) + 1))
        assert np.allclose([r.score for r in mine], [s for _, s in near], rtol=0, atol=1e-12)
    assert recall(ann.op9_nearest(spark, SF).collect(), want) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, rank int, shard string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(spark, df).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.nearest(spark, df.limit(0)).collect() == []
    assert ann.nearest(spark, df.where(F.col("vec_id") == 20)).collect() == []


def test_equal_vectors_tie_to_smaller_ids(spark):
    r = np.random.default_rng(9)
    for seed in range(3):
        one, rest = r.normal(size=(1, 64)), r.normal(size=(200, 64))
        x = np.concatenate([np.repeat(one, 301, 0), rest])[r.permutation(501)]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for row in ann.nearest(spark, df, factor=1.0, shard_vectors=(170, 501, 60)[seed]).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append(row.vec_id)
        score = lambda a, b: sum(float(p) * float(q) for p, q in zip(a, b))
        for i in range(0, 501, 20):
            want = sorted((j for j in range(501) if j != i), key=lambda j: (-score(x[i], x[j]), j))[: ann.K]  # noqa: B023
            assert got[i] == want


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 2.0, 3.0]), (1, [2.0, 1.0]), (2, [1.0] * 4), (3, [0.0, 1.0]), (4, [1.0, 1.0, 1.0])]
    got = ann.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 2.0), (0, 2, 3, 0.0)]


def test_the_default_factor_skips_and_still_finds():
    """Recall and the share of pairs looked at, on clustered vectors."""
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 64))[r.integers(0, 200, 50_000)] + 0.25 * r.normal(size=(50_000, 64))
    ids, asked = np.arange(50_000), np.arange(0, 50_000, 200)
    tree = ann.Tree(ids, x, float(np.sqrt((x * x).sum(1)).max()))
    found, _ = tree.search(asked, x[asked], ann.K, ann.FACTOR)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argpartition(-scores, ann.K, 1)[:, : ann.K]
    assert np.mean([len(set(a) & set(b)) / ann.K for a, b in zip(found.tolist(), want.tolist())]) >= 0.9
    assert tree.scored / (len(asked) * len(ids)) < 0.7


def test_tree_survives_a_file(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 8))
    norm = float(np.sqrt((x * x).sum(1)).max())
    tree = ann.Tree(np.arange(900), x, norm)
    again = ann.Tree.load(tree.save())
    want = plain_nearest(np.arange(900), x, 20, 10)
    for t in (tree, again):
        found, _ = t.search(np.arange(0, 900, 20), x[::20], 10, 1.0)
        assert [set(f) for f in found.tolist()] == [{i for i, _ in near} for near in want.values()]
