from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from reelspark.llm import decontaminate, quality
from reelspark.llm.common import table
from reelspark.llm.token_store import tokenizer_file

from .helpers import SF, near_components
from .test_passages_and_mixing import plain_count


def test_every_stage_does_its_whole_work(spark):
    docs = table(spark, SF, "documents")
    kept = dict(pipeline.STAGES)["quality_classifier"](spark, docs, SF)
    assert kept.columns == docs.columns
    score = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, table(spark, SF, "labels"))).collect()}
    rows = [tuple(r) for r in docs.collect() if score[r.doc_id] >= quality.THRESHOLD]
    assert sorted(tuple(r) for r in kept.collect()) == sorted(rows)

    at = docs.columns.index("text")
    group = near_components([(r[0], r[at]) for r in rows])
    rows = [r for r in rows if group[r[0]] == r[0]]
    left = spark.createDataFrame(rows, docs.schema)
    assert sorted(tuple(r) for r in pipeline.one_of_each(spark, kept, SF).collect()) == sorted(rows)

    found = {r.doc_id for r in decontaminate.leaks(spark, left, table(spark, SF, "benchmark")).collect()}
    rows = [r for r in rows if r[0] not in found]
    clean = pipeline.uncontaminated(spark, left, SF)
    assert sorted(tuple(r) for r in clean.collect()) == sorted(rows)

    source = docs.columns.index("source")
    n = Counter(r[source] for r in rows)
    total = sum(x**0.5 for x in n.values())
    copies = {r[0]: plain_count(r[0], n[r[source]] ** 0.5 / total * len(rows) / n[r[source]]) for r in rows}
    mixed = pipeline.mixed(spark, clean, SF)
    assert mixed.columns == docs.columns
    assert Counter(r[0] for r in mixed.collect()) == +Counter(copies)

    tokens = Tokenizer.from_file(tokenizer_file())
    size = {r[0]: len(tokens.encode(r[at] or "", add_special_tokens=False).ids) + 1 for r in rows}
    want = Counter({(d, size[d]): c for d, c in copies.items() if c})
    assert Counter((r.doc_id, r.n_tokens) for r in pipeline.tokens(spark, mixed, SF).collect()) == want
    assert Counter((r.doc_id, r.n_tokens) for r in pipeline.run(spark, SF).collect()) == want


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, item_id long, seq int"
    odd = [(None, None, None, None, None, None, None, None), (1, "", "en", "web", 0, 1.0, 2, 3), (1, "", "en", "web", 0, 1.0, 2, 3), (2, "word " * 20_000, "en", "web", 100_000, 1.0, 2, 3)]
    out = stage(spark, spark.createDataFrame(odd, schema), SF)
    assert out.count() <= 40
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0


def test_all_are_registered():
    queries = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11)) and "pipeline" in queries
    assert set(entry.oracle_sql()) <= set(queries)
