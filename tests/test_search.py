"""Stored indexes against plain Python and brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalars
from spanloom.functions.ids import render
from spanloom.functions.tokenize import Dictionary, bigrams, dictionary_tokenizer
from spanloom.functions.vectors import distance
from spanloom.operators import nearest, search, textindex
from spanloom.operators.textindex import TextIndex, hybrid
from spanloom.plans import catalog
from spanloom.sources import fixtures as fx


def texts(n=60, seed=4):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 200) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i // 10, i % 10, t) for i, t in enumerate(rows)], "trace_id long, span_id long, text string")


def plain_bm25(rows, query, k):
    docs = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in enumerate(rows) if t and re.findall(r"\w+", t)}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    score = Counter()
    for w in set(re.findall(r"\w+", query.lower())):
        for i, c in docs.items():
            if c[w]:
                score[i] += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
    return [(i, round(s, 6)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]


@pytest.mark.parametrize("parts", [1, 3])
def test_bm25_ranks_like_an_exhaustive_search(spark, tmp_path, parts):
    rows = [*texts(), "", None, "w1", "w1 " * 500]
    docs = frame(spark, rows)
    index = TextIndex(spark, f"file://{tmp_path}/index")
    for n in range(parts):
        index = index.add(docs.filter(F.pmod("span_id", F.lit(parts)) == n), one_row_each=True)
    queries = ["w1", "w1 w2 w3", "w7 w150 w9", "absent", "", "W1 w1"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    for own in (index, index.compact()):
        got = {}
        for r in own.search(asked, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.trace_id * 10 + r.span_id, r.score))
        assert got == {i: want for i, q in enumerate(queries) if (want := plain_bm25(rows, q, 7))}
    assert own.search(asked, 0).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_many_texts_are_ranked_in_blocks_like_few(spark, tmp_path, monkeypatch, parts):
    """Scores in blocks of documents, with filters, repeated texts and parts of documents, are those of the join."""
    rows = [*texts(90), "", None, "w1", "w1 " * 500, "w1"]
    docs = frame(spark, rows).union(frame(spark, ["w3 w4 w4"] * 12))
    index = TextIndex(spark, f"file://{tmp_path}/index")
    for n in range(parts):
        index = index.add(docs.filter(F.pmod("span_id", F.lit(parts)) == n))
    queries = [*texts(50, 5), "w1", "W1 w1", "absent", "", None, *texts(3, 5)]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    found = lambda **kw: [tuple(r) for r in index.search(asked, 7, **kw).orderBy("query_id", "rank").select("query_id", "rank", "trace_id", "span_id", "score").collect()]
    want = {}
    for filters in ({}, {"attrs": docs.selectExpr("trace_id", "span_id", "span_id % 3 as tenant_id"), "wanted": search.SearchFilter(tenant_id=1)}):
        monkeypatch.setattr(textindex, "JOINED", 1 << 30)
        joined = found(**filters)
        assert joined and {r[0] for r in joined} >= {0, 49, 50, 55, 57}
        for size, dense in ((20, 0.1), (1 << 30, 2.0), (7, 0.0)):
            monkeypatch.setattr(textindex, "JOINED", 0)
            monkeypatch.setattr(textindex, "BLOCK_DOCS", size)
            monkeypatch.setattr(textindex, "DENSE", dense)
            assert found(**filters) == joined


def test_documents_that_came_whole_need_no_grouping(spark, tmp_path):
    docs = frame(spark, texts())
    first = TextIndex(spark, f"file://{tmp_path}/index").add(docs.filter("span_id < 5"), one_row_each=True)
    both = first.add(docs.filter("span_id >= 5"), one_row_each=True)
    assert both.whole and both.compact().whole and (both.compact().n, both.compact().total) == (60, 1800)
    assert "Aggregate" not in both.lengths()._jdf.queryExecution().toString()
    again = first.add(docs.filter("span_id >= 4"), one_row_each=True)
    assert not again.whole and again.n == 60 and again.compact().lengths().count() == 60


def test_a_batch_of_any_size_is_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(textindex, "COUNTED", 5)
    rows = [["a", "b", "a"], [], None, ["b"] * 12, ["c", "c"], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([0] * 6), pa.array(rows, pa.list_(pa.string()))], ["trace_id", "span_id", "tokens"])
    assert len(list(textindex._pieces([batch]))) > 2
    got = [tuple(r.values()) for b in textindex._count([batch]) for r in b.to_pylist()]
    want = [(w, i, 0, n, len(r)) for i, r in enumerate(rows) if r for w, n in Counter(r).items()] + [(None, i, 0, 0, len(r)) for i, r in enumerate(rows) if r]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_each_text_is_ranked_once(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, f"file://{tmp_path}/index").add(frame(spark, texts()), one_row_each=True)
    seen = []
    scores = TextIndex.scores
    monkeypatch.setattr(TextIndex, "scores", lambda self, q: seen.append(q.count()) or scores(self, q))
    asked = spark.createDataFrame([(i, f"w{i % 2 + 1}") for i in range(500)], "query_id int, query string")
    x, df = vectors(spark, 50)
    assert index.search(asked, 3).count() == 1500 and seen == [2]
    found = hybrid(index, df, asked.withColumn("vector", F.array(*(F.lit(float(v)) for v in x[0]))), 3)
    assert found.count() == 1500 and seen == [2, 2]


def test_rows_of_one_span_are_one_document(spark, tmp_path):
    rows = [(1, 1, "alpha beta"), (1, 1, "beta gamma"), (2, 1, "beta")]
    index = TextIndex(spark, f"file://{tmp_path}/index").add(spark.createDataFrame(rows, "trace_id long, span_id long, text string"))
    assert (index.n, index.total) == (2, 5)
    asked = spark.createDataFrame([(0, "beta gamma")], "query_id int, query string")
    want = plain_bm25(["alpha beta beta gamma", "beta"], "beta gamma", 9)
    for own in (index, index.compact()):
        assert [(r.trace_id - 1, r.score) for r in own.search(asked).orderBy("rank").collect()] == want


def test_a_search_opens_only_the_buckets_of_its_tokens(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index").add(frame(spark, texts(400)), one_row_each=True)
    found = index.search(spark.createDataFrame([(0, "w1 w2")], "query_id int, query string"))
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", plan) and "PushedFilters: [In(token" in plan
    assert plan.split("== Physical Plan ==")[1].count("FileScan") <= 2


def test_dictionary_tokenizer_in_an_index(spark, tmp_path):
    words = Dictionary.parse("反洗钱 100 n\n规则 50\n洗钱 10\n").extended({"卡片": 5})
    cut = dictionary_tokenizer(words)
    assert words.cut("反洗钱规则ABC卡片x") == ["反洗钱", "规则", "abc", "卡片", "x"] and words.cut("无名") == ["无", "名"] and words.cut(None) == []
    docs = frame(spark, ["反洗钱规则", "洗钱", None])
    index = TextIndex(spark, f"file://{tmp_path}/a", tokenizer=cut).add(docs, one_row_each=True)
    asked = spark.createDataFrame([(0, "反洗钱")], "query_id int, query string")
    assert [r.span_id for r in index.search(asked).collect()] == [0]
    pairs = TextIndex(spark, f"file://{tmp_path}/b").add(docs, one_row_each=True)
    assert {r.span_id for r in pairs.search(asked).collect()} == {0, 1}
    assert docs.select(bigrams(F.lit("我ab洗钱了"))).first()[0] == ["我", "ab", "洗钱", "钱了"]


def vectors(spark, n=500, dim=16, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, 1, (clusters, dim))[rng.integers(0, clusters, n)] + rng.normal(0, 0.4, (n, dim))).astype(np.float32)
    return x, spark.createDataFrame([(i // 10, i % 10, [float(v) for v in row]) for i, row in enumerate(x)], "trace_id long, span_id long, embedding array<float>")


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_blocks_find_what_columns_find(spark, monkeypatch, metric):
    monkeypatch.setattr(nearest, "BLOCK", 37)
    monkeypatch.setattr(nearest, "HELD", 300)
    x, df = vectors(spark, 150)
    df = df.union(df.filter("trace_id = 3").withColumn("trace_id", F.lit(-5).cast("long"))).union(spark.createDataFrame([(99, 1, None), (99, 2, []), (99, 3, [1.0])], df.schema))
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in (0, 31, 77)] + [(500, [1.0]), (501, None), (502, [1.0, 2.0])], "query_id long, vector array<float>")
    for sent in (1 << 30, 0):
        monkeypatch.setattr(nearest, "SENT_BYTES", sent)
        got = {}
        for r in nearest.vector_batch(df.repartition(3), asked.repartition(2), 4, metric).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.trace_id, r.span_id, r.distance))
        assert set(got) == {0, 31, 77, 500} and [g[1:3] for g in got[500]] == [(99, 3)]
        for i in (0, 31, 77):
            want = search.vector_scan(df, [float(v) for v in x[i]], 4, metric).collect()
            assert sorted((a, b, c) for a, b, c, _ in got[i]) == sorted((r["rank"], r.trace_id, r.span_id) for r in want)
            assert all(abs(a - b) < 2e-6 for a, b in zip(sorted(g[3] for g in got[i]), sorted(r.distance for r in want)))


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_later_blocks_pass_on_only_what_is_closer(metric):
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(9, 8)), rng.normal(size=(4000, 8)).round(1)
    x[2000:2020] = x[:20]
    known, found = np.full((9, 5), np.inf), []
    for i in range(0, 4000, 200):
        row, column, d = nearest._closer(q, x[i : i + 200], known, metric)
        found += zip(row.tolist(), d.tolist(), (i + column).tolist())
    assert len(found) < 9 * 5 * 20 / 2
    every = np.round(nearest.batch_distance(q, x, metric), 6)
    for i in range(9):
        want = sorted(zip(every[i].tolist(), range(4000)))[:5]
        got = sorted((d, c) for r, d, c in found if r == i)[:5]
        assert [c for _, c in got] == [c for _, c in want] and np.allclose([d for d, _ in got], [d for d, _ in want], atol=2e-6)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_recall_of_the_inverted_file(spark, tmp_path, metric):
    x, df = vectors(spark, 3000, clusters=40)
    index = nearest.VectorIndex.build(df, f"file://{tmp_path}/ivf", lists=32, metric=metric)
    asked = df.filter("span_id = 0").select((F.col("trace_id") * 10).alias("query_id"), F.col("embedding").alias("vector"))
    rows = lambda f: {(r.query_id, r.trace_id, r.span_id) for r in f.collect()}
    exact, found = rows(nearest.vector_batch(df, asked, 10, metric)), rows(index.search(asked, 10, probes=8))
    assert len(exact & found) >= 0.9 * len(exact)
    assert rows(index.search(asked, 10, probes=32)) == exact
    plan = index.search(asked, 10, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_recall_on_the_tables(spark, sf):
    d = "/root/testdata/sf0.01"
    rows = lambda f: {(r.query_id, r.trace_id, r.span_id) for r in f.collect()}
    exact, found = rows(catalog.QUERIES["vector_l2"](spark, d)), rows(catalog.QUERIES["vector_ann"](spark, d))
    print("recall:", len(exact & found) / len(exact))
    assert len(exact & found) >= 0.9 * len(exact)


def test_selective_filters_lose_no_neighbour(spark):
    """The filter comes before the ranking: a hundredth of the rows, and still all of the nearest ten of them."""
    x, df = vectors(spark, 2000)
    attrs = df.select("trace_id", "span_id", F.when(F.col("trace_id") % 100 == 7, "rare").otherwise("other").alias("agent_name"))
    wanted = search.SearchFilter(agent_name="rare")
    asked = spark.createDataFrame([(0, [float(v) for v in x[0]])], "query_id long, vector array<float>")
    got = [(r.trace_id, r.span_id) for r in nearest.vector_batch(search.restrict(df, attrs, wanted), asked, 10).orderBy("rank").collect()]
    rare = [i for i in range(2000) if i // 10 % 100 == 7]
    want = sorted(rare, key=lambda i: (round(float(np.linalg.norm(x[i].astype(float) - x[0])), 6), i))[:10]
    assert got == [(i // 10, i % 10) for i in want]
    with pytest.raises(ValueError, match="metrics"):
        hybrid(None, df, asked, metric="l1")


def test_small_functions(spark):
    row = spark.range(1).select(scalars.rfc3339(F.lit(1_704_553_130_025_999_999)), scalars.clamp_score(F.lit(5000)), scalars.clamp_score(F.lit(-3)), render(F.lit(-1)), distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))).first()
    assert tuple(row) == ("2024-01-06T14:58:50.025Z", 1000, -3, "18446744073709551615", 5.0)


def test_events_as_they_are_searched(spark, sf):
    row = search.search_text(fx.span_events(spark, sf).filter("src_row = 2")).first()
    assert row.text.startswith("done ") or row.text
