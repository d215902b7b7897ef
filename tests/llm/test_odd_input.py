"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import struct
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import decontam, langid, lines, neardup, packing, quality, sharding, tiff, tokencounts, toxicity
from spanloom.llm.shared import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k long, id string, u int, v int, n long, part int, shard int, line string, score double, shard_id int, band long, term int, h long"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))


def odd(spark):
    rows = [(None, "A text without an id that is long enough to be a line."), (None, None), (1, None), (2, ""), (3, "  \n\t \n"), (4, "Repeated rows are the same line of text."), (4, "Repeated rows are the same line of text."), (4, "Another text of the same id."), (5, LONG), (6, LONG), (7, "ü ŋ 漢字 \x00 !!! ###"), (8, "one")]
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else "s", None if n % 5 == 0 else len(t or ""), *[None] * 13) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, empty=False):
    rows = [] if empty else [(4, 1, 0), (4, 0, None), (5, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark, empty=False):
    rows = [] if empty else [(1, None), (None, "one"), (2, ""), (3, "repeated rows are the same line of text"), (3, "repeated rows are the same line of text")]
    return spark.createDataFrame(rows, "item_id long, text string")


def rolled(spark, docs, batch="a"):
    from spanloom.llm.shared import scratch_path

    store = tokencounts.RollupStore(spark, scratch_path(spark, "test-rollups"))
    store.commit(batch, tokencounts.inserts(tokencounts.token_counts(docs)))
    return store.totals()


RUNS = {
    "lines": lambda s, d, e: lines.dedup_lines(d),
    "filter_lines": lambda s, d, e: lines.filter_lines(d),
    "packing": lambda s, d, e: packing.pack(d),
    "decontam": lambda s, d, e: decontam.matches(d, benchmark(s, e)),
    "filter_contaminated": lambda s, d, e: decontam.filter_contaminated(d, benchmark(s, e)),
    "quality": lambda s, d, e: quality.resample(d, labels(s, e)),
    "filter_quality": lambda s, d, e: quality.filter_quality(d, labels(s, e)),
    "language": lambda s, d, e: langid.identify(d),
    "tokens": lambda s, d, e: tokencounts.token_counts(d),
    "shuffle": lambda s, d, e: sharding.shuffle(d),
    "toxicity": lambda s, d, e: toxicity.toxic_documents(d, labels(s, e)),
    "near": lambda s, d, e: neardup.near_duplicates(d),
    "drop_near": lambda s, d, e: neardup.drop_near_duplicates(d),
    "rollups": lambda s, d, e: rolled(s, d),
    "tiff": lambda s, d, e: tiff.pages(tiff.rendered(d.selectExpr("doc_id as vec_id", "array(cast(n as float)) as embedding", "text"))),
}
FILTERS = ["filter_lines", "filter_contaminated", "filter_quality", "drop_near"]


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_tables(spark, name):
    assert RUNS[name](spark, odd(spark).filter("false"), True).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(spark, name):
    docs = odd(spark)
    out = RUNS[name](spark, docs, False)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_odd_lines(spark):
    got = [tuple(r) for r in lines.dedup_lines(odd(spark)).collect()]
    by = {}
    for i, *rest in got:
        by.setdefault(i, []).append(tuple(rest))
    assert by[1] == [(None, 0, 0)] and by[2] == [("", 1, 0)] and by[3] == [("  \n\t \n", 3, 0)]
    assert sorted(by[4]) == [("Another text of the same id.", 1, 0), ("Repeated rows are the same line of text.", 1, 0)]
    assert by[5] == [(LONG, 1, 0)] and by[6] == [("", 1, 1)] and len(by[None]) == 2
    assert {r.doc_id for r in lines.filter_lines(odd(spark)).collect()} == {None, 1, 2, 3, 4, 5, 7, 8}


def test_odd_packing(spark):
    rows = packing.pack(odd(spark), window=1000).collect()
    assert sum(r.n_tokens for r in rows) == sum(len((r.text or "").split()) for r in odd(spark).collect())
    assert {r.doc_id for r in rows} == {None, 4, 5, 6, 7, 8} and None in {r.source for r in rows}


def test_odd_benchmark(spark):
    got = {(r.doc_id, r.item_id) for r in decontam.matches(odd(spark), benchmark(spark)).filter("kind = 'phrase'").collect()}
    assert got == {(4, 3), (8, None)}
    assert {r.doc_id for r in decontam.filter_contaminated(odd(spark), benchmark(spark)).collect()} == {None, 1, 2, 3, 4, 5, 6, 7}


def test_odd_quality(spark):
    rows = quality.resample(odd(spark), labels(spark), k=9).collect()
    weight = {r.doc_id: r.log_weight for r in quality.resample(odd(spark), labels(spark), k=99).collect()}
    assert 9 <= len(rows) <= 12 and weight[1] == weight[2] == weight[3] == 0
    no_labels = quality.resample(odd(spark), labels(spark, True)).collect()
    assert len(no_labels) == 12 and {r.log_weight for r in no_labels} == {0.0}


def test_odd_language(spark):
    rows = langid.identify(odd(spark)).collect()
    assert len(rows) == 12
    assert all(r.lang_found is None and r.confidence is None and r.n_windows == 0 for r in rows if r.doc_id in (1, 2))
    assert next(r.n_windows for r in rows if r.doc_id == 5) == -(-len(LONG.encode()) // langid.LENGTH)
    nothing = langid.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == 12 and {r.lang_found for r in nothing} == {None}


def test_odd_tokens(spark):
    rows = tokencounts.token_counts(odd(spark)).collect()
    assert len(rows) == 12 * len(tokencounts.TOKENIZERS) and {r.n0 for r in rows if r.doc_id in (1, 2)} == {0}
    long = {r.tokenizer: r.n0 for r in rows if r.doc_id == 5}
    assert long == {name: len(tokencounts.encoder(path).encode_ordinary(LONG)) for name, path in tokencounts.TOKENIZERS.items()}


def test_odd_shuffle(spark):
    out = sharding.shuffle(odd(spark))
    assert out.count() == 12 and set(out.columns) == {*odd(spark).columns, "shard_pos"}


def test_long_blanks_and_unspaced_text(spark):
    """A million blanks, and texts without any place to cut, are counted in seconds, like short ones of the same form."""
    for own in tokencounts.TOKENIZERS.values():
        plain = lambda t: len(tokencounts.encoder(own).encode_ordinary(t))
        for blank in (" ", "\n", " \n", "\u2003"):
            for before, after in (("", ""), ("word", ""), ("", "word"), ("word", "word"), ("word ", "\u00a0word!")):
                t = before + blank * 1500 + after
                assert tokencounts.count(t, own) == plain(t), (blank, before, after)
        began = time.time()
        for t in (" " * 1_000_000, "a" * 1_000_000, "漢" * 300_000, "end" + "\t \n" * 300_000 + "begin"):
            assert tokencounts.count(t, own) > 0
        assert time.time() - began < 60
    docs = spark.createDataFrame([(1, " " * 1_000_000, "en", "s"), (2, "x" * 1_000_000, "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.n0 > 0 for r in tokencounts.token_counts(docs).collect()} == {True}


def test_odd_rollups(spark, tmp_path):
    """Null keys are keys, repeated rows count each, an empty batch commits, sums of nothing vanish, torn markers count as none."""
    docs = odd(spark)
    rows = rolled(spark, docs).collect()
    assert sum(r.docs for r in rows) == 12 * len(tokencounts.TOKENIZERS) and {None, "s"} == {r.source for r in rows}
    store = tokencounts.RollupStore(spark, f"file://{tmp_path}/store")
    counts = tokencounts.token_counts(docs)
    assert store.commit("empty", tokencounts.inserts(counts.filter("false"))) and store.totals().collect() == []
    assert not store.commit("empty", tokencounts.inserts(counts))
    folder = tmp_path / "store" / "commits"
    for torn in ("", '{"batch": "b"', "[]"):
        (folder / "b").write_text(torn)
        assert not store.committed("b") and store.totals().collect() == []
    assert store.commit("b", tokencounts.inserts(counts)) and not store.commit("b", tokencounts.inserts(counts))
    (folder / ".c.dead").write_text("draft of a writer that died")
    assert sorted(map(str, store.totals().collect())) == sorted(map(str, rows))
    assert store.compact()
    (tmp_path / "store" / "bases" / "2").write_text("")
    assert sorted(map(str, store.totals().collect())) == sorted(map(str, rows))
    store.commit("away", tokencounts.deletes(counts))
    assert store.totals().collect() == []


def test_many_copies_of_a_record_scatter(spark, tmp_path):
    docs = odd(spark).select("doc_id", "text", "lang").unionAll(spark.range(20_000).selectExpr("7L as doc_id", "'the same record again and again' as text", "cast(null as string) as lang"))
    params = {"bucket_bytes": 200_000, "repeats": 500}
    rows = lambda d: sorted((r.shard_id, r.shard_pos, r.doc_id or -1, r.text or "") for r in d.collect())
    got = rows(sharding.write_shards(docs, f"file://{tmp_path}/shards", **params))
    size = Counter(r[0] for r in got)
    assert len(got) == 20_012 and len(size) > 8 and max(size.values()) < 1.3 * 20_012 / len(size)
    assert Counter(r[2:] for r in got) == Counter((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert got == rows(sharding.shuffle(docs.orderBy(F.desc("text")).repartition(3), **params))
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == len(size)


def test_more_sources_than_a_window_has_room_for(spark):
    docs = spark.createDataFrame([(i, " ".join(["x"] * (1 + i % 7)), f"source {i % 90}") for i in range(600)], "doc_id long, text string, source string")
    rows = packing.pack(docs, window=64).collect()
    tokens = Counter((r.doc_id, t) for r in rows for t in range(r.start_token, r.end_token))
    assert set(tokens.values()) == {1} and len(tokens) == sum(1 + i % 7 for i in range(600))
    fill = Counter()
    for r in rows:
        fill[r.window_id] += r.n_tokens
    assert {n for k, n in fill.items() if k < max(fill)} == {64}
    for weights in ({"source 1": 2}, {f"source {i}": 0 for i in range(90)}):
        with pytest.raises(ValueError, match="weights"):
            packing.pack(docs, window=64, weights=weights)


def faulty(tag, kind, values, count=None):
    """A file of one 2 x 2 page with one more tag in its directory, of any type and count."""
    code = {3: "H", 4: "I", 6: "b", 8: "h", 11: "f", 12: "d"}[kind]
    tags = {256: (3, (2,)), 257: (3, (2,)), 258: (3, (8,)), 259: (3, (1,)), 273: (4, (8,)), 277: (3, (1,)), 278: (3, (2,)), 279: (4, (4,)), tag: (kind, values)}
    out = bytearray(b"II*\0" + struct.pack("<I", 12) + b"\1\2\3\4")
    body = b""
    for t, (k, v) in sorted(tags.items()):
        data = struct.pack(f"<{len(v)}{code if t == tag else {3: 'H', 4: 'I'}[k]}", *v)[:4].ljust(4, b"\0")
        body += struct.pack("<HHI", t, k, count if t == tag and count is not None else len(v)) + data
    return bytes(out + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0))


def test_odd_images(spark):
    good = tiff.render(np.linspace(-1, 1, 64).astype(np.float32), 1)
    assert tiff.read_tiff(faulty(305, 3, (1,)))[0][0]["pixels"].ravel().tolist() == [1, 2, 3, 4]
    bad = [faulty(t, k, v, n) for t in (256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 339) for k, v, n in ((3, (), 0), (11, (2.5,), None), (8, (-2,), None), (12, (1.0,), None), (3, (0,), None), (4, (4_000_000_000,), None))]
    bad += [faulty(258, 3, (8,)) [:30], faulty(339, 3, (3,))]
    for data in bad:
        found, error = tiff.read_tiff(data)
        assert error or all("error" in p or p["pixels"].size >= 0 for p in found)
    loop = bytearray(faulty(305, 3, (1,)))
    loop[-4:] = struct.pack("<I", 12)
    empty = tiff.write_tiff([{"pixels": np.zeros((0, 5, 1), np.uint8), "rows": 1}])
    blobs = [good, good, bytes(loop), empty, *bad]
    rows = tiff.pages(spark.createDataFrame([(i, bytearray(x), "clash") for i, x in enumerate(blobs)], "id long, data binary, page string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert set(by) == set(range(len(blobs)))
    assert [r.pixels for r in by[0]] == [r.pixels for r in by[1]] and len(by[0]) == 4
    assert len(by[2]) == 1 and by[2][0].error is None
    assert [(r.height, r.pixel_sum, r.pixel_check, r.error) for r in by[3]] == [(0, None, None, None)]


def test_flipped_bytes_of_images_never_fail():
    data, rng = bytearray(tiff.render(np.linspace(-1, 1, 64).astype(np.float32), 2)), np.random.default_rng(8)
    for _ in range(1500):
        own = data.copy()
        for at in rng.integers(0, len(own), 3):
            own[at] = rng.integers(256)
        tiff.read_tiff(bytes(own))


def test_odd_toxicity_and_near_copies(spark):
    assert toxicity.toxic_documents(odd(spark), labels(spark)).count() == 0
    twice = odd(spark).union(odd(spark))
    once = sorted(map(str, toxicity.score(odd(spark), toxicity.induce(odd(spark), {4: 0, 7: 1})).collect()))
    assert sorted(map(str, toxicity.score(twice, toxicity.induce(odd(spark), {4: 0, 7: 1})).collect())) == sorted(once * 2)
    assert {(r.doc_id, r.group_id, r.n_links) for r in neardup.near_duplicates(odd(spark)).collect()} == {(5, 5, 1), (6, 5, 1)}
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in neardup.drop_near_duplicates(odd(spark)).collect())
    assert kept == sorted([(True, 0), (True, 0), *((False, i) for i in (1, 2, 3, 4, 4, 5, 7, 8))])


def test_near_copies_of_null_and_shared_ids(spark):
    text = " ".join(f"word{i} of{i % 7}" for i in range(80))
    other = " ".join(f"else{i} by{i % 5}" for i in range(80))
    docs = spark.createDataFrame([(None, text), (None, text), (None, text + " more"), (3, other), (3, text + " still more"), (3, "of its own"), (9, other)], "doc_id long, text string")
    got = Counter((r.doc_id, r.group_id) for r in neardup.near_duplicates(docs).collect())
    assert got == {(None, None): 2, (3, None): 1, (3, 3): 1, (9, 3): 1}
    kept = neardup.drop_near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in kept) == {None: 1, 3: 2} and {r.text for r in kept if r.doc_id == 3} == {other, "of its own"}


def test_rows_that_differ_in_extra_columns_keep_a_defined_one(spark):
    text = "a line that is long enough to count\nand another line of the same length"
    rows = [(1, text, k) for k in range(5)] + [(2, "something else", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long")
    for run in (lines.filter_lines, neardup.drop_near_duplicates):
        kept = [sorted(tuple(r) for r in run(d).collect()) for d in (docs, docs.orderBy(F.desc("k")).repartition(3))]
        assert kept[0] == kept[1] and len(kept[0]) == 2


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0.5 * docs.count() < out.count() <= docs.count(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert decontam.matches(docs, table(spark, sf, "benchmark")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.filter(r"text rlike '[^ \t\n\r\f]'").count()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(packed)


def test_pipeline_of_odd_documents(spark, sf):
    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars", "k", "id", "shard")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} >= {5}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
