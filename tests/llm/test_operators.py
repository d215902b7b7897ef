"""The training-data operators against SQL, brute force, exact round trips and held-out labels."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontam, langid, lines, neardup, packing, quality, queries, sharding, tiff, tokencounts, toxicity
from spanloom.llm.shared import table
from spanloom.llm.tokens import U, hash_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE[name])


def random_texts(n, words, seed=1, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, words)) for _ in range(n)]


# 1


def test_perfect_hash_is_minimal_and_survives_a_dump():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(U)
    keys = np.unique(keys)
    built = lines.PerfectHash.build(keys)
    loaded = lines.PerfectHash.load(*built.dump())
    assert sorted(loaded.lookup(keys)) == list(range(len(keys)))


def test_lines_many_shards_and_hot_line(spark, monkeypatch):
    monkeypatch.setattr(lines, "PROBES", 50)
    monkeypatch.setattr(lines, "TASK_BYTES", 1000)
    hot = "this line is in every single document"
    docs = make(spark, [f"{hot}\nown line of the document number {i}\n{hot}\nshort" for i in range(200)])
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs, shard_bytes=2000).collect()}
    for i in range(200):
        assert got[i] == (hot + "\n" if i == 0 else "") + f"own line of the document number {i}\nshort"


# 2


def drain(totals, weights, window):
    """Deficit round-robin in fractions, window by window: what each queue serves in each window."""
    from fractions import Fraction

    served, out, k = [0] * len(totals), [], 0
    t, left = 0, sum(totals)
    due = [Fraction(0)] * len(totals)
    while t < left:
        room = min(window, left - t)
        while room:
            active = [i for i in range(len(totals)) if due[i] < totals[i]]
            w = sum(weights[i] for i in active)
            step = min([Fraction(room), *((totals[i] - due[i]) * w / weights[i] for i in active)])
            for i in active:
                due[i] += step * weights[i] / w
            room -= step
            t += step
        out.append([float(d) for d in due])
    return out


def test_schedule_keeps_each_queue_within_a_token_of_its_share():
    totals, weights, window = [1000, 90, 4000], [3, 1, 2], 64
    plan = packing.Schedule(totals, weights, window)
    for k, due in enumerate(drain(totals, weights, window), 1):
        got = [int(plan.share(np.array([k]), np.array([i]))[0]) for i in range(3)]
        assert sum(got) == min(k * window, sum(totals))
        assert all(abs(g - d) < 2 for g, d in zip(got, due))


def test_windows_are_full_and_hold_each_token_once(spark):
    docs = make(spark, random_texts(40, 57), "a").union(make(spark, random_texts(9, 300), "b"))
    rows = packing.pack(docs, window=128, weights={"a": 3, "b": 1}).collect()
    fill = defaultdict(list)
    for r in rows:
        fill[r.window_id].append((r.pos, r.pos + r.n_tokens))
    total = 40 * 57 + 9 * 300
    for k, spans in fill.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert spans[-1][1] == min(128, total - 128 * k)
    tokens = Counter((r.source, r.doc_id, t) for r in rows for t in range(r.start_token, r.end_token))
    assert len(tokens) == total and set(tokens.values()) == {1}
    first = Counter()
    for r in rows:
        first[r.source] += r.n_tokens * (r.window_id < 10)
    assert abs(first["a"] - 960) < 2
    with pytest.raises(ValueError):
        packing.pack(docs, window=4, weights={"a": 1, "b": 9}).collect()


# 3


def test_phrases_and_proximity_against_brute_force(spark):
    texts = random_texts(60, 200, seed=5, vocabulary=90)
    bench = random_texts(6, 14, seed=6, vocabulary=90) + ["", None, "alpha beta gamma delta"]
    texts[3] = texts[3] + " " + bench[0] + " " + bench[0]
    texts[4] = bench[1]
    texts[5] = "Alpha, beta!\ngamma delta " + texts[5]
    texts[6] = " ".join(texts[6].split() + bench[2].split()[:8])
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    found = decontam.matches(make(spark, texts), items).collect()
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    docs, asks = [split(t) for t in texts], [split(t) for t in bench]
    want = {}
    for i, item in enumerate(asks):
        for k in range(max(1, len(item) - 7)) if item else ():
            run = item[k : k + 8]
            for d, words in enumerate(docs):
                for p in range(len(words) - len(run) + 1):
                    if words[p : p + len(run)] == run:
                        n, lo, hi = want.get((d, i), (0, p, p))
                        want[d, i] = n + 1, min(lo, p), max(hi, p + len(run) - 1)
    assert {(r.doc_id, r.item_id): (r.hits, r.first_word, r.last_word) for r in found if r.kind == "phrase"} == want
    assert {(3, 0), (4, 1), (5, 8), (6, 2)} <= set(want)

    freq, near = Counter(w for d in docs for w in d), {}
    names = sorted(set(w for a in asks for w in a), key=lambda w: hash_words([w])[0])
    place, counts = {w: i for i, w in enumerate(names)}, np.array([freq[w] for w in names])
    for i, item in enumerate(asks):
        terms, need = decontam.rare_terms([place[w] for w in item], counts) if item else ([], 0)
        terms = [names[t] for t in terms]
        for d, words in enumerate(docs):
            at = {t: [p for p, w in enumerate(words) if w == t] for t in terms}
            lead = sorted(p for t in terms[: len(terms) - need + 1] for p in at[t])
            hits = [p for p in lead if sum(any(abs(p - q) <= decontam.SPAN for q in at[t]) for t in terms) >= need] if terms else []
            if hits:
                near[d, i] = len(hits), hits[0], hits[-1]
    assert near and {(r.doc_id, r.item_id): (r.hits, r.first_word, r.last_word) for r in found if r.kind == "near"} == near


def test_growth_by_unrelated_text_changes_no_match(spark):
    texts, bench = random_texts(60, 200, seed=5, vocabulary=90), random_texts(6, 14, seed=6, vocabulary=90)
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    docs = make(spark, texts + [bench[0]])
    more = make(spark, [" ".join(f"u{x}" for x in np.random.default_rng(k).integers(0, 500, 20_000)) for k in range(30)]).withColumn("doc_id", F.col("doc_id") + 1000)
    rows = lambda d: sorted(tuple(r) for r in decontam.matches(d, items).collect())
    found = rows(docs)
    assert {r[3] for r in found} == {"phrase", "near"} and rows(docs.union(more)) == found


def test_one_index_serves_several_benchmarks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PORTION", 7)
    texts, bench = random_texts(60, 200, seed=5, vocabulary=90), random_texts(6, 14, seed=6, vocabulary=90)
    docs = make(spark, texts + bench)
    index = decontam.build_index(docs)
    split = decontam.build_index(docs.repartition(5))
    assert index.count() < split.count()
    for part in (bench[:2], bench[2:], bench):
        items = spark.createDataFrame(list(enumerate(part)), "item_id long, text string")
        rows = [sorted(tuple(r) for r in decontam.search(i, items).collect()) for i in (index, split)]
        assert rows[0] == rows[1] == sorted(tuple(r) for r in decontam.matches(docs, items).collect()) and rows[0]


def test_copies_with_some_words_replaced(spark):
    """No phrase is left, one of the rarest terms is gone, another is nowhere in the corpus."""
    bench = random_texts(8, 40, seed=21, vocabulary=5000)
    copies = [" ".join(f"new{i}x{k}" if k % 8 == 7 else w for k, w in enumerate(t.split())) for i, t in enumerate(bench)]
    items = spark.createDataFrame([(i, t + " nowhere") for i, t in enumerate(bench)], "item_id long, text string")
    docs = make(spark, copies + random_texts(200, 200, seed=22, vocabulary=5000))
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()} == {(i, i) for i in range(8)}
    assert {r.doc_id for r in decontam.filter_contaminated(docs, items).collect()} == set(range(8, 208))


# 4


def test_resample_against_brute_force(spark):
    texts = random_texts(80, 30, seed=8, vocabulary=50)
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    good = set(quality.target_ids(quality.labelled(labels)))
    grams = [Counter(next(quality.features(pa.array([t])))[1].tolist()) for t in texts]
    raw, target = Counter(), Counter()
    for i, g in enumerate(grams):
        raw.update(g)
        if i in good:
            target.update(g)
    scale = sum(target.values()) / sum(raw.values())
    ratio = {b: np.log(target[b] + quality.SMOOTHING) - np.log(raw[b] * scale + quality.SMOOTHING) for b in raw}
    bits = {r[0]: r[1] for r in docs.select("doc_id", quality.noise()).collect()}
    key = {}
    for i, g in enumerate(grams):
        u = ((bits[i] % (1 << 64) >> 11) + 0.5) * 2.0**-53
        key[i] = sum(ratio[b] * n for b, n in g.items()) - np.log(-np.log(u))
    for k in (1, 17, 80):
        want = sorted(key, key=lambda i: -key[i])[:k]
        got = quality.resample(docs, labels, k).collect()
        assert {r.doc_id for r in got} == set(want)
        assert all(abs(r.sort_key - key[r.doc_id]) < 1e-6 for r in got)
        assert {r.doc_id for r in quality.filter_quality(docs, labels, k).collect()} == set(want)


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    kept = quality.resample(docs, labels).select("doc_id").distinct().withColumn("kept", F.lit(1))
    known = labels.join(docs.select("doc_id").distinct(), "doc_id").join(kept, "doc_id", "left")
    r = known.agg(F.avg(F.expr("if(quality = 1, coalesce(kept, 0), null)")), F.avg(F.expr("if(quality = 0, coalesce(kept, 0), null)"))).first()
    assert r[0] >= 0.9 and r[1] <= 0.2, r


# 5


def test_folded_tables_equal_the_network():
    rng = np.random.default_rng(2)
    net = langid.ByteNet(["a", "b", "c"])
    x = rng.integers(0, 256, (40, langid.LENGTH)).astype(np.uint8)
    assert np.allclose(net._forward(x)[2], net.folded().log_probabilities(x), atol=1e-4)


def test_gradients_by_differences():
    rng = np.random.default_rng(4)
    net = langid.ByteNet(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 123, (6, 40)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda: -net._forward(x)[2][np.arange(6), y].mean()
    for name, g in net.gradients(x, y).items():
        flat, at = net.p[name].reshape(-1), int(np.abs(g).argmax())
        old, eps = flat[at], 1e-5
        flat[at] = old + eps
        up = loss()
        flat[at] = old - eps
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2 / eps - g.reshape(-1)[at]) < 1e-4, name


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 and length(text) > 100")
    net = langid.fit(train)
    pairs = [(r.lang, r.text) for r in test.select("lang", "text").filter("lang is not null").collect()]
    hits = 0
    for lang, text in pairs:
        _, x, _ = next(langid.windows(pa.array([text], pa.large_string())))
        hits += net.langs[net.log_probabilities(x).sum(0).argmax()] == lang
    assert hits / len(pairs) >= 0.95


def test_language_query_on_held_out_documents(spark):
    """``identify`` itself: documents of hidden language are told by those whose language is known."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("doc_id is not null")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = langid.identify(hidden).select("doc_id", "lang_found", "confidence", "n_windows").distinct()
    truth = docs.filter("doc_id % 2 = 1 and length(text) > 100 and lang is not null").select("doc_id", "lang", F.ceil(F.octet_length("text") / langid.LENGTH).alias("n")).distinct()
    rows = truth.join(found, "doc_id").collect()
    assert sum(r.lang == r.lang_found for r in rows) >= 0.95 * len(rows)
    assert all(r.n == r.n_windows and 0.25 <= r.confidence <= 1 for r in rows)


# 6


def test_rollup_query_against_a_recount(spark, sf):
    docs, toxic = table(spark, sf, "documents").collect(), {r.doc_id for r in table(spark, sf, "labels").filter("toxic = 1").collect()}
    want = defaultdict(lambda: [0, 0])
    for r in docs:
        if r.doc_id not in toxic:
            text = re.sub(queries.MARKS, "", r.text or "")
            for name, path in tokencounts.TOKENIZERS.items():
                want[r.source, r.lang, name][0] += 1
                want[r.source, r.lang, name][1] += len(tokencounts.encoder(path).encode_ordinary(text)) if text else 0
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in queries.op6_token_rollups(spark, sf).collect()}
    assert got == {k: v for k, v in want.items() if v != [0, 0]} and any(re.search(queries.MARKS, r.text or "") for r in docs)


def test_rollups_are_idempotent_and_equal_a_recount(spark, sf, tmp_path):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    store = tokencounts.RollupStore(spark, f"file://{tmp_path}/rollups")
    counts = tokencounts.token_counts(docs)
    assert store.commit("a", tokencounts.inserts(counts))
    assert not store.commit("a", tokencounts.inserts(counts))
    store.commit("gone", tokencounts.deletes(counts.filter("doc_id % 5 = 0")))
    changed = tokencounts.revised_counts(docs.filter("doc_id % 5 = 1"), F.concat(F.lit("New words first. "), "text"))
    store.commit("new", tokencounts.revisions(changed))
    want = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        if r.doc_id % 5:
            text = "New words first. " + r.text if r.doc_id % 5 == 1 and r.text is not None else r.text
            for name, path in tokencounts.TOKENIZERS.items():
                want[r.source, r.lang, name][0] += 1
                want[r.source, r.lang, name][1] += len(tokencounts.encoder(path).encode_ordinary(text)) if text else 0
    read = lambda: {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in store.totals().collect()}
    assert read() == dict(want)
    assert store.compact() and read() == dict(want)
    assert not store.commit("new", tokencounts.revisions(changed)) and read() == dict(want)


# 7


def test_shuffle_is_a_permutation_that_doesnt_depend_on_the_order_read(spark, sf):
    docs = table(spark, sf, "documents")
    docs = docs.union(docs.limit(3))
    read = lambda d: sorted((r.shard_id, r.shard_pos, r.doc_id, r.text) for r in sharding.shuffle(d, 60_000).collect())
    got = read(docs)
    assert len({g[0] for g in got}) > 3
    assert Counter((g[2], g[3]) for g in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert {g[:2] for g in got} == {(s, p) for s, n in Counter(g[0] for g in got).items() for p in range(n)}
    assert read(docs.orderBy(F.desc("doc_id")).repartition(5)) == got


def test_shards_against_plain_python(spark, sf):
    """Buckets by hash, order by hash, then swaps drawn by splitmix64, written out one by one."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    size = sum(len((r.text or "").encode()) + 64 for r in docs.collect())
    seed, buckets, mask = 5, -(-size // 60_000), (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    keyed = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("h2")).collect()
    want = {}
    for b in range(buckets):
        own = [r.doc_id for r in sorted((r for r in keyed if ((r.h & mask) >> 20) % buckets == b), key=lambda r: (r.h, r.h2))]
        start = mix(seed ^ mix(b + 1))
        for n, i in enumerate(range(len(own) - 1, 0, -1), 1):
            j = int((mix(start + n * 0x9E3779B97F4A7C15 & mask) >> 11) * 2.0**-53 * (i + 1))
            own[i], own[j] = own[j], own[i]
        want |= {(b, k): d for k, d in enumerate(own)}
    got = {(r.shard_id, r.shard_pos): r.doc_id for r in sharding.shuffle(docs, 60_000, seed).collect()}
    assert got == want


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, 1, b)) for b in range(6000))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())


# 8


def test_walk_against_dense_matrices(spark):
    rng = np.random.default_rng(7)
    v, seeds = 15, np.array([0, 5, 6, 11])
    dense = np.triu(rng.random((v, v)) * (rng.random((v, v)) < 0.6), 1)
    dense = dense + dense.T
    dense[np.ix_(*[np.setdiff1d(np.arange(v), seeds)] * 2)] = 0
    rows = []
    for a in range(v):
        near = np.array([c for c in seeds if dense[a, c] and (a not in seeds or a < c)], np.int32)
        rows.append((a, bytearray(near.tobytes()), bytearray(dense[a][near].astype(np.float32).tobytes())))
    graph = spark.createDataFrame([r for r in rows if r[1]], "a int, near binary, weight binary")
    restart = np.zeros((v, 2))
    restart[[0, 5], 0], restart[[6, 11], 1] = (0.7, 0.3), (0.4, 0.6)
    degree = dense.sum(0)
    step = dense / np.where(degree > 0, degree, 1)
    p = restart
    for _ in range(300):
        p = toxicity.RESTART * restart + (1 - toxicity.RESTART) * step @ p
    assert np.allclose(toxicity.walk(graph, seeds, restart), p, atol=1e-6)


def test_numbers_of_any_size():
    x = np.random.default_rng(5).integers(0, 1 << 35, 5000) >> np.random.default_rng(6).integers(0, 35, 5000)
    x = np.concatenate((x, [0, 127, 128, (1 << 14) - 1, 1 << 14, (1 << 35) - 1]))
    assert np.array_equal(toxicity._numbers(toxicity._varints(x)[0]), x)


def toxic_texts(n=1500):
    """English-like noise; every fifteenth document has company of filth, five of the 'gutter' without a label."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 600, 30)) for _ in range(n)]
    for i in range(65):
        texts[i] += f" filth a{i} filth" + " gutter filth" * 2 * (i >= 60)
    return texts


def test_edges_are_all_pairs_over_the_thresholds(spark, monkeypatch):
    """Words that are no seeds have edges too; waves, cells and what a task holds at a time leave none out and change no count."""
    rng = np.random.default_rng(11)
    texts = [" ".join({f"w{x}" for x in rng.zipf(1.3, 40) if x < 400} | ({"rare", "company"} if i % 80 == 0 else set())) for i in range(900)]
    terms = [x for x, k in Counter(x for t in texts for x in t.split()).items() if k >= toxicity.MIN_DOCS]
    passages = {frozenset(x for x in t.split() if x in terms) for t in texts} - {frozenset()}
    often, want = Counter(x for p in passages for x in p), {}
    for pair, k in Counter(frozenset((x, y)) for p in passages for x in p for y in p if x < y).items():
        x, y = pair
        if weight := float(toxicity.shifted_ppmi(*(np.array([float(c)]) for c in (k, often[x], often[y])), len(passages))[0]):
            want[pair] = weight
    words = dict(zip(hash_words(terms).tolist(), terms))
    vocabulary = np.array(sorted(words), U)
    place = [words[int(h)] for h in vocabulary]
    for small in ({}, {"HELD": 3000, "PAIRS": 700, "CELL": 500, "WAVE": 20000}):
        for k, x in small.items():
            monkeypatch.setattr(toxicity, k, x)
        graph, edges = toxicity.word_graph(make(spark, texts), vocabulary)
        found = []
        for a, runs, near, weight in (e for b in graph.toArrow().to_batches() for e in edges(b)):
            found += [(frozenset((place[x], place[y])), w) for x, y, w in zip(np.repeat(a, runs), near, weight)]
        assert len(found) == len(dict(found)) and set(dict(found)) == set(want) and frozenset(("rare", "company")) in want
        assert all(abs(w - want[pair]) < 1e-9 for pair, w in found)


def test_edges_are_the_same_by_counters_and_by_cells(spark, monkeypatch):
    """Which words have counters, and where cells, waves and what they hold end, changes no edge; an edge takes few bytes."""
    rng = np.random.default_rng(12)
    docs = make(spark, [" ".join(f"w{x}" for x in rng.zipf(1.3, 60) if x < 400) for _ in range(900)])
    vocabulary = hash_words([f"w{x}" for x in range(1, 400)])
    found = []
    for head, small in ((8192, 1 << 20), (30, 300), (0, 300)):
        for k, x in {"HEAD": head, "HELD": small, "CELL": small, "WAVE": 50 * small}.items():
            monkeypatch.setattr(toxicity, k, x)
        graph, edges = toxicity.word_graph(docs, vocabulary)
        rows = graph.toArrow()
        found.append({(x, y): round(w, 9) for b in rows.to_batches() for a, runs, near, weight in edges(b) for x, y, w in zip(np.repeat(a, runs).tolist(), near.tolist(), weight.tolist())})
        if head > 400:
            assert sum(len(r["steps"]) + len(r["many"]) for r in rows.to_pylist()) < 3 * len(found[0])
    assert len(found[0]) > 100 and found[0] == found[1] == found[2]


TOXIC_LABELS = [(i, 1, int(i < 60)) for i in [*range(60), *range(65, 400)]]


def test_lexicon_against_brute_force(spark):
    """Terms, seeds, passages, weights, walks, polarities and scores again, in plain Python."""
    texts = toxic_texts() + ["", None, "filth " * 300] + [toxic_texts()[61]] * 40
    docs = make(spark, texts)
    known = dict((i, t) for i, _, t in TOXIC_LABELS)
    words = [re.findall(r"[a-z0-9]+", t or "") for t in texts]
    df, toxic, clean, uses = Counter(), Counter(), Counter(), defaultdict(set)
    for i, w in enumerate(words):
        for x in set(w):
            df[x] += 1
            toxic[x] += known.get(i) == 1
            clean[x] += known.get(i) == 0
        if known.get(i) == 1:
            for k, x in enumerate(w):
                uses[x].add((w[k - 1] if k else None, w[k + 1] if k + 1 < len(w) else None))
    terms = {x for x in df if df[x] >= toxicity.MIN_DOCS}
    used = {x: min(toxic[x], len(uses[x])) for x in terms}
    n_toxic, n_clean = sum(known.values()), len(known) - sum(known.values())
    bad = {x for x in terms if used[x] >= toxicity.MIN_USES and toxicity.wilson(np.array([used[x]]), np.array([clean[x]]))[0] >= 0.5}
    fit = [x for x in terms if df[x] <= toxicity.USUAL_DF * len(texts) and clean[x] and toxic[x] * n_clean <= clean[x] * n_toxic]
    good = set(sorted(fit, key=lambda x: (-df[x], hash_words([x])[0]))[: toxicity.CLEAN_SEEDS])
    passages = {frozenset(x for x in w[k : k + toxicity.PASSAGE] if x in terms) for w in words for k in range(0, len(w), toxicity.PASSAGE)} - {frozenset()}
    often = Counter(x for p in passages for x in p)
    names = sorted(terms)
    n = Counter(frozenset((x, y)) for p in passages for x in p for y in p if x < y)
    place, dense = {x: i for i, x in enumerate(names)}, np.zeros((len(names), len(names)))
    for pair, k in n.items():
        x, y = pair
        expected = often[x] * often[y] / len(passages)
        weight = np.log(k / expected) - np.log(toxicity.SHIFT)
        if k >= toxicity.MIN_COUNT and k - expected >= toxicity.MIN_Z * np.sqrt(expected) and weight > 0:
            dense[place[x], place[y]] = dense[place[y], place[x]] = weight
    restart = np.zeros((len(names), 2))
    for column, (own, much) in enumerate(((bad, used), (good, df))):
        for x in own:
            restart[place[x], column] = much[x] / sum(much[y] for y in own)
    step = dense / np.where(dense.sum(0) > 0, dense.sum(0), 1)
    p = restart
    for _ in range(300):
        p = toxicity.RESTART * restart + (1 - toxicity.RESTART) * step @ p
    want = (p[:, 0] - p[:, 1]) / (p.sum(1) + toxicity.NEUTRAL / len(names))
    want = {x: min(0, w) if clean[x] > used[x] else max(w, toxicity.LEXICON) if x in bad else w for x, w in zip(names, want)}
    got = toxicity.induce(docs, known)
    got = dict(zip(got.column("h").to_numpy().view(U).tolist(), got.column("polarity").to_numpy()))
    assert "filth" in bad and want["gutter"] >= toxicity.LEXICON
    assert set(got) == {int(h) for h in hash_words(names)}
    assert all(abs(got[int(hash_words([x])[0])] - want[x]) < 1e-5 for x in names)
    scores = {r.doc_id: (r.score, r.hits) for r in toxicity.score(docs, toxicity.induce(docs, known)).collect()}
    for i, w in enumerate(words):
        hits = [want[x] for x in w if want.get(x, 0) >= toxicity.LEXICON]
        assert scores[i][1] == len(hits) and abs(scores[i][0] - sum(hits)) < 1e-3


def test_walks_find_words_that_are_no_seeds(spark):
    """Half of the certain words may not be seeds. The walks find most of them again, and mark toxic documents better than the seeds left."""
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    known = toxicity.labelled(labels)
    t = toxicity.terms(docs, known)
    certain = t.h[t.toxic_seeds()]
    out = certain[::2]
    lexicon = toxicity.induce(docs, known, held_out=out)
    h, polarity = lexicon.column("h").to_numpy().view(U), lexicon.column("polarity").to_numpy()
    added = np.setdiff1d(h[polarity >= toxicity.LEXICON], certain[1::2])
    kept = pa.table([certain[1::2].view(np.int64), np.ones(len(certain[1::2]))], schema=toxicity.LEXICON_ROWS)
    toxic = [i for i, k in known.items() if k]
    hits = lambda x: {r.doc_id for r in toxicity.score(docs, x).filter("hits > 0").select("doc_id").distinct().collect()} & set(toxic)
    own = np.isin(t.h, added)
    print("held out:", len(out), "found again:", np.isin(out, added).sum(), "added:", len(added), "toxic uses of those added:", t.toxic[own].sum(), "clean:", t.clean[own].sum(), "toxic documents:", len(hits(lexicon)), "by the kept seeds:", len(hits(kept)), "of", len(toxic))
    assert np.isin(out, added).mean() >= 0.5
    assert t.toxic[own].sum() >= 5 * t.clean[own].sum()
    assert len(hits(lexicon)) > len(hits(kept))


def test_toxicity_held_out(spark):
    """A quarter of the labels is held out. Rare words need labelled uses, so recall grows with the labels."""
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    found = {r[0] for r in toxicity.toxic_documents(docs, labels.filter("doc_id % 4 > 0")).select("doc_id").collect()}
    known = {r[0]: r[1] for r in labels.filter("doc_id % 4 = 0").join(docs.select("doc_id"), "doc_id").select("doc_id", "toxic").collect()}
    toxic, clean = ([i for i, t in known.items() if t == k] for k in (1, 0))
    print("held out:", len(found & set(toxic)), "of", len(toxic), "toxic;", len(found & set(clean)), "of", len(clean), "clean")
    assert len(found & set(toxic)) >= 0.75 * len(toxic)
    assert len(found & set(clean)) <= 0.01 * len(clean)


# 9


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate", "packbits"])
def test_codecs_round_trip(compression):
    rng = np.random.default_rng(1)
    for data in (b"", b"a", bytes(5000), rng.bytes(9000), bytes(rng.integers(0, 3, 70_000, dtype=np.uint8))):
        code, encode = tiff.ENCODE[compression]
        assert tiff.DECODE[code](encode(data)) == data


def test_broken_files_give_a_reason(spark):
    good = tiff.render(np.linspace(-1, 1, 64).astype(np.float32), 1)
    rows = [(1, bytearray(good)), (2, bytearray(b"no image")), (3, bytearray(good[: len(good) // 2])), (4, None), (5, bytearray()), (None, bytearray(good))]
    got = tiff.pages(spark.createDataFrame(rows, "id long, data binary")).collect()
    assert sorted(r.page for r in got if r.id == 1) == [0, 1, 2, 3]
    assert [r.error is not None for r in got if r.id == 2] == [True]
    assert any(r.error for r in got if r.id == 3) and not [r for r in got if r.id == 4]
    assert len([r for r in got if r.id is None]) == 4
    assert zlib.crc32(next(r.pixels for r in got if r.id == 1 and r.page == 1)) == zlib.crc32(next(r.pixels for r in got if r.id is None and r.page == 1))


def test_pages_after_a_broken_one_come_out(monkeypatch):
    monkeypatch.setitem(tiff.ENCODE, "jpeg", (7, bytes))
    x = np.arange(3 * 5 * 6 * 2, dtype=np.uint8).reshape(3, 5, 6, 2)
    data = tiff.write_tiff([{"pixels": x[0], "compression": "lzw", "rows": 2}, {"pixels": x[1], "compression": "jpeg", "rows": 2}, {"pixels": x[2], "compression": "none", "planar": 2, "rows": 2}])
    found, error = tiff.read_tiff(data)
    assert error is None and found[1] == {"error": "compression 7"}
    assert np.array_equal(found[0]["pixels"], x[0]) and np.array_equal(found[2]["pixels"], x[2])


# 10


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_pairs(texts, least):
    sets = {i: shingles(t) for i, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def test_near_duplicates_recall_and_clean_documents(spark):
    rng = np.random.default_rng(9)
    base = random_texts(60, 120, seed=10, vocabulary=3000)
    texts = list(base)
    for i in range(30):
        w = base[i].split()
        for at in rng.integers(0, len(w), 1 + i % 6):
            w[at] = f"new{at}"
        texts.append(" ".join(w))
    texts += [base[0]] * 5 + ["short text"] * 2 + ["", None]
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(make(spark, texts)).collect()}
    pairs = brute_pairs(dict(enumerate(texts)), 0.7)
    assert sum(a in got and got[a] == got.get(b) for a, b in pairs) >= 0.9 * len(pairs)
    assert not set(got) & set(range(30, 60))
    kept = {r.doc_id for r in neardup.drop_near_duplicates(make(spark, texts)).collect()}
    assert set(range(60)) <= kept and len(kept & set(got)) == len(set(got.values()))


def test_components_against_union_find(spark):
    rng = np.random.default_rng(12)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 300, (200, 2)) if p[0] != p[1]} | {(i, i + 1) for i in range(400, 430)}
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(sorted(pairs), "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}


def test_densified_agreement_estimates_jaccard():
    rng = np.random.default_rng(13)
    errors = []
    for share in (0.3, 0.6, 0.9):
        for k in range(60):
            common = [f"c{k}x{x}" for x in range(int(60 * share))]
            a, b = ([f"{s}{k}x{j}" for j in range(60 - len(common))] + common for s in "ab")
            jaccard = len(common) / (120 - len(common))
            sig = [s for _, s in neardup.signatures(pa.array([" ".join(rng.permutation(x)) for x in (a, b)]), shingle=1)][0]
            errors.append((sig[0] == sig[1]).mean() - jaccard)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.1
