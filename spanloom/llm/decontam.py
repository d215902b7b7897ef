"""Benchmark decontamination over a positional inverted index.

Training texts are indexed in blocks of documents (about ``BLOCK`` bytes of word hashes): for every term of the block, the
sorted positions of its occurrences, delta-coded. A block is one row of a written table, so the index is as distributed
as the corpus, answers without a shuffle, and serves any number of benchmarks. Positions count words; between documents
there is a gap longer than any phrase or span.

Phrases are all runs of ``PHRASE`` words of a benchmark item (an item with fewer words is one phrase). A block answers all
phrases at once: it takes the postings of each phrase's rarest term in the corpus, shifts them to where the phrase would
begin, and keeps those that the shifted postings of the next rarest term hold too, until all words agree: an exact phrase
match. For proximity (kind ``near``), a document matches if ``MOST`` of an item's ``MOST_TERMS`` rarest distinct terms (of
all, if it has fewer) occur within ``SPAN`` words of an occurrence of one of them, so copies with some words replaced are
found too. The rarest are those of fewest occurrences, terms that the corpus lacks left out; no threshold depends on the
size of the corpus, and text that shares no word with an item changes none of its matches. An item of whose rarest terms
fewer than ``NEAR_TERMS`` would have to meet has phrases only.

Results for odd input: documents or items with null or empty text, or without words, match nothing; null ids are ids like
any other; repeated rows match alike and give one row; an empty table gives an empty result; extra columns are ignored by
``matches`` and kept by ``filter_contaminated``. Items go through in slices of ``ITEMS_BYTES`` of text, so what is sent to
the executors is bounded however large the benchmark is; the index is read once for each slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .tokens import U, word_hashes

PHRASE = 8
NEAR_TERMS = 4
MOST_TERMS, MOST = 8, 0.75
SPAN = 60
BLOCK = 16 << 20
ITEMS_BYTES = 32 << 20
GAP = 1024
#: Candidates that are looked at together.
PORTION = 1 << 20

INDEX = "ids binary, known binary, texts binary, starts binary, terms binary, counts binary, deltas binary"
_FIELDS = pa.schema([(c, pa.binary()) for c in ("ids", "known", "texts", "starts", "terms", "counts", "deltas")])


def _block(ids, known, texts, hashes, offsets) -> pa.RecordBatch:
    words = np.concatenate([np.diff(o) for o in offsets])
    starts = np.concatenate(([0], np.cumsum(words + GAP)))[:-1]
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h = h[order]
    pos = (np.repeat(starts - np.concatenate(([0], np.cumsum(words)))[:-1], words) + np.arange(len(h)))[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
    deltas = np.diff(pos, prepend=0)
    deltas[first] = pos[first]
    wide = len(pos) and int(pos.max()) >= 1 << 31
    cols = [np.concatenate(ids), np.concatenate(known), np.concatenate(texts), starts, h[first], np.diff(np.append(first, len(h))).astype(np.int32), deltas.astype(np.int64 if wide else np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols], schema=_FIELDS)


def _indexer(batches):
    parts, size = ([], [], [], [], []), 0
    for b in batches:
        key, text = b.column(0), b.column(1)
        ids, known = key.fill_null(0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)
        hashed = b.column(2).to_numpy(zero_copy_only=False)
        for first, h, of in word_hashes(text):
            n = len(of) - 1
            for part, x in zip(parts, (ids[first : first + n], known[first : first + n], hashed[first : first + n], h, of)):
                part.append(x)
            size += 8 * len(h)
            if size >= BLOCK:
                yield _block(*parts)
                parts, size = ([], [], [], [], []), 0
    if parts[0]:
        yield _block(*parts)


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of all terms: one row for each block of documents."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__ll_h"))
    return materialise(keyed.mapInArrow(_indexer, INDEX), "postings")


#: A place in a list of postings: the term's number above, the position below.
PLACE = np.int64(40)


class Block:
    """The posting lists of one block of documents for the terms of a sorted vocabulary."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.texts, self.starts = np.frombuffer(row["texts"], np.int64), np.frombuffer(row["starts"], np.int64)
        terms, counts = np.frombuffer(row["terms"], U), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        all_ = int(counts.sum())
        deltas = np.frombuffer(row["deltas"], np.int32 if len(row["deltas"]) == 4 * all_ else np.int64)
        at = np.searchsorted(terms, vocabulary)
        at[at == len(terms)] = 0
        have = np.flatnonzero(terms[at] == vocabulary) if len(terms) else np.zeros(0, int)
        self.count, self.first = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        n = counts[at[have]]
        begin = np.cumsum(n) - n
        self.count[have], self.first[have] = n, begin
        source = np.cumsum(counts) - counts
        pos = np.cumsum(deltas[np.repeat(source[at[have]] - begin, n) + np.arange(int(n.sum()))], dtype=np.int64)
        if len(have):
            pos -= np.repeat(np.concatenate(([0], pos[begin[1:] - 1])), n)
        self.places = (np.repeat(have, n) << PLACE) + pos

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``terms``, position) of every occurrence of each."""
        n = self.count[terms]
        own = np.repeat(np.arange(len(terms)), n)
        pos = self.places[np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(len(own))]
        return own, pos & ((1 << PLACE) - 1)

    def phrases(self, runs: np.ndarray, order: np.ndarray):
        """(run, position where it begins) of all matches; ``order``: each run's places, the rarest term's first."""
        rows = np.flatnonzero((self.count[runs] > 0).all(1))
        lead = runs[rows, order[rows, 0]]
        for i, j in portions(self.count[lead], PORTION):
            own, pos = self.postings(lead[i:j])
            run = rows[i:j][own]
            pos = pos - order[run, 0]
            for o in range(1, runs.shape[1]):
                place = order[run, o]
                hit = _in((runs[run, place] << PLACE) + pos + place, self.places)
                run, pos = run[hit], pos[hit]
            yield run, pos

    def near(self, terms: np.ndarray, need: np.ndarray, span: int):
        """(item, position) of the occurrences of rare terms that have ``need`` of the item's terms within ``span``, their own among them.

        ``terms``: a row for each item, rarest first, -1 where it has no more.
        """
        have = (terms >= 0) & (self.count[terms] > 0)
        rows = np.flatnonzero((have.sum(1) >= need) & (need > 0))
        # Of any ``need`` terms one is among the first.
        item, column = np.nonzero(have[rows] & (np.arange(terms.shape[1])[None] <= ((terms >= 0).sum(1) - need)[rows][:, None]))
        item = rows[item]
        lead = terms[item, column]
        for i, j in portions(self.count[lead], PORTION):
            own, pos = self.postings(lead[i:j])
            which = item[i:j][own]
            n = np.zeros(len(pos), np.int64)
            for o in range(terms.shape[1]):
                t = terms[which, o]
                low = (t << PLACE) + np.maximum(pos - span, 0)
                at = np.minimum(np.searchsorted(self.places, low), len(self.places) - 1)
                n += (t >= 0) & (self.places[at] >= low) & (self.places[at] <= (t << PLACE) + pos + span)
            hit = n >= need[which]
            yield which[hit], pos[hit]

    def docs(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, pos, "right") - 1


def portions(sizes: np.ndarray, most: int):
    """Ranges of about ``most`` in all."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _in(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    i = np.searchsorted(sorted_, x)
    i[i == len(sorted_)] = 0
    return sorted_[i] == x


def rare_terms(terms: list[int], freq: np.ndarray) -> tuple[list[int], int]:
    """The rarest distinct terms of an item that the corpus has, and how many have to meet; none if too few are there."""
    n = min(MOST_TERMS, len(set(terms)))
    need = int(np.ceil(MOST * n))
    found = sorted((t for t in set(terms) if freq[t]), key=lambda t: (freq[t], t))[:n]
    return (found, need) if len(found) >= need >= NEAR_TERMS else ([], 0)


class Plan:
    """What to ask of every block: runs by length with their items, and the rare terms of each item."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], freq: np.ndarray, n: int):
        self.ids = sorted({i for i, _ in items}, key=lambda i: (i is None, i))
        number = {i: k for k, i in enumerate(self.ids)}
        by_length: dict[int, tuple[list, list]] = {}
        for i, terms in items:
            for k in range(max(1, len(terms) - n + 1)):
                run = terms[k : k + n]
                rows, owners = by_length.setdefault(len(run), ([], []))
                rows.append(run)
                owners.append(number[i])
        self.runs = []
        for rows, owners in by_length.values():
            runs = np.array(rows, np.int64)
            self.runs.append((runs, np.argsort(freq[runs], axis=1, kind="stable"), np.array(owners)))
        rare = [(number[i], *rare_terms(terms.tolist(), freq)) for i, terms in items]
        self.near = np.full((len(rare), MOST_TERMS), -1, np.int64)
        for k, (_, found, _) in enumerate(rare):
            self.near[k, : len(found)] = found
        self.need, self.near_of = np.array([r[2] for r in rare], np.int64), np.array([r[0] for r in rare], np.int64)


FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("hits", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def _rows(block: Block, ids: list, kind: str, item: np.ndarray, pos: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """One row for each document and item of the matches."""
    doc = block.docs(pos)
    order = np.lexsort((pos, item, doc))
    doc, item, pos = doc[order], item[order], pos[order] - block.starts[doc[order]]
    end = pos + length[order] - 1
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))))
    d = doc[first]
    cols = [pa.array(block.ids[d], mask=~block.known[d]), pa.array(block.texts[d]), pa.array([ids[k] for k in item[first]], pa.int64()), pa.array([kind] * len(d)), pa.array(np.diff(np.append(first, len(doc)))), pa.array(pos[first]), pa.array(np.maximum.reduceat(end, first))]
    return pa.RecordBatch.from_arrays(cols, schema=FOUND)


def _asker(sent, n: int):
    def run(batches):
        vocabulary, items, freq = sent.value
        plan = Plan(items, freq, n)
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, vocabulary)
                parts = [(item[r], pos, np.full(len(pos), runs.shape[1])) for runs, order, item in plan.runs for r, pos in block.phrases(runs, order)]
                near = [(plan.near_of[i], pos, np.ones(len(pos), np.int64)) for i, pos in block.near(plan.near, plan.need, SPAN)]
                for kind, found in (("phrase", parts), ("near", near)):
                    item, pos, length = (np.concatenate(x) for x in zip(*found)) if found else ((),) * 3
                    if len(item):
                        yield _rows(block, plan.ids, kind, item, pos, length)

    return run


def _frequencies(vocabulary):
    def run(batches):
        for b in batches:
            for terms, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, n = np.frombuffer(terms, U), np.frombuffer(counts, np.int32)
                at = np.searchsorted(h, vocabulary.value)
                at[at == len(h)] = 0
                hit = np.flatnonzero(h[at] == vocabulary.value) if len(h) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n[at[hit]].astype(np.int64))], ["term", "n"])

    return run


def search(index: DataFrame, benchmark: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """doc_id, text_hash, item_id, kind (phrase or near), hits, first_word, last_word; one row for each document, item and kind."""
    send = index.sparkSession.sparkContext.broadcast
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // ITEMS_BYTES))
    out = None
    for s in range(slices):
        rows = sorted((r for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == s).collect()), key=lambda r: (r.item_id is None, r.item_id, r.text))
        hashed: list[np.ndarray] = []
        for _, h, of in word_hashes(pa.array([r.text for r in rows], pa.large_string())):
            hashed += [h[of[i] : of[i + 1]] for i in range(len(of) - 1)]
        vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, U)
        freq = np.zeros(len(vocabulary), np.int64)
        for term, n in index.select("terms", "counts").mapInArrow(_frequencies(send(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n")).collect():
            freq[term] = n
        asked = [(r.item_id, np.searchsorted(vocabulary, h)) for r, h in zip(rows, hashed) if len(h)]
        found = index.mapInArrow(_asker(send((vocabulary, asked, freq)), phrase), "doc_id long, text_hash long, item_id long, kind string, hits long, first_word long, last_word long").distinct()
        out = found if out is None else out.union(found)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """The matches of all documents, over an index made for the purpose."""
    return search(build_index(docs), benchmark, phrase)


def filter_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that match no item, with all their columns."""
    bad = materialise(matches(docs, benchmark, **params).select(F.col("text_hash").alias("__ll_bad")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64("text") == F.col("__ll_bad"), "left_anti")
