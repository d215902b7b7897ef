"""Toxicity by lexicon induction.

Toxic seeds are the terms whose labelled documents are toxic for sure by a Wilson bound (uses in the same words count
once, so copies of one document prove nothing); clean seeds are the ``CLEAN_SEEDS`` most usual terms that don't favour
documents labelled toxic. A walk restarts at a seed in proportion to its documents. Texts are cut into passages of
``PASSAGE`` words; passages of the same terms count once, so copies and shared passages prove nothing either. The word
graph joins any two terms that share passages more often than chance (``MIN_COUNT`` passages and ``MIN_Z``
deviations at least), weighted by their positive pointwise mutual information less log ``SHIFT``. Random walks
with restart from the toxic and from the clean seeds go over all its edges, and give each term two
probabilities; their difference over their sum, plus ``NEUTRAL`` / V, so that terms which neither walk reaches often stay
neutral, is its polarity. Labels outrank the walks: a term with more clean labelled documents than
toxic uses, of those in the same words one, has no polarity above 0, and a toxic seed has ``LEXICON`` at least. A document's score is the sum of the polarities of its terms of ``LEXICON`` or more; it is toxic from
the score on that best tells the labelled documents apart, a clean one wrongly found counting as two missed.

Terms are the words of ``MIN_DOCS`` documents or more: rarer ones can't have ``MIN_COUNT`` passages of evidence worth the
name. All pairs of terms in a passage are counted, each as a pair of the rarer term. Pairs of the ``HEAD`` most usual terms
have a counter each in every task. Of the rest, ranges of rarer terms (cells) get the passages that hold them, so that each pair is
counted in one place; cells go in waves. Counts of all words and all distinct passages are shuffled, so nothing depends on where
a document is read. The vocabulary grows with the corpus; passages travel to cells, and the driver holds a few numbers a term.

Results for odd input: null, empty or wordless text scores nothing; a null doc_id is scored but never labelled; repeated
rows are scored alike; without labels of both kinds there are no seeds and nothing is toxic; an empty table gives an empty
result; extra columns are ignored. Equal terms are ranked by hash.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import best_cut
from .shared import materialise
from .tokens import U, mix, word_hashes

#: At most so many labelled documents give seeds and cut, by the hash of their ids.
MAX_LABELS = 50_000
CLEAN_SEEDS = 200
#: Words that toxic documents use so often, in different contexts, may be toxic seeds.
MIN_USES = 5
#: Deviations of the Wilson bound on the share of toxic documents among those with a seed; the bound is half at least.
SURE = 3.0
#: Clean seeds are in a tenth of the documents at most: the company of a word that is everywhere says nothing.
MIN_DOCS, USUAL_DF = 5, 0.1
PASSAGE = 128
MIN_COUNT, MIN_Z, SHIFT = 3, 3.0, 2.0
RESTART = 0.15
NEUTRAL = 2.0
LEXICON = 0.6
#: The most usual terms, of whose pairs each has a counter.
HEAD = 8192
#: Terms of passages that a cell holds before it counts their pairs, and edges that travel together: few, so that a core's cache holds their numbers.
HELD, PAIRS = 8_000_000, 1 << 17
#: Uses of pairs that a cell counts at least, and how many cells there are at most.
CELL, CELLS = 6_000_000, 8192
#: Uses of pairs that a wave counts at least, and waves at most: disk is bounded by a share of the passages sent.
WAVE, WAVES = 200_000_000, 12
#: Terms whose numbers travel together.
PART = 1 << 16
#: What the walks may lack at a term, as a share of NEUTRAL / V, and steps of their solution at most.
EXACT, MOST_STEPS = 1e-6, 200


def labelled(labels: DataFrame, most: int = MAX_LABELS) -> dict[int, int]:
    one = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return {i: t for i, t in one.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(most).collect()}


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (word, text) once."""
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    n = int(doc.max(initial=0)) + 1
    key = (np.cumsum(new) - 1) * n + doc[order]
    key.sort()
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    word = key // n
    return h[new][word], key - word * n


class _Counts:
    """Sums of rows of numbers by uint64 key, merged from time to time."""

    def __init__(self, width: int):
        self.keys, self.values, self.size, self.width = [], [], 0, width

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(keys)
        self.values.append(values)
        self.size += len(keys)
        if self.size > 4_000_000:
            self.merge()
            self.size = 0

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, U)
        values = np.concatenate(self.values) if self.values else np.zeros((0, self.width), np.int64)
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, values = keys[first], np.add.reduceat(values, first, axis=0)
        self.keys, self.values = [keys], [values]
        return keys, values


def _counter(known):
    def run(batches):
        toxic, clean = known.value
        counts, n = _Counts(3), 0
        for b in batches:
            key = b.column(0)
            ids, valid = key.fill_null(0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)
            kind = np.zeros((b.num_rows, 3), np.int64)
            kind[:, 0] = 1
            kind[:, 1], kind[:, 2] = valid & np.isin(ids, toxic), valid & np.isin(ids, clean)
            n += b.num_rows
            for first, h, of in word_hashes(b.column(1)):
                h, doc = _distinct(h, np.repeat(np.arange(len(of) - 1), np.diff(of)))
                if len(h):
                    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                    counts.add(h[new], np.add.reduceat(kind[first + doc], new, axis=0))
        keys, values = counts.merge()
        cols = [pa.concat_arrays([pa.array(c), pa.array([x], pa.int64())]) for c, x in zip((keys.view(np.int64), *values.T), (None, n, 0, 0))]
        yield pa.RecordBatch.from_arrays(cols, ["h", "df", "toxic", "clean"])

    return run


def _contexts(batches):
    """Each use of a word with its neighbours: copies of a text are one use."""
    for b in batches:
        for _, h, of in word_hashes(b.column(0)):
            if not len(h):
                continue
            doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
            at = np.arange(len(h))
            before = np.where(at > of[doc], np.roll(h, 1), U(0))
            after = np.where(at + 1 < of[doc + 1], np.roll(h, -1), U(0))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(mix(before * U(3) + after).view(np.int64))], ["h", "context"])


def wilson(hits: np.ndarray, misses: np.ndarray) -> np.ndarray:
    """The lower Wilson bound of hits / (hits + misses) at SURE deviations."""
    m = np.maximum(1, hits + misses)
    share = hits / m
    return np.round((share + SURE**2 / 2 / m - SURE * np.sqrt(share * (1 - share) / m + SURE**2 / 4 / m / m)) / (1 + SURE**2 / m), 9)


COUNTS = pa.schema([("cell", pa.int32()), ("size", pa.int64()), ("many", pa.binary())])
COUNTS_SQL = "cell int, size long, many binary"
SENT = pa.schema([("cell", pa.int32()), ("terms", pa.binary()), ("sizes", pa.binary())])
SENT_SQL = "cell int, terms binary, sizes binary"
EDGES = pa.schema([("terms", pa.binary()), ("runs", pa.binary()), ("jumps", pa.binary()), ("size", pa.int64()), ("steps", pa.binary()), ("many", pa.binary())])
EDGES_SQL = "terms binary, runs binary, jumps binary, size long, steps binary, many binary"


def _pack(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed; planes of zeros are left out."""
    planes = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([planes]) + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :planes].T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(memoryview(data)[1:], n * data[0], "zstd"), np.uint8).reshape(data[0], n)
    out = raw[0].astype(kind)
    for k in range(1, data[0]):
        out |= raw[k].astype(kind) << kind(8 * k)
    return out


def _cells(work: np.ndarray, low: int) -> np.ndarray:
    """Bounds of ranges of the terms from ``low`` on that are the rarer ones of about equally many pairs."""
    most = max(CELL, int(work[low:].sum()) // CELLS)
    return np.unique([low, *(low + np.flatnonzero(np.diff(np.cumsum(work[low:]) // most, prepend=0))).tolist(), len(work)])


def _batches(rows: list[dict], schema: pa.Schema):
    for k in range(0, len(rows), 500):
        yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema=schema)


def _parts(x: np.ndarray):
    """Rows of numbers by term, in parts."""
    for k in range(0, x.shape[1], PART):
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x[:, k : k + PART].tobytes()], pa.binary())], ["first", "numbers"])


def _total(parts: DataFrame, n: int, v: int, kind) -> np.ndarray:
    """The sum of what the tasks made by ``_parts``, in an order that doesn't depend on arrival."""

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind) for x in sorted(rows.column("numbers").to_pylist()))
        return pa.table({"first": rows.column("first")[:1], "numbers": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((n, v), kind)
    for first, numbers in parts.groupBy("first").applyInArrow(added, "first long, numbers binary").collect():
        out[:, first : first + PART] = np.frombuffer(numbers, kind).reshape(n, -1)
    return out


def _grouped(run):
    """``run`` with the types that tell Spark to hand it a group batch by batch."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    grouped.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return grouped


def _free(spark) -> None:
    """Has Spark delete the shuffle files of what is over; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, and how many bytes each number has."""
    size = np.ones(len(x), np.int64)
    for bits in range(7, 35, 7):
        size += x >= 1 << bits
    out, at = np.empty(int(size.sum()), np.uint8), np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = (x[some] >> (7 * k) & 127) | (size[some] > k + 1) << 7
    return out, size


def _numbers(b: np.ndarray) -> np.ndarray:
    """What _varints made."""
    last = np.flatnonzero(b < 128)
    out, size = b[last].astype(np.int64), np.diff(last, prepend=-1)
    more = np.flatnonzero(size > 1)
    for k in range(1, int(size.max(initial=0))):
        more = more[size[more] > k]
        out[more] = out[more] << 7 | b[last[more] - k] & 127
    return out


def _finder(words: np.ndarray):
    """Looks up hashes among sorted ones: their places, and which are there. Hashes are spread evenly, so the first bits lead close."""
    bits = max(1, len(words).bit_length())
    begin = np.searchsorted(words, np.arange(1 << bits, dtype=U) << U(64 - bits))
    padded = np.append(words, U(0xFFFFFFFFFFFFFFFF))

    def find(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = begin[(h >> U(64 - bits)).astype(np.int64)]
        on = np.flatnonzero(padded[at] < h)
        while len(on):
            at[on] += 1
            on = on[padded[at[on]] < h[on]]
        return at, (padded[at] == h) & (at < len(words))

    return find


def _passages(vocabulary):
    """The distinct terms of each passage, most usual first, and their hash."""

    def run(batches):
        vocab = vocabulary.value
        order = np.argsort(vocab)
        find, place_of = _finder(vocab[order]), order
        marks = mix(vocab ^ U(0x5851F42D4C957F2D))
        for b in batches:
            for _, h, of in word_hashes(b.column(0)):
                n = np.diff(of)
                passages = -(-n // PASSAGE)
                if not len(h) or not len(vocab):
                    continue
                place = np.arange(len(h)) - np.repeat(of[:-1], n)
                passage = np.repeat(np.cumsum(passages) - passages, n) + place // PASSAGE
                at, hit = find(h)
                key = passage[hit] * len(vocab) + place_of[at[hit]]
                key.sort()
                key = key[np.flatnonzero(np.diff(key, prepend=-1))]
                passage = key // len(vocab)
                term = key - passage * len(vocab)
                first = np.flatnonzero(np.diff(passage, prepend=-1))
                if not len(first):
                    continue
                steps = np.diff(term, prepend=0)
                steps[first] = term[first]
                data, size = _varints(steps)
                ends = np.concatenate((np.cumsum(size)[first[1:] - 1], [len(data)]))
                sums = np.add.reduceat(marks[term], first)
                terms = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(mix(sums).view(np.int64)), terms], ["h", "terms"])

    return run


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], ends[:-1])) if len(ends) else ends


def _decoded(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Terms of passages that have so many up to their ends."""
    steps = _numbers(data)
    total = np.cumsum(steps)
    first = _starts(ends)
    return total - np.repeat(total[first] - steps[first], np.diff(ends, prepend=0))


def _terms_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of the passages of a batch, where each passage ends, and the bytes that they were."""
    column = b.column(0).cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, bytes_to = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at[1:] - at[0]
    ends = np.cumsum(data < 128)[bytes_to - 1]
    return _decoded(data, ends), ends, data


def _slices(batches):
    """Parts of the batches that are small enough for a core's cache."""
    for b in batches:
        for k in range(0, b.num_rows, 2000):
            yield b.slice(k, 2000)


def _facts(v: int):
    """Passages of each term, and its pairs with the terms before it in them."""

    def run(batches):
        out = np.zeros((2, v), np.int64)
        for b in _slices(batches):
            term, ends, _ = _terms_of(b)
            np.add.at(out[0], term, 1)
            np.add.at(out[1], term, np.arange(len(term)) - np.repeat(_starts(ends), np.diff(ends, prepend=0)))
        yield from _parts(out)

    return run


def _pieces(low: np.ndarray) -> list[int]:
    """Bounds of ranges of terms with about a million counters; ``low`` has how many counters come before each term's."""
    return np.unique(np.concatenate((np.flatnonzero(np.diff(low >> 20, prepend=-1)), [len(low) - 1]))).tolist()


def _head(v: int):
    """Counts of passages by pairs of terms under ``v``, each in a counter of its own."""
    low = np.arange(v + 1) * np.arange(-1, v) // 2

    def run(batches):
        count = np.zeros(low[-1], np.uint32)

        def passed():
            rows = []
            for a, z in zip(cuts := _pieces(low), cuts[1:]):
                if (some := count[low[a] : low[z]]).any():
                    rows.append({"cell": a, "size": len(some), "many": _pack(some)})
            return _batches(rows, COUNTS)

        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            if seen + b.num_rows >= 1 << 32:
                yield from passed()
                count[:], seen = 0, 0
            seen += b.num_rows
            term, ends, _ = _terms_of(b)
            first = _starts(ends)
            size = np.add.reduceat(term < v, first, dtype=np.int64)
            order = np.argsort(size, kind="stable")
            for k in np.unique(size[size > 1]).tolist():
                # passages of equally many terms: a row for each place in them
                own = first[order[np.searchsorted(size[order], k) : np.searchsorted(size[order], k, "right")]]
                own = term[own + np.arange(k)[:, None]]
                for j in range(1, k):
                    np.add.at(count, (low[own[j]] + own[:j]).reshape(-1), np.uint32(1))
        yield from passed()

    return run


def _sender(bounds, low: int, high: int):
    """For each of the cells of terms from ``low`` up to ``high``, the passages with such terms, up to the last of them."""

    def run(batches):
        cells = bounds.value
        for b in _slices(batches):
            term, ends, data = _terms_of(b)
            at = np.flatnonzero((term >= low) & (term < high))
            cell = np.searchsorted(cells, term[at], "right") - 1
            passage = np.searchsorted(ends, at, "right")
            last = np.flatnonzero((np.diff(cell, append=-1) != 0) | (np.diff(passage, append=-1) != 0))
            last = last[np.argsort(cell[last], kind="stable")]
            at, cell, passage = at[last], cell[last], passage[last]
            bytes_to = np.concatenate(([0], np.flatnonzero(data < 128) + 1))
            first = _starts(ends)[passage]
            begin, n = bytes_to[first], bytes_to[at + 1] - bytes_to[first]
            rows, sizes = [], (at + 1 - first).astype(np.int32)
            new = np.flatnonzero(np.diff(cell, prepend=-1))
            for i, j in zip(new.tolist(), [*new[1:].tolist(), len(cell)]):
                m = n[i:j]
                place = np.repeat(begin[i:j] - (np.cumsum(m) - m), m)
                place += np.arange(len(place))
                rows.append({"cell": int(cell[i]), "terms": data[place].tobytes(), "sizes": sizes[i:j].tobytes()})
            yield from _batches(rows, SENT)

    return run


def _pairs(term: np.ndarray, ends: np.ndarray, low: int, high: int, v: int):
    """Pairs (first term times V plus second term) of terms from ``low`` up to ``high`` with those before them in passages, sorted, and their counts."""
    keys, counts, wide = [], [], max(1, (1 << 32) // v)
    every = np.flatnonzero((term >= low) & (term < high))
    before = every - _starts(ends)[np.searchsorted(ends, every, "right")]
    for a in range(low, high, wide):
        some = slice(None) if high - low <= wide else (term[every] >= a) & (term[every] < a + wide)
        at, n = every[some], before[some]
        to = np.cumsum(n)
        key = np.empty(int(to[-1]) if len(to) else 0, np.uint32 if v <= 1 << 32 else U)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(to, np.arange(PAIRS, len(key), PAIRS)), [len(at)]))).tolist()
        for i, j in zip(cuts, cuts[1:]):
            m, begin = n[i:j], int(to[i] - n[i])
            place = np.repeat(at[i:j] - to[i:j] + begin, m)
            place += np.arange(len(place))
            key[begin : begin + len(place)] = term[place] + np.repeat((term[at[i:j]].astype(np.int64) - a) * v, m)
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
        keys.append(key[first].astype(U) + U(a * v))
        counts.append(np.diff(first, append=len(key)))
    return np.concatenate(keys), np.concatenate(counts)


def _edge_rows(a: np.ndarray, near: np.ndarray, n: np.ndarray, often: np.ndarray, passages: int):
    """The edges among pairs and their counts: runs of terms, and the steps from each term that they are joined to, to the next."""
    use = np.flatnonzero(n >= MIN_COUNT)
    use = use[shifted_ppmi(n[use], often[a[use]], often[near[use]], passages) > 0]
    a, near, n, rows = a[use], near[use], np.minimum(n[use], (1 << 32) - 1).astype(np.uint32), []
    for k in range(0, len(a), PAIRS):
        x, y = a[k : k + PAIRS], near[k : k + PAIRS]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        steps = np.diff(y, prepend=0)
        jumps, steps[first] = steps[first], 0
        numbers = {"terms": x[first], "runs": np.diff(first, append=len(x)), "jumps": jumps}
        rows.append({c: m.astype(np.int32).tobytes() for c, m in numbers.items()} | {"size": len(x), "steps": _pack(steps.astype(np.uint32)), "many": _pack(n[k : k + PAIRS])})
    return _batches(rows, EDGES)


def _head_edges(facts, v: int):
    """The edges of a piece of the counters of ``_head``."""
    low = np.arange(v + 1) * np.arange(-1, v) // 2

    def run(batches):
        often, passages = facts.value
        count = 0
        for b in batches:
            for r in b.to_pylist():
                count, begin = count + _unpack(r["many"], r["size"], np.uint32).astype(np.int64), int(low[r["cell"]])
        pair = np.flatnonzero(count >= MIN_COUNT)
        a = np.searchsorted(low, pair + begin, "right") - 1
        yield from _edge_rows(a, pair + begin - low[a], count[pair], often, passages)

    return run


def _tail_edges(facts, bounds, v: int):
    """The edges of a cell, from the passages that ``_sender`` gave it."""

    def run(batches):
        (often, passages), cells = facts.value, bounds.value
        terms, sizes, size, known = [], [], 0, None

        def counted():
            keys, n = _pairs(np.concatenate(terms), np.cumsum(np.concatenate(sizes)), int(cells[cell]), int(cells[cell + 1]), v)
            terms.clear()
            sizes.clear()
            if known is None:
                return keys, n
            keys, n = np.concatenate((known[0], keys)), np.concatenate((known[1], n))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        for b in batches:
            for k in range(0, b.num_rows, 4):
                cell, data, own = (x.to_pylist() for x in b.slice(k, 4).columns)
                cell, data, own = cell[0], np.frombuffer(b"".join(data), np.uint8), np.frombuffer(b"".join(own), np.int32).astype(np.int64)
                terms.append(_decoded(data, np.cumsum(own)).astype(np.int32))
                sizes.append(own)
                size += len(terms[-1])
                if size >= HELD:
                    known, size = counted(), 0
        if terms:
            known = counted()
        keys, n = known
        use = n >= MIN_COUNT
        keys, n = keys[use], n[use]
        a = (keys // U(v)).astype(np.int64)
        yield from _edge_rows(a, keys.astype(np.int64) - a * v, n, often, passages)

    return run


def shifted_ppmi(n: np.ndarray, a: np.ndarray, b: np.ndarray, passages: int) -> np.ndarray:
    """The weight of pairs that share n passages, their ends being in a and b of them; 0: no edge."""
    expected = a * (b / passages)
    weight = np.log(np.maximum(n, 1) / np.maximum(expected, 1e-300)) - np.log(SHIFT)
    return np.where((n >= MIN_COUNT) & (n - expected >= MIN_Z * np.sqrt(expected)) & (weight > 0), weight, 0)


def _weighed(facts):
    """Reads the edges of ``word_graph``: terms, how many edges each has here, the other ends and the weights."""

    def edges(b):
        often, passages = facts.value
        rare, logs = np.log(np.maximum(often, 1)), np.log(np.maximum(np.arange(256), 1))
        for terms, runs, jumps, size, steps, many in zip(*(b.column(c).to_pylist() for c in range(6))):
            a, runs = np.frombuffer(terms, np.int32), np.frombuffer(runs, np.int32)
            near = _unpack(steps, size, np.int64)
            near[np.cumsum(runs) - runs] = np.frombuffer(jumps, np.int32)
            near = np.cumsum(near)
            weight = logs[_unpack(many, size, np.uint8)] if many[0] == 1 else np.log(_unpack(many, size, np.uint32).astype(float))
            weight -= rare[near]
            weight += np.repeat(np.log(passages / SHIFT) - rare[a], runs)
            yield a, runs, near, weight

    return edges


def _listed(b):
    """Reads edges that come as rows of a term, the other ends and the weights."""
    near, weight = ([np.frombuffer(x, kind) for x in b.column(c).to_pylist()] for c, kind in ((1, np.int32), (2, np.float32)))
    if near:
        yield b.column(0).to_numpy(), np.array([len(x) for x in near]), np.concatenate(near), np.concatenate(weight).astype(float)


def _product(sent, edges):
    """The weights, as a symmetric matrix of which each edge is held once, times each row of the numbers sent."""

    def run(batches):
        # arrays that travelled have a dtype of their own, with which np.add.at takes its slow way
        y, x = np.zeros(sent.value.shape), np.zeros(sent.value.shape)
        x[:] = sent.value
        for b in batches:
            for a, runs, near, weight in edges(b):
                first = np.cumsum(runs) - runs
                for own, out in zip(x, y):
                    np.add.at(out, a, np.add.reduceat(own[near] * weight, first))
                    np.add.at(out, near, np.repeat(own[a], runs) * weight)
        yield from _parts(y)

    return run


def walk(graph: DataFrame, seed_terms: np.ndarray, restart: np.ndarray, edges=_listed) -> np.ndarray:
    """(V, 2): where random walks are that restart at the seeds by two distributions (columns of ``restart`` that sum to 1).

    The walks' equations, scaled by the roots of the degrees, are symmetric and have a condition of (2 - RESTART) / RESTART
    at most, so conjugate gradients solve them in few steps whatever the graph: each is a product with the edges, of which
    the driver gets a few numbers a term. They end when no term lacks more than ``EXACT`` of what keeps
    terms neutral. ``graph`` has each edge once, and ``edges`` reads its batches.
    """
    v = restart.shape[0]
    context = graph.sparkSession.sparkContext
    graph = graph.coalesce(context.defaultParallelism)

    def times(x: np.ndarray) -> np.ndarray:
        sent = context.broadcast(x)
        out = _total(graph.mapInArrow(_product(sent, edges), "first long, numbers binary"), len(x), v, float)
        sent.destroy()
        return out

    start = np.zeros((2, v))
    start[:, seed_terms] = RESTART * restart[seed_terms].T
    root = np.sqrt(times(np.ones((1, v)))[0])
    inverse = np.divide(1, root, out=np.zeros(v), where=root > 0)
    x, lack = np.zeros((2, v)), start * inverse
    to, size = lack, (lack**2).sum(1, keepdims=True)
    for k in range(1, MOST_STEPS + 1):
        if np.abs(lack * root).max() <= EXACT * NEUTRAL / v:
            break
        image = to - (1 - RESTART) * times(to * inverse) * inverse
        step = size / np.maximum((to * image).sum(1, keepdims=True), 1e-300)
        x, lack = x + step * to, lack - step * image
        last, size = size, (lack**2).sum(1, keepdims=True)
        to = lack + size / np.maximum(last, 1e-300) * to
        if k % 4 == 0:
            _free(graph.sparkSession)
    return np.where(root > 0, x * root, start).T


LEXICON_ROWS = pa.schema([("h", pa.int64()), ("polarity", pa.float64())])


class Terms:
    """The vocabulary, sorted by hash: documents and labelled documents of each term, and its toxic uses in different contexts."""

    def __init__(self, rows: pa.Table, uses: pa.Table, n_docs: int, n_toxic: int, n_clean: int):
        h, df, toxic, clean = (rows.column(c).to_numpy() for c in ("h", "df", "toxic", "clean"))
        order = np.argsort(h.view(U))
        self.h, self.df, self.toxic, self.clean = h.view(U)[order], df[order], toxic[order], clean[order]
        keys, n = uses.column("h").to_numpy().view(U), uses.column("count").to_numpy()
        place = np.searchsorted(self.h, keys)
        known = np.flatnonzero(self.h[np.minimum(place, len(self.h) - 1)] == keys) if len(self.h) else np.zeros(0, int)
        used = np.zeros(len(order), np.int64)
        used[place[known]] = n[known]
        self.used = np.minimum(self.toxic, used)
        self.n_docs, self.n_toxic, self.n_clean = n_docs, n_toxic, n_clean

    def toxic_seeds(self) -> np.ndarray:
        """Places of the terms that the labels make certain."""
        return np.flatnonzero((self.used >= MIN_USES) & (wilson(self.used, self.clean) >= 0.5))

    def clean_seeds(self, most: int) -> np.ndarray:
        fit = (self.df <= USUAL_DF * self.n_docs) & (self.clean > 0) & (self.toxic * self.n_clean <= self.clean * self.n_toxic)
        order = np.lexsort((self.h, -self.df))
        return order[fit[order]][:most]


def terms(docs: DataFrame, known: dict[int, int]) -> Terms:
    send = docs.sparkSession.sparkContext.broadcast
    toxic, clean = (np.array(sorted(i for i, t in known.items() if t == k), np.int64) for k in (1, 0))
    text = docs.select("doc_id", "text")
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in toxic], "doc_id long")
    uses = text.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(_contexts, "h long, context long").distinct()
    uses = uses.groupBy("h").count().toArrow()
    counted = text.mapInArrow(_counter(send((toxic, clean))), "h long, df long, toxic long, clean long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("df", "toxic", "clean")))
    found = materialise(counted.filter((F.col("df") >= MIN_DOCS) | F.col("h").isNull()), "terms")
    n = next((r[0] for r in found.filter("h is null").select("df").collect()), 0)
    return Terms(found.filter("h is not null").toArrow(), uses, n, len(toxic), len(clean))


def word_graph(docs: DataFrame, vocabulary: np.ndarray):
    """All edges between terms (their places), each once, and what reads them: the argument ``edges`` of ``walk``.

    Any order of the vocabulary is right; with the most usual terms first most pairs are counted by ``_head``. The others are counted
    in waves of rarer terms, each with about as many pairs, so that of the passages under way only a wave's are on disk.
    """
    spark, v = docs.sparkSession, len(vocabulary)
    context = spark.sparkContext
    send, tasks = context.broadcast, context.defaultParallelism
    passages = docs.select("text").mapInArrow(_passages(send(vocabulary)), "h long, terms binary").groupBy("h").agg(F.first("terms").alias("terms"))
    passages = materialise(passages.select("terms"), "passages")
    often, work = _total(passages.coalesce(tasks).mapInArrow(_facts(v), "first long, numbers binary"), 2, v, np.int64)
    _free(spark)
    head = min(HEAD, v)
    cells = _cells(work, head)
    bounds, facts = send(cells), send((often, max(1, passages.count())))
    graph = passages.coalesce(tasks).mapInArrow(_head(head), COUNTS_SQL).groupBy("cell").applyInArrow(_grouped(_head_edges(facts, head)), EDGES_SQL)
    graph = materialise(graph.coalesce(tasks), "edges")
    _free(spark)
    to = np.cumsum(work[head:])
    total = int(to[-1]) if len(to) else 0
    waves = min(WAVES, 1 + total // WAVE)
    cuts = head + np.searchsorted(to, total * np.arange(1, waves) / waves)
    cuts = [head, *cells[np.searchsorted(cells, cuts)].tolist(), v]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            met = passages.mapInArrow(_sender(bounds, low, high), SENT_SQL).groupBy("cell").applyInArrow(_grouped(_tail_edges(facts, bounds, v)), EDGES_SQL)
            met = materialise(met.coalesce(tasks), "edges")
            graph = graph.union(met)
            _free(spark)
    return graph, _weighed(facts)


def induce(docs: DataFrame, known: dict[int, int], clean_seeds: int = CLEAN_SEEDS, held_out: np.ndarray | None = None) -> pa.Table:
    """The lexicon: hash and polarity of every term. What reaches the driver is the vocabulary.

    ``held_out``: hashes of words that may not be toxic seeds, to measure what the walks find without them.
    """
    if len(set(known.values())) < 2:
        return LEXICON_ROWS.empty_table()
    t = terms(docs, known)
    bad, good = t.toxic_seeds(), t.clean_seeds(clean_seeds)
    if held_out is not None:
        bad = bad[~np.isin(t.h[bad], held_out)]
    if not len(bad) or not len(good):
        return LEXICON_ROWS.empty_table()
    v = len(t.h)
    restart = np.zeros((v, 2))
    restart[bad, 0], restart[good, 1] = t.used[bad], t.df[good]
    restart /= restart.sum(0)
    order = np.lexsort((t.h, -t.df))
    place = np.argsort(order)
    graph, edges = word_graph(docs, t.h[order])
    p = walk(graph, place[np.unique(np.concatenate((bad, good)))], restart[order], edges)[place]
    polarity = np.round((p[:, 0] - p[:, 1]) / (p.sum(1) + NEUTRAL / v), 9)
    polarity = np.where(t.clean > t.used, np.minimum(0, polarity), polarity)
    polarity[bad] = np.maximum(polarity[bad], LEXICON)
    return pa.table([t.h.view(np.int64), polarity], schema=LEXICON_ROWS)


def _scorer(lexicon):
    def run(batches):
        keys, weights = lexicon.value
        for b in batches:
            score, hits = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for first, h, of in word_hashes(b.column(1)):
                if not len(h) or not len(keys):
                    continue
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                own = np.flatnonzero(keys[at] == h)
                doc = first + np.searchsorted(of, own, "right") - 1
                score += np.bincount(doc, weights[at[own]], minlength=b.num_rows)
                hits += np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(score, 6)), pa.array(hits)], ["doc_id", "score", "hits"])

    return run


def score(docs: DataFrame, lexicon: pa.Table) -> DataFrame:
    """doc_id, score and hits (lexicon terms) of every row."""
    keys, weights = lexicon.column("h").to_numpy().view(U), lexicon.column("polarity").to_numpy()
    order = np.argsort(keys)
    order = order[weights[order] >= LEXICON]
    sent = docs.sparkSession.sparkContext.broadcast((keys[order], weights[order]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(sent), "doc_id long, score double, hits long")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and hits of the toxic documents."""
    known = labelled(labels)
    scored = materialise(score(docs, induce(docs, known)), "toxicity")
    cut = None
    if known:
        ids = docs.sparkSession.createDataFrame(list(known.items()), "doc_id long, toxic int")
        rows = scored.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("score"), F.max("toxic")).collect()
        if rows:
            found, bad = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]) == 1
            cut = best_cut(np.concatenate((found, found[~bad])), np.concatenate((bad, bad[~bad])))
    return scored.filter(F.lit(False) if cut is None else (F.col("score") >= cut) & (F.col("hits") > 0))
