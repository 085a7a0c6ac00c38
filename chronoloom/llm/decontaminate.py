"""Benchmark decontamination: suffix arrays over the training documents, searched by every suffix of the test items.

Each task cuts its documents into shards. A shard's words become numbers of the test set's vocabulary; words
that no item has can't be part of a match, so they only separate. Over what is left the shard gets a suffix
array (prefix doubling, as deep as the longest item is long), and all test suffixes are looked up at once by
binary search, word by word: the interval at the window's length has all its occurrences, and extending them
gives the longest verbatim matches with their places. Documents that hold a window go.

The test set is sent to the tasks in blocks of a bounded number of words, one pass over the documents each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spans import byte_class, spans
from ._spark import prepare, save, unused
from ._text import string_buffers

#: Digits, letters and everything beyond ASCII are words; A-Z count as a-z.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of text in a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 1 << 24
#: Words of the test set that go to the tasks at once, about; longer items are cut into overlapping stretches.
BLOCK_WORDS, STRETCH_WORDS = 4_000_000, 65_536
#: Pairs of a test suffix and a place that are worked on at once.
PAIRS = 1 << 21

_MATCH = ["item_id", "item_word", "doc_word", "length"]
_LONGS = lambda names: [T.StructField(n, T.LongType()) for n in names]
RESULT = T.StructType(_LONGS(["n_words", "n_hit", "longest"]) + [T.StructField("items", T.ArrayType(T.LongType())), T.StructField("matches", T.ArrayType(T.StructType(_LONGS(_MATCH))))])


class TestSet:
    """The test items' words as numbers, and all their suffixes that hold a whole window.

    rows: (item id or None, the stretch's first word in the item, words of the item, names of the stretch's words).
    """

    __test__ = False  # not a test class

    def __init__(self, rows: list[tuple[int | None, int, int, np.ndarray]], window: int):
        words = [r[3].view(np.uint64) for r in rows]
        self.names = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.names & np.uint64(len(self.maybe) - 1)] = True
        self.depth = max((len(w) for w in words), default=1)
        text, start, need, item, first, at = [np.zeros(1, np.int32)], [], [], [], [], 1
        for k, (_, offset, total, _) in enumerate(rows):
            n, m = len(words[k]), min(window, total)
            text += [(np.searchsorted(self.names, words[k]) + 1).astype(np.int32), np.zeros(1, np.int32)]
            begins = np.arange(max(0, n - m + 1))
            start.append(at + begins)
            need.append(np.full(len(begins), m))
            item.append(np.full(len(begins), k))
            first.append(offset + begins)
            at += n + 1
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
        self.text = np.concatenate([*text, np.zeros(self.depth + 1, np.int32)])
        self.start, self.need, self.item, self.first = join(start), join(need), join(item), join(first)
        self.ids = [r[0] for r in rows]
        self.least = int(self.need.min()) if len(self.need) else 1

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """The words' numbers from 1; 0 for a word that no item has."""
        out = np.zeros(len(names), np.int32)
        likely = np.flatnonzero(self.maybe[names & np.uint64(len(self.maybe) - 1)])
        if len(likely) and len(self.names):
            at = np.minimum(np.searchsorted(self.names, names[likely]), len(self.names) - 1)
            out[likely] = np.where(self.names[at] == names[likely], at + 1, 0)
        return out


class SuffixArray:
    """The suffixes of text that don't begin with 0, sorted by their first `depth` words. 0 is a separator."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = np.concatenate([text, np.zeros(depth + 1, text.dtype)])
        rank = text.astype(np.int64)
        span, n = 1, len(text)
        live = np.flatnonzero(text)
        while span < depth and len(live):
            ahead = np.zeros(n, np.int64)
            ahead[: n - span] = rank[span:]
            key = rank[live] * (int(rank.max()) + 1) + ahead[live]
            seen, place = np.unique(key, return_inverse=True)
            rank = np.zeros(n, np.int64)
            rank[live] = place + 1
            span *= 2
            if len(seen) == len(live):
                break
        self.order = live[np.argsort(rank[live], kind="stable")]

    def _edge(self, lo, hi, depth, word, after):
        """Within each [lo, hi), whose suffixes agree on the first `depth` words: where those with this next word begin or end."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            there = self.text[self.order[mid] + depth]
            below = there <= word[open_] if after else there < word[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo

    def find(self, text: np.ndarray, start: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix of text at start: the interval of the order whose suffixes share its first `need` words."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        depth, live = 0, np.arange(len(start))
        while len(live):
            word = text[start[live] + depth]
            a = self._edge(lo[live], hi[live], depth, word, False)
            lo[live], hi[live] = a, self._edge(a, hi[live], depth, word, True)
            depth += 1
            live = live[(lo[live] < hi[live]) & (need[live] > depth)]
        return lo, hi


def _runs(numbers: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least `least` known words within a document, each followed by a 0; and the places of these words (-1 at a 0)."""
    known = numbers > 0
    inner = bounds[(bounds > 0) & (bounds < len(numbers))]
    opens = known & np.append(True, ~known[:-1])
    closes = known & np.append(~known[1:], True)
    opens[inner] |= known[inner]
    closes[inner - 1] |= known[inner - 1]
    a, z = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    keep = z - a >= least
    a, size = a[keep], (z - a)[keep]
    if not len(a):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    ends = np.cumsum(size + 1)
    place = np.arange(ends[-1]) + np.repeat(a - (ends - size - 1), size + 1)
    place[ends - 1] = -1
    return np.where(place >= 0, numbers[place], 0).astype(np.int32), place


def shard_matches(tests: TestSet, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The longest matches, each at least a window long, of a shard: word number in the shard, suffix, words.

    A match that can be begun one word earlier isn't listed by itself.
    """
    text, place = _runs(numbers, bounds, tests.least)
    found: list[tuple[np.ndarray, ...]] = []
    if len(text):
        array = SuffixArray(text, tests.depth)
        lo, hi = array.find(tests.text, tests.start, tests.need)
        hits = np.flatnonzero(lo < hi)
        total = np.cumsum(hi[hits] - lo[hits])
        cut = 0
        while cut < len(hits):
            to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + PAIRS, "right")))
            some = hits[cut:to]
            size = hi[some] - lo[some]
            suffix = np.repeat(some, size)
            at = array.order[np.arange(size.sum()) + np.repeat(lo[some] - (np.cumsum(size) - size), size)]
            q = tests.start[suffix]
            before = np.where(at > 0, array.text[at - 1], 0)
            fresh = (before == 0) | (before != tests.text[q - 1])
            suffix, at, q = suffix[fresh], at[fresh], q[fresh]
            length = tests.need[suffix].copy()
            grow = np.arange(len(at))
            while len(grow):
                word = array.text[at[grow] + length[grow]]
                grow = grow[(word > 0) & (word == tests.text[q[grow] + length[grow]])]
                length[grow] += 1
            found.append((place[at], suffix, length))
            cut = to
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _results(tests: TestSet, batches: list[pa.RecordBatch], text_at: int, prior_at: int | None, column: str) -> list[pa.RecordBatch]:
    """A shard's rows with what was found in them; prior_at: the column with what earlier blocks found."""
    numbers, counts = [], []
    for b in batches:
        raw, off = string_buffers(b.column(text_at))
        n = np.zeros(b.num_rows, np.int64)
        for names, s, _ in spans(raw, off, WORD):
            numbers.append(tests.numbers(names))
            n += np.bincount(np.searchsorted(off, s, "right") - 1, minlength=b.num_rows)
        counts.append(n)
    n_words = np.concatenate(counts)
    bounds = np.concatenate(([0], np.cumsum(n_words)))
    numbers = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
    at, suffix, length = shard_matches(tests, numbers, bounds)
    row = np.searchsorted(bounds, at, "right") - 1
    ids = np.array([0 if x is None else x for x in tests.ids], np.int64)
    named = np.array([x is not None for x in tests.ids], bool)
    item, has_id = ids[tests.item[suffix]], named[tests.item[suffix]]
    columns = [item, tests.first[suffix], at - bounds[row], length]
    if prior_at is not None:
        prior = pa.chunked_array([b.column(prior_at) for b in batches]).combine_chunks()
        old = prior.field("matches")
        row = np.concatenate([np.repeat(np.arange(len(prior)), old.value_lengths().to_numpy(zero_copy_only=False)), row])
        flat = old.flatten()
        has_id = np.concatenate([flat.field("item_id").is_valid().to_numpy(zero_copy_only=False), has_id])
        columns = [np.concatenate([flat.field(k).fill_null(0).to_numpy(zero_copy_only=False), c]) for k, c in zip(_MATCH, columns)]
    order = np.lexsort((columns[1], columns[0], columns[2], row))
    row, has_id, columns = row[order], has_id[order], [c[order] for c in columns]
    n = len(n_words)
    step = np.zeros(len(numbers) + 1, np.int64)
    begin = bounds[row] + columns[2]
    np.add.at(step, begin, 1)
    np.add.at(step, begin + columns[3], -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    n_hit = hit[bounds[1:]] - hit[bounds[:-1]]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, columns[3])
    pairs = np.unique(np.stack([row[has_id], columns[0][has_id]]), axis=1) if has_id.any() else np.empty((2, 0), np.int64)
    lists = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)
    matches = pa.StructArray.from_arrays([pa.array(columns[0], pa.int64(), mask=~has_id), *[pa.array(c, pa.int64()) for c in columns[1:]]], _MATCH)
    result = pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(n_hit), pa.array(longest), lists(pairs[0], pa.array(pairs[1], pa.int64())), lists(row, matches)], RESULT.names
    )
    out, a = [], 0
    for b in batches:
        kept = [c for k, c in enumerate(b.columns) if k != prior_at]
        out.append(pa.RecordBatch.from_arrays([*kept, result.slice(a, b.num_rows)], [*[x for k, x in enumerate(b.schema.names) if k != prior_at], column]))
        a += b.num_rows
    return out


def _encoded(items: DataFrame, window: int) -> DataFrame:
    """item_id, first, total, words: the items' words by name, long items in stretches that overlap by a window less one word."""

    def run(batches):
        for batch in batches:
            raw, off = string_buffers(batch.column(1))
            parts = list(spans(raw, off, WORD))
            names = np.concatenate([p[0] for p in parts]).view(np.int64) if parts else np.empty(0, np.int64)
            bounds = np.searchsorted(np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64), off)
            out: tuple[list, ...] = ([], [], [], [])
            for i, item in enumerate(batch.column(0).to_pylist()):
                n = int(bounds[i + 1] - bounds[i])
                for a in range(0, max(1, n - window + 1) if n else 0, STRETCH_WORDS):
                    for c, v in zip(out, (item, a, n, names[bounds[i] + a : min(bounds[i + 1], bounds[i] + a + STRETCH_WORDS + window - 1)])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], ["item_id", "first", "total", "words"])

    return items.mapInArrow(run, "item_id long, first long, total long, words array<long>")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every row of docs with its columns and, as the last column, a struct of what it shares with the test items:
    n_words, n_hit (words inside any occurrence of a window), longest (words of the longest match), items (ids, ascending,
    once each) and matches (item_id, item_word, doc_word, length: the longest verbatim matches, with word numbers from 0).

    The last column is called `contamination`, with underscores added where docs has a column of that name.
    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Null and empty
    texts have no words. An item without an id marks words as hit and is listed among the matches, but not among the items;
    rows that share an item id count as one item. Repeated rows of docs are judged row by row. Words are compared by 64-bit names.
    """
    spark = docs.sparkSession
    prepare(spark)
    column = unused(docs.columns, "contamination")[0]
    encoded = save(_encoded(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")), window), "test-items")
    words = encoded.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    text_at, out = docs.columns.index(text_col), docs
    block = F.pmod(F.xxhash64("item_id", "first", "words"), F.lit(blocks))
    for k in range(blocks):
        rows = encoded.where(block == k).orderBy("item_id", "first", "words").toArrow()
        parts = [np.asarray(w.values) for w in rows.column("words")]
        tests = spark.sparkContext.broadcast(TestSet(list(zip(rows.column("item_id").to_pylist(), rows.column("first").to_pylist(), rows.column("total").to_pylist(), parts)), window))
        prior_at = len(docs.columns) if k else None

        def run(batches, tests=tests, prior_at=prior_at):
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.column(text_at).nbytes
                if size >= SHARD_BYTES:
                    yield from _results(tests.value, held, text_at, prior_at, column)
                    held, size = [], 0
            if held:
                yield from _results(tests.value, held, text_at, prior_at, column)

        out = out.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, RESULT)]))
        if k < blocks - 1:
            out = save(out, "decontamination")
    return out


def clean_rows(docs: DataFrame, items: DataFrame, *, window: int = 10, **columns: str) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with the columns of docs."""
    found = contamination(docs, items, window=window, **columns)
    return found.where(F.col(f"{found.columns[-1]}.n_hit") == 0).select(*docs.columns)
