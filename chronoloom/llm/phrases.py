"""Phrase collocation mining: n-grams as rows, counted by language, and scored by how much more often words
stand together than apart.

All n-grams of 1 to `most` words are exploded into rows and summed by (lang, phrase). Most n-grams are too rare
to matter, and a phrase can't be more frequent than any part of it; so sieves run first: they count words, then
pairs, then triples by 64-bit name, each only where the sieve before lets it pass, and what reaches the threshold
sets bits of a bitmap of a fixed size. The bitmaps only spare rows their way through the shuffle: whatever they
let pass without need is counted exactly, by its words, and then dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ._spans import byte_class, spans
from ._spark import parallelism, prepare, release, save
from ._text import mix64, string_buffers

#: Bytes that are part of a word, and bytes that end a piece.
BREAKS = byte_class((0x0A, 0x0D)) | np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
WORD = ~(BREAKS | byte_class((0x09, 0x09), (0x20, 0x20)))
#: Bits of a sieve's bitmap (16 MiB), and how many words a task gathers before it sums n-grams.
BITS, GATHER = 1 << 27, 4_000_000
#: Bits of a name in the sieves' counts.
NAME = 40
#: The longest n-grams that have a sieve of their own.
SIEVED = 3
_TIMES = np.uint64(0x9FB21C651E98DF25)


class Sieve:
    """Which names may be frequent: a bit by the name's leading bits."""

    def __init__(self, places: np.ndarray, bits: np.ndarray):
        self.map = np.zeros(BITS // 64, np.uint64)
        self.map[places] = bits.view(np.uint64)

    def passes(self, names: np.ndarray) -> np.ndarray:
        at = names >> np.uint64(64 - BITS.bit_length() + 1)
        return (self.map[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Words:
    """Words in reading order: name (with the language), first byte, end, number of the word's piece; fresh: the first new one."""

    def __init__(self, names, starts, ends, pieces, fresh):
        self.names, self.starts, self.ends, self.pieces, self.fresh = names, starts, ends, pieces, fresh

    def grams(self, most: int, sieves: list[Sieve], only: int = 0):
        """(n, places, names) of the n-grams within pieces that end in fresh words and whose parts pass the sieves; only: of this n alone."""
        fits: list[np.ndarray] = []  # by length: the places whose n-gram passes
        name = self.names
        for n in range(1, most + 1):
            size = len(self.names) - n + 1
            if size <= 0:
                return
            if n > 1:
                name = mix64(name[:size] * _TIMES + self.names[n - 1 :])
                ok = self.pieces[:size] == self.pieces[n - 1 :]
                if fits:
                    ok = ok & fits[-1][:size] & fits[-1][1 : size + 1]
            else:
                ok = np.ones(size, bool)
            if n <= len(sieves):
                at = np.flatnonzero(ok)
                ok = np.zeros(size, bool)
                ok[at] = sieves[n - 1].passes(name[at])
            fits.append(ok)
            if not only or n == only:
                at = np.flatnonzero(ok)
                at = at[at + n > self.fresh]  # those that end in a fresh word
                yield n, at, name[at]


def _salt(lang: str) -> int:
    """A number for a language, the same in every process."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


class Reader:
    """Turns batches of (lang, text) into words, stretch by stretch; numbers the languages it meets."""

    def __init__(self, most: int):
        self.most, self.langs = most, []
        self._number: dict[str, int] = {}
        self._salts = np.empty(0, np.uint64)

    def read(self, batch: pa.RecordBatch):
        """(raw bytes, words, each word's language, first fresh word): the words before the first fresh one were given before
        and only begin n-grams that reach into the fresh ones."""
        raw, off = string_buffers(batch.column(1))
        lang = np.empty(batch.num_rows, np.int64)
        for i, x in enumerate(batch.column(0).to_pylist()):
            if x not in self._number:
                self._number[x] = len(self.langs)
                self.langs.append(x)
                self._salts = np.append(self._salts, np.uint64(_salt(x)))
            lang[i] = self._number[x]
        held, at, piece = None, int(off[0]), 0
        for names, s, e in spans(raw, off, WORD):
            if not len(s):
                continue
            row = np.searchsorted(off, s, "right") - 1
            # Breaks since the last word of the stretch before; rows end pieces too, so row numbers count with them.
            seen = np.cumsum(BREAKS[raw[at : int(s[-1]) + 1]])
            pieces = piece + seen[s - at] + row
            at, piece = int(e[-1]), int(piece + seen[-1])
            fresh = (mix64(names ^ self._salts[lang[row]]), s, e, pieces, lang[row])
            whole = fresh if held is None else tuple(np.concatenate(x) for x in zip(held, fresh))
            begin = len(whole[0]) - len(names)
            yield raw, Words(*whole[:4], begin), whole[4]
            held = tuple(x[-(self.most - 1) :] for x in whole) if self.most > 1 else None


def _sieve(docs: DataFrame, n: int, least: int, sieves: list) -> Sieve:
    """The bitmap of the n-grams that occur `least` times."""

    def run(batches):
        reader, loaded = Reader(n), [s.value for s in sieves]
        held, size = [], 0

        def summed():
            x = np.sort(np.concatenate(held) >> np.uint64(64 - NAME))  # fewer bits travel: names that then agree only pass too often
            edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
            return pa.RecordBatch.from_arrays([pa.array(x[edge[:-1]].view(np.int64)), pa.array(np.diff(edge).astype(np.int64))], ["name", "n"])

        for batch in batches:
            for _, words, _ in reader.read(batch):
                for _, _, names in words.grams(n, loaded, only=n):
                    held.append(names)
                    size += len(names)
                if size >= GATHER:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    counts = docs.mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    at = F.shiftright("name", NAME - BITS.bit_length() + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    rows = counts.groupBy(F.shiftright(at, 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most BITS / 64 rows
    return Sieve(rows.column("place").to_numpy(), rows.column("bits").to_numpy())


def counted(docs: DataFrame, most: int, sieves: list) -> DataFrame:
    """lang, words, phrase, n: the n-grams of 1 to `most` words that pass the sieves, exploded into rows and summed over all
    documents; and per lang a row of 0 words with the number of all word occurrences. Equal n-grams of a stretch are one row already."""

    def run(batches):
        reader, loaded = Reader(most), [s.value for s in sieves]
        totals = np.zeros(0, np.int64)
        for batch in batches:
            for raw, words, lang in reader.read(batch):
                more = np.bincount(lang[words.fresh :], minlength=len(reader.langs))
                more[: len(totals)] += totals
                totals = more
                for n, at, names in words.grams(most, loaded):
                    _, first, times = np.unique(names, return_index=True, return_counts=True)
                    at = at[first]
                    along = [np.stack([x[at + i] for i in range(n)], axis=1).tolist() for x in (words.starts, words.ends)]
                    text = [b" ".join([raw[a:z].tobytes() for a, z in zip(*w)]).lower().decode() for w in zip(*along)]  # bytes.lower() changes A-Z alone
                    yield pa.RecordBatch.from_arrays([pa.array(reader.langs).take(pa.array(lang[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(text, pa.string()), pa.array(times.astype(np.int64))], ["lang", "words", "phrase", "n"])
        names = pa.array(reader.langs, pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array([0] * len(names), pa.int32()), pa.array([""] * len(names), pa.string()), pa.array(totals.astype(np.int64))], ["lang", "words", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def phrases(docs: DataFrame, *, most: int = 5, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language the `top` phrases by score, then a (both descending), then phrase.

    A-Z count as a-z; texts are split at . , ; : ! ? and line ends into pieces, these at blanks and tabs into words. n: all word
    occurrences of the language; a: occurrences of the phrase within pieces, overlapping ones included. Phrases of 2 to `most`
    words with a >= least are candidates. Cut after its first words, a candidate scores floor(1000 a n / (l r)), l and r the counts
    of the two parts; the lowest cut counts, of equal ones the shortest first part. A candidate goes if a longer candidate that
    contains it is as frequent: then so is one with one word more. Numbers are exact while 1000 a n stays below 10^38.

    A null language is `und`; null and empty texts have no words; repeated rows count as often as they stand there. In the sums
    of one task phrases are told apart by 64-bit names, between tasks by their words.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    sieves: list = []
    for n in range(1, min(SIEVED, most) + 1):
        sieves.append(spark.sparkContext.broadcast(_sieve(texts, n, least, sieves)))  # 16 MiB each at any size of the input
        release(spark)
    counts = save(counted(texts, most, sieves).where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
    for s in sieves:
        s.unpersist()

    exact = lambda c: F.col(c).cast("decimal(17,0)")
    totals = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    candidates = counts.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    word = F.split("phrase", " ")
    cuts = candidates.join(totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(word, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    part = lambda text, n: counts.where("words >= 1").select("lang", F.col("phrase").alias(text), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("total"), "below": exact("l") * exact("r")}).withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "words", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("words >= 3").select("lang", (F.col("words") - 1).alias("words"), F.explode(F.array(F.array_join(F.slice(word, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(word, F.lit(2), F.col("words") - 1), " "))).alias("phrase"), "a")
    kept = lowest.join(longer, ["lang", "words", "phrase", "a"], "left_anti").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(parallelism(spark)))
    # No task gets a whole language: the best of each share of it first, then the best of these.
    near = kept.withColumn("share", spread).withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*best))).where(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
