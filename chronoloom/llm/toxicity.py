"""Toxic passages by maximum-scoring segments of word log-odds.

Training compares how often words, and the beginnings of words, occur in toxic and in clean documents:
log-odds with a Dirichlet prior, lowered by two standard deviations. A document counts a word once, equal
texts count once, and toxic occurrences count by their distinct surroundings, so that neither one long
document nor the near copies of one make their rare words look toxic. Scoring gives every word of a text
its log-odds, or a small penalty, and one linear scan finds all maximal segments. The extreme-value law of
such segments (Karlin and Altschul), fitted to the scores of the clean training texts, says how often clean
text of the same length would reach a score by chance; that expectation and the share of toxic documents
give the probability. Texts and the labels of training rows are all that a score depends on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, save, tidied

_WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that are units of their own, by length.
STEMS = range(3, 9)
#: A word that is no known unit moves a segment by this much.
DRIFT = -0.25
#: Units must differ from the base rate by so many standard deviations.
LEAST_Z = 3.3
PRIOR = 1.0
#: So many documents a word's beginning is worth beside the word's own.
STEM_PRIOR = 4.0
#: Labelled rows that training uses at most. The model's units are words of these rows, which bounds it.
MAX_LABELLED = 100_000
_MEMO = 400_000


class Model:
    """units: {unit: score}; full words are units as they stand, beginnings end in '*'.

    decay and factor are the extreme-value law of clean texts, base is the share of toxic documents and reach the
    mean surprise of toxic ones.
    """

    def __init__(self, units: dict[str, float], base: float, decay: float = 1.0, factor: float = 1.0, reach: float = 2.0):
        self.units, self.base, self.decay, self.factor, self.reach = units, min(0.3, max(0.01, base)), decay, factor, reach
        self._memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        s = self._memo.get(w)
        if s is None:
            s = self.units.get(w)
            if s is None:
                s = next((u for k in reversed(STEMS) if k < len(w) and (u := self.units.get(w[:k] + "*")) is not None), DRIFT)
            if len(self._memo) >= _MEMO:
                self._memo.clear()
            self._memo[w] = s
        return s

    def surprise(self, score: float, words: int) -> float:
        """Minus the logarithm of how many segments of this score clean text of this length has by chance."""
        return self.decay * score - math.log(self.factor * words)

    def together(self, surprises: list[float]) -> float:
        """The surprise of a text's segments: of the r best ones together, for the r that surprises most.

        By the law's sum statistic r segments of total surprise t come by chance with probability
        exp(-t) t^(r-1) / (r! (r-1)!); each further segment also costs the choice among the numbers r.
        """
        best, total = max(surprises), 0.0
        for r, x in enumerate(sorted(surprises, reverse=True), 1):
            total += x
            if x <= 0 or total <= r:
                break
            best = max(best, total - (r - 1) * math.log(2 * total) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def probability(self, surprise: float | None) -> float:
        """That a text is toxic, by its share among toxic and clean texts of this surprise.

        Surprises of clean texts are exponentially distributed with mean 1, those of toxic ones with mean `reach`.
        A text where no word scores counts as one with surprise 0 and less.
        """
        odds = math.log(self.base / (1 - self.base)) - math.log(self.reach)
        x = -2.0 if surprise is None else surprise * (1 - 1 / self.reach)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds + x))))

    def scores(self, low: str) -> list[float]:
        memo = self._memo
        return [memo[w] if w in memo else self.word(w) for w in _WORD.findall(low)]

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The probability that the text is toxic, and its significant segments: begin, end (characters), score, surprise."""
        low = text.lower()
        even = len(low) == len(text)
        # Where lower-casing moves characters, words are found in the text as it stands.
        scores = self.scores(low) if even else [self.word(w.lower()) for w in _WORD.findall(text)]
        if not scores or max(scores) <= 0:
            return self.probability(None), []
        found = [(a, z, s, self.surprise(s, len(scores))) for a, z, s in segments(scores)]
        p = self.probability(self.together([x for *_, x in found]))
        found = [f for f in found if f[3] > 0]
        spans = [m.span() for m in _WORD.finditer(low if even else text)] if found else []
        return p, [(spans[a][0], spans[z - 1][1], s, x) for a, z, s, x in found]


def segments(scores: list[float]) -> Iterator[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by one linear scan with a stack of candidates."""
    stack: list[list] = []  # begin, end, total before begin, total at end
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return ((a, z, right - left) for a, z, left, right in stack)


def extreme_value_law(hits: dict[float, float], best: list[tuple[float, float]], positive: list[float] = ()) -> tuple[float, float]:
    """Exponent and factor of the law for clean text: of n words, factor * n * exp(-exponent * s) segments reach s.

    hits counts the words of the clean texts by their score. The exponent is the positive root of
    sum p(s) exp(exponent * s) = 1; one further hit, shared by all positive scores that a word can have, stands
    for what was not seen. best has each clean
    text's number of words and best score: n * exp(-exponent * best) is exponentially distributed with the
    factor as its rate, and where no word scored it is only known to exceed that of the least score there is;
    the factor is the likeliest rate.
    """
    words = sum(hits.values()) + 1
    p = {s: n / words for s, n in hits.items()}
    more = sorted(positive) or sorted({s for s in hits if s > 0}) or [5.0]
    for s in more:
        p[s] = p.get(s, 0.0) + 1 / (words * len(more))
    if sum(s * x for s, x in p.items()) >= 0:
        return 0.1, 1.0
    lo, hi = 1e-6, 60.0
    for _ in range(100):
        mid = (lo + hi) / 2
        value = sum(x * math.exp(min(600.0, mid * s)) for s, x in p.items())
        lo, hi = (mid, hi) if value < 1 else (lo, mid)
    least = min(s for s in p if s > 0)
    seen = 1 + sum(1 for _, s in best if s > 0)
    return lo, seen / sum(n * math.exp(-lo * max(least, s)) for n, s in [(1.0, 0.0), *best])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled documents; labels(id, label 0/1), of which those with the smallest hashed ids count.

    Null ids and labels are passed over; an id labelled more than once is toxic if any label says so; texts
    that occur more than once count once. Without usable labels, as in empty tables, every text gets the same
    low score. Further columns don't matter.
    """
    spark = docs.sparkSession
    prepare(spark)
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    some = save(some.orderBy(F.xxhash64("id"), "id").limit(max_labelled), "toxic-labels")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most max_labelled short rows are broadcast. An id may have several texts: those with the smallest hashes count.
    found = d.join(F.broadcast(some), "id").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.min_by("text", "id").alias("text"))
    once = save(found, "toxic-training")
    if once.count() > max_labelled:
        last = once.select("h").orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
        once = once.where(F.col("h") <= last)
    once = once.select("text", "toxic")
    schema = "unit string, clean long, toxic long, near array<int>"

    def count(batches):
        seen: dict[str, list] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall(text.lower())
                at = dict(zip(reversed(words), range(len(words) - 1, -1, -1)))
                for w, i in at.items():
                    c = seen.get(w)
                    if c is None:
                        c = seen[w] = [0, 0, set()]
                    c[toxic] += 1
                    if toxic:
                        around = words[max(0, i - 1)] + " " + (words[i + 1] if i + 1 < len(words) else "")
                        c[2].add(zlib.crc32(around.encode()) - (1 << 31))
            if len(seen) > 300_000:
                yield from _rows(seen)
                seen = {}
        yield from _rows(seen)

    # A word's surroundings are at most as many as there are toxic training rows.
    merged = [F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")]
    words = save(once.mapInArrow(tidied(count), schema).groupBy("unit").agg(*merged), "toxic-words")
    # In the counts of its beginnings a word weighs as the logarithm of its documents does, clean and toxic alike:
    # no word, however frequent, speaks for all that begin like it, and a neutral one leaves them neutral. Decimals
    # make sums that don't depend on their order.
    damp = F.log2(1 + F.col("toxic") + F.col("clean")) / (F.col("toxic") + F.col("clean"))
    part = lambda c: (F.col(c) * damp).cast("decimal(24,6)").alias(c)
    stems = words.select("unit", part("clean"), part("toxic"), (F.size("near") * damp).cast("decimal(24,6)").alias("near"), F.explode(F.array(*[F.lit(k) for k in STEMS])).alias("k")).where(F.col("k") < F.char_length("unit"))
    stems = stems.groupBy(F.concat(F.substring("unit", F.lit(1), F.col("k")), F.lit("*")).alias("unit")).agg(*[F.sum(c).cast("double").alias(c) for c in ("clean", "toxic", "near")])
    totals = words.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).first()
    clean, toxic = float(totals["c"] or 0), float(totals["t"] or 0)
    if not clean or not toxic:
        return Model({}, 0.1)
    base = toxic / (clean + toxic)
    documents = once.agg(F.avg("toxic")).first()[0]

    a1, a0 = PRIOR * base, PRIOR * (1 - base)
    whole = words.select("unit", F.col("clean").cast("double").alias("clean"), F.col("toxic").cast("double").alias("toxic"), F.size("near").cast("double").alias("near"))
    units = whole.unionByName(stems).withColumns({"nt": F.least("toxic", "near") + a1, "nc": F.col("clean") + a0})
    units = units.withColumns({"odds": F.log(F.col("nt") / F.col("nc")) - math.log(a1 / a0), "sd": F.sqrt(1 / F.col("nt") + 1 / F.col("nc"))})
    units = units.where((F.abs("odds") / F.col("sd") >= LEAST_Z) & (F.col("toxic") + F.col("clean") >= 4))
    s = F.when(F.col("odds") > 0, F.least(F.lit(12.0), F.col("odds") - 2 * F.col("sd"))).otherwise(F.col("odds") + 2 * F.col("sd"))
    units = units.withColumn("s", s).where((F.col("s") > 1) | (F.col("s") < DRIFT))
    found = {r["unit"]: r["s"] for r in units.select("unit", "s").collect()}
    prior_odds = math.log(a1 / a0)

    def settled(batches):
        """Words seen in training that are no units, but begin like one: their own counts, with the beginning's as a prior."""
        begin = Model(found, documents)
        for batch in batches:
            names, scores = [], []
            for w, c, t, near in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if w in found or (up := begin.word(w)) <= 0:
                    continue
                p = 1 / (1 + math.exp(-up - prior_odds))
                nt, nc = min(t, near) + STEM_PRIOR * p, c + STEM_PRIOR * (1 - p)
                own = math.log(nt / nc) - prior_odds - 2 * math.sqrt(1 / nt + 1 / nc)
                names.append(w)
                scores.append(own if own > 1 else DRIFT)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["unit", "s"])

    settled_words = {r["unit"]: r["s"] for r in whole.select("unit", "clean", "toxic", "near").mapInArrow(tidied(settled), "unit string, s double").collect()}
    model, unseen = Model(found | settled_words, documents), Model(found, documents)

    def scored(batches):
        hits: Counter = Counter()
        for batch in batches:
            n, top = [], []
            for text in batch.column(0).to_pylist():
                own = unseen.scores(text.lower())
                hits.update(round(x, 1) for x in own)
                n.append(len(own))
                top.append(max((z for *_, z in segments(own)), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.float64()), pa.array(top, pa.float64()), pa.array([False] * len(n))], ["n", "s", "hit"])
        yield pa.RecordBatch.from_arrays([pa.array([float(x) for x in hits.values()], pa.float64()), pa.array(list(hits), pa.float64()), pa.array([True] * len(hits))], ["n", "s", "hit"])

    # The clean training texts, scored as new text is, whose words are not settled: at most max_labelled pairs of
    # numbers come back.
    law = save(once.where("toxic = 0").select("text").mapInArrow(tidied(scored), "n double, s double, hit boolean"), "toxic-law")
    hits = {r["s"]: r["n"] for r in law.where("hit").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    model.decay, model.factor = extreme_value_law(hits, sorted((r["n"], r["s"]) for r in law.where("NOT hit AND n > 0").select("n", "s").collect()), [s for s in found.values() if s > 0])

    def surprising(batches):
        for batch in batches:
            own = [model.scores(t.lower()) for t in batch.column(0).to_pylist()]
            x = [max(0.0, model.together([model.surprise(z, len(s)) for *_, z in segments(s)])) for s in own if s and max(s) > 0]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64())], ["x"])

    mean = once.where("toxic = 1").select("text").mapInArrow(tidied(surprising), "x double").agg(F.avg(F.col("x").cast("decimal(20,6)"))).first()[0]
    model.reach = max(2.0, float(mean or 0))
    return model


def _rows(seen: dict[str, list]) -> Iterator[pa.RecordBatch]:
    names = list(seen)
    for a in range(0, len(names), 50_000):
        part = names[a : a + 50_000]
        c = [seen[w] for w in part]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([x[0] for x in c], pa.int64()), pa.array([x[1] for x in c], pa.int64()), pa.array([sorted(x[2]) for x in c], pa.list_(pa.int32()))], ["unit", "clean", "toxic", "near"])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score, segments (begin, end in characters, score, surprise).

    Null text is empty; an empty text has the score of a text without findings. Each row is scored by its text
    alone, so repeated rows score alike; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    kind = "array<struct<begin:int,end:int,score:double,surprise:double>>"

    def run(batches):
        for batch in batches:
            judged = [model.judge(t or "") for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("begin", "end", "score", "surprise"), s)) for s in segs] for _, segs in judged]
            t = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("surprise", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in judged], pa.float64()), pa.array(spans, t)], ["doc_id", "score", "segments"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(tidied(run), f"doc_id long, score double, segments {kind}")


def clean_rows(docs: DataFrame, model: Model, *, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the limit, with all their columns, whatever these are called."""
    prepare(docs.sparkSession)
    name = text_col

    def run(batches):
        for batch in batches:
            keep = [model.judge(t or "")[0] < limit for t in batch.column(name).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
