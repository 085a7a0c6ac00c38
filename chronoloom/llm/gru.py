"""Scoring documents by a gated recurrent language model, trained with numpy.

Words are counted once for the whole training corpus. The most frequent ones get an output symbol of their
own; every other word, seen or not, belongs to a symbol given by its spelling (the hash of its last bytes),
inside which it has its share of the counts, so that the probabilities of all texts sum to one. A GRU over
the symbols predicts the next one's class and the symbol within it. Training documents are dealt to fixed
groups and slices by hash: in each round every group trains on its slice by truncated backpropagation, and
the groups' weights are averaged, so the result depends on the documents alone. Scoring carries the state
through windows, so a document counts as a whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, release, save
from ._text import _SPACE, chunks, mix64, string_buffers, word_hashes

#: Frequent words and spelling symbols of the network, symbols of a class, widths of a symbol's vector and of the state.
WORDS, SPELLINGS, CLASS, EMBED, STATE = 1024, 64, 32, 16, 24
LANES, WINDOW = 256, 32
#: Lanes in scoring, where they change no result.
WIDE = 1024
#: In training, longer documents go in pieces of so many symbols; in scoring the state runs through the whole document.
STRETCH = 1024
#: Learning rates of the rounds; a round takes one slice of every group.
RATES = (0.04, 0.03, 0.02, 0.01, 0.004)
#: Words of a group, about; and groups at least and at most.
GROUP_WORDS, LEAST_GROUPS, MOST_GROUPS = 2_500_000, 8, 4096
#: Words whose counts every task holds, the most frequent ones; the others' counts come by a join.
KNOWN_WORDS = 1 << 16
#: Words that a task counts at once.
FLUSH_WORDS = 2_000_000
_END = WORDS + SPELLINGS
_CLASSES = _END // CLASS + 1


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit word names, the words' spelling symbols, and row offsets."""
    base = int(offsets[0])
    h, rows = word_hashes(raw, offsets)
    if not len(h):
        return h, np.empty(0, np.uint8), rows
    b = raw[base : int(offsets[-1])]
    solid = ~_SPACE[b]
    ends = np.append(~solid[1:], True)
    ends[(offsets[1:] - base)[offsets[1:] > base] - 1] = True
    last = np.flatnonzero(solid & ends)
    before = np.concatenate(([-1], last[:-1]))
    spelling = np.zeros(len(last), np.uint64)
    for k in range(3):
        at = np.maximum(last - k, 0)
        c = b[at]
        use = (last - k > before) & solid[at]
        spelling = spelling * np.uint64(257) + np.where(use, c + ((c >= 65) & (c <= 90)) * np.uint8(32), 0).astype(np.uint64)
    return h, (mix64(spelling) & np.uint64(SPELLINGS - 1)).astype(np.uint8), rows


def word_counts(texts: DataFrame) -> DataFrame:
    """name, spelling, n of every distinct word of texts(text): counted in the tasks, then summed by name."""

    def run(batches):
        names, spellings, held = [], [], 0

        def counted():
            w, s = np.concatenate(names), np.concatenate(spellings)
            order = np.argsort(w)
            w = w[order]
            edge = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
            return pa.RecordBatch.from_arrays([pa.array(w[edge[:-1]].view(np.int64)), pa.array(s[order[edge[:-1]]].astype(np.int32)), pa.array(np.diff(edge))], ["name", "spelling", "n"])

        for batch in batches:
            raw, off = string_buffers(batch.column(0))
            for a, z in chunks(off):
                w, s, _ = _tokens(raw, off[a : z + 1])
                names.append(w)
                spellings.append(s)
                held += len(w)
                if held >= FLUSH_WORDS:
                    yield counted()
                    names, spellings, held = [], [], 0
        if held:
            yield counted()

    counts = texts.mapInArrow(run, "name long, spelling int, n long")
    return counts.groupBy("name").agg(F.min("spelling").alias("spelling"), F.sum("n").alias("n"))


class Vocabulary:
    """What every task knows of the counts.

    names (ascending) with log10(count + 0.5) of the KNOWN_WORDS most frequent words, and their symbols: of the
    WORDS first ones their own, of the others that of their spelling; complete: no other word was counted.
    log_rest: per spelling symbol the logarithm of what its words share.
    """

    def __init__(self, ranked: list[tuple[int, int, int]], tokens: np.ndarray, distinct: np.ndarray):
        ranked = sorted(ranked, key=lambda x: (-x[2], x[0]))
        names = np.array([n for n, *_ in ranked], np.int64).view(np.uint64)
        order = np.argsort(names)
        self.names, self.counts = names[order], np.array([c for *_, c in ranked], np.float64)[order]
        own = np.arange(len(ranked))
        self.symbols = np.where(own < WORDS, own, WORDS + np.array([s for _, s, _ in ranked], np.int64))[order].astype(np.uint16)
        self.logs = np.log10(self.counts + 0.5)
        self.complete = len(ranked) == int(distinct.sum())
        tokens, distinct = tokens.astype(np.float64), distinct.astype(np.float64)
        for _, s, c in ranked[:WORDS]:
            tokens[s] -= c
            distinct[s] -= 1
        self.log_rest = np.log10(tokens + 0.5 * (distinct + 1))
        self.frequent = np.array([c for *_, c in ranked[:WORDS]], np.float64)

    def encode(self, words: np.ndarray, spellings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, logarithms of counts, and which words are known here."""
        symbols = spellings.astype(np.uint16) + np.uint16(WORDS)
        if not len(self.names):
            return symbols, np.full(len(words), np.log10(0.5)), np.zeros(len(words), bool)
        at = np.searchsorted(self.names, words)
        at[at == len(self.names)] = 0
        known = self.names[at] == words
        return np.where(known, self.symbols[at], symbols), np.where(known, self.logs[at], np.log10(0.5)), known


_ENCODED = "row long, doc_id long, learn boolean, key long, n_tokens long, symbols binary, part double, rest double, known long, names array<long>, times array<long>"


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Of docs(doc_id, learn, key, text): a number for the row, the text's symbols (16 bits each), the sums of
    log10(count + 0.5) over its words (part) and over those without a symbol of their own (rest), how many of
    its words were counted, and the words whose counts must be looked up, with their numbers."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().taskAttemptId() << 32  # kept: the rows are saved before they are used
        for batch in batches:
            raw, off = string_buffers(batch.column(3))
            out: list[list] = [[] for _ in range(7)]
            for a, z in chunks(off):
                words, spellings, rows = _tokens(raw, off[a : z + 1])
                symbols, logs, known = vocabulary.encode(words, spellings)
                local = known | vocabulary.complete
                own = symbols < WORDS
                # Sums before each row's begin; the words to look up count nothing here.
                sums = [np.concatenate(([0.0], np.cumsum(np.where(local, logs, 0.0)))), np.concatenate(([0.0], np.cumsum(np.where(local & ~own, logs, 0.0)))), np.concatenate(([0], np.cumsum(known)))]
                bounds = rows.tolist()
                for b, e in zip(bounds, bounds[1:]):
                    rare, times = np.unique(words[b:e][~local[b:e]], return_counts=True)
                    for c, v in zip(out, (e - b + 1, symbols[b:e].tobytes(), sums[0][e] - sums[0][b], sums[1][e] - sums[1][b], int(sums[2][e] - sums[2][b]), rare.view(np.int64), times)):
                        c.append(v)
            n = batch.num_rows
            kinds = (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), *batch.columns[:3], *[pa.array(c, k) for c, k in zip(out, kinds)]], [c.split()[0] for c in _ENCODED.split(", ")])
            row += n

    return docs.select("doc_id", "learn", "key", "text").mapInArrow(run, _ENCODED)


def unigram_weights(vocabulary: Vocabulary, ends: int) -> dict[str, np.ndarray]:
    """Weights to start from: the output biases alone give every symbol its share of the counts."""
    w = new_weights()
    w["out"] *= np.float32(0.1)
    w["word"] *= np.float32(0.1)
    counts = np.full(_END, 1e-6)
    counts[: len(vocabulary.frequent)] = vocabulary.frequent + 0.5
    counts[WORDS:] = 10**vocabulary.log_rest
    per = counts.reshape(-1, CLASS)
    w["word0"] = np.log(per).astype(np.float32)
    w["out0"] = np.log(np.append(per.sum(1), ends + 0.5)).astype(np.float32)
    return w


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shape = {"embed": (_END + 1, EMBED), "gates": (EMBED, 3 * STATE), "gates0": (3 * STATE,), "turn": (STATE, 3 * STATE), "out": (STATE, _CLASSES), "out0": (_CLASSES,), "word": (_CLASSES - 1, STATE, CLASS), "word0": (_CLASSES - 1, CLASS)}
    return {k: (r.standard_normal(s) * (0.0 if k.endswith("0") else 0.2)).astype(np.float32) for k, s in shape.items()}


def _apart(m: np.ndarray) -> np.ndarray:
    """(N, 3 H) as (3, N, H)."""
    return np.ascontiguousarray(m.reshape(len(m), 3, -1).transpose(1, 0, 2))


class Network:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.steps = 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def _forward(self, x, fresh, h, keep):
        """x (T, B) symbols, fresh (T, B) true where a document begins. Returns states (T, B, H), the last one, and with
        `keep` what backpropagation needs: the states before each step, gates and candidates (3, T, B, H), and the candidates'
        recurrent parts. Each gate has an array of its own, so that a step's numbers lie side by side."""
        H, w = STATE, self.w
        (T, B), kind = x.shape, w["out"].dtype
        # The inputs' part is the same wherever a symbol stands.
        symbols = x.ravel()
        few = len(symbols) < len(w["embed"])
        table = _apart((w["embed"][symbols] if few else w["embed"]) @ w["gates"] + w["gates0"])
        turn = _apart(w["turn"])
        table[:2] *= 0.5  # a sigmoid is a tanh of the half
        turn[:2] *= 0.5
        gates = (table if few else table.take(symbols, axis=1)).reshape(3, T, B, H)
        states, u = np.empty((T, B, H), kind), np.empty((3, B, H), kind)
        before, inner = (np.empty((T if keep else 1, B, H), kind) for _ in range(2))
        begins = fresh.any(1)
        for t in range(T):
            if keep or begins[t]:
                own = before[t if keep else 0]
                own[:] = h
                if begins[t]:
                    own[fresh[t]] = 0
                h = own
            np.matmul(h, turn, out=u)
            zr, n = gates[:2, t], gates[2, t]
            zr += u[:2]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            if keep:
                inner[t] = u[2]
            u[2] *= zr[1]
            n += u[2]
            np.tanh(n, out=n)
            new = np.subtract(h, n, out=states[t])
            new *= zr[0]
            new += n
            h = new
        return states, h, (before, gates, inner)

    def _logits(self, s, y, ds=None):
        """For states s (N, H) and targets y: natural log probabilities. With ds, that takes the gradients of the mean
        loss by the states, also the gradients of the output weights."""
        w, n = self.w, len(y)
        c = (y // CLASS).astype(np.uint16)  # the end is a class of its own
        order = np.argsort(c, kind="stable")
        y, c = y[order], c[order]
        edge = np.searchsorted(c, np.arange(_CLASSES + 1))
        every = np.arange(n)
        # A column of ones takes the biases into the products. Only differences of scores count, so a row's largest need
        # not be taken away while none can overflow.
        s = np.concatenate((s[order], np.ones((n, 1), s.dtype)), axis=1)
        most = max(1.0, float(s.max(initial=0)), -float(s.min(initial=0)))
        out1 = np.concatenate((w["out"], (w["out0"] - w["out0"].max())[None]))
        word1 = np.concatenate((w["word"], (w["word0"] - w["word0"].max(1, keepdims=True))[:, None]), axis=1)
        safe = max(float(np.abs(m).sum(-2).max()) for m in (out1, word1)) * most < 60
        ones = np.ones(max(_CLASSES, CLASS), s.dtype)

        def scored(s, m):
            q = s @ m
            if not safe:
                q -= q.max(1, keepdims=True)
            return q

        p = scored(s, out1)
        lp = p[every, c]
        np.exp(p, out=p)
        total = p @ ones[:_CLASSES]
        lp -= np.log(total)
        g = {}
        if ds is not None:
            scale = p.dtype.type(1 / max(1, n))
            p *= (scale / total)[:, None]
            p[every, c] -= scale
            both = s.T @ p
            g = {"out": both[:-1], "out0": both[-1], "word": np.zeros_like(w["word"]), "word0": np.zeros_like(w["word0"])}
            own = p @ w["out"].T
        j = y % CLASS
        totals = np.ones(n, s.dtype)
        for k in range(_CLASSES - 1):
            a, z = edge[k], edge[k + 1]
            if a == z:
                continue
            q = scored(s[a:z], word1[k])
            at = every[: z - a], j[a:z]
            lp[a:z] += q[at]
            np.exp(q, out=q)
            total = np.matmul(q, ones[:CLASS], out=totals[a:z])
            if ds is not None:
                q *= (scale / total)[:, None]
                q[at] -= scale
                both = s[a:z].T @ q
                g["word"][k], g["word0"][k] = both[:-1], both[-1]
                own[a:z] += q @ w["word"][k].T
        lp -= np.log(totals)
        if ds is not None:
            ds[order] = own
        out = np.empty_like(lp)
        out[order] = lp
        return out, g

    def gradients(self, x, y, fresh, live, h):
        """Truncated backpropagation through one window; live (T, B): positions that exist. Returns the gradients of the
        mean loss, the state and the summed log probability."""
        H, w = STATE, self.w
        (T, B), kind = x.shape, w["out"].dtype
        states, h, (before, gates, inner) = self._forward(x, fresh, h, True)
        begins = fresh.any(1)
        at = np.flatnonzero(live.ravel())
        ds = np.zeros((T * B, H), kind)
        whole = len(at) == T * B
        part = ds if whole else np.empty((len(at), H), kind)
        flat = states.reshape(-1, H)
        lp, g = self._logits(flat if whole else flat[at], y.ravel() if whole else y.ravel()[at], part)
        if not whole:
            ds[at] = part
        ds = ds.reshape(T, B, H)
        # By candidate, both gates, and the candidate's recurrent part: the first three are the inputs', the last three the states'.
        d = np.empty((4, T, B, H), kind)
        dh, back = np.zeros((B, H), kind), np.empty((3, B, H), kind)
        turn = np.ascontiguousarray(_apart(w["turn"]).transpose(0, 2, 1))
        one, two = np.empty((B, H), kind), np.empty((B, H), kind)
        for t in range(T - 1, -1, -1):
            z, r, n = gates[:, t]
            dn, dz, dr, dv = d[:, t]
            dh += ds[t]
            np.multiply(dh, z, out=one)  # what goes on to the state before
            np.subtract(dh, one, out=dn)
            np.subtract(before[t], n, out=dz)
            dz *= one
            np.subtract(1, z, out=two)
            dz *= two
            np.multiply(n, n, out=two)
            np.subtract(1, two, out=two)
            dn *= two
            np.multiply(dn, r, out=dv)
            np.subtract(1, r, out=dr)
            dr *= dv
            dr *= inner[t]
            np.matmul(d[1:, t], turn, out=back)
            np.add(one, back[0], out=dh)
            dh += back[1]
            dh += back[2]
            if begins[t]:
                dh[fresh[t]] = 0
        d = d.reshape(4, -1, H)
        g["turn"] = np.concatenate([before.reshape(-1, H).T @ d[k] for k in (1, 2, 3)], axis=1)
        # Each symbol's vector has the sum over the places where it stands.
        symbols = x.ravel().astype(np.intp)
        vectors = w["embed"][symbols].T
        g["gates"] = np.concatenate([vectors @ d[k] for k in (1, 2, 0)], axis=1)
        g["gates0"] = np.concatenate([d[k].sum(0) for k in (1, 2, 0)])
        dembed = sum(m @ d[k].T for k, m in zip((1, 2, 0), np.split(w["gates"], 3, axis=1)))
        g["embed"] = np.stack([np.bincount(symbols, v, len(w["embed"])) for v in dembed], axis=1).astype(kind)
        return g, h, float(lp.sum())

    def step(self, g, rate):
        """One update by clipped gradients with running moments."""
        self.steps += 1
        a, b = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        for k, v in self.w.items():
            d = np.clip(g[k], -0.05, 0.05)
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            v -= (rate / a) * self.m[k] / (np.sqrt(self.v[k] / b) + 1e-7)


def _windows(docs: list[np.ndarray], width: int = LANES, stretch: int | None = None):
    """Documents (symbols without ends) laid end to end into lanes of about equal length, cut into windows.

    Yields x, y, fresh, owner, each (steps, lanes): inputs, targets, where no state comes in, document numbers
    (-1: nothing). Lanes are ordered by length, longest first, so that lanes still running are always the first
    ones. With `stretch`, a longer document goes in pieces of so many symbols, each without the state of the one before.
    """
    pieces = [(i, a, min(a + stretch, len(d) + 1) if stretch else len(d) + 1) for i, d in enumerate(docs) for a in range(0, len(d) + 1, stretch or len(d) + 1)]
    width = max(1, min(width, len(pieces)))
    heap = [(0, k) for k in range(width)]
    held: list[list[int]] = [[] for _ in range(width)]
    for i in sorted(range(len(pieces)), key=lambda i: pieces[i][1] - pieces[i][2]):
        n, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (n + pieces[i][2] - pieces[i][1], k))
    size = np.array([sum(pieces[i][2] - pieces[i][1] for i in lane) for lane in held])
    order = np.argsort(-size, kind="stable")
    flat = [pieces[i] for k in order.tolist() for i in held[k]]
    lengths = np.array([z - a for _, a, z in flat])
    begins = np.cumsum(lengths) - lengths
    end = np.array([_END], np.uint16)
    y = np.concatenate([part for i, a, z in flat for part in ((docs[i][a:z], end) if z > len(docs[i]) else (docs[i][a:z],))]).astype(np.int32)
    x = np.concatenate(([_END], y[:-1])).astype(np.int32)
    x[begins] = [docs[i][a - 1] if a else _END for i, a, _ in flat]
    fresh = np.zeros(len(y), bool)
    fresh[begins] = True
    owner = np.repeat(np.array([i for i, *_ in flat], np.int32), lengths)
    size = size[order]
    begin = np.cumsum(size) - size
    for t in range(0, int(size[0]), WINDOW):
        use = int((size > t).sum())
        step = np.arange(t, min(t + WINDOW, int(size[0])))[:, None]
        there = step < size[:use]
        at = np.where(there, begin[:use] + step, 0)
        yield x[at], y[at], fresh[at] & there, np.where(there, owner[at], -1)


def fit(net: Network, docs: list[np.ndarray], rate: float) -> float:
    h, total = None, 0.0
    for x, y, fresh, owner in _windows(docs, stretch=STRETCH):
        h = np.zeros((x.shape[1], STATE), np.float32) if h is None else h[: x.shape[1]]
        g, h, lp = net.gradients(x, y, fresh, owner >= 0, h)
        net.step(g, rate)
        total += lp
    return total


def likelihoods(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's symbols and end."""
    out, h = np.zeros(len(docs)), None
    for x, y, fresh, owner in _windows(docs, WIDE):
        h = np.zeros((x.shape[1], STATE), np.float32) if h is None else h[: x.shape[1]]
        states, h, _ = net._forward(x, fresh, h, False)
        at = np.flatnonzero(owner.ravel() >= 0)
        lp, *_ = net._logits(states.reshape(-1, STATE)[at], y.ravel()[at])
        out += np.bincount(owner.ravel()[at], lp.astype(np.float64), len(docs))
    return out


#: Words that a task lays into lanes at once, about.
LANE_WORDS = 4_000_000


def _gathered(batches, column: int):
    """Lists of (rows, symbols) of about LANE_WORDS words; rows as (batch, row)."""
    rows, docs, held = [], [], 0
    for batch in batches:
        for i, data in enumerate(batch.column(column)):
            rows.append((batch, i))
            docs.append(np.frombuffer(data.as_buffer(), np.uint16))
            held += len(docs[-1]) + 1
            if held >= LANE_WORDS:
                yield rows, docs
                rows, docs, held = [], [], 0
    if rows:
        yield rows, docs


def _packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in sorted(new_weights().items()):
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


_WEIGHTS = "part int, words long, weights binary"


def _trained(slices: DataFrame, groups: int, start: np.ndarray, rate: float) -> DataFrame:
    """Of slices(group, key, symbols): each group's weights after training on its documents in the order of their keys."""

    def run(batches):
        net, seen, group = Network(_unpacked(start)), 0, None
        for rows, symbols in _gathered(batches, 2):
            group = rows[0][0].column(0)[0].as_py()
            fit(net, symbols, rate)
            seen += sum(len(s) + 1 for s in symbols)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([seen], pa.int64()), pa.array([_packed(net.w).astype("<f4").tobytes()])], ["part", "words", "weights"])

    dealt = slices.repartitionById(groups, F.col("group")).sortWithinPartitions("key", "symbols")
    return dealt.select("group", "key", "symbols").mapInArrow(run, _WEIGHTS)


def _averaged(parts: DataFrame, groups: int) -> np.ndarray | None:
    """The word-weighted mean of all groups' weights: by 32 at a time, in the order of their numbers; one row reaches the driver."""

    def mean(batches):
        own = [row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        own.sort()
        for part in sorted({p // 32 for p, *_ in own}):
            few = [(n, np.frombuffer(w, "<f4").astype(np.float64)) for p, n, w in own if p // 32 == part]
            total = sum(n for n, _ in few)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([(sum(n * w for n, w in few) / total).astype("<f4").tobytes()])], ["part", "words", "weights"])

    while True:
        groups = -(-groups // 32)
        parts = parts.repartitionById(groups, (F.col("part") / 32).cast("int")).mapInArrow(mean, _WEIGHTS)
        if groups == 1:
            rows = parts.collect()
            return np.frombuffer(rows[0]["weights"], "<f4") if rows else None


def scored(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", known_words: int = KNOWN_WORDS, rates: tuple[float, ...] = RATES) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10).

    `learn` says which rows train. Null text is empty: its end alone. Rows that repeat id and text count
    each time in training and score alike. Without training rows the network stays as it began,
    which is close to the unigram counts. An empty table gives no rows; further columns don't matter.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    # Copies of a text have different keys: a text that makes up much of the corpus is spread over the groups.
    d = d.withColumn("key", F.xxhash64("text", "doc_id"))
    ends = d.where("learn").count()
    counts = save(word_counts(d.where("learn").select("text")), "lm-words")
    frequent = save(counts.orderBy(F.col("n").desc(), "name").limit(known_words).select("name", "spelling", "n"), "lm-known").toArrow().to_pydict()
    tokens, distinct = np.zeros(SPELLINGS, np.int64), np.zeros(SPELLINGS, np.int64)
    for r in counts.groupBy("spelling").agg(F.sum("n").alias("a"), F.count("*").alias("b")).collect():
        tokens[r["spelling"]], distinct[r["spelling"]] = r["a"], r["b"]
    total, kinds = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)
    vocabulary = Vocabulary(list(zip(*(frequent[c] for c in ("name", "spelling", "n")))), tokens, distinct)
    texts = save(encoded(d, vocabulary), "lm-texts")
    release(spark)

    start = _packed(unigram_weights(vocabulary, ends))
    groups = max(LEAST_GROUPS, min(MOST_GROUPS, -(-total // GROUP_WORDS)))
    mixed = F.xxhash64("key")
    training = texts.where("learn").select(F.pmod(mixed, F.lit(groups)).cast("int").alias("group"), F.pmod(F.shiftrightunsigned(mixed, 32), F.lit(len(rates))).alias("slice"), "key", "symbols")
    for k, rate in enumerate(rates):
        trained = _averaged(save(_trained(training.where(F.col("slice") == k), groups, start, rate), "lm-weights"), groups)
        start = start if trained is None else trained

    def run(batches):
        net = Network(_unpacked(start))
        for rows, symbols in _gathered(batches, 1):
            lp = likelihoods(net, symbols) / np.log(10)
            # A word without a symbol of its own has its share of what its spelling has.
            shared = [float(vocabulary.log_rest[s[s >= WORDS] - WORDS].sum()) for s in symbols]
            names = [batch.column(0)[i].as_py() for batch, i in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([float(p - q) for p, q in zip(lp, shared)], pa.float64())], ["row", "net"])

    network = texts.select("row", "symbols").mapInArrow(run, "row long, net double")
    out = texts.drop("symbols", "names", "times", "key", "learn").join(network, "row")
    if not vocabulary.complete:
        words = texts.where(F.size("names") > 0).select("row", F.explode(F.arrays_zip("names", "times")).alias("w")).select("row", F.col("w.names").alias("name"), F.col("w.times").alias("n"))
        looked = words.join(counts.select("name", F.col("n").alias("c")), "name", "left")
        looked = looked.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found"))
        out = out.join(looked, "row", "left")
    else:
        out = out.withColumns({"more": F.lit(0.0), "found": F.lit(0)})
    more = F.coalesce("more", F.lit(0.0))
    end = float(np.log10(ends + 0.5))
    norm = float(np.log10(total + 0.5 * (kinds + 1)))
    return out.select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + more + F.lit(end) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("net") + F.col("rest") + more).alias("score"),
    )
