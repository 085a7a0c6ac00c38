"""Exact n-gram Jaccard join: documents, classes and connected components.

Documents with the same window set are one class. Windows are ordered by how many classes hold them,
rare ones first, so that two classes can only reach the threshold if their prefixes share a window;
windows that a single class holds can never match and are not kept. Classes with identical prefix and
size form a group; group pairs are filtered by size and position, and only groups that share a prefix
window are compared. Inside a group, and in each list of groups that share a window, all first meet one
member; what links then needs no comparison with the rest of its component. What remains is compared
pair by pair, so that no link between different texts is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ._spark import prepare, release, save, tidied, unused
from ._text import chunks, mix64, shingle_hashes, string_buffers, word_hashes

#: Windows of one bucket, at most on average; buckets are a power of two of at least LEAST_BUCKETS, tasks at least LEAST_TASKS.
BUCKET_TOKENS, LEAST_BUCKETS, MOST_BUCKETS = 1_500_000, 256, 1 << 24
LEAST_TASKS = 32
#: Windows gathered before a map task hands blobs on, and sets of these that a window must be in to be looked at as hot.
FLUSH_TOKENS, FLUSH_SETS = 500_000, 8
#: A window is hot if one in so many sets holds it, and LEAST_HOT sets at least; at most MOST_HOT windows are.
HOT_SHARE, LEAST_HOT, MOST_HOT = 200, 500, 1 << 17
#: The windows travel in so many rounds, one part of the buckets each, so that no more of them lie on disk at once.
ROUNDS = 2
#: A window and a class of how many sets hold it: the order of windows needs no more.
_ENTRY = np.dtype([("t", "<u8"), ("d", "u1")])


def _sets(batch: pa.RecordBatch, width: int):
    """(row, window set) of every row of a batch (columns id, text)."""
    raw, off = string_buffers(batch.column(1))
    for a, z in chunks(off):
        words, rows = word_hashes(raw, off[a : z + 1])
        yield from enumerate(shingle_hashes(words, rows, width), a)


def _fingerprint(s: np.ndarray, bits: int) -> tuple[int, int, int]:
    """A 64-bit name of a set (a sum of scrambled members and its size), a second one to tell whether the first is
    shared by other sets, and a name for that case. With fewer bits the first takes fewer values, for tests."""
    with np.errstate(over="ignore"):
        x = mix64(s ^ np.uint64(0x2545F4914F6CDD1D))
        sums = np.array([x.sum(), mix64(x ^ np.uint64(0x9E6C63D0876A9A47)).sum()], np.uint64) + np.uint64(len(s))
        name, check = mix64(sums)
        name = name & np.uint64((1 << bits) - 1) if bits < 64 else name
        other = mix64(np.array([name * np.uint64(3) ^ check]))[0]
    return tuple(int(np.uint64(v).astype(np.int64)) for v in (name, check, other))


def document_sets(docs: DataFrame, width: int, bits: int = 64) -> DataFrame:
    """Kind 0: doc_id, n_shingles, fp, check, other: the size and names of each document's window set; and what docs has
    after id and text. Kind 1: windows (fp) that many sets of one stretch of documents hold (n_shingles)."""
    more = docs.schema.fields[2:]
    names = ["kind", "doc_id", "n_shingles", "fp", "check", "other", *[f.name for f in more]]

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size, empty = 0, None

        def common():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            w, n = w[n >= FLUSH_SETS].astype(np.int64), n[n >= FLUSH_SETS]
            void = [pa.nulls(len(w), pa.int64())] * 2 + [pa.nulls(len(w), t) for t in empty]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(w), np.int32)), pa.nulls(len(w), pa.int64()), pa.array(n, pa.int64()), pa.array(w), *void], names)

        for batch in batches:
            empty = [c.type for c in batch.columns[2:]]
            n, found = [], []
            for _, s in _sets(batch, width):
                n.append(len(s))
                found.append(_fingerprint(s, bits))
                if len(s) and found[-1][0] not in seen:
                    seen.add(found[-1][0])
                    held.append(s)
                    size += len(s)
            fp = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n, pa.int64()), *[pa.array(fp[:, k]) for k in range(3)], *batch.columns[2:]], names)
            if size >= FLUSH_TOKENS:
                yield common()
                held, size = [], 0
        if held:
            yield common()

    return docs.mapInArrow(tidied(run), "kind int, doc_id long, n_shingles long, fp long, check long, other long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more))


def _blobs(docs: DataFrame, width: int, buckets: int, hot: np.ndarray, shared_names: frozenset, bits: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """Windows dealt to buckets by the first bits of their names, packed: set names, runs, and the last 56 bits.
    Of all buckets those whose number is `turn` modulo `turns`.

    A run is up to 255 windows of one set; a set's windows of one bucket all lie in one row. Hot windows are in rows
    of their own, as numbers in the list, and dealt by the name of the set, so no bucket gets all of one.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches):
        seen: set[int] = set()  # each set once per partition, however many copies it has there
        sets: list[np.ndarray] = []
        fps: list[int] = []
        held = 0

        def flush():
            tok = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
            fp = np.array(fps, np.int64)
            at = np.searchsorted(hot, tok)
            at[at == len(hot)] = 0
            is_hot = hot[at] == tok if len(hot) else np.zeros(len(tok), bool)
            by = np.where(is_hot, mix64(fp.view(np.uint64))[doc], tok)
            bucket = (by >> shift).astype(np.int64) * 2 + is_hot
            tok = np.where(is_hot, at.astype(np.uint64), tok)
            if turns > 1:
                mine = (bucket >> 1) % turns == turn
                tok, doc, bucket = tok[mine], doc[mine], bucket[mine]
            order = np.argsort(bucket, kind="stable")
            tok, doc, bucket = tok[order], doc[order], bucket[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            rows: list[list] = [[] for _ in range(6)]
            for a, z in zip(edge.tolist(), edge[1:].tolist()):
                first = np.flatnonzero(np.concatenate(([True], doc[a + 1 : z] != doc[a : z - 1])))
                count = np.diff(np.append(first, z - a))
                parts = (count + 254) // 255
                last = np.cumsum(parts) - 1
                sizes = np.full(int(parts.sum()), 255, np.uint8)
                sizes[last] = count - (parts - 1) * 255
                t, is_list = tok[a:z], bool(bucket[a] % 2)
                high = b"" if is_list else (t >> np.uint64(32)).astype("<u2").tobytes() + (t >> np.uint64(48)).astype(np.uint8).tobytes()
                values = (int(bucket[a]) // 2, is_list, fp[np.repeat(doc[a:z][first], parts)].tobytes(), sizes.tobytes(), t.astype("<u4").tobytes(), high)
                for r, v in zip(rows, values):
                    r.append(v)
            kinds = [pa.int32(), pa.bool_()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["bucket", "hot", "fps", "counts", "low", "high"])

        for batch in batches:
            for _, s in _sets(batch, width):
                if not len(s):
                    continue
                fp, _, other = _fingerprint(s, bits)
                fp = other if fp in shared_names else fp
                if fp not in seen:
                    seen.add(fp)
                    sets.append(s)
                    fps.append(fp)
                    held += len(s)
                    if held >= FLUSH_TOKENS:
                        yield flush()
                        sets, fps, held = [], [], 0
        if sets:
            yield flush()

    return docs.mapInArrow(tidied(run), "bucket int, hot boolean, fps binary, counts binary, low binary, high binary")


def _entries_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set names, and for each window the number of its set and its own last bits; a set that several rows hold counts once."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    fp, count, tok = join("fps", "<i8"), join("counts", np.uint8), join("low", "<u4").astype(np.uint64)
    high = [(np.frombuffer(x, "<u2", n := len(x) // 3), np.frombuffer(x, np.uint8, offset=2 * n)) for x in table.column("high").to_pylist() if x]
    if high:
        tok |= np.concatenate([m for m, _ in high]).astype(np.uint64) << np.uint64(32)
        tok |= np.concatenate([h for _, h in high]).astype(np.uint64) << np.uint64(48)
    row = np.repeat(np.arange(table.num_rows), [x.as_buffer().size for c in table.column("counts").chunks for x in c])
    name, first, back = np.unique(fp, return_index=True, return_inverse=True)
    keep = np.repeat(row == row[first][back], count)  # copies in other rows bring the same windows again
    return name, np.repeat(back.astype(np.int32), count)[keep], tok[keep]


def _shared_windows(hot: np.ndarray, sets_of_hot: np.ndarray, buckets: int):
    """Of one bucket: for every set its windows that some other set holds too, with the number of sets that hold them.
    Hot windows have the number that was counted before."""

    def packed(name: np.ndarray, owner: np.ndarray, tok: np.ndarray, df: np.ndarray) -> pa.Table:
        order = np.argsort(owner, kind="stable")
        entry = np.empty(len(tok), _ENTRY)
        entry["t"], entry["d"], owner = tok[order], np.minimum(255, 8 * np.log2(df[order])), owner[order]
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(1, np.int64)
        data = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer((edge * _ENTRY.itemsize).astype(np.int64)), pa.py_buffer(entry.tobytes())])
        return pa.table([pa.array(name[owner[edge[:-1]]] if len(owner) else name[:0]), data.cast(pa.binary())], names=["fp", "entries"])

    def run(table: pa.Table) -> pa.Table:
        flags = table.column("hot")
        out = []
        rare = table.filter(pa.compute.invert(flags))
        if rare.num_rows:
            name, owner, tok = _entries_of(rare)
            # The bucket's number begins with the first 8 bits.
            tok |= np.uint64(table.column("bucket")[0].as_py() >> (buckets.bit_length() - 9)) << np.uint64(56)
            order = np.argsort(tok)
            tok, owner = tok[order], owner[order]
            edge = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1], [True])))
            df = np.diff(edge).astype(np.uint32)
            many = np.repeat(df > 1, df)
            out.append(packed(name, owner[many], tok[many], np.repeat(df, df)[many]))
        rest = table.filter(flags)
        if rest.num_rows:
            name, owner, tok = _entries_of(rest)
            out.append(packed(name, owner, hot[tok], sets_of_hot[tok]))
        return pa.concat_tables(out)

    return run


def _candidates(shared: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Sets that can have a partner: fp, n, own (windows no other set holds), prefix, seed, tokens."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            fps, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for fp, n, parts in zip(fps, ns, batch.column(2)):
                e = np.frombuffer(b"".join(x.as_py() for x in parts.values), _ENTRY)
                own, length = n - len(e), n - -(-n * num // den) + 1
                if own >= length:
                    continue  # its prefix holds only windows of its own
                prefix = e["t"][np.lexsort((e["t"], e["d"]))][: length - own]
                tokens = np.sort(e["t"])
                for r, v in zip(rows, (fp, n, own, prefix.astype(np.int64), int(mix64(tokens).min().astype(np.int64)), tokens.tobytes())):
                    r.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["fp", "n", "own", "prefix", "seed", "tokens"])

    grouped = shared.groupBy("fp").agg(F.collect_list("entries").alias("parts")).join(sizes, "fp")
    return grouped.select("fp", "n", "parts").mapInArrow(tidied(run), "fp long, n long, own long, prefix array<long>, seed long, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, common: the windows that the two sets share."""

    def run(batches):
        for batch in batches:
            common = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common.append(int((y[at] == x).sum()) if len(y) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("a", "b", "na", "nb")] + [pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"])

    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(tidied(run), "a long, b long, na long, nb long, common long")


def components(edges: DataFrame) -> DataFrame:
    """node, label of the connected components of edges(a, b): the smallest node of each, by label passing and pointer jumping."""
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "link-edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "link-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = save(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "link-labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after further links: old components are contracted to their labels, and only what the links add to
    them is searched for components."""
    if labels is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("label").alias(f"c{end}"))
        ends = ends.join(of, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    new = save(ends.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "link-new")
    if new.isEmpty():
        return labels
    top = components(new)
    # Every end that had no label is a component of its own so far.
    alone = top.select("node").join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    up = top.select(F.col("node").alias("label"), F.col("label").alias("higher"))
    return save(labels.unionByName(alone).join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label")), "link-labels")


def _linked(num: int, den: int) -> Column:
    return F.col("common") * den >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("common"))


def _across(rows: DataFrame) -> DataFrame:
    """Of rows(token, fp, comp, ...) those of tokens that still meet different components."""
    span = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("fp").alias("pivot")).where("lo <> hi")
    return rows.join(span.select("token", "pivot"), "token")


def jaccard_components(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the components of the graph that links documents of Jaccard >= threshold.

    Words and windows are compared by 64-bit hashes: two given sets of A and B windows have a false common one with
    a chance of A * B / 2^64. Classes of equal sets are told apart by 128 bits. Null or empty text, or text without
    words, has no windows and links with nothing. Rows that repeat a doc_id are documents of their own; a row
    without doc_id has no component. An empty table gives no rows. Further columns don't matter.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own, labels = _labelled(d, width, threshold)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return own.join(labels, "fp", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def _named(docs: DataFrame, width: int, bits: int) -> tuple[DataFrame, frozenset, np.ndarray, np.ndarray]:
    """The document_sets of docs with names that no two sets share; the names that did; hot windows and their numbers of sets."""
    every = save(document_sets(docs, width, bits), "jaccard-documents")
    own = every.where("kind = 0").drop("kind")
    # Names of 64 bits: of n sets about n^2 / 2^65 share one, some hundred of a hundred billion.
    clash = own.where("n_shingles > 0").groupBy("fp").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("fp")
    shared_names = frozenset(r["fp"] for r in clash.collect())
    if shared_names:
        own = own.withColumn("fp", F.when(F.col("n_shingles") > 0, F.when(F.col("fp").isin(*shared_names), F.col("other")).otherwise(F.col("fp"))).otherwise(F.col("fp")))
    least = max(LEAST_HOT, own.count() // HOT_SHARE)
    # Any list does, as long as all sets use the same; at most MOST_HOT pairs of numbers.
    hot = every.where("kind = 1").groupBy("fp").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "fp").limit(MOST_HOT).collect()
    names = np.array([r["fp"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(names)
    return own.drop("check", "other"), shared_names, names[order], np.minimum(np.array([r["n"] for r in hot], np.int64)[order], 2**32 - 1).astype(np.uint32)


def _labelled(docs: DataFrame, width: int, threshold: tuple[int, int], bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The document_sets of docs(doc_id, text, ...), and fp, comp, component_id of those with windows; comp names one component only."""
    num, den = threshold
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select("doc_id", "text")
    own, shared_names, hot, sets_of_hot = _named(docs, width, bits)
    named = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = min(MOST_BUCKETS, max(LEAST_TASKS, -(-total // BUCKET_TOKENS)))
    buckets = max(LEAST_BUCKETS, 1 << (tasks - 1).bit_length())
    shared = None
    for turn in range(ROUNDS):
        blobs = _blobs(d.where("doc_id IS NOT NULL"), width, buckets, hot, shared_names, bits, turn, ROUNDS)
        blobs = blobs.withColumn("task", F.floor(F.col("bucket").cast("long") * tasks / buckets).cast("int"))
        found = blobs.repartitionById(tasks, F.col("task")).groupBy("task", "bucket").applyInArrow(_shared_windows(hot, sets_of_hot, buckets), "fp long, entries binary")
        found = save(found, "jaccard-shared")
        shared = found if shared is None else shared.unionByName(found)
        release(spark)
    sizes = named.groupBy("fp").agg(F.first("n_shingles").alias("n"))
    sets = save(_candidates(shared, sizes, num, den), "jaccard-candidates")
    del shared
    release(spark)

    # Groups of identical prefix and size; their first member speaks for them.
    slim = sets.select("fp", "n", "own", "prefix", "seed", F.xxhash64("n", "own", "prefix").alias("key"))
    heads = slim.groupBy("key", "n").agg(F.min("fp").alias("head"))
    slim = save(slim.join(heads, ["key", "n"]).drop("key"), "jaccard-groups")
    in_group = slim.where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    seeds = slim.groupBy("seed").agg(F.min("fp").alias("a"))
    by_seed = slim.join(seeds, "seed").where("fp <> a").select("a", F.col("fp").alias("b"))
    tested = save(_verified(in_group.unionByName(by_seed).distinct(), sets), "jaccard-tested-1")
    links = tested.where(_linked(num, den)).select("a", "b")
    comps = joined_components(None, links)

    # Members that don't link to their head stand for themselves.
    reach = tested.join(slim.select(F.col("fp").alias("b"), F.col("head").alias("a")), ["a", "b"]).where(_linked(num, den))
    reach = save(reach.select(F.col("a").alias("head"), F.col("b").alias("fp"), (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("far")), "jaccard-members")
    stand = save(slim.join(reach.select("fp"), "fp", "left_anti").select("fp", "n", "own", F.posexplode("prefix").alias("at", "token")).select("fp", "n", "token", (F.col("own") + F.col("at")).alias("at")), "jaccard-prefixes")

    def placed(c: DataFrame) -> DataFrame:
        return _across(stand.join(c.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("comp", F.coalesce("label", "fp")).drop("label"))

    def can_link(x: str, y: str) -> Column:
        """By size, and by the windows left from the first shared one on."""
        nx, ny, ix, iy = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.at", f"{y}.at"))
        least = F.ceil((nx + ny) * num / (num + den) - 1e-9)
        return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (1 + F.least(nx - ix, ny - iy) - 1 >= least)

    # Each list of groups that share a window meets its first member.
    rows = placed(comps).alias("x")
    first = stand.alias("y")
    star = rows.join(first, (F.col("x.token") == F.col("y.token")) & (F.col("x.pivot") == F.col("y.fp"))).where((F.col("x.fp") != F.col("y.fp")) & can_link("x", "y"))
    star = star.select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = save(_verified(star, sets), "jaccard-tested-2")
    tested = tested.unionByName(more)
    comps = joined_components(comps, more.where(_linked(num, den)).select("a", "b"))

    # What still meets across components is compared pair by pair.
    left = save(placed(comps), "jaccard-open")
    x, y = left.alias("x"), left.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.comp") != F.col("y.comp"))).where(can_link("x", "y"))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = save(_verified(pairs, sets), "jaccard-tested-3")
    tested = tested.unionByName(more)
    comps = joined_components(comps, more.where(_linked(num, den)).select("a", "b"))

    # Heads that don't link while members of theirs might: the triangle inequality leaves few.
    comps = joined_components(comps, save(_expanded(tested, reach, comps, sets, num, den), "jaccard-links"))

    classes = named.groupBy("fp").agg(F.min("doc_id").alias("first")).join(comps.withColumnRenamed("node", "fp"), "fp", "left")
    classes = save(classes.select("fp", "label", F.coalesce("label", "fp").alias("comp"), "first"), "jaccard-classes")
    # A class that links with no other is its own component; the others meet the least id of theirs.
    least = classes.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("component_id"))
    alone = classes.where("label IS NULL").select("fp", "comp", F.col("first").alias("component_id"))
    return own, save(alone.unionByName(classes.join(least, "label").select("fp", "comp", "component_id")), "jaccard-components")


def _expanded(tested: DataFrame, reach: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between members of groups whose heads were compared and lie in different components.

    Jaccard distance is a metric: members x of head p and y of head q can only link if d(p, q) is at most
    d(x, p) + d(y, q) + 1 - threshold.
    """
    label = lambda c: comps.select(F.col("node").alias(c), F.col("label").alias(f"c{c}"))
    far = tested.withColumn("d", 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "d")
    far = far.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    members = reach.select("head", "fp", "far")
    ends = members.unionByName(reach.select("head", F.col("head").alias("fp"), F.lit(0.0).alias("far")).distinct())
    radius = members.groupBy("head").agg(F.max("far").alias("r"))
    room = 1 - num / den + 1e-9
    far = far.join(radius.select(F.col("head").alias("a"), F.col("r").alias("ra")), "a", "left").join(radius.select(F.col("head").alias("b"), F.col("r").alias("rb")), "b", "left")
    far = far.where((F.col("ra").isNotNull() | F.col("rb").isNotNull()) & (F.col("d") <= F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0)) + room)).select("a", "b", "d")
    xs = far.join(ends.select(F.col("head").alias("a"), F.col("fp").alias("x"), F.col("far").alias("fx")), "a", "left").withColumns({"x": F.coalesce("x", "a"), "fx": F.coalesce("fx", F.lit(0.0))})
    both = xs.join(ends.select(F.col("head").alias("b"), F.col("fp").alias("y"), F.col("far").alias("fy")), "b", "left").withColumns({"y": F.coalesce("y", "b"), "fy": F.coalesce("fy", F.lit(0.0))})
    both = both.where((F.col("d") <= F.col("fx") + F.col("fy") + room) & ~((F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))))
    return _verified(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), sets).where(_linked(num, den)).select("a", "b")


def first_of_each_component(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of docs the row with the smallest id, of several texts of that id one; rows without id stay.

    Rows that repeat an id with texts that nothing links are components of their own, so each stays; rows that
    repeat id and text stay once.
    """
    named = F.xxhash64(F.col(text_col).cast("string"))
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), named.alias("row"))
    own, labels = _labelled(d, width, threshold)
    own = own.where("doc_id IS NOT NULL")
    least = own.where("n_shingles > 0").join(labels, "fp").groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("k")).select("k.*")
    doc, row = unused(docs.columns, "doc", "row")
    found = save(least.unionByName(own.where("n_shingles = 0").select("doc_id", "row").distinct()), "jaccard-kept").select(F.col("doc_id").alias(doc), F.col("row").alias(row))
    rows = docs.where(F.col(id_col).isNotNull()).withColumns({doc: F.col(id_col).cast("long"), row: named})
    kept = rows.join(found, [doc, row], "left_semi").dropDuplicates([doc, row])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
