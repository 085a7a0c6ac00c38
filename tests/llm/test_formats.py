"""Chats, token shards, mixing, packing, archives and the pipeline, by round trips and brute force."""

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import chat, mixing, packing, queries, sstable, warc
from chronoloom.llm._bpe import Encoder
from chronoloom.llm._text import string_buffers

VOCABULARY = queries._vocabulary()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, bin long, piece int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3) for i, t, s in rows], DOCS)


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library():
    r = random.Random(1)
    pieces = ["'s", "'re", " 'll", "''s", "'", "  ", " \n", "\n\n", "a", "b1", "  x", "!!", "'tx", "don't", "I'M", "<|endoftext|>", "<|end", "é", "中文", "１2", " ", "　 ", "😀", "é", "\r\n", "\x0b", "\x85"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(3000)] + ["", None, "x" * 30000, "word " * 9000]
    import pyarrow as pa

    raw, off = string_buffers(pa.array(texts))
    got = [None] * len(texts)
    for a, z, flat, rows in Encoder(VOCABULARY).encode(raw, off):
        for i in range(a, z):
            got[i] = flat[rows[i - a] : rows[i - a + 1]].tolist()
    assert got == library_ids([t or "" for t in texts])


# Chats.

MESSAGES = "tree long, node long, parent long, role string, text string, score double, leaf int, formatted string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], MESSAGES)


def test_trees_and_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", "c", 0.0), (1, 5, 4, "assistant", "d", 1.0), (2, 7, 99, None, None, None)]
    rows += [(3, k, k - 1 if k else None, "user", str(k), 0.0) for k in range(40)]
    got = {(r["tree"], r["leaf"]): r for r in chat.read_chats(chat.format_chats(messages(spark, rows))).collect()}
    assert set(got) == {(1, 2), (1, 5), (2, 7), (3, 39)}
    assert [t["text"] for t in got[1, 5]["turns"]] == ["q", "b", "c", "d"] and got[1, 5]["loss_texts"] == ["b", "d"]
    assert got[1, 5]["branch"] == 1 and got[1, 2]["branch"] == 2
    assert [t["text"] for t in got[3, 39]["turns"]] == [str(k) for k in range(40)]
    assert got[2, 7]["formatted"] == "<|im_start|>\n<|im_end|>\n"
    assert [r["leaf"] for r in chat.format_chats(messages(spark, rows[:5]), branches=1).collect()] == [5]


def test_trees_with_cycles_are_set_aside(spark):
    # A cycle alone, a cycle with a branch below it, and a sound tree; trees without a name are trees too.
    rows = [(1, 1, 2, "u", "x", 0.0), (1, 2, 1, "u", "y", 0.0), (2, 1, None, "u", "root", 0.0), (2, 2, 3, "u", "a", 0.0), (2, 3, 2, "u", "b", 0.0), (2, 4, 3, "u", "c", 0.0)]
    rows += [(3, k, k - 1 if k else None, "u", str(k), 0.0) for k in range(9)] + [(None, 1, None, "u", "p", 0.0), (None, 2, 1, "u", "q", 0.0), (4, 1, 1, "u", "self", 0.0)]
    got = {(r["tree"], r["leaf"]): r["turns"] for r in chat.read_chats(chat.format_chats(messages(spark, rows))).collect()}
    assert set(got) == {(1, None), (2, None), (3, 8), (None, 2), (4, None)}
    assert [t["text"] for t in got[None, 2]] == ["p", "q"] and len(got[3, 8]) == 9 and got[1, None] is None


def test_repeated_messages_stay_apart(spark):
    rows = [(1, 1, None, "u", "root", 0.0), (1, 2, 1, "u", "b", 0.0), (1, 2, 1, "u", "a", 0.0), (1, 3, 2, "u", "reply", 0.0), (1, None, 1, "u", "no node", 0.0), (1, None, None, "u", "alone", 0.0)]
    got = sorted(" ".join(t["text"] for t in r["turns"]) for r in chat.read_chats(chat.format_chats(messages(spark, rows))).collect())
    assert got == ["alone", "root a reply", "root b", "root no node"]


def test_escapes_are_reversible(spark):
    r = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "\\", "\\n", "\\b", "<|", "|>", "é", "<|im_end|>\n", "assistant", "$1", ""]
    rows = []
    for c in range(150):
        for t in range(r.randrange(1, 5)):
            rows.append((c, t, "".join(r.choice(["assistant", *bits]) for _ in range(2)) if c % 3 else r.choice(("user", "assistant")), "".join(r.choice(bits) for _ in range(r.randrange(6)))))
    rows += [(None, 1, "user", "x"), (None, None, None, None), (500, 0, "user", "same"), (500, 0, "user", "same"), (501, 1, "assistant", "long " * 30000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_chats(chat.format_chats(chat.linear_threads(df))).collect()
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r["tree"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        assert "".join(r["loss_texts"]) == "".join(x for role, x in want[r["tree"]] if role == "assistant")
        assert r["formatted"].count("<|im_end|>") == len(want[r["tree"]])
    assert chat.format_chats(chat.linear_threads(df.where("conv_id > 1000"))).count() == 0


# Token shards.

TEXTS = [(5, "five", "a"), (3, None, "a"), (9, "", None), (None, "no name", "b"), (3, "again", "b"), (3, "again", "b"), (-7, "below zero", "c"), (2**40, "long " * 30000, "c"), (12, "<|endoftext|> x", "a"), (13, "é 中文", "a")]


def test_shards_round_trip(spark, tmp_path):
    rows = TEXTS + [(100 + i, f"text number {i} " * (i % 7), "s") for i in range(500)]
    manifest = sstable.write_shards(docs(spark, rows), VOCABULARY, str(tmp_path / "sst"), end_id=0).collect()
    m = spark.createDataFrame(manifest)
    ids = [x + [0] for x in library_ids([t or "" for _, t, _ in rows])]
    named = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, named[rows[i][1] or ""]))
    at, want = 0, Counter()
    for i in order:
        want[(rows[i][0], at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))] += 1
        at += len(ids[i])
    assert Counter(map(tuple, sstable.read_shards(m).collect())) == want
    found = defaultdict(list)
    for r in manifest:
        reader = sstable.Reader(r["path"])
        for key in {i for i, _, _ in rows} | {-1, 77777}:
            found[key] += [x.tolist() for x in reader.lookup(key)]
        assert sum(reader.may_contain(10**6 + k) for k in range(1000)) < 100
    for key in found:
        assert sorted(found[key]) == sorted(ids[i] for i in range(len(rows)) if rows[i][0] == key)
    keys = spark.createDataFrame([(k,) for k in [3, None, -7, 2**40, 150, 150, 77777, -(2**62)]], "doc_id long")
    by_key = defaultdict(list)
    for r in sstable.lookup_rows(m, keys).collect():
        by_key[r["doc_id"]].append(np.frombuffer(r["ids"], "<u4").tolist())
    assert {k: sorted(v) for k, v in by_key.items()} == {k: sorted(found[k]) for k in (3, None, -7, 2**40, 150)}
    assert sstable.lookup_rows(m, keys.where("doc_id = 0")).count() == 0


def test_one_id_over_several_shards(spark, tmp_path):
    rows = [(5, f"text {k}", "s") for k in range(400)] + [(4, "before", "s"), (6, "after", "s")]
    m = sstable.write_shards(docs(spark, rows), VOCABULARY, str(tmp_path / "sst"))
    assert m.count() > 2
    assert sstable.lookup_rows(m, spark.createDataFrame([(5,)], "doc_id long")).count() == 400
    got = sstable.read_shards(m).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [4] + [5] * 400 + [6]


def test_damaged_shard_is_refused(spark, tmp_path):
    r = sstable.write_shards(docs(spark, TEXTS), VOCABULARY, str(tmp_path / "sst")).orderBy("shard").first()
    data = bytearray(open(r["path"], "rb").read())
    data[3] ^= 1
    open(r["path"], "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(r["path"]))


def test_no_shards(spark, tmp_path):
    assert sstable.round_trip(docs(spark, TEXTS).where("doc_id = 1"), VOCABULARY).count() == 0


# Mixing.

def fill(sizes, weights, most=3):
    """Targets by resharing what capped sources leave, round by round."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left, share = total - sum(target.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / share > most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / share for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= set(over)
    return target


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), r.choice(["big"] * 12 + ["tiny", "mid", "mid", "Z", "é", None, ""])) for i in range(1500)]
    rows += [(None, "a b c", "mid"), (3000, None, "mid"), (3001, "x y", "empty"), (7, rows[7][1], rows[7][2]), (3002, None, "nothing")]
    got = mixing.mix(docs(spark, rows), rows_per_range=50).collect()
    assert len(got) == len(rows)
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target, taken = fill(dict(sizes), (1, 2, 3)), Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - target[x["source"]]) < 1e-6
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7), rows_per_range=50).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs(spark, rows).where("doc_id > 9000")).count() == 0


def test_mixed_rows(spark):
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3] if i % 10 else "d") for i in range(300)] + [(5, "w " * 6, "c"), (900, None, "a"), (None, "n n", "b")]
    d = docs(spark, rows)
    plan = mixing.mix(d).collect()
    out = mixing.mixed_rows(d)
    assert out.columns == d.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for x in plan:
        want[x["doc_id"]] += int(x["taken"] / x["size"] + 0.5) if x["size"] else 1
    assert copies == +want


def test_mixed_rows_keep_columns_of_any_name(spark):
    rows = [(i % 40, "w " * (1 + i % 3), "ab"[i % 2], f"id{i % 40}", i % 7, i % 5) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, `__id` string, share int, copies int")
    out = mixing.mixed_rows(d.withColumn("mix_key", F.lit(-1)))
    assert out.columns == [*d.columns, "mix_key"]
    got = out.drop("mix_key").collect()
    assert set(map(tuple, got)) <= {tuple(r) for r in rows} and all(r["__id"] == f"id{r['doc_id']}" for r in got)
    assert len(got) == sum(int(x["taken"] / x["size"] + 0.5) for x in mixing.mix(d).collect())
    same = spark.createDataFrame([(1, "a b", "x")] * 50 + [(2, "c d", "y")] * 3, "doc_id long, text string, source string")
    assert mixing.mixed_rows(same).count() == sum(int(x["taken"] / x["size"] + 0.5) for x in mixing.mix(same).collect())


# Packing.

def test_best_fit_never_overfills():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 1025, 3000)
    bins, offsets = packing.best_fit(lengths, 1024)
    for b in range(bins.max() + 1):
        i = np.flatnonzero(bins == b)
        i = i[np.argsort(offsets[i])]
        assert offsets[i].tolist() == np.concatenate(([0], np.cumsum(lengths[i])[:-1])).tolist() and lengths[i].sum() <= 1024
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 1024 + 1


@pytest.mark.parametrize("size", [1024, 16])
def test_pack(spark, size):
    r = random.Random(6)
    rows = TEXTS + [(1000 + i, " ".join(r.choice(["alpha", "beta", "x"]) for _ in range(r.randrange(0, 900))), "s") for i in range(300)]
    got = packing.pack(docs(spark, rows).repartition(13), VOCABULARY, size=size, end_id=2, keep_ids=True).collect()
    ids = [x + [2] for x in library_ids([t or "" for _, t, _ in rows])]
    pieces = Counter()
    for (i, _, _), x in zip(rows, ids):
        n = len(x)
        first = n % size or size if n > size else n
        cuts = [0, *range(first, n, size), n] if n > first else [0, n]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            pieces[(i, k, a, z - a, zlib.crc32(np.array(x[a:z], "<u4").tobytes()))] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == pieces
    by = defaultdict(list)
    for g in got:
        assert zlib.crc32(g["ids"]) == g["ids_crc32"]
        by[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    total = sum(g["length"] for g in got)
    assert len(by) <= 1.05 * total / size + 2


def test_pack_nothing(spark):
    assert packing.pack(docs(spark, TEXTS).where("doc_id = 1"), VOCABULARY).count() == 0


# Archives.

PAGES = [(4, "http://a/ b\r\nX: y", "same"), (2, "http://b", "same"), (9, None, ""), (8, "http://c", None), (None, "http://d", "same"), (None, "http://e", "alone"), (5, "http://f", "WARC/1.1\r\n\r\n" * 3), (6, "http://g", "é" * 70000), (2, "http://b", "same"), (-3, "http://h", "alone")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 7) for i, u, h in rows], "page_id long, url string, html string, first long")


def test_archives(spark):
    import base64

    got = Counter(map(tuple, warc.round_trip(pages(spark, PAGES)).collect()))
    want = Counter()
    for i, _, h in PAGES:
        p = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "").encode() == p and j is not None]
        first = min(same) if same and len([1 for _, _, g in PAGES if (g or "").encode() == p]) > 1 else None
        revisit = first is not None and first != i
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == want
    assert {r["record_type"] for r in warc.round_trip(pages(spark, PAGES), least_bytes=5).where("payload_bytes < 5").collect()} == {"response"}
    assert warc.round_trip(pages(spark, PAGES).where("page_id > 100")).count() == 0


def test_normaliser_reads_any_stream(tmp_path):
    whole = b"".join(warc.record(i, f"http://{i}", b"x" * (i * 1000), None, False) for i in range(50))
    for k, data in enumerate((gzip.compress(whole), gzip.compress(whole[:7777]) + gzip.compress(whole[7777:]))):
        (tmp_path / f"{k}.gz").write_bytes(data)
        n = warc.normalise(str(tmp_path / f"{k}.gz"), str(tmp_path / f"{k}.out"), str(tmp_path / f"{k}.idx"))
        out = (tmp_path / f"{k}.out").read_bytes()
        assert n == 50 and gzip.decompress(out) == whole
        import json

        for i, line in enumerate((tmp_path / f"{k}.idx").read_text().splitlines()):
            at = json.loads(line)
            assert warc.parsed(zlib.decompress(out[at["offset"] : at["offset"] + at["length"]], 31))["page_id"] == i
    with pytest.raises(ValueError, match="within a record"):
        (tmp_path / "cut.gz").write_bytes(gzip.compress(whole[:-10]))
        warc.normalise(str(tmp_path / "cut.gz"), str(tmp_path / "c.out"), str(tmp_path / "c.idx"))
    # Cut where a record ends, or anywhere else in the compressed stream.
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = [warc.record(i, f"http://{i}", bytes(range(256)) * 40, None, False) for i in range(4)]
    head = z.compress(one[0] + one[1]) + z.flush(zlib.Z_FULL_FLUSH)
    data = head + z.compress(one[2] + one[3]) + z.flush()
    for cut in (len(head), len(data) - 8, len(data) - 1, 5):
        (tmp_path / "cut.gz").write_bytes(gzip.compress(whole) + data[:cut])
        with pytest.raises(ValueError, match="cut"):
            warc.normalise(str(tmp_path / "cut.gz"), str(tmp_path / "c.out"), str(tmp_path / "c.idx"))
    (tmp_path / "big.gz").write_bytes(gzip.compress(bytes(10_000_000)))
    with open(tmp_path / "big.gz", "rb") as f:
        assert sum(len(x) for x in warc.inflated(iter(lambda: f.read(1 << 20), b""))) == 10_000_000


def test_hot_payloads(spark):
    rows = [(k, f"http://{k}", "same" if k % 3 else f"own {k // 6}") for k in range(60, 0, -1)] + [(None, "u", "same")]
    p = pages(spark, rows)
    got = [Counter(map(tuple, warc.with_references(p, hot_pages=n).select("page_id", "payload", "first").collect())) for n in (2, 10, 1000)]
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == 61


# The pipeline.

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "mixing", "packing"]
    r = random.Random(8)
    vocabulary = [f"v{chr(97 + k % 20)}{chr(97 + k // 20)}" for k in range(200)]
    rows, labels = [], []
    for i in range(400):
        t = [r.choice(vocabulary) for _ in range(60)]
        if i % 5 == 0:
            t.insert(30, r.choice(("foul", "awful")))
        labels.append((i, int(i % 5 == 0)))
        rows.append((i, " ".join(t), f"s{i % 4}"))
    rows += [(1000 + k, rows[1][1] + (" more" if k % 2 else ""), "s1") for k in range(6)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        kept.append([x.asDict() for x in d.collect()])
        d = spark.createDataFrame(d.collect(), d.schema)
    assert {x["doc_id"] for x in kept[0]} == {i for i, *_ in rows if i >= 1000 or i % 5}
    assert {x["doc_id"] for x in kept[1]} == {i for i, *_ in rows if i < 1000 and i % 5}
    assert {x["doc_id"] for x in kept[2]} <= {x["doc_id"] for x in kept[1]} and set(kept[2][0]) == set(kept[0][0])
    assert sum(x["length"] for x in kept[3]) == sum(len(x) + 1 for x in library_ids([x["text"] for x in kept[2]]))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[3])
