"""The subpackage's queries: thin digests over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, chat, decontaminate, graphann, gru, jaccard, mixing, packing, phrases, sstable, topk, toxicity, warc
from ._spark import table


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=5, threshold=(75, 100))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = chat.format_chats(chat.linear_threads(rows.unionByName(extra)))
    back = chat.read_chats(chats)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), _vocabulary(), end_id=0).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary(), size=1024, end_id=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op9_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = gru.scored(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    c = F.col(found.columns[-1])
    names = F.array_join(F.array_sort(F.transform(c["items"], lambda x: x.cast("string"))), ",")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


def op12_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"), most=5, least=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_jaccard": op2_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_chat": op4_chat,
    "op5_sstable": op5_sstable,
    "op6_mix": op6_mix,
    "op7_pack": op7_pack,
    "op8_warc": op8_warc,
    "op9_graph_ann": op9_graph_ann,
    "op10_gru_lm": op10_gru_lm,
    "op11_decontaminate": op11_decontaminate,
    "op12_balltree": op12_balltree,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {}

ORACLES["op1_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS own
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR abs(x::DOUBLE) > 7e305)) = 0
), s AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.own <> b.own AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op4_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') AS body FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(body) + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op6_mix"] = r"""
WITH d AS (
  SELECT doc_id, source,
    length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS mix_key
  FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::DOUBLE AS cap,
    (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER w - (sum(cap) OVER w - cap - coalesce(sum(cap) OVER after_, 0)))
      / (sum(weight) OVER w - (sum(weight) OVER w - weight - coalesce(sum(weight) OVER after_, 0))) AS level
  FROM p WINDOW w AS (), after_ AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, source_size,
    CASE WHEN cap <= weight * level THEN cap
         ELSE weight * (SELECT level FROM l x WHERE x.cap > x.weight * x.level ORDER BY x.cap / x.weight, x.source NULLS LAST LIMIT 1) END AS target
  FROM l
), e AS (
  SELECT doc_id, d.source, size, source_size, target, mix_key,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM e
"""

ORACLES["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex, strlen(payload)) AS first FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(strpos('0123456789abcdef', substr(hex, i, 1)) - 1 + 16), 4)), '') AS bits FROM f
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substr(bits, 5 * i + j, 1) = '1' THEN 1 << (5 - j)::INTEGER ELSE 0 END))::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""

ORACLES["op2_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams
  FROM w
), g AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.first, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS first FROM r GROUP BY x) m ON s.doc_id = m.x
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op11_decontaminate"] = f"""
WITH i AS (
  SELECT item_id, ws, least(10, len(ws)) AS w FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
), iw AS (
  SELECT DISTINCT item_id, w, array_to_string(ws[p:p + w - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS p FROM i)
), d AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents
), dw AS (
  SELECT row, w, p, array_to_string(ws[p:p + w - 1], ' ') AS gram
  FROM (SELECT row, ws, w, unnest(range(1, len(ws) - w + 2)) AS p FROM d, (SELECT DISTINCT w FROM i))
), m AS (
  SELECT DISTINCT row, w, p, item_id FROM dw JOIN iw USING (w, gram)
), h AS (
  SELECT row, count(DISTINCT p + x) AS n_hit FROM (SELECT DISTINCT row, p, unnest(range(0, w)) AS x FROM m) GROUP BY row
), n AS (
  SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT row, item_id::VARCHAR AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN n USING (row)
"""


def _rounds(n: int) -> str:
    """The clustering's rounds, one after the other: every vector to its nearest centroid, then the floor of the means."""
    out = ""
    for r in range(n + 1):
        out += f""", a{r} AS (
  SELECT row, min(struct_pack(distance := list_sum(list_transform(range(1, 65), lambda j: (q[j] - m[j]) * (q[j] - m[j]))), c := c)) AS best FROM v, c{r} GROUP BY row
)"""
        if r < n:
            out += f""", s{r} AS (
  SELECT best.c AS c, j, sum(q[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT row, q, unnest(range(1, 65)) AS j FROM v) JOIN a{r} USING (row) GROUP BY ALL
), m{r} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM s{r} GROUP BY c
), c{r + 1} AS (
  SELECT c{r}.c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c
)"""
    return out


ORACLES["op12_balltree"] = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, q) - 1)::INTEGER AS c, q AS m FROM v QUALIFY c < 16
){_rounds(3)}
SELECT vec_id, best.c AS cluster, best.distance::BIGINT AS distance, (sum(best.distance) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM v JOIN a3 USING (row) JOIN c3 ON c3.c = best.c
"""

ORACLES["op13_phrases"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, * FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS ks(k)) GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 100
), cut AS (
  SELECT c.lang, c.k, c.phrase, a, x AS after_, array_to_string(ws[1:x], ' ') AS first_, array_to_string(ws[x + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS x FROM c) c
), s AS (
  SELECT cut.lang, cut.phrase, a, after_, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN g l ON l.lang = cut.lang AND l.phrase = first_ JOIN g r ON r.lang = cut.lang AND r.phrase = rest JOIN n ON n.lang = cut.lang
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, after_) = 1
), kept AS (
  SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = low.lang AND c.a >= low.a AND c.phrase <> low.phrase AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
