"""The operators' queries over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         F.col("sequence_offset").alias("offset"))


@query("op6_bpe_encoding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.bpe_encoding import encode

    done = encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


@query("op9_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op10_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def held_out(modulus: int, rest: int):
    """Whether a document is held out from learning."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.quality import score_quality

    out = held_out(5, 0)
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_on=~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.toxicity import score_toxicity

    out = held_out(4, 2)
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_on=~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.language_id import identify

    out = held_out(4, 2)
    found = identify(table(spark, sf_dir, "documents"), learn_on=~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op5_near_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [[w[1]]]
  ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id, component_id = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.suffix_dedup import repeated_substrings

    cut = repeated_substrings(table(spark, sf_dir, "documents"), width=100)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_decontamination", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: w[k : k + n - 1])) AS x
  FROM (SELECT *, least(10, len(w)) AS n FROM i) WHERE n > 0 AND item_id IS NOT NULL),
dw AS (SELECT r, n, k, list_slice(w, k, k + n - 1) AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, item_id, k, n FROM dw JOIN iw USING (n, x)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.decontamination import build_index, contamination, covered

    found = contamination(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), width=10)
    hit = covered("spans")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


@query("op12_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
n AS (SELECT r, count(*) AS n FROM d GROUP BY r), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN w USING (t) JOIN n USING (r), s GROUP BY item_id, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.lexical_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.id AS a, c.id AS c, a.y = c.y AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS s
  FROM v a JOIN v c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % 100 = 0),
f AS (SELECT a, c, s FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT f.a AS anchor_id, f.c AS positive_id, CAST(row_number() OVER (PARTITION BY f.a, f.c ORDER BY p.s DESC, p.c) AS INTEGER) AS rank, p.c AS negative_id,
  f.s AS positive_score, p.s AS negative_score
FROM f JOIN p ON p.a = f.a AND NOT p.same AND 80 * f.s <= 100 * p.s AND 100 * p.s <= 100 * f.s
QUALIFY row_number() OVER (PARTITION BY f.a, f.c ORDER BY p.s DESC, p.c) <= 5
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, label_col=label)
