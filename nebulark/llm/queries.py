"""The registered queries of the text operators, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.llm.common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.substrings import dedup

    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.sharding import shard

    placed = shard(documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from nebulark.llm.tokens import count_tokens, vocabulary

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, vocabulary(path("piece_bpe_32k.model"))).drop("text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.secrets import scan

    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("found")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.language import identify

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labelled = docs.where(~held_out)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), labelled).select("doc_id", "held_out", "lang_pred", "score", "phrase_chars")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.mixing import mix

    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.vectors import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.pages import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.neardup import classes

    return classes(documents(spark, sf_dir).select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.decontaminate import contamination

    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    length = "aggregate(spans, 0, (acc, x) -> x - acc)"  # ends less starts: they alternate
    return found.select(
        "doc_id",
        "n_words",
        F.expr(length).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: The rules of the query, by precedence of length.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.urls import judge, rules

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nebulark.llm.conversations import branched, ordered, trie

    turns, convs = ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    conv_id = F.col("conv_id")
    taken = F.crc32(conv_id.cast("string").cast("binary")) % 9
    return trie(*branched(turns, convs, base=conv_id - conv_id % 5, taken=taken, most=8))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from nebulark.llm.crosstokens import align, byte_level, pieces

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = align(docs, byte_level(path("byte_bpe_50k.json")), pieces(path("piece_bpe_32k.model")))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_sharding, op3_token_counts, op4_secret_scan, op5_language_id, op6_mixing, op7_exact_top_k, op8_page_text, op9_near_duplicates, op10_decontamination, op11_url_filter, op12_conversation_trie, op13_cross_tokenizer)}

ORACLE = {
    "op1_substring_dedup": r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    g AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
    m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
    c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM g JOIN m USING (k) WHERE least < doc_id),
    x AS (SELECT r, w[i] AS word, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN c USING (r, i)),
    t AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN t USING (r)
    """,
    "op4_secret_scan": r"""
    WITH k(kind, name, pattern, grp, least, base) AS (VALUES
      (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12, true),
      (1, 'access', 'AKIA[A-Z0-9]+', 0, 18, true),
      (2, 'hex', '[0-9a-f]{16,}', 0, 16, true),
      (3, 'hub', 'gh[opsu]_[A-Za-z0-9]{36,}', 0, 0, false),
      (4, 'chat', 'xox[abps]-[A-Za-z0-9-]{10,}', 0, 0, false),
      (5, 'pem', '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----', 0, 0, false)),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    m AS (SELECT r, kind, name, least, base, regexp_extract_all(text, pattern, 0) AS hit,
                 CASE WHEN grp = 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern, 0) END AS val,
                 string_split_regex(text, pattern) AS gap
          FROM d, k WHERE regexp_matches(text, pattern)),
    u AS (SELECT r, kind, name, least, base, i, length(hit[i]) AS n, length(val[i]) AS v,
                 sum(length(gap[i])) OVER w + coalesce(sum(length(hit[i])) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
          FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m) WINDOW w AS (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT r, kind, base, s, name || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS x FROM u WHERE v >= least),
    a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                 string_agg(x, ',' ORDER BY s, kind) FILTER (base) AS b, string_agg(x, ',' ORDER BY s, kind) AS spans FROM f GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (r)
    """,
    "op7_exact_top_k": """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(1024 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
    "op6_mixing": r"""
    WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                      md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
    w AS (SELECT *, CAST([3, 1, 2][k % 3 + 1] AS DOUBLE) AS weight, CAST([-0.5, 0, 0.5][k % 3 + 1] AS DOUBLE) AS a FROM s),
    l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(words) OVER () - coalesce(sum(2 * words) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reached
          FROM w WINDOW f AS (ORDER BY words / weight, source NULLS LAST)),
    t AS (SELECT source, words, a, least(CAST(2 * words AS DOUBLE), weight * max(reached) OVER ()) AS target FROM l),
    p AS (SELECT d.*, words, target, a, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start,
                 CAST(floor(target + 0.5) AS BIGINT) AS want
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    q AS (SELECT *, greatest(0, least(size, want - start)) AS one, greatest(0, least(size, want - start - words)) AS two,
                 CASE WHEN want - start > 0 OR want - start - words > 0 THEN (CASE WHEN want - start > 0 THEN start ELSE start + words END) / target END AS u FROM p)
    SELECT doc_id, size, words AS source_size, target, CAST(one + two AS BIGINT) AS taken,
           CASE WHEN one > 0 THEN round(CASE WHEN a = 0 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END, 9) + 0.0 END AS position
    FROM q
    """,
    "op8_page_text": r"""
    WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<br>', ' ', 'g') AS x FROM pages),
    b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:h1|p)>'),
                 lambda y: trim(regexp_replace(regexp_replace(regexp_replace(y, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS x FROM a),
    t AS (SELECT page_id, url, array_to_string(list_filter(x, lambda y: y <> ''), chr(10)) AS text FROM b)
    SELECT page_id, url, text, length(text) AS n_chars FROM t
    """,
    "op10_decontamination": r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                      coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
               FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
          FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    g AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
    m AS (SELECT r, i, g.n, item_id FROM g JOIN p ON g.n = p.n AND g.k = p.k),
    h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
    """,
    "op11_url_filter": r"""
    WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages),
    k(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    m AS (SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS n
          FROM u JOIN k ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (r)
    """,
    "op12_conversation_trie": """
    WITH t AS (SELECT conv_id AS c, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS y,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), x) - 1 AS i
               FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT c, c - c % 5 AS b, (list_reduce(flatten(list_prepend([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: [CAST(ascii(z) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                     lambda a, z: CASE WHEN z >= 0 THEN xor(a, z) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END)) AS crc
          FROM (SELECT DISTINCT c FROM t)),
    h AS (SELECT c, b, xor(crc, 4294967295) % 9 AS h FROM n),
    own AS (SELECT h.c, x, y, h.h AS h, i FROM h JOIN t ON t.c = h.b WHERE i < h.h),
    q AS (SELECT c, x, y, i FROM own UNION ALL SELECT h.c, x, y, i FROM h JOIN t ON t.c = h.c WHERE i >= h.h),
    l AS (SELECT h.c, coalesce(xs, []) AS xs, coalesce(ys, []) AS ys FROM h LEFT JOIN (SELECT c, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys FROM q GROUP BY c) USING (c)),
    m AS (SELECT c, d, len(xs) AS n, md5(d || ':' || array_to_string(xs[1 : d], '')) AS k, md5((d - 1) || ':' || array_to_string(xs[1 : d - 1], '')) AS up, CASE WHEN d = 0 THEN 0 ELSE ys[d] END AS y
          FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM l)),
    v AS (SELECT k, d, any_value(up) AS up, any_value(y) AS y, min(c) AS c, count(*) AS n_convs, string_agg(c, ',' ORDER BY c) FILTER (n = d) AS ends FROM m GROUP BY k, d),
    g AS (SELECT up, count(*) AS n FROM v WHERE d > 0 GROUP BY up),
    s AS (SELECT m.k, count(*) FILTER (g.n IS NULL) AS n_leaves, sum((n_convs - 1) * v.y) AS saved FROM v LEFT JOIN g ON g.up = v.k JOIN m ON m.c = v.c AND m.d <= v.d GROUP BY m.k)
    SELECT v.c AS conv_id, v.d AS depth, CASE WHEN v.d > 0 THEN p.c END AS parent_conv_id, v.n_convs, CAST(coalesce(g.n, 0) AS BIGINT) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
    FROM v JOIN s USING (k) LEFT JOIN g ON g.up = v.k LEFT JOIN v p ON p.k = v.up
    """,
}
