"""The registered query of each operator: the operator over its whole table, reduced to the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (
    arrow_output,
    byte_bpe,
    conversation_repair,
    histogram_shards,
    packing,
    pq_dedup,
    projected_search,
    quality,
    ranked_search,
    secret_scan,
    simhash,
    suffix_dedup,
    suffix_tree_lm,
)
from vitrine.llm.common import remainder, written

LIBRARY_FILE, RANK_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    columns = {
        "n_bytes": F.col("n_bytes"),
        "n_removed": width,
        "n_spans": F.size("spans").cast("long"),
        "kept_sha256": F.sha2("kept", 256),
    }
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"), columns)


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    scored = suffix_tree_lm.score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pq_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))
    kept = (F.col("vec_id") == F.col("component")).alias("kept")
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), kept)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(LIBRARY_FILE))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = arrow_output.write_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path(LIBRARY_FILE))
    back = arrow_output.read_documents(manifest)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return back.select("doc_id", "start", n_tokens, F.crc32("ids").alias("ids_crc32"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))}
    dealt = histogram_shards.shard_rows(_table(spark, sf_dir, "documents"), 40, kept)
    grown = F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("row.doc_id", "size", "row.text_crc32", "law", "shard", "slot", grown)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _ = written(quality.with_statistics(_table(spark, sf_dir, "documents")), "statistics")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = quality.fit(quality.training_rows(stats, _table(spark, sf_dir, "labels"), ~held_out), "label")
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return quality.scored(stats, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", shown, F.col("component").alias("component_id"))


def op9_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return projected_search.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    back = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, dropped_rows=F.col("gone"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    kinds = secret_scan.KINDS[: secret_scan.BASE_KINDS]

    def of(*wanted):
        return F.filter("spans", lambda s: s["kind"].isin(*wanted))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(of(*kinds)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_suffix_tree_lm": op2_suffix_tree_lm,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "op5_arrow_output": op5_arrow_output,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_projected_search": op9_projected_search,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_secret_scan": op13_secret_scan,
}

#: DuckDB SQL of those queries that SQL can express: op1 counts all windows of 200 bytes, op3 compares all pairs, op11 goes
#: from row to row with the best edits to each place of the pattern (inserted rows come before a row, so neither of two
#: paths is the beginning of the other), op12 scores every document for every item.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS s, h FROM d), x AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS x FROM w),
r AS (SELECT doc_id, s, s > lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) + 200 AS new FROM x WHERE x IN (SELECT x FROM x GROUP BY x HAVING count(*) > 1)),
g AS (SELECT doc_id, s, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM r),
p AS (SELECT doc_id, g, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, 0 AS a, (SELECT min(p.a) FROM p WHERE p.doc_id = d.doc_id) AS b, 0 AS g FROM d UNION ALL SELECT doc_id, b, lead(a) OVER (PARTITION BY doc_id ORDER BY g), g FROM p),
t AS (SELECT k.doc_id, string_agg(CASE WHEN k.b IS NULL THEN substr(h, 2 * k.a + 1) ELSE substr(h, 2 * k.a + 1, 2 * (k.b - k.a)) END, '' ORDER BY k.g) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce((SELECT sum(b - a) FROM p WHERE p.doc_id = d.doc_id), 0) AS BIGINT) AS n_removed,
  (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op3_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = v.vec_id AS kept FROM v JOIN r ON r.a = v.vec_id GROUP BY 1""",
    "op11_conversation_repair": """WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
h AS (SELECT k.* EXCLUDE (s), xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS d FROM k, t),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT * FROM h WHERE d > 0 UNION ALL SELECT * FROM h WHERE d = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM g),
f AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b, CASE WHEN x = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN right(x, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS e FROM o),
n AS (SELECT * FROM (VALUES (0, 'u', 2), (0, 's', 1), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) n(q, r, p)),
y AS (SELECT q AS q0, q, '' AS a, 0 AS c, CAST([] AS VARCHAR[]) AS w FROM range(4) z(q) UNION ALL SELECT q0, n.p, a || 'I', c + 5, list_append(w, CASE n.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END) FROM y JOIN n USING (q) WHERE n.r <> 's' AND c < 15),
m AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS c, '' AS a, CAST([] AS VARCHAR[]) AS w FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, q, min(c), min_by(a, (c, a)), min_by(w, (c, a)) FROM (
    SELECT m.conv_id, f.i, z.q, m.c + y.c + z.c AS c, m.a || y.a || z.l AS a, list_concat(list_concat(m.w, y.w), z.w) AS w
    FROM m JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i + 1 JOIN y ON y.q0 = m.q,
    LATERAL (SELECT y.q, 2 AS c, 'D' AS l, CAST([] AS VARCHAR[]) AS w UNION ALL SELECT n.p, CASE e WHEN 't' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM n WHERE n.q = y.q AND n.r = f.r AND e NOT IN ('b', 'd')
      UNION ALL SELECT n.p, CASE e WHEN 't' THEN 6 ELSE 1 END, 'R', [CASE n.r WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] FROM n WHERE n.q = y.q AND n.r <> 's' AND e NOT IN ('b', 'd')) z) GROUP BY conv_id, i, q),
l AS (SELECT conv_id, max(i) AS i FROM m GROUP BY 1),
v AS (SELECT m.conv_id, m.c + y.c AS c, m.a || y.a AS a, list_concat(m.w, y.w) AS w FROM m JOIN l ON l.conv_id IS NOT DISTINCT FROM m.conv_id AND l.i = m.i JOIN y ON y.q0 = m.q WHERE y.q IN (0, 3)),
b AS (SELECT conv_id, min(c) AS cost, min_by(a, (c, a)) AS audit, min_by(w, (c, a)) AS w FROM v GROUP BY 1),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (e = 'b') AS blank, count(*) FILTER (e = 'd') AS duplicate, count(*) FILTER (e = 't') AS truncated, count(*) FILTER (i > 1 AND b || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(array_to_string(w, chr(10)), '')) AS repaired_sha256
FROM b LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op12_ranked_search": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0), p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p GROUP BY r, term), h AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
i AS (SELECT item_id, text, term, count(*) AS k FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2, 3),
x AS (SELECT item_id, i.text, r, doc_id, CAST(sum(k * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total))))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN h USING (term), s GROUP BY item_id, i.text, r, doc_id),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
}
