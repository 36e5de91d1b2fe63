"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import url_filters

    rules = spark.createDataFrame([(h, p, a) for a, h, p in URL_RULES], "host string, path string, action string")
    return url_filters(_table(spark, sf_dir, "pages"), rules)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_score

    return lm_score(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    text = F.encode("text", "utf-8")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    out = shard_rows(docs, 24, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_cut_words", "base_failed", "depleted", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated, decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"))
    kept = F.btrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    out = fill_in_middle(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a known share of damage, by a checksum of id and turn."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, role, text = F.crc32(name.cast("binary")) % 20, F.coalesce("role", space), F.coalesce("text", space)
    changed = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return changed.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(times).alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_repair import repair_conversations, repair_digests

    rows = _table(spark, sf_dir, "conversations")
    edits, facts = repair_conversations(damaged(rows))
    ids, digests = rows.select("conv_id").distinct(), repair_digests(edits)
    out = ids.join(facts.withColumnRenamed("conv_id", "f"), F.col("conv_id").eqNullSafe(F.col("f")), "left").join(digests.withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import bpe_decode, bpe_encode

    ranks, pattern = _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe_decode(bpe_encode(_table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_RULES_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)

_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON x = d.doc_id""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
ln AS (
  SELECT r, host, t, line, k, regexp_extract_all(line, '{_WORDS}') AS lw FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)),
named AS (
  SELECT *, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm,
         row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth FROM ln WHERE len(lw) > 0),
dup AS (SELECT r, count(*) FILTER (WHERE nth > 1) AS n_dup FROM named GROUP BY r),
sizes AS (SELECT host, count(*) AS docs FROM d WHERE len(w) > 0 GROUP BY 1),
wide AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT r) AS n FROM named GROUP BY 1, 2) JOIN sizes USING (host) WHERE n >= 5 AND n > 0.05::DOUBLE * docs),
spread AS (SELECT r, sum(len(lw)) AS n_wide FROM named JOIN wide USING (host, norm) GROUP BY r),
rich AS (SELECT r, host FROM d LEFT JOIN spread USING (r) WHERE len(w) > 0 AND 2 * coalesce(n_wide, 0) <= len(w)),
rich_sizes AS (SELECT host, count(*) AS docs FROM rich GROUP BY 1),
common AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT r) AS n FROM named JOIN wide USING (host, norm) WHERE r IN (SELECT r FROM rich) GROUP BY 1, 2) JOIN rich_sizes USING (host)
  WHERE n >= 5 AND n > 0.05::DOUBLE * docs),
cut AS (SELECT r, sum(len(lw)) AS n_cut FROM named JOIN common USING (host, norm) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut_words
  FROM d LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN cut USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_cut_words < 0.2 * n_words AS depleted,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - n_cut_words < 0.2 * n_words) AS kept
FROM m""",
    "op10_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT r, doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (g) WHERE m < doc_id),
every AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM every ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, [CAST('0x' || substr(h, i, 8) AS BIGINT) FOR i IN [1, 9, 17, 25]] AS g,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
  FROM d),
f AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS z, plain OR g[3] % 100 >= 100 AS p FROM e),
x AS (
  SELECT doc_id, n, t, CASE WHEN p THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:z], '') AS mid, array_to_string(w[z + 1:], '') AS suf
  FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM x""",
    "op12_turn_repair": r"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(name, '')]),
                            lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
  FROM k),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER o AS i, left(role, 1) AS ini, left(lag(role) OVER o, 1) AS prev,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT conv_id, turn, role, text, i, ini, prev, CASE WHEN ink = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s0, {'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s1, {'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s2, {'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s3
  FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, i, {'c': s0.c + 3, 'a': s0.a || 'D', 'r': s0.r},
         list_min([{'c': s1.c + 3, 'a': s1.a || 'D', 'r': s1.r}, {'c': CASE WHEN ini = 's' THEN s0.c + stay ELSE 1000000000 END, 'a': s0.a || 'K', 'r': list_append(s0.r, line)}]),
         list_min([{'c': s2.c + 3, 'a': s2.a || 'D', 'r': s2.r}] || [{'c': x.c + CASE WHEN ini = 'u' THEN stay ELSE 2 + stay END, 'a': x.a || CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END, 'r': list_append(x.r, CASE WHEN ini = 'u' THEN line ELSE 'user:' || text END)} FOR x IN [s0, s1, s3]]),
         list_min([{'c': s3.c + 3, 'a': s3.a || 'D', 'r': s3.r}, {'c': s2.c + CASE WHEN ini = 'a' THEN stay ELSE 2 + stay END, 'a': s2.a || CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END, 'r': list_append(s2.r, CASE WHEN ini = 'a' THEN line ELSE 'assistant:' || text END)}])
  FROM (
    SELECT conv_id, i, ini, text, line, stay, s0, s1, s2, list_min([s3, {'c': s2.c + 2, 'a': s2.a || 'I', 'r': list_append(s2.r, 'assistant:')}]) AS s3
    FROM (
      SELECT w.conv_id, r.i, ini, text, role || ':' || text AS line, CASE fault WHEN 1 THEN 1000000000 WHEN 2 THEN 1000000000 WHEN 3 THEN 1 ELSE 0 END AS stay, s0, s1, s3,
             list_min([s2] || [{'c': x.c + 2, 'a': x.a || 'I', 'r': list_append(x.r, 'user:')} FOR x IN [s0, s1, s3]]) AS s2
      FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
ended AS (
  SELECT conv_id, list_min([s0, {'c': s1.c + 4, 'a': s1.a || 'II', 'r': s1.r || ['user:', 'assistant:']}, {'c': s2.c + 2, 'a': s2.a || 'I', 'r': list_append(s2.r, 'assistant:')}, s3]) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM walk) WHERE last = 1),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op3_url_filters": rf"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES {_RULES_SQL}),
hit AS (
  SELECT r, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action DESC) AS k
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN hit ON hit.r = u.r AND k = 1""",
    "op9_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n)),
hit AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
