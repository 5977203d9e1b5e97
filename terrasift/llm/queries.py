"""The queries of this subpackage, bound to the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, licenses, neardup, secrets, sharding, substrings, toxicity, vectors
from .common import keep, settled, table, workspace


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = lambda: F.filter("spans", lambda s: s["rank"] < len(secrets.PATTERNS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{p[0]}") for i, p in enumerate(secrets.PATTERNS)),
        F.sha2(secrets.listed(base()).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


OP2_SQL = f"""
WITH RECURSIVE numbers AS (SELECT unnest(range({sharding.TABLE_SIZE}))::BIGINT AS n),
shards AS (
  SELECT s, printf('shard-%02d', s::INT) AS name FROM (SELECT unnest(range({len(sharding.SHARDS)}))::BIGINT AS s)),
prefs AS (
  SELECT s, ('0x' || substr(md5(name || ':offset'), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS off,
         ('0x' || substr(md5(name || ':skip'), 1, 15))::BIGINT % {sharding.TABLE_SIZE - 1} + 1 AS skip FROM shards),
fill(turn, owner, taken) AS (
  SELECT 0::BIGINT, NULL::BIGINT, [0::BIGINT for x in range({sharding.TABLE_SIZE})]
  UNION ALL
  SELECT turn + 1, pick, list_concat(list_concat(taken[1:pick], [1::BIGINT]), taken[pick + 2:])
  FROM (SELECT f.turn, f.taken, list_filter(list_transform(range({sharding.TABLE_SIZE}), lambda n: (p.off + n * p.skip) % {sharding.TABLE_SIZE}),
               lambda x: f.taken[x + 1] = 0)[1] AS pick
        FROM fill f JOIN prefs p ON p.s = f.turn % {len(sharding.SHARDS)} WHERE f.turn < {sharding.TABLE_SIZE})),
placed AS (SELECT owner AS slot, (turn - 1) % {len(sharding.SHARDS)} AS s FROM fill WHERE turn > 0)
SELECT d.doc_id, d.slot::INT AS slot, shards.name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents) d
JOIN placed USING (slot) JOIN shards USING (s)
"""


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    sizes = ", ".join(f"({a + 1}, {m}, {licenses.window_size(m)}, {licenses.stride(m)})" for a, m in zip((0, *licenses.LENGTHS), licenses.LENGTHS, strict=False))
    words = "list_filter(string_split(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda w: w <> '')"
    five = "list_transform(range(1, greatest(1, len(words) - 3)), lambda i: struct_pack(pos := i - 1, s := array_to_string(words[i:i + 4], ' ')))"
    return f"""
WITH templates(template, license, text) AS (VALUES {rows}),
sizes(least, most, size, stride) AS (VALUES {sizes}),
split AS (SELECT template, license, {words} AS words FROM templates),
wanted AS (SELECT DISTINCT template, license, most, size, stride, unnest({five}).s AS s FROM split JOIN sizes ON len(words) BETWEEN least AND most),
totals AS (SELECT template, count(*) AS n FROM wanted GROUP BY template),
docs AS (SELECT doc_id, {words} AS words FROM documents WHERE doc_id IS NOT NULL),
held AS (SELECT doc_id, f.pos AS pos, f.s AS s FROM (SELECT doc_id, unnest({five}) AS f FROM docs)),
hits AS (SELECT h.doc_id, h.pos, w.* FROM held h JOIN wanted w USING (s)),
placed AS (SELECT *, unnest(range(greatest(0, (pos + {licenses.SHINGLE} - size + stride - 1) // stride), pos // stride + 1)) AS k FROM hits),
counted AS (SELECT doc_id, license, template, k, count(DISTINCT s) AS n FROM placed GROUP BY ALL),
matched AS (SELECT c.*, t.n AS total FROM counted c JOIN totals t USING (template) WHERE c.n >= {licenses.CONTAINMENT} * t.n)
SELECT doc_id, license, n AS n_matched, total AS n_shingles FROM matched
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY n / total DESC, template, n DESC) = 1
"""


OP3_SQL = _op3_sql()


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
steps AS (
  SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS size,
         string_agg(md5(role) || md5(text), '') OVER w AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
firsts AS (SELECT min(conv_id) AS conv_id, prefix FROM steps WHERE n = size GROUP BY prefix),
kept AS (SELECT conv_id FROM firsts WHERE prefix NOT IN (SELECT prefix FROM steps WHERE n < size))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
FROM turns SEMI JOIN kept USING (conv_id) GROUP BY conv_id
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_covered", F.col("n_words").alias("n_item_words"), F.round("coverage", 6).alias("coverage"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


_SPLIT = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, {_SPLIT.format(_LOWERED)} AS words FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS held
  FROM split),
sizes AS (SELECT doc_id, len(held) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(held) AS s FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= 85 * (x.n + y.n - met.n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
tops AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN tops USING (doc_id)
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    with workspace(spark):
        found = substrings.Repeats(table(spark, sf_dir, "documents"))
        texts = found.removed.select("id", F.col("whole").alias("of"), "n_removed", sha(F.col("kept")).alias("sha")).distinct()
        gone = found.copies.select("id", F.col("whole").alias("of"), F.lit(None).cast("long").alias("n_removed"), sha(F.lit("")).alias("sha"))
        # of: the text of an id that is meant, null where it has one only.
        touched = keep(texts.union(gone.distinct())).alias("t")
        rows = found.whole.alias("w").join(touched, (F.col("w.id") == F.col("t.id")) & (F.col("t.of").isNull() | (F.col("t.of") == F.col("w.whole"))), "left")
        removed = F.when(F.col("sha").isNull(), 0).otherwise(F.coalesce("n_removed", "n_words"))
        return settled(rows.select(F.col("w.id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256")))


OP8_SQL = f"""
WITH split AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS words FROM documents WHERE doc_id IS NOT NULL),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(words) - {substrings.WINDOW} + 2)),
         lambda i: struct_pack(p := i, s := sha256(array_to_string(words[i:i + {substrings.WINDOW - 1}], ' '))))) AS w FROM split),
numbered AS (SELECT doc_id, w.p AS p, row_number() OVER (PARTITION BY w.s ORDER BY doc_id, w.p) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {substrings.WINDOW})) AS p FROM numbered WHERE n > 1),
each AS (SELECT doc_id, unnest(list_transform(range(1, len(words) + 1), lambda i: struct_pack(p := i, word := words[i]))) AS w FROM split),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS text
         FROM each ANTI JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.w.p GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
good AS (SELECT DISTINCT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
          AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE false END),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
tops AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN tops USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_sharding": op2_sharding,
    "op3_license_scans": op3_license_scans,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}
ORACLES = {
    "op2_sharding": OP2_SQL,
    "op3_license_scans": OP3_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
}
