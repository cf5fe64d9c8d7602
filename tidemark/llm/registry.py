"""The registered queries of this subpackage: thin contract views of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, knn_quality, language_id, license_scan, line_dedup, mixing, prefix_trie, quality_rules, simhash_dedup, substring_dedup, token_alignment, token_store, topk_search
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The ids that end a document, and the tokenizers of the encoders.
END_ID, WORD_BPE, BYTE_BPE, PIECE_BPE = 2, "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.score(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return found.select("doc_id", "quality_rules.*")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)


#: The table has no paths: documents are laid out by source in directories of 400 and of 20, whose first ones are their licence files.
OP3_PATH = """concat('/', source, '/', CAST(doc_id DIV 400 AS STRING), '/',
  CASE WHEN doc_id % 400 = 0 THEN 'LICENSE' ELSE concat(CAST(doc_id DIV 20 AS STRING), '/', CASE WHEN doc_id % 20 = 0 THEN 'LICENSE' ELSE concat(CAST(doc_id AS STRING), '.txt') END) END)"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(OP3_PATH).alias("path"), "text")
    return license_scan.scan(files).select("doc_id", "path", "own_license", "own_score", "license", "origin")


def op3_sql() -> str:
    wanted = license_scan.template_terms()
    templates = ", ".join(f"({tid}, '{name}', '{anchor}', {own.index(anchor)}, {len(own)})" for tid, (name, anchor, own) in enumerate(wanted))
    counts = ", ".join(f"({tid}, '{t}', {own.count(t)})" for tid, (_, _, own) in enumerate(wanted) for t in sorted(set(own)))
    path = OP3_PATH.replace("STRING", "VARCHAR").replace("doc_id DIV 400", "doc_id // 400").replace("doc_id DIV 20", "doc_id // 20").replace("concat('/', source", "concat_ws('', '/', source")
    term, pattern, e = license_scan.TERM, license_scan.anchor_pattern(), license_scan.SMOOTHING
    return f"""
WITH templates(tid, license, anchor, before, size) AS (VALUES {templates}),
own(tid, t, k) AS (VALUES {counts}),
total AS (SELECT greatest(count(*), 1) AS n FROM documents),
files AS (SELECT row_number() OVER () AS f, doc_id, {path} AS path, md5(text) AS key, text FROM documents),
held AS (SELECT DISTINCT key, lower(text) AS low FROM files WHERE regexp_matches(lower(text), '{pattern}')),
worded AS (SELECT key, regexp_extract_all(low, '{term}') AS all_terms, list_transform(list_filter(string_split(low, chr(10)), lambda x: regexp_matches(x, '{pattern}')), lambda x: regexp_extract_all(x, '{term}')) AS lines FROM held),
placed AS (SELECT key, tid, all_terms, before, size, unnest(list_filter(range(len(all_terms)), lambda i: all_terms[i + 1] = anchor)) AS p FROM worded, templates),
cut AS (
  SELECT key, tid, all_terms[greatest(p - before, 0) + 1 : greatest(p - before, 0) + size - greatest(before - p, 0)] AS terms FROM placed
  UNION SELECT key, tid, unnest(list_filter(lines, lambda x: list_contains(x, anchor))) FROM worded, templates WHERE size <= {license_scan.NOTICE}),
passages AS (SELECT row_number() OVER () AS pid, * FROM cut),
counted AS (SELECT key, tid, pid, t, count(*) AS n FROM (SELECT key, tid, pid, unnest(terms) AS t FROM passages) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{term}'))) AS t FROM documents) WHERE t IN (SELECT t FROM counted UNION ALL SELECT t FROM own) GROUP BY t),
weight AS (SELECT v.t, 1 + ln((1 + {e}) / (coalesce(df, 0) / CAST(total.n AS DOUBLE) + {e})) AS w FROM (SELECT t FROM counted UNION SELECT t FROM own) v CROSS JOIN total LEFT JOIN df ON v.t = df.t),
norms AS (SELECT tid, sqrt(sum((k * w) ** 2)) AS norm FROM own JOIN weight USING (t) GROUP BY tid),
given_terms AS (SELECT tid, t, k * w / norm AS v FROM own JOIN weight USING (t) JOIN norms USING (tid)),
scored AS (
  SELECT c.key, c.tid, pid, round(sum(n * w * coalesce(v, 0)) / sqrt(sum((n * w) ** 2)), 6) AS score
  FROM counted c JOIN weight USING (t) LEFT JOIN given_terms g ON c.tid = g.tid AND c.t = g.t GROUP BY ALL),
best AS (SELECT key, license, score FROM (SELECT key, license, score, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN license = '{license_scan.RESERVED}' THEN 2 WHEN size > {license_scan.NOTICE} AND score >= {license_scan.WHOLE} THEN 0 ELSE 1 END, score DESC, license) AS r FROM scored JOIN templates USING (tid) WHERE score >= {license_scan.THRESHOLD}) WHERE r = 1),
matched AS (SELECT f.f, f.doc_id, f.path, regexp_replace(f.path, '[^/]*$', '') AS dir, best.license AS own_license, best.score AS own_score FROM files f LEFT JOIN best ON f.key = best.key),
given AS (SELECT dir, license FROM (SELECT dir, own_license AS license, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) AS r FROM matched WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE') WHERE r = 1),
nearest AS (
  SELECT m.dir, arg_max(g.license, len(g.dir)) AS license FROM (SELECT DISTINCT dir FROM matched) m JOIN given g ON starts_with(m.dir, g.dir) GROUP BY m.dir)
SELECT m.doc_id, m.path, m.own_license, m.own_score, coalesce(m.own_license, n.license) AS license,
       CASE WHEN m.own_license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM matched m LEFT JOIN nearest n ON m.dir = n.dir
"""


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by five; a null id is no row to learn from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out())
    return language_id.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


OP5_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM ints),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


#: Rounds of the water level are a recursion, one more than there are sources at most; the order within a source is that of the MD5 of seed, id and text.
OP6_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM sized GROUP BY source),
level(n, v) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT n + 1, (SELECT (1.5 * (SELECT sum(source_size) FROM src) - coalesce(sum(CASE WHEN weight * v > 2.0 * source_size THEN 2.0 * source_size END), 0))
                        / sum(CASE WHEN NOT weight * v > 2.0 * source_size THEN weight END) FROM src)
  FROM level WHERE n <= (SELECT count(*) FROM src)),
filled AS (
  SELECT source, source_size, least(2.0 * source_size, weight * (SELECT arg_max(v, n) FROM level)) AS target FROM src),
part AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM filled),
dealt AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS fraction,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN part p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN before < fraction AND 2 * (fraction - before) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM dealt
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), from_files=True)


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    space = knn_quality.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return knn_quality.classify(docs, space, 0.3).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
split_up AS (SELECT d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (
  SELECT d, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split_up),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT d) >= 10),
judged AS (SELECT d, pos, line, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged JOIN docs USING (d) GROUP BY d
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))


def op13_source(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def op13_head(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % 9


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), op13_source, op13_head, 8)


#: CRC-32 of an id's decimals, which DuckDB lacks: eight shifts a byte.
_CRC32 = """xor(list_reduce(list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: CAST(unicode(CAST(c AS VARCHAR)[i]) AS BIGINT)),
  lambda a, b: list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""
OP13_SQL = f"""
WITH numbered AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': r, 't': t}} ORDER BY i) AS turns FROM numbered GROUP BY c),
headed AS (SELECT c, turns, {_CRC32} % 9 AS h FROM own),
built AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM headed a LEFT JOIN own b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM built),
node AS (
  SELECT turns[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = len(turns)), '') AS ends
  FROM prefixes GROUP BY 1, 2),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
weighed AS (
  SELECT node.*, coalesce(n, 0) AS n_children, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(node.k[d].t) ELSE 0 END AS saved
  FROM node LEFT JOIN children ON node.k = children.k),
above AS (SELECT k, leaf, saved, unnest(range(0, d + 1)) AS a FROM weighed),
totals AS (SELECT k[1:a] AS k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM weighed w JOIN totals ON w.k = totals.k LEFT JOIN node p ON w.d > 0 AND p.k = w.k[1:w.d - 1]
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {"pipeline": pipeline, "op1_quality_rules": op1_quality_rules, "op2_token_store": op2_token_store, "op3_license_scan": op3_license_scan, "op4_language_id": op4_language_id, "op5_topk": op5_topk, "op6_mixing": op6_mixing, "op7_simhash": op7_simhash, "op8_bpe": op8_bpe, "op9_knn_quality": op9_knn_quality, "op10_substring_dedup": op10_substring_dedup, "op11_line_dedup": op11_line_dedup, "op12_token_alignment": op12_token_alignment, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": op3_sql(), "op5_topk": OP5_SQL, "op6_mixing": OP6_SQL, "op11_line_dedup": OP11_SQL, "op13_prefix_trie": OP13_SQL}
