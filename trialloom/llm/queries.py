"""The corpus operators over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import (
    bpe, chat_format, clusters, fill_middle, mixing, nearest, ngram_join, pii, quality_model, quality_rules, token_store, toxicity,
    url_rules,
)
from trialloom.llm.common import ship
from trialloom.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", F.col("served").cast("long").alias("served"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.new_folder(spark)
    token_store.write_store(_table(spark, sf_dir, "documents"), folder)
    read = token_store.read_store(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: A conversation whose texts are control strings of the template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    more = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = stage(chat_format.format_conversations(given.unionByName(more)), "chat-formatted")
    return chat_format.digests(formatted)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.assess(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    n = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return done.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.drop("class_distance", "word_distance")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.restore(fill_middle.transform(_table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(*clusters.cluster(_table(spark, sf_dir, "embeddings")))


#: Host, path and verdict of the query's rules.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


OP3_SQL = r"""
WITH keyed AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS base,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, base) - 1 AS number FROM keyed),
sized AS (
  SELECT doc_id, source, size, CASE WHEN number = 0 THEN base ELSE md5(base || ':' || number) END AS key,
         row_number() OVER () AS row FROM numbered),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS most
  FROM per),
levels AS (
  SELECT *, most / weight AS ratio,
         ((SELECT sum(source_size) FROM per)
          - coalesce((SELECT sum(b.most) FROM weighed b WHERE b.most / b.weight < a.most / a.weight), 0))
         / (SELECT sum(b.weight) FROM weighed b WHERE b.most / b.weight >= a.most / a.weight) AS level
  FROM weighed a),
fixed AS (
  SELECT min_by(level, ratio) AS level FROM levels WHERE most > level * weight),
targets AS (
  SELECT source, source_size,
         CASE WHEN f.level IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), f.level * weight) END AS target
  FROM levels LEFT JOIN fixed f ON true),
flows AS (
  SELECT s.*, t.source_size, t.target, r.round,
         CAST(sum(s.size) OVER (PARTITION BY s.source, r.round ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) r(round)
  WHERE size > 0 AND target > 0),
queue AS (
  SELECT *, sum(size) OVER (
           ORDER BY CAST(upto + round * source_size AS DOUBLE) / target, key, source NULLS LAST, round
           ROWS UNBOUNDED PRECEDING) AS total
  FROM flows),
served AS (
  SELECT row, count(*) AS served FROM queue WHERE total <= (SELECT sum(size) FROM sized) GROUP BY row)
SELECT s.doc_id, s.size, t.source_size, t.target, s.size * coalesce(v.served, 0) AS taken, s.source,
       coalesce(v.served, 0) AS served
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN served v USING (row)
"""

OP10_SQL = r"""
WITH refs AS (
  SELECT * FROM (VALUES
    ('en', string_split('the of and to in a is that it for with as was on are this by be from or an at', ' ')),
    ('de', string_split('der die und in den von zu das mit sich ist im ein nicht auf dem des eine für als auch es', ' ')),
    ('fr', string_split('de la le et les des en un une que du est pour qui dans par au sur pas avec plus ne', ' ')),
    ('es', string_split('de la que el en y los se del las un por con una para su al lo como más es no', ' '))) r(lang, common)),
docs AS (
  SELECT doc_id, d.lang, coalesce(text, '') AS text, coalesce(r.common, []) AS common,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents d LEFT JOIN refs r USING (lang)),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs))),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, common, list_transform(w, lambda x: lower(x)) AS lw,
         CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '[0-9]')) AS n_digit,
         len(regexp_extract_all(text, '[.,;:!?''"()-]')) AS n_punct
  FROM docs),
base AS (
  SELECT c.*, coalesce(chars, 0) AS word_chars, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM counted c LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id)),
bins AS (
  SELECT doc_id, lang, base_failed, 'class' AS kind, u.i, u.n
  FROM (SELECT doc_id, lang, base_failed,
          unnest([{'i': 0, 'n': n_upper}, {'i': 1, 'n': n_digit}, {'i': 2, 'n': n_symbols}, {'i': 3, 'n': n_punct},
                  {'i': 4, 'n': greatest(word_chars - n_upper - n_digit - n_symbols - n_punct, 0)}]) AS u
        FROM base)
  UNION ALL
  SELECT doc_id, lang, base_failed, 'word', k, len(list_filter(lw, lambda x: x = c))
  FROM (SELECT doc_id, lang, base_failed, lw, unnest(common) AS c, generate_subscripts(common, 1) AS k FROM base)
  UNION ALL
  SELECT doc_id, lang, base_failed, 'word', 0, len(list_filter(lw, lambda x: NOT list_contains(common, x))) FROM base),
shares AS (
  SELECT b.doc_id, b.kind, b.n / sum(b.n) OVER (PARTITION BY b.doc_id, b.kind) AS p, r.n / r.total AS q
  FROM bins b JOIN (
    SELECT lang, kind, i, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, kind) AS total
    FROM bins WHERE NOT base_failed GROUP BY lang, kind, i) r
  ON b.lang IS NOT DISTINCT FROM r.lang AND b.kind = r.kind AND b.i = r.i),
far AS (
  SELECT doc_id, kind, sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
     + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS distance
  FROM shares WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY doc_id, kind)
SELECT b.doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT (n_words >= 50 AND coalesce(c.distance, 0) > 0.15 + 1.2 / sqrt(n_words))
       AND NOT (n_words >= 100 AND coalesce(v.distance, 0) > 0.15 + 2.0 / sqrt(n_words)) AS kept
FROM base b
LEFT JOIN far c ON c.doc_id = b.doc_id AND c.kind = 'class'
LEFT JOIN far v ON v.doc_id = b.doc_id AND v.kind = 'word'
"""

OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents),
numbers AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def _op12_sql() -> str:
    """Starting centroids, three rounds of assignment and means, and the last assignment."""
    steps = [
        """
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
components AS (
  SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
c0 AS (
  SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), v) - 1 AS c FROM kept) WHERE c < 16)"""
    ]
    for at in range(4):
        steps.append(f"""
a{at} AS (
  SELECT row, min_by(c, far * 16 + c) AS c, min(far) AS far
  FROM (SELECT row, c, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS far
        FROM components p JOIN c{at} c USING (d) GROUP BY row, c) GROUP BY row)""")
        if at < 3:
            steps.append(f"""
c{at + 1} AS (
  SELECT o.c, o.d, coalesce(CAST(floor(m.total / m.n) AS BIGINT), o.x) AS x
  FROM c{at} o LEFT JOIN (SELECT c, d, sum(x) AS total, count(*) AS n FROM components JOIN a{at} USING (row) GROUP BY c, d) m
  USING (c, d))""")
    return ",".join(steps) + """
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.far AS distance,
       CAST(sum(a.far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.far) OVER () AS BIGINT) AS inertia,
       s.sha AS centroid_sha256
FROM kept k JOIN a3 a USING (row)
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM c3 GROUP BY c) s ON s.c = a.c
"""


OP12_SQL = _op12_sql()

OP13_SQL = r"""
WITH rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r(rule_host, rule_path, verdict)),
cut AS (
  SELECT page_id, row_number() OVER () AS row, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, row,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
best AS (
  SELECT row, arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) AS best
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (row)
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_nearest": op2_nearest,
    "op3_mixing": op3_mixing,
    "op4_token_store": op4_token_store,
    "op5_chat_format": op5_chat_format,
    "op6_quality_model": op6_quality_model,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_middle": op11_fill_middle,
    "op12_clusters": op12_clusters,
    "op13_url_rules": op13_url_rules,
}
ORACLES = {
    "op3_mixing": OP3_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_clusters": OP12_SQL,
    "op13_url_rules": OP13_SQL,
}
