"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import htmltext, jaccard, langid, licences, linededup, media, mixing, packing, pii, topk
from .common import table


def op1_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_lines(spark, sf_dir):
    found = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
    return found.select("doc_id", "text", "n_lines", "removed_lines", shown.alias("removed"))


def op4_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_media(spark, sf_dir):
    return media.described(media.store(table(spark, sf_dir, "documents")))


def op6_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    found = langid.identify(docs, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_near(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "n_links")


def op10_main_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per_source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank % 3 + 1)::INT] AS weight FROM ranked),
ratios AS (SELECT *, (source_size * 2)::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
             - coalesce(sum(source_size * 2) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
shared AS (SELECT level AS shared FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
goals AS (
  SELECT l.*, CASE WHEN s.shared IS NULL OR ratio < s.shared THEN (source_size * 2)::DOUBLE ELSE weight * s.shared END AS target
  FROM levels l LEFT JOIN shared s ON true),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.rank,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(2, floor(target / source_size)::BIGINT
            + (start + size / 2.0::DOUBLE < target - floor(target / source_size) * source_size)::BIGINT) END AS copies,
         least(start::DOUBLE / target, 1.0::DOUBLE) AS u
  FROM placed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(CASE rank % 3
         WHEN 0 THEN least(2.0::DOUBLE * u / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * u, 0.0::DOUBLE))), 1.0::DOUBLE)
         WHEN 1 THEN least(2.0::DOUBLE * u / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * u, 0.0::DOUBLE))), 1.0::DOUBLE)
         ELSE u END, 9) END AS position
FROM counted
"""


def _sql_text(value):
    return "'" + value.replace("'", "''") + "'"


# Written apart from the operator: only the fixed values (texts, digests, equal spellings) are shared.
_HOLDER = r"(?im)^[ \t#*/;!-]*(?:copyright[ \t]*(?:\(c\)|©|[<\[{]|[12][0-9]{3}|by )|\(c\)[ \t]*(?:copyright|[12][0-9]{3})|©|all rights reserved)[^\n]*$"
_SPELLED = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in licences.SPELLINGS) + "}"
# a text's lines as lists of words, then its lines, and its blocks: what stands between lines without words
_LINES = f"""list_transform(string_split(regexp_replace(text, '{_HOLDER}', '', 'g'), chr(10)), lambda l:
  array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(l), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: coalesce({_SPELLED}[w], w)), ' '))"""
_BLOCKS = "list_filter(list_transform(string_split(replace(array_to_string(list_transform(lines, lambda l: CASE WHEN l = '' THEN chr(1) ELSE l END), ' '), chr(1) || ' ', chr(1)), chr(1)), lambda b: trim(b)), lambda b: b <> '')"

OP4_SQL = f"""
WITH texts(licence, text) AS (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in licences.KNOWN)}),
tl AS (SELECT licence, {_LINES} AS lines FROM texts),
tb AS (SELECT licence, {_BLOCKS} AS b FROM tl),
known AS (SELECT licence, len(b) AS blocks, md5(array_to_string(b, ' ')) AS whole, md5(array_to_string(list_transform(b, lambda x: md5(x)), '')) AS run FROM tb
  UNION SELECT * FROM (VALUES {", ".join(f"('{a}', {n}, '{b}', '{c}')" for a, n, b, c in licences.KNOWN_DIGESTS)})),
wanted AS (SELECT licence, whole AS digest FROM known UNION SELECT licence, run FROM known WHERE blocks > 1),
dl AS (SELECT doc_id, {_LINES} AS lines FROM documents WHERE text IS NOT NULL),
db AS (SELECT doc_id, lines, {_BLOCKS} AS b FROM dl),
units AS (
  SELECT doc_id, 'whole' AS kind, -1 AS line, md5(array_to_string(b, ' ')) AS digest FROM db WHERE len(b) > 0
  UNION ALL SELECT doc_id, 'line', line, md5(l) FROM (SELECT doc_id, unnest(range(len(lines)))::INT AS line, unnest(lines) AS l FROM db WHERE len(lines) > 1) WHERE l <> ''
  UNION ALL SELECT doc_id, 'block', -1, md5(x) FROM (SELECT doc_id, unnest(b) AS x FROM db WHERE len(b) > 1)
  UNION ALL SELECT doc_id, 'run', -1, md5(array_to_string(list_transform(b[i:i + n - 1], lambda x: md5(x)), ''))
    FROM (SELECT doc_id, b, n, unnest(range(1, len(b) - n + 2)) AS i FROM db JOIN (SELECT DISTINCT blocks AS n FROM known WHERE blocks > 1) ON len(b) >= n))
SELECT doc_id, licence, bool_or(kind = 'whole') AS whole, count(*) FILTER (WHERE kind <> 'whole') AS n_units, min(CASE WHEN line >= 0 THEN line END) AS first_line
FROM units JOIN wanted USING (digest) GROUP BY doc_id, licence
"""

OP6_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id,
         list_sum(list_transform(list_zip(q.v, p.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM rows WHERE vec_id % 50 = 0) q JOIN rows p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def queries():
    return {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}


def oracle_sql():
    return {"op1_mix": OP1_SQL, "op4_licences": OP4_SQL, "op6_topk": OP6_SQL}
