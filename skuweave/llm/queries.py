"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    exact_dedup,
    filter_audit,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    repeats,
    token_alignment,
    token_counts,
    toxicity,
    url_filter,
)
from .common import table


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), length=200).select(
        "doc_id", "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"]).alias(
            "n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place,
         sum(sum(size)) OVER () * 1.5::DOUBLE AS pot
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, 2 * source_size AS most, (2 * source_size)::DOUBLE / weight AS ratio,
         (pot - coalesce(sum(2 * source_size) OVER (
             ORDER BY (2 * source_size)::DOUBLE / weight, place
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, place
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce(
           (SELECT arg_min(level, place_) FROM (
              SELECT level, row_number() OVER (ORDER BY ratio, place) AS place_, ratio
              FROM leveled) WHERE level <= ratio) * weight, most::DOUBLE)) AS target
  FROM leveled),
based AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT
            AS base FROM targets),
hashes AS (
  SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
running AS (
  SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
edges AS (
  SELECT r.source, CASE WHEN upto - budget < budget - (upto - words) THEN h ELSE h - 1 END AS threshold
  FROM running r JOIN (SELECT *, greatest(target - base * source_size, 0.0) AS budget FROM based) b
    ON r.source IS NOT DISTINCT FROM b.source
  WHERE upto >= budget AND upto - words < budget)
SELECT s.doc_id, s.size, b.source_size, b.target, s.source,
       base + (h <= coalesce(threshold, -1))::BIGINT AS copies,
       (base + (h <= coalesce(threshold, -1))::BIGINT) * s.size AS taken
FROM sized s JOIN based b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP7_SQL = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM folded WINDOW same AS (PARTITION BY body)
"""

#: The vocabulary of op1; any sentencepiece file with scores will do.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     token_counts.read_pieces(pieces))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model).select(
        "doc_id", "held_out", "score", "predicted")


#: (verdict, host, path) of op8.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"),
             ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ROUNDS = 8


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES, rounds=ROUNDS)


def _propagation_sql(name: str, links: str, seeds: str) -> str:
    """CTEs for the rounds of one direction; the last is called `name`."""
    unit, last = url_filter.UNIT, f"{name}_{ROUNDS}"
    parts = [f"""{name}_seed AS (
  SELECT host, (pages * {unit} // sum(pages) OVER ())::BIGINT AS seed
  FROM (SELECT host, {seeds} AS pages FROM hosts) WHERE pages > 0)""",
             f"{name}_0 AS (SELECT host, seed AS mass FROM {name}_seed)"]
    for k in range(ROUNDS):
        parts.append(f"""{name}_{k + 1} AS (
  SELECT host, sum(mass)::BIGINT AS mass FROM (
    SELECT dst AS host, mass * 85 * links // (100 * fanout) AS mass
    FROM {name}_{k} m JOIN (SELECT *, sum(links) OVER (PARTITION BY src) AS fanout FROM {links}) l
      ON m.host = l.src
    UNION ALL SELECT host, seed * 15 // 100 FROM {name}_seed) GROUP BY host)""")
    return ",\n".join(parts) + f",\n{name} AS (SELECT * FROM {last})"


def _rule_sql(what: str) -> str:
    longest = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
        f"THEN '{h + p if what == 'rule' else verdict}'" for verdict, h, p in longest) + " END"


OP8_SQL = rf"""
WITH read AS (
  SELECT page_id, html,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS of_rule FROM read),
hosts AS (SELECT host, count(*) FILTER (of_rule = 'allow') AS allowed,
                 count(*) FILTER (of_rule = 'block') AS blocked FROM ruled GROUP BY host),
named AS (
  SELECT host AS src, unnest(regexp_extract_all(html,
    '(?i)(?:href|src)\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) AS link FROM read),
linked AS (
  SELECT src, translate(regexp_extract(CASE WHEN link LIKE '//%' THEN 'http:' || link ELSE link END,
                 '^(?s:.*?)://([^/?#]*)', 1),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM named),
split AS (SELECT DISTINCT host, string_split(host, '.') AS part FROM read),
up AS (
  SELECT DISTINCT array_to_string(part[k:], '.') AS src, array_to_string(part[k + 1:], '.') AS dst
  FROM (SELECT part, unnest(range(1, len(part) - 1)) AS k FROM split WHERE len(part) > 2)),
links AS (
  SELECT src, dst, sum(links)::BIGINT AS links FROM (
    SELECT src, dst, 1 AS links FROM linked WHERE src <> dst AND src <> '' AND dst <> ''
    UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY src, dst),
back AS (SELECT dst AS src, src AS dst, links FROM links),
{_propagation_sql('trust', 'links', 'allowed')},
{_propagation_sql('distrust', 'back', 'blocked')},
judged AS (
  SELECT h.host, CASE WHEN coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END
           AS verdict
  FROM hosts h LEFT JOIN trust t ON h.host = t.host LEFT JOIN distrust d ON h.host = d.host)
SELECT page_id, r.host, path, rule, coalesce(of_rule, verdict) AS verdict
FROM ruled r JOIN judged j ON r.host = j.host
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaking_items(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).select(
        "doc_id", "held_out", "score", "predicted")


#: The conversation that op11 adds: texts that look like turns.
PLANTED_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"),
                (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(PLANTED_CHAT, rows.schema))
    return chat_format.read_back(chat_format.format_chats(chat_format.log_of_rows(rows))).drop(
        "n_documents")


OP11_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
              ORDER BY turn NULLS FIRST, role || ':' || md5(body)) AS place,
         length(regexp_replace(body, '(<)(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|unk>'
             || '|<SYS>>|</SYS>>))|(\[)(\\*(?:INST\]|/INST\]))', '\1\3\\\2\4', 'g')) AS chars
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY place) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + chars + length('<|im_end|>') + 1)::BIGINT
         AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"),
                                     table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
masked AS (
  SELECT doc_id, part,
         (len(words) < 100)::INT
         + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
         + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body))::INT
         + 8 * regexp_matches(body, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)::INT AS mask
  FROM split),
marked AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good,
         coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY 1),
cells AS (
  SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masked m LEFT JOIN marked l ON m.doc_id = l.doc_id GROUP BY 1, 2),
orders(filter_order, applied, path) AS (
  SELECT '', 0, [0] UNION ALL
  SELECT filter_order || letter, applied | bit, list_append(path, applied | bit)
  FROM orders, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(letter, bit)
  WHERE applied & bit = 0),
steps AS (
  SELECT filter_order, k AS step, path[k] AS before, path[k + 1] AS after,
         path[k + 1] - path[k] AS bit
  FROM orders, (SELECT unnest(range(1, 6))::INT AS k) WHERE length(filter_order) = 5),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & after = 0 THEN docs ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN docs ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN docs ELSE 0 END)::BIGINT
           AS redundant,
         sum(CASE WHEN mask = bit THEN docs ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT
           AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT
           AS toxic_lost
  FROM cells, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""


#: The vocabularies of op13: byte-level BPE and pieces.
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def op13_token_alignment(spark: SparkSession, sf_dir: str, a: str = BYTE_VOCABULARY,
                         b: str = PIECES) -> DataFrame:
    return token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), a, b)


QUERIES = {"op1_token_counts": op1_token_counts, "op2_ngram_join": op2_ngram_join,
           "op3_repeats": op3_repeats,
           "op4_line_dedup": op4_line_dedup,
           "op5_mixture": op5_mixture, "op6_toxicity": op6_toxicity, "op7_exact_dedup": op7_exact_dedup, "op8_url_filter": op8_url_filter,
           "op9_decontaminate": op9_decontaminate, "op10_quality": op10_quality,
           "op11_chat_format": op11_chat_format, "op12_filter_audit": op12_filter_audit,
           "op13_token_alignment": op13_token_alignment}
ORACLES = {"op5_mixture": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filter": OP8_SQL,
           "op11_chat_format": OP11_SQL, "op12_filter_audit": OP12_SQL}
