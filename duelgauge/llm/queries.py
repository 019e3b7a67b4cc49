"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgauge.llm import conversations, hnsw, jaccard, licenses, line_dedup, mixing, packing, pii, quality, records, substrings, topk, whitening
from duelgauge.llm.common import table
from duelgauge.llm.tokens import vocabulary_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=0)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: licenses found, number of matching units, best score."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select(
        "doc_id", F.array_join(names, ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches"), best.alias("best_score")
    )


def op7_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.written_and_read(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_graph_neighbours": op4_graph_neighbours,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_record_files": op7_record_files,
    "op8_quality": op8_quality,
    "op9_personal_data": op9_personal_data,
    "op10_pareto_mix": op10_pareto_mix,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

LINE_DEDUP_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
 SELECT r, doc_id, i, lines[i] AS line,
        translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
 FROM docs, unnest(range(1, len(lines) + 1)) AS t(i)),
frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (k) GROUP BY r"""

EXACT_TOP_K_SQL = """
WITH v AS (
 SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0 GROUP BY vec_id),
scored AS (
 SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
 SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

LICENSE_SQL = f"""
WITH templates AS (
 SELECT t.name, t.number, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS b
 FROM (SELECT name, number, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM (VALUES {
    ", ".join(f"({k}, '{name}', '{body.replace(chr(39), chr(39) * 2)}')" for k, (name, body) in enumerate(licenses.TEMPLATES))
}) AS v(number, name, body)) t),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
 SELECT r, text, x, i, coalesce(sum(length(x) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
 FROM (SELECT r, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)),
breaks AS (
 SELECT r, text, p, g, i FROM (
  SELECT r, text, unnest(string_split_regex(text, '\\n(?:[ \\t\\v\\f\\r]*\\n)+')) AS p, unnest(list_append(regexp_extract_all(text, '\\n(?:[ \\t\\v\\f\\r]*\\n)+'), '')) AS g,
         generate_subscripts(string_split_regex(text, '\\n(?:[ \\t\\v\\f\\r]*\\n)+'), 1) AS i FROM docs)),
paragraphs AS (
 SELECT r, p AS x, coalesce(sum(length(p) + length(g)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM breaks),
units AS (
 SELECT r, a, x FROM lines WHERE x <> '' UNION SELECT r, a, x FROM paragraphs WHERE x <> '' UNION SELECT r, 0, text FROM docs WHERE text <> ''),
words AS (
 SELECT r, a, length(x) AS n, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM units),
sets AS (
 SELECT r, a, n, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS b
 FROM words WHERE len(w) BETWEEN 1 AND 400),
scored AS (
 SELECT r, a, n, name, max(2.0 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b))) AS score
 FROM sets s JOIN templates t ON len(s.b) BETWEEN len(t.b) * 2 / 3 - 0.01 AND len(t.b) * 1.5 + 0.01 GROUP BY r, a, n, name HAVING score >= 0.8)
SELECT d.doc_id, coalesce(string_agg(DISTINCT s.name, ',' ORDER BY s.name), '') AS licenses, count(s.name) AS n_matches,
       coalesce(max(CAST(s.score AS DOUBLE)), 0.0) AS best_score
FROM docs d LEFT JOIN scored s USING (r) GROUP BY d.r, d.doc_id"""

# CRC-32 bit by bit; then a walk over all rows of every conversation at once, which keeps the cheapest edits and the
# ASCII-least audit for each state of the automaton. `ways` holds what one row can do, inserts before it included.
CONVERSATION_SQL = r"""
WITH RECURSIVE
keyed AS (
 SELECT row_number() OVER () AS r, conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), 'null') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
 SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM keyed),
damaged AS (
 SELECT r, g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n
 FROM kinds, (VALUES (1), (2)) t(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, r, n) AS i,
        trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
judged AS (
 SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
                WHEN body[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
        role[1] AS c, lag(role[1]) OVER (PARTITION BY g ORDER BY i) AS p FROM placed),
counted AS (
 SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY g),
step(s, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
added(s, t, cost, ins, made) AS (
 VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', 'u'), (1, 2, 3, 'I', 'u'), (2, 3, 3, 'I', 'a'), (3, 2, 3, 'I', 'u'),
        (0, 3, 6, 'II', 'ua'), (1, 3, 6, 'II', 'ua'), (2, 2, 6, 'II', 'au'), (3, 3, 6, 'II', 'ua')),
ways AS (
 SELECT a.s, a.cost + 4 AS cost, a.t, a.ins || 'D' AS audit, a.made, 'D' AS op, NULL AS c FROM added a
 UNION ALL SELECT a.s, a.cost, b.t, a.ins || 'K', a.made, 'K', b.c FROM added a JOIN step b ON a.t = b.s
 UNION ALL SELECT a.s, a.cost + 3, b.t, a.ins || 'R', a.made, b.c, NULL FROM added a JOIN step b ON a.t = b.s WHERE b.c <> 's'),
walk(g, i, s, best) AS (
 SELECT g, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} FROM counted
 UNION ALL
 SELECT w.g, w.i + 1, y.t, min({'cost': w.best.cost + y.cost + CASE WHEN j.fault = 't' AND y.op <> 'D' THEN 3 ELSE 0 END, 'audit': w.best.audit || y.audit,
   'lines': w.best.lines || list_transform(string_split(y.made, ''), lambda x: CASE x WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' END)[1:length(y.made)]
            || CASE y.op WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [j.role || ':' || j.text] WHEN 'u' THEN ['user:' || j.text] ELSE ['assistant:' || j.text] END})
 FROM walk w JOIN judged j ON w.g = j.g AND j.i = w.i + 1 JOIN ways y ON y.s = w.s AND (y.c IS NULL OR y.c = j.c) AND (y.op = 'D' OR j.fault NOT IN ('b', 'd'))
 GROUP BY w.g, w.i, y.t),
ended AS (
 SELECT w.g, min({'cost': w.best.cost + a.cost, 'audit': w.best.audit || a.ins,
   'lines': w.best.lines || list_transform(string_split(a.made, ''), lambda x: CASE x WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' END)[1:length(a.made)]}) AS best
 FROM walk w JOIN counted c ON w.g = c.g AND w.i = c.n JOIN added a ON a.s = w.s AND a.t IN (0, 3) GROUP BY w.g)
SELECT any_value(k.conv_id) AS conv_id, coalesce(any_value(c.gaps), 0) AS gaps, coalesce(any_value(c.blank), 0) AS blank, coalesce(any_value(c.duplicate), 0) AS duplicate,
       coalesce(any_value(c.truncated), 0) AS truncated, coalesce(any_value(c.illegal), 0) AS illegal, coalesce(any_value(e.best.cost), 0) AS cost,
       coalesce(any_value(e.best.audit), '') AS audit, sha256(coalesce(any_value(array_to_string(e.best.lines, chr(10))), '')) AS repaired_sha256
FROM keyed k LEFT JOIN counted c USING (g) LEFT JOIN ended e USING (g) GROUP BY k.g"""

SUBSTRING_SQL = r"""
WITH docs AS (
 SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS no, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
 SELECT no, s, array_to_string(words[s:s + 19], ' ') AS body FROM docs, unnest(range(1, len(words) - 18)) AS t(s)),
repeated AS (SELECT no, s FROM windows QUALIFY row_number() OVER (PARTITION BY body ORDER BY no, s) > 1),
gone AS (SELECT DISTINCT no, s + k AS i FROM repeated, range(20) AS t(k)),
flagged AS (
 SELECT d.no, d.doc_id, w.i, d.words[w.i] AS word, g.no IS NOT NULL AS dropped
 FROM docs d, unnest(range(1, len(d.words) + 1)) AS w(i) LEFT JOIN gone g ON g.no = d.no AND g.i = w.i),
cut AS (SELECT no, count(*) FILTER (dropped) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT dropped) AS kept FROM flagged GROUP BY no)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN cut c USING (no)"""

ORACLES: dict[str, str] = {
    "op12_substring_dedup": SUBSTRING_SQL,
    "op11_conversation_repair": CONVERSATION_SQL,
    "op6_license_scan": LICENSE_SQL,
    "op3_exact_top_k": EXACT_TOP_K_SQL,
    "op1_line_dedup": LINE_DEDUP_SQL,
}
