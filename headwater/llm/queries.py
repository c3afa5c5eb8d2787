"""One query for each training-data operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, language_id, lexical, line_dedup, media, minhash, mixing, packing, pii, quality_rules, suffix_dedup, toxicity
from .common import documents, id_mod


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_mod(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.filter(~held_out).select("lang", "text"))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(rows, model)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["first"].cast("string"), m["last"].cast("string"))), ",")
    return out.withColumn("mask", mask)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=3, percent=85, lower=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", F.col("n_chunks"), "n_removed", F.md5("text").alias("text_md5"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_media(documents(spark, sf_dir)))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_mod(F.col("doc_id"), 4) == 2
    scorer = toxicity.train(docs.filter(~held_out).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), scorer)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "passages", "share")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(documents(spark, sf_dir)))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.search(lexical.build(documents(spark, sf_dir)), items, top=20)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_best_fit_packing, op3_chat_formatting, op4_minhash_near_dedup, op5_quality_rules, op6_suffix_array_dedup, op7_line_dedup, op8_media_columns, op9_source_mixing, op10_toxicity, op11_pii, op12_lexical_search, op13_tokenizer_alignment)
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": """
WITH t AS (
  SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1) // 64)::BIGINT AS part
  FROM (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<||im_') AS text FROM conversations)),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
p AS (
  SELECT t.conv_id, s.perspective, t.part, t.turn, t.role, t.text, t.role = s.perspective AS own,
    CASE WHEN t.role = s.perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || t.role || chr(10) END AS head,
    t.text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS LAST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM p)
SELECT conv_id, perspective, part, count(*)::BIGINT AS n_turns,
  string_agg(head || body, '' ORDER BY turn NULLS LAST, role, text) AS rendered,
  coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR, ',' ORDER BY pos) FILTER (WHERE own), '') AS mask,
  coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_masked
FROM o GROUP BY conv_id, perspective, part""",
    "op5_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, """ + _WORDS + r""" AS w FROM documents),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
ink AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ink GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
tw AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM tw, range(0, 5) AS x(k) GROUP BY r),
n AS (SELECT r, doc_id, source, lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))) AS line FROM ink),
one AS (SELECT r, doc_id, source, line, count(*) * (length(line) - length(replace(line, ' ', '')) + 1) AS words FROM n GROUP BY r, doc_id, source, line),
com AS (SELECT source, line FROM one JOIN d USING (r) GROUP BY ALL HAVING count(DISTINCT (d.doc_id, d.text)) > 20),
lost AS (SELECT r, sum(words) AS n_common_words FROM one JOIN com ON one.line = com.line AND one.source IS NOT DISTINCT FROM com.source GROUP BY r),
b AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_common_words, 0)::BIGINT AS n_common_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * (n_words - n_common_words) < 30 * n_words AS kept, n_common_words FROM f""".replace("FROM one JOIN d USING (r) GROUP BY ALL", "FROM (SELECT one.source, one.line, d.doc_id, d.text FROM one JOIN d USING (r)) AS d GROUP BY source, line"),
    "op7_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, text, i, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL)),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
e AS (SELECT *, (coalesce(lag(h) OVER (PARTITION BY r ORDER BY i), 0) * 1000003 + h) % 2147483647 % 4 = 0 OR i = n AS ends FROM h),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
k AS (SELECT r, doc_id, text, place, string_agg(line, chr(10) ORDER BY i) AS chunk,
  count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS ink FROM c GROUP BY r, doc_id, text, place),
m AS (SELECT *, CASE WHEN ink >= 2 THEN dense_rank() OVER (PARTITION BY chunk, ink >= 2 ORDER BY coalesce(doc_id, 9223372036854775807), text, place) ELSE 1 END > 1 AS gone FROM k)
SELECT d.doc_id, coalesce(x.n_chunks, 0)::BIGINT AS n_chunks, coalesce(x.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL WHEN x.n_removed = 0 THEN md5(d.text) ELSE md5(coalesce(x.rest, '')) END AS text_md5
FROM d LEFT JOIN (SELECT r, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS n_removed,
  string_agg(chunk, chr(10) ORDER BY place) FILTER (WHERE NOT gone) AS rest FROM m GROUP BY r) AS x USING (r)""",
    "op9_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(""" + _WORDS + r""")::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix-1'), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS s FROM d GROUP BY source),
n AS (SELECT source, s, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (SELECT *, 3 * s / w AS lim, sum(3 * s) OVER (ORDER BY 3 * s / w, source ROWS UNBOUNDED PRECEDING) AS full_, sum(w) OVER (ORDER BY 3 * s / w, source ROWS UNBOUNDED PRECEDING) AS w_full, sum(s) OVER () AS t, sum(w) OVER () AS w_all FROM n),
c AS (SELECT greatest(max((t - full_ + 3 * s) / (w_all - w_full + w)) FILTER (WHERE (t - full_ + 3 * s) / (w_all - w_full + w) <= lim), 0) AS rate FROM o),
g AS (SELECT source, s, least(3 * s, w * rate) AS target FROM n, c),
b AS (SELECT d.*, g.s, g.target, row_number() OVER () AS r, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, upto / target + p * s / target AS finish FROM b, range(0, 3) AS x(p) WHERE size > 0 AND target > 0),
v AS (SELECT r, size, coalesce(sum(size) OVER (ORDER BY finish, source NULLS FIRST, k, p, doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM q),
n3 AS (SELECT r, count(*) AS copies FROM v WHERE spent + size / 2 <= (SELECT sum(size) FROM d) GROUP BY r)
SELECT doc_id, size, s::BIGINT AS source_size, round(target, 6) AS target, (size * coalesce(copies, 0))::BIGINT AS taken FROM b LEFT JOIN n3 USING (r)""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, """ + _TERMS + r""" AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, """ + _TERMS + r""" AS t FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
a AS (SELECT q, item_id, term, count(*) * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT q, item_id, unnest(t) AS term FROM i) JOIN df USING (term), g GROUP BY q, item_id, term, n_docs, df),
s AS (SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))))::BIGINT AS score
  FROM a JOIN tf USING (term), g GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op11_pii": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT r, 0 AS k, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT r, 1, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+'), string_split_regex(text, '[0-9](?:[ -]?[0-9])+') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][ ().0-9-]+[0-9]') FROM d),
u AS (SELECT r, k, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM f WHERE len(m) > 0),
s AS (SELECT r, k, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
  sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) - length(m) AS a, sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS b FROM u),
base AS (
  SELECT r, k, a::INT AS a, b::INT AS b, k || ':' || CASE k WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE digits END AS value FROM s WHERE CASE k WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255')) = 0
    WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
      CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INT WHEN digits[length(digits) - i]::INT > 4 THEN 2 * digits[length(digits) - i]::INT - 9 ELSE 2 * digits[length(digits) - i]::INT END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END),
n AS (SELECT count(*) AS n FROM d),
e AS (SELECT value, count(DISTINCT r) AS held FROM base JOIN d USING (r), n GROUP BY value, n HAVING count(DISTINCT text) >= 5 AND count(DISTINCT r) * 64 <= n),
w AS (SELECT r, value, held, text, side, CASE side WHEN 0 THEN greatest(a - 128, 0) ELSE b END AS first, CASE side WHEN 0 THEN a ELSE least(b + 128, length(text)) END AS last
  FROM base JOIN e USING (value) JOIN d USING (r), range(2) AS x(side)),
t AS (SELECT *, unnest(string_split_regex(substring(text, first + 1, last - first), '[\t\n\x0B\f\r ]')) AS word, unnest(range(len(string_split_regex(substring(text, first + 1, last - first), '[\t\n\x0B\f\r ]')))) AS i FROM (SELECT *, row_number() OVER () AS wid FROM w)),
l AS (SELECT *, first + coalesce(sum(length(word) + 1) OVER (PARTITION BY wid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, regexp_extract(word, '^(\p{L}{3,})[.,;:!?)]*$', 1) AS letters FROM t),
near AS (SELECT r, text, value, held, a::INT AS a, (a + length(letters))::INT AS b, lower(letters) AS term FROM l
  WHERE letters <> '' AND (a > first OR first = 0) AND (a + length(letters) < last OR last = length(text))),
pairs AS (SELECT value, held, term, count(DISTINCT r) AS both_ FROM near GROUP BY ALL HAVING count(DISTINCT text) >= 5),
df AS (SELECT term, count(DISTINCT r) AS holding FROM (SELECT r, regexp_extract(unnest(string_split_regex(lower(text), '[\t\n\x0B\f\r ]')), '^(\p{L}{3,})[.,;:!?)]*$', 1) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY term),
told AS (SELECT value, term FROM pairs JOIN df USING (term), n WHERE log2(both_ * n::DOUBLE / (held * holding)) >= 6 AND log2(both_ * n::DOUBLE / (held * holding)) >= 0.8 * log2(n::DOUBLE / held)),
every AS (SELECT r, k, a, b FROM base UNION ALL SELECT DISTINCT r, 4, a, b FROM near JOIN told USING (value, term)),
o AS (SELECT r, string_agg(['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans,
  string_agg(['email', 'ip', 'card', 'phone'][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (WHERE k < 4) AS base,
  count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, count(*) FILTER (WHERE k = 3) AS n3 FROM every GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_email, coalesce(n1, 0)::BIGINT AS n_ip, coalesce(n2, 0)::BIGINT AS n_card, coalesce(n3, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)""",
}
