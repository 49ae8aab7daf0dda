"""The queries of the thirteen operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonara.llm import bpe, chat, fim, lzprint, mixing, quality, sentencepieces, simhash, tokens, toxicity, urls, warc, whitening
from sonara.llm.common import prepare, table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_json(name: str = TOKENIZER) -> str:
    return bpe.read_tokenizer(public_tokenizers.path(name))


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return tokens.token_digest(table(spark, sf_dir, "documents"), tokenizer_json())


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_json())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lzprint.edit_likeness(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return chat.chat_digest(chat.with_probe(table(spark, sf_dir, "conversations")))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sentencepieces.piece_round_trip(table(spark, sf_dir, "documents"), sentencepieces.read_model(public_tokenizers.path(PIECES)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whitening.whitening_rows(table(spark, sf_dir, "embeddings"), most=32)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fim.fim_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_shards, op2_bpe, op3_toxicity, op4_lz_fingerprint, op5_warc, op6_simhash, op7_quality, op8_url_rules, op9_mixing, op10_chat, op11_sentencepiece, op12_whitening, op13_fim)}


OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f"""

OP7 = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
b AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
t AS (SELECT doc_id, k, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4, lag(word) OVER o AS before
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w) WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
c AS (SELECT doc_id, k, word, before, CASE WHEN w4 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w1, w2, w3, w4) > 1 THEN 1 ELSE 0 END AS found FROM t),
m AS (SELECT doc_id, word = before AS adjacent, max(found) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM c),
r AS (SELECT doc_id, CAST(sum(inside) AS BIGINT) AS n_repeat_words, count(*) FILTER (WHERE adjacent) AS n_adjacent FROM m GROUP BY doc_id),
j AS (SELECT b.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_adjacent, 0) AS n_adjacent FROM b LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 5 * n_adjacent > n_words OR 2 * n_dup_lines > len(lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM f"""

OP8 = r"""WITH RECURSIVE rules(rv, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (SELECT url, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>') AS link, regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') AS meta FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
targets AS (SELECT url, regexp_extract(link, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM tags UNION SELECT url, regexp_extract(meta, '(?is)url\s*=\s*([^"''\s>]+)', 1) FROM tags),
full_targets AS (SELECT url, CASE WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN 'http://' || regexp_extract(url, '://([^/?#]*)', 1) || t WHEN contains(t, '://') THEN t END AS t FROM targets WHERE t <> ''),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION SELECT url FROM full_targets UNION SELECT t FROM full_targets)),
rest AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM urls),
parts AS (SELECT url, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
nodes AS (SELECT url, host, path, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END END AS node FROM parts),
fits AS (SELECT node, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC) AS k FROM (SELECT DISTINCT node, host, path FROM nodes) JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)),
ruled AS (SELECT host, path, node, rule, rv FROM fits WHERE k = 1),
edges AS (SELECT a.node AS x, b.node AS y FROM full_targets f JOIN nodes a ON a.url = f.url JOIN nodes b ON b.url = f.t WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y),
by_class AS (SELECT r.x AS node, CASE WHEN bool_or(d.rv = 'allow') THEN 'allow' WHEN bool_or(d.rv = 'block') THEN 'block' END AS v FROM reach r LEFT JOIN ruled d ON d.node = r.y GROUP BY r.x)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, d.rule, coalesce(d.rv, c.v, 'allow') AS verdict
FROM pages p LEFT JOIN nodes n ON n.url = p.url LEFT JOIN ruled d ON d.host = n.host AND d.path = n.path LEFT JOIN by_class c ON c.node = n.node"""

OP9 = r"""WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
o AS (SELECT *, row_number() OVER () AS n, sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM s),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS most FROM t),
l AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(most) OVER w - most AS before, sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM w WINDOW w AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, CASE WHEN NOT most * after <= (budget - before) * weight THEN (budget - before) / after END AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE weight * max(level) OVER () END AS target FROM v),
d AS (SELECT o.*, g.source_size, g.target FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source),
p AS (SELECT d.*, pass, source_size * pass + upto - size AS begin, greatest(0, least(size, floor(target) - (source_size * pass + upto - size))) AS first FROM d, (VALUES (0), (1)) AS x(pass)),
c AS (SELECT n, k, pass, FALSE AS behind, first AS words, (begin + first) / target AS finish FROM p WHERE first > 0 UNION ALL SELECT n, k, pass, TRUE, size - first, (begin + size) / target FROM p WHERE first < size),
q AS (SELECT n, words, sum(words) OVER (ORDER BY finish, behind, k, pass, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served FROM c),
r AS (SELECT n, sum(greatest(0, least(words, (SELECT sum(floor(target)) FROM g) - (served - words)))) AS taken FROM q GROUP BY n)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM d LEFT JOIN r USING (n)"""

OP10 = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, CASE role WHEN 'assistant' THEN 14 ELSE 18 END AS marks,
  len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|\[ANS\]|<<SYS>>|<</SYS>>|\[ROLE:|\[/ROLE\]|\x1b')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256, CAST(sum(marks + length(text) + escapes) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

OP13 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS d FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || d[25:32] AS BIGINT) % 100 < 50 AS s FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN s THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS e FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || e || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || e || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""

#: The others tokenize, learn or hash in ways that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_warc": OP5, "op7_quality": OP7, "op8_url_rules": OP8, "op9_mixing": OP9, "op10_chat": OP10, "op13_fim": OP13}
