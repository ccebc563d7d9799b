"""The registered queries of this package, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    bpe_trie,
    chat_views,
    embedding_dedup,
    exact_dedup,
    html_text,
    langid,
    minhash,
    ngram_lm,
    packing,
    personal_data,
    spelling,
    token_alignment,
    url_rules,
)
from clickloom.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query()
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    models = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, models)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")


@query()
def op3_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query(r"""
WITH w AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS at FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS words
    FROM documents)),
b AS (SELECT a.doc_id, a.at, a.w, p.w AS h FROM w a LEFT JOIN w p ON a.doc_id = p.doc_id AND a.at = p.at + 1),
n AS (SELECT count(*) AS n FROM w),
c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w),
o1 AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY doc_id, w),
c2 AS (SELECT h, w, count(*) AS c FROM b WHERE h IS NOT NULL GROUP BY h, w),
o2 AS (SELECT doc_id, h, w, count(*) AS c FROM b WHERE h IS NOT NULL GROUP BY doc_id, h, w),
d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
s AS (
  SELECT b.doc_id, b.h, c2.c - o2.c AS two, ch.c - oh.c AS history,
         (CASE WHEN c1.c > o1.c THEN c1.c - o1.c ELSE 0.5::DOUBLE END) / greatest(n.n - d.n, 1) AS one
  FROM b CROSS JOIN n JOIN d USING (doc_id) JOIN c1 ON c1.w = b.w JOIN o1 ON o1.doc_id = b.doc_id AND o1.w = b.w
  LEFT JOIN c2 ON c2.h = b.h AND c2.w = b.w LEFT JOIN o2 ON o2.doc_id = b.doc_id AND o2.h = b.h AND o2.w = b.w
  LEFT JOIN c1 ch ON ch.w = b.h LEFT JOIN o1 oh ON oh.doc_id = b.doc_id AND oh.w = b.h),
t AS (
  SELECT doc_id, sum(ln(CASE WHEN h IS NULL THEN one WHEN two > 0 THEN two / history ELSE 0.4::DOUBLE * one END)) AS log_score
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(d.n, 0) AS n_tokens, round(coalesce(log_score, 0), 5) AS log_score, round(log_score / d.n, 5) AS score
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op4_lm_scoring(spark, sf_dir):
    scored = ngram_lm.lm_scores(table(spark, sf_dir, "documents"), order=2)
    return scored.select("doc_id", "n_tokens", F.round("log_score", 5).alias("log_score"), F.round("score", 5).alias("score"))


@query()
def op5_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query(r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker,
         coalesce(text, '') AS content
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (
  SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM v),
r AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM h),
s AS (
  SELECT *, coalesce(sum(length(rendered)) OVER before, 0)::BIGINT AS start, count(*) OVER before AS position FROM r
  WINDOW before AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, position, turn, speaker, role, name, rendered, start, start + length(head) AS text_start,
       start + length(head) + length(content) AS text_end, speaker = perspective AS trained
FROM s
""")
def op6_chat_formatting(spark, sf_dir):
    return chat_views.rotate(table(spark, sf_dir, "conversations"))


@query(r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


URL_RULES = [
    url_rules.host_rule("block", "net"),
    url_rules.host_rule("allow", "example.net", "/en/"),
    url_rules.host_rule("block", "example.com", "/de/"),
    url_rules.host_rule("allow", "org", "/fr/"),
    url_rules.pattern_rule("block", r"/wp-login\.php$", ["wp", "login", "php"]),
    url_rules.pattern_rule("block", r"/(?:cgi-bin)/", ["cgi", "bin"]),
    url_rules.pattern_rule("block", r"/ads/[0-9]+", ["ads"]),
    url_rules.pattern_rule("block", r"(?:^|[.])casino[.-]", ["casino"]),
    url_rules.pattern_rule("block", r"/calendar/[0-9]{4}/[0-9]{2}/", ["calendar"]),
]
#: Rules that a caller sees by name; other patterns decide without one.
NAMED = ("net/", "example.net/en/", "example.com/de/", "org/fr/")


def _url_sql() -> str:
    quoted = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', {r[4]})" for r in URL_RULES)
    return rf"""
WITH rules(rule, verdict, pattern, weight) AS (VALUES {quoted}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT target, arg_min(rule, (-weight, rule)) AS rule, arg_min(verdict, (-weight, rule)) AS verdict
  FROM (SELECT DISTINCT host || path AS target FROM u) JOIN rules ON regexp_matches(target, pattern) GROUP BY target)
SELECT page_id, host, path, CASE WHEN rule IN {NAMED} THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN best ON target = host || path
"""


@query(_url_sql())
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", F.when(F.col("rule").isin(*NAMED), F.col("rule")).alias("rule"), "verdict")


@query(r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.good AND b.good AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id <= coalesce(m.b, vec_id) AS kept
FROM v LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
""")
def op9_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


@query()
def op10_bpe_round_trip(spark, sf_dir):
    return bpe_trie.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op11_personal_data(spark, sf_dir):
    return personal_data.personal_spans(table(spark, sf_dir, "documents"))


@query()
def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


@query(r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT doc_id, run, n, xor(4294967295, list_reduce(
    [4294967295] || list_transform(range(1, length(x)::BIGINT, 2), lambda i:
      (strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) AS h
  FROM runs, crc),
words AS (
  SELECT CASE WHEN doc_id IS NOT NULL AND h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, range(1, length(word) + 1) r(i)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS onward FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.onward)
SELECT word, form, c.root, n, n_near, form_n FROM formed JOIN chain c USING (word) WHERE c.onward IS NULL
""")
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_forms(spelling.word_counts(table(spark, sf_dir, "documents")))
