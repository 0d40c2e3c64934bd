"""Driver queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, htmltext, jaccard, langid, mixing, pii, prefixtrie, quality, sharding, toxicity, urlrep, whitening
from .common import held_out, table

URL_RULES = [urlrep.Rule("block", "net/"), urlrep.Rule("allow", "example.net/en/"), urlrep.Rule("block", "example.com/de/"), urlrep.Rule("allow", "org/fr/")]
URL_STRENGTH, URL_Z, URL_LIMIT = 8.0, 1.64, 0.3


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; a page is a labelled bad outcome if the document it shows has quality 0 or is toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("url", F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1).alias("n")).where("n <> ''").select("url", F.col("n").cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = shown.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")
    return urlrep.judge_urls(pages, outcomes, URL_RULES, strength=URL_STRENGTH, z=URL_Z, limit=URL_LIMIT)


OP5_SQL = f"""
WITH parts AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
         nullif(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{{1,18}})', 1), '') AS n
  FROM pages),
page AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS bare FROM parts),
cut AS (SELECT *, string_split(bare, '.') AS l FROM page),
named AS (
  SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS two, l[len(l)] AS one, array_to_string(l[greatest(len(l) - 2, 1):], '.') AS three FROM cut),
levels AS (
  SELECT *, CASE WHEN address THEN '{urlrep.ADDRESS_SUFFIX}' WHEN two IN {urlrep.TWO_LABEL_SUFFIXES} THEN two ELSE one END AS suffix,
         CASE WHEN address THEN bare WHEN two IN {urlrep.TWO_LABEL_SUFFIXES} THEN three ELSE two END AS domain
  FROM (SELECT *, regexp_full_match(bare, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\]?') AS address FROM named)),
outcome AS (
  SELECT bare, domain, suffix, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad
  FROM levels JOIN labels ON labels.doc_id = CAST(n AS BIGINT)),
root AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (count(*) + 2.0) AS m FROM outcome),
s AS (SELECT suffix, {URL_STRENGTH} * m + sum(bad) AS a, {URL_STRENGTH} * (1 - m) + count(*) - sum(bad) AS b FROM outcome, root GROUP BY suffix, m),
d AS (SELECT domain, {URL_STRENGTH} * (a / (a + b)) + sum(bad) AS a2, {URL_STRENGTH} * (1 - a / (a + b)) + count(*) - sum(bad) AS b2 FROM outcome JOIN s USING (suffix) GROUP BY domain, a, b),
h AS (SELECT bare, {URL_STRENGTH} * (a2 / (a2 + b2)) + sum(bad) AS a3, {URL_STRENGTH} * (1 - a2 / (a2 + b2)) + count(*) - sum(bad) AS b3 FROM outcome JOIN d USING (domain) GROUP BY bare, a2, b2),
post AS (
  SELECT page_id, host, path, coalesce(a3, a2, a, {URL_STRENGTH} * m) AS x, coalesce(b3, b2, b, {URL_STRENGTH} * (1 - m)) AS y
  FROM levels LEFT JOIN h USING (bare) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix), root),
bound AS (
  SELECT *, round(x / (x + y), 6) AS bad_rate, round(x / (x + y) - {URL_Z} * sqrt(x * y / ((x + y) * (x + y) * (x + y + 1))), 6) AS bad_bound FROM post),
rules(verdict, rule, rhost, rpath) AS (VALUES {', '.join(f"('{r.verdict}', '{r.rule}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
fit AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
  FROM (SELECT DISTINCT page_id, host, path FROM page) p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL)
SELECT b.page_id, b.host, b.path, fit.rule, coalesce(fit.ruled, CASE WHEN bad_bound >= {URL_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, bad_bound
FROM bound b LEFT JOIN fit ON fit.page_id IS NOT DISTINCT FROM b.page_id AND fit.host = b.host AND fit.path = b.path
"""


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect_pii(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumn("spans", text)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_turns(rows.unionByName(more).withColumn("parts", content_parts()), "parts"), in_order=True)


def content_parts():
    """Typed parts of the table's plain turns: the text in two pieces, cut anywhere, and in two turns of three an attachment between them."""
    text, turn = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("turn").cast("long"), F.lit(0))
    half = (F.length(text) / 2).cast("int")
    part = lambda kind, words, ref, units: F.struct(kind.alias("type"), words.alias("text"), ref.alias("ref"), units.alias("units"))
    none, one = F.lit(None).cast("string"), F.lit(None).cast("int")
    said = lambda words: part(F.lit("text"), words, none, one)
    kind = F.element_at(F.array(F.lit("image"), F.lit("audio"), F.lit("document")), (F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(3)) + 1).cast("int"))
    shown = part(kind, none, F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string")), (F.pmod(turn, F.lit(5)) + 1).cast("int"))
    first, rest = said(F.left(text, half)), said(F.substring(text, half + 1, F.length(text)))
    return F.when(F.pmod(turn, F.lit(3)) == 0, F.array(first, rest)).otherwise(F.array(first, shown, rest))


#: Target weights of the documents' tree; a source's domain goes by its number.
DOMAINS = ("web", "books", "forum")
MIX = mixing.Mix(weights={"domain": {"web": 0.5, "books": 0.3, "forum": 0.2}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}, default=0.1, budget_share=0.6, max_epochs=2, seed=17)


def source_domain(source: str = "source"):
    number = F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999"))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (F.coalesce(number, F.lit(0)) % len(DOMAINS) + 1).cast("int"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX, source_domain())


def _level_sql(level: int) -> str:
    """One level of the budgets: children of every parent filled by rising cap/weight."""
    keys, name = mixing.LEVELS[: level + 1], mixing.LEVELS[level]
    parent = ", ".join(keys[:-1])
    over = f"PARTITION BY {parent} " if parent else ""
    listed = " ".join(f"WHEN '{n}' THEN {w}" for n, w in sorted(MIX.weights.get(name, {}).items()))
    weight = f"CASE {name} {listed} ELSE {MIX.default} END" if listed else str(MIX.default)
    cols = ", ".join(keys)
    source = f"n{level - 1} USING ({parent})" if parent else "total ON true"
    return f"""
c{level} AS (SELECT {cols}, sum(leaf_tokens * {MIX.max_epochs})::DOUBLE AS cap, {weight} AS weight FROM leaves GROUP BY {cols}),
r{level} AS (SELECT *, cap / weight AS ratio FROM c{level} JOIN {source}),
l{level} AS (SELECT *, (budget - coalesce(sum(cap) OVER ({over}ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER ({over}ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM r{level}),
m{level} AS (SELECT *, max(CASE WHEN ratio > here THEN here END) OVER ({over}) AS level FROM l{level}),
n{level} AS (SELECT {cols}, CASE WHEN ratio <= here THEN cap ELSE least(cap, greatest(level * weight, 0)) END AS budget FROM m{level})"""


def mixing_sql(source: str) -> str:
    """The rows of mix_sources over a table or subquery, as DuckDB SQL."""
    keys = ", ".join(mixing.LEVELS)
    return f"""
docs AS (
  SELECT doc_id, ['{"', '".join(DOMAINS)}'][coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % {len(DOMAINS)} + 1] AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens
  FROM {source}),
leaves AS (SELECT {keys}, sum(tokens) AS leaf_tokens FROM docs GROUP BY {keys}),
total AS (SELECT coalesce(sum(leaf_tokens), 0) * {MIX.budget_share} AS budget FROM leaves),
{",".join(_level_sql(i) for i in range(len(mixing.LEVELS)))},
plan AS (
  SELECT *, b // leaf_tokens AS epochs, b - (b // leaf_tokens) * leaf_tokens AS rest
  FROM (SELECT {keys}, leaf_tokens::BIGINT AS leaf_tokens, floor(budget + 1e-6)::BIGINT AS b FROM leaves JOIN n2 USING ({keys})) WHERE leaf_tokens > 0),
placed AS (
  SELECT doc_id, {keys}, tokens, epochs, rest,
         coalesce(sum(tokens) OVER (PARTITION BY {keys} ORDER BY md5('{MIX.seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs JOIN plan USING ({keys}) WHERE tokens > 0)
SELECT doc_id, {keys}, tokens, epochs, greatest(least(rest - before, tokens), 0)::BIGINT AS extra_tokens
FROM placed WHERE epochs > 0 OR rest > before
"""


OP1_SQL = "WITH " + mixing_sql("documents")


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.detect_language(docs, langid.fit_language(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


def op12_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with turns of the one whose id is the next lower multiple of 20."""
    seqs = prefixtrie.sequences(table(spark, sf_dir, "conversations"))
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return prefixtrie.prefix_trie(prefixtrie.with_heads(seqs, F.col("conv_id") - F.col("conv_id") % 20, heads, most=3))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
d AS (
  SELECT conv_id, row_number() OVER w AS depth, list(md5(concat(length(role), ':', role, ':', text))) OVER w AS prefix, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT conv_id, 0 AS depth, []::VARCHAR[] AS prefix, 0 AS words FROM c UNION ALL SELECT * FROM d),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM m),
n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM e GROUP BY prefix, depth),
k AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT prefix[1:up] AS prefix, up AS depth, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM (SELECT n.*, n_children, unnest(range(0, n.depth + 1)) AS up FROM n LEFT JOIN k USING (prefix)) GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (prefix, depth) LEFT JOIN k USING (prefix) LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_toxicity_grammar, op3_language_crf, op4_string_tiling, op5_url_reputation, op6_pii_anchors, op7_jaccard_paths, op8_html_blocks, op9_quality_rules, op10_chat_format, op11_embedding_whitening, op12_karmarkar_karp, op13_prefix_trie)}
ORACLE = {"op1_source_mixing": OP1_SQL, "op5_url_reputation": OP5_SQL, "op13_prefix_trie": OP13_SQL}
