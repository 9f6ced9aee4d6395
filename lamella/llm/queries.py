"""Queries of the subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, mixing, neighbours, pii, quality, simhash, substrings
from .common import load


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT rid, i, p.n, item_id FROM p JOIN bw ON bw.n = p.n AND bw.s = array_to_string(w[i:i + p.n - 1], ' ')),
x AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
y AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS k FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN x USING (rid) LEFT JOIN y USING (rid)
"""


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of those that share passages with it, and its number of links."""
    docs = load(spark, sf_dir, "documents")
    return substrings.classes(docs, substrings.passages(docs))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user'), (-1L, 1L, 'assistant') AS t(conv_id, turn, role)")
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.conversations(chat.chain(rows.union(more.withColumn("text", F.lit(said))))))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS er, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(20 + length(er) + length(et))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _op8_sql() -> str:
    """Phrases by their places; templates by the share of their words in windows, each word standing in two."""
    literal = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(
        f"({i}, '{label}', {len(licenses.template_words(text))}, {literal(licenses.template_tokens(text))})" for i, (label, text) in enumerate(licenses.TEMPLATES)
    )
    places = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS place, '{label}' AS label FROM p WHERE "
        + " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(" ")))
        for phrase, label in licenses.PHRASES
    )
    firsts = ", ".join(f"'{phrase.split(' ')[0]}'" for phrase, _ in licenses.PHRASES)
    return f"""
WITH t(no, label, m, tokens) AS (VALUES {templates}),
k AS (SELECT no, label, m, len(tokens) AS most, unnest(tokens) AS word FROM t),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
p AS (SELECT rid, w, i FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN ({firsts})),
b AS ({places}),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS named FROM b GROUP BY rid),
v AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
n AS (SELECT rid, no, label, most, word, unnest([i // m, i // m - 1]) AS block FROM v JOIN k USING (word)),
m AS (SELECT rid, label, count(DISTINCT word) AS common, most FROM n WHERE block >= 0 GROUP BY rid, no, label, most, block),
met AS (SELECT rid, list(DISTINCT label) AS found, max(common / most) AS best FROM m
        WHERE common >= greatest(1, ceil({licenses.THRESHOLD} * most - 1e-9)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(named), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(named, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN met USING (rid)
"""


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    """One sort of each source by its keys, where the operator has two levels of sums."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    return f"""
WITH s AS (SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT rid, doc_id, source, size, -ln((('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE)
  / CASE WHEN length(text) BETWEEN 4 * size AND 12 * size THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS key FROM s),
a AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {cases} END AS weight FROM k GROUP BY source),
c AS (SELECT *, {mixing.CAP} * source_size AS cap, {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM a),
e AS (SELECT *, coalesce(sum(cap) OVER soon, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER soon, 0) AS free FROM c
  WINDOW soon AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * free <= weight * (total - caps) AS capped FROM e),
g AS (SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0) AS spent, sum(weight) FILTER (NOT capped) OVER () AS open FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (total - spent::DOUBLE) / open::DOUBLE END AS target FROM g),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
v AS (SELECT *, target - epochs * source_size AS rest FROM u),
n AS (SELECT greatest(1, least({mixing.MOST_BUCKETS}, ceil(count(*) / {mixing.BUCKET_ROWS})))::BIGINT AS buckets FROM k),
r AS (SELECT k.*, source_size, target, epochs, rest, floor(buckets * key / (1 + key)) AS bucket,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size) AS upto,
  sum(size) OVER (PARTITION BY k.source, key, doc_id, size) AS together
  FROM k JOIN v ON k.source IS NOT DISTINCT FROM v.source CROSS JOIN n),
h AS (SELECT source AS hs, min(bucket) AS edge FROM r WHERE upto > rest GROUP BY source),
i AS (SELECT r.*, edge, rest - coalesce(max(upto) FILTER (upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM r LEFT JOIN h ON source IS NOT DISTINCT FROM hs),
j AS (SELECT source AS js, arg_min((key, doc_id, size), (abs(together - gap), key, coalesce(doc_id, -9223372036854775808), size)) AS more FROM i
  WHERE bucket = edge AND upto > rest AND together > 0 AND abs(together - gap) < gap GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN edge IS NOT NULL AND (upto <= rest OR (key, doc_id, size) IS NOT DISTINCT FROM more) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM i LEFT JOIN j ON source IS NOT DISTINCT FROM js
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_substrings, op3_simhash, op4_quality, op5_neighbours, op6_pii, op7_chat, op8_licenses, op9_mix, op10_langid, pipeline)}


def oracle_sql() -> dict[str, str]:
    """op2 to op6, op10 and the pipeline hash, train or search approximately, so SQL has no twin of them; tests hold them by brute force."""
    return {"op1_decontaminate": OP1_SQL, "op7_chat": OP7_SQL, "op8_licenses": _op8_sql(), "op9_mix": _op9_sql()}
