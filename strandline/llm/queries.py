"""The numbered queries over the test tables and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.tokens_bpe import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.shards import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"), 24)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.pfp import removal_digest

    return removal_digest(table(spark, sf_dir, "documents"), 400)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.packing import packed_sequences

    return packed_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.webp import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.spann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.langid import language_model, predicted_languages

    docs = table(spark, sf_dir, "documents")
    found = predicted_languages(docs, language_model(docs))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.toxicity import fitted_model, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, fitted_model(docs, table(spark, sf_dir, "labels")))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.mixing import mixed_sources

    return mixed_sources(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.order_minhash import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


PHRASES_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
 w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
 g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 5) r(k)),
 f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
 c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
 x AS (SELECT c.lang, c.phrase, a, cut, fl.f AS l, fr.f AS r, (2000000::HUGEINT * a // (fl.f + fr.f))::BIGINT AS score FROM c
  JOIN f fl ON fl.lang = c.lang AND fl.phrase = array_to_string(w[1 : cut], ' ') JOIN f fr ON fr.lang = c.lang AND fr.phrase = array_to_string(w[cut + 1 : len(w)], ' ')),
 b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 s AS (SELECT lang, f, string_split(phrase, ' ') AS w, k, unnest(range(2, k)) AS size FROM f WHERE k > 2),
 i AS (SELECT lang, f, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM s),
 m AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY ALL),
 z AS (SELECT b.lang AS lang, b.phrase AS phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
 SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000"""

def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


# The CRC takes a digit's code in, then shifts eight times (the steps marked -1).
TRIE_SQL = """WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
 s AS (SELECT c, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM (SELECT DISTINCT c FROM o)),
 h AS (SELECT c, xor(list_reduce(steps, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 6 AS h FROM s),
 r AS (SELECT h.c AS c, 0 AS own, k, role, text FROM h JOIN o ON o.c = h.c - h.c % 100 AND k <= h UNION ALL SELECT h.c, 1, k, role, text FROM h JOIN o ON o.c = h.c AND k > h),
 q AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY own, k) AS q FROM r GROUP BY c), a AS (SELECT h.c AS c, coalesce(q, []) AS q FROM h LEFT JOIN q ON q.c = h.c),
 p AS (SELECT c, len(q) AS n, q, unnest(range(0, len(q) + 1)) AS d FROM a),
 t AS (SELECT q[1 : d] AS key, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY q[1 : d], d),
 w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(key[d].text) END AS saved FROM t),
 k AS (SELECT key[1 : d - 1] AS key, d - 1 AS d, count(*) AS n_children FROM t WHERE d > 0 GROUP BY ALL),
 v AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN k ON k.d = w.d AND k.key = w.key),
 u AS (SELECT key[1 : up] AS key, up AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM v) GROUP BY ALL)
 SELECT v.conv_id AS conv_id, v.d::BIGINT AS depth, f.conv_id AS parent_conv_id, v.n_convs AS n_convs, v.n_children AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256 AS ends_sha256
 FROM v JOIN u ON u.d = v.d AND u.key = v.key LEFT JOIN t f ON f.d = v.d - 1 AND f.key = v.key[1 : v.d - 1]"""


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_minhash, op4_suffix_dedup, op5_packing, op6_media, op7_neighbours, op8_language_id, op9_mixing, op10_toxicity, op11_prefix_trie, op12_fingerprints, op13_phrases)}
ORACLES: dict[str, str] = {"op11_prefix_trie": TRIE_SQL, "op13_phrases": PHRASES_SQL}
