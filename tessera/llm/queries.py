"""The llm operators as named queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, fingerprints, html_extract, jaccard_join, language_id, mixing, packing, token_counts, toxicity, warc
from tessera.llm.shared import fold_of, materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older snapshot: rows whose crc32(doc_id as text) is even; the rest is the incoming batch."""
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), fold_of(2) == 0)
    return found.withColumnRenamed("digest", "text_sha256")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


#: Brute force: all pairs of rows that share a shingle, with the numbers they share; components by reachability.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS items FROM w),
n AS (SELECT r, doc_id, len(items) AS n FROM s),
e AS (SELECT r, unnest(items) AS item FROM s),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM e a JOIN e b ON a.item = b.item AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, u.b FROM c JOIN u ON u.a = c.b)
SELECT n.doc_id, n.n AS n_shingles, g.component_id, coalesce(k.n, 0) AS n_links
FROM n JOIN (SELECT c.a, min(o.doc_id) AS component_id FROM c JOIN n o ON o.r = c.b GROUP BY c.a) g ON g.a = n.r LEFT JOIN (SELECT a, count(*) AS n FROM u GROUP BY a) k ON k.a = n.r
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    pages = table(spark, sf_dir, "pages")
    archives = materialize(warc.write_archives(warc.plan_records(pages, "page_id", "url", "html", 0)), "archives")
    read = warc.read_archives(archives)
    return read.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: base32 by way of the digest's bits, five at a time.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(string_split(sha1(html), ''), lambda c:
    substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', c) - 1) * 4 + 1, 4)), '') AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(16 * CAST(bits[i + 1] AS INT) + 8 * CAST(bits[i + 2] AS INT) + 4 * CAST(bits[i + 3] AS INT) + 2 * CAST(bits[i + 4] AS INT) + CAST(bits[i + 5] AS INT) AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (fold_of(5) == 0).alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold_of(4) != 2)
    return language_id.predict(docs, model).select("doc_id", (fold_of(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.trained())


#: No source is repeated more than so many times as often as the one that is repeated least.
MAX_REPEATS = 1.5


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MAX_REPEATS)
    return mixed.select("doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.round("mix_weight", 9).alias("weight"))


#: The exponent in closed form; blocks, permutations and cuts as the operator defines them.
OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(1 + length(text) - length(replace(text, ' ', '')) + length(text) - length(replace(text, chr(10), '')), 0) AS n,
         ('0x' || substr(md5(concat_ws(':', '1', doc_id)), 1, 8))::BIGINT % blocks AS block, blocks,
         ('0x' || substr(md5(concat_ws(':', '1', doc_id)), 9, 12))::BIGINT AS v
  FROM documents, (SELECT greatest({mixing.BLOCKS}, (count(*) + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS}) AS blocks FROM documents) z),
s AS (SELECT source, sum(n)::DOUBLE AS n FROM d GROUP BY source),
e AS (SELECT CASE WHEN max(n) <= {MAX_REPEATS} * min(n) THEN 0 ELSE 1 - ln({MAX_REPEATS}) / ln(max(n) / min(n)) END AS e FROM s),
w AS (SELECT source, n, n ** e / sum(n ** e) OVER () AS weight FROM s, e),
r AS (SELECT source, n, weight, max(n / weight) OVER () * weight / n + 1e-9 AS epochs FROM w),
p AS (SELECT source, weight, floor(epochs)::BIGINT AS epochs, (epochs - floor(epochs)) * n AS wanted FROM r),
b AS (
  SELECT d.source, d.block, sum(d.n) AS n, any_value(p.wanted) AS wanted,
         ('0x' || substr(md5(concat_ws(':', '1', d.source, d.block, any_value(p.epochs))), 1, 8))::BIGINT * any_value(d.blocks) + d.block AS spot
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY d.source, d.block),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY spot) AS run FROM b),
k AS (SELECT *, run <= wanted AS fits, run > wanted AND run - n <= wanted AS edge, wanted - run + n AS spare FROM c),
x AS (
  SELECT d.*, p.weight, p.epochs, k.fits, k.edge, k.spare,
         sum(CASE WHEN k.edge THEN d.n ELSE 0 END) OVER (PARTITION BY d.source, d.block ORDER BY d.v) AS run
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.block = k.block)
SELECT doc_id, source, unnest(range(epochs + CASE WHEN fits OR (edge AND run <= spare) THEN 1 ELSE 0 END)) AS epoch, block, round(weight, 9) AS weight FROM x
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_toxicity": op3_toxicity,
        "op4_warc": op4_warc,
        "op5_document_fingerprints": op5_document_fingerprints,
        "op6_html_extraction": op6_html_extraction,
        "op7_language_id": op7_language_id,
        "op8_mixing": op8_mixing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op4_warc": OP4_SQL, "op8_mixing": OP8_SQL, "op9_exact_dedup": OP9_SQL}
