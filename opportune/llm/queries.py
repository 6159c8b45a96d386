"""The registered queries of this subpackage: thin digests of each operator's output, with SQL where SQL can express one."""

from __future__ import annotations

import os
import secrets
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, decontaminate, divergence, langid, licenses, packing, pii, simhash, token_counts, toxicity, warc


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; OPPORTUNE_TOKENIZERS names another folder."""
    if folder := os.environ.get("OPPORTUNE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of their decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, tokenizer_file("word_bpe_49k.json"), decoded_col="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, packed in matrices."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that copy benchmark items, with the items and alignment scores."""
    docs, items = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    return decontaminate.leaks(docs.select("doc_id", "text"), items.select("item_id", "text")).select("doc_id", "item_id", "score", "first_word", "last_word")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 4096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = token_counts.token_counts(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0", k=20)


def op3_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-duplicates of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def toxicity_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    """The lexicon learned from labels that aren't held out."""
    return toxicity.learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a lexicon learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_lexicon(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    score = F.col("toxicity.score")
    return out.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.col("toxicity.matches").alias("matches"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


_own_key: list[bytes] = []


def pii_key() -> bytes:
    """The surrogates' key, from OPPORTUNE_PII_KEY; where it is unset, one drawn for this process, with a warning: nobody can invert
    its surrogates, and those of two processes don't match."""
    if key := os.environ.get("OPPORTUNE_PII_KEY"):
        return key.encode()
    if not _own_key:
        warnings.warn("OPPORTUNE_PII_KEY is unset: surrogates of this process won't match those of another", stacklevel=2)
        _own_key.append(secrets.token_bytes(32))
    return _own_key[0]


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and what was replaced."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key())
    return out.select("doc_id", "pii.text", F.size("pii.entities").alias("n_entities"), "pii.entities")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held_out))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back through their index."""
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    out = warc.read_records(index, folder, with_payload=False)
    return out.select(F.col("row_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and error of every vector, and the codebooks' digest."""
    out, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).cast("string").alias("codebooks_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each two sources of a language, and each source's typical terms."""
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


#: Exact search: what op2_nearest_vectors finds on tables small enough for all lists to be probed.
NEAREST_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
usual AS (SELECT len(x) AS n FROM ok GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 1), u AS (SELECT * FROM ok WHERE len(x) = (SELECT n FROM usual)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
             , q.x FROM u q JOIN u c ON NOT (c.vec_id = q.vec_id AND c.x = q.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""


#: Records' types from the pages themselves.
WARC_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
o AS (SELECT *, row_number() OVER w AS k, first(page_id) OVER w AS first FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= {warc.LEAST_REVISIT} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= {warc.LEAST_REVISIT} THEN first END AS refers_to FROM o"""


def _assigned(n: int) -> str:
    """SQL: every part's nearest entry of the n-th codebooks."""
    return f"""a{n} AS MATERIALIZED (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT rid, x.p, e, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS d FROM x JOIN b{n} b ON b.p = x.p AND b.j = x.j GROUP BY rid, x.p, e) GROUP BY rid, p)"""


def _averaged(n: int) -> str:
    """SQL: the codebooks that follow from the n-th assignment."""
    return f"""b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN (
  SELECT x.p, a.e, x.j, floor(sum(x.c)::DOUBLE / count(*))::BIGINT AS c FROM x JOIN a{n} a ON a.rid = x.rid AND a.p = x.p GROUP BY ALL) m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"""


#: The same codebooks and codes from all distances.
CODES_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
flat AS (SELECT rid, len(v) // {codes.PARTS} AS w, unnest(v) AS c, generate_subscripts(v, 1) - 1 AS k FROM v),
x AS MATERIALIZED (SELECT rid, k // w AS p, k % w AS j, floor({codes.SCALE} * c)::BIGINT AS c FROM flat),
b0 AS (SELECT p, rid AS e, j, c FROM x WHERE rid < {codes.ENTRIES}),
{_assigned(0)}, {_averaged(0)}, {_assigned(1)}, {_averaged(1)}, {_assigned(2)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM b2) AS codebooks_sha256
FROM v JOIN coded USING (rid)"""


#: The same from every group's share of every kept term.
DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
every AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + ({divergence.UNIT}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM every JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + ({divergence.UNIT}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= {divergence.TOP}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_bpe_round_trip, op2_nearest_vectors, op3_simhash_duplicates, op4_packed_ids, op5_decontamination, op6_token_counts, op7_toxicity, op8_license_scan, op9_pii_surrogates, op10_language, op11_warc_index, op12_vector_codes, op13_source_divergence)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest_vectors": NEAREST_SQL, "op8_license_scan": licenses.duckdb_sql(), "op11_warc_index": WARC_SQL, "op12_vector_codes": CODES_SQL, "op13_source_divergence": DIVERGENCE_SQL}
