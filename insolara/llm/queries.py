"""Registered queries of this subpackage and, where SQL can state the result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.llm import (
    bpe, conversation_trie, cross_polytope, exact_dedup, fingerprints, html_wrapper, ids_output, language_id, lm_score, mixing,
    secret_scan, simhash_dedup, token_align,
)
from insolara.llm.common import prepare, table
from insolara.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            prepare(spark)
            return build(spark, sf_dir)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op8_exact_dedup", """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, one row per document."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 4-word shingles and the component of each document at 4 bits or fewer."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text by the ranks of a public vocabulary and the bytes they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)


@query("op4_token_id_output")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read back from the files written."""
    folder = scratch_path(spark, "token-ids")
    files = ids_output.write_ids(table(spark, sf_dir, "documents"), folder,
                                 public_tokenizers.path("byte_bpe_50k.json"))
    back = ids_output.read_ids(files, folder)
    return back.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


@query("op2_source_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of all sources takes."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by nearest centroids learned outside the held-out quarter."""
    return language_id.languages(table(spark, sf_dir, "documents"))


@query("op7_document_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of each text and of its edited text, and their likeness."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page by the wrapper of its host."""
    return html_wrapper.main_texts(table(spark, sf_dir, "pages"))


@query("op10_secret_scans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the texts with their word number and probability."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of each document."""
    return lm_score.pseudo_likelihood(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two public vocabularies, per document."""
    return token_align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_conversation_trie", """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM t
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN c2 % 2 = 1 THEN xor(c2 >> 1, CAST(3988292384 AS BIGINT)) ELSE c2 >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(s[CAST(k // 8 + 1 AS INT)]) AS BIGINT)) ELSE c END AS c2
        FROM bits WHERE k < 8 * length(s))),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h FROM bits WHERE k = 8 * length(s)),
r AS (
  SELECT c.conv_id, 1 AS part, t.pos, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 2, t.pos, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
q AS (
  SELECT c.conv_id, coalesce(list({'k': sha256(concat(octet_length(encode(r.role)), ':', r.role, r.text)),
                                   'b': octet_length(encode(r.text))} ORDER BY r.part, r.pos) FILTER (r.part IS NOT NULL), []) AS turns
  FROM convs c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM q),
n AS (
  SELECT turns[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends_sha256
  FROM m GROUP BY 1, 2),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * n.path[depth].b END AS saved
  FROM n LEFT JOIN kids ON kids.path = n.path),
up AS (
  SELECT path[1:a] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM own) GROUP BY 1)
SELECT own.conv_id, own.depth, p.conv_id AS parent_conv_id, own.n_convs, own.n_children, up.n_leaves,
       CAST(up.saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN up ON up.path = own.path LEFT JOIN n p ON own.depth > 0 AND p.path = own.path[1:own.depth - 1]""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth one."""
    return cross_polytope.neighbours(table(spark, sf_dir, "embeddings"))
