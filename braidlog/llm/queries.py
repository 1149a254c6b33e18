"""One thin query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where vocabulary files are looked up when no path is given.
RANKS_FILE, TOKENIZER_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from braidlog.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path(RANKS_FILE))
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import ngram_join

    return ngram_join.components(table(spark, sf_dir, "documents"), 3, (90, 100))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import license as licences

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.train(licences.sample_lines(docs)))
    return found.select("doc_id", F.array_join("license_families", ",").alias("license_families"), "license_paragraphs", "license_unknown")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.session_key(spark), count_col="n_replaced")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import shard

    return shard.shard(table(spark, sf_dir, "documents"), 40)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import quality

    judged = quality.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = {"n_words": "q_n_words", "word_chars": "q_chars", "n_symbols": "q_symbols", "n_dup_lines": "q_dup_lines", "n_repeat_words": "q_repeat_words"}
    return judged.select(
        "doc_id",
        *[F.col(c).cast("long").alias(n) for n, c in names.items()],
        F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
        F.col("q_left").cast("long").alias("n_kept_words"),
    )


def op7_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from braidlog.llm import packing

    with open(public_tokenizers.path(TOKENIZER_FILE), encoding="utf-8") as source:
        return packing.pack(table(spark, sf_dir, "documents"), source.read())


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import substrings

    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import cdc

    return cdc.dedup(table(spark, sf_dir, "documents"))


#: Links of three-word shingle sets at a Jaccard similarity of 0.9, and what each document reaches through them.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""
#: Base counts, and the line rules with their fixed thresholds.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) > 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 4)) AS c FROM g),
v AS (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS more FROM k WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(more) AS BIGINT) AS n FROM v GROUP BY 1),
l AS (SELECT doc_id, unnest(list_distinct(ls)) AS l FROM w),
m AS (SELECT doc_id, l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n, length(l) - length(replace(l, '|', '')) AS bars, length(l) - length(replace(l, '!!', '!')) AS shouts, len(regexp_extract_all(l, '[#*$%&<>]')) AS symbols FROM l),
q AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS kept FROM m WHERE NOT ((bars >= 3 AND 100 * bars >= 20 * n) OR 100 * symbols >= 30 * n OR (shouts > 0 AND 100 * shouts >= 30 * n)
  OR (n <= 20 AND regexp_matches(l, '(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|click here|read more|log ?in|sign (in|up)|subscribe|lorem ipsum|skip to content|share this|back to top)\b'))) GROUP BY 1),
o AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(q.kept, 0) AS n_kept_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_kept_words >= 50 * n_words AS kept FROM o
"""
#: Equal payloads of at least 100 bytes revisit the smallest page.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""

#: Equal texts of the exact deduplication, kept rows by code points and id.
OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM n WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ngram_join": op2_ngram_join,
    "op3_license": op3_license,
    "op4_pii": op4_pii,
    "op5_shard": op5_shard,
    "op6_quality": op6_quality,
    "op7_nnls": op7_nnls,
    "op8_suffix": op8_suffix,
    "op9_warc": op9_warc,
    "op10_cdc": op10_cdc,
}
ORACLES: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op6_quality": OP6_SQL, "op9_warc": OP9_SQL, "op10_cdc": OP10_SQL}
