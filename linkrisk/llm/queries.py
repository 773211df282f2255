"""The queries of this subpackage over the shared test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of benchmark items in whole texts; null has no words, empty tables give no rows."""
    from .decontamination import mark_contaminated

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contaminated(docs, _read(spark, sf_dir, "benchmark"), window=10, carry=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of whole texts (null: empty) under a model of the rows that are not held out."""
    from .language_model import score, split, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = split(F.col("doc_id")) == 0
    model = train(docs.where(~out))
    return score(docs, model, carry=["doc_id"]).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by windows of 20 that start earlier as well, judged on the input; null has none."""
    from .substring_dedup import without_repeats

    kept = without_repeats(_read(spark, sf_dir, "documents"), k=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts (null: empty); of each the row with the largest id stays."""
    from .exact_dedup import exact_groups

    return exact_groups(_read(spark, sf_dir, "documents"), keep="largest")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit fingerprints of 4-word shingles and the components of links at 4 bits or fewer; no words: fingerprint zero."""
    from .simhash import STRICT, near_groups

    groups = near_groups(_read(spark, sf_dir, "documents"), STRICT)
    # hex() of a long is its two's complement without leading zeros
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of whole texts (null: empty) in ascending id order, read back from the files."""
    from .token_store import new_store, read_tokens, write_tokens

    path = new_store(spark)
    write_tokens(_read(spark, sf_dir, "documents"), path, end_id=2)
    return read_tokens(spark, path, ids=False)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; null and empty texts have size 0 and take nothing."""
    from .mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole texts (null: empty) by a machine that learned from labelled rows that are not held out."""
    from .toxicity import labelled, remainder, score, train

    docs = _read(spark, sf_dir, "documents")
    out = remainder(F.col("doc_id"), 5) == 0
    machine = train(labelled(docs, _read(spark, sf_dir, "labels")).where(~out))
    return score(docs.select("doc_id", "text"), machine, carry=["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten sources or more share; null has no lines."""
    from .line_dedup import without_boilerplate

    kept = without_boilerplate(_read(spark, sf_dir, "documents"), sites=10)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and certainty of whole texts; null and texts without a letter are und with score 0."""
    from .language_id import identify, train
    from .toxicity import remainder

    docs = _read(spark, sf_dir, "documents")
    out = remainder(F.col("doc_id"), 4) == 2
    trees = train(docs.where(~out))
    return identify(docs.select("doc_id", "text"), trees, carry=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of whole texts under two tokenizers, and what the corpus counts for each link's pair."""
    from .alignment import align_tokenizers

    return align_tokenizers(_read(spark, sf_dir, "documents"))[0]


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole texts (null: empty) in sequences of at most 1024 tokens, read from the sequences."""
    from .packing import pack_documents, packed_pieces

    return packed_pieces(pack_documents(_read(spark, sf_dir, "documents"), capacity=1024, end_id=0))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of whole texts towards the benchmark's words, and the tenth of the documents that is drawn."""
    from .resampling import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), share=0.1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_token_store": op7_token_store,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_packing": op12_packing,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op9_line_dedup": r"""
        WITH parts AS (
          SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents
        ), lines AS (
          SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts
        ), spread AS (
          SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> ''
          GROUP BY trim(line, ' ') HAVING count(DISTINCT coalesce('=' || source, '')) >= 10
        ), marked AS (
          SELECT doc_id, l.line, pos, s.line IS NOT NULL AS gone FROM lines l LEFT JOIN spread s ON s.line = trim(l.line, ' ')
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    # CRC-32: bytes one by one through the table of the reflected polynomial, which is made here too
    "op13_resampling": r"""
        WITH RECURSIVE steps AS (
          SELECT i AS b, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
          UNION ALL
          SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
        ), crc AS (
          SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8
        ), words AS (
          SELECT 's' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
          UNION ALL
          SELECT 't', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
        ), counted AS (
          SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL
        ), coded AS (
          SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INTEGER, 2))::BIGINT)),
                 lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
          FROM (SELECT DISTINCT word FROM words), crc
        ), bars AS (
          SELECT bucket, sum(CASE WHEN side = 's' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END)::DOUBLE AS t
          FROM counted JOIN coded USING (word) GROUP BY bucket
        ), totals AS (
          SELECT sum(s) AS s_all, sum(t) AS t_all FROM bars
        ), gain AS (
          SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM bars, totals
        ), weighed AS (
          SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
          FROM counted JOIN coded USING (word) JOIN gain USING (bucket) WHERE side = 's' GROUP BY doc_id
        ), scored AS (
          SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
          FROM documents d LEFT JOIN weighed w ON w.doc_id = d.doc_id
        ), ranked AS (
          SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, floor(10 * count(*) OVER () / 100) AS wanted FROM scored WHERE n_features >= 20
        )
        SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank
        FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id""",
}
