"""The queries of this subpackage, by registered name, and their SQL where SQL can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import transcode_digest as byte_bpe_digest
from .decontam import benchmark_matches
from .langid import identify_languages
from .minhash import near_duplicate_groups
from .phrases import collocations
from .pii import pseudonymise, surrogate_key
from .quality import score_quality
from .sentencepiece_fst import transcode_digest
from .sharding import shard_digest
from .spelling import spelling_variants
from .spotsigs import fingerprint_documents
from .suffix_dedup import remove_repeats
from .toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcode_digest(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digest(_table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_spotsigs, op4_suffix_dedup, op5_minhash, op6_sentencepiece, op7_pii, op8_decontamination, op9_sharding, op10_quality, op11_byte_bpe, op12_phrases, op13_spelling)}

# All pairs that share a shingle, and the closure of their links: the brute-force form, fine at small scale.
MINHASH_SQL = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM sh), e AS (SELECT doc_id, unnest(s) AS g FROM sh
), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, comp) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.comp FROM reach r JOIN both_ways l ON l.a = r.id)
SELECT n.doc_id, n.n AS n_shingles, min(r.comp) AS component_id, n.doc_id = min(r.comp) AS kept FROM n JOIN reach r ON r.id = n.doc_id GROUP BY n.doc_id, n.n"""

# All phrases counted, every cut and every longer candidate compared.
PHRASES_SQL = """WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)
), f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY 1, 2), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1
), c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), inner_ AS (SELECT lang, a AS b, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))) AS phrase FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < k
), most AS (SELECT lang, phrase, max(b) AS b FROM inner_ GROUP BY 1, 2
), left_ AS MATERIALIZED (SELECT c.* FROM c LEFT JOIN most USING (lang, phrase) WHERE b IS NULL OR 100 * b < 80 * a
), halves AS MATERIALIZED (SELECT *, array_to_string(w[1:h], ' ') AS head, array_to_string(w[h + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS h FROM left_)
), much AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 30
), cuts AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, h, 2000000::HUGEINT * a // (x.f + y.f) AS score FROM halves c
  JOIN much x ON x.lang = c.lang AND x.phrase = c.head JOIN much y ON y.lang = c.lang AND y.phrase = c.tail
), one AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op5_minhash": MINHASH_SQL, "op12_phrases": PHRASES_SQL}
