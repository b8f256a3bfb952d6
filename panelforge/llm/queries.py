"""The registered queries of the operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import ann, chat_format, conversation_repair, html_extract, language_id, license_scan, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_sampling, substring_dedup, vector_codes
from panelforge.llm.common import table
from panelforge.llm.sql import OP11_SQL, OP12_SQL, OP13_SQL
from panelforge.session import ship


#: Fixed value: a text of control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int):
    """crc32 of doc_id written as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    model = tokenizer_file("piece_bpe_32k.model")
    got = sentencepiece_sampling.decode(sentencepiece_sampling.encode(table(spark, sf_dir, "documents"), model), model)
    return got.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scored = quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3) != 1)
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    got = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learned from those that are not held out."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    got = language_id.language_id(docs, language_id.fit(docs.where(remainder(5) != 0)))
    return got.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired; conversations that lost all rows too."""
    ship(spark)
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(conversations), conversations.select("conv_id"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read back from the formatted conversations, and from one whose texts are control strings."""
    ship(spark)
    hard = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{HARD_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    got = chat_format.chat_format(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard))
    got = got.select("conv_id", "formatted", "valid", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors; each row carries the hash of the codebooks."""
    ship(spark)
    codes, book = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_errors(codes)
    return out.select("vec_id", "code", "error", "label_error", F.lit(book.sha256() if book else "").alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_quality_classifier, op3_nearest_neighbours, op4_packing, op5_license_scan,
        op6_substring_dedup, op7_html_extraction, op8_quality_rules, op9_ngram_jaccard_join, op10_language_id,
        op11_conversation_repair, op12_chat_formatting, op13_vector_codes,
    )
}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Substring dedup: a window key is its 50 words; least document by key; words under later windows go.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, p, list_slice(w, p + 1, p + 50) AS k
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS p FROM d)
),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM late)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS q FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.q) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.q = gone.q WHERE gone.q IS NULL GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_RULES = " AND ".join(
    f"({ratio}) {sign} {limit}" for _, ratio, least, most in quality_rules.RULES for sign, limit in ((">=", least), ("<=", most)) if limit is not None
)

#: Quality rules: counts by unnested words and windows, then the rule table.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, list_slice(w, p + 1, p + 3) AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 0))) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM again) GROUP BY 1),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_shouts,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g') <> '')) AS n_lines,
    CAST(n_lines - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g') <> ''))) AS BIGINT) AS n_dup_lines,
    len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop_words,
    len(list_filter(list_zip(w[:-2], w[2:]), lambda x: x[1] = x[2])) AS n_doubled,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {_RULES} END AS kept
FROM b
"""

_TEMPLATES = ", ".join(
    f"({i}, '{label}', {str(i < len(license_scan.PHRASES)).lower()}, '{text}')" for i, (text, label) in enumerate([*license_scan.PHRASES, *license_scan.TEMPLATES])
)

#: License scan: word triples of texts and templates, votes by diagonal, runs of near diagonals, spans that hold.
OP5_SQL = f"""
WITH t AS (SELECT tid, label, is_base, string_split(t, ' ') AS w FROM (VALUES {_TEMPLATES}) v(tid, label, is_base, t)),
tg AS (SELECT tid, label, is_base, len(w) - 2 AS t_grams, p AS t_at, list_slice(w, p + 1, p + 3) AS g FROM (SELECT *, unnest(range(0, len(w) - 2)) AS p FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT rid, p, list_slice(w, p + 1, p + 3) AS g FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 2, 0))) AS p FROM d)),
votes AS (SELECT rid, tid, label, is_base, t_grams, p - t_at AS diagonal, list(t_at) AS held FROM dg JOIN tg ON dg.g = tg.g GROUP BY ALL),
strong AS (SELECT * FROM votes WHERE CASE WHEN is_base THEN len(held) = t_grams ELSE len(held) >= 2 END),
runs AS (
  SELECT *, sum(new) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS run
  FROM (SELECT *, CASE WHEN is_base OR diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) <= 4 THEN CAST(is_base AS INT) ELSE 1 END AS new FROM strong)
),
spans AS (
  SELECT rid, label, is_base, t_grams, len(list_distinct(flatten(list(held)))) / t_grams AS cover, min(diagonal + list_min(held)) AS start, max(diagonal + list_max(held) + 3) AS stop
  FROM runs GROUP BY rid, tid, label, is_base, t_grams, run
),
found AS (
  SELECT rid, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (is_base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(cover) AS score
  FROM spans WHERE is_base OR (cover >= 0.6 AND stop - start <= 1.25 * (t_grams + 2)) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found ON d.rid = found.rid
"""

#: N-gram join: classes of equal sets, exact intersections through shared shingles, components by walking the links.
OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda p: list_slice(w, p, p + 2)))) END AS sh FROM d
),
class AS (SELECT sh, len(sh) AS n, min(doc_id) AS rep FROM s WHERE len(sh) > 0 AND doc_id IS NOT NULL GROUP BY sh),
one AS (SELECT rep, n, unnest(sh) AS g FROM class),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM one a JOIN one b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT rep AS id, rep AS least FROM class UNION SELECT l.b, w.least FROM walk w JOIN links l ON l.a = w.id WHERE w.least < l.b),
found AS (SELECT id, min(least) AS component FROM walk GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(found.component, s.doc_id) AS component_id
FROM s LEFT JOIN class ON s.sh = class.sh LEFT JOIN found ON found.id = class.rep
"""

ORACLE_SQL: dict[str, str] = {
    "op5_license_scan": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_ngram_jaccard_join": OP9_SQL,
    "op11_conversation_repair": OP11_SQL, "op12_chat_formatting": OP12_SQL, "op13_vector_codes": OP13_SQL,
}
