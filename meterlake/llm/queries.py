"""Queries of the numbered operators, with SQL where SQL can say the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import chat, decontam, langid, mining, mixing, packing, pii, quality, simhash, spelling, substring, toxicity, warc
from meterlake.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_TEXT: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.learned(docs.where(fold("doc_id", 4) != 2))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


@_query
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    same = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {same}), (-7L, 1L, 'assistant', {same}) AS t(conv_id, turn, role, text)")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_chats(turns).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("trained", chat.trained_text(F.col("segments")))
    spoken = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    n = lambda c: c.cast("bigint")
    return out.select(
        "conv_id",
        n(F.size("back")).alias("n_turns"),
        digest(spoken).alias("turns_sha256"),
        n(F.length("trained")).alias("loss_chars"),
        digest(F.col("trained")).alias("loss_sha256"),
        n(F.length("formatted")).alias("formatted_chars"),
    )


SQL_TEXT["op2_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z_]{1,32}\|>|/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g')) AS text_chars,
    length(regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z_]{1,32}\|>|/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before = role THEN 8 ELSE 8 + role_chars + 8 + 8 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


@_query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query
def op4_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring.passages(table(spark, folder, "documents"))


@_query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"))


@_query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.classes(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    out = warc.deduplicated(table(spark, folder, "pages"))
    return out.select(
        number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to")
    )


SQL_TEXT["op7_warc"] = """
WITH sums AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), named AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM sums
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM named
"""


@_query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learned(docs, table(spark, folder, "labels").where(fold("doc_id", 3) != 1))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def _spelled(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


@_query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = pii.find(docs, pii.learned(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(F.encode(_spelled("base"), "UTF-8"), 256).alias("base_sha256"), _spelled("spans").alias("spans"))


@_query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@_query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@_query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = mining.prepared(table(spark, folder, "embeddings"), label)
    return mining.hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL_TEXT["op12_hard_negatives"] = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND b.vec_id != a.vec_id
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE label != anchor_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""


@_query
def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# Marks in full order in place of histograms; sources are compared in whole numbers.
SQL_TEXT["op13_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS mark
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT a.source, a.source_size, a.weight,
    (SELECT sum(least(3::HUGEINT * a.source_size * b.weight, 3::HUGEINT * b.source_size * a.weight)) FROM sources b)
      < a.weight::HUGEINT * (SELECT sum(source_size) FROM sources) AS filled
  FROM sources a
), rest AS (
  SELECT CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (filled), 0) AS DOUBLE) AS words,
    CAST(coalesce(sum(weight) FILTER (NOT filled), 1) AS DOUBLE) AS among FROM levels
), goals AS (
  SELECT source, source_size, CASE WHEN filled THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight AS DOUBLE) * words / among END AS target
  FROM levels, rest
), budgets AS (
  SELECT *, CAST(floor(target / source_size) AS BIGINT) AS copies, target - CAST(floor(target / source_size) AS BIGINT) * source_size AS left_over
  FROM goals WHERE source_size > 0
), marks AS (
  SELECT source, mark, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY mark) AS upto FROM sized GROUP BY source, mark
), cuts AS (
  SELECT b.source, copies, CASE WHEN upto - left_over < left_over - (upto - n) THEN mark ELSE mark - 1 END AS cut
  FROM budgets b JOIN marks m ON b.source IS NOT DISTINCT FROM m.source WHERE upto > left_over AND upto - n <= left_over
)
SELECT doc_id, size, source_size, target, CAST(size * least(3, coalesce(copies + CASE WHEN mark <= cut THEN 1 ELSE 0 END, 0)) AS BIGINT) AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""


@_query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


# What an SQL engine without user functions can say of the words and windows of a text.
SQL_TEXT["op5_quality_rules"] = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts
), windows AS (
  SELECT r, i, list_aggregate(words[i:i + 4], 'string_agg', chr(1)) AS g
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 4)) AS i FROM split)
), twice AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, sum(least(5, coalesce(lead_i - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS lead_i FROM twice) GROUP BY r
), base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(words, lambda w: regexp_full_match(lower(w), '(?:STOP)[.,;:!?]*'))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM split LEFT JOIN covered USING (r)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.02
  AND n_dup_lines / n_lines <= 0.3 AND n_repeat_words / n_words <= 0.2 AND n_bullet_lines / n_lines <= 0.9 AND n_ellipsis_lines / n_lines <= 0.3 AS kept
FROM judged
""".replace("STOP", "|".join(quality.STOP_WORDS))
