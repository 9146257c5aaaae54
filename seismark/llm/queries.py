"""The corpus operators over their whole tables, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm.chat_format import format_conversations, read_back
from seismark.llm.decontaminate import contamination, report
from seismark.llm.exact_dedup import exact_dedup
from seismark.llm.ngram_join import ngram_join
from seismark.llm.periodic_runs import periodic_runs
from seismark.llm.pii_surrogates import with_surrogates
from seismark.llm.quality_nbsvm import quality_scores
from seismark.llm.secret_scan import scan
from seismark.llm.sentencepiece_lattice import encode
from seismark.llm.shared import table
from seismark.llm.source_divergence import source_divergence
from seismark.llm.token_counts import token_counts
from seismark.llm.toxicity import toxicity_scores
from seismark.llm.vector_search import top_k


def model_path() -> str:
    """The SentencePiece model of the queries; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), "a key of the owner")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), model_path())


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(hard)))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it (U+2581 is a space to the model)."""
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), check_col="round_trip")
    return docs.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of ids whose crc32 ends in 0, the words from a place on are a few of them over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("transform(sequence(a, n - 1), i -> w[cast(a + (i - a) % p as int)])")
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    d = found.select("doc_id", "runs", "collapsed", best.alias("best")).withColumn("length", -F.col("best.l"))
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "length", "best.period", F.expr("1000 * length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality_nbsvm": op2_quality_nbsvm,
        "op3_pii_surrogates": op3_pii_surrogates,
        "op4_token_counts": op4_token_counts,
        "op5_ngram_join": op5_ngram_join,
        "op6_toxicity": op6_toxicity,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_chat_format": op8_chat_format,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_decontamination": op10_decontamination,
        "op11_source_divergence": op11_source_divergence,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_exact_top_k": op13_exact_top_k,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": OP5, "op7_exact_dedup": OP7, "op8_chat_format": OP8, "op10_decontamination": OP10, "op11_source_divergence": OP11, "op13_exact_top_k": OP13}


OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, (len(w) - least(4, len(w)) + 2)::BIGINT), lambda i: array_to_string(w[i:i + least(4, len(w)) - 1], ' '))) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = w.doc_id GROUP BY ALL
"""

OP7 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""

#: formatted_chars: 24 characters of marks a turn, and one for each control string inside a text.
OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, len(regexp_extract_all(text, '<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>')) AS escapes FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + len(role) + len(text) + escapes)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: translate() lower-cases A-Z alone.
OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, (len(w) - least(10, len(w)) + 2)::BIGINT), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i, w FROM d, ks WHERE len(w) >= k
), hits AS (
  SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND array_to_string(w[i:i + dw.k - 1], ' ') = g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: 1e9 * (count + 5) needs more than 64 bits only beyond 9e9 occurrences; hugeint all the same.
OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT id, lang, source, unnest(w) AS term FROM d), kept AS (
  SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30
), n AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang), g AS (
  SELECT lang, source, coalesce(sum(n.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (total + 5 * v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(t) + 5 * any_value(v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS t FROM g GROUP BY lang) USING (lang) GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pair UNION ALL FROM term)
)
FROM r WHERE part = 'pair' OR rank <= 50
"""

OP13 = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""
