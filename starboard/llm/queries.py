"""The operators applied to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.llm import chat
from starboard.llm.collocations import collocations
from starboard.llm.embedding_dedup import near_vectors
from starboard.llm.exact_dedup import exact_dedup
from starboard.llm.fingerprints import as_text, containment, fingerprint_edited, resemblance
from starboard.llm.importance import importance_sample
from starboard.llm.language import identify_languages
from starboard.llm.line_dedup import MIN_SITES, remove_shared_lines
from starboard.llm.mixing import mix_sources
from starboard.llm.packing import pack_documents
from starboard.llm.simhash import simhash_components
from starboard.llm.token_counts import count_tokens
from starboard.llm.whitening import by_component, whiten


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, the same on all machines that have the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", "language.held_out", "language.lang_pred", "language.score")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edited(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("own"), F.col("edited_sketch")).alias("contained_in_edited"),
        containment(F.col("own"), F.col("next_sketch")).alias("contained_in_next"),
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, tokenizer_file("piece_bpe_32k.model"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    found = chat.format_trees(chat.linear_tree(rows.unionByName(planted)))
    found = found.withColumn("turns", chat.read_back(F.col("formatted")))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    spans = F.transform(
        "loss_spans",
        lambda s: chat.unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    found = found.withColumn("loss", F.array_join(spans, ""))
    return found.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that begin alike as one tree; of each tree the three most travelled branches."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = chat.format_trees(chat.shared_tree(rows), branches=3)
    return found.select(
        "tree", "rank", "n_turns", F.sha2("formatted", 256).alias("formatted_sha256"), F.size("loss_spans").alias("n_replies")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared_lines(documents(spark, sf_dir))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As large a sample as the labels say there is text of good quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    share = labels.agg(F.avg("quality")).first()[0]
    targets = labels.where("quality = 1").select("doc_id")
    return importance_sample(documents(spark, sf_dir), targets, sample_share=0.5 if share is None else share)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(embeddings(spark, sf_dir)))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir)).drop("recall")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_language_id,
        op3_document_fingerprints,
        op4_simhash_near_dedup,
        op5_best_fit_packing,
        op6_exact_dedup,
        op7_token_counts,
        op8_chat_formatting,
        reply_trees,
        op9_line_dedup,
        op10_importance_resampling,
        op11_embedding_whitening,
        op12_embedding_near_dedup,
        op13_phrase_collocations,
    )
}

SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM plain JOIN grouped USING (t)
""",
    "op8_chat_formatting": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), parts AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(12 + length(head) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
""",
    "op9_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS n
  FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM lines
), shared AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT doc_id, n, line, key IN (SELECT key FROM shared) AS gone FROM keyed
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
""",
    "op12_embedding_near_dedup": """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
         len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AS odd,
         len(list_filter(embedding, lambda x: x <> 0)) AS used
  FROM embeddings
), usable AS (
  SELECT vec_id, label, v FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND odd = 0 AND used > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reached AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), counted AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
), least AS (
  SELECT x, min(y) AS y FROM reached GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.y, vec_id)) AS component_id,
       vec_id <= coalesce(least.y, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON counted.x = vec_id LEFT JOIN least ON least.x = vec_id
""",
    "op13_phrase_collocations": r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM cut
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0
), spans AS (
  SELECT lang, w, i, k FROM starts, (SELECT unnest(range(1, 6)) AS k) AS lengths WHERE i + k <= len(w) + 1
), counted AS (
  SELECT lang, w[i:i + k - 1] AS p, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM counted WHERE len(p) > 1
), scores AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, n,
         CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:c.k]
       JOIN counted y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]
       JOIN totals t ON t.lang = c.lang
), least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM scores
), inner_ AS (
  SELECT DISTINCT lang, p[1:len(p) - 1] AS p, f FROM counted WHERE len(p) > 2
  UNION SELECT DISTINCT lang, p[2:] AS p, f FROM counted WHERE len(p) > 2
), kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, n, score
  FROM least s LEFT JOIN inner_ i ON i.lang = s.lang AND i.p = s.p AND i.f = s.a WHERE nth = 1 AND i.p IS NULL
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept) AS ranked
WHERE rank <= 2000
""",
}
