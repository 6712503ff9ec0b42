"""One query for each training-data operator, over whole tables, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import block_max_search, bpe, chat, embedding_dedup, graph_search, jaccard_join, line_dedup, mixing, phrase_mining, sharding, topk_segments, toxicity, unigram_count
from quillspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
BPE_VOCABULARY = "word_bpe_49k.json"
CHAT_VOCABULARY = "byte_bpe_50k.json"
UNIGRAM_VOCABULARY = "piece_bpe_32k.model"


def op1_topk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_segments.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


TOPK_SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk_segments.K}
"""


def bpe_digests(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    coded = bpe.encode_decode(documents, vocabulary_path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_VOCABULARY))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the public vocabulary file, read as a unigram model."""
    return unigram_count.token_counts(table(spark, sf_dir, "documents"), unigram_count.pieces_of(public_tokenizers.path(UNIGRAM_VOCABULARY)))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


CONTROL_CONVERSATION = [(-1, 0, role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(c, k, r, t) for k, (c, _, r, t) in enumerate(CONTROL_CONVERSATION)], conversations.schema)
    told = chat.conversation_digests(conversations.unionByName(control), public_tokenizers.path(CHAT_VOCABULARY))
    return told.drop("n_tokens", "loss_tokens")  # which SQL can't count


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, ['user', 'assistant'][k + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) t(k)),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length('<|im_start|><|im_sep|><|im_end|>' || chr(10)) + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM told
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[k : k + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared.n::DOUBLE / (x.n + y.n - shared.n) >= 0.8),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS low FROM reached GROUP BY 1),
counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(n, 0)::BIGINT AS n_links FROM documents LEFT JOIN classes USING (doc_id) LEFT JOIN counts USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


LINE_DEDUP_SQL = rf"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
bad AS (SELECT trim(line) AS bad FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
marked AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
judged AS (SELECT doc_id, pos, line, bad IS NOT NULL AS is_bad FROM marked LEFT JOIN bad ON trim(line) = bad),
documents_judged AS (
  SELECT doc_id, count(*) AS n_lines, sum(is_bad::int) AS n_bad, bool_or(NOT is_bad AND regexp_matches(line, '[^\x20\x09-\x0D]')) AS accompanies,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_bad) AS kept
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, (CASE WHEN accompanies THEN n_bad ELSE 0 END)::BIGINT AS n_removed,
       CASE WHEN accompanies AND n_bad > 0 THEN coalesce(kept, '') ELSE d.text END AS text
FROM documents d LEFT JOIN documents_judged j USING (doc_id)
"""


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "copies")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


EMBEDDING_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS MATERIALIZED (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM usable),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= 0.98),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS vec_id, min(b) AS low FROM reached GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN classes USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


MIXING_SQL = r"""
WITH sized AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM sources),
limited AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((position - 1) % 3 + 1)::INT] AS weight, source_size::DOUBLE * 3.0::DOUBLE AS lim FROM ranked),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM limited WINDOW b AS (ORDER BY lim / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, level * weight > lim AS capped FROM levels),
targeted AS (
  SELECT source, source_size, CASE WHEN capped THEN lim ELSE (sum(source_size::DOUBLE) OVER () - sum(CASE WHEN capped THEN lim ELSE 0 END) OVER ()) * weight / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM marked),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized d JOIN targeted t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT))::BIGINT AS taken, (floor(rate)::INT + (draw < rate - floor(rate))::INT)::INT AS copies
FROM rated
"""


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RANKED_SQL = rf"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT row_number() OVER () AS row, doc_id, terms, len(terms)::BIGINT AS n FROM lowered),
whole AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n)::BIGINT AS occurrences FROM sized),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY ALL),
occurring AS (SELECT row, doc_id, n, unnest(terms) AS term FROM sized),
postings AS MATERIALIZED (SELECT row, doc_id, n, term, count(*) AS tf FROM occurring WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, whole GROUP BY term),
impacts AS (SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // occurrences)) AS impact FROM postings, whole),
scored AS (
  SELECT item_id, row, doc_id, sum(q * w * impact)::BIGINT AS score FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {block_max_search.K}
"""


def op12_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents"))


PHRASE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
spans AS (SELECT lang, w, i, unnest(range(1, least({phrase_mining.MAX_N}, len(w) - i + 1) + 1)) AS s FROM starts),
counts AS MATERIALIZED (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, s, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= {phrase_mining.MIN_COUNT}),
candidates AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, s, f AS a FROM counts WHERE s > 1),
cuts AS (SELECT lang, phrase, w, a, s, unnest(range(1, s)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.s], ' ') JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
begun AS (SELECT lang, w, s, a, unnest(range(1, s)) AS i FROM candidates WHERE s > 2),
inside AS (SELECT lang, w, s, a, i, unnest(range(2, least(s - 1, s - i + 1) + 1)) AS size FROM begun),
longer AS (SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT * FROM weakest LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {phrase_mining.ABSORB_PERCENT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= {phrase_mining.TOP}
"""


QUERIES: dict[str, Query] = {
    "op1_topk_segments": op1_topk_segments,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_token_counts": op3_token_counts,
    "op4_balanced_shards": op4_balanced_shards,
    "op5_chat_format": op5_chat_format,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_block_max_search": op11_block_max_search,
    "op12_graph_search": op12_graph_search,
    "op13_phrase_mining": op13_phrase_mining,
}
ORACLE_SQL: dict[str, str] = {
    "op1_topk_segments": TOPK_SQL,
    "op5_chat_format": CHAT_SQL,
    "op6_jaccard_join": JACCARD_SQL,
    "op8_line_dedup": LINE_DEDUP_SQL,
    "op9_mix_sources": MIXING_SQL,
    "op10_embedding_dedup": EMBEDDING_SQL,
    "op11_block_max_search": RANKED_SQL,
    "op13_phrase_mining": PHRASE_SQL,
}
