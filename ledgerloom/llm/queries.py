"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, langid, matroska, merkle, neardup, packing, pages, pii, quality, rules, suffixtree, transducer
from .common import id_fold, table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.store_texts(table(spark, sf_dir, "documents")))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation whose texts consist of the template's own control strings.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.expand(turns.unionByName(spark.createDataFrame(CONTROL_TURNS, turns.schema))))


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
      '\', '\\'), '<<SYS>>', '<+<SYS>>'), '<</SYS>>', '<+</SYS>>'), '[INST]', '[+INST]'), '[/INST]', '[+/INST]'),
      '<s>', '<+s>'), '</s>', '<+/s>'), '[ROLE]', '[+ROLE]'), '[/ROLE]', '[+/ROLE]'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + length(role) END AS chars
  FROM turns
), placed AS (
  SELECT *,
    sum(chars) OVER w AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR last) AS n_examples
FROM placed GROUP BY conv_id
"""


def op4_confirmed_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).drop("found")


def op5_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.label_documents(docs, langid.train(docs, langid.training_rows()))
    return found.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=quality.training_rows())
    return found.select("doc_id", (id_fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).withColumnRenamed("nid", "doc_id")


def op8_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encode(table(spark, sf_dir, "documents"), vocabulary_path(), digest=True)


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixtree.score_documents(table(spark, sf_dir, "documents"), suffixtree.training_rows())
    return found.select("doc_id", (id_fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda text: merkle.leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    tampered = F.when((id_fold("doc_id", 2) == 0) & F.col("doc_id").isNotNull(), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    found = merkle.manifest(docs, group_col="source", id_col="doc_id", leaf=leaf(F.col("text")), claimed=tampered, proof_digest=True)
    return found.withColumnRenamed("proof", "proof_sha256").withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, text, '' AS h,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
    -- the CRC's polynomial division, a byte and then its eight bits
    list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: [ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(front || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS claimed
  FROM docs
), placed AS (
  SELECT *, row_number() OVER () AS uid,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed NULLS FIRST) - 1 AS place,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, place // 3
), subroots AS (
  SELECT tree, arg_max(h, level) AS h FROM nodes GROUP BY tree
), tops AS (
  SELECT -1 AS tree, 0 AS level, tree AS place, h FROM subroots
  UNION ALL
  SELECT -1, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, place // 3
), every AS (
  SELECT *, count(*) OVER (PARTITION BY tree, level) AS n FROM (SELECT * FROM nodes UNION ALL SELECT * FROM tops)
), siblings AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.place
), climb AS (
  SELECT uid, tree, 0 AS level, place, '' AS proof, coalesce(claimed, leaf) AS folded FROM placed
  UNION ALL
  SELECT c.uid, CASE WHEN s.l IS NULL THEN -1 ELSE c.tree END, CASE WHEN s.l IS NULL THEN 0 ELSE c.level + 1 END,
    CASE WHEN s.l IS NULL THEN c.tree ELSE c.place // 3 END, c.proof || coalesce(s.l || s.r, ''),
    CASE WHEN s.l IS NULL THEN c.folded ELSE sha256(s.l || c.folded || s.r) END
  FROM climb c LEFT JOIN siblings s ON c.tree = s.tree AND c.level = s.level AND c.place = s.place
  WHERE s.l IS NOT NULL OR c.tree >= 0
), climbed AS (
  SELECT uid, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM climb WHERE tree = -1 GROUP BY uid
)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.h AS verified
FROM placed p JOIN climbed c USING (uid) JOIN subroots s USING (tree), (SELECT arg_max(h, level) AS h FROM tops) t
"""


def op12_consensus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.linked(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska_packets": op1_matroska_packets,
    "op2_decision_list": op2_decision_list,
    "op3_prefix_target": op3_prefix_target,
    "op4_confirmed_pii": op4_confirmed_pii,
    "op5_viterbi_language": op5_viterbi_language,
    "op6_kernel_quality": op6_kernel_quality,
    "op7_probminhash_classes": op7_probminhash_classes,
    "op8_transducer_bpe": op8_transducer_bpe,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_consensus_pages": op12_consensus_pages,
    "op13_token_alignment": op13_token_alignment,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {"op3_prefix_target": OP3_SQL, "op11_merkle_manifest": OP11_SQL}
