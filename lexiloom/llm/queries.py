"""The queries over the corpus operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.chat_format import format_chats, unescape
from lexiloom.llm.common import docs_of
from lexiloom.llm.exact_dedup import exact_dedup
from lexiloom.llm.jaccard_join import jaccard_components
from lexiloom.llm.language_id import identify
from lexiloom.llm.line_dedup import line_dedup
from lexiloom.llm.lm_score import lm_score
from lexiloom.llm import merkle, mixing
from lexiloom.llm.packing import pack_documents
from lexiloom.llm.periodic_runs import periodic_runs
from lexiloom.llm.suffix_dedup import remove_repeats
from lexiloom.llm.topk_search import top_k
from lexiloom.llm.toxicity import learn, score

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def fold(modulus: int, remainder: int):
    """Whether crc32 of the identifier as text leaves ``remainder``; null identifiers don't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


@query
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(docs_of(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op1_topk_search"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(docs_of(spark, sf_dir), max_repeats=2.0).select("doc_id", "n_tokens", "copies", "place")


ORACLES["op2_mixing"] = mixing.ORACLE


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels")
    model = learn(docs.select("doc_id", "text"), labels.where(~fold(5, 0)))
    return score(docs.withColumn("held_out", fold(5, 0)), model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted", "n_passages")


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(docs_of(spark, sf_dir), n=3, percent=90)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(docs_of(spark, sf_dir).select("doc_id", "text"), min_words=1)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).withColumn("held_out", fold(4, 2))
    return identify(docs, ~fold(4, 2), keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(own).alias("text"),
    )
    rows = docs_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(rows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss", lambda s: unescape(s["text"])), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op7_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS role_out,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS text_out
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(role_out) + length(text_out) + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(docs_of(spark, sf_dir))
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", "bound", "bins"
    )


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(docs_of(spark, sf_dir), keep="largest")


ORACLES["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(docs_of(spark, sf_dir))


ORACLES["op4_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')]
    ELSE list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]) END)) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON both_ways.a = reach.doc_id),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.r, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
"""


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(docs_of(spark, sf_dir), plant=True).drop("n_words")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(docs_of(spark, sf_dir), tampered=fold(5, 0))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLES["op12_merkle_manifest"] = merkle.oracle()


@query
def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(docs_of(spark, sf_dir), held_out=fold(7, 2))
