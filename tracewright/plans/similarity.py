"""Near-duplicates, decontamination and hashing over documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import canary, content_hash, minhash, stable_seed
from ..functions.text import tokens
from ..operators import overlap as V
from ..operators import similarity as S
from ..operators.numbering import numbered
from ..sources.shared import spread
from .tables import table

THRESHOLD = 0.85
#: The benchmark's passages stand inside longer documents, so overlap is graded at a low threshold.
OVERLAP = 0.3


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shingled(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("doc_id"), F.col("text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shingled(table(spark, sf_dir, "benchmark"), F.col("item_id"), F.col("text"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shingle_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("doc_id"), F.col("text"))


def shingle_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.similar_pairs(_docs(spark, sf_dir), THRESHOLD)
    return pairs.select("i", "j", F.round("sim", 6).alias("sim"))


def dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicate(_docs(spark, sf_dir), THRESHOLD)[0].select(F.col("ord").alias("doc_id"))


def dedup_removed_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicate(_docs(spark, sf_dir), THRESHOLD)[1].select(F.col("ord").alias("doc_id"), F.col("kept").alias("kept_id"), F.col("sim").alias("similarity"))


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of 64 permutations, and the sum of all as a check of the others."""
    signed = minhash(S.shingle_texts(table(spark, sf_dir, "benchmark"), F.col("item_id"), F.col("text")))
    total = F.aggregate("sig", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    return signed.select(F.col("ord").alias("item_id"), *(F.col("sig")[k].alias(f"h{k}") for k in range(4)), total.cast("string").alias("total"))


def lsh_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs that share a band; at this threshold a pair misses every band with a chance of about 5e-6."""
    return S.lsh_pairs(_texts(spark, sf_dir), THRESHOLD).select("i", "j", F.round("sim", 6).alias("sim"))


def dedup_minhash_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicate(_texts(spark, sf_dir), THRESHOLD, "minhash")[0].select(F.col("ord").alias("doc_id"))


def decontam_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.decontaminated(_docs(spark, sf_dir), _items(spark, sf_dir), OVERLAP)[0].select(F.col("ord").alias("doc_id"))


def decontam_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.decontaminated(_docs(spark, sf_dir), _items(spark, sf_dir), OVERLAP)[1].select(F.col("ord").alias("doc_id"), F.round("overlap", 4).alias("overlap"))


def corpus_overlap_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's greatest similarity with any document."""
    found = V.best_overlap(_items(spark, sf_dir), _docs(spark, sf_dir))
    return found.select(F.col("ord").alias("item_id"), F.round("overlap", 4).alias("overlap"))


def contamination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canary, overlap and flag of every item of the pack."""
    found = V.best_overlap(_items(spark, sf_dir), _docs(spark, sf_dir))
    return found.select(F.col("ord").alias("item_id"), canary(F.col("ord"), "pack").alias("canary"), F.round("overlap", 4).alias("overlap"), (F.col("overlap") >= OVERLAP).alias("flagged"))


def containment_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.containment(_docs(spark, sf_dir), _items(spark, sf_dir), 0.8)
    return found.select(F.col("ord").alias("doc_id"), F.col("item").alias("item_id"), "share")


def canary_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", canary(F.col("item_id"), "salt").alias("canary"))


def canary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that repeat a canary: here every tenth item's canary stands in a reply."""
    planted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("reply_id"), F.when(F.col("item_id") % 10 == 0, F.concat(F.lit("as in "), canary(F.col("item_id")), F.lit(" it says"))).otherwise(F.col("text")).alias("text"))
    words = planted.select("reply_id", F.explode(F.split("text", r"\s+")).alias("canary"))
    keys = table(spark, sf_dir, "benchmark").select("item_id", canary(F.col("item_id")).alias("canary"))
    return words.join(keys, "canary").select("reply_id", "item_id").distinct()


def stable_seed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic sample of ten items (the sampling operator's own limit)."""
    seeds = table(spark, sf_dir, "benchmark").select("item_id", stable_seed(F.lit(42), F.col("item_id")).alias("seed"))
    return seeds.orderBy("seed", "item_id").limit(10)


def modular_cycle_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of as many rows as documents that cycles through the benchmark items."""
    bank = numbered(table(spark, sf_dir, "benchmark").select("item_id"), [F.col("item_id")], rank="at")
    n = bank.count()
    plan = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), (F.col("doc_id") % F.lit(n)).alias("at"))
    modes = F.array(F.lit("single_agent"), F.lit("multi_agent"), F.lit("code_execution"))
    return plan.join(bank, "at").select("idx", "item_id", F.element_at(modes, (F.col("idx") % 3 + 1).cast("int")).alias("mode"))


def tool_relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three items that share most words with each query, ties by a stable seed."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    tools = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    shared = queries.join(tools, "w").groupBy("q", "item_id").agg(F.count("*").alias("overlap"))
    ranked = shared.withColumn("seed", stable_seed(F.lit(7), F.col("item_id"), F.col("q")))
    order = Window.partitionBy("q").orderBy(F.col("overlap").desc(), "seed", "item_id")
    return ranked.withColumn("place", F.row_number().over(order).cast("bigint")).filter("place <= 3").select("q", "item_id", "overlap", "place")


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical content hash of every event's properties."""
    return table(spark, sf_dir, "events").select("event_id", content_hash(F.col("props")).alias("hash"))


QUERIES = {f.__name__: f for f in (shingle_pairs_exact, dedup_kept, dedup_removed_best, minhash_signature, lsh_candidate_pairs, dedup_minhash_kept, decontam_clean, decontam_flagged, corpus_overlap_max, contamination_report, containment_ext, canary_per_item, canary_search, stable_seed_sample, modular_cycle_plan, tool_relevance_topk, content_hashes)}


def _shingles(relation: str, key: str) -> str:
    """SQL for the distinct 3-word shingles of a table as (ord, s), and all keys with their counts as n."""
    return f"""{relation}_w AS (SELECT {key} AS ord, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM {relation}),
{relation}_s AS (SELECT DISTINCT ord, s FROM (
  SELECT ord, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM {relation}_w)),
{relation}_n AS (SELECT w.ord, count(s.s) AS n FROM {relation}_w w LEFT JOIN {relation}_s s USING (ord) GROUP BY 1)"""


_D, _B = _shingles("documents", "doc_id"), _shingles("benchmark", "item_id")
_PAIRS = f"""WITH {_D},
documents_k AS (SELECT n.ord, list_sort(list(s) FILTER (WHERE s IS NOT NULL)) AS k FROM documents_n n LEFT JOIN documents_s USING (ord) GROUP BY 1),
documents_r AS (SELECT ord, min(ord) OVER (PARTITION BY k) AS first FROM documents_k),
f AS (SELECT s.* FROM documents_s s JOIN documents_r r ON r.ord = s.ord AND r.first = s.ord),
common AS (SELECT a.ord AS i, b.ord AS j, count(*) AS c FROM f a JOIN f b ON a.s = b.s AND a.ord < b.ord GROUP BY 1, 2),
pairs AS (SELECT i, j, c / (x.n + y.n - c)::DOUBLE AS sim FROM common JOIN documents_n x ON x.ord = i JOIN documents_n y ON y.ord = j WHERE c / (x.n + y.n - c)::DOUBLE >= {THRESHOLD})"""
#: Keep-first unrolled: a row goes if an earlier neighbour is sure to stay. Eight rounds settle these tables.
_ROUNDS = 8


def _greedy() -> str:
    sql = ", r0 AS (SELECT DISTINCT ord, 'u' AS st FROM (SELECT i AS ord FROM pairs UNION ALL SELECT j FROM pairs))"
    for k in range(1, _ROUNDS + 1):
        sql += f""", r{k} AS (SELECT r.ord, CASE WHEN r.st <> 'u' THEN r.st WHEN bool_or(coalesce(p.st = 'k', false)) THEN 'r' WHEN bool_and(coalesce(p.st = 'r', true)) THEN 'k' ELSE 'u' END AS st
  FROM r{k - 1} r LEFT JOIN pairs e ON e.j = r.ord LEFT JOIN r{k - 1} p ON p.ord = e.i GROUP BY r.ord, r.st)"""
    return sql


_GREEDY = _PAIRS + _greedy()
_KEPT = f"{_GREEDY} SELECT ord AS doc_id FROM documents_r WHERE ord = first AND ord NOT IN (SELECT ord FROM r{_ROUNDS} WHERE st = 'r')"
_BEST = """{with_},
common AS (SELECT a.ord AS i, b.ord AS j, count(*) AS c FROM {a}_s a JOIN {b}_s b USING (s) GROUP BY 1, 2),
best AS (SELECT i AS ord, max(c / (x.n + y.n - c)::DOUBLE) AS o FROM common JOIN {a}_n x ON x.ord = i JOIN {b}_n y ON y.ord = j GROUP BY 1),
found AS (SELECT n.ord, CASE WHEN n.n = 0 AND EXISTS (SELECT 1 FROM {b}_n WHERE n = 0) THEN 1e0 ELSE coalesce(o, 0e0) END AS overlap FROM {a}_n n LEFT JOIN best USING (ord))"""
_DB = _BEST.format(with_=f"WITH {_D}, {_B}", a="documents", b="benchmark")
_BD = _BEST.format(with_=f"WITH {_D}, {_B}", a="benchmark", b="documents")
_SEED = "CAST(('0x' || substr(sha256({}), 1, 12)) AS BIGINT)"


def _minhash_sql() -> str:
    from ..functions.hashing import PRIME, coefficients

    each = ", ".join(f"min((({a}::HUGEINT * h) + {b}) % {PRIME}) AS h{k}" for k, (a, b) in enumerate(coefficients(64)))
    total = " + ".join(f"h{k}::HUGEINT" for k in range(64))
    return f"""WITH {_B}, hashed AS (SELECT n.ord, coalesce(CAST(('0x' || substr(md5(s), 1, 16)) AS UBIGINT), 0)::HUGEINT AS h FROM benchmark_n n LEFT JOIN benchmark_s USING (ord)),
sig AS (SELECT ord, {each} FROM hashed GROUP BY 1)
SELECT ord AS item_id, h0::BIGINT AS h0, h1::BIGINT AS h1, h2::BIGINT AS h2, h3::BIGINT AS h3, CAST({total} AS VARCHAR) AS total FROM sig"""


ORACLES = {
    "shingle_pairs_exact": f"{_PAIRS} SELECT i, j, round(sim, 6) AS sim FROM pairs",
    "lsh_candidate_pairs": f"{_PAIRS} SELECT i, j, round(sim, 6) AS sim FROM pairs",
    "dedup_kept": _KEPT,
    "dedup_minhash_kept": _KEPT,
    "dedup_removed_best": f"""{_GREEDY}, beside AS (SELECT i AS a, j AS b, sim FROM pairs UNION ALL SELECT j, i, sim FROM pairs),
c AS (SELECT m.ord, e.b AS kept, sim, row_number() OVER (PARTITION BY m.ord ORDER BY sim DESC, e.b) AS k
  FROM documents_r m JOIN r{_ROUNDS} g ON g.ord = m.first AND g.st = 'r' JOIN beside e ON e.a = m.first JOIN r{_ROUNDS} s ON s.ord = e.b AND s.st = 'k' WHERE e.b < m.ord)
SELECT ord AS doc_id, kept AS kept_id, round(sim, 3) AS similarity FROM c WHERE k = 1
UNION ALL SELECT ord, first, 1e0 FROM documents_r WHERE ord <> first AND first NOT IN (SELECT ord FROM r{_ROUNDS} WHERE st = 'r')""",
    "minhash_signature": _minhash_sql(),
    "decontam_clean": f"{_DB} SELECT ord AS doc_id FROM found WHERE overlap < {OVERLAP}",
    "decontam_flagged": f"{_DB} SELECT ord AS doc_id, round(overlap, 4) AS overlap FROM found WHERE overlap >= {OVERLAP}",
    "corpus_overlap_max": f"{_BD} SELECT ord AS item_id, round(overlap, 4) AS overlap FROM found",
    "contamination_report": f"{_BD} SELECT ord AS item_id, 'tracewright-canary-' || substr(sha256('pack:' || ord), 1, 12) AS canary, round(overlap, 4) AS overlap, overlap >= {OVERLAP} AS flagged FROM found",
    "containment_ext": f"WITH {_D}, {_B}, c AS (SELECT a.ord, b.ord AS item, count(*) AS c FROM documents_s a JOIN benchmark_s b USING (s) GROUP BY 1, 2) SELECT c.ord AS doc_id, item AS item_id, round(c / n::DOUBLE, 4) AS share FROM c JOIN benchmark_n n ON n.ord = item WHERE c >= 0.8 * n",
    "canary_per_item": "SELECT item_id, 'tracewright-canary-' || substr(sha256('salt:' || item_id), 1, 12) AS canary FROM benchmark",
    "canary_search": "SELECT item_id AS reply_id, item_id FROM benchmark WHERE item_id % 10 = 0",
    "stable_seed_sample": f"SELECT item_id, {_SEED.format("'42||' || item_id")} AS seed FROM benchmark ORDER BY seed, item_id LIMIT 10",
    "modular_cycle_plan": """
WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS at FROM benchmark)
SELECT doc_id AS idx, item_id, CASE doc_id % 3 WHEN 0 THEN 'single_agent' WHEN 1 THEN 'multi_agent' ELSE 'code_execution' END AS mode
FROM documents JOIN b ON b.at = doc_id % (SELECT count(*) FROM benchmark)""",
    "tool_relevance_topk": f"""
WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
s AS (SELECT q.item_id AS q, t.item_id, count(*) AS overlap FROM w q JOIN w t USING (w) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, {_SEED.format("'7||' || item_id || '||' || q")}, item_id) AS place FROM s)
SELECT * FROM r WHERE place <= 3""",
    "content_hashes": "SELECT event_id, substr(sha256('{\"k\": ' || json_extract_string(props, '$.k') || '}'), 1, 16) AS hash FROM events",
}
