"""Trajectories made from conversations: import, messages, judge, features, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import DANGER, DEFAULT_WEIGHTS, DIMENSIONS, FEATURES, PRESETS, REDACTIONS
from ..functions.text import page_text, phrase, redact, snippet
from ..operators import judge as J
from ..operators import steps as P
from ..operators.schema import from_conversations
from ..operators.verify import verified
from ..sources import writers
from ..sources.shared import spread
from .tables import table


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_conversations(table(spark, sf_dir, "conversations"))


def import_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(spark, sf_dir).select(F.col("ord").alias("conv_id"), "query", "final_answer", F.size("steps").cast("bigint").alias("num_steps"), "success", "generator_model")


def messages_to_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = trajectories(spark, sf_dir).select(F.col("ord").alias("conv_id"), F.posexplode("steps").alias("step_idx", "s"))
    return steps.select("conv_id", F.col("step_idx").cast("bigint").alias("step_idx"), "s.step_type", F.coalesce("s.thought", "s.content").alias("text"))


def message_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat messages of every trajectory, one row each."""
    found = trajectories(spark, sf_dir).select(F.col("ord").alias("conv_id"), F.posexplode(P.messages()).alias("place", "m"))
    return found.select("conv_id", F.col("place").cast("bigint").alias("place"), "m.role", "m.content")


def first_query_last_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by aggregates instead of arrays."""
    turns = table(spark, sf_dir, "conversations").filter("text != ''")
    by = turns.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("query"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"),
    )
    return by.select("conv_id", F.md5("query").alias("query_md5"), F.md5("answer").alias("answer_md5"))


def dangling_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns before any user turn, and conversations that end on a user turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    marked = turns.withColumn("asked", F.coalesce(F.max(F.col("role") == "user").over(before), F.lit(False)))
    return marked.groupBy("conv_id").agg(F.sum(((F.col("role") == "assistant") & ~F.col("asked")).cast("bigint")).alias("orphans"), (F.max_by("role", "turn") == "user").alias("open_end"))


def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that speak twice in a row."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("again", F.lag("role").over(order).eqNullSafe(F.col("role")))
    return turns.groupBy("conv_id").agg(F.sum(F.col("again").cast("bigint")).alias("repeats"))


def judge_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion of every answer without gathered evidence."""
    text = F.trim(F.coalesce("text", F.lit("")))
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", F.round(J.completion(text, F.array().cast("array<string>")), 4).alias("score"))


def judge_safety_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = docs.select("doc_id", J.danger_hits(F.col("text")).cast("bigint").alias("hits"), F.round(J.safety(F.col("text")), 4).alias("safety"))
    return hits


def judge_efficiency_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efficiency of every user's calls: distinct tools over calls, less repeats of the same call in a row."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    again = F.lag("event_type").over(order).eqNullSafe(F.col("event_type")).cast("bigint")
    calls = table(spark, sf_dir, "events").withColumn("again", again)
    by = calls.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_distinct("event_type").alias("tools"), F.sum("again").alias("repeats"))
    raw = F.col("tools") / F.col("calls") - 0.15 * F.col("repeats")
    return by.select("user_id", "calls", "tools", "repeats", F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4).alias("efficiency"))


def judge_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six dimensions of every conversation, without noise."""
    found = J.judged(trajectories(spark, sf_dir), noise=False)
    return found.select(F.col("trajectory_id").cast("bigint").alias("conv_id"), "task_completion", "tool_correctness", "reasoning_coherence", "efficiency", "safety", "faithfulness", "overall", "passed")


def weighted_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted overall of six dimensions that are drawn from an event's value."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("trajectory_id"), *(F.round(F.pmod(F.col("event_id") * (k + 3), F.lit(101)) / 100.0, 3).alias(d) for k, d in enumerate(DIMENSIONS)))
    return events.select("trajectory_id", J.weighted({d: F.col(d) for d in DIMENSIONS}, DEFAULT_WEIGHTS).alias("overall"))


def rubric_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("trajectory_id"), *(F.round(F.pmod(F.col("event_id") * (k + 3), F.lit(101)) / 100.0, 3).alias(d) for k, d in enumerate(DIMENSIONS)))
    return J.with_presets(events).groupBy("preset").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("bigint")).alias("passed"), F.round(F.avg("overall"), 4).alias("mean"))


def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as judges of a user."""
    each = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("trajectory_id"), F.col("event_type").alias("judge")).agg(F.round(F.avg("value") / 100.0, 4).alias("overall"))
    return J.ensemble(each.withColumn("passed", F.col("overall") >= 0.5))


def features_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trajectories(spark, sf_dir)
    return found.select(F.col("ord").alias("conv_id"), *(v.alias(n) for n, v in P.features().items() if n in FEATURES))


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of every conversation: tool arguments, safety and an expected word."""
    found = verified(trajectories(spark, sf_dir), expected=F.lit("the"))
    return found.select(F.col("ord").alias("conv_id"), F.col("verification.verified").alias("verified"), F.col("verification.score").alias("score"), F.array_join(F.transform(F.filter("verification.checks", lambda c: ~c["passed"]), lambda c: c["name"]), ",").alias("failed"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents as a hash with the number of marks."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", redact(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("text_md5"), F.regexp_count("t", F.lit(r"\[redacted-")).cast("bigint").alias("marks"))


def page_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", page_text(F.regexp_replace("html", "<[^>]*>", "\n")).alias("t"))
    return pages.select("page_id", F.md5("t").alias("text_md5"), F.char_length("t").cast("bigint").alias("n"))


def page_find_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", snippet(F.col("html"), "Article", 80).alias("snippet"))


def query_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", phrase(F.col("text"), 8).alias("phrase"))


def parquet_flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat export: one row per trajectory with its evaluation."""
    evals = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("trajectory_id"), F.col("quality").cast("double").alias("overall"), (F.col("quality") == 1).alias("passed"))
    flat = writers.flat(trajectories(spark, sf_dir), evals)
    return flat.select("id", "num_steps", "num_tool_calls", "tools_used", F.md5("final_answer").alias("answer_md5"), "overall", "passed")


def sharegpt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = writers.sharegpt(trajectories(spark, sf_dir)).select("id", F.posexplode("conversations").alias("place", "c"))
    return found.select("id", F.col("place").cast("bigint").alias("place"), F.col("c.from").alias("speaker"), F.md5("c.value").alias("value_md5"))


def adp_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = writers.adp(trajectories(spark, sf_dir)).select("id", "schema", F.posexplode("steps").alias("place", "s"))
    return found.select("id", "schema", F.col("place").cast("bigint").alias("place"), "s.type", F.md5("s.content").alias("content_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        import_conversations, messages_to_steps, message_rendering, first_query_last_answer, dangling_turns, repeated_turns, judge_completion, judge_safety_hits, judge_efficiency_repeats,
        judge_dimensions, weighted_overall, rubric_presets, ensemble_vote, features_19, verification, redact_text, page_clean_text, page_find_snippet, query_phrases, parquet_flat_export, sharegpt_export, adp_export,
    )
}

_T = """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM c WHERE role = 'assistant' AND text <> ''),
q AS (SELECT conv_id, arg_min(text, turn) AS query FROM c WHERE role = 'user' AND text <> '' GROUP BY 1),
ids AS (SELECT DISTINCT conv_id FROM c),
t AS (SELECT ids.conv_id, coalesce(q.query, '') AS query, coalesce((SELECT text FROM a WHERE a.conv_id = ids.conv_id AND turn = last), '') AS final_answer, (SELECT count(*) FROM a WHERE a.conv_id = ids.conv_id) AS num_steps FROM ids LEFT JOIN q USING (conv_id)),
s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_idx, CASE WHEN turn = last THEN 'final_answer' ELSE 'thought' END AS step_type, text FROM a)"""
_M = _T + """,
m AS (SELECT conv_id, 0 AS place, 'user' AS role, query AS content FROM t
  UNION ALL SELECT conv_id, 1, 'assistant', string_agg('[assistant] ' || text, chr(10) ORDER BY step_idx) FROM s WHERE step_type = 'thought' GROUP BY 1
  UNION ALL SELECT conv_id, CASE WHEN num > 1 THEN 2 ELSE 1 END, 'assistant', text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS num FROM s) WHERE step_type = 'final_answer')"""
_HITS = " + ".join(f"contains(lower(coalesce({{0}}, '')), '{x}')::INT" for x in DANGER)
_E = "SELECT event_id, " + ", ".join(f"round(((event_id * {k + 3}) % 101) / 100e0, 3) AS {d}" for k, d in enumerate(DIMENSIONS)) + " FROM events"


def _weighted(weights: dict[str, float]) -> str:
    return "round((" + " + ".join(f"{d} * {weights[d]}::DOUBLE" for d in DIMENSIONS) + f") / {sum(weights.values())!r}::DOUBLE, 4)"


def _presets() -> str:
    parts = [f"SELECT '{name}' AS preset, {_weighted(w)} AS overall, {t}::DOUBLE AS t FROM e" for name, (w, t) in PRESETS.items()]
    return f"WITH e AS ({_E}), p AS ({' UNION ALL '.join(parts)}) SELECT preset, count(*) AS n, sum((overall >= t)::INT)::BIGINT AS passed, round(avg(overall), 4) AS mean FROM p GROUP BY 1"


def _redacted() -> str:
    text = "text"
    for label, pattern in REDACTIONS:
        pattern = pattern.replace("(?U)", "").replace("'", "''")
        if label == "phone":  # no look-behind here: the character before is matched and put back
            pattern = pattern.replace(r"(?<![\w.])", r"(^|[^\p{L}\p{N}_.])")
            text = f"regexp_replace({text}, '{pattern}', '\\1[redacted-{label}]', 'g')"
        else:
            text = f"regexp_replace({text}, '{pattern}', '[redacted-{label}]', 'g')"
    return f"WITH r AS (SELECT doc_id, {text} AS t FROM documents) SELECT doc_id, md5(t) AS text_md5, len(regexp_extract_all(t, '\\[redacted-'))::BIGINT AS marks FROM r"


ORACLES = {
    "import_conversations": f"{_T} SELECT conv_id, query, final_answer, num_steps, final_answer <> '' AS success, 'import:openai' AS generator_model FROM t",
    "messages_to_steps": f"{_T} SELECT conv_id, step_idx, step_type, text FROM s",
    "message_rendering": f"{_M} SELECT conv_id, place::BIGINT AS place, role, content FROM m",
    "first_query_last_answer": "SELECT conv_id, md5(arg_min(text, turn) FILTER (WHERE role = 'user')) AS query_md5, md5(arg_max(text, turn) FILTER (WHERE role = 'assistant')) AS answer_md5 FROM conversations WHERE text <> '' GROUP BY 1",
    "dangling_turns": """
WITH m AS (SELECT *, coalesce(bool_or(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS asked FROM conversations)
SELECT conv_id, sum((role = 'assistant' AND NOT asked)::INT)::BIGINT AS orphans, arg_max(role, turn) = 'user' AS open_end FROM m GROUP BY 1""",
    "repeated_turns": "WITH m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AS again FROM conversations) SELECT conv_id, sum(again::INT)::BIGINT AS repeats FROM m GROUP BY 1",
    "judge_completion": "WITH x AS (SELECT conv_id, turn, length(trim(coalesce(text, ''))) AS n FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0.1e0 WHEN n < 20 THEN 0.35e0 + 0.2e0 * n / 20e0 ELSE 0.85e0 END, 4) AS score FROM x",
    "judge_safety_hits": f"WITH h AS (SELECT doc_id, ({_HITS.format('text')})::BIGINT AS hits FROM documents) SELECT doc_id, hits, round(greatest(1e0 - 0.25e0 * hits, 0e0), 4)::DOUBLE AS safety FROM h",
    "judge_efficiency_repeats": """
WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type AS again FROM events),
b AS (SELECT user_id, count(*) AS calls, count(DISTINCT event_type) AS tools, sum(again::INT)::BIGINT AS repeats FROM m GROUP BY 1)
SELECT *, round(least(greatest(tools / calls::DOUBLE - 0.15e0 * repeats, 0e0), 1e0), 4) AS efficiency FROM b""",
    "judge_dimensions": f"""{_T},
d AS (SELECT conv_id, final_answer, CASE WHEN length(trim(final_answer)) = 0 THEN 0.1e0 WHEN length(trim(final_answer)) < 20 THEN 0.35e0 + 0.2e0 * length(trim(final_answer)) / 20e0 ELSE 0.85e0 END AS tc,
  least(greatest(0.5e0 + CASE WHEN num_steps > 1 THEN 0.2e0 ELSE 0e0 END + CASE WHEN num_steps > 0 THEN 0.2e0 ELSE -0.1e0 END, 0e0), 1e0) AS rc, CASE WHEN num_steps > 0 THEN 0.75e0 ELSE 0.6e0 END AS f, greatest(1e0 - 0.25e0 * ({_HITS.format('final_answer')}), 0e0) AS sa FROM t),
r AS (SELECT conv_id, round(tc, 3) AS task_completion, 0.7e0 AS tool_correctness, round(rc, 3) AS reasoning_coherence, 1e0 AS efficiency, round(sa, 3)::DOUBLE AS safety, f AS faithfulness FROM d)
SELECT *, {_weighted(DEFAULT_WEIGHTS)} AS overall, {_weighted(DEFAULT_WEIGHTS)} >= 0.6 AS passed FROM r""",
    "weighted_overall": f"WITH e AS ({_E}) SELECT event_id::VARCHAR AS trajectory_id, {_weighted(DEFAULT_WEIGHTS)} AS overall FROM e",
    "rubric_presets": _presets(),
    "ensemble_vote": """
WITH j AS (SELECT user_id::VARCHAR AS trajectory_id, event_type, round(avg(value) / 100e0, 4) AS o FROM events GROUP BY 1, 2)
SELECT trajectory_id, round(avg(o), 4) AS overall, 2 * sum((o >= 0.5)::INT) >= count(*) AS passed, round(1 - (max(o) - min(o)), 3) AS agreement, count(*) AS judges FROM j GROUP BY 1""",
    "features_19": f"""{_T}, w AS (SELECT *, len(list_filter(regexp_split_to_array(final_answer, '\\s+'), lambda x: x <> '')) AS aw, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '')) AS qw FROM t)
SELECT conv_id, num_steps::DOUBLE AS num_steps, 0e0 AS num_tool_calls, 0e0 AS num_observations, greatest(num_steps - 1, 0)::DOUBLE AS num_thoughts, 0e0 AS distinct_tools, 0e0 AS repeated_signature, 1e0 AS valid_arg_ratio, 0e0 AS error_observation_ratio,
  0e0 AS avg_observation_chars, (final_answer <> '')::INT::DOUBLE AS has_final_answer, aw::DOUBLE AS final_answer_words, 0e0 AS thought_before_first_call, qw::DOUBLE AS query_words, 1e0 AS mode_single, 0e0 AS mode_multi, 0e0 AS mode_code, 0e0 AS has_verification, 0e0 AS verification_verified, 0e0 AS verification_score FROM w""",
    "verification": f"""{_T}, k AS (SELECT conv_id, ({_HITS.format('final_answer')}) = 0 AS safe, contains(lower(final_answer), 'the') AS found FROM t)
SELECT conv_id, safe AND found AS verified, round((1 + safe::INT + found::INT) / 3e0, 3) AS score, concat_ws(',', CASE WHEN NOT safe THEN 'safety' END, CASE WHEN NOT found THEN 'expected_answer' END) AS failed FROM k""",
    "redact_text": _redacted(),
    "page_clean_text": """
WITH l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM pages),
t AS (SELECT page_id, array_to_string(l, chr(10)) AS t FROM l), c AS (SELECT page_id, CASE WHEN length(t) > 2000 THEN substring(t, 1, 2000) || '…' ELSE t END AS t FROM t)
SELECT page_id, md5(t) AS text_md5, length(t) AS n FROM c""",
    "page_find_snippet": """
WITH p AS (SELECT page_id, html, strpos(lower(html), 'article') AS hit FROM pages), x AS (SELECT *, greatest(hit - 80, 1) AS a, least(hit + 6 + 80, length(html)) AS b FROM p)
SELECT page_id, CASE WHEN hit > 0 THEN (CASE WHEN a > 1 THEN '…' ELSE '' END) || substring(html, a, b - a + 1) || (CASE WHEN b < length(html) THEN '…' ELSE '' END) END AS snippet FROM x""",
    "query_phrases": "SELECT item_id, array_to_string((string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))[1:8], ' ') AS phrase FROM benchmark",
    "parquet_flat_export": f"{_T} SELECT t.conv_id::VARCHAR AS id, num_steps, 0::BIGINT AS num_tool_calls, '' AS tools_used, md5(final_answer) AS answer_md5, quality::DOUBLE AS overall, quality = 1 AS passed FROM t LEFT JOIN labels l ON l.doc_id = t.conv_id",
    "sharegpt_export": f"{_M} SELECT conv_id::VARCHAR AS id, place::BIGINT AS place, CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END AS speaker, md5(content) AS value_md5 FROM m",
    "adp_export": f"{_T} SELECT conv_id::VARCHAR AS id, 'adp/0.1' AS schema, step_idx AS place, step_type AS type, md5(text) AS content_md5 FROM s",
}


def step_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short line for every step."""
    steps = trajectories(spark, sf_dir).select(F.col("ord").alias("conv_id"), F.posexplode("steps").alias("place", "s"))
    return steps.select("conv_id", F.col("place").cast("bigint").alias("place"), P.one_line(F.col("s")).alias("line"))


def transcript_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 characters of every conversation's transcript."""
    row = F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    return turns.select("conv_id", F.right(F.array_join(F.transform("t", lambda t: t["line"]), "\n"), F.lit(200)).alias("tail"))


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a pack by tier; a third of them name none."""
    tier = F.get_json_object(F.when(F.col("item_id") % 3 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"tier": "t'), (F.col("item_id") % 2).cast("string"), F.lit('"}'))), "$.tier")
    return table(spark, sf_dir, "benchmark").groupBy(F.coalesce(tier, F.lit("unspecified")).alias("tier")).agg(F.count("*").alias("n"))


QUERIES |= {f.__name__: f for f in (step_lines, transcript_tails, tier_counts)}
ORACLES |= {
    "step_lines": f"{_T} SELECT conv_id, step_idx AS place, '[' || step_type || '] ' || substring(text, 1, 80) AS line FROM s",
    "transcript_tails": "SELECT conv_id, right(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn), 200) AS tail FROM conversations GROUP BY 1",
    "tier_counts": "SELECT CASE WHEN item_id % 3 = 0 THEN 'unspecified' ELSE 't' || (item_id % 2) END AS tier, count(*) AS n FROM benchmark GROUP BY 1",
}
