"""Tool-call scoring, failure mining, targeted expansion and preference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_seed

#: Own wordings that a failed query is varied by.
TARGET_TEMPLATES = ("{q}", "{q} Use the right tool for it.", "Once more, step by step: {q}", "{q} Check every argument.", "Another user asks: {q}", "{q} Keep to the required fields.")
EVOLVE_TEMPLATES = ("{q} Give your reasons.", "{q} Add one more condition.", "{q} Work with incomplete data.", "Compare two ways to do this: {q}", "{q} Answer in one sentence.", "{q} Say what could go wrong.", "Now the other way round: {q}")


def lenient_match(got: Column, wanted: Column) -> Column:
    """Values equal but for case and outer blanks; a list of wanted values means any of them."""
    clean = F.lower(F.trim(got))
    return F.exists(wanted, lambda v: F.lower(F.trim(v)) == clean)


def case_score() -> Column:
    """1 for the right tool and arguments, a half for the right tool, else 0."""
    return F.when(F.col("tool_ok") & F.col("args_ok"), 1.0).when(F.col("tool_ok"), 0.5).otherwise(0.0)


def case_report(cases: DataFrame) -> DataFrame:
    """One row ``n, tool_accuracy, arg_accuracy, score`` of scored cases."""
    shares = {"tool_accuracy": F.col("tool_ok").cast("double"), "arg_accuracy": F.col("args_ok").cast("double"), "score": F.col("score")}
    return cases.agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(v), F.lit(0.0)), 4).alias(k) for k, v in shares.items()))


def models_compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the reports of two models' scored cases side by side, and what changed."""
    names = ("tool_accuracy", "arg_accuracy", "score")
    old, new = (case_report(c).select("n", *(F.col(k).alias(f"{k}_{when}") for k in names)) for c, when in ((before, "before"), (after, "after")))
    both = old.join(new.drop("n"))  # one row each
    return both.withColumns({f"delta_{k}": F.round(F.col(f"{k}_after") - F.col(f"{k}_before"), 4) for k in ("tool_accuracy", "score")})


def scored_cases(cases: DataFrame) -> DataFrame:
    """``tool_ok, args_ok, score`` of rows ``case_id, expected_tool, predicted_tool, expected_arg, predicted_arg``."""
    tool = F.coalesce(F.col("predicted_tool") == F.col("expected_tool"), F.lit(False))
    args = tool & F.coalesce(lenient_match(F.col("predicted_arg"), F.array("expected_arg")), F.lit(False))
    return cases.withColumns({"tool_ok": tool, "args_ok": args}).withColumn("score", case_score())


def failures(cases: DataFrame) -> DataFrame:
    """Kinds of failure of scored cases that are not fully right."""
    kind = F.when(F.col("predicted_tool").isNull(), "invalid_call").when(~F.col("tool_ok"), "wrong_tool").otherwise("bad_args")
    return cases.filter(~(F.col("tool_ok") & F.col("args_ok"))).withColumn("kind", kind)


def low_dimensions(scores: DataFrame, key: str, dimensions: tuple[str, ...], threshold: float = 0.7) -> DataFrame:
    """Unpivoted dimensions under the threshold with a sentence each."""
    long = scores.unpivot([key], list(dimensions), "dimension", "value")
    return long.filter(F.col("value") < threshold).withColumn("detail", F.format_string(f"%s=%.2f < {threshold:.2f}", "dimension", "value"))


def weak_dimensions(scores: DataFrame, key: str, dimensions: tuple[str, ...], threshold: float = 0.7) -> DataFrame:
    """Dimensions whose mean is under the threshold, with their mean."""
    long = scores.unpivot([key], list(dimensions), "dimension", "value")
    return long.groupBy("dimension").agg(F.round(F.avg("value"), 4).alias("mean")).filter(F.col("mean") < threshold)


def varied(queries: DataFrame, rounds: int, templates: tuple[str, ...], first_as_is: bool) -> DataFrame:
    """Keep-first variations ``query, round, ord`` of rows ``ord, query``: one template a round, drawn by a stable seed."""
    each = queries.filter(F.trim(F.coalesce("query", F.lit(""))) != "").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    drawn = F.pmod(stable_seed(F.col("ord"), F.col("round")), F.lit(len(templates))).cast("int") + 1
    made = F.replace(F.element_at(F.array(*map(F.lit, templates)), drawn), F.lit("{q}"), F.col("query"))
    text = F.when(F.col("round") == 0, F.col("query")).otherwise(made) if first_as_is else made
    rows = each.select("ord", "round", text.alias("query"))
    order = Window.partitionBy("query").orderBy("round", "ord")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def preference_pairs(scored: DataFrame, min_margin: float = 0.0) -> DataFrame:
    """Best against worst row of every query in rows ``query, ord, text, overall``."""
    best, worst = F.max(F.struct("overall", -F.col("ord"), "text")), F.min(F.struct("overall", -F.col("ord"), "text"))
    pairs = scored.groupBy("query").agg(best.alias("b"), worst.alias("w"), F.count("*").alias("n"))
    margin = F.round(F.col("b.overall") - F.col("w.overall"), 4)
    out = pairs.select("query", F.col("b.text").alias("chosen"), F.col("w.text").alias("rejected"), F.col("b.overall").alias("chosen_score"), F.col("w.overall").alias("rejected_score"), margin.alias("margin"), (F.col("b") == F.col("w")).alias("same"))
    return out.filter(~F.col("same") & (F.col("margin") >= min_margin)).drop("same")


#: Values that the last step of a selection takes to the driver at most, and the parts that a step cuts the rows into.
LAST_VALUES, PARTS = 4096, 2000


def value_at(values: DataFrame, column: str, place: int) -> float:
    """The value at ``place`` (from 0) in descending order, ties counted, of a column without nulls and NaN.

    A selection in rounds: approximate percentiles bracket the place, exact
    counts tell how many rows are above the bracket, and only the rows within go
    on. Each round leaves about one part in ``PARTS`` of the rows, or a single value.
    """
    v = F.col(column)
    while True:
        n = values.count()
        if n <= LAST_VALUES:
            return sorted((r[0] for r in values.select(v).collect()), reverse=True)[place]
        share = 1 - (place + 0.5) / n
        ends = [min(max(share - 1 / PARTS, 0.0), 1.0), min(share + 1 / PARTS, 1.0)]
        low, high = values.agg(F.percentile_approx(v, ends, 10 * PARTS)).first()[0]
        above, within = values.agg(F.count_if(v > high), F.count_if((v >= low) & (v <= high))).first()
        if above > place:  # the estimate was off: go on above, or below
            values = values.filter(v > high)
        elif above + within <= place:
            values, place = values.filter(v < low), place - above - within
        elif low == high:
            return low
        elif within == n:  # nothing was cut off
            equal = values.agg(F.count_if(v == high)).first()[0]
            if place < equal:
                return high
            values, place = values.filter(v < high), place - equal
        else:
            values, place = values.filter((v >= low) & (v <= high)), place - above


def top_quantile(episodes: DataFrame, q: float) -> DataFrame:
    """Episodes with a reward at or above the top quantile's last one; ties stay. Rewards that are null or NaN are no rewards: they neither count nor stay."""
    if not 0 < q <= 1:
        raise ValueError("the quantile must be in (0, 1]")
    rated = episodes.filter(F.col("reward").isNotNull() & ~F.isnan(F.col("reward").cast("double")))
    n = rated.count()
    if not n:
        return rated
    return rated.filter(F.col("reward") >= F.lit(value_at(rated.select("reward"), "reward", max(0, min(n - 1, int(n * q) - 1)))))
