"""Quality rules by robust multivariate outliers.

Every text gets base counts and a vector of transformed statistics (mean word
length and the rates of symbols, repeated lines, words in repeated windows and
stuttered words). Rates of short texts are noisy, so each is first shrunk
towards the group's ordinary value as if that many words of it came on top.
For every language and source, for every language and for all rows, the minimum
covariance determinant is estimated over all rows by concentration steps: the
share ``share`` of rows with the least distances gives the next centre and
scatter, by sums that tasks make before anything is shuffled, until all centres
stand still (single rows may go in and out of a step for ever). The start is the coordinatewise median and quartile spread. An estimate
from n rows is mixed with that of the language (and a language's with that of
all rows) with weight ``prior`` against n, so a group of few rows differs
little from its language; groups of any size are treated alike. A row is
rejected when its squared Mahalanobis distance passes a quantile of the
chi-squared distribution. ``floors`` is added to the scatter, so a statistic
that is zero for most rows doesn't make it singular.

Medians and cuts are exact on values rounded to ``_BINS`` steps, relative ones
for values above ``_FINE``, so they don't depend on how rows are dealt over
tasks. A group whose centre still moves after the last step is judged by that
step's estimate, and its rows say so (``settled``).

Nulls and odd rows: a null or empty text has zero counts and fails the base
rules; a null language or source is a group of its own; repeated rows each
count; rows at the same distance are in or out of a step together; a very long
text is counted whole; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written

STATS = ("word_length", "symbols", "dup_lines", "repeats", "stutter")
#: Statistic's count, what it is counted over, and rows of ordinary text that it is shrunk with.
RATES = {"word_length": ("word_chars", "n_words", 100.0), "symbols": ("n_symbols", "n_words", 20.0), "dup_lines": ("n_dup_lines", "n_lines", 6.0), "repeats": ("n_repeat_words", "n_words", 40.0), "stutter": ("n_stutter", "n_words", 40.0)}
#: Standard deviations added to the scatter.
FLOORS = (0.2, 0.04, 0.08, 0.06, 0.02)
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter")
_MIX = np.random.default_rng(11).integers(1, 1 << 63, size=8, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = 8) -> tuple[int, int]:
    """Words inside windows that occur twice or more, the first occurrence included; and words equal to the one before."""
    n = len(words)
    if n < 2:
        return 0, 0
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], dtype=np.int64, count=n)
    stutter = int((ids[1:] == ids[:-1]).sum())
    m = n - window + 1
    if m < 2 or len(known) == n:
        return 0, stutter
    values = (ids + 1).astype(np.uint64)
    keys = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        keys += values[k : k + m] * _MIX[k % 8]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0, stutter
    # equal hashes are compared word for word
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), dtype=bool)
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    marks = np.zeros(n + 1, dtype=np.int64)
    starts = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks)[:n] > 0).sum()), stutter


def base_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``_BASE`` for one whole text."""
    if not text:
        return (0,) * len(_BASE)
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen: set[str] = set()
    dups = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeats, stutter = repeated_words(words)
    return len(words), chars, symbols, dups, repeats, lines, stutter


def _counted(rows: DataFrame, first: str, parts) -> DataFrame:
    """The ``first`` column (name and type) of ``rows``, with language, source and base counts of the text that ``parts`` takes from a batch."""

    def run(batches):
        for batch in batches:
            text, lang, source = parts(batch)
            found = np.array([base_counts(t) for t in text.to_pylist()], dtype=np.int64).reshape(-1, len(_BASE))
            yield pa.RecordBatch.from_arrays([batch.column(0), lang.cast(pa.string()), source.cast(pa.string()), *(pa.array(c) for c in found.T)], names=[batch.schema.names[0], "lang", "source", *_BASE])

    return rows.mapInArrow(run, f"{first}, lang string, source string, " + ", ".join(f"{c} long" for c in _BASE))


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base counts of every row."""
    some = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source")
    return _counted(some, "doc_id long", lambda batch: [batch.column(k) for k in (1, 2, 3)])


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-14:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 10.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i, len(STATS))]


def _quadratic(mean: str, inverse: str):
    """Squared Mahalanobis distance as a column, from an array of means and the packed inverse scatter."""
    out = F.lit(0.0)
    for k, (i, j) in enumerate(_pairs()):
        a, b = (F.col(STATS[x]) - F.col(mean)[x] for x in (i, j))
        out = out + F.col(inverse)[k] * a * b * (1.0 if i == j else 2.0)
    return out


#: A centre stands still when it moves by less than the root of this, in standard deviations.
STILL = 1e-4
#: Stands for all languages or all sources in the key of a pooled estimate.
ALL = "\x00all"
#: Steps that a value of 1 is rounded to: of rates and statistics, and of the logarithm of distances.
_BINS = (1000, 100)
#: Values above are rounded to steps of their logarithm where medians and quartiles are sought, so the distinct ones stay few.
_FINE = 1000.0


def _rounded(x):
    """``x`` in steps of ``_BINS``: even ones up to ``_FINE``, relative ones above; the order of values stays."""
    return F.when(x <= _FINE, F.round(x * _BINS[0]) / _BINS[0]).otherwise(F.greatest(F.exp(F.round(F.ln(x) * _BINS[0]) / _BINS[0]), F.lit(_FINE)))


def _levels(rows: DataFrame) -> DataFrame:
    """Every row thrice: under its language and source, its language, and all (``g_lang, g_source``)."""
    every = F.lit(ALL)
    keys = F.array(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")), F.struct(F.col("lang").alias("l"), every.alias("s")), F.struct(every.alias("l"), every.alias("s")))
    return rows.withColumn("g", F.explode(keys)).withColumns({"g_lang": F.col("g.l"), "g_source": F.col("g.s")}).drop("g")


def _matched(rows: DataFrame, params: DataFrame, lang: str, source: str, how: str = "left") -> DataFrame:
    """``rows`` with what ``params`` (by ``p_lang, p_source``) has for the group of the columns named; few groups, so the smaller side is sent to the tasks if it is small."""
    return rows.join(params, rows[lang].eqNullSafe(params["p_lang"]) & rows[source].eqNullSafe(params["p_source"]), how).drop("p_lang", "p_source")


#: Groups to a file of a table with a row for each.
_GROUP_ROWS = 50_000


def _few(groups: DataFrame, n: int, label: str) -> DataFrame:
    """A table of ``n`` groups written to few files, so joins with it need no shuffle while it is small."""
    return written(groups.repartition(max(1, -(-n // _GROUP_ROWS))), label)


def _with_parents(groups: DataFrame, values: list[str]) -> DataFrame:
    """Stored ``groups`` (``g_lang, g_source`` and ``values``) with the values of language and all as ``l_..`` and ``a_..``."""

    langs = groups.filter(F.col("g_source").eqNullSafe(ALL)).select(F.col("g_lang").alias("p_lang"), *(F.col(v).alias(f"l_{v}") for v in values))
    out = groups.join(langs, groups["g_lang"].eqNullSafe(langs["p_lang"])).drop("p_lang")
    top = groups.filter(F.col("g_lang").eqNullSafe(ALL)).select(*values).first()  # one row of sums or medians
    if top is None:
        return out.limit(0).withColumns({f"a_{v}": F.col(v) for v in values})
    return out.withColumns({f"a_{v}": F.array(*map(F.lit, top[v])) if isinstance(top[v], list) else F.lit(top[v]) for v in values})


def usual_rates(table: DataFrame, prior: float, n: int) -> DataFrame:
    """Medians of the rates for each language and source (``p_lang, p_source, usual``), mixed with those of language and all."""
    rate = {s: _rounded(F.col(a) / F.nullif(F.col(b), F.lit(0))) for s, (a, b, _) in RATES.items()}
    medians = [F.coalesce(F.percentile(rate[s], 0.5), F.lit(0.0)) for s in STATS]
    groups = _few(_levels(table).groupBy("g_lang", "g_source").agg(F.count(F.nullif("n_words", F.lit(0))).alias("n"), F.array(*medians).alias("usual")), n, "usual")
    full = _with_parents(groups, ["n", "usual"])

    def mixed(n: str, own: str, parent):
        return F.zip_with(own, parent, lambda x, y: (F.col(n) * x + F.lit(prior) * y) / (F.col(n) + F.lit(prior)))

    usual = mixed("n", "usual", mixed("l_n", "l_usual", F.col("a_usual")))
    return full.select(F.col("g_lang").alias("p_lang"), F.col("g_source").alias("p_source"), usual.alias("usual"))


def vectors(table: DataFrame, usual: DataFrame) -> DataFrame:
    """``table`` with the transformed statistics."""
    rows = _matched(table, usual, "lang", "source")
    shrunk = {s: (F.col(a) + F.lit(k) * F.col("usual")[i]) / (F.col(b) + F.lit(k)) for i, (s, (a, b, k)) in enumerate(RATES.items())}
    return rows.withColumns(shrunk).drop("usual")


_SUMS = ["n", *(f"s{i}" for i in range(len(STATS))), *(f"q{i}_{j}" for i, j in _pairs())]


def _estimated(sums: DataFrame, factor: float, floors: tuple[float, ...], prior: float) -> DataFrame:
    """Centre and inverse scatter of each group from its sums and its parents' (one row per group, dealt over tasks).

    ``moved`` is the squared distance from the centre before.
    """
    p = len(STATS)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mean, scatter = np.zeros((batch.num_rows, p)), np.zeros((batch.num_rows, p, p))
            for level in ("a_", "l_", ""):
                n = batch.column(f"{level}n").to_numpy().astype(float)
                own = np.stack([batch.column(f"{level}s{i}").to_numpy() for i in range(p)], axis=1) / np.maximum(n, 1)[:, None]
                spread = np.zeros_like(scatter)
                for i, j in _pairs():
                    spread[:, i, j] = spread[:, j, i] = factor * (batch.column(f"{level}q{i}_{j}").to_numpy() / np.maximum(n, 1) - own[:, i] * own[:, j])
                share = n / (n + prior) if level != "a_" else np.ones(len(n))
                mean = share[:, None] * own + (1 - share)[:, None] * mean
                scatter = share[:, None, None] * spread + (1 - share)[:, None, None] * scatter
            inverse = np.linalg.inv(scatter + np.diag(np.square(floors)))
            packed = np.stack([inverse[:, i, j] for i, j in _pairs()], axis=1)
            before = np.array([x if x is not None else [np.inf] * p for x in batch.column("mean").to_pylist()])
            apart = mean - before
            moved = np.einsum("ri,rij,rj->r", apart, inverse, apart)
            lists = [pa.array(list(np.round(x, 12)), pa.list_(pa.float64())) for x in (mean, packed)]
            yield pa.RecordBatch.from_arrays([batch.column("g_lang"), batch.column("g_source"), *lists, pa.array(moved)], names=["p_lang", "p_source", "mean", "inverse", "moved"])

    return sums.mapInArrow(run, "p_lang string, p_source string, mean array<double>, inverse array<double>, moved double")


def concentrated(good: DataFrame, groups: DataFrame, n: int, params: DataFrame, share: float, factor: float, floors: tuple[float, ...], prior: float) -> DataFrame:
    """The next estimates of ``groups``: one aggregation of the rows by group and binned distance, then only its sums."""
    near = _matched(good, params, "g_lang", "g_source", "inner").withColumn("bin", F.floor(F.log1p(F.greatest(_quadratic("mean", "inverse"), F.lit(0.0))) * _BINS[1]).cast("int"))
    moments = [F.count("*").alias("n"), *(F.sum(F.col(s)).alias(f"s{i}") for i, s in enumerate(STATS)), *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}_{j}") for i, j in _pairs())]
    binned = near.groupBy("g_lang", "g_source", "bin").agg(*moments)
    group = Window.partitionBy("g_lang", "g_source")
    before = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    # a bin counts if the share is not reached before it
    inner = binned.withColumns({"before": before, "all": F.sum("n").over(group)}).filter(F.col("before") < F.lit(share) * F.col("all"))
    sums = _few(inner.groupBy("g_lang", "g_source").agg(*(F.sum(c).alias(c) for c in _SUMS)), n, "sums").withColumnsRenamed({"g_lang": "p_lang", "g_source": "p_source"})
    every = _few(_matched(groups, sums, "g_lang", "g_source").fillna(0, _SUMS).fillna(0.0, _SUMS), n, "sums")
    every = _matched(_with_parents(every, _SUMS), params.drop("moved"), "g_lang", "g_source")
    return _few(_estimated(every, factor, floors, prior), n, "centres")


def estimates(good: DataFrame, groups: DataFrame, n: int, share: float, steps: int, floors: tuple[float, ...], prior: float) -> DataFrame:
    """``p_lang, p_source, mean, inverse, moved`` of all ``groups`` from the rows that pass the base rules."""
    p = len(STATS)
    factor = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    rows = written(_levels(good).select("g_lang", "g_source", *STATS), "levels")
    binned = [F.percentile(_rounded(F.col(s)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(s) for s in STATS]
    quartiles = rows.groupBy("g_lang", "g_source").agg(*binned)
    spread = [F.pow((F.col(s)[2] - F.col(s)[0]) / 1.349, 2) + F.lit(f * f) for s, f in zip(STATS, floors, strict=True)]
    packed = [1 / spread[i] if i == j else F.lit(0.0) for i, j in _pairs()]
    start = quartiles.select(F.col("g_lang").alias("p_lang"), F.col("g_source").alias("p_source"), F.array(*(F.col(s)[1] for s in STATS)).alias("mean"), F.array(*packed).alias("inverse"))
    params = _few(start, n, "centres")
    for _ in range(steps):
        new = concentrated(rows, groups, n, params, share, factor, floors, prior)
        discard(params)
        params = new
        if (params.agg(F.max("moved").alias("most")).first()["most"] or 0.0) < STILL:
            break
    discard(rows)
    return params


def judged(table: DataFrame, whole: DataFrame | None = None, share: float = 0.75, steps: int = 20, p_reject: float = 1e-7, prior: float = 100.0, min_words: int = 20, max_repeat: int = 30, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Stored counts with ``base_failed``, ``distance`` (squared) and ``kept``; other columns stay.

    With ``whole``, the same rows with other columns, those are judged. Only rows that pass the base rules enter the estimates. Steps end when
    all centres stand still, after ``steps`` at most; ``settled`` tells whether that of a row's group did by then.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    bare = table.select("lang", "source", *_BASE).withColumn("base_failed", failed)
    groups = _levels(bare.select("lang", "source").distinct()).select("g_lang", "g_source").distinct()
    groups = written(groups, "quality-groups")
    n = groups.count()
    groups = _few(groups, n, "quality-groups")
    usual = _few(usual_rates(bare, prior, n), n, "usual")
    good = vectors(bare.filter("not base_failed"), usual)
    last = estimates(good, groups, n, share, steps, floors, prior)
    out = _matched(vectors((table if whole is None else whole).withColumn("base_failed", failed), usual), last, "lang", "source")
    out = out.withColumn("distance", _quadratic("mean", "inverse")).withColumn("settled", F.col("moved") < STILL).drop("mean", "inverse", "moved")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(1 - p_reject, len(STATS))))


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with their own columns."""
    table = written(counts(docs), "counts", texts=True)
    # counted again beside the documents themselves: that needs neither a join nor a copy of the texts
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    parts = lambda batch: [batch.column(0).field(c) for c in ("text", "lang", "source")]
    again = _counted(whole, f"doc {whole.schema['doc'].dataType.simpleString()}", parts)
    return judged(table, again, **options).filter("kept").select("doc.*")


def quality(docs: DataFrame, **options) -> DataFrame:
    """Counts, distance and verdict of every row of ``docs`` (``doc_id, text, lang, source``)."""
    return judged(written(counts(docs), "counts", texts=True), **options)
