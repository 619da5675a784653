"""Dataset folders with a card, and Markdown reports of small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import writers
from .shared import stored


def size_bucket(n: int) -> str:
    return next((name for limit, name in ((1000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K")) if n < limit), "100K<n<1M")


def card(name: str, n: int, pass_rate: float | None, license_id: str = "mit") -> str:
    rate = "not judged" if pass_rate is None else f"{100 * pass_rate:.1f} %"
    return f"---\nlicense: {license_id}\nsize_categories:\n- {size_bucket(n)}\n---\n\n# {name}\n\n{n} trajectories, pass rate {rate}. Files: `train` (JSON lines) and `sharegpt`.\n"


def prepare_folder(trajectories: DataFrame, path: str, name: str, evals: DataFrame | None = None) -> str:
    """Write ``train``, ``sharegpt`` and the card under ``path``; returns the card."""
    rows = stored(trajectories, "export")
    writers.save(rows, f"{path}/train", "jsonl")
    writers.save(rows, f"{path}/sharegpt", "sharegpt")
    rate = None if evals is None else evals.agg(F.avg(F.col("passed").cast("double"))).first()[0]
    text = card(name, rows.count(), rate)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/README")
    return text


def markdown_lines(df: DataFrame) -> DataFrame:
    """A report of any length as lines of Markdown (``value``), one for each row."""
    cells = [F.coalesce(F.regexp_replace(F.replace(F.format_string("%.6g", c) if t in ("double", "float") else F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit("")) for c, t in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown(df: DataFrame) -> str:
    """A whole report table as Markdown, for reports that are short by nature; longer ones go to files by :func:`markdown_lines`."""
    rows = df.collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else f'{v:g}' if isinstance(v, float) else str(v) for v in r)} |\n" for r in rows)
