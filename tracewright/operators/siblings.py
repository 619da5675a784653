"""Held-out siblings of scenarios: the same tasks with other labels, as joins over cells and texts.

A pack is two tables: ``cells`` (``scenario_id, row, col, text``) of its worlds,
and ``texts`` (``scenario_id, place, text``) of everything that speaks about
them (task, queries, expected values, answers). The labels are a third table
made of the cells; both are rewritten by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renamed(label: Column, number: Column) -> Column:
    """A label of the same shape: what stands before ``@``, or else before the first ``-``, is turned round, and a number is added."""
    sign = F.when(label.contains("@"), "@").when(label.contains("-"), "-").otherwise("")
    head = F.when(sign == "", label).otherwise(F.call_function("substring_index", label, sign, F.lit(1)))
    tail = F.when(sign == "", F.lit("")).otherwise(F.substr(label, F.char_length(head) + 1))
    digits = number.cast("string")
    return F.when(sign == "-", F.concat(F.reverse(head), tail, digits)).otherwise(F.concat(F.reverse(head), digits, tail))


def label_map(cells: DataFrame, seed: Column) -> DataFrame:
    """``scenario_id, label, new``: the distinct text cells of three or more characters that are no numbers, numbered by first place from ``seed`` on."""
    words = cells.filter("char_length(text) >= 3 and not replace(text, '.', '') rlike '^[0-9]+$'")
    first = words.groupBy("scenario_id", F.col("text").alias("label")).agg(F.min(F.struct("row", "col")).alias("at"))
    number = F.row_number().over(Window.partitionBy("scenario_id").orderBy("at")) - 1
    return first.select("scenario_id", "label", "at", renamed(F.col("label"), seed + number).alias("new"))


def relabelled_cells(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """``cells`` with every label exchanged; other cells stay."""
    by = labels.select("scenario_id", F.col("label").alias("text"), "new")
    return cells.join(by, ["scenario_id", "text"], "left").select("scenario_id", "row", "col", F.coalesce("new", "text").alias("text"))


def relabelled_texts(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``texts`` with the labels of their scenario replaced inside, by first place; a text that is a label is exchanged whole."""
    lists = labels.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("at", "label", "new"))).alias("labels"))
    whole = F.filter("labels", lambda x: x["label"] == F.col("text"))
    inside = F.aggregate("labels", F.col("text"), lambda text, x: F.replace(text, x["label"], x["new"]))
    rows = texts.join(lists, "scenario_id", "left")
    return rows.select("scenario_id", "place", F.when(F.col("labels").isNull(), F.col("text")).when(F.size(whole) > 0, F.get(whole, 0)["new"]).otherwise(inside).alias("text"))


def held_out(cells: DataFrame, texts: DataFrame, seed: Column) -> tuple[DataFrame, DataFrame]:
    """The cells and texts of the siblings; a scenario without labels keeps its own name and texts."""
    labels = label_map(cells, seed)
    other = labels.select("scenario_id").distinct().withColumn("made", F.lit(True))

    def named(rows: DataFrame) -> DataFrame:
        name = F.when(F.col("made"), F.concat("scenario_id", F.lit("~sibling"))).otherwise(F.col("scenario_id"))
        return rows.join(other, "scenario_id", "left").withColumn("sibling_id", name).drop("made")

    return named(relabelled_cells(cells, labels)), named(relabelled_texts(texts, labels))
