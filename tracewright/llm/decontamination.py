"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by an item when some window of as many words as the
item has reaches a weighted similarity of ``similarity`` on five-word shingles
(the sum of the lesser counts over the sum of the greater ones; a shingle's
weight is its count). Words are runs of letters and digits, lower-cased.

1. Windows are laid for an item at every shared shingle, beginning with it.
   This loses nothing: a window that begins with a shingle that the item lacks
   gets no less similar when it is moved on to its first shared shingle. Of
   these, windows with too few shared shingles to reach the similarity go (hits
   are counted in pieces of twice the item's length, so a passage repeated any
   number of times in a long text stays bounded work).
2. Every window and item gets a 64-bit SimHash of its weighted shingles.
3. Multi-index Hamming search: fingerprints are cut into ``radius + 1`` blocks,
   and within ``radius`` bits of each other at least one block is equal, so
   window and item meet under the block's value (and the item, which the window
   knows). No pair within the radius is lost, and each is met once. At
   similarity 0.8 the fingerprints differ in about ten bits of 64, so a radius
   of 23 stands more than four standard deviations off.
4. The pairs found are verified by the exact similarity.

Items with fewer than five words have their whole word sequence as the only
shingle and are looked up as such.

Only DataFrame functions. The items' shingles are broadcast only while there
are at most ``BROADCAST_ROWS`` of them, and joined by a shuffle beyond that.
Documents without a laid window are read once, for their hits.

Nulls and odd rows: null and empty texts, and items without words, match
nothing; very long texts are searched whole; a window that would end behind the
text is what the text has of it; rows with equal ids are judged one by one, and
rows repeated in full report once; repeated items each match; of equally
similar windows the first counts; extra columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused, written

BROADCAST_ROWS = 1_000_000
SHINGLE = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order; empty for fewer words."""

    def hashes(bound: Column) -> Column:
        n = F.size(bound) - F.lit(k)
        at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(bound, i + j) for j in range(k))))

    # each word is hashed once; bound as a variable, so that is not done again for every shingle
    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), hashes), 1)


def simhash_of(shingles: Column) -> Column:
    """SimHash of the shingles, each counted as often as it occurs; bit set when set in over half of them."""

    def with_bit(fp: Column, b: Column) -> Column:  # a pass for each bit: windows are few
        ones = F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return fp.bitwiseOR(F.when(2 * ones > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), with_bit)


def counts_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over the sum of the greater counts of two lists' members."""

    def times(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    counted = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    # where one list repeats nothing, the lesser count of what both have is one
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)
    return both / (F.size(a) + F.size(b) - both)


def block_edges(radius: int) -> list[int]:
    """Bounds of ``radius + 1`` blocks of nearly equal size over 64 bits."""
    blocks = radius + 1
    return [64 * k // blocks for k in range(blocks + 1)]


def _blocks(fp: str, radius: int) -> Column:
    edges = block_edges(radius)
    return F.array(*(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)))


def windows(docs: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    """Windows laid over shared shingles: ``row, doc_id, item_id, item_row, n_words, window_start, window`` (its shingles)."""
    grams = written(items.select("item_id", "item_row", F.size("item_shingles").alias("m"), F.explode(F.array_distinct("item_shingles")).alias("gram")), "item-grams")
    if grams.count() <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
    # (no array beside the exploded shingles: every row would carry it)
    shingled = docs.select("row", shingles_of(words_of(F.col("text")), k).alias("shingles"))
    hits = shingled.select("row", F.size("shingles").alias("n"), F.posexplode("shingles").alias("pos", "gram")).join(grams, "gram")
    # a window that begins in a piece of m positions ends in this piece or the next one
    piece = F.floor(F.col("pos") / F.col("m")).cast("int")
    parts = hits.select("row", "item_id", "item_row", "m", "n", "pos", F.explode(F.array(F.struct(piece.alias("piece"), F.lit(True).alias("begins")), F.struct((piece - 1).alias("piece"), F.lit(False).alias("begins")))).alias("p"))
    parts = parts.distinct().groupBy("row", "item_id", "item_row", "m", "n", "p.piece").agg(F.collect_list(F.when(F.col("p.begins"), F.col("pos"))).alias("starts"), F.collect_list("pos").alias("all"))
    size = lambda start: F.least(F.col("m"), F.col("n") - start)
    inside = lambda start: F.size(F.filter("all", lambda x: (x >= start) & (x < start + F.col("m"))))
    # both / (window + m - both) can reach the similarity with this many shared positions
    enough = lambda start: inside(start) * F.lit(1 + similarity) + 1e-9 >= (size(start) + F.col("m")) * F.lit(similarity)
    laid = parts.select("row", F.explode(F.transform(F.filter("starts", enough), lambda x: F.struct("item_id", "item_row", "m", x.alias("start")))).alias("w"))
    laid = written(laid, "windows-laid")
    of_row = laid.groupBy("row").agg(F.collect_list("w").alias("laid"))
    # texts are dealt by their row at every size: what is laid grows with the corpus, so it is never broadcast
    again = docs.join(of_row.hint("merge"), "row").select("row", "doc_id", "laid", shingles_of(words_of(F.col("text")), k).alias("shingles"))
    cut = F.transform("laid", lambda w: F.struct(w["item_id"].alias("item_id"), w["item_row"].alias("item_row"), w["start"].alias("window_start"), F.slice(F.col("shingles"), w["start"] + 1, w["m"]).alias("window")))
    return again.select("row", "doc_id", F.inline(cut))


def _pairs(docs: DataFrame, items: DataFrame, k: int, radius: int, similarity: float) -> DataFrame:
    found = written(windows(docs, items, k, similarity).distinct().withColumn("fp", simhash_of(F.col("window"))), "windows")
    probes = found.select("*", F.posexplode(_blocks("fp", radius)).alias("block", "value"))
    cells = items.select("item_id", "item_row", "n_words", "item_shingles", "item_fp", F.posexplode(_blocks("item_fp", radius)).alias("block", "value"))
    met = probes.join(cells, ["item_id", "item_row", "block", "value"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    edges = block_edges(radius)
    # a pair is kept under its first equal block
    first = F.coalesce(*(F.when(F.shiftrightunsigned(apart, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0, F.lit(n)) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    met = met.withColumn("bits_apart", F.bit_count(apart)).filter((F.col("bits_apart") <= radius) & (F.col("block") == first))
    return met.select("row", "doc_id", "item_id", "item_row", "window_start", "n_words", "bits_apart", counts_similarity(F.col("window"), F.col("item_shingles")).alias("similarity"))


def _row_of(docs: DataFrame) -> Column:
    """Two hashes that tell a document row."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no item of ``benchmark`` contaminates, with their own columns."""
    (row,) = unused(docs, "row")
    rows = written(contaminated(docs, benchmark, **options).select(F.col("row").alias(row)).distinct(), "contaminated")
    return docs.withColumn(row, _row_of(docs)).join(rows, row, "left_anti").select(*docs.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 23) -> DataFrame:
    """Pairs ``doc_id, item_id`` (and ``row``, hashes of the document row) with their best window: ``window_start, n_words, bits_apart, similarity``.

    ``docs`` has ``doc_id, text`` and ``benchmark`` has ``item_id, text``.
    """
    items = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item_row"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words")).filter("n_words > 0").dropDuplicates(["item_id", "words"])
    items = written(items, "items")
    sizes = sorted(r["k"] for r in items.select(F.least("n_words", F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most five
    rows = docs.select(_row_of(docs).alias("row"), "doc_id", "text")
    found = None
    for k in sizes:
        some = items.filter((F.col("n_words") == k) | (F.lit(k == SHINGLE) & (F.col("n_words") > k)))
        some = some.withColumn("item_shingles", shingles_of(F.col("words"), k)).withColumn("item_fp", simhash_of(F.col("item_shingles")))
        some = written(some.drop("words"), "item-prints")
        pairs = _pairs(rows, some, k, radius, similarity).filter(F.col("similarity") >= similarity)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return docs.sparkSession.createDataFrame([], "row struct<a:long,b:long>, doc_id long, item_id long, window_start int, n_words int, bits_apart int, similarity double")
    best = F.max_by(F.struct("window_start", "bits_apart", "similarity"), F.struct("similarity", -F.col("window_start"))).alias("best")
    out = found.groupBy("row", "doc_id", "item_id", "item_row", "n_words").agg(best)
    return out.select("row", "doc_id", "item_id", "best.window_start", "n_words", "best.bits_apart", F.round("best.similarity", 6).alias("similarity"))
