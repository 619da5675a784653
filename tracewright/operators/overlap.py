"""Greatest overlap of each row with another table, decontamination and containment, on word shingles.

A best match has no threshold to filter by, so it is searched in rounds. The
shingles of a row are read rarest first (rare in the other table). After p of
its k matched shingles, a set that hasn't been met shares at most k - p with
the row's n, so its Jaccard is at most (k - p) / n; a row whose best so far
reaches that is settled and reads no more. Each round reads further, compares
what it meets exactly, and only rows that aren't settled go on.

Shingles in more than ``HOT`` sets of the other table are not read that way.
A set that was not met by a rare shingle shares hot ones only, so of all sets
with the same hot shingles the smallest is the best: one stands for all of
them, however many there are. The rounds go on over those.

Only shingles that both tables have matter beside the sizes of the sets. Rows
with as many members and the same shared ones are compared once, on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Membership, stored
from .similarity import kept_sets

#: Sets of the other table that make a shingle hot.
HOT = 32
#: How many of a row's shingles are read by the end of each round; the last round reads all.
READ = (4, 64, 1 << 62)


def _shared(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``ord, n, s`` (written): members of sets that are among ``wanted`` (``s``); of the others next to none is shuffled."""
    members = sets.filter("n > 0").select("ord", "n", F.explode("shingles").alias("s"))
    return stored(Membership(stored(wanted.select("s").distinct(), "wanted")).within(members).select("ord", F.col("n").cast("long").alias("n"), "s"), "shared")


def _kinds(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ord, first`` of every row, and ``ord, n, shingles`` of the first of those with as many members and the same shared ones: they have the same overlaps."""
    each = stored(shared.groupBy("ord", "n").agg(F.sort_array(F.collect_list("s")).alias("shingles")), "shared-sets")
    first = stored(each.groupBy("n", "shingles").agg(F.min("ord").alias("first")), "kinds")
    return each.join(first, ["n", "shingles"]).select("ord", "first"), first.select(F.col("first").alias("ord"), "n", "shingles")


def _rounds(state: DataFrame, members: DataFrame, postings: DataFrame, ours: DataFrame, theirs: DataFrame, later: str) -> DataFrame:
    """``state`` (``ord, n, best`` and counts) with better ``best`` where ``postings`` (``s, o, m``) give one.

    ``members`` (``ord, s, pos``) are a row's shingles in the order of reading,
    of which the state says how many (``count``) and how many more are shared at
    most that aren't read here (``later``). ``ours`` and ``theirs`` (``shingles``)
    are what is compared.
    """
    low = 0
    for high in READ:
        unread = F.col("count") + F.col(later) - low
        active = state.filter((F.col("count") > low) & (F.col("best") * F.col("n") < unread))
        if active.isEmpty():
            break
        left = F.least(F.col("count") + F.col(later) - F.col("pos") + 1, F.col("n"), F.col("m"))
        better = left / (F.col("n") + F.col("m") - left) > F.col("best")
        read = members.filter((F.col("pos") > low) & (F.col("pos") <= high)).join(active, "ord")
        met = stored(read.join(postings, "s").filter(better).select("ord", "o", "n", "m").distinct(), "overlap-candidates")
        both = F.size(F.array_intersect("ours", "theirs"))
        pairs = met.join(ours.select("ord", F.col("shingles").alias("ours")), "ord").join(theirs.select("o", F.col("shingles").alias("theirs")), "o")
        found = pairs.select("ord", (both / (F.col("n") + F.col("m") - both)).alias("is")).groupBy("ord").agg(F.max("is").alias("is"))
        state = stored(state.join(found, "ord", "left").withColumn("best", F.greatest("best", F.coalesce("is", F.lit(0.0)))).drop("is"), "overlap-best")
        low = high
    return state


def _ranked(members: DataFrame, by: str) -> DataFrame:
    order = Window.partitionBy("ord").orderBy(by, "s")
    return members.withColumn("pos", F.row_number().over(order).cast("long"))


def best_overlap(sets: DataFrame, others: DataFrame, floor: float = 0.0) -> DataFrame:
    """``ord, overlap``: the greatest Jaccard of each set with any of ``others``; 0 where nothing is shared.

    An overlap below ``floor`` is reported as 0, which spares its search. An
    empty set has overlap 1 with an empty one and 0 with any other.
    """
    sets, others = kept_sets(sets), kept_sets(others)

    def members(of: DataFrame) -> DataFrame:
        return of.select(F.explode("shingles").alias("s"))

    if sets.count() <= others.count():  # the smaller side says first what may be shared
        yours = _shared(others, members(sets))
        ours = _shared(sets, yours)
    else:
        ours = _shared(sets, members(others))
        yours = _shared(others, ours)
    in_class, mine = _kinds(ours)
    theirs = _kinds(yours)[1].select(F.col("ord").alias("o"), F.col("n").alias("m"), "shingles")
    postings = theirs.select("o", "m", F.explode("shingles").alias("s"))
    counted = stored(postings.groupBy("s").agg(F.count("*").alias("df")), "overlap-counts")
    matched = stored(_ranked(mine.select("ord", "n", F.explode("shingles").alias("s")).join(counted, "s"), "df"), "overlap-members")
    rare, hot = F.col("df") <= HOT, F.col("df") > HOT
    start = F.lit(max(floor - 1e-12, 0.0))
    state = matched.groupBy("ord", "n").agg(F.count_if(rare).alias("count"), F.count_if(hot).alias("hot"), F.max(start).alias("best"))
    index = stored(postings.join(counted.filter(rare).select("s"), "s", "left_semi"), "overlap-index")
    state = _rounds(stored(state, "overlap-best"), matched.filter(rare).select("ord", "s", "pos"), index, mine, theirs, "hot")

    tails = matched.filter(hot).select("ord", "s").join(state.filter(F.col("best") * F.col("n") < F.col("hot")).select("ord"), "ord", "left_semi")
    tails = stored(tails, "overlap-tails")
    if not tails.isEmpty():
        kinds = postings.join(counted.filter(hot).select("s"), "s", "left_semi").groupBy("o", "m").agg(F.sort_array(F.collect_list("s")).alias("shingles"))
        kinds = stored(kinds.groupBy("shingles").agg(F.min("m").alias("m")).withColumn("o", F.monotonically_increasing_id()), "overlap-kinds")
        kind_index = kinds.select("o", "m", F.explode("shingles").alias("s"))
        order = kind_index.groupBy("s").agg(F.count("*").alias("df"))
        ranked = stored(_ranked(tails.join(order, "s"), "df").select("ord", "s", "pos"), "overlap-members")
        ours = ranked.groupBy("ord").agg(F.collect_list("s").alias("shingles"))
        last = state.select("ord", "n", F.col("hot").alias("count"), "best", F.lit(0).alias("later"))
        state = _rounds(stored(last, "overlap-best"), ranked, kind_index, ours, kinds, "later")

    best = F.when(F.col("best") >= floor, F.col("best")) if floor else F.col("best")
    any_empty = not others.filter("n = 0").isEmpty()
    found = in_class.join(state.select(F.col("ord").alias("first"), best.alias("overlap")), "first").select("ord", "overlap")
    return sets.select("ord", "n").join(found, "ord", "left").select("ord", F.when(F.col("n") == 0, float(any_empty)).otherwise(F.coalesce("overlap", F.lit(0.0))).alias("overlap"))


def decontaminated(sets: DataFrame, contaminants: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Clean ``ord`` and flagged ``ord, overlap`` against the contaminants."""
    found = stored(best_overlap(sets, contaminants, threshold), "overlaps")
    return found.filter(F.col("overlap") < threshold).select("ord"), found.filter(F.col("overlap") >= threshold)


def containment(sets: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Extension: items of which a row holds at least the share ``threshold`` of shingles.

    Such a row holds one of the item's ``m - ceil(t m) + 1`` shingles that are
    rarest among the rows; only those are looked up.
    """
    sets = stored(sets.select("ord", "shingles"), "sets")
    members = sets.select("ord", F.explode("shingles").alias("s"))
    theirs = stored(items.filter(F.size("shingles") > 0).select(F.col("ord").alias("item"), F.size("shingles").alias("m"), "shingles"), "items")
    wanted = theirs.select(F.col("item").alias("ord"), "m", F.explode("shingles").alias("s"))
    counts = members.join(wanted.select("s").distinct(), "s", "left_semi").groupBy("s").agg(F.count("*").alias("df"))
    ranked = _ranked(wanted.join(counts, "s", "left").fillna(0, ["df"]), "df").filter(F.col("pos") <= F.col("m") - F.ceil(F.col("m") * threshold - 1e-9) + 1)
    met = members.join(ranked.select(F.col("ord").alias("item"), "s"), "s").select("ord", "item").distinct()
    both = F.size(F.array_intersect("shingles", "theirs"))
    pairs = met.join(sets, "ord").join(theirs.select("item", "m", F.col("shingles").alias("theirs")), "item").select("ord", "item", "m", both.alias("both"))
    return pairs.filter(F.col("both") >= threshold * F.col("m")).select("ord", "item", F.round(F.col("both") / F.col("m"), 4).alias("share"))
