"""Values made up from a query: phrases, locations and expressions for tool arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ARGUMENT_HINTS, CITIES, GENERATOR_STOP_WORDS, STAND_IN_CITIES, WHOLE_HINTS
from .text import blank, numbers, phrase, tokens


def generator_tokens(text: Column) -> Column:
    """Words of a text without the generator's stop words, in order."""
    stop = F.array(*map(F.lit, GENERATOR_STOP_WORDS))
    return F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))


def task_phrase(query: Column, words: int) -> Column:
    """The first words of a query on one line, or a stand-in where it has none."""
    return F.coalesce(F.nullif(phrase(query, words), F.lit("")), F.lit("the requested task"))


def named_location(text: Column, cities: tuple[str, ...] = CITIES) -> Column:
    """The longest known city that a text names (then the first of the list), else a name after a preposition of place; null without either.

    Cities are told apart from parts of words by Unicode word boundaries.
    """
    ranked = sorted(cities, key=len, reverse=True)
    pattern = r"(?U)\b(?:" + "|".join("\\Q" + c + "\\E" for c in ranked) + r")\b"
    hits = F.regexp_extract_all(F.lower(blank(text)), F.lit(pattern), F.lit(0))
    places = F.array(*map(F.lit, ranked))
    longest = F.array_min(F.transform(hits, lambda h: F.array_position(places, h)))  # they stand longest first
    known = F.initcap(F.try_element_at(places, longest.cast("int")))
    after = F.regexp_extract(blank(text), r"(?U)\b(?:in|at|for|near|to|from)\s+([A-Z][\w.\-]+(?:\s+[A-Z][\w.\-]+)?)", 1)
    name = F.regexp_replace(after, r"(?U)\s+", " ")
    fits = (F.char_length(name) >= 3) & ~F.lower(name).isin(*GENERATOR_STOP_WORDS)
    return F.coalesce(known, F.when(fits, name))


def location(named: Column, seed: Column) -> Column:
    """A named location, or one of the stand-ins by the seed."""
    return F.coalesce(named, F.element_at(F.array(*map(F.lit, STAND_IN_CITIES)), (seed % len(STAND_IN_CITIES) + 1).cast("int")))


def small_numbers(text: Column) -> Column:
    """The numbers of a text under a million either way, cut to whole ones."""
    return F.transform(F.filter(numbers(text), lambda x: F.abs(x) < 1e6), lambda x: x.cast("long"))


def expression(found: Column, seed: Column) -> Column:
    """A sum of the first two numbers found, twice the only one, or a product made from the seed."""
    a, b = (F.try_element_at(found, F.lit(k)).cast("string") for k in (1, 2))
    made = F.concat((seed % 20 + 2).cast("string"), F.lit(" * ("), (F.floor(seed / 7) % 9 + 1).cast("string"), F.lit(" + 1)"))
    return F.when(F.size(found) >= 2, F.concat(a, F.lit(" + "), b)).when(F.size(found) == 1, F.concat(a, F.lit(" * 2"))).otherwise(made)


def value_of(text: Column) -> Column:
    """What an expression of whole numbers, ``+``, ``-``, ``*`` and parentheses comes to (null if it is none): a fold over its tokens with two stacks.

    The state is a stack of frames ``(total, product, sign)``: a number joins
    the product, a sign closes it, a parenthesis opens or closes a frame.
    """
    tokens_ = F.regexp_extract_all(text, F.lit(r"\d+|[-+*()]"), F.lit(0))
    frame = "struct<total:bigint,product:bigint,open:boolean>"

    def one(total: Column, product: Column, is_open: Column) -> Column:
        return F.struct(total.alias("total"), product.alias("product"), is_open.alias("open")).cast(frame)

    zero, unit = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.array(one(zero, unit, F.lit(True)))  # open: a factor is awaited

    def step(stack: Column, t: Column) -> Column:
        def within(bound: Column) -> Column:
            top, below = F.element_at(bound, -1), F.slice(bound, 1, F.size(bound) - 1)

            def put(total: Column, product: Column, is_open: Column) -> Column:
                return F.concat(below, F.array(one(total, product, is_open)))

            closed = top["total"] + top["product"]
            under = F.try_element_at(bound, F.lit(-2))
            folded = F.concat(F.slice(bound, 1, F.greatest(F.size(bound) - 2, F.lit(0))), F.array(one(under["total"], under["product"] * closed, F.lit(False))))
            sign = F.when(t == "-", F.lit(-1)).otherwise(F.lit(1)).cast("long")
            signed = F.when(top["open"], put(top["total"], top["product"] * sign, F.lit(True))).otherwise(put(closed, sign, F.lit(True)))
            return (
                F.when(t == "(", F.concat(bound, start)).when(t == ")", F.when(F.size(bound) > 1, folded)).when(t == "*", put(top["total"], top["product"], F.lit(True)))
                .when(t.isin("+", "-"), signed).otherwise(put(top["total"], top["product"] * t.cast("long"), F.lit(False)))
            )

        return F.element_at(F.transform(F.array(stack), within), 1)

    end = F.aggregate(tokens_, start, step)
    whole = F.regexp_replace(text, r"[-+*()\d\s]", "") == ""
    return F.when(whole & (F.size(end) == 1) & ~end[0]["open"], end[0]["total"] + end[0]["product"])


def hint(name: Column) -> Column:
    """What an argument's name says of its value: ``arith``, ``query``, ``location``, a text, or null."""
    lower, out = F.lower(name), None
    for needle, kind in ARGUMENT_HINTS:
        met = (lower == needle) | F.endswith(lower, F.lit("_" + needle)) if needle in WHOLE_HINTS else F.contains(lower, F.lit(needle))
        out = F.when(met, kind) if out is None else out.when(met, kind)
    return out
