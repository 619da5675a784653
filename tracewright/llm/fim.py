"""Fill-in-the-middle rows from whole texts, in Spark SQL alone.

A text is cut into units (runs of A-Z and a-z, and every other character by
itself). Two cuts drawn from a hash of the id part the units into prefix, middle
and suffix, which are put together with a sentinel before each: prefix, suffix,
middle (``psm``) or suffix, prefix, middle (``spm``). A share of the rows stays
as it is (``plain``). The parts are read back by the sentinels alone, which
:func:`restored` shows.

Everything is a column expression over one row: no shuffle, no Python, and what
is held is one row's text and its units.

Nulls and odd rows: a null text counts as empty; an empty text, and one that
holds a sentinel, stays plain; a null id is hashed as the empty text; repeated
rows and repeated ids get the same cuts; a very long text is cut whole; extra
columns are carried along, but those called like a result give way to it; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = "[A-Za-z]+|[^A-Za-z]"
SENTINELS = ("<P>", "<S>", "<M>")
#: What :func:`transformed` adds.
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be told apart wherever they stand: none lies in or overlaps another or itself."""
    if len(sentinels) != 3 or not all(sentinels) or len(set(sentinels)) < 3 or any("\\E" in s for s in sentinels):
        raise ValueError("three different sentinels are needed")
    for a, b in product(sentinels, sentinels):
        if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    return tuple(sentinels)


def draws(key: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = 1, key: str = "doc_id", text: str = "text", sentinels: tuple[str, str, str] = SENTINELS, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null where plain) and ``output``.

    ``percent`` of the rows are rearranged, ``spm_percent`` of those suffix first.
    """
    p, s, m = _checked(sentinels)
    taken = {c.lower() for c in docs.columns} | set(RESULTS)
    names = []
    for name in ("_body", "_units", "_draws", "_low", "_high", "_prefix", "_middle", "_suffix"):
        while name in taken:
            name += "_"
        names.append(name)
    body, units, drawn, low, high, prefix, middle, suffix = names
    kept = [c for c in docs.columns if c.lower() not in RESULTS or c in (key, text)]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(body), F.array(*draws(F.col(key), seed)).alias(drawn))
    rows = rows.withColumn(units, F.regexp_extract_all(body, F.lit(UNITS), F.lit(0)))
    rows = rows.withColumn("n", F.size(units).cast("long"))
    cuts = [F.col(drawn)[k] % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.withColumns({low: F.least(*cuts).cast("int"), high: F.greatest(*cuts).cast("int")})

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(units, start, length), "")

    whole = (F.col(body) == "") | F.contains(body, F.lit(p)) | F.contains(body, F.lit(s)) | F.contains(body, F.lit(m)) | (F.col(drawn)[2] % 100 >= percent)
    rows = rows.withColumn("form", F.when(whole, "plain").when(F.col(drawn)[3] % 100 < spm_percent, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    rows = rows.withColumns({
        prefix: F.when(cut, part(F.lit(1), F.col(low))),
        middle: F.when(cut, part(F.col(low) + 1, F.col(high) - F.col(low))),
        suffix: F.when(cut, part(F.col(high) + 1, (F.col("n") - F.col(high)).cast("int"))),
    })
    first, second = F.concat(F.lit(p), prefix, F.lit(s), suffix), F.concat(F.lit(s), suffix, F.lit(p), prefix)
    made = F.concat(F.when(F.col("form") == "psm", first).otherwise(second), F.lit(m), middle)
    return rows.select(*kept, "n", "form", F.char_length(prefix).cast("long").alias("prefix_chars"), F.char_length(middle).cast("long").alias("middle_chars"), F.when(cut, made).otherwise(F.col(body)).alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, by its sentinels."""
    pattern = "|".join(f"\\Q{x}\\E" for x in _checked(sentinels))

    def joined(parts: Column) -> Column:
        # what stands before the first sentinel is nothing
        return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))

    # bound as a variable, so the output is parted once
    return F.when(form == "plain", output).otherwise(F.element_at(F.transform(F.array(F.split(output, pattern, -1)), joined), 1))
