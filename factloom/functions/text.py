"""Column expressions over text: tokens, signal words, hashes, slugs. All native, so they stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1
_EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
CAUSAL_SIGNALS = tuple(sorted("because|caused by|chain|consequence of|depends on|downstream|enables|led to|root cause|therefore|upstream".split("|")))
TEMPORAL_SIGNALS = tuple(sorted("active|after|as of|before|changed|current|currently|history|latest|now|recent|recently|since|still|was|when did".split("|")))


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Search tokens: lower-cased runs of letters and digits of at most 40 bytes; none for null."""
    parts = F.split(F.lower(F.coalesce(column(c), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda x: (x != "") & (F.octet_length(x) <= 40))


def signal(c: Column | str, phrases) -> Column:
    """Whether a text has one of the phrases: those with a blank anywhere, single words as whole tokens without punctuation."""
    low = F.lower(F.coalesce(column(c), F.lit("")))
    words = F.transform(F.split(low, r"[ \t\n\r\f]+"), lambda w: F.regexp_replace(w, _EDGES, ""))
    found = F.lit(False)
    single = [p for p in phrases if " " not in p]
    if single:
        found = F.arrays_overlap(words, F.array(*map(F.lit, single)))
    for phrase in phrases:
        if " " in phrase:
            found = found | low.contains(phrase)
    return found


def is_causal(c: Column | str) -> Column:
    """Whether any causal phrase occurs, as a substring."""
    low = F.lower(F.coalesce(column(c), F.lit("")))
    found = F.lit(False)
    for phrase in CAUSAL_SIGNALS:
        found = found | low.contains(phrase)
    return found


def causal_pattern(c: Column | str) -> Column:
    """backward, forward or chain."""
    low = F.lower(column(c))

    def any_of(*phrases):
        return F.greatest(*(low.contains(p) for p in phrases))

    return F.when(any_of("root cause", "upstream", "caused by"), "backward").when(any_of("downstream", "enables", "consequence of"), "forward").otherwise("chain")


def temporal_pattern(c: Column | str) -> Column:
    """since, history or current."""
    low = F.lower(column(c))
    return F.when(low.contains("since"), "since").when(low.rlike("what happened|when did|changed|history"), "history").otherwise("current")


def since_year(c: Column | str) -> Column:
    """The first token that is a year from 2000 to 2100, or null."""
    words = F.transform(F.split(column(c), r"\s+"), lambda w: F.regexp_replace(w, _EDGES, ""))
    years = F.filter(words, lambda w: w.rlike(r"^(20\d\d|2100)$"))
    return F.try_element_at(years, F.lit(1)).cast("int")


def fnv1a64(c: Column | str) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a long with the same bits, in two halves so that nothing overflows."""
    raw = F.hex(F.encode(column(c), "UTF-8"))
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, at: Column) -> Column:
        byte = F.conv(raw.substr(at, F.lit(2)), 16, 10).cast("long")
        low = acc["lo"].bitwiseXOR(byte)
        product = low * 435  # the prime is 2**40 + 435
        high = (acc["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(_MASK)
        return F.struct(high.alias("hi"), product.bitwiseAND(_MASK).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(places, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


def slug(c: Column | str) -> Column:
    """First six words, lower case, runs of other characters as one hyphen, 60 characters at most."""
    words = F.filter(F.split(F.trim(column(c)), r"\s+"), lambda w: w != "")
    joined = F.array_join(F.slice(words, 1, 6), "-")
    plain = F.regexp_replace(F.regexp_replace(F.lower(joined), "[^a-z0-9-]", "-"), "-+", "-")
    return F.rtrim(F.substring(F.regexp_replace(plain, "-+$", ""), 1, 60), F.lit("-"))


def glob(pattern: Column, value: Column) -> Column:
    """``*`` matches all, even null; a trailing star is a prefix; else equality."""
    prefix = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    return F.when(pattern == "*", True).when(value.isNull(), False).when(F.endswith(pattern, F.lit("*")), F.startswith(value, prefix)).otherwise(pattern == value)
