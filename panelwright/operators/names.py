"""Entity names in any spelling: accent folding, aliases, ordered patterns.

A name is looked up in three steps: as it stands (case, accents, punctuation
and blanks aside), through a bounded alias dictionary, and through patterns
built from the canonical names themselves.  A pattern asks for every word of
the canonical name, in any order, as the beginning of a word of the name looked
up ("Iran, Islamic Rep." matches "Iran (Islamic Republic of)"); of several that
match, the one with most words wins.  Names and patterns meet by an equi-join
on a word beginning, never by a cross product.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEM = 3                                          # letters of a word by which names and patterns meet
# letters that Unicode does not decompose
_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "ð": "d", "ħ": "h"}


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the plain letters under them, by Unicode's own decomposition."""
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    pairs = {c: p for c, p in plain.items() if p != c and p.isascii()} | {c: p for c, p in _LIGATURES.items() if len(p) == 1}
    return "".join(pairs), "".join(pairs.values())


def fold_accents(c: Column | str) -> Column:
    """Lower-case text without accents: marked Latin letters become plain ones,
    combining marks go, ligatures are written out."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    marked, plain = _folds()
    c = F.regexp_replace(F.translate(c, marked, plain), r"\p{M}+", "")
    for letter, spelled in _LIGATURES.items():
        if len(spelled) > 1:
            c = F.replace(c, F.lit(letter), F.lit(spelled))
    return c


def name_words(c: Column | str) -> Column:
    """Folded name as words of letters and digits, joined by one blank; text in
    brackets after the name counts, full stops and apostrophes do not part words."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold_accents(c), r"['’`.]+", ""), r"[^\p{L}\p{N}]+", " "))


def normalised_name(c: Column | str) -> Column:
    """Folded name without anything but letters and digits, a lookup key."""
    return F.replace(name_words(c), F.lit(" "), F.lit(""))


def resolve_names(df: DataFrame, column: str, canonical: DataFrame, canonical_col: str, aliases: DataFrame | None = None,
                  out: str = "canonical", how: str = "matched_by") -> DataFrame:
    """``df`` with ``out`` (canonical name, NULL if none matches) and ``how``
    ("name", "alias", "pattern" or NULL).

    Every row stays once.  ``aliases`` (``alias, canonical``) is a bounded
    literal table; a repeated alias keeps its least canonical name.  Equal keys
    of canonical names keep the least name."""
    key = normalised_name
    known = canonical.select(F.col(canonical_col).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    direct = known.groupBy(key("_name").alias("_key")).agg(F.min("_name").alias("_direct")).where(F.col("_key") != "")
    names = df.select(F.col(column).alias("_raw")).where(F.col("_raw").isNotNull()).distinct()
    names = names.withColumn("_key", key("_raw")).join(direct, "_key", "left")
    if aliases is None:
        names = names.withColumn("_alias", F.lit(None).cast("string"))
    else:
        fixed = aliases.groupBy(key("alias").alias("_key")).agg(F.min("canonical").alias("_alias"))
        names = names.join(F.broadcast(fixed), "_key", "left")
    stem = lambda w: F.substring(w, 1, STEM)
    patterns = known.select("_name", F.split(name_words("_name"), " ").alias("_words"))
    patterns = patterns.withColumn("_anchor", F.array_max(F.transform("_words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    patterns = patterns.where(F.length("_anchor") >= STEM).select("_name", "_words", stem(F.col("_anchor")).alias("_stem"))
    asked = names.where(F.col("_direct").isNull() & F.col("_alias").isNull()).select("_raw", F.split(name_words("_raw"), " ").alias("_has"))
    met = (asked.withColumn("_stem", F.explode(F.array_distinct(F.transform("_has", stem)))).join(patterns, "_stem")
           .where(F.forall("_words", lambda w: F.exists("_has", lambda h: F.startswith(h, w)))))
    best = met.groupBy("_raw").agg(F.min_by("_name", F.struct(-F.size("_words"), "_name")).alias("_pattern"))
    names = names.join(best, "_raw", "left").select(
        "_raw", F.coalesce("_direct", "_alias", "_pattern").alias(out),
        F.when(F.col("_direct").isNotNull(), "name").when(F.col("_alias").isNotNull(), "alias").when(F.col("_pattern").isNotNull(), "pattern").alias(how))
    return df.join(names, df[column] == names["_raw"], "left").drop("_raw")
