"""Quality rules, line first: lines that fail go, then documents that lost too much text.

Every rule is a column expression over one row; no text leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, words

# What a line of prose may end with, and phrases of page furniture (lower case).
ENDINGS = ".!?:;…\"'”’»)]؟۔।॥።。！？：；」』）"
BOILERPLATE = [
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of service",
    "terms of use", "subscribe to our", "sign up for", "click here", "read more", "share this",
    "follow us", "skip to content", "back to top", "powered by", "lorem ipsum",
]
_SYMBOLS = r"[#*$%&|<>]"


_PLACE_BITS = 20


def n_repeat_words(found: Column) -> Column:
    """Words of an array that stand in 3-word windows found twice or more in it, the first included.

    Windows are sorted as longs: a hash of their words above, their place below. Of repeated
    ones the words themselves are compared; should a hash cover different windows, or the
    places need more bits, the windows of that text are sorted by their words instead.
    """
    high = lambda x: F.shiftright(x, _PLACE_BITS)
    either = lambda same, s: lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))

    def covered(p: Column) -> Column:
        gap = F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        repeated = lambda s: F.sort_array(F.transform(F.filter(s, either(same, s)), lambda x: x["i"]))
        return let(F.sort_array(windows), lambda s: let(repeated(s), covered))

    def by_hash(w: Column) -> Column:
        packed = lambda i: F.shiftleft(high(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), _PLACE_BITS).bitwiseOR(i.cast("long"))
        place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
        alike = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        def verdict(kept: Column) -> Column:
            clash = F.filter(kept, lambda x, k: (k > 0) & (high(x) == high(F.get(kept, k - 1))) & ~alike(place(x), place(F.get(kept, k - 1))))
            return F.when(F.size(clash) > 0, by_words(w)).otherwise(let(F.sort_array(F.transform(kept, place)), covered))

        repeated = lambda s: F.filter(s, either(lambda x, y: high(x) == high(y), s))
        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), packed)), lambda s: let(repeated(s), verdict))

    n = lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) < (1 << _PLACE_BITS), by_hash(w)).otherwise(by_words(w))
    return let(found, n)


def line_fails(line: Column, furnished: Column) -> Column:
    """Whether a line fails a rule: punctuation, navigation or boilerplate. Blank lines never fail.

    furnished: whether any line of the text may hold a phrase of BOILERPLATE.
    """
    text = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    n = F.length(text)
    n_words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != F.lit("")))
    count = lambda pattern: n - F.length(F.regexp_replace(text, pattern, ""))
    unended = ~F.substring(text, -1, 1).isin(*ENDINGS) & n_words.between(4, 20)
    marked = text.rlike(r"[#*$%&|<>!»›•·]") & ((count(_SYMBOLS) * 10 > n) | (count("!") * 3 > n_words + 3) | (count(r"[|»›•·]") * 4 > n_words))
    known = furnished & F.lower(text).rlike("|".join(BOILERPLATE)) & (n_words <= 12)
    return (n > 0) & (unended | marked | known)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.3) -> DataFrame:
    """doc_id, base figures, lost_chars, clean_text, base_failed and kept for every row.

    Null and empty texts have no words: their figures are 0, and they fail. Lines are what \\n
    separates. A document is kept if the base rules pass it and its failing lines have at most
    most_lost of its characters outside white space. Repeated rows get equal results; an
    empty table gives no rows; other columns of docs are ignored.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    solid = lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    counted = let(words(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("repeats")))
    furnished = let(F.lower(text), lambda t: functools.reduce(Column.__or__, [t.contains(x) for x in BOILERPLATE]))
    found = rows.select(
        "doc_id",
        "_text",
        counted.alias("_counted"),
        solid(text).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(furnished, lambda may: F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x, may)), "\n")).alias("clean_text"),
    )
    found = found.select("doc_id", F.col("_counted.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_counted.repeats").alias("n_repeat_words"), "clean_text", "_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.when(F.col("clean_text") == text, F.lit(0)).otherwise(F.col("word_chars") - solid(F.col("clean_text")))
    found = found.withColumn("lost_chars", lost.cast("long")).drop("_text")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_chars") <= most_lost * F.col("word_chars")))
