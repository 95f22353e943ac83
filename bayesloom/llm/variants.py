"""Spelling variants: words one edit apart, by asymmetric chunks.

The shorter word of a pair (or either of two equally long ones) contributes two disjoint chunks, its halves; the
other contributes its grams of a chunk's length at the chunk's place and, where it is longer by one, shifted by up
to one. An edit spares one of the halves. It hits the other, of which again one of two chunks is spared: a key is
a half and a quarter, so that halves that many words share do not meet word by word. Candidates are verified by
their edit distance, and of the keys that a pair shares only the first one counts, so that no pair comes twice.

Cases: a null text has no runs; a null doc_id is written as nothing before the colon; ties of ``n`` go to the word
that is smallest in code-point order; rows of repeated ids are each counted; an empty table, or one without words
of ``least_n`` occurrences, gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .urls import LOWER, UPPER

RUN = r"[A-Za-zÀ-ÿ]+"

#: Following forms raises the count twofold at each step, so that no chain is longer than a long's bits; six doublings reach its end.
DOUBLINGS = 6


def vocabulary(docs: DataFrame, modulus: int = 97, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """Words of ``docs`` and their number of occurrences ``n``, after one code point goes from some runs of each document."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("w"))
    runs = runs.where(F.length("w") >= least_length)  # deletion makes runs only shorter
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("w")))
    runs = runs.select("w", h.alias("h"))
    at = F.pmod(F.col("h"), F.length("w")).cast("int")
    shorter = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    words = runs.select(F.when(F.pmod(F.col("h"), F.lit(modulus)) == 0, shorter).otherwise(F.col("w")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _cuts(length: Column) -> tuple[Column, Column, Column]:
    """Where the second quarter, the second half and the last quarter of a word of ``length`` begin."""
    half = (length / 2).cast("int")
    return (half / 2).cast("int"), half, half + ((length - half) / 2).cast("int")


def _part(begin: Column, end: Column) -> Column:
    return F.substring("word", begin + 1, end - begin)


def _keys(length: Column, shifts: bool) -> list[Column]:
    """The keys of ``word`` for a partner's chunks, where the chunked word has ``length``.

    Each is a half with one quarter of the rest. With ``shifts`` the word is longer by one, and what stands behind
    the inserted code point is found one place further.
    """
    g, h, k = _cuts(length)
    one = F.lit(1 if shifts else 0)
    zero = F.lit(0)
    end = length + one
    parts = [
        (_part(zero, h), _part(h, k)),
        (_part(zero, h), _part(k + one, end)),
        (_part(zero, g), _part(h + one, end)),
        (_part(g + one, h + one), _part(h + one, end)),
    ]
    return [F.concat(F.lit(f"{i}:"), length.cast("string"), F.lit(":"), *p) for i, p in enumerate(parts)]


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of ``words`` (word, n) that differ by exactly one inserted, deleted or replaced code point, each once.

    Columns: ``a``, ``a_n``, ``b``, ``b_n``; ``b`` is the longer one, or the greater of two equally long ones.
    """
    length = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(*_keys(length, False))).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(*_keys(length, False), *_keys(length - 1, True))).alias("key"))
    la, lb = F.length("a"), F.length("b")
    g, h, k = _cuts(la)
    kind = F.substring("key", 1, 1)
    same = lambda n: F.substring("a", F.lit(1), n) == F.substring("b", F.lit(1), n)
    #: With equal lengths the edited quarter is in all keys but one. Else an earlier key holds as far as the beginnings agree.
    first = (lb == la) | (kind == "0") | ((kind == "1") & ~same(k)) | ((kind == "2") & ~same(h)) | ((kind == "3") & ~same(g))
    met = chunks.join(grams, "key").where((la < lb) | ((la == lb) & (F.col("a") < F.col("b"))))
    return met.where(first & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def _forms(words: DataFrame, ratio: int) -> DataFrame:
    """For words with a near word: ``n_near``, and ``form`` with ``form_n`` where the best near word is ``ratio`` times as frequent."""
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    links = near_pairs(words).select(both.alias("l")).select("l.*")
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    follows = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    return best.select("word", "n_near", F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.minus")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every word that has a form: pointers that double their reach in each round."""
    reach = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = reach.join(onward, "root", "left")
        reach = cut(moved.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        if reach.where("_moved").isEmpty():
            break
        reach = reach.select("word", "root")
    return reach.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """For each of ``words`` (word, n): word, form, root, n, n_near, form_n.

    The form is the near word of largest ``n``, where that is at least ``ratio`` times the word's; the root is
    where following forms ends.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    forms = cut(_forms(words, ratio))
    found = words.join(forms, "word", "left").join(_roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))

