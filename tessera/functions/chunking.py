"""Chunks of a text as an array column."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 100, 20
SLIDING, EXACT = "sliding_window", "exact_match"
#: Strategies that are accepted but cut like SLIDING.
FALLBACK = ("sentence_aware", "paragraph")
#: Unicode white space, spelled out so that every regex engine agrees.
WHITE = r"[\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def effective_overlap(size: Column, overlap: Column) -> Column:
    """An overlap that is not smaller than the size becomes a quarter of the size."""
    return F.when(overlap >= size, F.floor(size / 4)).otherwise(overlap).cast("int")


def words(text: Column) -> Column:
    """What stands between white space; none for blank texts. Only the first and the last part can be empty."""
    parts = F.split(text, WHITE)
    first, last = (F.when(F.get(parts, i) == "", 1).otherwise(0) for i in (F.lit(0), F.size(parts) - 1))
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def windows_of(w: Column, size: Column, overlap: Column) -> Column:
    """Windows of ``size`` words that share ``overlap``, ending with the first that reaches the last word; none without words.

    ``w`` should be a column made in an earlier projection: each window reads it,
    and an expression would be evaluated again for each. A size of 0 gives an
    empty chunk for each word, as a step is one word at least.
    """
    n, step = F.size(w), F.greatest(F.lit(1), size - overlap)
    last = F.when(size == 0, n - 1).otherwise(F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int") * step)
    starts = F.sequence(F.lit(0), last, step)
    cut = F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))
    return F.when(w.isNull() | (n <= 0), F.array().cast("array<string>")).otherwise(cut)


def explode_chunks(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, strategy: str = SLIDING) -> DataFrame:
    """``docs`` without the text, a row for each chunk: pos from 0, and chunk.

    EXACT keeps a text as it is, even blank; any other strategy cuts sliding windows.
    """
    rest = [c for c in docs.columns if c != text]
    if strategy == EXACT:
        return docs.select(*rest, F.posexplode(F.array(text)).alias("pos", "chunk"))
    if strategy != SLIDING:
        logging.getLogger(__name__).warning("strategy %r cuts sliding windows", strategy)
    over = overlap if overlap < size else size // 4
    split = docs.select(*rest, words(F.col(text)).alias("_words"))
    return split.select(*rest, F.posexplode(windows_of(F.col("_words"), F.lit(size), F.lit(over))).alias("pos", "chunk"))
