"""Tokenisers and token-array functions, all built from JVM-side expressions.

Every function takes and returns a Column, so the work stays inside one scan of the texts: no explode and no shuffle
happens before an aggregate asks for one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A letter or digit of any script, or the underscore. Combining marks split words, as Python's \w does.
WORD_CHAR = r"[\p{L}\p{N}_]"


def word_tokens(text: Column, min_len: int = 3) -> Column:
    """Lower-cased runs of at least ``min_len`` Unicode word characters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_CHAR}{{{min_len},}})"), F.lit(1))


def ascii_tokens(text: Column, min_len: int = 2) -> Column:
    """Lower-cased runs of at least ``min_len`` letters a-z; digits, accents and apostrophes split."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{min_len},}})"), F.lit(1))


def drop_words(tokens: Column, words: Iterable[str]) -> Column:
    """Remove every token found in a fixed word list (evaluated as a hash-set test)."""
    words = list(words)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def unigrams_bigrams(tokens: Column) -> Column:
    """The tokens followed by all pairs of neighbours joined with a blank."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(tokens, 1, pairs), F.slice(tokens, 2, pairs), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, bigrams)


def assemble(*parts: Column, sep: str = "\n") -> Column:
    """Join text parts with a separator; null when any part is null."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        pieces += [F.lit(sep), part] if i else [part]
    return F.concat(*pieces)
