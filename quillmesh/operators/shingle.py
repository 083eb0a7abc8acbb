"""Token segments and k-grams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 5
DELIMITERS = ("{", "}", ";")


def segments(tokens: Column, delimiters=DELIMITERS) -> Column:
    """Token arrays between delimiters, empty ones left out. Tokens must not hold the control character U+0001."""
    ends = "|".join(re.escape(d) for d in delimiters)
    text = F.concat(F.lit("\u0001"), F.array_join(tokens, "\u0001\u0001"), F.lit("\u0001"))
    cut = F.filter(F.split(text, f"(?:\u0001(?:{ends})\u0001)+"), lambda s: F.length(s) > 0)
    parts = F.transform(cut, lambda s: F.split(F.substring(s, F.lit(2), F.length(s) - 2), "\u0001\u0001"))
    return F.when(F.size(tokens) > 0, parts).otherwise(F.array().cast("array<array<string>>"))


def grams(tokens: Column, k: int = K) -> Column:
    """The n - k + 1 runs of k tokens without separators; up to k tokens are one run; none gives none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (k - 1), F.lit(1)))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), ""))).otherwise(F.array().cast("array<string>"))


def segmented_grams(docs: DataFrame, tokens: Column, key: str = "doc_id", k: int = K, delimiters=DELIMITERS) -> DataFrame:
    """(key, pos, gram): grams of each segment; positions run on over a document's segments."""
    all_ = F.flatten(F.transform(segments(tokens, delimiters), lambda t: grams(t, k)))
    return docs.select(key, F.posexplode(all_).alias("pos", "gram"))
