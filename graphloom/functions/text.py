"""Text functions: token counts, tokenisers, trigrams, Jaro-Winkler."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def char_tokens(text: Column | str) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(_c(text)) / 4).cast("long")


def bpe_tokens(df: DataFrame, text: str, vocabulary: str, pattern: str, out: str = "tokens") -> DataFrame:
    """df with the number of BPE tokens of a column; vocabulary is a file of base64 ranks on the driver."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in parts:
            yield s.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    return df.withColumn(out, count(text))


#: Pre-tokenisers of the public byte-level vocabularies.
BPE_PATTERNS = {
    "cl100k": r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s""",
    "o200k": "|".join(
        [
            r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
            r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
            r"""\p{N}{1,3}""",
            r""" ?[^\s\p{L}\p{N}]+[\r\n/]*""",
            r"""\s*[\r\n]+""",
            r"""\s+(?!\S)""",
            r"""\s+""",
        ]
    ),
}


def count_tokens(df: DataFrame, text: str, kind: str = "char", vocabulary: str | None = None, out: str = "tokens") -> DataFrame:
    """df with token counts: char, cl100k or o200k by their vocabulary file, or exact, which counts characters without one."""
    if kind in BPE_PATTERNS:
        if vocabulary is None:
            raise ValueError(f"{kind} needs its vocabulary file")
        return bpe_tokens(df, text, vocabulary, BPE_PATTERNS[kind], out)
    if kind not in ("char", "exact"):
        raise ValueError(f"no token counter {kind}")
    if kind == "exact" and vocabulary is not None:
        return bpe_tokens(df, text, vocabulary, BPE_PATTERNS["cl100k"], out)
    return df.withColumn(out, char_tokens(text))


def search_tokens(text: Column | str) -> Column:
    """Lower-case words of letters and digits that have two bytes or more."""
    words = F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: F.octet_length(w) >= 2)


def rerank_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))


def trigrams(text: Column | str) -> Column:
    """Lower-case character trigrams with repeats; a shorter string is its own."""
    low = F.lower(_c(text))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) < 3, F.array(low)).otherwise(many)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro with a bonus of a tenth for each of up to four equal first characters, where Jaro is over 0.7."""
    score = jaro(a, b)
    if score <= 0.7:
        return score
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return score + 0.1 * prefix * (1 - score)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


def same_name(a: Column, b: Column, threshold: float) -> Column:
    """Equal but for case, or Jaro-Winkler of the lower-case forms at or over the threshold."""
    return (F.lower(a) == F.lower(b)) | (jaro_winkler(F.lower(a), F.lower(b)) >= threshold)
