"""String similarities in percent and the composite pair score.

Token sorting, token sets and all bounds are Column expressions. Only the longest common
subsequence itself runs in Python, by bit-parallel arithmetic on Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarrylink.functions.text import number_set


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine step per character of ``b``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        met = rows & places.get(c, 0)
        rows = (rows + met | rows - met) & full
    return len(a) - rows.bit_count()


def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in memo:
            x, y = pair
            memo[pair] = None if x is None or y is None else 100.0 if x == y else 200.0 * common_subsequence(x, y) / (len(x) + len(y))
        out.append(memo[pair])
    return pd.Series(out, dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """100 times twice the common subsequence over both lengths; two empty texts give 100."""
    return F.pandas_udf(_indel, DoubleType())(a, b)


def sorted_tokens(x: Column) -> Column:
    """Tokens between white space, sorted and joined again."""
    return F.array_join(F.array_sort(tokens(x)), " ")


def tokens(x: Column) -> Column:
    """Tokens between white space."""
    return F.array_remove(F.split(x, r"[\s\p{Z}]+"), "")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """``ratio`` of the texts with their tokens sorted."""
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set_parts(a: Column, b: Column) -> Column:
    """What ``token_set_ratio`` needs: both differences as texts, lengths, and whether a side is empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    joined = lambda ts: F.array_join(F.array_sort(ts), " ")
    return F.struct(joined(F.array_except(x, y)).alias("left"), joined(F.array_except(y, x)).alias("right"), F.length(joined(F.array_intersect(x, y))).alias("both"), ((F.size(x) == 0) | (F.size(y) == 0)).alias("empty"))


def token_set_from_parts(parts: Column, difference: Column) -> Column:
    """``token_set_ratio`` from its parts and the ratio of the two differences.

    With a shared beginning of length n the subsequence of whole texts is n, a space, and that
    of the differences; texts of which one is the beginning of the other need no search.
    """
    n, left, right = parts["both"], F.length(parts["left"]), F.length(parts["right"])
    space = (n > 0).cast("int")
    found = difference / 200.0 * (left + right)
    whole = 200.0 * (n + space + found) / (2 * (n + space) + left + right)
    alone = lambda d: 200.0 * n / (2 * n + 1 + d)
    best = F.when(n > 0, F.greatest(whole, alone(left), alone(right))).otherwise(difference)
    return F.when(parts["empty"], F.lit(0.0)).when((n > 0) & ((left == 0) | (right == 0)), F.lit(100.0)).otherwise(best)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of token sets; 100 if one side's set holds the other, 0 if a side is empty."""
    parts = token_set_parts(a, b)
    return token_set_from_parts(parts, ratio(parts["left"], parts["right"]))


def name_score(a: Column, b: Column, token_set: Column, token_sort: Column) -> Column:
    """Names: 65 % token set and 35 % token sort; equal names 100."""
    return F.when(a == b, F.lit(100.0)).otherwise(0.65 * token_set + 0.35 * token_sort)


def number_score(name_a: Column, address_a: Column, name_b: Column, address_b: Column) -> Column:
    """100 if a number is shared, 10 if both have numbers but none is, else 60."""
    x, y = number_set(F.concat_ws(" ", name_a, address_a)), number_set(F.concat_ws(" ", name_b, address_b))
    return F.when(F.arrays_overlap(x, y), F.lit(100.0)).when((F.size(x) > 0) & (F.size(y) > 0), F.lit(10.0)).otherwise(F.lit(60.0))


def composite(name_a: Column, name_b: Column, address_a: Column, address_b: Column, name: Column, token_set: Column, address: Column, number: Column) -> Column:
    """The pair score of its parts; 0 if a name is empty, 30 at most if the names' token sets differ much."""
    both = (address_a != "") & (address_b != "")
    score = F.when(both, 0.50 * name + 0.35 * address + 0.15 * number).otherwise(0.80 * name + 0.20 * number)
    score = F.when(token_set < 45, F.least(score, F.lit(30.0))).otherwise(score)
    return F.when((name_a == "") | (name_b == ""), F.lit(0.0)).otherwise(score)
