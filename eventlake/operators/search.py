"""Full-text search of page bodies: words in any order, implicit AND, the keyword OR."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(body: Column) -> Column:
    """The distinct lower-case words of a text (letters and digits of ASCII)."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(body, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def parse(query: str) -> list[list[str]]:
    """A query as alternatives of words that must all occur: "a b OR c" is [[a, b], [c]]."""
    groups: list[list[str]] = [[]]
    for word in query.split():
        if word == "OR":
            groups.append([])
        else:
            groups[-1] += [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in word.lower()).split()]
    return [g for g in groups if g]


def matches(tokens: Column, query: str) -> Column:
    groups = parse(query)
    if not groups:
        return F.lit(False)
    every = [reduce(lambda a, b: a & b, [F.array_contains(tokens, w) for w in g]) for g in groups]
    return reduce(lambda a, b: a | b, every)


def search(pages: DataFrame, body_col: str, query: str) -> DataFrame:
    """The pages that match: a filter in the scan's stage, no shuffle."""
    return pages.where(matches(words(F.col(body_col)), query))


def postings(pages: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(word, id): the inverted index, for repeated queries."""
    return pages.select(F.explode(words(F.col(body_col))).alias("word"), id_col)


def search_postings(index: DataFrame, id_col: str, query: str) -> DataFrame:
    """Ids that match, from an index: a semi-filter on the words and a count per id."""
    groups = parse(query)
    found = None
    for group in groups:
        need = sorted(set(group))
        hit = index.where(F.col("word").isin(need)).groupBy(id_col).agg(F.count_distinct("word").alias("n_")).where(F.col("n_") == len(need)).select(id_col)
        found = hit if found is None else found.union(hit)
    return found.distinct() if found is not None else index.select(id_col).limit(0)
