"""Fuzzy search of many queries at once, by a posting table of q-grams.

A query of L characters finds a name if at most e = threshold * L edits lead from
it to a part of the name. Each edit spoils at most g grams of g characters, so
the name holds at least L - g + 1 - g * e of the query's grams (counted with
repeats), and one of any so many that fewer are left. Only a query's rarest
grams are looked up; what they find is scored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.session import by_keys, durable_table

THRESHOLD = 0.4
LIMIT = 10
SHORTEST = 2
#: The score of a category's match begins here, as labels weigh four times as much.
CATEGORY_BASE = 0.2
#: So many grams or names of all queries are few.
MOST_BROADCAST = 100_000


def part_score(query: Column, name: Column) -> Column:
    """0 if a name holds a query, else the least edit distance to a part of the query's length, as a share of that length; both in lower case."""
    n = F.length(query)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, n))
    return F.when(F.contains(name, query), 0.0).otherwise(F.array_min(F.transform(windows, lambda x: F.levenshtein(x, query))) / n)


def score(query: Column, label: Column, category: Column) -> Column:
    """0 (the same) to 1: label weighing 2 and category 0.5."""
    return F.least(part_score(query, F.lower(label)), F.lit(CATEGORY_BASE) + (1 - CATEGORY_BASE) * part_score(query, F.lower(category)))


def _sorted_grams(text: Column, size: int) -> Column:
    every = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.array_sort(F.when(F.length(text) >= size, every).otherwise(F.array().cast("array<string>")))


def _numbered(grams: Column, size: int) -> Column:
    """Sorted grams, each with how often it stood before: repeats differ. Give a column that is there already: it would be sorted anew for each gram."""
    return F.transform(grams, lambda g, i: F.concat(F.lit(f"{size}:"), g, F.lit(":"), (i + 1 - F.array_position(grams, g)).cast("string")))


def _small(rows: DataFrame) -> DataFrame:
    """Written rows, to be broadcast if they are few: the other side of their join then stays where it is."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def candidates(queries: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """qid, query and the columns of names: all pairs that may score within the threshold. queries: qid, query; names: name, distinct; both in lower case."""
    n = F.length("query")
    edits = F.floor(n * threshold + 1e-9).cast("int")
    two = n - 1 - 2 * edits
    asked = queries.withColumn("need", F.when(two >= 1, two).otherwise(n - edits)).withColumns({f"_{k}": _sorted_grams(F.col("query"), k) for k in (1, 2)})
    asked = asked.withColumn("grams", F.when(two >= 1, _numbered(F.col("_2"), 2)).otherwise(_numbered(F.col("_1"), 1)))
    asked = durable_table(asked.select("qid", "query", (F.size("grams") - F.col("need") + 1).alias("take"), F.explode("grams").alias("gram")))
    posted = names.withColumns({f"_{k}": _sorted_grams(F.col("name"), k) for k in (1, 2)})
    posted = posted.select(*names.columns, F.explode(F.concat(_numbered(F.col("_1"), 1), _numbered(F.col("_2"), 2))).alias("p_gram"))
    wanted = _small(durable_table(asked.select(F.col("gram").alias("w_gram")).distinct()))
    counts = posted.join(wanted, F.col("p_gram") == F.col("w_gram"), "left_semi").groupBy(F.col("p_gram").alias("c_gram")).count()
    rarest = F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("count", F.lit(0)), "gram"))
    asked = asked.join(counts, F.col("gram") == F.col("c_gram"), "left").withColumn("nth", rarest).filter("nth <= take AND count IS NOT NULL")
    asked = _small(durable_table(asked.select("qid", "query", "gram")))
    return posted.join(asked, F.col("gram") == F.col("p_gram")).select("qid", "query", *names.columns).distinct()


def _best(pairs: DataFrame, asked: DataFrame, column: str, threshold: float, limit: int) -> DataFrame:
    """qid, query, category, label: the best pairs of each query by one column's score, label and category.

    Names are ranked first, each by its least pair, so that only the pairs of as many names as hits are looked up.
    """
    named = by_keys(pairs.withColumn("name", F.lower(column)).filter("name IS NOT NULL"), ["name"])
    names = named.groupBy("name").agg(F.min(F.struct("label", "category")).alias("least"))
    nth = lambda *order: F.row_number().over(Window.partitionBy("qid").orderBy("part", *order))
    scored = candidates(asked, names, threshold).withColumn("part", part_score(F.col("query"), F.col("name")))
    top = scored.withColumn("nth", nth("least")).filter((F.col("nth") <= limit) & (F.col("part") <= threshold + 1e-12)).select("qid", "query", "name", "part")
    found = pairs.join(_small(durable_table(top)), F.lower(column) == F.col("name"))
    return found.withColumn("nth", nth("label", "category")).filter(F.col("nth") <= limit).select("qid", "query", "category", "label")


def search_all(rows: DataFrame, queries: DataFrame, limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """qid, rank, category, label, score: the best hits of each query, by score, label and category; each pair of label and category once.

    rows: category and label; queries: qid (of its own each) and query. Queries of less than two characters have no hits. A
    score is the lesser of two, so that the best hits are among the best by one of them.
    """
    asked = queries.select("qid", F.lower("query").alias("query")).filter(F.length("query") >= SHORTEST)
    pairs = durable_table(rows.select("category", "label").distinct())
    found = _best(pairs, asked, "label", threshold, limit)
    share = (threshold - CATEGORY_BASE) / (1 - CATEGORY_BASE)
    if share >= 0:
        found = found.unionByName(_best(pairs, asked, "category", share, limit)).distinct()
    scored = found.withColumn("score", score(F.col("query"), F.col("label"), F.col("category"))).filter(F.col("score") <= threshold)
    order = Window.partitionBy("qid").orderBy("score", "label", "category")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "rank", "category", "label", "score")
