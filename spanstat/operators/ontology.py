"""Ancestors in an is_a hierarchy, and terms for free names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanstat.functions.names import candidates, normalised, word_set
from spanstat.session import checkpointed


def ancestors(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, ancestor) of all is_a edges (child, parent), each node its own ancestor.

    Path doubling: a round joins the closure with itself, so there are as many
    rounds as the logarithm of the depth; a cycle ends by itself.
    """
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    e = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    known = nodes.select("node", F.col("node").alias("ancestor")).union(e).distinct()
    n = known.count()
    for _ in range(most):
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor")
        known = checkpointed(further.distinct())
        if (now := known.count()) == n:
            break
        n = now
    return known


def match_names(names: DataFrame, terms: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """name, term and kind of match: exact_name, exact_synonym, word_subset or word_subset_synonym.

    ``names`` has name; ``terms`` has term, text and synonym (boolean). The forms of a
    name are tried from the most to the least specific, exact before word subsets; of
    subsets the shortest text wins, then the least term. Names that hold a word of
    ``skip`` only match exactly. Words are compared through an index on the word, so
    names and terms aren't paired.
    """
    forms = names.select("name", F.posexplode(candidates(F.col("name"))).alias("rank", "form"))
    known = terms.select("term", "synonym", normalised(F.col("text")).alias("text"))
    exact = forms.join(known, forms["form"] == known["text"]).select("name", "term", F.when(F.col("synonym"), "exact_synonym").otherwise("exact_name").alias("kind"), F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"), F.col("synonym").cast("int").alias("c"), F.lit(0).alias("d"), F.col("term").alias("e")).alias("cost"))
    loose = forms.where(F.length("form") >= 5)
    for word in skip:
        loose = loose.where(~normalised(F.col("name")).contains(word))
    asked = loose.withColumn("words", word_set(F.col("form"))).where(F.size("words") > 0).select("name", "rank", "words", F.explode("words").alias("word"))
    index = known.select("term", "synonym", "text", F.explode(word_set(F.col("text"))).alias("word"))
    hits = asked.join(index, "word").groupBy("name", "rank", F.size("words").alias("n"), "term", "synonym", "text").agg(F.count("*").alias("k")).where("n = k")
    loose = hits.select("name", "term", F.when(F.col("synonym"), "word_subset_synonym").otherwise("word_subset").alias("kind"), F.struct(F.lit(1).alias("a"), F.col("rank").alias("b"), F.col("synonym").cast("int").alias("c"), F.length("text").alias("d"), F.col("term").alias("e")).alias("cost"))
    best = exact.unionByName(loose).groupBy("name").agg(F.min_by(F.struct("term", "kind"), "cost").alias("m"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.col("m.term").alias("term"), F.col("m.kind").alias("kind"))
