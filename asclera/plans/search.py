"""Ranked text search: term weights by BM25, one query or many, with attribute filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..functions import text as tx
from ..operators import joins, partitions, windows
from ..session import kept

K1 = 1.2
B = 0.75


def corpus(df: DataFrame, key: str, search: str | None = None, attributes: list[str] | None = None) -> DataFrame:
    """Key, search text and attributes of a searchable table."""
    column = search or naming.search_column(df)
    return df.select(key, F.col(column).alias("search_text"), *naming.attribute_columns(df, column, attributes))


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def matching(filters: Mapping[str, object] | None) -> Column:
    """Equality on every filtered attribute; a list means any of its values."""
    condition = F.lit(True)
    for c, v in (filters or {}).items():
        condition = condition & (F.col(c).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(c) == v)
    return condition


def _occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == term))


def _mentions(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms], F.lit(False))


def _any_of(tokens: str, terms: list[str]) -> Column:
    return F.exists(tokens, lambda w: w.isin(terms))


def _ranking(key: str) -> list[Column]:
    """Best first; copies of a text tie and go by key, whatever the last digit of their scores."""
    return [F.round("score", 9).desc(), F.col(key)]


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _idf(total: Column, found: Column) -> Column:
    return F.ln(1 + (total - found + 0.5) / (found + 0.5))


def search(
    docs: DataFrame, key: str, text: str, query: str, columns: Sequence[str] = (), filters: Mapping[str, object] | None = None, n: int = 10
) -> DataFrame:
    """Best documents for a query.

    Term counts are read off each text in place, so nothing but the n best rows is
    shuffled. Weights use the whole collection; the filter limits what is returned.
    """
    terms = query_terms(query)

    def counts(rows: DataFrame) -> DataFrame:
        tokens = rows.select(key, *columns, tx.words(text).alias("_t"))
        return tokens.select(
            key, *columns, F.size("_t").alias("_n"), *[_occurrences("_t", t).alias(f"_tf{i}") for i, t in enumerate(terms)]
        )

    stats = counts(partitions.spread(docs)).agg(
        F.count("*").alias("total"), F.avg("_n").alias("mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    )
    one = F.col("_one")
    score = sum(
        (_idf(one["total"], one[f"df{i}"]) * _weight(F.col(f"_tf{i}"), F.col("_n"), one["mean"]) for i in range(len(terms))), F.lit(0.0)
    )
    # a plain substring test at the scan drops most texts; zero scores go after the limit,
    # since a filter on the score itself would be evaluated once more below
    possible = partitions.spread(docs.filter(matching(filters)).filter(_mentions(F.col(text), terms)))
    best = joins.with_row(counts(possible), stats).withColumn("score", score).orderBy(*_ranking(key)).limit(n)
    return best.filter("score > 0").select(key, *columns, "score")


#: Blocks per unit of a word's weight in a document; weights are below ``K1 + 1``.
LEVELS = 16
#: Words of a query whose best documents give the first bound on its n-th score.
LEADING = 4
#: Blocks to read, over all queries, that are sent to every task.
BLOCKS = 500_000
#: Pairs of a query and a document that a partition scores together, on average.
PAIRS = 500_000
#: Documents per asked result whose full scores give the second bound.
PROMISING = 10
#: More than the rounding errors of a sum of weights.
SLACK = 1e-6


def build_index(docs: DataFrame, key: str, text: str, path: str, buckets: int = 256) -> str:
    """Store an impact-ordered index: word weights in blocks of falling weight, and a table of the blocks.

    A posting's weight is the part of its score that depends on the document; a block
    holds the postings of a word whose weights lie in one sixteenth. ``blocks`` has each
    block's size and greatest weight. Postings are placed by word bucket; rows of a
    bucket are dealt out by document as well, since a frequent word may hold a large
    share of all rows, and lie by word and falling weight within a file. Texts are
    split once: the mean length follows from the words' counts. ``stats`` has the number
    of texts and the largest number under one key.
    """
    spark = docs.sparkSession
    sized = partitions.spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("_x"))).select("doc", tx.words("_x").alias("_t"))
    kind = docs.schema[key].dataType.simpleString()
    rows = sized.select("doc", F.size("_t").alias("length"), F.explode("_t").alias("term"))
    counts = rows.groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    texts = docs.agg(F.count("*").alias("total"), F.count(text).alias("texts"))
    # the counts' shuffle is read twice
    length = texts.join(counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))).select(F.when(F.col("texts") > 0, F.col("words") / F.col("texts")).alias("mean"))
    # small whole numbers travel better than weights, levels and buckets, which follow from them
    dealt = counts.select("doc", F.col("length").cast("int"), "term", F.col("tf").cast("int")).repartition(bucket, F.pmod(F.xxhash64("doc"), F.lit(16)))
    weighed = joins.with_row(dealt, length).select("doc", "term", _weight(F.col("tf").cast("bigint"), F.col("length"), F.col("_one")["mean"]).alias("weight"))
    placed = weighed.withColumns({"level": F.floor(F.col("weight") * LEVELS).cast("int"), "bucket": bucket})
    dealt = placed.sortWithinPartitions("bucket", "term", F.desc("weight"))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/words")
    written = spark.read.schema(f"doc {kind}, term string, weight double, level int, bucket int").parquet(f"{path}/words")
    blocks = written.groupBy("bucket", "term", "level").agg(F.max("weight").alias("top"), F.count("*").alias("size"))
    blocks.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    per_key = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(1)).alias("most"))
    stats = texts.join(per_key).select("total", "most")
    stats.withColumns({"buckets": F.lit(buckets), "kind": F.lit(kind)}).write.mode("overwrite").parquet(f"{path}/stats")
    return path


class Index:
    """A stored index, narrowed to the buckets of the words that are asked for."""

    def __init__(self, spark: SparkSession, path: str, terms: DataFrame):
        row = spark.read.parquet(f"{path}/stats").first()
        self.total, self.most, buckets = row["total"], row["most"], row["buckets"]
        # at most ``buckets`` numbers
        places = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]
        inside = F.col("bucket").isin(places)
        words = spark.read.schema(f"doc {row['kind']}, term string, weight double, level int, bucket int").parquet(f"{path}/words")
        blocks = spark.read.schema("term string, level int, top double, size bigint, bucket int").parquet(f"{path}/blocks")
        self.postings = words.filter(inside).select("term", "level", "doc", "weight")
        self.blocks = blocks.filter(inside).select("term", "level", "top", "size")


class BlockMax:
    """Exact best documents of many queries that leaves blocks unread where they cannot matter.

    A query's words are ordered by the most that each can add. A document is found
    through the first of its words in that order, so a block must be read only if its
    greatest weight and all that later words can add reach the query's bound: a score
    that n documents are known to reach. What is read gives every document an upper
    bound; the most promising ones, scored in full, raise the query's bound, and only
    those that may still reach it are scored in full. What is known of the queries'
    words is small beside the postings, which are so read where they lie.
    """

    def __init__(self, index: Index, asked: DataFrame, n: int):
        """``asked`` has distinct rows of query_id and term."""
        self.index, self.n = index, n
        of_query = Window.partitionBy("query_id").orderBy(F.desc("best"), "term")
        known = kept(index.blocks.join(asked.select("term").distinct(), "term", "left_semi"))
        terms = known.groupBy("term").agg(F.sum("size").alias("df"), F.max("top").alias("top")).withColumn("idf", _idf(F.lit(index.total), F.col("df")))
        # the window holds one query's words
        words = (
            asked.join(terms, "term")
            .withColumn("best", F.col("idf") * F.col("top") * index.most)
            .withColumns({"place": F.row_number().over(of_query), "rest": F.sum("best").over(of_query.rowsBetween(1, Window.unboundedFollowing))})
            .select("query_id", "term", "idf", "place", F.coalesce("rest", F.lit(0.0)).alias("rest"))
        )
        self.words = kept(words)
        self.known = known

    def scored(self, found: DataFrame) -> DataFrame:
        """Full scores of pairs of query_id and doc; of few documents no other postings are shuffled."""
        found = kept(found)
        wanted = found.join(joins.small(self.words.select("query_id", "term", "idf")), "query_id")
        docs = found.select("doc").distinct()
        postings = self.index.postings
        if docs.limit(joins.SMALL_ROWS + 1).count() <= joins.SMALL_ROWS:
            postings = postings.join(F.broadcast(docs), "doc", "left_semi")
        hits = wanted.join(postings, ["doc", "term"])
        return hits.groupBy("query_id", "doc").agg(F.sum(F.col("idf") * F.col("weight")).alias("score"))

    def bounds(self) -> DataFrame:
        """Per query a score that n documents reach: the best documents of its leading words, in full."""
        leading = self.words.filter(F.col("place") <= LEADING).select("query_id", "term")
        level = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
        head = self.known.join(leading.select("term").distinct(), "term", "left_semi").withColumn("above", F.coalesce(F.sum("size").over(level), F.lit(0)))
        first = self.index.postings.join(joins.small(head.filter(F.col("above") < self.n).select("term", "level")), ["term", "level"])
        few = windows.top_per_group(first, ["term"], [F.desc("weight"), F.col("doc")], self.n).select("term", "doc")
        seeds = leading.join(few, "term").select("query_id", "doc").distinct()
        return self.reached(seeds)

    def reached(self, found: DataFrame) -> DataFrame:
        """Per query the score that n of the given documents reach, if it has as many."""
        ranked = windows.top_per_group(self.scored(found), ["query_id"], [F.desc("score")], self.n)
        return ranked.filter(F.col("rank") == self.n).select("query_id", (F.col("score") - SLACK).alias("bound"))

    def cuts(self) -> DataFrame:
        """Per query and word: the blocks to read, and the most that the word adds in an unread one."""
        asked = self.words.join(self.bounds(), "query_id", "left")
        reach = F.col("idf") * F.col("top") * self.index.most + F.col("rest") >= F.coalesce("bound", F.lit(0.0))
        each = asked.join(self.known, "term").withColumn("read", reach)
        return each.groupBy("query_id", "term", "idf", "bound").agg(
            F.collect_list(F.when(F.col("read"), F.col("level"))).alias("levels"),
            F.coalesce(F.max(F.when(~F.col("read"), F.col("idf") * F.col("top"))), F.lit(0.0)).alias("unread"),
        )

    def pairs(self, cuts: DataFrame) -> DataFrame:
        """A row per query and posting of the blocks that are read."""
        wanted = cuts.select("query_id", "term", "idf", "unread", F.explode("levels").alias("level"))
        return self.index.postings.join(joins.small(wanted, BLOCKS), ["term", "level"])

    def best(self) -> DataFrame:
        cuts = kept(self.cuts())
        limits = cuts.groupBy("query_id").agg((F.sum("unread") * self.index.most).alias("unread"), F.coalesce(F.max("bound"), F.lit(0.0)).alias("bound"))
        # several texts under one key may hold a word in read and in unread blocks
        spared = F.col("unread") if self.index.most == 1 else F.lit(0.0)
        gains = kept(self.pairs(cuts).groupBy("query_id", "doc").agg(F.sum(F.col("idf") * F.col("weight") - spared).alias("gain")))
        reachable = gains.join(joins.small(limits), "query_id").filter(F.col("gain") + F.col("unread") >= F.col("bound") - SLACK)
        first = windows.top_per_group(reachable.filter(F.col("doc").isNotNull()), ["query_id"], [F.desc("gain"), F.col("doc")], PROMISING * self.n)
        higher = self.reached(first.select("query_id", "doc")).withColumnRenamed("bound", "higher")
        possible = reachable.join(joins.small(kept(higher)), "query_id", "left").filter(F.col("gain") + F.col("unread") >= F.coalesce("higher", F.lit(0.0)) - SLACK)
        return windows.top_per_group(self.scored(possible.select("query_id", "doc")), ["query_id"], _ranking("doc"), self.n)


def search_index(spark: SparkSession, path: str, query: str, n: int = 10) -> DataFrame:
    """Best documents for a query from a stored index; only buckets and blocks that matter are read."""
    terms = query_terms(query)
    asked = spark.createDataFrame([(0, t) for t in terms], "query_id int, term string")
    best = BlockMax(Index(spark, path, asked), asked, n).best()
    return best.select("doc", "score").orderBy(*_ranking("doc"))


def asked_words(queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """Distinct words of every query."""
    return queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(tx.words(query_text))).alias("term"))


def search_many_index(spark: SparkSession, path: str, queries: DataFrame, query_key: str, query_text: str, key: str, n: int = 10) -> DataFrame:
    """Best documents for each query of a table from a stored index, exact."""
    asked = asked_words(queries, query_key, query_text)
    best = BlockMax(Index(spark, path, asked), asked, n).best()
    return best.select("query_id", F.col("doc").alias(key), "score", "rank")


def search_many(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """Best documents for each query of a table.

    Only words that some query uses leave a text. Rows are placed by document, where
    counting and scoring happen without another shuffle, and each partition keeps
    its n best per query before the final ranking.
    """
    asked = queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(tx.words(query_text))).alias("term"))
    vocabulary = asked.select("term").distinct()
    sized = partitions.spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("_x"))).select("doc", tx.words("_x").alias("_t")).withColumn("_n", F.size("_t"))
    stats = sized.agg(F.count("*").alias("total"), F.avg("_n").alias("mean"))
    # the outer form keeps Spark from testing the token array at the scan as well
    hits = sized.select("doc", "_n", F.explode_outer("_t").alias("term")).join(joins.small(vocabulary), "term")
    # a partition makes about PAIRS scores at most, whatever the tables' sizes; the count is at least the session's own
    spark = docs.sparkSession
    pairs = docs.count() * queries.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    counts = hits.repartition(parts, "doc").groupBy("doc", "_n", "term").agg(F.count("*").alias("tf"))
    found = counts.groupBy("term").agg(F.count("*").alias("df"))
    one = F.col("_one")
    weighted = joins.with_row(asked.join(found, "term"), stats).withColumn("idf", _idf(one["total"], F.col("df")))
    part = F.col("idf") * _weight(F.col("tf"), F.col("_n"), one["mean"])
    scored = (
        joins.with_row(counts.join(weighted.select("query_id", "term", "idf"), "term"), stats)
        .withColumn("_s", part)
        .groupBy("doc", "query_id")
        .agg(F.sum("_s").alias("score"))
    )
    best = windows.top_per_group(scored, ["query_id"], _ranking("doc"), n)
    return best.select("query_id", F.col("doc").alias(key), "score", "rank")


def probe(queries: Sequence[str], docs: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """Number of results for each probe query, at most n; all probes in one scan."""
    hits = [_any_of("_t", query_terms(q)) for q in queries]
    one = partitions.spread(docs.select(text)).select(tx.words(text).alias("_t")).agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hits)])
    rows = F.array(
        *[F.struct(F.lit(q).alias("query"), F.least(F.col(f"n{i}"), F.lit(n)).alias("result_count")) for i, q in enumerate(queries)]
    )
    return one.select(F.inline(rows)).withColumn("has_results", F.col("result_count") > 0)


def cohort_evidence(cohort: DataFrame, code: str, member: str, docs: DataFrame, key: str, text: str, words: Mapping[str, str]) -> DataFrame:
    """Per code: members of the cohort and documents that mention its words.

    The two sides are counted apart and meet on the code, so no member by document
    pair is formed.
    """
    members = cohort.groupBy(code).agg(F.count_distinct(member).alias("members"))
    hits = [F.forall(F.array(*[F.lit(t) for t in query_terms(q)]), lambda t: F.array_contains(F.col("_t"), t)) for q in words.values()]
    one = docs.select(tx.words(text).alias("_t")).agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hits)])
    rows = F.array(*[F.struct(F.lit(c).alias(code), F.col(f"n{i}").alias("documents")) for i, c in enumerate(words)])
    return members.join(one.select(F.inline(rows)), code)
