"""Full-text search with dynamic pruning: postings by impact, and bounds that decide which of them are joined at all.

The relevance of a chunk is the sum of tf * weight over the query's terms. Every term's postings lie in blocks of like tf, whose
number of postings and greatest tf are known. A first look at the strongest postings gives a query a floor that its k-th result
cannot fall under. Then blocks are skipped, those first that save most postings for what they could add to a
chunk, until what a chunk could have in skipped blocks alone comes to half the floor: so common terms, whose weights are nearly 0, take
part with their strongest blocks or not at all. The other blocks are joined; a chunk whose sum there and greatest
possible rest stay under the floor goes, and what is left is scored in full.

Postings are written with few bytes a row and take some 70 times that in memory, so by the files' size Spark would send all of them
through the driver to every task: joins with them are told to merge, and so are those with the asked terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.sources.tables import written

#: Relevance is rounded to this many digits before it is ranked; floors are lower by more than that can make out.
DIGITS, SLACK = 6, 2e-6
#: Of a query's strongest postings so many times k are looked at for its floor; of the floor so much is given to skipped blocks.
LOOKED_AT, GIVEN = 4, 0.5


def terms(text: Column) -> Column:
    """Lower-cased words of letters and digits, three characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{3,})"), 1)


def index(chunks: DataFrame, queries: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
    """asked(query_id, term, weight, blocks) and held(term, chunk_id, tf, block, …also), both written.

    chunks(chunk_id, content, …also), queries(query_id, query). weight: idf squared, idf = log10(N / df); terms that every chunk has
    weigh 0 and are left out. block: the number of binary digits of tf; blocks: of the term, with the number of postings
    and the greatest tf of each. Only terms that are asked for are indexed."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    wanted = asked.select("term").distinct()
    held = chunks.select("chunk_id", *also, F.explode(terms(F.col("content"))).alias("term")).join(wanted, "term", "left_semi").groupBy("term", "chunk_id", *also).agg(F.count("*").alias("tf"))
    held = written(held.withColumn("block", F.length(F.bin("tf"))))
    total = chunks.agg(F.count("*").alias("total"))
    blocks = held.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"))
    weights = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sort_array(F.collect_list(F.struct("block", "n", "most"))).alias("blocks")).crossJoin(F.broadcast(total))  # one row
    weights = weights.select("term", F.pow(F.log10(F.col("total") / F.col("df")), F.lit(2.0)).alias("weight"), "blocks").where("weight > 0")
    return written(asked.join(weights, "term")), held


def scored(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, chunk_id, relevance) over 0 for pairs(query_id, chunk_id): looked up by term and chunk, not by term alone."""
    looked = pairs.join(asked.select("query_id", "term", "weight").hint("merge"), "query_id").join(held.select("term", "chunk_id", "tf").hint("merge"), ["term", "chunk_id"])
    return looked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("tf") * F.col("weight")), DIGITS).alias("relevance")).where("relevance > 0")


def floors(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): a relevance that k chunks reach, for queries with a term that k chunks or more hold.

    Of every term the k postings of the highest tf, of those a query's strongest; a query looks at LOOKED_AT * k chunks at most."""
    champions = held.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("tf"), "chunk_id"))).where(F.col("_n") <= k).select("term", "chunk_id", "tf")
    strongest = Window.partitionBy("query_id").orderBy(F.desc(F.col("tf") * F.col("weight")), "chunk_id")
    looked = asked.join(champions.hint("merge"), "term").withColumn("_n", F.row_number().over(strongest)).where(F.col("_n") <= LOOKED_AT * k).select("query_id", "chunk_id").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance")))
    return scored(looked, asked, held).withColumn("_n", place).where(F.col("_n") == k).select("query_id", F.col("relevance").alias("floor"))


def unskipped(asked: DataFrame, reached: DataFrame) -> DataFrame:
    """(query_id, term, weight, block, skipped, rest, floor): the blocks that are to be joined.

    skipped: what a chunk can have of the term in its skipped blocks; rest: the sum of that over the query's terms. A block's price
    is how much more of the term a chunk can have with it than in lower blocks, which are skipped before it. Without a floor
    nothing is skipped."""
    rows = asked.join(reached, "query_id", "left").withColumn("floor", F.coalesce(F.col("floor") - SLACK, F.lit(0.0)))
    rows = rows.select("query_id", "term", "weight", "floor", F.explode("blocks").alias("b")).select("query_id", "term", "weight", "floor", "b.*")
    term, own = Window.partitionBy("query_id", "term").orderBy("block"), Window.partitionBy("query_id")
    rows = rows.withColumn("price", F.col("weight") * (F.col("most") - F.lag("most", 1, 0).over(term)))
    rows = rows.withColumn("gain", F.min(F.col("n") / F.col("price")).over(term))  # a block is no better than those before it
    spent = F.sum("price").over(own.orderBy(F.desc("gain"), "term", "block").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_skip", spent <= GIVEN * F.col("floor"))
    price = F.when(F.col("_skip"), F.col("price")).otherwise(0.0)
    rows = rows.withColumns({"skipped": F.sum(price).over(Window.partitionBy("query_id", "term")), "rest": F.sum(price).over(own)})
    return rows.where(~F.col("_skip")).select("query_id", "term", "weight", "block", "skipped", "rest", "floor")


def candidates(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id): every chunk that can be among a query's k most relevant, and few others.

    Queries and postings meet by term and block, so skipped blocks are not touched. A term of a chunk that was not met has
    what its skipped blocks allow at most."""
    met = unskipped(asked, floors(asked, held, k)).join(held.select("term", "block", "chunk_id", "tf").hint("merge"), ["term", "block"])
    most = F.sum(F.col("tf") * F.col("weight") - F.col("skipped")) + F.max("rest")
    return met.groupBy("query_id", "chunk_id").agg(most.alias("_most"), F.max("floor").alias("_floor")).where(F.col("_most") >= F.col("_floor") * (1 - 1e-9)).select("query_id", "chunk_id")


def fulltext_topk(chunks: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, relevance, rank): the k chunks of the highest relevance, ties by chunk_id.

    Null or empty texts hold no term; a query without any term that a chunk has gets no row."""
    asked, held = index(chunks, queries)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id"))
    return scored(candidates(asked, held, k), asked, held).withColumn("rank", place).where(F.col("rank") <= k)


def fulltext_in_sources(chunks: DataFrame, queries: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, source_id, chunk_id, relevance, rank): of every source that pairs(query_id, source_id) ask about the k chunks of the highest relevance.

    Weights are those of all chunks(chunk_id, source_id, content). A source is searched as a collection of its own: a pair is a query and a
    source's term a term, each with blocks and floors of its own."""
    asked, held = index(chunks, queries, "source_id")
    term = F.struct("source_id", "term").alias("term")
    held = held.select(term, "chunk_id", "tf", "block")
    own = held.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most")).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("block", "n", "most"))).alias("blocks"))
    rows = pairs.select("query_id", "source_id").distinct().join(asked.select("query_id", "term", "weight"), "query_id")
    asked = written(rows.select(F.struct("query_id", "source_id").alias("query_id"), term, "weight").join(own.hint("merge"), "term"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id"))
    top = scored(candidates(asked, held, k), asked, held).withColumn("rank", place).where(F.col("rank") <= k)
    return top.select("query_id.*", "chunk_id", "relevance", "rank")
