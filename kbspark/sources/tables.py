"""Reading and writing of tables: declared schemas, exports, validated imports, legacy imports, retention."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "knowledge": "id long, keyword string, sub_keyword string, question string, response string, category_id long, search_type string, status string, hits int, helpful_yes int, helpful_no int, reuse_response int, reuse_keyword string, reuse_sub_keyword string, expires_at date, created_at timestamp, updated_at timestamp",
    "questions": "id long, question string, original_question string, detected_language string, matched_keyword string, matched_sub_keyword string, knowledge_id long, match_type string, match_score decimal(5,2), ai_rejected int, ai_tiebreak int, ai_provider string, ip_address string, user_agent string, referer string, session_id string, created_at timestamp",
    "synonyms": "id long, canonical_word string, variant_words string, misspellings string, is_phrase int, is_active int",
    "stopwords": "word string, is_active int",
    "chunks": "id long, source_id long, chunk_index int, word_count int, content string",
    "sources": "id long, title string, source_type string, url string, status string, refresh_interval string, content_hash string, chunk_count int, word_count int, last_crawled_at timestamp",
}


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/kbspark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a scratch folder: computed once, and read again if an executor is lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema_of(name: str) -> T.StructType:
    """The declared schema of a table."""
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, path: str, name: str, format: str = "parquet", unescape: bool = False) -> DataFrame:
    """A table with its declared schema; unescape strips backslashes that escape quotes in text columns."""
    reader = spark.read.schema(SCHEMAS[name])
    df = reader.option("header", True).csv(path) if format == "csv" else reader.format(format).load(path)
    if unescape:
        df = df.withColumns({f.name: F.regexp_replace(f.name, r"\\(['\"\\])", "$1") for f in df.schema if isinstance(f.dataType, T.StringType)})
    return df


def export_bundle_json(tables: dict[str, DataFrame], folder: str, version: str = "1") -> None:
    """One JSON section for each table, and a manifest with their row counts."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
        counts.append((version, name, spark.read.json(f"{folder}/{name}").count()))
    spark.createDataFrame(counts, "version string, section string, n_rows long").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def export_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """A CSV with a header, values with commas, quotes or line ends quoted; with `mark` the header has a byte-order mark."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


#: The columns of sources and chunks that a bundle holds.
BUNDLED = {"sources": ["id", "title", "source_type", "url", "status", "created_at"], "chunks": ["source_id", "chunk_index", "content", "word_count"]}
#: The sections that a bundle may have.
SECTIONS = ("knowledge", "categories", "synonyms", "stopwords", "sources", "chunks")


def export_bundle(tables: dict[str, DataFrame], folder: str, version: str = "1") -> None:
    """export_bundle_json of the sections that a bundle has (ValueError for others), sources and chunks with the columns that are carried over."""
    if other := sorted(set(tables) - set(SECTIONS)):
        raise ValueError(f"no sections of a bundle: {other}")
    export_bundle_json({n: df.select(*(c for c in BUNDLED.get(n, df.columns) if c in df.columns)) for n, df in tables.items()}, folder, version)


def newest_questions(questions: DataFrame, limit: int = 10_000) -> DataFrame:
    return questions.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("question", "matched_keyword", "match_type", "ip_address", "created_at")


def newest_leads(leads: DataFrame) -> DataFrame:
    return leads.orderBy(F.desc("created_at"), F.desc("id"))


def import_csv_validated(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a CSV with a header; columns in lower case; ValueError without the required ones.

    A line with another number of values than the header is bad; blank lines are skipped; unknown status is active,
    unknown search_type is contains. A byte-order mark before the header is left out. Quoted values may have line ends in them, so
    a file is read by one task; a folder of files, as export_csv() writes it, by as many."""
    first = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path).columns
    names = [c.strip("\ufeff \t").lower() for c in first]
    if lost := [c for c in required if c not in names]:
        raise ValueError(f"columns are missing: {lost}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_bad"]])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).option("escape", '"').csv(path)
    good = rows.where("_bad is null").drop("_bad")
    fixed = {"status": (("active", "inactive", "hold", "expired"), "active"), "search_type": (("contains", "exact", "pattern"), "contains")}
    good = good.withColumns({c: F.when(F.col(c).isin(*known), F.col(c)).otherwise(default) for c, (known, default) in fixed.items() if c in names})
    # Spark reads no CSV for the bad lines alone, so another column is looked at too
    bad = rows.where(F.col("_bad").isNotNull() & (F.length(F.concat_ws("", "_bad", names[0])) > 0))
    return good, bad.select(F.col("_bad").alias("line"))


def preview_import(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """total, new and duplicate rows by key; null and empty are the same key."""
    safe = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in key]
    a, b = incoming.select(*safe), existing.select(*safe).distinct().withColumn("_known", F.lit(1))
    return a.join(b, key, "left").agg(F.count("*").alias("total"), F.count(F.when(F.col("_known").isNull(), 1)).alias("new"), F.count("_known").alias("duplicate"))


def insert_if_absent(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming whose key is not there yet, one for each key (the lowest id)."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*(F.coalesce(F.col(c), F.lit("")) for c in key)).orderBy("id"))).where("_n = 1").drop("_n")
    known = existing.select(*(F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in key)).distinct()
    first = first.withColumns({f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in key})
    return first.join(known, [f"_{c}" for c in key], "left_anti").drop(*(f"_{c}" for c in key))


def remap_sources(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(old_id, new_id, inserted): sources matched by url, others with new ids after the highest.

    New ids are dense and in the order of old ids: rows are dealt out by ranges of it, every range is numbered alone, and begins
    after the rows of those before, which are counted first (a number for each range)."""
    top = existing.agg(F.max("id")).first()[0] or 0
    known = existing.groupBy("url").agg(F.min("id").alias("known_id"))
    rows = incoming.select(F.col("id").alias("old_id"), "url").join(known, "url", "left")
    fresh = written(rows.where("known_id is null").select("old_id").repartitionByRange("old_id").withColumn("part", F.spark_partition_id()))
    before, firsts = top, []
    for r in fresh.groupBy("part").count().orderBy("part").collect():
        firsts.append((r["part"], before))
        before += r["count"]
    firsts = F.broadcast(incoming.sparkSession.createDataFrame(firsts, "part int, first long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("old_id"))
    fresh = fresh.withColumn("place", place).join(firsts, "part").select("old_id", (F.col("first") + F.col("place")).alias("new_id"), F.lit(True).alias("inserted"))
    return rows.where("known_id is not null").select("old_id", F.col("known_id").alias("new_id"), F.lit(False).alias("inserted")).union(fresh)


def remap_categories(categories: DataFrame, ids: DataFrame) -> DataFrame:
    """Categories with ids and parents of the map (old_id, new_id); an unknown parent becomes none."""
    own = ids.select(F.col("old_id").alias("id"), F.col("new_id").alias("_id"))
    up = ids.select(F.col("old_id").alias("parent_id"), F.col("new_id").alias("_parent"))
    return categories.join(own, "id").join(up, "parent_id", "left").select(F.col("_id").alias("id"), "name", F.col("_parent").alias("parent_id"))


def legacy_status(code: Column) -> Column:
    c = F.upper(F.trim(F.coalesce(code.cast("string"), F.lit(""))))
    return F.when(c.isin("I", "INACTIVE", "0"), "inactive").when(c.isin("H", "HOLD", "D", "DRAFT"), "hold").otherwise("active")


def legacy_knowledge(rows: DataFrame) -> DataFrame:
    """Entries from legacy rows(id, keyword, subkeyword, question, response, status, expdate, hits, rate)."""
    yes = F.when(F.col("rate") > 0, F.floor(F.col("hits") * F.col("rate") / 5).cast("int")).otherwise(0)
    wild = F.col("keyword").startswith("*") | F.col("keyword").endswith("*")
    return rows.where(F.trim(F.coalesce("keyword", F.lit(""))) != "").select(
        "id", "keyword", F.col("subkeyword").alias("sub_keyword"), F.coalesce(F.expr("nullif(trim(question), '')"), F.col("keyword")).alias("question"), "response", legacy_status(F.col("status")).alias("status"),
        F.when(wild, "pattern").otherwise("contains").alias("search_type"), F.try_to_date("expdate", "yyyy-MM-dd").alias("expires_at"), "hits", yes.alias("helpful_yes"), F.greatest(F.lit(0), F.when(F.col("rate") > 0, F.col("hits") - yes).otherwise(0)).alias("helpful_no"),
    )


def legacy_synonyms(rows: DataFrame) -> DataFrame:
    """rows(ord, misspelling, canonical) -> one row for each canonical word with its misspellings in first-seen order."""
    clean = rows.select("ord", F.lower(F.trim("misspelling")).alias("m"), F.lower(F.trim("canonical")).alias("c")).where("m <> '' and c <> '' and m <> c")
    first = clean.groupBy("c", "m").agg(F.min("ord").alias("ord"))
    out = first.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("ord", "m"))).alias("l"))
    return out.select(F.col("c").alias("canonical_word"), F.array_join("l.m", ",").alias("misspellings"), F.contains("c", F.lit(" ")).cast("int").alias("is_phrase"))


def upsert_stopwords(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    clean = incoming.select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct().withColumn("is_active", F.lit(1))
    return existing.select("word", "is_active").join(clean.select("word"), "word", "left_anti").unionByName(clean)


def legacy_questions(rows: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    has = F.coalesce("keyword", F.lit("")) != ""
    recent = rows.where(F.col("created_at") >= F.expr(f"timestamp '{as_of}' - interval {days} days"))
    return recent.withColumns({"match_type": F.when(has, "partial").otherwise("none"), "match_score": F.when(has, 100).otherwise(0)})


def clean_legacy_html(c: Column) -> Column:
    for pattern, new in ((r"(?s)<\?xml.*?\?>", ""), (r"(?s)<!--\[if.*?<!\[endif\]-->", ""), (r"(?i)<font[^>]*color=[\"']?([#\w]+)[\"']?[^>]*>", '<span style="color:$1">'), (r"(?i)</font>", "</span>"), (r"(?i)<(/?)center>", "<$1div>"), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)


def bulk_questions(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """rows(row_index, question, notes) without blank questions, optionally only the first."""
    kept = rows.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    return kept.orderBy("row_index").limit(limit) if limit else kept


def retention_prune(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows young enough to keep; 0 days keeps all."""
    return rows.where(F.col("created_at") >= F.expr(f"timestamp '{as_of}' - interval {days} days")) if days else rows


def unexpired(cache: DataFrame, as_of: str, drop_tenant: str | None = None) -> DataFrame:
    kept = cache.where(F.col("expires_at") > F.expr(f"timestamp '{as_of}'"))
    return kept.where(F.col("tenant_id") != drop_tenant) if drop_tenant else kept
