"""Urls that are taken to be normalised are."""

from pyspark.sql import functions as F

from kbspark.functions import text as X


def test_left_alone(spark):
    urls = "http://a.b/ http://a.b http://a.b/c http://a.b/c/ http://A.b/c http://a.b:80/c http://a.b/c#d http://a.b/?x=1 http://a.b?x=1 http://a.b/c/?x#y HTTP://a.b/c a.b/c http:///c ftp://a.b//c http://é.b/c".split() + ["http://a.b/c\n", "http://a.b/\n", "", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", X.normalise_url(F.col("url")).alias("same"), X.is_normalised_url(F.col("url")).alias("done")).collect()
    assert all(r.url == r.same for r in rows if r.done) and {r.url for r in rows if r.done} >= {"http://a.b/", "http://a.b/c", "http://a.b/?x=1"}
