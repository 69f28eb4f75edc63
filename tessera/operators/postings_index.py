"""A kept lexical index: postings in buckets of their terms, changed by batches, read by the terms that a query has.

A batch adds chunks and takes chunks away. It writes files of its own: postings by bucket of the term, what each chunk holds by bucket
of the id, and changes of document frequencies; nothing that is there is written again. A search reads the buckets of its terms,
and within them the row groups that can hold them, since rows lie sorted by term. A batch that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .retrieval import asked_terms, bm25_sums, idf_of, ranked, tokenized

BUCKETS = 64
#: So many distinct terms at most go into a scan's filter; more are met by the join alone.
NAMED_TERMS = 2000

_POSTINGS = "id long, tok string, tf long, dl long, version int, bucket int"
_HELD = "id long, dl long, toks array<string>, version int, bucket int"
_DF = "tok string, d long, version int, bucket int"
_TOTALS = "n long, dl long, version int"
_GONE = "id long, version int"


class PostingsIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        return rows if before is None else rows.filter(F.col("version") < before)

    def _write(self, df: DataFrame, name: str, batch: int, by: str | None = None, sort: str | None = None) -> None:
        """by: the column whose buckets become folders."""
        path = f"{self.folder}/{name}/version={batch}"
        if by is None:
            df.write.mode("overwrite").parquet(path)
            return
        df = df.withColumn("bucket", self._bucket(by)).hint("rebalance", "bucket")
        (df.sortWithinPartitions("bucket", sort) if sort else df).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _live(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Without what a later batch has taken away or replaced."""
        gone = self._read("gone", _GONE, before).groupBy(F.col("id").alias("_id")).agg(F.max("version").alias("_version"))
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("version") < F.col("_version")), "left_anti")

    def apply(self, batch: int, add: DataFrame | None = None, remove: DataFrame | None = None) -> None:
        """add: chunks(id, text), which replace those of equal ids; remove: ids(id). Batches are numbered upwards."""
        none = self.spark.createDataFrame([], "id long")
        toks = written(tokenized(add).select(F.col("id").cast("long").alias("id"), "toks", F.col("dl").cast("long").alias("dl"))) if add is not None else self.spark.createDataFrame([], "id long, toks array<string>, dl long")
        ids = (remove.select(F.col("id").cast("long").alias("id")) if remove is not None else none).unionByName(toks.select("id")).distinct()
        where = [r[0] for r in ids.select(self._bucket("id")).distinct().collect()]  # as many as there are buckets at most
        old = self._live(self._read("held", _HELD, batch).filter(F.col("bucket").isin(where)), batch).join(ids, "id", "left_semi")
        changed = toks.select("dl", "toks", F.lit(1).alias("d")).unionByName(old.select("dl", "toks", F.lit(-1).alias("d")))
        df = changed.select("d", F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.sum("d").alias("d")).filter("d <> 0")
        self._write(df, "df", batch, "tok", "tok")
        self._write(changed.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("d") * F.col("dl")), F.lit(0)).cast("long").alias("dl")), "totals", batch)
        self._write(toks.select("id", "dl", F.explode("toks").alias("tok")).groupBy("id", "tok").agg(F.count("*").alias("tf"), F.any_value("dl").alias("dl")), "postings", batch, "tok", "tok")
        self._write(toks.select("id", "dl", F.array_distinct("toks").alias("toks")), "held", batch, "id")
        self._write(ids, "gone", batch)

    def totals(self) -> DataFrame:
        """One row (n, avgdl)."""
        return self._read("totals", _TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))

    def statistics(self) -> DataFrame:
        """(tok, df, idf) of the vocabulary at present; idf's floor needs all of it, but a row for each term only."""
        df = self._read("df", _DF).groupBy("tok").agg(F.sum("d").alias("df")).filter("df > 0")
        return idf_of(df, self.totals())

    def postings(self, terms: DataFrame) -> DataFrame:
        """(id, tok, tf, dl) of the terms(tok), from their buckets alone."""
        where = [r[0] for r in terms.select(self._bucket("tok")).distinct().collect()]  # as many as there are buckets at most
        rows = self._read("postings", _POSTINGS).filter(F.col("bucket").isin(where))
        named = [r[0] for r in terms.limit(NAMED_TERMS + 1).collect()]
        if len(named) <= NAMED_TERMS:
            rows = rows.filter(F.col("tok").isin(named))
        return self._live(rows.join(terms, "tok", "left_semi")).select("id", "tok", "tf", "dl")

    def scores(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, query) -> (query_id, id, score), as retrieval.bm25_scores over the chunks at present."""
        asked, terms = asked_terms(queries)
        known = asked.join(self.statistics().join(terms, "tok", "left_semi"), "tok")
        return bm25_sums(self.postings(terms).join(known, "tok").crossJoin(F.broadcast(self.totals())))  # one row of totals

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        return ranked(self.scores(queries), k)
