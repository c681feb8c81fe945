"""Logical tables over the driver's tables: the only place that knows their names. SQL holds the same definitions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy readers of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @property
    def docs_l(self) -> DataFrame:
        """Citing documents."""
        date = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate"))
        courts = self.raw("customer").select("c_custkey", F.col("c_mktsegment").alias("court"))
        return self.raw("orders").join(courts, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("stable_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("doc_type"), "court", date.alias("decision_date"), F.col("o_totalprice").alias("weight"))

    @property
    def docs_r(self) -> DataFrame:
        """Cited documents."""
        return self.raw("part").select(F.col("p_partkey").alias("stable_id"), F.col("p_brand").alias("source"), F.col("p_type").alias("doc_type"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))

    @property
    def rel(self) -> DataFrame:
        """Typed edges."""
        part, line = F.col("l_partkey"), F.col("l_linenumber")
        kind = F.when(line % 4 == 0, "cited_by").when(line % 4 == 1, "mentions").when(line % 4 == 2, "applies").otherwise("follows")
        via = F.when(F.col("l_returnflag") == "A", "regex").when(F.col("l_returnflag") == "N", "structured").otherwise("inferred")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("src_id"), F.when(F.col("l_linestatus") == "F", part).alias("dst_id"), F.when(part % 13 != 0, part).alias("candidate_id"), F.concat(F.lit("ref-"), part).alias("raw"),
            F.when(F.col("l_linestatus") == "F", "resolved").otherwise("pending").alias("status"), via.alias("via"), kind.alias("type"), F.concat(F.lit("s. "), line).alias("dst_anchor"),
            F.to_date("l_shipdate").alias("event_date"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"),
        )

    @property
    def cyclic(self) -> DataFrame:
        """Distinct edges (src, dst) in one namespace of ids, with cycles and dangling nodes."""
        li = self.raw("lineitem")
        first = self.raw("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
        n = self.raw("supplier").agg(F.count("*").alias("n"))
        second = li.select("l_suppkey", "l_partkey").distinct().join(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("n")).alias("dst"))  # n is one row
        return first.unionByName(second).filter("src <> dst").distinct()

    @property
    def versions(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("base_id"), F.to_date("l_shipdate").alias("version_date")).distinct()

    @property
    def tags(self) -> DataFrame:
        """Sparse tags of documents."""
        lab = self.raw("labels")
        tag = lambda c, name: lab.filter(F.col(c) == 1).select("doc_id", F.lit(name).alias("tag"))
        return tag("quality", "quality").unionByName(tag("toxic", "toxic"))

    @property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings")


SQL = {
    "docs_l": "SELECT o_orderkey AS stable_id, o_orderstatus AS source, o_orderpriority AS doc_type, c_mktsegment AS court, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS decision_date, o_totalprice AS weight FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "docs_r": "SELECT p_partkey AS stable_id, p_brand AS source, p_type AS doc_type, p_name AS title, p_size AS size FROM part",
    "rel": """SELECT l_orderkey AS src_id, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS dst_id, CASE WHEN l_partkey % 13 <> 0 THEN l_partkey END AS candidate_id, 'ref-' || l_partkey AS raw,
        CASE WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'pending' END AS status, CASE l_returnflag WHEN 'A' THEN 'regex' WHEN 'N' THEN 'structured' ELSE 'inferred' END AS via,
        CASE l_linenumber % 4 WHEN 0 THEN 'cited_by' WHEN 1 THEN 'mentions' WHEN 2 THEN 'applies' ELSE 'follows' END AS type, 's. ' || l_linenumber AS dst_anchor,
        CAST(l_shipdate AS DATE) AS event_date, l_suppkey AS supp, l_quantity AS quantity FROM lineitem""",
    "cyclic": """SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        UNION ALL SELECT l_suppkey, l_partkey % (SELECT count(*) FROM supplier) FROM lineitem) WHERE src <> dst""",
    "versions": "SELECT DISTINCT l_partkey AS base_id, CAST(l_shipdate AS DATE) AS version_date FROM lineitem",
    "tags": "SELECT doc_id, 'quality' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1",
}


def with_views(sql: str, *names: str) -> str:
    """SQL behind the definitions of the logical tables it names."""
    sql = sql.strip()
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {head}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {head} {sql}"
