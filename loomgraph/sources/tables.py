"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.model import EdgeTable, Graph, NodeTable
from loomgraph import session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


_NODES = {"region": ("region", "r_regionkey", "Region"), "nation": ("nation", "n_nationkey", "Nation"), "customer": ("customer", "c_custkey", "Customer"), "supplier": ("supplier", "s_suppkey", "Supplier"), "part": ("part", "p_partkey", "Part"), "orders": ("order", "o_orderkey", "Order")}
_EDGES = {
    "IN_REGION": ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
    "CUSTOMER_IN": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "SUPPLIER_IN": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    "PLACED": ("orders", "customer", "o_custkey", "order", "o_orderkey"),
}


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders; IN_REGION, CUSTOMER_IN, SUPPLIER_IN, PLACED, CONTAINS (order to part)."""
    g = Graph(spark)
    for name, (prefix, key, label) in _NODES.items():
        df = table(spark, sf_dir, name)
        g.node_tables.append(NodeTable(df.select(_id(prefix, key).alias("id"), "*"), (label,)))
    for label, (name, a, ka, b, kb) in _EDGES.items():
        g.edge_tables.append(EdgeTable(label, table(spark, sf_dir, name).select(_id(a, ka).alias("src"), _id(b, kb).alias("dst"))))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    g.edge_tables.append(EdgeTable("CONTAINS", lines.select(_id("order", "l_orderkey").alias("src"), _id("part", "l_partkey").alias("dst"), "quantity")))
    return g


def conversation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Conversations and messages; HAS_MESSAGE, and NEXT between a conversation's consecutive messages."""
    t = table(spark, sf_dir, "conversations")
    message = F.concat(F.lit("message:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    conv = _id("conversation", "conv_id")
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    chain = t.select("conv_id", message.alias("src"), after.alias("turn")).filter("turn is not null").select("src", message.alias("dst"))
    nodes = [NodeTable(t.select(conv.alias("id")).distinct(), ("Conversation",)), NodeTable(t.select(message.alias("id"), "role", "turn", "text"), ("Message",))]
    return Graph(spark, nodes, [EdgeTable("HAS_MESSAGE", t.select(conv.alias("src"), message.alias("dst"))), EdgeTable("NEXT", chain)])


def document_graph(spark: SparkSession, sf_dir: str, size: int = 1500, overlap: int = 200) -> Graph:
    """Documents and their chunks, joined by HAS_CHUNK."""
    from loomgraph.operators.retrieval import chunk_documents

    d = table(spark, sf_dir, "documents")
    chunks = chunk_documents(d, size=size, overlap=overlap).select(F.concat(_id("chunk", "doc_id"), F.lit(":"), F.col("chunk_index").cast("string")).alias("id"), "doc_id", "chunk_index", "text")
    return Graph(
        spark,
        [NodeTable(d.select(_id("doc", "doc_id").alias("id"), "lang", "source", "n_chars"), ("Document",)), NodeTable(chunks, ("DocumentChunk",))],
        [EdgeTable("HAS_CHUNK", chunks.select(_id("doc", "doc_id").alias("src"), F.col("id").alias("dst")))],
    )


def co_purchase(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """(src, dst, weight) of parts bought together in at least so many orders, src < dst."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    return a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) edges of the integer graph of nations, customers and orders: customer -> order and customer -> nation, ids made disjoint."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 4).alias("src"), (F.col("o_orderkey") * 4 + 1).alias("dst"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 4).alias("src"), (F.col("c_nationkey").cast("bigint") * 4 + 2).alias("dst"))
    return o.unionByName(c)
