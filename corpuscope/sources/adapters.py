"""Tables as corpora: any table with a text and a path expression can be searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.files import Corpus
from corpuscope.operators.history import History


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the repo, the path is language/source/doc_<id>.txt."""
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), path.alias("path"), "lang", F.col("text").alias("content"))


def documents(spark: SparkSession, sf_dir: str, **rules) -> Corpus:
    return Corpus(document_files(spark, sf_dir), **rules)


def pages(spark: SparkSession, sf_dir: str) -> Corpus:
    """Pages as html files of their host."""
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/?", ""), r"(\.html)?([?#].*)?$", ""), F.lit("-"), F.col("page_id"), F.lit(".html"))
    return Corpus(read(spark, sf_dir, "pages").select("page_id", host.alias("repo"), path.alias("path"), F.lit("html").alias("lang"), F.col("html").alias("content")))


def order_history(spark: SparkSession, sf_dir: str) -> History:
    """Orders as commits of their customer's nation, line items as changed files: a path by part type, one line of text, removed
    where the item was returned."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    commits = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    commits = commits.select(
        F.col("n_name").alias("repo"), F.col("n_nationkey").alias("repo_ord"), F.col("o_orderkey").alias("store_ord"), F.hex("o_orderkey").alias("sha"),
        F.col("c_name").alias("author_name"), F.concat(F.lower(F.col("c_mktsegment")), F.lit("@example.org")).alias("author_email"),
        F.col("o_orderdate").alias("landed"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("subject"), F.lit("").alias("body"),
    )
    items, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    sign = F.when(F.col("l_returnflag") == "R", "-").otherwise("+")
    path = F.concat(F.regexp_replace("p_type", " ", "/"), F.lit("/part_"), F.col("p_partkey"), F.lit(".py"))
    text = F.concat_ws(" ", "p_name", F.col("l_quantity").cast("int").cast("string"))
    changes = items.join(part, items.l_partkey == part.p_partkey).select(F.hex("l_orderkey").alias("sha"), path.alias("path"), F.array(F.struct(sign.alias("sign"), text.alias("text"))).alias("lines"))
    changes = changes.select("sha", "path", F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("string").alias("now_path"), "lines")
    return History(commits, changes)


def event_commits(events: DataFrame) -> DataFrame:
    """Events as a stream of commits."""
    return events.select(F.lit("events").alias("repo"), F.lit(0).alias("repo_ord"), F.col("event_id").alias("store_ord"), F.hex("event_id").alias("sha"), F.concat(F.lit("user"), F.col("user_id")).alias("author_name"), F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.org")).alias("author_email"), F.col("ts").alias("landed"), F.col("event_type").alias("subject"), F.coalesce("props", F.lit("")).alias("body"))


def conversation_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notebooks: a file per conversation, a cell per turn. ``content`` joins the cells' texts by line ends."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    n = lambda t: F.size(F.split(t["text"], "\n", -1))
    cell = lambda acc, t: F.struct((acc["next"] + n(t)).alias("next"), F.concat(acc["cells"], F.array(F.struct((F.size(acc["cells"]) + 1).cast("int").alias("number"), F.when(t["role"] == "assistant", "code").otherwise("markdown").alias("kind"), acc["next"].alias("start_line"), n(t).alias("lines")))).alias("cells"))
    start = F.expr("named_struct('next', 1, 'cells', CAST(array() AS array<struct<number:int,kind:string,start_line:int,lines:int>>))")
    return ordered.select("conv_id", F.aggregate("turns", start, cell)["cells"].alias("cells"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("content"))
