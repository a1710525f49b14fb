"""The driver's tables seen as a code base: which rows are nodes, edges, chunks and source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.tables import load


def calls(spark: SparkSession, d: str) -> DataFrame:
    """CALLS edges between parts: from an earlier to a later line of one order, both of quantity 44 or more."""
    lines = load(spark, d, "lineitem").where("l_quantity >= 44").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b.hint("merge"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.l_partkey") != F.col("b.l_partkey")))
    return pairs.select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"), F.lit("CALLS").alias("type")).distinct()


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as functions and methods."""
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "Function").otherwise("Method").alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"))


def most_called(edges: DataFrame) -> DataFrame:
    """id of the node with the most incoming edges, the least of them."""
    return edges.groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def most_calling(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def inherits(spark: SparkSession, d: str) -> DataFrame:
    """Part k inherits from part (k - 1) div 3."""
    return load(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("(p_partkey - 1) div 3").alias("dst"), F.lit("INHERITS").alias("type"))


def imports(spark: SparkSession, d: str) -> DataFrame:
    """The customer's nation imports from the supplier's nation for each line."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers, suppliers = load(spark, d, "customer").select("c_custkey", "c_nationkey"), load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.lit("IMPORTS").alias("type")).distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("File").alias("label"), F.col("n_name").alias("path"), F.col("n_regionkey").alias("repo_id"))


def has_method(spark: SparkSession, d: str) -> DataFrame:
    """A supplier is a class, a part that it ships a method of it."""
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("HAS_METHOD").alias("type")).distinct()


def _ids(df: DataFrame, letter: str, key: str, label: str, repo: str | None = None) -> DataFrame:
    return df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), (F.concat(F.lit("r"), F.col(repo).cast("string")) if repo else F.lit(None).cast("string")).alias("repo_id"))


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """region, nation, supplier, customer as Repository, File, Class, Function: (id, label, repo_id)."""
    nation = load(spark, d, "nation")
    s = load(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    c = load(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return _ids(load(spark, d, "region"), "r", "r_regionkey", "Repository").unionByName(_ids(nation, "n", "n_nationkey", "File", "n_regionkey")).unionByName(_ids(s, "s", "s_suppkey", "Class", "n_regionkey")).unionByName(_ids(c, "c", "c_custkey", "Function", "n_regionkey"))


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """CONTAINS, DEFINES and HAS_METHOD (supplier s to customer c = s) edges of that tree."""

    def edge(table: str, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
        return load(spark, d, table).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("type"))

    return edge("nation", "r", "n_regionkey", "n", "n_nationkey", "CONTAINS").unionByName(edge("supplier", "n", "s_nationkey", "s", "s_suppkey", "DEFINES")).unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey", "DEFINES")).unionByName(edge("supplier", "s", "s_suppkey", "c", "s_suppkey", "HAS_METHOD"))


SQL_CALLS = """g as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
and a.l_linenumber < b.l_linenumber and a.l_partkey <> b.l_partkey where a.l_quantity >= 44 and b.l_quantity >= 44)"""
SQL_FUNCTIONS = "f as (select p_partkey as id, case when p_size % 2 = 0 then 'Function' else 'Method' end as label, p_name as name, p_brand as file_path, p_size as start_line from part)"
SQL_CALLED = "root as (select dst as id from g group by dst order by count(*) desc, dst limit 1)"
SQL_CALLING = "root as (select src as id from g group by src order by count(*) desc, src limit 1)"
SQL_INHERITS = "h as (select p_partkey as src, (p_partkey - 1) // 3 as dst from part where p_partkey > 0)"
SQL_IMPORTS = "m as (select distinct c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"
SQL_TREE = """n as (select 'r' || r_regionkey as id, 'Repository' as label, null as repo_id from region
union all select 'n' || n_nationkey, 'File', 'r' || n_regionkey from nation
union all select 's' || s_suppkey, 'Class', 'r' || n_regionkey from supplier join nation on s_nationkey = n_nationkey
union all select 'c' || c_custkey, 'Function', 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey),
e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst, 'CONTAINS' as type from nation
union all select 'n' || s_nationkey, 's' || s_suppkey, 'DEFINES' from supplier
union all select 'n' || c_nationkey, 'c' || c_custkey, 'DEFINES' from customer
union all select 's' || s_suppkey, 'c' || s_suppkey, 'HAS_METHOD' from supplier)"""
