"""Vector queries over the driver's embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import vectors as V
from codeloom.plans.code_queries import texts
from codeloom.plans.registry import query
from codeloom.sources import parsing
from codeloom.sources.tables import load

_KINDS = [*(f"function_{x}" for x in ("full", "signature", "docstring")), *(f"class_{x}" for x in ("full", "docstring"))]


def chunks(spark, d):
    """The embeddings as chunks; their payload follows from id and label."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("vec_id") % 5 + 1).cast("int"))
    return load(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("repo"), (F.col("label") % 3).cast("string")).alias("repo_id"), F.concat(F.lit("f"), (F.col("vec_id") % 40).cast("string")).alias("file_path"),
        kind.alias("chunk_type"), F.split(kind, "_")[0].alias("entity_type"), F.concat(F.lit("e"), (F.col("vec_id") % 25).cast("string")).alias("entity_name"), F.lit("python").alias("language"),
    )


def first(spark, d):
    return load(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("vector"))


_C = """c as (select vec_id as chunk_id, embedding::double[] as e, 'repo' || (label % 3) as repo_id, 'f' || (vec_id % 40) as file_path,
['function_full','function_signature','function_docstring','class_full','class_docstring'][vec_id % 5 + 1] as chunk_type, 'e' || (vec_id % 25) as entity_name from embeddings),
q as (select embedding::double[] as v from embeddings where vec_id = 0),
s as (select c.*, list_cosine_similarity(e, v) as cos, list_inner_product(e, v) as dot, list_distance(e, v) as dist from c cross join q)"""


def _out(df, *more):
    return df.select("chunk_id", *more, F.round("score", 6).alias("score"))


@query(f"with {_C} select chunk_id, round(cos, 6) as score from s where cos >= 0 order by cos desc, chunk_id limit 10")
def vector_topk_cosine(spark, d):
    return _out(V.search(chunks(spark, d), first(spark, d)))


@query(f"with {_C} select chunk_id, round(dot, 6) as score from s where dot >= 0 order by dot desc, chunk_id limit 10")
def vector_topk_dot(spark, d):
    return _out(V.search(chunks(spark, d), first(spark, d), distance="Dot"))


@query(f"with {_C} select chunk_id, round(dist, 6) as score from s order by dist, chunk_id limit 10")
def vector_topk_euclid(spark, d):
    return _out(V.search(chunks(spark, d), first(spark, d), threshold=None, distance="Euclid"))


@query(f"with {_C} select chunk_id, round(cos, 6) as score from s where repo_id = 'repo1' and chunk_type = 'function_full' and cos >= 0.05 order by cos desc, chunk_id limit 10")
def vector_filtered_topk(spark, d):
    return _out(V.search(chunks(spark, d), first(spark, d), threshold=0.05, repo_id="repo1", chunk_type="function_full", language=None))


@query(f"with {_C} select chunk_id, round(cos, 6) as score from s where repo_id = 'repo0' and entity_name = 'e7' order by cos desc, chunk_id limit 10")
def vector_search_entity(spark, d):
    return _out(V.search(chunks(spark, d), first(spark, d), threshold=None, repo_id="repo0", entity_name="e7"))


@query(f"with {_C} select chunk_id, round(cos, 6) as score from s where chunk_id <> 0 and chunk_type = 'function_full' and cos >= 0.05 order by cos desc, chunk_id limit 10")
def similar_functions(spark, d):
    return _out(V.similar_functions(chunks(spark, d), 0, threshold=0.05))


@query(f"with {_C} select chunk_id, chunk_type, round(cos, 6) as score from s where chunk_type in ('function_docstring', 'class_docstring') and cos >= 0.1 order by cos desc, chunk_id limit 10")
def docstring_merge_topk(spark, d):
    return _out(V.docstring_search(chunks(spark, d), first(spark, d), threshold=0.1), "chunk_type")


@query(
    f"with {_C} select vec_id as query_id, chunk_id, rank, round(score, 6) as score from (select vec_id, chunk_id, list_cosine_similarity(e, embedding::double[]) as score, row_number() over (partition by vec_id order by list_cosine_similarity(e, embedding::double[]) desc, chunk_id)::integer as rank from embeddings cross join c where vec_id % 100 = 0) where rank <= 5"
)
def batch_knn(spark, d):
    """The rows whose id is divisible by 100 ask all rows."""
    queries = load(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.batch_search(chunks(spark, d), queries, 5).withColumn("score", F.round("score", 6))


@query("select vec_id as chunk_id, case when vec_id % 7 = 0 then 'newer' else 'repo' || (label % 3) end as repo_id from embeddings")
def upsert_chunks(spark, d):
    """A batch that names every seventh chunk twice: the later row wins."""
    c = chunks(spark, d)
    some = c.where("chunk_id % 7 = 0")
    batch = some.withColumns({"repo_id": F.lit("new"), "o": F.lit(1)}).unionByName(some.withColumns({"repo_id": F.lit("newer"), "o": F.lit(2)}))
    return V.upsert_chunks(c, batch, F.col("o")).select("chunk_id", "repo_id")


@query("select count(*) as deleted from embeddings where label % 3 = 2 and vec_id % 40 = 5")
def delete_chunks(spark, d):
    return V.delete_chunks(chunks(spark, d), repo_id="repo2", file_path="f5")[1]


@query("select vec_id as chunk_id from embeddings where label % 3 = 1 and vec_id % 40 = 5 order by vec_id limit 100")
def chunks_of_file(spark, d):
    return V.chunks_of_file(chunks(spark, d), "repo1", "f5").select("chunk_id")


@query("select 'repo' || (label % 3) as repo_id, count(*) as chunks from embeddings group by 1")
def chunk_counts(spark, d):
    return chunks(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    """with e as (select p_brand as f, p_name as n, ['function','class','method'][p_size % 3 + 1] as t, p_size as l, case when p_partkey % 2 = 0 then p_type end as doc from part),
x as (select f, case when t = 'method' then 'Owner.' || n else n end as n, t, l, doc from e)
select 'r:' || f || ':' || n || ':' || l || ':full' as chunk_id, t || '_full' as chunk_type, 'src ' || l as content from x
union all select 'r:' || f || ':' || n || ':' || l || ':sig', t || '_signature', 'def ' || n || '()' from x
union all select 'r:' || f || ':' || n || ':' || l || ':doc', t || '_docstring', doc from x where t <> 'method' and doc <> ''"""
)
def chunk_functions(spark, d):
    kind = F.element_at(F.array(F.lit("function"), F.lit("class"), F.lit("method")), F.col("p_size") % 3 + 1)
    e = load(spark, d, "part").select(F.lit("r").alias("repo_id"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), kind.alias("type"), F.lit("Owner").alias("owner"), F.col("p_size").alias("start_line"), F.concat(F.lit("src "), F.col("p_size").cast("string")).alias("source_code"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("docstring"))
    e = e.withColumn("signature", F.concat(F.lit("def "), F.when(F.col("type") == "method", F.concat(F.lit("Owner."), "name")).otherwise(F.col("name")), F.lit("()")))
    return V.chunk_entities(e).select("chunk_id", "chunk_type", "content")


@query(
    """select * from (values ('r:greet.py:greet:1:sig', 'function_signature', 'def greet(name)', 1), ('r:age.py:check_age:1:sig', 'function_signature', 'def check_age(age)', 1), ('r:deep.py:f:1:sig', 'function_signature', 'def f(items)', 1), ('r:docs.py:f:7:sig', 'function_signature', 'def f()', 7),
('r:docs.py:f:7:doc', 'function_docstring', 'Long' || chr(10) || 'text', 7), ('r:single.py:S:1:sig', 'class_signature', 'class S', 1), ('r:single.py:S.get_instance:3:sig', 'method_signature', 'S.def get_instance(cls)', 3), ('r:make.py:CarFactory:1:sig', 'class_signature', 'class CarFactory', 1),
('r:make.py:CarFactory.create_car:2:sig', 'method_signature', 'CarFactory.def create_car(self)', 2), ('r:make.py:CarFactory.make_bike:4:sig', 'method_signature', 'CarFactory.def make_bike(self)', 4), ('r:wrap.py:timed:2:sig', 'function_signature', 'def timed(fn)', 2),
('r:big.py:big:1:sig', 'function_signature', 'def big(a, b, c, d, e, f)', 1)) as v(chunk_id, chunk_type, content, end_line)"""
)
def chunk_signatures(spark, d):
    """Signatures and docstrings of what all sources define; the documents define nothing."""
    entities = parsing.parse(texts(spark, d), "file_path", "text")
    return V.chunk_entities(V.described(entities, "r")).where("not chunk_type like '%_full'").select("chunk_id", "chunk_type", "content", "end_line")
