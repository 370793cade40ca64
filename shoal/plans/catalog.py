"""Registered queries of the vector-search engine, each over its whole tables, with SQL that gives the same rows.

Shared definitions, the same in queries and SQL: the query set is the rows whose vec_id is divisible by 100; the centres are
the same rows, numbered from 0 in vec_id order; there are PARTS ranges or groups of parts.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import distance as D
from shoal.operators import cluster, evaluate, exact, graph, lineage, partition, sample, search
from shoal.sources import index

K, PARTS, DEGREE, EVERY = 10, 4, 8, 100


# --- shared tables ----------------------------------------------------------------------------------------------


def vectors(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def query_set(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def pairs(v: DataFrame) -> DataFrame:
    """Each row beside the row of the next id."""
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return v.select("vec_id", F.col("embedding").alias("a")).join(nxt, "vec_id")


def centers(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % EVERY == 0).select(F.floor(F.col("vec_id") / EVERY).alias("part_id"), F.transform("embedding", lambda x: x.cast("double")).alias("center"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))  # no negative zero
    return df


def ranked(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("rank", F.col("rank").cast("long")), "dist")


def owners(v: DataFrame) -> DataFrame:
    return exact.nearest_centers(v, centers(v)).select("vec_id", "part_id", "dist")


# --- the same in SQL --------------------------------------------------------------------------------------------


def fold(a: str, b: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: {term}))"


def sql_l2(a: str, b: str) -> str:
    return fold(a, b, "(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)")


def sql_ip(a: str, b: str) -> str:
    return fold(a, b, "x[1]::DOUBLE * x[2]::DOUBLE")


def sql_cosine(a: str, b: str) -> str:
    return f"1 - {sql_ip(a, b)} / (sqrt({sql_ip(a, a)}) * sqrt({sql_ip(b, b)}))"


def sql_metric(metric: str, a: str, b: str) -> str:
    return {"l2": sql_l2, "mips": lambda a, b: f"1 - {sql_ip(a, b)}", "cosine": sql_cosine}[metric](a, b)


QUERIES_SQL = f"q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % {EVERY} = 0)"
CENTERS_SQL = f"c AS (SELECT vec_id // {EVERY} AS part_id, embedding AS center FROM embeddings WHERE vec_id % {EVERY} = 0)"
NEAR_SQL = f"{CENTERS_SQL}, near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, part_id) AS rank FROM (SELECT vec_id, part_id, {sql_l2('embedding', 'center')} AS dist FROM embeddings, c))"
RANGE_SQL = f"parts AS (SELECT vec_id, least(vec_id // (SELECT count(*) // {PARTS} FROM embeddings), {PARTS - 1})::BIGINT AS part_id FROM embeddings)"
GRAPH_SQL = f"g AS (SELECT src, rank, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {sql_l2('a.embedding', 'b.embedding')} AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= {DEGREE})"
POS_SQL = f"{RANGE_SQL}, pos AS (SELECT vec_id, part_id, row_number() OVER (ORDER BY part_id, vec_id) - 1 AS pos FROM parts)"
PLACED_SQL = f"{POS_SQL}, {GRAPH_SQL}, placed AS (SELECT s.pos AS src_pos, s.part_id AS src_part, d.pos AS dst_pos, d.part_id AS dst_part FROM g JOIN pos s ON g.src = s.vec_id JOIN pos d ON g.dst = d.vec_id)"


def knn_sql(metric: str = "l2", base: str = "embeddings", where: str = "true", k: int = K, extra: str = "") -> str:
    return (
        f"WITH {QUERIES_SQL}{extra}, d AS (SELECT query_id, vec_id, {sql_metric(metric, 'qv', 'embedding')} AS dist FROM q, {base} WHERE {where}) "
        f"SELECT query_id, rank, vec_id, round(dist, 6) + 0.0::DOUBLE AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= {k}"
    )


CATALOG: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a function of the vector table as a query."""

    def add(f):
        CATALOG[f.__name__] = (lambda spark, sf_dir: f(vectors(spark, sf_dir)), sql)
        return f

    return add


# --- distances --------------------------------------------------------------------------------------------------


def _pair_sql(value: str, a: str = "a.embedding", b: str = "b.embedding") -> str:
    return f"SELECT a.vec_id, {value} FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query(_pair_sql(f"round({sql_l2('a.embedding', 'b.embedding')}, 6) AS dist"))
def dist_l2(v):
    return rounded(pairs(v).select("vec_id", D.l2_sq(F.col("a"), F.col("b")).alias("dist")), "dist")


@query(_pair_sql(f"round({sql_ip('a.embedding', 'b.embedding')}, 6) AS dist"))
def dist_ip(v):
    return rounded(pairs(v).select("vec_id", D.inner_product(F.col("a"), F.col("b")).alias("dist")), "dist")


@query(_pair_sql(f"round(1 - {sql_ip('a.embedding', 'b.embedding')}, 6) AS dist"))
def dist_mips(v):
    return rounded(pairs(v).select("vec_id", D.mips_distance(F.col("a"), F.col("b")).alias("dist")), "dist")


@query(_pair_sql(f"round({sql_cosine('a.embedding', 'b.embedding')}, 6) AS dist"))
def dist_cosine(v):
    return rounded(pairs(v).select("vec_id", D.cosine_distance(F.col("a"), F.col("b")).alias("dist")), "dist")


@query(f"SELECT vec_id, round({sql_ip('embedding', 'embedding')}, 6) AS norm_sq FROM embeddings")
def vec_norm(v):
    return rounded(v.select("vec_id", D.norm_sq(F.col("embedding")).alias("norm_sq")), "norm_sq")


def _int_l2(a: str, b: str, of: str) -> str:
    return fold(a, b, f"({of.format('x[1]')} - {of.format('x[2]')}) * ({of.format('x[1]')} - {of.format('x[2]')})")


@query(_pair_sql(f"{_int_l2('a.embedding', 'b.embedding', 'floor({}::DOUBLE * 127)')}::BIGINT AS dist"))
def dist_l2_int8(v):
    return pairs(v).select("vec_id", D.l2_sq(D.to_int8(F.col("a")), D.to_int8(F.col("b"))).cast("long").alias("dist"))


@query(_pair_sql(f"{_int_l2('a.embedding', 'b.embedding', 'floor(({}::DOUBLE + 1) * 127)')}::BIGINT AS dist"))
def dist_l2_uint8(v):
    return pairs(v).select("vec_id", D.l2_sq(D.to_uint8(F.col("a")), D.to_uint8(F.col("b"))).cast("long").alias("dist"))


SCALED_SQL = "list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7))"


@query(
    f"WITH u AS (SELECT vec_id, {SCALED_SQL} AS x FROM embeddings), n AS (SELECT vec_id, {sql_ip('x', 'x')} AS n FROM u), m AS (SELECT sqrt(max(n)) AS m FROM n) "
    "SELECT vec_id, round(sqrt(greatest(1 - n / (m * m), 0)), 5) AS added, (SELECT count(*) FROM embeddings) AS n_rows FROM n, m"
)
def mips_augment(v):
    u = v.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("x"))
    largest = u.agg(F.sqrt(F.max(D.norm_sq(F.col("x")))).alias("m"), F.count("*").alias("n")).first()
    grown = D.augmented(F.col("x"), F.lit(largest["m"]))
    return u.select("vec_id", F.round(F.element_at(grown, -1), 5).alias("added"), F.lit(largest["n"]).cast("long").alias("n_rows"))


@query("SELECT vec_id, len(embedding)::BIGINT + (48 - len(embedding) % 48) % 48 AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def align_pad(v):
    p = D.padded(F.col("embedding"), 48)
    return v.select("vec_id", F.size(p).cast("long").alias("dim"), F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(f"WITH {NEAR_SQL} SELECT n.vec_id, n.part_id, round({sql_ip('r', 'r')}, 6) AS norm_sq FROM (SELECT near.vec_id, near.part_id, list_transform(list_zip(embedding, center), lambda x: x[1]::DOUBLE - x[2]::DOUBLE) AS r FROM near JOIN embeddings USING (vec_id) JOIN c USING (part_id) WHERE rank = 1) n")
def residuals(v):
    rows = owners(v).join(v, "vec_id").join(centers(v), "part_id")
    return rows.select("vec_id", "part_id", F.round(D.norm_sq(D.residual(F.col("embedding"), F.col("center"))), 6).alias("norm_sq"))


# --- exact search -----------------------------------------------------------------------------------------------


@query(knn_sql())
def knn_l2(v):
    return ranked(exact.knn_join(query_set(v), v, K))


@query(knn_sql("mips", f"(SELECT vec_id, {SCALED_SQL} AS embedding FROM embeddings)"))
def knn_mips(v):
    scaled = v.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("embedding"))
    q = query_set(v).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return ranked(exact.knn_join(q, scaled, K, "mips"))


@query(knn_sql("cosine"))
def knn_cosine(v):
    return ranked(exact.knn_join(query_set(v), v, K, "cosine"))


@query(knn_sql(where="query_id <> vec_id"))
def knn_self_excluded(v):
    return ranked(exact.knn_join(query_set(v), v, K, keep_self=False))


@query(knn_sql(where="label = 3"))
def knn_filtered_label(v):
    return ranked(exact.knn_join(query_set(v), v, K, allowed=F.col("label") == 3))


@query(f"WITH {QUERIES_SQL} SELECT query_id, vec_id, round(dist, 6) AS dist FROM (SELECT query_id, vec_id, {sql_l2('qv', 'embedding')} AS dist FROM q, embeddings) WHERE dist <= 1.6 AND query_id <> vec_id")
def knn_range(v):
    return rounded(exact.range_search(query_set(v), v, 1.6), "dist")


@query(knn_sql(base="b", extra=", b AS (SELECT vec_id, CASE WHEN label = 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings)"))
def knn_after_upsert(v):
    changed = v.where("label = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return ranked(exact.knn_join(query_set(v), exact.upsert(v, changed), K))


@query(knn_sql(where="label <> 2"))
def knn_after_delete(v):
    return ranked(exact.knn_join(query_set(v), exact.delete(v, v.where("label = 2").select("vec_id")), K))


@query(knn_sql())
def shared_nothing_topk_merge(v):
    parts = v.join(partition.range_parts(v, PARTS), "vec_id")
    shards = [exact.knn_join(query_set(v), parts.where(F.col("part_id") == p), K).drop("rank") for p in range(PARTS)]
    return ranked(exact.merge_top_k(shards, K))


# --- partitions and clusters ------------------------------------------------------------------------------------


@query(f"WITH {RANGE_SQL} SELECT vec_id, part_id FROM parts")
def range_partition(v):
    return partition.range_parts(v, PARTS)


@query(f"WITH {RANGE_SQL} SELECT part_id, count(*) AS n FROM parts GROUP BY part_id")
def partition_sizes(v):
    return partition.part_sizes(partition.range_parts(v, PARTS))


@query(f"WITH {NEAR_SQL} SELECT vec_id, part_id, row_number() OVER (ORDER BY part_id, vec_id) - 1 AS pos FROM near WHERE rank = 1")
def pos_map(v):
    return partition.position_map(owners(v))


@query(f"WITH {POS_SQL} SELECT pos, part_id FROM pos")
def owner_lookup(v):
    parts = partition.range_parts(v, PARTS)
    return partition.owner_of(partition.position_map(parts).select("pos"), partition.part_sizes(parts))


@query(f"WITH {POS_SQL} SELECT pos, pos // (SELECT count(*) // {PARTS} + 1 FROM embeddings) AS part_id FROM pos")
def forced_equal_partition(v):
    return partition.forced_equal_parts(partition.position_map(partition.range_parts(v, PARTS)), PARTS)


@query(f"WITH {NEAR_SQL} SELECT vec_id, part_id, round(dist, 6) AS dist FROM near WHERE rank = 1")
def nearest_centroid(v):
    return rounded(owners(v), "dist")


@query(f"WITH {NEAR_SQL} SELECT vec_id, rank, part_id, round(dist, 6) AS dist FROM near WHERE rank <= 2")
def nearest_2_centroids(v):
    return ranked(exact.nearest_centers(v, centers(v), 2))


@query(f"WITH {NEAR_SQL} SELECT part_id, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM near WHERE rank = 1 GROUP BY part_id")
def inverted_index(v):
    ix = cluster.inverted_index(owners(v))
    return ix.select("part_id", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {NEAR_SQL} SELECT part_id, count(*) AS n, round(sum(dist), 6) AS total_dist, round(max(dist), 6) AS max_dist FROM near WHERE rank = 1 GROUP BY part_id")
def cluster_stats(v):
    return rounded(cluster.cluster_stats(owners(v)), "total_dist", "max_dist")


@query(f"WITH {NEAR_SQL}, m AS (SELECT part_id, i, avg(x) AS m FROM (SELECT part_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM near JOIN embeddings USING (vec_id) WHERE rank = 1) GROUP BY part_id, i), n AS (SELECT part_id, count(*) AS n FROM near WHERE rank = 1 GROUP BY part_id) SELECT part_id, n, round(sum(m * m), 6) AS norm_sq FROM m JOIN n USING (part_id) GROUP BY part_id, n")
def lloyd_step(v):
    return cluster.lloyd_step(v, centers(v)).select("part_id", "n", F.round(D.norm_sq(F.col("center")), 6).alias("norm_sq"))


@query(f"WITH {NEAR_SQL} SELECT round(sum(dist), 5) AS inertia FROM near WHERE rank = 1")
def inertia(v):
    return cluster.inertia(owners(v)).select(F.round("inertia", 5).alias("inertia"))


@query(f"WITH {NEAR_SQL} SELECT vec_id, rank - 1 AS replica_rank, part_id, round(dist, 6) AS dist FROM near WHERE rank <= 2")
def replica_assign(v):
    return rounded(partition.replica_parts(v, centers(v)).withColumn("replica_rank", F.col("replica_rank").cast("long")), "dist")


@query(f"WITH {NEAR_SQL} SELECT vec_id, string_agg(part_id::VARCHAR, ',' ORDER BY rank) AS parts FROM near WHERE rank <= 2 GROUP BY vec_id")
def replica_membership(v):
    m = partition.membership(partition.replica_parts(v, centers(v)))
    return m.select("vec_id", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@query(f"WITH {NEAR_SQL} SELECT part_id, vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM near JOIN embeddings USING (vec_id) WHERE rank <= 2")
def retrieve_shard(v):
    rows = partition.retrieve(v, partition.replica_parts(v, centers(v)).select("vec_id", "part_id"))
    return rows.select("part_id", "vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(f"WITH {NEAR_SQL} SELECT part_id, count(*) AS n FROM near WHERE rank <= 2 GROUP BY part_id")
def cluster_sizes(v):
    return partition.part_sizes(exact.nearest_centers(v, centers(v), 2))


@query(f"WITH {POS_SQL} SELECT pos, vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM pos JOIN embeddings USING (vec_id)")
def reorder_vectors(v):
    """Vectors in the order of their positions."""
    rows = partition.reordered(v, partition.position_map(partition.range_parts(v, PARTS)))
    return rows.select("pos", "vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(f"WITH {NEAR_SQL} SELECT part_id, vec_id, (label + 1)::BIGINT AS n_labels FROM near JOIN embeddings USING (vec_id) WHERE rank <= 2")
def shard_labels(v):
    rows = partition.part_labels(_labelled(v), partition.replica_parts(v, centers(v)))
    return rows.select("part_id", "vec_id", F.size("labels").cast("long").alias("n_labels"))


@query(f"SELECT vec_id, round({sql_ip('embedding', 'embedding')}, 6) AS norm_sq FROM embeddings")
def random_rotation(v):
    """A rotation keeps norms."""
    turned = D.rotated(v, v.agg(F.max(F.size("embedding"))).first()[0] or 0, 5)
    return rounded(turned.select("vec_id", D.norm_sq(F.col("embedding")).alias("norm_sq")), "norm_sq")


@query(f"WITH {POS_SQL}, {GRAPH_SQL} SELECT pos.part_id, count(*) AS n_edges, sum(dst)::BIGINT AS of_dst FROM g JOIN pos ON g.src = pos.vec_id GROUP BY pos.part_id")
def index_round_trip(v):
    """Positions and edges written as an index and read again."""
    spark = v.sparkSession
    path = f"{lineage.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.write_index(path, positions=partition.position_map(partition.range_parts(v, PARTS)), edges=graph.knn_graph(v, DEGREE).select("src", "dst"))
    placed = index.read_index(spark, path, "edges").join(index.read_index(spark, path, "positions"), F.col("src") == F.col("vec_id"))
    return placed.groupBy("part_id").agg(F.count("*").alias("n_edges"), F.sum("dst").alias("of_dst"))


# --- routing ----------------------------------------------------------------------------------------------------


def _coarse(v: DataFrame) -> DataFrame:
    """The 10 nearest coarse rows (those of label below 5) of each query, with their owner."""
    found = exact.knn_join(query_set(v), v, K, allowed=F.col("label") < 5)
    return found.join(partition.range_parts(v, PARTS), "vec_id").select("query_id", "part_id", "vec_id")


COARSE_SQL = f"{QUERIES_SQL}, {RANGE_SQL}, coarse AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (SELECT query_id, vec_id, {sql_l2('qv', 'embedding')} AS dist FROM q, embeddings WHERE label < 5)) WHERE rank <= {K}), cnt AS (SELECT query_id, part_id, count(*) AS n FROM coarse JOIN parts USING (vec_id) GROUP BY ALL)"
ROUTE_SQL = f"{COARSE_SQL}, r AS (SELECT query_id, part_id, n, n / sum(n) OVER (PARTITION BY query_id) AS share, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, part_id) = 1 AS leader FROM cnt), route AS (SELECT *, share > 1.0 / {PARTS} OR (leader AND NOT bool_or(share > 1.0 / {PARTS}) OVER (PARTITION BY query_id)) AS \"primary\" FROM r)"


@query(f'WITH {ROUTE_SQL} SELECT query_id, part_id, n, round(share, 6) AS share, "primary", leader FROM route')
def route_primary(v):
    return rounded(partition.routes(_coarse(v), PARTS), "share")


def _routed_sql(route: str) -> str:
    return f"WITH {ROUTE_SQL}, d AS (SELECT query_id, vec_id, {sql_l2('qv', 'embedding')} AS dist FROM q JOIN ({route}) USING (query_id) JOIN parts USING (part_id) JOIN embeddings USING (vec_id)) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= {K}"


def _routed(v: DataFrame, rule: str) -> DataFrame:
    route = partition.routes(_coarse(v), PARTS, rule).where("primary")
    return ranked(search.exact_in_parts(query_set(v), route, partition.range_parts(v, PARTS).join(v, "vec_id"), K))


@query(_routed_sql('SELECT query_id, part_id FROM route WHERE "primary"'))
def kmeans_routed_share(v):
    return _routed(v, "share")


@query(_routed_sql("SELECT query_id, part_id FROM route"))
def kmeans_routed_any(v):
    return _routed(v, "any")


@query(_routed_sql('SELECT query_id, part_id FROM route WHERE "primary"'))
def ann_kmeans_routed(v):
    """Graph search in the routed parts only, with ef no less than a part and a ring in each part, so exact in them."""
    route = partition.routes(_coarse(v), PARTS, "share").where("primary")
    return ranked(search.kmeans_routed(query_set(v), route, _ringed_parts(v), v, K, v.count()))


# --- graphs -----------------------------------------------------------------------------------------------------


def _placed(v: DataFrame) -> DataFrame:
    return graph.to_positions(graph.knn_graph(v, DEGREE), partition.position_map(partition.range_parts(v, PARTS)))


@query(f"WITH {GRAPH_SQL} SELECT src, rank, dst, round(dist, 6) AS dist FROM g")
def knn_graph(v):
    return ranked(graph.knn_graph(v, DEGREE))


@query(f"WITH {GRAPH_SQL}, e AS (SELECT src, dst, dist FROM g UNION SELECT dst, src, dist FROM g) SELECT src, rank, dst, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT DISTINCT src, dst, round(dist, 9) AS dist FROM e)) WHERE rank <= {DEGREE}")
def graph_merge(v):
    g = graph.knn_graph(v, DEGREE)
    both = g.select("src", "dst").unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return ranked(graph.merge_graphs(both, v, DEGREE))


@query(f"WITH {PLACED_SQL} SELECT src_pos, dst_part, count(*) AS n, string_agg(dst_pos::VARCHAR, ',' ORDER BY dst_pos) AS ids, CASE WHEN src_part = dst_part THEN 'local' WHEN count(*) <= 2 THEN 'inline' ELSE 'shipped' END AS kind FROM placed GROUP BY src_pos, src_part, dst_part")
def graph_layout(v):
    groups = graph.layout(_placed(v))
    return groups.select("src_pos", "dst_part", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "kind")


@query("SELECT 0::BIGINT AS differences")
def graph_layout_verified(v):
    placed = _placed(v)
    return graph.layout_differences(graph.layout(placed), placed).agg(F.count("*").alias("differences"))


@query(f"WITH {PLACED_SQL} SELECT src_part, src_pos, dst_pos FROM placed WHERE src_part = dst_part")
def graph_local(v):
    return graph.local_edges(_placed(v))


@query(f"WITH {GRAPH_SQL} SELECT degree, count(*) AS n FROM (SELECT dst, count(*) AS degree FROM g GROUP BY dst) GROUP BY degree")
def graph_degree_hist(v):
    return graph.degree_histogram(graph.knn_graph(v, DEGREE))


@query(f"WITH {PLACED_SQL} SELECT floor(share * 10)::BIGINT AS decile, count(*) AS n FROM (SELECT src_pos, max(n) / sum(n) AS share FROM (SELECT src_pos, dst_part, count(*) AS n FROM placed GROUP BY ALL) GROUP BY src_pos) GROUP BY ALL")
def graph_part_skew(v):
    return graph.part_skew(_placed(v))


@query(f"WITH {PLACED_SQL} SELECT src_part, sum((src_part = dst_part)::INT)::BIGINT AS local, sum((src_part <> dst_part)::INT)::BIGINT AS remote, round(avg((src_part = dst_part)::INT), 6) AS share FROM placed GROUP BY src_part")
def graph_locality(v):
    return rounded(evaluate.locality(_placed(v)), "share")


@query(f"WITH RECURSIVE {GRAPH_SQL}, b AS (SELECT 0 AS hop, 0::BIGINT AS vec_id UNION SELECT hop + 1, dst FROM b JOIN g ON g.src = b.vec_id WHERE hop < 5) SELECT hop::BIGINT AS hop, count(*) AS n FROM (SELECT vec_id, min(hop) AS hop FROM b GROUP BY vec_id) GROUP BY hop")
def khop_growth(v):
    g = graph.knn_graph(v, DEGREE).select("src", "dst")
    entry = v.agg(F.lit(0).cast("long").alias("vec_id"))
    return graph.hops(g, entry).groupBy(F.col("hop").cast("long").alias("hop")).agg(F.count("*").alias("n"))


@query(f"WITH {RANGE_SQL}, m AS (SELECT part_id, i, avg(x) AS m FROM (SELECT part_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM parts JOIN embeddings USING (vec_id)) GROUP BY part_id, i), l AS (SELECT part_id, list(m ORDER BY i) AS mean FROM m GROUP BY part_id) SELECT part_id, vec_id AS entry FROM (SELECT part_id, vec_id, row_number() OVER (PARTITION BY part_id ORDER BY {sql_l2('embedding', 'mean')}, vec_id) AS rank FROM parts JOIN embeddings USING (vec_id) JOIN l USING (part_id)) WHERE rank = 1")
def graph_entry_medoid(v):
    return graph.medoids(v, partition.range_parts(v, PARTS))


@query(f"WITH {GRAPH_SQL} SELECT vec_id, degree, row_number() OVER (ORDER BY degree DESC, vec_id) - 1 AS place FROM (SELECT dst AS vec_id, count(*) AS degree FROM g GROUP BY dst)")
def graph_reorder(v):
    return graph.by_degree(graph.knn_graph(v, DEGREE))


LABELS_SQL = "points AS (SELECT vec_id, list_transform(range(0, label + 1), lambda i: (label + i) % 10) AS labels FROM embeddings)"


def _labelled(v: DataFrame) -> DataFrame:
    return v.select("vec_id", F.transform(F.sequence(F.lit(0), F.col("label")), lambda i: (F.col("label") + i) % 10).alias("labels"))


@query(f"WITH {LABELS_SQL}, e AS (SELECT vec_id, generate_subscripts(labels, 1) - 1 AS i, unnest(labels) AS label FROM points) SELECT vec_id, (i // 3)::BIGINT AS dummy, string_agg(label::VARCHAR, ',' ORDER BY i) AS labels FROM e GROUP BY ALL")
def label_breakup(v):
    b = graph.break_up_labels(_labelled(v), 3)
    return b.select("vec_id", "dummy", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query(f"WITH {RANGE_SQL} SELECT label, string_agg(entry::VARCHAR, ',' ORDER BY entry) AS entries FROM (SELECT DISTINCT label, part_id FROM parts JOIN embeddings USING (vec_id)) JOIN (SELECT part_id, min(vec_id) AS entry FROM parts GROUP BY part_id) USING (part_id) GROUP BY label")
def label_medoids(v):
    parts = partition.range_parts(v, PARTS)
    entries = parts.groupBy("part_id").agg(F.min("vec_id").alias("entry"))
    m = graph.label_entries(v.join(parts, "vec_id"), entries)
    return m.select("label", F.array_join(F.transform("entries", lambda x: x.cast("string")), ",").alias("entries"))


# --- approximate strategies -------------------------------------------------------------------------------------


def _ring(v: DataFrame) -> DataFrame:
    """Edges of the neighbour graph and of a ring over all rows, so that every row can be reached."""
    n = v.count()
    ring = v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") + 1) % n).alias("dst"))
    return graph.knn_graph(v, DEGREE).select("src", "dst").unionByName(ring).distinct()


def _whole(v: DataFrame) -> DataFrame:
    lists = _ring(v).groupBy(F.col("src").alias("vec_id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
    return lists.withColumn("entry", F.lit(0).cast("long"))


def _ringed_parts(v: DataFrame) -> DataFrame:
    """Pruned graphs of the parts, with a ring in each, so that every row of a part can be reached."""
    graphs = graph.build_part_graphs(partition.range_parts(v, PARTS).join(v, "vec_id"), DEGREE, 20)
    of_part = Window.partitionBy("part_id")
    nxt = F.coalesce(F.lead("vec_id").over(of_part.orderBy("vec_id")), F.min("vec_id").over(of_part))
    return graphs.withColumn("neighbors", F.array_distinct(F.concat("neighbors", F.array(nxt))))


@query(knn_sql())
def ann_single(v):
    """With ef no less than the table, so exact."""
    return ranked(search.single(query_set(v), _whole(v), v, K, v.count()))


@query(knn_sql())
def ann_shared_nothing(v):
    """On pruned graphs of the parts, with ef no less than a part and a ring in each part, so exact."""
    return ranked(search.shared_nothing(query_set(v), _ringed_parts(v), v, K, v.count()))


@query(knn_sql())
def ann_global_pull(v):
    return ranked(search.global_pull(query_set(v), _ring(v), v, v.agg(F.min("vec_id").alias("vec_id")), K, v.count(), beam=128))


@query(knn_sql())
def ann_collaborative(v):
    index = search.top_index(v)
    return ranked(search.collaborative(query_set(v), index, partition.range_parts(v, PARTS), _ring(v), v, PARTS, K, v.count(), beam=64))


@query()
def ann_single_narrow(v):
    """ef of 40: approximate; tests hold its recall."""
    return ranked(search.single(query_set(v), _whole(v), v, K, 40))


@query()
def balanced_assignment(v):
    """Owner and one replica of each row, sizes balanced."""
    c = np.array([r["center"] for r in centers(v).orderBy("part_id").collect()])
    return rounded(cluster.balanced_assign(v, c, 2), "dist")


@query()
def kmeans_centers(v):
    fitted = cluster.kmeans(v, 8)
    return fitted.select("part_id", F.round(D.norm_sq(F.col("center")), 6).alias("norm_sq"))


@query()
def part_graphs(v):
    return graph.build_part_graphs(partition.range_parts(v, PARTS).join(v, "vec_id"), DEGREE, 20)


# --- evaluation, sampling ---------------------------------------------------------------------------------------


@query(f"WITH t AS ({knn_sql()}), f AS ({knn_sql(where='label < 5')}) SELECT count(f.vec_id) AS hits, count(*) AS total, round(count(f.vec_id) / count(*), 6) AS recall FROM t LEFT JOIN f USING (query_id, vec_id)")
def recall_at_k(v):
    """Recall of a search that sees half of the labels."""
    found = exact.knn_join(query_set(v), v, K, allowed=F.col("label") < 5)
    return rounded(evaluate.recall(found, exact.knn_join(query_set(v), v, K), K), "recall")


@query(f"WITH {COARSE_SQL} SELECT place, sum(n)::BIGINT AS n, round(sum(n) / (SELECT sum(n) FROM cnt), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, part_id) AS place FROM cnt) GROUP BY place")
def partition_access_rank(v):
    return rounded(evaluate.access_ranks(_coarse(v)), "share")


@query("SELECT CASE WHEN h >= 150 THEN 150 WHEN h >= 100 THEN 100 WHEN h >= 50 THEN 50 ELSE 0 END::BIGINT AS bucket, count(*) AS n FROM (SELECT vec_id % 170 AS h FROM embeddings) GROUP BY ALL")
def hop_hist(v):
    hist = evaluate.hop_histogram(v.select((F.col("vec_id") % 170).alias("hops")))
    return hist.select(F.col("bucket").cast("long").alias("bucket"), "n")


@query("SELECT query_id, sum((part_id <> last)::INT)::BIGINT AS switches FROM (SELECT vec_id // 50 AS query_id, label AS part_id, lag(label) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS last FROM embeddings) GROUP BY query_id")
def path_part_switches(v):
    path = v.select(F.floor(F.col("vec_id") / 50).alias("query_id"), F.col("vec_id").alias("step"), F.col("label").alias("part_id"))
    return evaluate.part_switches(path)


@query("SELECT vec_id FROM embeddings WHERE (vec_id * 2654435761 + 17) % 4294967296 / 4294967296.0 < 0.25")
def sample_bernoulli(v):
    return sample.bernoulli(v, 0.25, 17).select("vec_id")


@query(f"WITH {QUERIES_SQL} SELECT i * (SELECT count(*) FROM q) + row_number() OVER (PARTITION BY i ORDER BY query_id) - 1 AS query_id, round(list_sum(list_transform(qv, lambda x: x::DOUBLE)), 6) AS total FROM q, range(10) t(i)")
def amplified_queries(v):
    q = query_set(v).withColumn("query_id", F.floor(F.col("query_id") / EVERY))
    return sample.amplified(q).select("query_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT label, count(*) AS n, max(vec_id) AS hi, min(vec_id) AS lo, bool_and(vec_id >= 0) AS all_, bool_or(vec_id > 400) AS any_ FROM embeddings GROUP BY label")
def reductions(v):
    return v.groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("hi"), F.min("vec_id").alias("lo"), F.bool_and(F.col("vec_id") >= 0).alias("all_"), F.bool_or(F.col("vec_id") > 400).alias("any_"))


def queries():
    return {k: f for k, (f, _) in CATALOG.items()}


def oracle_sql():
    return {k: s for k, (_, s) in CATALOG.items() if s}
