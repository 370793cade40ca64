"""Edge cases and properties of the vector-search operators."""

import functools
import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.functions import distance as D
from shoal.operators import cluster, evaluate, exact, graph, lineage, partition, sample, search
from shoal.sources import binary, labels
from shoal.sources.schema import check_vectors


def table(spark, rows, name="vec_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<float>")


def found(df):
    return [(r["query_id"], r["vec_id"]) for r in df.orderBy("query_id", "rank").collect()]


BASE = [(0, [0, 0]), (1, [1, 0]), (2, [0, 1]), (3, [-1, 0])]


def test_ties_go_to_the_smaller_id(spark):
    assert found(exact.knn_join(table(spark, [(7, [0, 0])], "query_id"), table(spark, BASE), 2)) == [(7, 0), (7, 1)]


def test_fewer_rows_than_k(spark):
    assert len(found(exact.knn_join(table(spark, [(7, [0, 0])], "query_id"), table(spark, BASE[:3]), 10))) == 3


def test_filter_before_the_search(spark):
    base = table(spark, [(i, [i + 1, 0]) for i in range(4)])
    q = table(spark, [(0, [0, 0])], "query_id")
    assert found(exact.knn_join(q, base, 2, allowed=F.col("vec_id") != 1)) == [(0, 0), (0, 2)]
    assert found(exact.knn_join(q, base, 2, allowed=F.col("vec_id") > 99)) == []


@pytest.mark.parametrize("a, b, want", [([0], [255], 65025), ([-128], [127], 65025), ([1, 2, 3], [1, 2, 5], 4)])
def test_integer_l2(spark, a, b, want):
    assert spark.range(1).select(D.l2_sq(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0] == want


def test_mips_distance_may_be_negative(spark):
    d = spark.range(1).select(D.mips_distance(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))).first()[0]
    assert d == -3


def test_augmented_norms(spark):
    rows = table(spark, [(0, [3, 4]), (1, [0, 1])]).select(F.element_at(D.augmented(F.col("embedding"), F.lit(5.0)), -1).alias("x")).collect()
    assert [r["x"] for r in rows] == pytest.approx([0, math.sqrt(1 - 1 / 25)])


def test_sql_functions(spark):
    D.register(spark)
    assert spark.sql("SELECT l2_sq(array(1D, 2D), array(1D, 4D)), inner_product(array(1D, 2D), array(3D, 4D)), mips_distance(array(2D), array(2D))").first()[:] == (4.0, 11.0, -3.0)


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, None]])
def test_bad_vectors_are_rejected(spark, bad):
    with pytest.raises(ValueError):
        check_vectors(spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "vec_id long, embedding array<float>"))


def test_range_parts_keep_the_remainder(spark):
    parts = partition.range_parts(table(spark, [(i, [i]) for i in range(10)]), 4)
    assert sorted(r["n"] for r in partition.part_sizes(parts).collect()) == [2, 2, 2, 4]


def test_replicas(spark):
    centers = cluster.centers_table(spark, np.array([[0.0, 0], [10, 0], [0, 10]]))
    r = partition.replica_parts(table(spark, BASE), centers).collect()
    assert len(r) == 8 and {x["vec_id"] for x in r if x["replica_rank"] == 0} == {0, 1, 2, 3}
    assert all(len({x["part_id"] for x in r if x["vec_id"] == i}) == 2 for i in range(4))


def test_empty_cluster_keeps_its_centre(spark):
    centers = cluster.centers_table(spark, np.array([[0.0, 0], [100, 100]]))
    got = {r["part_id"]: (r["n"], r["center"]) for r in cluster.lloyd_step(table(spark, BASE), centers).collect()}
    assert got[1] == (0, [100.0, 100.0]) and got[0][0] == 4


def test_balanced_assignment_covers_all_rows(spark):
    rng = np.random.default_rng(0)
    points = table(spark, list(enumerate(rng.normal(size=(400, 4)))))
    centers = rng.normal(size=(4, 4))
    got = cluster.balanced_assign(points, centers, 2).collect()
    assert len(got) == 800 and all(len({g["part_id"] for g in got if g["vec_id"] == i}) == 2 for i in range(0, 400, 50))
    assert cluster.Balancer().weight(np.zeros(3), np.zeros(3), np.zeros(3)) == 0


def test_merge_takes_each_edge_once(spark):
    v = table(spark, [(1, [0, 0]), (2, [1, 0]), (3, [0, 2]), (4, [3, 3])])
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (1, 4)], "src long, dst long")
    assert [r["dst"] for r in graph.merge_graphs(edges, v, 2).orderBy("rank").collect()] == [2, 3]


def test_layout_kinds(spark):
    placed = spark.createDataFrame([(0, 0, 1, 0), (0, 0, 5, 1), (0, 0, 6, 1), (0, 0, 7, 1), (0, 0, 9, 2)], "src_pos long, src_part long, dst_pos long, dst_part long")
    got = {r["dst_part"]: (r["n"], r["kind"]) for r in graph.layout(placed).collect()}
    assert got == {0: (1, "local"), 1: (3, "shipped"), 2: (1, "inline")}
    assert graph.layout_differences(graph.layout(placed), placed).count() == 0


@pytest.mark.parametrize("counts, primary", [({0: 5, 1: 3, 2: 2}, {0, 1}), ({0: 1, 1: 1, 2: 1, 3: 1}, {0})])
def test_routes(spark, counts, primary):
    rows = [(0, p) for p, n in counts.items() for _ in range(n)]
    r = partition.routes(spark.createDataFrame(rows, "query_id long, part_id long"), 4).collect()
    assert {x["part_id"] for x in r if x["primary"]} == primary and [x["part_id"] for x in r if x["leader"]] == [0]


def test_label_breakup(spark):
    points = spark.createDataFrame([(0, [1, 2, 3, 4, 5])], "vec_id long, labels array<int>")
    assert {r["dummy"]: r["labels"] for r in graph.break_up_labels(points, 2).collect()} == {0: [1, 2], 1: [3, 4], 2: [5]}


def test_recall(spark):
    t = spark.createDataFrame([(0, i, v) for i, v in enumerate([2, 3, 4], 1)], "query_id long, rank int, vec_id long")
    r = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 2, 3], 1)], "query_id long, rank int, vec_id long")
    assert evaluate.recall(r, t, 3).first()["recall"] == pytest.approx(2 / 3)


def test_pruned_graph_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    g, medoid = graph.pruned_graph(x, 12, 30)
    assert max(map(len, g)) <= 12
    hits = 0
    for q in rng.normal(size=(20, 8)):
        top, _ = graph.best_first(g, x, q, medoid, 40)
        hits += len({v for _, v in top[:10]} & set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist()))
    assert hits / 200 > 0.9


def test_narrow_search_recall(spark):
    from shoal.plans import catalog

    sf = "/root/testdata/sf0.001"
    r = evaluate.recall(catalog.queries()["ann_single_narrow"](spark, sf), catalog.queries()["knn_l2"](spark, sf), 10)
    assert r.first()["recall"] > 0.6


def test_sampling_is_repeatable(spark):
    rows = spark.range(2000).withColumnRenamed("id", "vec_id")
    a = {r[0] for r in sample.bernoulli(rows.repartition(3), 0.3, 5).collect()}
    assert a == {r[0] for r in sample.bernoulli(rows.repartition(7), 0.3, 5).collect()} and 450 < len(a) < 750


@pytest.mark.parametrize("kind, low, high", [("fbin", -1, 1), ("u8bin", 0, 255), ("i8bin", -128, 127)])
def test_vector_files(spark, tmp_path, kind, low, high):
    random.seed(1)
    rows = [(i, [round(random.uniform(low, high)) for _ in range(5)]) for i in range(57)]
    path = f"{tmp_path}/v.{kind}"
    binary.write_vectors(table(spark, rows), path)
    assert binary.read_header(path) == (57, 5)
    back = binary.read_vectors(spark, path, rangeBytes=100)
    assert back.rdd.getNumPartitions() > 1
    assert [(r["vec_id"], [int(x) for x in r["embedding"]]) for r in back.orderBy("vec_id").collect()] == rows


def test_ground_truth_files(spark, tmp_path):
    truth = spark.createDataFrame([(q, r, q * 10 + r) for q in range(3) for r in (1, 2)], "query_id long, rank int, vec_id long")
    binary.write_ground_truth(truth, f"{tmp_path}/t.ibin", 2)
    assert sorted(binary.read_ground_truth(spark, f"{tmp_path}/t.ibin", 2).collect()) == sorted(truth.collect())


def test_graph_files(spark, tmp_path):
    body = np.array([2, 1, 2, 1, 0, 0], "<u4").tobytes()
    head = (24 + len(body)).to_bytes(8, "little") + np.array([2, 1], "<u4").tobytes() + bytes(8)
    (tmp_path / "g.bin").write_bytes(head + body)
    g, entry = binary.read_graph_file(spark, f"{tmp_path}/g.bin")
    assert entry == 1 and [r["neighbors"] for r in g.orderBy("vec_id").collect()] == [[1, 2], [0], []]


def test_label_files(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1, 2\n3\n\n4\n")
    assert [r["labels"] for r in labels.read_labels(spark, f"file://{tmp_path}/l.txt").orderBy("vec_id").collect()] == [[1, 2], [3], [], [4]]


def test_query_stream(spark, tmp_path):
    from shoal.streaming.search import search_stream

    q = table(spark, [(5, [0.1, 0])], "query_id")
    q.write.parquet(f"{tmp_path}/in")
    base, got = table(spark, BASE), []
    s = search_stream(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/in"), lambda b: exact.knn_join(b, base, 1), lambda d, n: got.extend(d.collect()), f"{tmp_path}/c")
    s.processAllAvailable()
    s.stop()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(5, 0)]


def test_global_pull_from_one_entry(spark):
    v = table(spark, [(i, [i, 0]) for i in range(12)])
    edges = spark.createDataFrame([(i, j) for i in range(12) for j in (i - 1, i + 1) if 0 <= j < 12], "src long, dst long")
    q = table(spark, [(0, [9.2, 0])], "query_id")
    assert found(search.global_pull(q, edges, v, v.where("vec_id = 0"), 2, 4, beam=2)) == [(0, 9), (0, 10)]


def test_supersteps_never_end_early_in_silence(spark):
    v = table(spark, [(i, [i, 0]) for i in range(12)])
    edges = spark.createDataFrame([(i, j) for i in range(12) for j in (i - 1, i + 1) if 0 <= j < 12], "src long, dst long")
    q, seeds = table(spark, [(0, [9.2, 0])], "query_id"), spark.createDataFrame([(0, 0)], "query_id long, vec_id long")
    assert inspect.signature(search.supersteps).parameters["most"].default is None  # all steps that it takes
    with pytest.raises(RuntimeError, match="still open"):
        search.supersteps(q, seeds, edges, v, 2, 4, 1, most=2)


def test_supersteps_with_the_met_rows_compacted(spark, monkeypatch):
    monkeypatch.setattr(search, "COMPACTED", 2)
    test_global_pull_from_one_entry(spark)


def test_what_is_cut_has_the_size_of_its_files(spark):
    df = spark.range(20).select("id", F.col("id").alias("x"))
    for i in range(6):  # estimates that go on would be products of all steps'
        df = lineage.cut(df.join(df.select("id", F.col("x").alias("y")), "id").select("id", F.col("y").alias("x")))
    assert df.count() == 20 and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1_000_000


def test_supersteps_compute_the_edges_once(spark):
    v = table(spark, [(i, [i, 0]) for i in range(12)])
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            met.add(len(b))
            yield b

    edges = spark.createDataFrame([(i, j) for i in range(12) for j in (i - 1, i + 1) if 0 <= j < 12], "src long, dst long")
    q = table(spark, [(0, [9.2, 0])], "query_id")
    assert found(search.global_pull(q, edges.mapInPandas(counted, "src long, dst long"), v, v.where("vec_id = 0"), 2, 4, beam=2)) == [(0, 9), (0, 10)]
    assert met.value == 22


@pytest.mark.parametrize("metric, k", [("l2", 1), ("l2", 3), ("cosine", 2)])
def test_more_centers_than_are_sent_to_all_tasks(spark, monkeypatch, metric, k):
    random.seed(4)
    points = table(spark, [(i, [random.randint(1, 5) for _ in range(3)]) for i in range(80)])
    centers = spark.createDataFrame([(i, [float(random.randint(1, 5)) for _ in range(3)]) for i in range(12)] + [(12, [1.0, 2.0, 3.0]), (13, [1.0, 2.0, 3.0])], "part_id long, center array<double>")
    got = lambda: [(r["vec_id"], r["rank"], r["part_id"], round(r["dist"], 6)) for r in exact.nearest_centers(points, centers, k, metric).orderBy("vec_id", "rank").collect()]
    sent = got()
    monkeypatch.setattr(exact, "MAX_CENTERS", 5)
    assert got() == sent and len(sent) == 80 * k


def test_weight_of_sizes_by_hand():
    n, total, largest = np.array([6.0, 2.0]), np.array([12.0, 2.0]), np.array([5.0, 1.5])
    want = 0.95 * (5 - 12 / 6) / 8 * (1 + np.sqrt(((6 / 8 - 0.5) ** 2 + (2 / 8 - 0.5) ** 2) / 2))
    assert cluster.Balancer().weight(n, total, largest) == pytest.approx(want)
    assert cluster.ratio_weight(np.array([4, 4]), np.array([[0.1, 0.1]])) == pytest.approx(0.95 * 0.5 * 4 / (4 + 1e-6))


def test_integer_kmeans():
    x = np.array([[0, 0], [1, 0], [100, 100], [101, 101], [100, 103]])
    centers, of, cost = cluster.integer_kmeans(x, 2)
    assert of[0] == of[1] != of[2] == of[3] == of[4] and centers.dtype == np.int64
    assert cost == ((x - centers[of]) ** 2).sum()
    _, even, _ = cluster.integer_kmeans(np.repeat([[5, 5]], 8, 0), 2, weight=1.0)
    assert np.bincount(even).tolist() == [4, 4]


def test_search_leaves_out_incomplete_vectors_and_cuts_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, None), (101, [None, 1.0]), (102, []), (103, [1.0, 2.0, 3.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = base.select(F.col("vec_id").alias("query_id"), "embedding")
    found = {}
    for r in exact.knn_join(queries, base, 3).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(found) == [*range(30), 103] and found[103] == [103]
    assert all(sorted(v) == [0, 1, 2] for q, v in found.items() if q < 30)


@pytest.fixture
def scattered(spark, monkeypatch):
    """Many blocks, each key in a task of its own, as in tables above a block's size."""
    monkeypatch.setattr(exact, "BASE_ROWS", 20)
    monkeypatch.setattr(exact, "QUERY_ROWS", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
def test_blocks_meet_whatever_tasks_they_are_dealt_to(scattered, metric):
    x = np.random.default_rng(3).normal(size=(100, 4))
    base = table(scattered, enumerate(x)).withColumn("embedding", F.col("embedding").cast("array<double>"))
    d = {"l2": ((x[::5, None] - x[None]) ** 2).sum(2), "mips": 1 - x[::5] @ x.T, "cosine": D.KERNELS["cosine"](x[::5], x)}[metric]
    queries = base.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = [(5 * i, int(j)) for i, row in enumerate(d) for j in row.argsort()[:6]]
    assert found(exact.knn_join(queries, base, 6, metric)) == want
    near = {(r["query_id"], r["vec_id"]) for r in exact.range_search(queries, base, 0.5, metric).collect()}
    assert near == {(5 * i, int(j)) for i, row in enumerate(d) for j in np.flatnonzero(row <= 0.5) if j != 5 * i}


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
def test_distances_are_added_from_left_to_right_as_in_sql(spark, metric):
    """Rows of the same components in other orders, seen from a constant vector: only the last bits of their sums differ."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=64).astype(np.float32).astype(float)
    rows = [list(rng.permutation(x)) for _ in range(40)]

    def left_to_right(a, b):
        total = lambda f: functools.reduce(lambda s, t: s + t, [f(u, v) for u, v in zip(a, b)])
        if metric == "l2":
            return total(lambda u, v: (u - v) * (u - v))
        dot = total(lambda u, v: u * v)
        return 1 - dot if metric == "mips" else 1 - dot / (math.sqrt(total(lambda u, v: u * u)) * math.sqrt(total(lambda u, v: v * v)))

    q = [0.1] * 64
    a = [float(np.float32(u)) for u in q]
    dist = [left_to_right(a, r) for r in rows]
    got = exact.knn_join(table(spark, [(7, q)], "query_id"), table(spark, enumerate(rows)), 40, metric)
    assert [(r["vec_id"], r["dist"]) for r in got.orderBy("rank").collect()] == sorted(enumerate(dist), key=lambda r: (r[1], r[0]))


def test_routed_queries_meet_their_parts_only_in_many_blocks(scattered):
    x = np.random.default_rng(3).normal(size=(100, 4))
    base = table(scattered, enumerate(x)).withColumn("embedding", F.col("embedding").cast("array<double>"))
    queries = base.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    route = queries.select("query_id", F.explode(F.array(F.col("query_id") % 3, F.lit(3).cast("long"))).alias("part_id"))
    parts = base.withColumn("part_id", (F.col("vec_id") % 4).cast("int"))  # of another type than the route's
    d = ((x[::5, None] - x[None]) ** 2).sum(2)
    want = [(5 * i, int(j)) for i, row in enumerate(d) for j in [j for j in row.argsort() if j % 4 in (5 * i % 3, 3)][:6]]
    assert found(search.exact_in_parts(queries, route, parts, 6)) == want


def test_queries_reach_every_part_whatever_task_it_is_dealt_to(scattered):
    x = np.random.default_rng(3).normal(size=(60, 4))
    base = table(scattered, enumerate(x))
    graphs = graph.build_part_graphs(partition.range_parts(base, 3).join(base, "vec_id"), 8, 20)
    queries = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert found(search.shared_nothing(queries, graphs, base, 3, 60)) == found(exact.knn_join(queries, base, 3))


def test_collaborative_search_shares_work_among_primary_parts(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(6, 8)) * 2
    x = c[np.arange(240) % 6] + 0.4 * rng.normal(size=(240, 8))
    base = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = base.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    edges = graph.knn_graph(base, 6).select("src", "dst")
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().cache()
    assigned, trace = partition.range_parts(base, 3), []
    found = search.collaborative(queries, search.top_index(base, 0.3), assigned, edges, base, 3, 5, 40, trace=trace).collect()
    truth = {(r["query_id"], r["vec_id"]) for r in exact.knn_join(queries, base, 5).collect()}
    assert len(truth & {(r["query_id"], r["vec_id"]) for r in found}) >= 0.9 * len(truth)
    read = search.accesses(trace).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in read}) == len(read)  # no row is expanded twice for a query
    assert max(sum(r["query_id"] == q and r["step"] == 1 and r["part"] == p for r in read) for q in range(0, 240, 40) for p in range(3)) <= 4
    owner = {r["vec_id"]: r["part_id"] for r in assigned.collect()}
    parts = {q: {r["part"] for r in read if r["query_id"] == q} for q in range(0, 240, 40)}
    assert all(r["part"] == owner[r["vec_id"]] or owner[r["vec_id"]] not in parts[r["query_id"]] for r in read)


def test_rotation_and_back(spark):
    base = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [0.0, -1.0, 0.5])], "vec_id long, embedding array<double>")
    there = D.rotated(base, 3, 4)
    back = {r["vec_id"]: r["embedding"] for r in D.rotated(there, 3, 4, back=True).collect()}
    assert back[0] == pytest.approx([1, 2, 3]) and back[1] == pytest.approx([0, -1, 0.5])
    assert there.first()["embedding"] != pytest.approx([1, 2, 3])


def test_index_is_written_and_read(spark, tmp_path):
    from shoal.sources import index

    positions = spark.createDataFrame([(5, 0, 0), (7, 1, 1)], "vec_id long, part_id long, pos long")
    index.write_index(str(tmp_path), positions=positions)
    index.write_index(str(tmp_path), append=True, positions=positions.withColumn("vec_id", F.col("vec_id") + 10))
    assert sorted(tuple(r) for r in index.read_index(spark, str(tmp_path), "positions").select("vec_id", "part_id", "pos").collect()) == [(5, 0, 0), (7, 1, 1), (15, 0, 0), (17, 1, 1)]
    with pytest.raises(ValueError):
        index.write_index(str(tmp_path), other=positions)


def test_a_wrong_order_is_found(spark):
    base = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    positions = partition.position_map(partition.range_parts(base, 2))
    ordered = partition.reordered(base, positions)
    assert partition.reorder_differences(ordered, base, positions).isEmpty()
    assert partition.reorder_differences(ordered.withColumn("pos", (F.col("pos") + 1) % 6), base, positions).count() == 12


def test_partition_entry_point(spark):
    base = spark.createDataFrame([(i, [float(i % 3) * 10, float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    for balanced in (True, False):
        fitted, assigned = cluster.partition_by_kmeans(base, 3, 2, balanced)
        rows = assigned.collect()
        assert fitted.count() == 3 and len(rows) == 120 and len({(r["vec_id"], r["part_id"]) for r in rows}) == 120
