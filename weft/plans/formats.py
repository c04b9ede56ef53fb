"""Queries over files of other formats: a table is written in the format to the shared folder, read again and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.exprs import epoch_micros, epoch_millis, part_name
from weft.operators import actions, collectives, combine, graph, gridsearch, kmeans, sort, trace, training
from weft.plans.catalogue import BOUNDS, CLUSTERS, DISTANCE, EDGES, FROM_0, MEMBERS, ORDER, PARTS, QUERIES, RANKED, USERS, _bipartite, _from, _keyed, _labelled, _lloyd, _power, _transitions, _walk, query, table
from weft.session import materialize, shared_dir
from weft.sources import byteranges, csr, eventlog, sinks, tables, transactions


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"


# sources


@query(f"WITH {USERS} SELECT src, dst FROM edges")
def scan_tsv_edges(spark, sf_dir):
    edges, _ = _transitions(spark, sf_dir)
    edges.write.csv(path := _path(spark), sep="\t")
    return tables.read_edge_tsv(spark, path)


def _edge_lines(spark: SparkSession, sf_dir: str) -> str:
    """An edge list with comments, blank lines and lines that aren't edges."""
    edges = _bipartite(spark, sf_dir)
    line = F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" \t"), F.col("dst").cast("string"), F.when(F.col("src") % 3 == 0, F.lit(" 0.5")).otherwise(F.lit("")))
    odd = spark.createDataFrame([("# a comment",), ("% 1 2",), ("",), ("x y",), ("7",)], "value string")
    edges.select(line.alias("value")).union(odd).write.text(path := _path(spark))
    return path


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def scan_edge_list(spark, sf_dir):
    return tables.read_graph(spark, _edge_lines(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src, dst FROM edges WHERE src >= 10 AND src < 60")
def scan_edge_list_range(spark, sf_dir):
    return tables.read_graph(spark, _edge_lines(spark, sf_dir), 10, 60)


def _csr_file(spark: SparkSession, sf_dir: str) -> str:
    csr.write_csr_frame(_bipartite(spark, sf_dir), path := _path(spark) + ".sg")
    return path


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def scan_csr(spark, sf_dir):
    return tables.read_graph(spark, _csr_file(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src, dst FROM edges WHERE src >= 11 AND src < 61")
def scan_csr_range(spark, sf_dir):
    return tables.read_graph(spark, _csr_file(spark, sf_dir), 11, 61)


@query("SELECT CAST(j AS INTEGER) AS j, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 4) AS total FROM (SELECT generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding) AS v FROM embeddings) GROUP BY j")
def scan_points(spark, sf_dir):
    values = F.transform("embedding", lambda v: v.cast("string"))
    # a field that isn't a number is dropped
    table(spark, sf_dir, "embeddings").select(F.concat(F.array_join(values, ", "), F.lit(",none")).alias("value")).write.text(path := _path(spark))
    found = tables.read_points(spark, path).select(F.posexplode("features").alias("j", "v"))
    return found.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v").cast("double")), 4).alias("total"))


@query("SELECT quality AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY quality")
def scan_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("text is not null")
    # a review is a line
    line = F.concat(F.lit("__label__"), (F.col("quality") + 1).cast("string"), F.lit(" "), F.regexp_replace("text", "[\r\n]", " "))
    rows.select(line.alias("value")).write.text(path := _path(spark), compression="bzip2")
    return tables.read_reviews(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


#: Columns of lineitem that text files hold, of many lengths.
TEXT_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def _line_files(spark: SparkSession, sf_dir: str) -> str:
    rows = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("string") for c in TEXT_COLUMNS])
    rows.repartition(3).write.csv(path := _path(spark))
    return path


@query(f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in TEXT_COLUMNS)} FROM lineitem")
def scan_byte_ranges(spark, sf_dir):
    """A table of text files, read in 7 byte ranges."""
    return byteranges.read_range_table(spark, _line_files(spark, sf_dir), len(TEXT_COLUMNS), 7).toDF(*TEXT_COLUMNS)


@query("""WITH r AS (SELECT doc_id, quality AS label, regexp_replace(text, '[\r\n]', ' ', 'g') AS text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
    b AS (SELECT doc_id, label, length(text) AS chars, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
    SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS place, label, chars, CAST(before AS BIGINT) AS before FROM b WHERE before <= 131072""")
def scan_reviews_limit(spark, sf_dir):
    """Labelled lines in order up to an eighth of a MiB; the files are not read beyond."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("text is not null")
    line = F.concat(F.lit("__label__"), (F.col("quality") + 1).cast("string"), F.lit(" "), F.regexp_replace("text", "[\r\n]", " "))
    rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path := _path(spark))
    found, _ = byteranges.read_reviews_head(spark, path, 0.125)
    return sort.global_rank(found, ["before"], 4).select(F.col("rank").alias("place"), "label", F.length("text").cast("long").alias("chars"), "before")


@query(f"{_walk(FROM_0)} SELECT node % {MEMBERS} AS worker, node, dist FROM found")
def scan_results(spark, sf_dir):
    found = graph.bfs(_bipartite(spark, sf_dir), _from(spark, 0))
    rows = found.groupBy((F.col("node") % MEMBERS).alias("worker_id")).agg(F.collect_list(F.array("node", F.col("dist").cast("long"))).alias("local_distances"))
    sinks.write_results(rows.withColumn("timestamps", F.array(F.struct(F.lit("end").alias("key"), F.lit("1").alias("value")))), path := _path(spark))
    return tables.read_results(spark, path, lines=True)


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS keys FROM lineitem WHERE CAST(concat('0x', substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 16 = 0")
def scan_sample(spark, sf_dir):
    return tables.sample_rows(table(spark, sf_dir, "lineitem"), "l_orderkey", 16).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("keys"))


# sinks


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS overlaps FROM lineitem")
def sink_sorted_csv(spark, sf_dir):
    """Rows of the part files, and parts whose least key is below the greatest of the part before."""
    sinks.write_sorted_csv(_keyed(spark, sf_dir), "k", path := _path(spark), PARTS, "l_linenumber", "l_partkey", "l_suppkey")
    parts = tables.read_sort_table(spark, path, 5).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("c0").alias("low"), F.max("c0").alias("high"))
    # a row for each part
    last = parts.select("*", F.lag("high").over(trace.Window.orderBy("file")).alias("last"))
    return last.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("low") < F.col("last"), 1).otherwise(0)).cast("long").alias("overlaps"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS k, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def sink_parts(spark, sf_dir):
    """Two transactions of sorted parts, read by the manifest."""
    rows, path = _keyed(spark, sf_dir), _path(spark)
    for half in (F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 2 == 1):
        transactions.write_parts(sort.sort_exchange(rows.where(half), ORDER, PARTS), path)
    return transactions.read_parts(spark, path, "k string, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")


@query("SELECT user_id AS worker, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS ms FROM events GROUP BY user_id")
def sink_stats(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("worker")).agg((F.max(at) - F.min(at)).alias("ms"))
    sinks.write_stats(rows, path := _path(spark))
    return spark.read.csv(path, header=True, schema="worker long, ms long")


# sort


@query(f"""WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem WHERE CAST(concat('0x', substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 4 = 0),
    placed AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM s)
    SELECT CAST(i AS INTEGER) AS i, k AS bound FROM placed, range(1, {PARTS}) AS r(i) WHERE place = CAST(floor(i / {PARTS}.0 * n) AS BIGINT)""")
def sort_sampled_bounds(spark, sf_dir):
    found = sort.sampled_bounds(_keyed(spark, sf_dir), "k", PARTS, 4)
    return found.select(F.posexplode("bounds").alias("p", "bound")).select((F.col("p") + 1).alias("i"), "bound")


@query(f"WITH {BOUNDS} SELECT bucket, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM bucketed GROUP BY bucket")
def sort_map_stage(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    staged = sort.sort_map(keyed, F.col("k"), PARTS, _path(spark), sort.quantile_bounds(keyed, F.col("k"), PARTS))
    return staged.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query(RANKED)
def sort_fragments(spark, sf_dir):
    """A sort of text files whose buckets are planned from 20 seeded fragments of them."""
    columns = ("k", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    _keyed(spark, sf_dir).select(*columns).write.csv(path := _path(spark))
    rows = byteranges.read_range_table(spark, path, len(columns), PARTS).toDF(*columns)
    rows = rows.select("k", *[F.col(c).cast("long") for c in columns[1:]])
    bounds = sort.fragment_bounds(spark, path, 0, PARTS, length=1 << 12, seed=7)
    return sort.staged_sort(rows, F.col("k"), ORDER, PARTS, bounds).select("rank", "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", "l_suppkey")


@query("SELECT CAST(row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS rank, o_orderkey FROM orders")
def sort_reduce_stage(spark, sf_dir):
    # buckets that any other map stage has written will do
    staged = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k")).withColumn("bucket", F.substring("k", 1, 1).cast("long"))
    return sort.sort_reduce(staged, ["k"]).select("rank", "o_orderkey")


# graphs


def _same_walk(strategy: str):
    def run(spark, sf_dir):
        return graph.bfs(_bipartite(spark, sf_dir), _from(spark, 0), strategy).select("node", "dist")

    run.__name__ = f"bfs_{strategy}"
    return query(f"{_walk(FROM_0)} SELECT node, dist FROM found")(run)


bfs_scatter_reduce = _same_walk("scatter_reduce")
bfs_halves = _same_walk("halves")
bfs_replicate = _same_walk("replicate")

#: Distances from the first 64 suppliers: a level of all trials in each round, of nodes that weren't reached before.
WALK_64 = f"""WITH RECURSIVE {EDGES}, walk(trial, node, dist) USING KEY (trial, node) AS (
    SELECT s_suppkey, 2 * s_suppkey, 0 FROM supplier WHERE s_suppkey < 64
    UNION SELECT DISTINCT trial, dst, dist + 1 FROM walk JOIN edges ON src = node WHERE NOT EXISTS (FROM recurring.walk r WHERE r.trial = walk.trial AND r.node = dst))
    SELECT trial, node, dist FROM walk"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey < 64").select(F.col("s_suppkey").alias("trial"), (2 * F.col("s_suppkey")).alias("node"))


@query(WALK_64)
def bfs_masks(spark, sf_dir):
    """64 searches at once, a bit for each in a node's row."""
    return graph.bfs(_bipartite(spark, sf_dir), _suppliers(spark, sf_dir), "masks")


@query(WALK_64)
def bfs_regions(spark, sf_dir):
    """64 searches at once, by regions of node ids."""
    return graph.bfs(_bipartite(spark, sf_dir), _suppliers(spark, sf_dir), "regions")


#: Nodes in a row of the grid of parts.
WIDTH = 40


@query(f"""WITH p AS (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS node FROM part), s AS (SELECT node AS trial, node AS source FROM p WHERE node < 64),
    d AS (SELECT trial, CAST(abs(source // {WIDTH} - node // {WIDTH}) + abs(source % {WIDTH} - node % {WIDTH}) AS INTEGER) AS dist FROM s, p)
    SELECT trial, dist, count(*) AS n FROM d GROUP BY trial, dist""")
def bfs_part_grid(spark, sf_dir):
    """64 searches over a grid of all parts, 40 in a row: a graph as deep as the table is long."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    node = part.crossJoin(F.broadcast(part.agg(F.min("p_partkey").alias("first")))).select((F.col("p_partkey") - F.col("first")).alias("node"))
    right = node.where(F.col("node") % WIDTH < WIDTH - 1).select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    down = node.select(F.col("node").alias("src"), (F.col("node") + WIDTH).alias("dst"))
    one_way = right.union(down).join(node.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    return graph.level_sizes(graph.bfs(one_way.union(one_way.select("dst", "src")), node.where("node < 64").select(F.col("node").alias("trial"), "node"), "regions"))


#: The published benchmark: a grid of 500 x 500 nodes and 64 trials.
SIDE, TRIALS = 500, 64


@query(f"""WITH s AS (SELECT t AS trial, (t * 390727 + 11) % {SIDE * SIDE} AS node FROM range({TRIALS}) AS r(t)),
    d AS (SELECT trial, CAST(abs(node // {SIDE} - r) + abs(node % {SIDE} - c) AS INTEGER) AS dist FROM s, range({SIDE}) AS a(r), range({SIDE}) AS b(c))
    SELECT trial, dist, count(*) AS n FROM d GROUP BY trial, dist""")
def bfs_grid(spark, sf_dir):
    """Nodes at each distance on the published benchmark's grid, from 64 sources."""
    sources = spark.range(TRIALS).select(F.col("id").alias("trial"), ((F.col("id") * 390727 + 11) % (SIDE * SIDE)).alias("node"))
    return graph.level_sizes(graph.bfs(tables.grid_edges(spark, SIDE, SIDE), sources, "replicate"))


@query("SELECT CAST(64 AS BIGINT) AS n, CAST(64 AS BIGINT) AS n_nodes, CAST(64 AS BIGINT) AS n_with_edges")
def graph_sources(spark, sf_dir):
    """Sources are distinct nodes with an edge."""
    edges = _bipartite(spark, sf_dir)
    picked = graph.pick_sources(edges, 64, seed=27491095)
    known = picked.join(graph.out_degree(edges), "node").agg(F.count(F.lit(1)).alias("n_with_edges"))
    return picked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node").alias("n_nodes")).crossJoin(F.broadcast(known))


@query("SELECT count(DISTINCT l_suppkey) AS n_nodes, bool_or(l_quantity > 49) AS has_work FROM lineitem")
def frontier_union(spark, sf_dir):
    ids, work = collectives.union_ids(table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") > 49).alias("w")), "l_suppkey", "w")
    return ids.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(F.broadcast(work))


# k-means


@query(f"""WITH p AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, x FROM p ORDER BY vec_id LIMIT {CLUSTERS}),
    a AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, any_value(x) AS x FROM (SELECT p.vec_id, p.x, c.cluster, {DISTANCE} AS d FROM p, c0 c) GROUP BY vec_id),
    m AS (SELECT cluster, j, avg(v) AS v FROM (SELECT cluster, generate_subscripts(x, 1) - 1 AS j, unnest(x) AS v FROM a) GROUP BY cluster, j)
    SELECT k.cluster, CAST(t.j AS INTEGER) AS j, round(coalesce(m.v, 0.0), 6) AS value FROM (SELECT unnest(range({CLUSTERS + 1}))::INTEGER AS cluster) k CROSS JOIN (SELECT unnest(range(64)) AS j) t LEFT JOIN m ON m.cluster = k.cluster AND m.j = t.j""")
def kmeans_empty_cluster(spark, sf_dir):
    """One step where no point is near the last centroid, which goes to the origin."""
    points = table(spark, sf_dir, "embeddings")
    first = kmeans.first_points(points, "vec_id", "embedding", CLUSTERS)
    far = kmeans.np.concatenate([first, kmeans.np.full((1, first.shape[1]), 1e6)])
    found = kmeans.step(points, far, "embedding")
    return found.select("cluster", F.posexplode("centroid").alias("j", "v")).select("cluster", "j", F.round("v", 6).alias("value"))


@query(f"{_lloyd(2)} SELECT c.cluster, CAST(unnest(range(64)) AS INTEGER) AS j, round(unnest(c.x), 6) AS value FROM c3 c")
def kmeans_bounded(spark, sf_dir):
    """Three steps with bounds kept for each point."""
    points = table(spark, sf_dir, "embeddings")
    found, _ = kmeans.bounded_fit(points, kmeans.first_points(points, "vec_id", "embedding", CLUSTERS), "embedding", 3)
    return kmeans.centroid_frame(spark, found).withColumn("value", F.round("value", 6))


@query(f"{_lloyd(3)} SELECT 1 AS iteration, count(*) AS n, count(*) AS moved, 1.0::DOUBLE AS delta FROM a0" + "".join(
    f" UNION ALL SELECT {i + 1}, count(*), count(*) FILTER (a.cluster <> b.cluster), round(count(*) FILTER (a.cluster <> b.cluster) / count(*), 9) FROM a{i - 1} a JOIN a{i} b USING (vec_id)" for i in range(1, 4)))
def kmeans_delta_trace(spark, sf_dir):
    """Points that change cluster in each of four steps."""
    points = table(spark, sf_dir, "embeddings")
    _, trace_ = kmeans.bounded_fit(points, kmeans.first_points(points, "vec_id", "embedding", CLUSTERS), "embedding", 4)
    return spark.createDataFrame([(t["iteration"], t["n"], t["moved"], round(t["delta"], 9)) for t in trace_], "iteration int, n long, moved long, delta double")


@query("SELECT CAST(5 AS BIGINT) AS n_clusters, CAST(320 AS BIGINT) AS n_values, CAST(320 AS BIGINT) AS n_inside, (SELECT count(*) FROM embeddings) AS n_points")
def kmeans_random_start(spark, sf_dir):
    """Centroids drawn evenly from 0 to 100, and the points of a step from them."""
    first = kmeans.uniform_points(5, 64)
    values = kmeans.centroid_frame(spark, first)
    inside = F.sum(((F.col("value") >= 0) & (F.col("value") < 100)).cast("long"))
    shape = values.agg(F.countDistinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_values"), inside.alias("n_inside"))
    return shape.crossJoin(F.broadcast(kmeans.step(table(spark, sf_dir, "embeddings"), first, "embedding").agg(F.sum("n").alias("n_points"))))


# training


@query()
def grid_refit(spark, sf_dir):
    """The best configuration of the search, trained on all labelled texts but a fold: rows and accuracy of both sides."""
    rows = materialize(gridsearch.assign_folds(_labelled(spark, sf_dir).where("text is not null and label is not null"), "id", "label"))
    best = QUERIES["grid_best"](spark, sf_dir).first()
    _, said = training.refit(rows, best.asDict() if best else {"ngram_max": 1, "norm": "l2", "alpha": 1e-4, "max_iter": 10, "penalty": "l2"})
    right = F.avg((F.col("label") == F.col("predicted")).cast("double"))
    return said.groupBy(F.when(F.col("fold") == 0, "test").otherwise("train").alias("part")).agg(F.count(F.lit(1)).alias("n"), right.alias("accuracy"))


@query("""WITH f AS (SELECT quality AS label, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS fold FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL)
    SELECT CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS part, CAST(label AS INTEGER) AS label, count(*) AS n FROM f GROUP BY ALL""")
def refit_sides(spark, sf_dir):
    """Rows of each label that a model is trained on and scored on."""
    rows = gridsearch.assign_folds(_labelled(spark, sf_dir).where("text is not null and label is not null"), "id", "label")
    cfg = {"ngram_max": 1, "norm": "l2", "alpha": 1e-4, "max_iter": 2, "penalty": "l2"}
    _, said = training.refit(rows, cfg)
    return said.groupBy(F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"), "label").agg(F.count(F.lit(1)).alias("n"))


# collectives and traces


@query(f"""WITH w AS (SELECT user_id % {MEMBERS} AS worker, sum(length(props)) / 1048576.0 AS mib, (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 1000.0 AS seconds FROM events GROUP BY ALL)
    SELECT count(*) AS workers, round(CAST(sum(mib / seconds * 1e6) AS DOUBLE), 5) AS micro_mib_per_s FROM w""")
def collective_total_throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % MEMBERS).alias("sender"), F.length("props").alias("size"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    found = collectives.total_throughput(collectives.throughput(rows, F.col("size"), F.col("at"), F.col("at")))
    return found.select("workers", F.round(F.col("mib_per_s") * 1e6, 5).alias("micro_mib_per_s"))


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS event_type FROM events GROUP BY user_id")
def collective_concat(spark, sf_dir):
    return collectives.concat_ordered(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT count(*) AS records_read, TRUE AS phases_add_up, TRUE AS within_makespan FROM events")
def trace_own_run(spark, sf_dir):
    """The log of a run of this library over events: records that its tasks read, and whether the phases of each task add up
    to its time and no task takes longer than the run."""
    edges, _ = _transitions(spark, sf_dir)
    with eventlog.recorded(spark) as log:
        graph.out_degree(edges).write.format("noop").mode("overwrite").save()
    tasks = eventlog.read_tasks(spark, log)
    marks = materialize(trace.parse_trace(eventlog.task_trace(tasks)))
    phases = trace.phase_durations(marks).groupBy("worker", "trial").agg(F.sum("ms").alias("parts"))
    times = trace.trial_times(marks).join(phases, ["worker", "trial"], "left").crossJoin(F.broadcast(trace.makespan(marks).withColumnRenamed("ms", "whole")))
    checks = times.agg(F.bool_and(F.col("parts").eqNullSafe(F.col("ms"))).alias("phases_add_up"), F.bool_and(F.col("ms") <= F.col("whole")).alias("within_makespan"))
    # a stage that is run again reads its records again
    read = tasks.where("succeeded").groupBy("stage", "part").agg(F.max("records_read").alias("n")).agg(F.sum("n").alias("records_read"))
    return read.crossJoin(F.broadcast(checks))


@query("SELECT CAST(user_id % 4 AS INTEGER) AS trial, count(DISTINCT event_id % 7) AS n_iterations, CAST(min(event_id % 7) AS INTEGER) AS first, CAST(max(event_id % 7) AS INTEGER) AS last FROM events GROUP BY user_id % 4")
def trace_trials(spark, sf_dir):
    key = F.format_string("trial_%d_iter_%d_compute", F.col("user_id") % 4, F.col("event_id") % 7)
    stamp = F.struct(key.alias("key"), F.lit("1").alias("value"))
    return trace.distinct_trials(trace.parse_trace(table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.array(stamp).alias("timestamps"))))


@query("""WITH s AS (SELECT user_id AS fn_id, count(*) AS n FROM events GROUP BY user_id), m AS (SELECT user_id AS fn_id, max(epoch_us(ts) // 1000) AS ended FROM events WHERE user_id % 2 = 0 GROUP BY user_id)
    SELECT fn_id, n, ended FROM s LEFT JOIN m USING (fn_id)""")
def stats_update(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "fn_id")
    more = events.where("fn_id % 2 = 0").groupBy("fn_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ended"))
    return trace.update_stats(events.groupBy("fn_id").agg(F.count(F.lit(1)).alias("n")), more, "fn_id")


@query("SELECT user_id AS fn_id, count(*) AS n, NULL::BIGINT AS bytes FROM events GROUP BY user_id UNION ALL SELECT user_id, NULL, CAST(sum(length(props)) AS BIGINT) FROM events GROUP BY user_id")
def stats_merge(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("fn_id"))
    return trace.merge_stats([by.agg(F.count(F.lit(1)).alias("n")), by.agg(F.sum(F.length("props")).alias("bytes"))])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def results_flatten(spark, sf_dir):
    """Lists of records, null for finished orders, as rows."""
    record = F.array(F.struct("o_orderkey", "o_custkey"))
    return trace.flatten_results(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "F", record).alias("results")))


@query("""WITH u AS (SELECT user_id AS fn, min(epoch_us(ts) // 1000) AS a, max(epoch_us(ts) // 1000) AS b FROM events GROUP BY user_id)
    SELECT fn, a + fn - (SELECT min(a) FROM u) AS wait_ms, b - a - fn AS run_ms FROM u""")
def trace_gantt(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("fn")).agg(F.min(at).alias("submit"), F.max(at).alias("end"))
    return trace.gantt(rows.withColumn("start", F.col("submit") + F.col("fn")))


@query(f"{_power(4)} SELECT node, round(r, 9) AS rank FROM r4")
def pagerank_combined(spark, sf_dir):
    """Four steps with the caller's own sum of what nodes are given."""
    edges, n = _transitions(spark, sf_dir)
    return graph.pagerank(edges, n, iterations=4, combiner=combine.sums(["dst"]))[0].select("node", F.round("rank", 9).alias("rank"))


@query(f"SELECT l_partkey % {MEMBERS} AS member, count(DISTINCT l_suppkey) AS n_nodes FROM lineitem GROUP BY 1")
def frontier_combined(spark, sf_dir):
    """Each member's union of node sets, as bitmaps joined by the caller's function."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % MEMBERS).alias("member"), F.floor(F.col("l_suppkey") / 32768).alias("block"), (F.col("l_suppkey") % 32768).alias("bit"))
    # a bitmap for each task's rows of a member, not for each row
    states = rows.groupBy("member", "block", F.spark_partition_id().alias("p")).agg(F.bitmap_construct_agg("bit").alias("bits")).select("member", "block", "bits")
    found = combine.combine(states, ["member", "block"], combine.bitmap_union(["member", "block"], "bits"))
    return found.groupBy("member").agg(F.sum(F.bitmap_count("bits")).alias("n_nodes"))


def _describe(event_id: int, user_id: int, event_type: str) -> dict:
    """An action that refuses some of its calls."""
    if event_id % 97 == 5:
        raise ValueError(f"event {event_id} is refused")
    return {"worker": user_id % 8, "name": f"{event_type}-{event_id % 10}"}


@query("""SELECT event_id AS call, CASE WHEN event_id % 97 <> 5 THEN user_id % 8 END AS worker, CASE WHEN event_id % 97 <> 5 THEN event_type || '-' || (event_id % 10) END AS name,
    CASE WHEN event_id % 97 = 5 THEN 'ValueError: event ' || event_id || ' is refused' END AS error FROM events""")
def action_events(spark, sf_dir):
    """A function run by name over all events; calls that fail are rows with their error."""
    params = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return actions.run_action(params, {"describe": (_describe, "worker long, name string")}, "describe", "event_id").select("call", "worker", "name", "error")


@query("SELECT event_id, printf('part-%05d', event_id) AS part, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us FROM events")
def scalar_formats(spark, sf_dir):
    """Part names, and times from text in milliseconds and microseconds since 1970."""
    ts = F.col("ts").cast("timestamp")
    millis, micros = epoch_millis(F.unix_millis(ts).cast("string")), epoch_micros(F.unix_micros(ts).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", part_name(F.col("event_id")).alias("part"), F.unix_millis(millis).alias("ms"), F.unix_micros(micros).alias("us"))


@query(f"""WITH m AS (SELECT l_orderkey % {MEMBERS} AS sender, l_partkey % {MEMBERS} AS place, length(l_returnflag || l_linestatus || CAST(l_orderkey AS VARCHAR)) AS size FROM lineitem),
    k AS (SELECT 'all_to_all' AS benchmark, sender, place AS receiver, size FROM m UNION ALL SELECT 'broadcast', sender, r, size FROM m, range({MEMBERS}) AS x(r) WHERE sender = 0
        UNION ALL SELECT 'gather', sender, 0, size FROM m UNION ALL SELECT 'scatter', sender, place, size FROM m WHERE sender = 0 UNION ALL SELECT 'pair', sender, sender - {MEMBERS // 2}, size FROM m WHERE sender >= {MEMBERS // 2})
    SELECT benchmark, count(DISTINCT sender) AS senders, count(DISTINCT receiver) AS receivers, count(*) AS n, CAST(sum(size) AS BIGINT) AS payload_size FROM k GROUP BY benchmark""")
def collective_records(spark, sf_dir):
    """A record for each collective, by name: its members and what it moves."""
    body = F.concat("l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % MEMBERS).alias("sender"), (F.col("l_partkey") % MEMBERS).alias("place"), F.length(body).alias("size"))
    return collectives.records(rows, F.col("place"), F.col("size"), MEMBERS)
