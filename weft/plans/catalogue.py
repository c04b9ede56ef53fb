"""The library's queries over the driver's tables, and the DuckDB SQL that they are checked against.

Tables stand in for the workloads' inputs: lineitem for a table to be sorted and for messages, suppliers and parts of
lineitem for an undirected graph (even and odd node ids), events for a directed graph and for traces, embeddings for
points, documents with labels for reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.exprs import owner_block, owner_cyclic, owner_half
from weft.operators import collectives, graph, gridsearch, kmeans, sort, trace
from weft.session import materialize, spread
from weft.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PARTS, MEMBERS, CLUSTERS = 8, 8, 3


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# sort


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


BOUNDS = f"""
    keys AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, l_linenumber, l_partkey, l_suppkey, l_orderkey FROM lineitem),
    placed AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM keys),
    bounds AS (SELECT i, k FROM placed, range(1, {PARTS}) AS r(i) WHERE place = CAST(floor(i / {PARTS}.0 * n) AS BIGINT)),
    listed AS (SELECT list(k ORDER BY i) AS bs FROM bounds),
    bucketed AS (SELECT keys.*, CAST(len(list_filter(bs, lambda x: x < k)) AS BIGINT) AS bucket FROM keys, listed)
"""


@query(f"WITH {BOUNDS} SELECT CAST(i AS INTEGER) AS i, k AS bound FROM bounds")
def sort_bounds(spark, sf_dir):
    found = sort.quantile_bounds(_keyed(spark, sf_dir), F.col("k"), PARTS)
    return found.select(F.posexplode("bounds").alias("p", "bound")).select((F.col("p") + 1).alias("i"), "bound")


@query(f"WITH {BOUNDS} SELECT bucket, count(*) AS n, min(k) AS low, max(k) AS high FROM bucketed GROUP BY bucket")
def sort_bucket_stats(spark, sf_dir):
    return sort.bucket_stats(_keyed(spark, sf_dir), F.col("k"), PARTS)


RANKED = "SELECT row_number() OVER (ORDER BY CAST(l_orderkey AS VARCHAR), l_linenumber, l_partkey, l_suppkey) AS rank, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"
ORDER = ["k", "l_linenumber", "l_partkey", "l_suppkey"]


@query(RANKED)
def sort_global_rank(spark, sf_dir):
    return sort.global_rank(_keyed(spark, sf_dir), ORDER, PARTS).select("rank", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(RANKED)
def sort_staged(spark, sf_dir):
    return sort.staged_sort(_keyed(spark, sf_dir), F.col("k"), ORDER, PARTS).select("rank", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"WITH {BOUNDS} SELECT l_suppkey % {PARTS} AS source, bucket, count(*) AS n, CAST(sum(length(k)) AS BIGINT) AS bytes FROM bucketed GROUP BY ALL")
def sort_partition_sizes(spark, sf_dir):
    return sort.partition_sizes(_keyed(spark, sf_dir), F.col("l_suppkey") % PARTS, F.col("k"), F.length("k"), PARTS)


@query(f"""WITH {BOUNDS}, s AS (SELECT l_suppkey % {PARTS} AS source, bucket, CAST(sum(length(k)) AS BIGINT) AS bytes FROM bucketed GROUP BY ALL)
    SELECT source, string_agg(bucket || '=' || bytes, ',' ORDER BY bucket) AS sizes FROM s GROUP BY source""")
def sort_size_map(spark, sf_dir):
    found = sort.size_map(sort_partition_sizes(spark, sf_dir))
    return found.select("source", F.expr("array_join(transform(map_entries(sizes), x -> concat(x.key, '=', x.value)), ',')").alias("sizes"))


@query("SELECT count(*) AS n, count(*) AS distinct_ranks, CAST(0 AS BIGINT) AS inversions FROM lineitem")
def sort_validate(spark, sf_dir):
    return sort.validate_sort(sort.global_rank(_keyed(spark, sf_dir), ORDER, PARTS), ORDER)


@query("SELECT count(DISTINCT length(CAST(l_orderkey AS VARCHAR))) = 1 AS uniform FROM lineitem")
def sort_uniform_rows(spark, sf_dir):
    return sort.uniform_lengths(_keyed(spark, sf_dir), F.col("k"))


# graphs


def _bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst")).distinct()
    return rows.union(rows.select("dst", "src"))


def _transitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    n = events.agg(F.max("user_id").alias("m")).first()["m"] + 1
    return events.select(F.col("user_id").alias("src"), ((F.col("user_id") + F.col("event_id") * F.col("event_id") + 1) % n).alias("dst")), n


EDGES = "e AS (SELECT DISTINCT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem), edges AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
USERS = "n AS (SELECT max(user_id) + 1 AS n FROM events), edges AS (SELECT DISTINCT user_id AS src, (user_id + event_id * event_id + 1) % n AS dst FROM events, n)"


@query(f"WITH {EDGES} SELECT src AS node, count(DISTINCT dst) AS degree FROM edges GROUP BY src")
def graph_out_degree(spark, sf_dir):
    return graph.out_degree(_bipartite(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src AS node, string_agg(DISTINCT CAST(dst AS VARCHAR), ',' ORDER BY CAST(dst AS VARCHAR)) AS neighbours FROM edges GROUP BY src")
def graph_adjacency(spark, sf_dir):
    found = graph.adjacency(_bipartite(spark, sf_dir))
    return found.select("node", F.array_join(F.array_sort(F.transform("neighbours", lambda x: x.cast("string"))), ",").alias("neighbours"))


@query(f"WITH {EDGES} SELECT least(min(src), min(dst)) AS low, greatest(max(src), max(dst)) AS high, greatest(max(src), max(dst)) + 1 AS n_nodes FROM edges")
def graph_id_range(spark, sf_dir):
    edges = _bipartite(spark, sf_dir)
    return graph.id_range(edges).crossJoin(F.broadcast(tables.node_count(edges)))


@query("""WITH c AS (SELECT r * 40 + c AS src, r, c FROM range(50) AS a(r), range(40) AS b(c))
    SELECT src, src - 40 AS dst FROM c WHERE r > 0 UNION ALL SELECT src, src + 40 FROM c WHERE r < 49
    UNION ALL SELECT src, src - 1 FROM c WHERE c > 0 UNION ALL SELECT src, src + 1 FROM c WHERE c < 39""")
def grid_edges(spark, sf_dir):
    return tables.grid_edges(spark, 50, 40)


def _walk(sources: str) -> str:
    """Distances by SQL, as far as 16 hops: the farthest nodes of the tables are 4 away, so a search that ended early would
    show."""
    return f"""WITH RECURSIVE {EDGES}, walk(trial, node, dist) AS (
        SELECT * FROM (VALUES {sources}) AS s(trial, node, dist)
        UNION SELECT trial, dst, dist + 1 FROM walk JOIN edges ON src = node WHERE dist < 16),
        found AS (SELECT trial, node, min(dist) AS dist FROM walk GROUP BY trial, node)"""


FROM_0 = "(CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0)"
FROM_3 = ", ".join(f"(CAST({i} AS BIGINT), CAST({v} AS BIGINT), 0)" for i, v in enumerate((0, 2, 5)))


def _from(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame(list(enumerate(nodes)), "trial long, node long")


@query(f"{_walk(FROM_0)} SELECT node, dist FROM found")
def bfs_shuffle(spark, sf_dir):
    return graph.bfs(_bipartite(spark, sf_dir), _from(spark, 0), "shuffle").select("node", "dist")


@query(f"{_walk(FROM_0)} SELECT node, dist FROM found")
def bfs_broadcast(spark, sf_dir):
    return graph.bfs(_bipartite(spark, sf_dir), _from(spark, 0), "broadcast").select("node", "dist")


@query(f"{_walk(FROM_0)} SELECT node, dist FROM found")
def bfs_block(spark, sf_dir):
    return graph.bfs(_bipartite(spark, sf_dir), _from(spark, 0), "block").select("node", "dist")


@query(f"{_walk(FROM_3)} SELECT trial, node, dist FROM found")
def bfs_multi_source(spark, sf_dir):
    return graph.bfs(_bipartite(spark, sf_dir), _from(spark, 0, 2, 5))


@query(f"{_walk(FROM_3)} SELECT trial, dist, count(*) AS n FROM found GROUP BY trial, dist")
def bfs_level_sizes(spark, sf_dir):
    return graph.level_sizes(graph.bfs(_bipartite(spark, sf_dir), _from(spark, 0, 2, 5)))


@query(f"{_walk(FROM_0)} SELECT count(*) AS n_found, count(*) AS n_expected, CAST(0 AS BIGINT) AS n_wrong FROM found")
def bfs_validate(spark, sf_dir):
    edges = materialize(_bipartite(spark, sf_dir))
    # level by level over the cluster, and trial by trial over arrays of the whole graph
    return graph.compare_distances(graph.bfs(edges, _from(spark, 0), "shuffle"), graph.bfs(edges, _from(spark, 0), "replicate"))


def _power(k: int) -> str:
    steps = [
        f"r{i} AS MATERIALIZED (SELECT v.node, coalesce(g.got, 0.0) AS r FROM r{i - 1} v LEFT JOIN (SELECT e.dst, sum(p.r / d.deg) AS got FROM edges e JOIN d ON d.src = e.src JOIN r{i - 1} p ON p.node = e.src GROUP BY e.dst) g ON g.dst = v.node)"
        for i in range(1, k + 1)
    ]
    return f"WITH {USERS}, d AS (SELECT src, count(*) AS deg FROM edges GROUP BY src), r0 AS (SELECT u.node, 1.0::DOUBLE / n AS r FROM n, (SELECT unnest(range(n)) AS node FROM n) u), " + ", ".join(steps)


@query(f"{_power(4)} SELECT node, round(r, 9) AS rank FROM r4")
def pagerank_k(spark, sf_dir):
    edges, n = _transitions(spark, sf_dir)
    return graph.pagerank(edges, n, iterations=4)[0].select("node", F.round("rank", 9).alias("rank"))


@query(f"{_power(4)} " + " UNION ALL ".join(f"SELECT {i} AS iteration, round(sqrt(sum((a.r - b.r) * (a.r - b.r))), 9) AS error FROM r{i} a JOIN r{i - 1} b USING (node)" for i in range(1, 5)))
def pagerank_error_trace(spark, sf_dir):
    edges, n = _transitions(spark, sf_dir)
    return graph.pagerank_trace(spark, graph.pagerank(edges, n, iterations=4)[1]).select("iteration", F.round("error", 9).alias("error"))


@query()
def pagerank_converged(spark, sf_dir):
    edges, n = _transitions(spark, sf_dir)
    return graph.pagerank(edges, n)[0]


@query(f"""WITH {EDGES}, n AS (SELECT greatest(max(src), max(dst)) + 1 AS n FROM edges)
    SELECT DISTINCT src AS node, src % {MEMBERS} AS cyclic, CAST(floor(src / ceil(n / {MEMBERS}.0)) AS BIGINT) AS block, CAST(CASE WHEN src < floor(n / 2.0) THEN 0 ELSE 1 END AS BIGINT) AS half FROM edges, n""")
def graph_owners(spark, sf_dir):
    edges = _bipartite(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).distinct().crossJoin(F.broadcast(tables.node_count(edges)))
    n = F.col("n_nodes")
    return nodes.select("node", owner_cyclic(F.col("node"), MEMBERS).alias("cyclic"), owner_block(F.col("node"), n, MEMBERS).alias("block"), owner_half(F.col("node"), n).alias("half"))


# k-means

DISTANCE = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _lloyd(steps: int) -> str:
    out = [
        "p AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, x FROM p ORDER BY vec_id LIMIT {CLUSTERS})",
    ]
    for i in range(steps + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d, any_value(x) AS x FROM (SELECT p.vec_id, p.x, c.cluster, {DISTANCE} AS d FROM p, c{i} c) GROUP BY vec_id)")
        out.append(f"m{i} AS MATERIALIZED (SELECT cluster, j, avg(v) AS v FROM (SELECT cluster, generate_subscripts(x, 1) - 1 AS j, unnest(x) AS v FROM a{i}) GROUP BY cluster, j)")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT k.cluster, list(coalesce(m.v, 0.0) ORDER BY t.j) AS x FROM c0 k CROSS JOIN (SELECT unnest(range(64)) AS j) t LEFT JOIN m{i} m ON m.cluster = k.cluster AND m.j = t.j GROUP BY k.cluster)")
    return "WITH " + ", ".join(out)


def _points(spark: SparkSession, sf_dir: str):
    points = table(spark, sf_dir, "embeddings")
    return points, kmeans.first_points(points, "vec_id", "embedding", CLUSTERS)


@query(f"{_lloyd(0)} SELECT vec_id, cluster, round(d, 6) AS dist2 FROM a0")
def kmeans_assign(spark, sf_dir):
    points, first = _points(spark, sf_dir)
    return kmeans.assign(points, first, "vec_id", "embedding").select(F.col("id").alias("vec_id"), "cluster", F.round("dist2", 6).alias("dist2"))


@query(f"{_lloyd(0)} SELECT c.cluster, (SELECT count(*) FROM a0 WHERE a0.cluster = c.cluster) AS n, CAST(unnest(range(64)) AS INTEGER) AS j, round(unnest(c.x), 6) AS value FROM c1 c")
def kmeans_step(spark, sf_dir):
    points, first = _points(spark, sf_dir)
    return kmeans.step(points, first, "embedding").select("cluster", "n", F.posexplode("centroid").alias("j", "v")).select("cluster", "n", "j", F.round("v", 6).alias("value"))


@query(f"{_lloyd(2)} SELECT c.cluster, CAST(unnest(range(64)) AS INTEGER) AS j, round(unnest(c.x), 6) AS value FROM c3 c")
def kmeans_fit_k(spark, sf_dir):
    points, first = _points(spark, sf_dir)
    return kmeans.centroid_frame(spark, kmeans.fit(points, first, "embedding", 3)).withColumn("value", F.round("value", 6))


@query(f"{_lloyd(1)} SELECT count(*) AS n, CAST(sum(CASE WHEN a.cluster <> b.cluster THEN 1 ELSE 0 END) AS BIGINT) AS moved, round(sum(CASE WHEN a.cluster <> b.cluster THEN 1 ELSE 0 END) / count(*), 9) AS delta FROM a0 a JOIN a1 b USING (vec_id)")
def kmeans_delta(spark, sf_dir):
    points, first = _points(spark, sf_dir)
    second = kmeans.fit(points, first, "embedding", 1)
    return kmeans.membership_change(points, first, second, "vec_id", "embedding").withColumn("delta", F.round("delta", 9))


# collectives

MESSAGES = f"m AS (SELECT l_orderkey % {MEMBERS} AS sender, l_partkey % {MEMBERS} AS place, l_partkey, length(l_returnflag || l_linestatus || CAST(l_orderkey AS VARCHAR)) AS size, l_quantity FROM lineitem)"
COUNTED = "count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % MEMBERS).alias("sender"), (F.col("l_partkey") % MEMBERS).alias("place"), "l_partkey", F.length(body).alias("size"), "l_quantity"
    )


@query(f"WITH {MESSAGES} SELECT sender, place AS receiver, {COUNTED} FROM m GROUP BY ALL")
def collective_all_to_all(spark, sf_dir):
    return collectives.traffic(collectives.all_to_all(_messages(spark, sf_dir), F.col("place"), MEMBERS), F.col("size"))


@query(f"WITH {MESSAGES} SELECT sender, receiver, {COUNTED} FROM m, range({MEMBERS}) AS r(receiver) WHERE sender = 0 GROUP BY ALL")
def collective_broadcast(spark, sf_dir):
    return collectives.traffic(collectives.broadcast(_messages(spark, sf_dir), MEMBERS), F.col("size"))


@query(f"WITH {MESSAGES} SELECT sender, CAST(0 AS BIGINT) AS receiver, {COUNTED} FROM m GROUP BY ALL")
def collective_gather(spark, sf_dir):
    return collectives.traffic(collectives.gather(_messages(spark, sf_dir)), F.col("size"))


@query(f"WITH {MESSAGES} SELECT sender, place AS receiver, {COUNTED} FROM m WHERE sender = 0 GROUP BY ALL")
def collective_scatter(spark, sf_dir):
    return collectives.traffic(collectives.scatter(_messages(spark, sf_dir), F.col("place"), MEMBERS), F.col("size"))


@query(f"WITH {MESSAGES} SELECT sender, sender - {MEMBERS // 2} AS receiver, {COUNTED} FROM m WHERE sender >= {MEMBERS // 2} GROUP BY ALL")
def collective_pair(spark, sf_dir):
    return collectives.traffic(collectives.pair(_messages(spark, sf_dir), MEMBERS), F.col("size"))


@query(f"WITH {MESSAGES} SELECT place, round(sum(l_quantity), 2) AS l_quantity FROM m GROUP BY place")
def collective_reduce(spark, sf_dir):
    return collectives.reduce_rows(_messages(spark, sf_dir), "place", "l_quantity").withColumn("l_quantity", F.round("l_quantity", 2))


@query(f"WITH {MESSAGES} SELECT sender, CAST(CASE WHEN l_partkey < 500 THEN 0 ELSE 1 END AS BIGINT) AS receiver, {COUNTED} FROM m GROUP BY ALL")
def collective_halves(spark, sf_dir):
    return collectives.traffic(collectives.halves(_messages(spark, sf_dir), 1000, "l_partkey"), F.col("size"))


@query(f"""WITH w AS (SELECT user_id % {MEMBERS} AS worker, sum(length(props)) / 1048576.0 AS mib, (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 1000.0 AS seconds FROM events GROUP BY ALL)
    SELECT worker, round(mib, 9) AS mib, round(CAST(seconds AS DOUBLE), 3) AS seconds, round(mib / seconds * 1e6, 6) AS micro_mib_per_s FROM w""")
def collective_throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % MEMBERS).alias("sender"), F.length("props").alias("size"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    found = collectives.throughput(rows, F.col("size"), F.col("at"), F.col("at"))
    return found.select("worker", F.round("mib", 9).alias("mib"), F.round("seconds", 3).alias("seconds"), F.round(F.col("mib_per_s") * 1e6, 6).alias("micro_mib_per_s"))


# traces

PHASE = "list_extract(['compute', 'alltoall', 'reduce', 'broadcast', 'process'], CAST(event_id % 5 AS INTEGER) + 1)"
DURATIONS = f"""d AS (SELECT user_id AS worker, CAST(event_id AS INTEGER) AS iter, {PHASE} AS phase,
    (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY event_id) AS ms FROM events)"""


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = F.array(*map(F.lit, trace.PHASES))
    key = F.concat(F.lit("trial_0_iter_"), F.col("event_id").cast("string"), F.lit("_"), F.get(phases, (F.col("event_id") % 5).cast("int")))
    stamp = F.struct(key.alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("value"))
    return trace.parse_trace(table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.array(stamp).alias("timestamps")))


@query(f"WITH {DURATIONS} SELECT worker, 0 AS trial, iter, phase, ms FROM d WHERE ms IS NOT NULL")
def trace_phase_durations(spark, sf_dir):
    return trace.phase_durations(_trace(spark, sf_dir))


@query(f"WITH {DURATIONS} SELECT round(avg(CASE WHEN phase = 'compute' THEN ms END), 6) AS compute, round(avg(CASE WHEN phase IN ('alltoall', 'broadcast') THEN ms END), 6) AS comm FROM d WHERE ms IS NOT NULL")
def trace_mean_phase(spark, sf_dir):
    found = trace.mean_phase(trace.phase_durations(_trace(spark, sf_dir)))
    return found.select(F.round("compute", 6).alias("compute"), F.round("comm", 6).alias("comm"))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("worker")).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    marks = [("worker_start", "a"), ("graph_generated", "b"), ("trial_0_start", "a"), ("trial_0_end", "b"), ("worker_end", "b")]
    return trace.parse_trace(rows.select("worker", F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in marks]).alias("timestamps")))


@query("SELECT max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS ms FROM events")
def trace_makespan(spark, sf_dir):
    return trace.makespan(_ends(spark, sf_dir))


@query("SELECT user_id AS worker, 0 AS trial, max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS ms FROM events GROUP BY user_id")
def trace_trial_times(spark, sf_dir):
    return trace.trial_times(_ends(spark, sf_dir))


@query("SELECT user_id AS worker, max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS ms FROM events GROUP BY user_id")
def trace_load_times(spark, sf_dir):
    return trace.load_times(_ends(spark, sf_dir))


# text and grid search


@query("SELECT doc_id, CAST(before AS BIGINT) AS before FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before <= 524288")
def text_parse_limit(spark, sf_dir):
    return tables.take_mebibytes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 0.5).select("doc_id", "before")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents),
    g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM w)
    SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def text_ngrams(spark, sf_dir):
    words = spread(table(spark, sf_dir, "documents").select("text")).select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)).alias("w"))
    pairs = F.expr("transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> concat(x, ' ', w[i + 1]))")
    return words.select(F.explode(F.concat("w", pairs)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(row_number() OVER (ORDER BY a, b, c, d, e) - 1 AS INTEGER) AS cfg_id, ['l1', 'l2'][a] AS norm, b AS ngram_max, [0.01::DOUBLE, 0.001, 0.0001, 0.00001][c] AS alpha,
    [10, 30, 50, 80][d] AS max_iter, ['l2', 'l1', 'elasticnet'][e] AS penalty
    FROM (VALUES (1), (2)) x(a), (VALUES (1), (2)) y(b), (VALUES (1), (2), (3), (4)) z(c), (VALUES (1), (2), (3), (4)) v(d), (VALUES (1), (2), (3)) u(e)""")
def grid_enumerate(spark, sf_dir):
    return gridsearch.enumerate_grid(spark)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), "text", F.col("quality").alias("label"))


@query("SELECT doc_id AS id, quality AS label, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents JOIN labels USING (doc_id)")
def fold_assign(spark, sf_dir):
    return gridsearch.assign_folds(_labelled(spark, sf_dir).select("id", "label"), "id", "label")


@query()
def grid_search_cv(spark, sf_dir):
    return gridsearch.grid_search(_labelled(spark, sf_dir))


@query()
def grid_best(spark, sf_dir):
    return gridsearch.best_configuration(materialize(grid_search_cv(spark, sf_dir)), gridsearch.enumerate_grid(spark))


@query()
def grid_search_slices(spark, sf_dir):
    return gridsearch.sliced_search(_labelled(spark, sf_dir), 8)


# byte ranges


@query("""WITH c AS (SELECT CAST(ceil(ceil(1000003 / 8.0) / 100.0) * 100 AS BIGINT) AS chunk)
    SELECT worker, least(worker * chunk, 1000003) AS start, least((worker + 1) * chunk, 1000003) AS stop FROM range(8) AS w(worker), c""")
def byte_ranges(spark, sf_dir):
    return tables.row_ranges(spark, 1_000_003, 8, 100)


@query("""SELECT worker, worker - worker % 4 AS base, CAST(CASE WHEN worker % 4 = 0 THEN 0 ELSE (1000003 // 4) * (worker % 4) + 1 END AS BIGINT) AS start,
    CAST(CASE WHEN worker % 4 = 3 THEN 1000003 ELSE (1000003 // 4) * (worker % 4 + 1) END AS BIGINT) AS stop FROM range(16) AS w(worker)""")
def byte_ranges_in_groups(spark, sf_dir):
    return tables.group_ranges(spark, 1_000_003, 16, 4)
