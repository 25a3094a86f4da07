"""Further queries of the catalogue: graphs, resampling, model stand-ins, compound reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quilate.operators import clusters, graphs, lexical, stats, vectors
from quilate.plans import catalogue as C
from quilate.plans.catalogue import query, r6
from quilate.sources.scratch import new_folder, written
from quilate.sources.tables import table


def _edges(s, d):
    return C._pairs(s, d).where("sim >= 0.3").select("i", "j", F.round("sim", 9).alias("weight"))


def _nodes(s, d):
    return table(s, d, "embeddings").select((F.col("vec_id") % 50).alias("m")).distinct()


def _graph(s, d):
    """A similarity graph for each label, of the means of twenty parts of its vectors, and all nodes."""
    parts = C._vectors(s, d).where("label IS NOT NULL").withColumn("node", (F.col("label") * 100 + F.pmod(F.col("vec_id"), F.lit(20))).cast("bigint"))
    means = written(vectors.mean_vectors(parts, ["label", "node"]))
    a, b = means.select("label", F.col("node").alias("i"), F.col("embedding").alias("vi")), means.select("label", F.col("node").alias("j"), F.col("embedding").alias("vj"))
    edges = a.join(b, "label").where("i < j").withColumn("weight", F.round(vectors.cosine(F.col("vi"), F.col("vj")), 9)).where("weight >= 0.1")
    return edges.select(F.col("label").alias("graph"), "i", "j", "weight"), means.select(F.col("label").alias("graph"), "node")


@query()
def louvain(s, d):
    edges, nodes = _graph(s, d)
    return graphs.communities(edges, "graph", nodes)


@query()
def greedy_modularity(s, d):
    edges, nodes = _graph(s, d)
    return graphs.communities(edges, "graph", nodes, "greedy")


@query()
def community_summary(s, d):
    edges, nodes = _graph(s, d)
    found = written(graphs.communities(edges, "graph", nodes).select("node", "community"))
    people = nodes.select("node", (F.col("node") % 3).cast("int").alias("genero"))
    return graphs.summaries(found, people, "genero")


@query()
def density_clusters(s, d):
    pairs = written(C._pairs(s, d).select("i", "j", (1 - F.col("sim")).alias("distance")))
    nodes = _nodes(s, d)
    return graphs.density_clusters(pairs, nodes, "m", 0.5, 3, lambda e, n: vectors.components(e, n, "node", new_folder(s, "density")))


@query()
def label_prop(s, d):
    return graphs.label_propagation(_edges(s, d), _nodes(s, d), "m", new_folder(s, "label_prop"))


@query()
def community_purity(s, d):
    """Number, mean and weighed purity of the communities that label propagation finds."""
    found = graphs.label_propagation(_edges(s, d), _nodes(s, d), "m", new_folder(s, "label_prop")).select("node", F.col("label").alias("cluster"))
    return clusters.average_purity(found, _nodes(s, d).select(F.col("m").alias("node"), (F.col("m") % 3).cast("string").alias("genero")), "node", "genero")


@query(f"WITH {C._GROUPS}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS threshold), te AS (SELECT threshold, count(*) FILTER (WHERE sim >= threshold) AS edges FROM p, t GROUP BY 1) SELECT threshold, edges FROM te ORDER BY edges > 10 DESC, abs(threshold - 0.3), edges DESC LIMIT 1")
def best_threshold(s, d):
    t = C._pairs(s, d).select("sim", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7)))).alias("threshold"))
    e = t.groupBy("threshold").agg(F.count_if(F.col("sim") >= F.col("threshold")).alias("edges"))
    return e.orderBy(F.desc(F.col("edges") > 10), F.abs(F.col("threshold") - 0.3), F.desc("edges")).limit(1)


@query(f"WITH {C._GROUPS} SELECT i, j, round(50.0 * ((i % 5 = j % 5)::INT + (i % 3 = j % 3)::INT), 6) AS match_pct FROM p")
def config_match(s, d):
    same = lambda n: (F.col("i") % n).eqNullSafe(F.col("j") % n).cast("int")
    return C._pairs(s, d).select("i", "j", r6(F.lit(50.0) * (same(5) + same(3))).alias("match_pct"))


@query(f"WITH RECURSIVE {C._GROUPS}, ed AS (SELECT i, j FROM p WHERE sim >= 0.3 UNION SELECT j, i FROM p WHERE sim >= 0.3), r(node, other) AS (SELECT m, m FROM g UNION SELECT r.node, ed.j FROM r JOIN ed ON r.other = ed.i) SELECT node, min(other) AS component FROM r GROUP BY 1")
def components(s, d):
    return vectors.components(_edges(s, d), _nodes(s, d), "m", new_folder(s, "components"))


_PICK = "('0x' || substr(md5(k || '|' || b), 1, 8))::BIGINT % n + 1"


@query(f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id, value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), p AS (SELECT event_type, b, {_PICK} AS pick FROM r, (SELECT unnest(range(1, 51)) AS b)), m AS (SELECT event_type, b, avg(value) AS m FROM p JOIN r ON p.event_type IS NOT DISTINCT FROM r.event_type AND pick = r.k GROUP BY p.event_type, r.event_type, b) SELECT event_type, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1 HAVING count(*) > 5".replace("SELECT event_type, b, avg", "SELECT r.event_type, b, avg"))
def bootstrap_ci(s, d):
    """95 % intervals of a mean from 50 resamples of exact size, drawn by digests."""
    return stats.bootstrap_interval(table(s, d, "events"), "event_id", "value", "event_type").select("event_type", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


_RESAMPLED = f"""WITH r AS (SELECT label, embedding, row_number() OVER (ORDER BY vec_id) AS k, count(*) OVER () AS n FROM embeddings),
p AS (SELECT b, {_PICK} AS pick, count(*) AS t FROM r, (SELECT unnest(range(1, 51)) AS b) GROUP BY 1, 2),
x AS (SELECT b, label, t, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM p JOIN r ON pick = k),
s AS (SELECT b, label, pos, sum(t * x) AS s, sum(t * x * x) AS q FROM x GROUP BY ALL), n AS (SELECT b, label, sum(t) AS n FROM p JOIN r ON pick = k GROUP BY ALL),
w AS (SELECT b, label, sum(s * s) AS ss, sum(q) AS sq FROM s GROUP BY ALL), t AS (SELECT b, sum(s * s) AS tt FROM (SELECT b, pos, sum(s) AS s FROM s GROUP BY ALL) GROUP BY ALL),
e AS (SELECT b, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS g, sum(sq - ss / n) AS wcss, sum(ss / n) AS bt, stddev_pop(n) / avg(n) AS size_cv FROM w JOIN n USING (b, label) GROUP BY ALL),
m AS (SELECT b, n, g, wcss, bt - tt / n AS bcss, size_cv FROM e JOIN t USING (b)),
l AS (SELECT 'wcss' AS metric, wcss AS v FROM m UNION ALL SELECT 'bcss', bcss FROM m UNION ALL SELECT 'size_cv', size_cv FROM m UNION ALL SELECT 'explained', bcss / (wcss + bcss) FROM m UNION ALL SELECT 'calinski_harabasz', (bcss / (g - 1)) / (wcss / (n - g)) FROM m)
SELECT metric, count(*) AS valid, round(quantile_cont(v, 0.025), 5) AS low, round(quantile_cont(v, 0.975), 5) AS high FROM l GROUP BY 1"""


@query(_RESAMPLED)
def bootstrap_quality(s, d):
    """The intervals of five measures of the clusters by label."""
    q = vectors.resampled_quality(C._vectors(s, d), "vec_id", "label")
    return q.select("metric", "valid", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(f"WITH {C._CENTRED}, l AS (SELECT label, list(c ORDER BY pos) AS c FROM c GROUP BY 1) SELECT round(coalesce(avg(list_distance(a.c, b.c)), 0), 6) AS mean_inter FROM l a JOIN l b ON a.label < b.label")
def centroid_gap(s, d):
    return vectors.centroid_gap(C._vectors(s, d), "label").select(r6(F.col("mean_inter")).alias("mean_inter"))


def _designed(s, d):
    m = F.col("m")
    return C._means(s, d).select("m", "embedding", (m % 3).cast("string").alias("genero"), (m % 5).cast("string").alias("raca"), (F.floor(m / 5) % 2).cast("string").alias("regiao"))


_DESIGN = ", ".join(f"{x} AS {n}" for n, x in (("genero", "(m % 3)::VARCHAR"), ("raca", "(m % 5)::VARCHAR"), ("regiao", "((m // 5) % 2)::VARCHAR")))
_GRID_SQL = f"""WITH {C._GROUPS}, h AS (SELECT m, v, {_DESIGN} FROM g), cells AS (SELECT m, v, 'genero' AS trait, genero AS value FROM h UNION ALL SELECT m, v, 'raca', raca FROM h UNION ALL SELECT m, v, 'regiao', regiao FROM h),
cx AS (SELECT trait, value, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM cells), ce AS (SELECT trait, value, list(a ORDER BY pos) AS c FROM (SELECT trait, value, pos, avg(x) AS a FROM cx GROUP BY ALL) GROUP BY ALL),
two AS (SELECT a.m AS i, b.m AS j, a.v AS vi, b.v AS vj, a.genero AS gi, b.genero AS gj, a.raca AS ri, b.raca AS rj, a.regiao AS ei, b.regiao AS ej FROM h a JOIN h b ON a.m < b.m),
ev AS (SELECT trait, value, i, j, list_cosine_similarity(vi, vj) AS original, list_cosine_similarity(list_transform(range(1, len(c) + 1), lambda k: vi[k] - c[k]), list_transform(range(1, len(c) + 1), lambda k: vj[k] - c[k])) AS centred, ((gi = gj)::INT + (ri = rj)::INT + (ei = ej)::INT) * 100.0::DOUBLE / 3 AS match_pct, CASE trait WHEN 'genero' THEN gi = value AND gj = value WHEN 'raca' THEN ri = value AND rj = value ELSE ei = value AND ej = value END AS held FROM two, ce),
pr AS (SELECT *, 'centering' AS analysis FROM ev UNION ALL SELECT *, 'filtered' FROM ev WHERE held)
SELECT trait, value, analysis, count(*) AS total_pairs, round(round(avg(original), 6), 5) AS original_mean, round(round(avg(centred), 6), 5) AS centred_mean, round(round(stddev_pop(centred), 6), 5) AS centred_std, round(avg(match_pct), 2) AS match_mean, round(round(CASE WHEN stddev_pop(centred) > 0 AND stddev_pop(original) > 0 THEN corr(centred, original) END, 6), 5) AS centred_vs_original FROM pr GROUP BY ALL"""


@query(_GRID_SQL)
def pair_stats_grid(s, d):
    """The whole grid: every trait and value, centred on its mean, over all groups and over its own."""
    df = written(_designed(s, d))
    traits = ["genero", "raca", "regiao"]
    pairs = vectors.pair_analysis(df, "m", traits)
    cells = df.select("m", F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("value")) for t in traits])).alias("x"))
    own = cells.groupBy("x.trait", "x.value").agg(F.count("*").alias("own")).crossJoin(df.agg(F.count("*").alias("every")))
    groups = own.select("trait", "value", F.explode(F.array(F.struct(F.lit("centering").alias("analysis"), F.col("every").alias("group_size")), F.struct(F.lit("filtered").alias("analysis"), F.col("own").alias("group_size")))).alias("g")).select("trait", "value", "g.*")
    found = vectors.pair_statistics(pairs, groups).where("status = 'ok'")
    short = lambda c: F.round(c, 5).alias(c)
    return found.select("trait", "value", "analysis", "total_pairs", *map(short, ("original_mean", "centred_mean", "centred_std")), "match_mean", short("centred_vs_original"))


@query()
def pca(s, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = C._vectors(s, d).select("vec_id", array_to_vector("embedding").alias("x"))
    return PCA(k=10, inputCol="x", outputCol="y").fit(v).transform(v).select("vec_id", vector_to_array("y").alias("components"))


@query()
def kmeans(s, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = C._vectors(s, d).select("vec_id", array_to_vector("embedding").alias("x"))
    return KMeans(k=10, seed=42, featuresCol="x", predictionCol="cluster").fit(v).transform(v).select("vec_id", "cluster")


@query("WITH g AS (SELECT unnest(range(0, 21))::INTEGER AS k), m AS (SELECT min(value) AS a, max(value) AS b, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events) SELECT k, round(sum(exp(-0.5 * pow((a + (b - a) * k / 20 - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM events, g, m WHERE value IS NOT NULL GROUP BY 1")
def kde(s, d):
    e = table(s, d, "events").where("value IS NOT NULL").select("value")
    a, b, n, sd = e.agg(F.min("value"), F.max("value"), F.count("*"), F.stddev_samp("value")).first()
    h = (sd or 1.0) * n**-0.2 if n else 1.0
    grid = e.select("value", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    z = (F.lit(a or 0.0) + F.lit((b or 0.0) - (a or 0.0)) * F.col("k") / 20 - F.col("value")) / h
    return grid.groupBy("k").agg(F.round(F.sum(F.exp(-0.5 * z * z)) / (n * h * (2 * 3.141592653589793) ** 0.5), 9).alias("density"))


_HALF = C._TFIDF.replace("documents WHERE", "documents WHERE doc_id % 2 = @ AND")


@query(f"SELECT lang, rank, a.term AS term_0, b.term AS term_1 FROM (WITH {_HALF.replace('@', '0')} SELECT lang, rank, term FROM r WHERE rank <= 10) a JOIN (WITH {_HALF.replace('@', '1')} SELECT lang, rank, term FROM r WHERE rank <= 10) b USING (lang, rank)")
def ctfidf_compare(s, d):
    docs = C._texts(s, d)
    half = lambda h: lexical.top_terms(lexical.ctfidf(lexical.term_counts(docs.where(F.col("doc_id") % 2 == h))).withColumn("score", F.round("score", 9)), 10).select("lang", "rank", F.col("term").alias(f"term_{h}"))
    return half(0).join(half(1), ["lang", "rank"])


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 20")
def highest_values(s, d):
    return table(s, d, "events").where("value IS NOT NULL").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query()
def tukey_equivalent(s, d):
    return stats.tukey(table(s, d, "events"), "event_type", "value").where("NOT reject").select("group1", "group2")
