"""Connectors, text metrics, statistics and graphs against plain Python."""

import asyncio
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quilate.functions import text as T
from quilate.operators import conllu, connect, enrich, graphs, lexical, metrics, stats, vectors

CONLLU = "# text = Ela disse que viu o gato no jardim.\n1\tEla\tele\tPRON\t_\t_\t2\tnsubj\t_\t_\n2\tdisse\tdizer\tVERB\t_\t_\t0\troot\t_\t_\n3\tque\tque\tSCONJ\t_\t_\t4\tmark\t_\t_\n4\tviu\tver\tVERB\t_\t_\t2\tccomp\t_\t_\n5\to\to\tDET\t_\t_\t6\tdet\t_\t_\n6\tgato\tgato\tNOUN\t_\t_\t4\tobj\t_\t_\n7-8\tno\t_\t_\t_\t_\t_\t_\t_\t_\n7\tem\tem\tADP\t_\t_\t9\tcase\t_\t_\n8\to\to\tDET\t_\t_\t9\tdet\t_\t_\n9\tjardim\tjardim\tNOUN\t_\t_\t4\tobl\t_\t_\n10\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_\n\n# text = Tem 2 cães e gatos pretos.\n1\tTem\tter\tVERB\t_\t_\t0\troot\t_\t_\n2\t2\t2\tNUM\t_\t_\t3\tnummod\t_\t_\n3\tcães\tcão\tNOUN\t_\t_\t1\tobj\t_\t_\n4\te\te\tCCONJ\t_\t_\t5\tcc\t_\t_\n5\tgatos\tgato\tNOUN\t_\t_\t3\tconj\t_\t_\n6\tpretos\tpreto\tADJ\t_\t_\t5\tamod\t_\t_\n7\t.\t.\tPUNCT\t_\t_\t1\tpunct\t_\t_\n"


def test_message_formats():
    part = SimpleNamespace(text="hi")
    same = [{"role": "user", "content": "hi"}]
    assert connect.normalised("hi") == connect.normalised(SimpleNamespace(content=[part])) == connect.normalised([{"content": "hi"}]) == same
    assert connect.normalised([SimpleNamespace(role="system", content="s"), {"role": "user", "content": [{"text": "u"}]}]) == [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]


def test_parser_retries_and_kinds():
    calls = []

    def post(url, form, timeout):
        calls.append(form["data"])
        return (500, "busy") if len(calls) < 3 else (200, '{"result": "parsed"}')

    assert connect.parser("http://x", post=post, delay=0)()("texto") == "parsed" and len(calls) == 3
    for error, kind in ((TimeoutError(), "timeout"), (ConnectionError(), "request"), (KeyError(), "generic")):
        with pytest.raises(connect.RequestFailed) as e:
            connect.retried(lambda error=error: (_ for _ in ()).throw(error), 2, 0)
        assert e.value.kind == kind
    with pytest.raises(connect.RequestFailed, match="no result"):
        connect.parser("http://x", post=lambda *_: (200, "{}"), attempts=1)()("t")


def test_registry():
    made = []
    r = connect.Registry({"openai": lambda key: made.append(key) or "client"}, {"openai": ["k1", "k2"], "gemini": []})
    assert r.client("gpt-4o") == r.client("gpt-4") == "client" and made == ["k1"]
    for model in ("nope", "gemini-2.0"):
        with pytest.raises(ValueError):
            r.client(model)


def test_limiter_keeps_its_rate():
    async def run():
        limit, begin = connect.Limiter(3, 0.2), time.monotonic()
        for _ in range(7):
            async with limit:
                pass
        return time.monotonic() - begin

    assert asyncio.run(run()) >= 0.4


def test_bounded_concurrency_and_responses(spark):
    def registry():
        state = {"now": 0, "most": 0}

        def maker(_):
            async def client(config, messages):
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                await asyncio.sleep(0.01)
                state["now"] -= 1
                if messages[0]["content"] == "bad":
                    raise RuntimeError("no")
                return str(state["most"])

            return client

        return connect.Registry({"openai": maker}, {"openai": ["k"]})

    rows = [(i, "ok", "gpt-4o", 1) for i in range(20)] + [(20, "bad", "gpt-4o", 2), (21, "x", "unknown", 1), (22, "ok", "gpt-4o", 3), (23, "ok", "gpt-4o", 0)]
    items = spark.createDataFrame(rows, "id int, message string, model string, times int").coalesce(1)
    got = connect.asked(items, "message", "model", registry, times="times", concurrency=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert len(by[22]) == 3 and 23 not in by and by[20][0].error == "RuntimeError: no" and by[20][0].response is None and "unknown" in by[21][0].error
    assert max(int(r.response) for r in got if r.response) <= 4 + 2  # an item in a slot may ask three at once
    assert connect.counters(enrich.call(items, "id", "message", lambda: str.upper)).first().asDict() == {"ok": 24, "failed": 0}


def test_fixture_of_two_sentences(spark):
    df = spark.createDataFrame([("a", CONLLU), ("b", ""), ("c", None)], "id string, parse string")
    rows = {r["id"]: r.asDict() for r in conllu.complexity(df, "id", "parse").collect()}
    want = {"MLC": 16.0, "MLS": 8.0, "DCC": 0.0, "CPC": 3.0, "profundidade_media": 3.0, "profundidade_max": 3, "ttr": 0.9375, "lexical_density": 0.5, "token_quantity": 16}
    assert {k: rows["a"][k] for k in want} == want and rows["a"]["lemmas"] == "ele dizer que ver o gato _ em o jardim ter cão e gato preto"
    assert all(rows["b"][m] == 0 for m in conllu.METRICS) and rows["c"]["lemmas"] == ""
    adjectives, nouns = df.where("id = 'a'").select(*conllu.word_lists(F.col("parse"))).first()
    assert adjectives == ["pretos"] and nouns == ["gato", "jardim", "cães", "gatos"]


def test_depth_of_random_trees(spark):
    r, rows = random.Random(4), []
    for d in range(40):
        n = r.randint(1, 60)
        heads = [0] + [r.randint(0, i) for i in range(1, n)]
        rows.append((d, "\n".join(f"{i + 1}\tw\tw\tX\t_\t_\t{h}\tdep\t_\t_" for i, h in enumerate(heads)), heads))

    def depth(heads):
        def up(i):
            return 0 if heads[i] == 0 else 1 + up(heads[i] - 1)

        return max(map(up, range(len(heads))))

    got = {x.d: x.profundidade_max for x in conllu.complexity(spark.createDataFrame([x[:2] for x in rows], "d int, parse string"), "d", "parse").collect()}
    assert got == {d: depth(h) for d, _, h in rows}
    loop = spark.createDataFrame([(1, "1\tw\tw\tX\t_\t_\t2\tdep\t_\t_\n2\tw\tw\tX\t_\t_\t1\tdep\t_\t_")], "d int, parse string")
    assert conllu.complexity(loop, "d", "parse").count() == 1  # a broken tree ends, too


def test_all_metrics_and_defaults(spark):
    df = spark.createDataFrame([(1, "Casa bonita. Ela comprou pão!", CONLLU, ["PER", "LOC", "GPE", "X"]), (2, "  ", CONLLU, ["ORG"]), (3, None, None, None)], "id int, response string, parse string, ents array<string>")
    rows = {r.id: r.asDict() for r in metrics.analyzed(df, "id", "response", "parse", "ents").collect()}
    assert len(rows[1]) == 23 and (rows[1]["per_count"], rows[1]["org_count"], rows[1]["loc_count"]) == (1, 0, 2)
    assert rows[1]["avg_word_length"] == 4.6 and rows[1]["sentence_length_variance"] == 0.25 and rows[1]["MLC"] == 16.0
    for k in (2, 3):
        assert {m: rows[k][m] for m in metrics.DEFAULTS} == metrics.DEFAULTS
    bare = metrics.analyzed(df, "id", "response", include_lemmatization=False, include_ner=False).where("id = 1").first()
    assert bare.lemmas == "" and bare.per_count == 0 and bare.MLC == 0.0
    wide = metrics.added(df.withColumn("MLC", F.lit(-1)), "id", "response", parse="parse")
    assert wide.where("id = 1").first().MLC == 16.0
    assert metrics.summary(df, wide, F.col("response").isNull()).first().asDict() == {"n_rows": 3, "n_columns": 26, "new_columns": 22, "ok": 2, "failed": 1}


def test_scalar_functions(spark):
    T.register_all(spark)
    row = spark.sql("SELECT syllables_pt('coração') AS a, uuid5_dns('python.org') AS b, cosine(array(1D, 0D), array(1D, 1D)) AS c, vec_sub(array(3D), array(1D)) AS d, vec_project(array(2D, 2D), array(1D, 0D)) AS e, vec_project(array(2D), array(0D)) AS f, flesch_pt(10D, 2D, 20D) AS g").first()
    assert (row.a, row.b, row.d, row.e, row.f) == (2, "886313e1-3b8a-5372-9b90-0c9aee199e5d", [2.0], [2.0, 0.0], [0.0])
    assert row.c == pytest.approx(0.5**0.5) and row.g == pytest.approx(248.835 - 1.015 * 5 - 84.6 * 2)
    texts = ["", "one", "alpha beta gamma delta", "a " * 30, "averyveryverylongword x"]
    import textwrap

    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.wrapped(F.col("t"), 12)).collect()]
    assert got == ["\n".join(textwrap.wrap(t, 12, break_long_words=False)) for t in texts]


def test_lexical_guards_and_null_prior(spark):
    df = spark.createDataFrame([("a", "alpha beta"), ("b", "beta gamma"), (None, "gamma delta"), ("c", "")], "lang string, text string")
    counts = lexical.group_counts(df, "lang", max_share=1.0)
    assert counts.where("lang IS NULL").count() == 2
    z = {r.term: r for r in lexical.log_odds(counts, "a", "b").collect()}
    assert z["gamma"].p == 1 and z["gamma"].b == 1 and z["delta"].p == 1
    empty = df.where("false")
    with pytest.raises(lexical.EmptyVocabulary):
        lexical.group_counts(empty, "lang", required=True)
    with pytest.raises(lexical.EmptyVocabulary):
        lexical.ctfidf(lexical.term_counts(empty), required=True)
    assert lexical.ctfidf(lexical.term_counts(empty)).count() == 0
    batch = lexical.log_odds_batch(counts, (("lang", "a", "b"), ("lang", "b", "b")))
    assert {(r.target, r.term): round(r.z, 9) for r in batch.where("target = 'a' AND z IS NOT NULL").collect()} == {("a", t): round(r.z, 9) for t, r in z.items() if r.z is not None}
    assert {r.z for r in batch.where("target = 'b'").collect()} <= {0.0, None}


def test_exact_quantiles_and_places(spark):
    r = random.Random(3)
    rows = [(i, r.choice("abc"), r.choice([None, float(r.randint(0, 30)), r.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, x double").repartition(7)
    by = {g: sorted(x for _, h, x in rows if h == g and x is not None) for g in "abc"}

    def at(v, q):
        k = (len(v) - 1) * q
        i = int(k)
        return v[i] + (v[min(i + 1, len(v) - 1)] - v[i]) * (k - i)

    for row in stats.quantiles(df, "x", (0.25, 0.5, 0.9), "g").collect():
        assert [row.q0, row.q1, row.q2] == pytest.approx([at(by[row.g], q) for q in (0.25, 0.5, 0.9)])
    places = stats.ranked(df, "x", "g", then=("id",)).collect()
    for g in "abc":
        own = sorted((p.k, p.x, p.id) for p in places if p.g == g)
        assert [k for k, _, _ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted((x, i) for i, h, x in rows if h == g and x is not None)
    assert stats.quantiles(df.where("false"), "x", (0.5,)).first()[0] is None and stats.quantiles(df.where("false"), "x", (0.5,), "g").count() == 0


def modularity(member, edges):
    total = 2.0 * sum(w for *_, w in edges)
    degree = {}
    for i, j, w in edges:
        degree[i] = degree.get(i, 0) + w
        degree[j] = degree.get(j, 0) + w
    inside = sum(2 * w for i, j, w in edges if member[i] == member[j]) / total
    share = {}
    for n, x in degree.items():
        share[member[n]] = share.get(member[n], 0) + x / total
    return inside - sum(x * x for x in share.values())


def test_communities_find_planted_groups(spark):
    r = random.Random(6)
    edges = [(i, j, 1.0 if i // 6 == j // 6 else 0.1) for i in range(18) for j in range(i + 1, 18) if i // 6 == j // 6 or r.random() < 0.2]
    df = spark.createDataFrame([(0, *e) for e in edges], "graph int, i bigint, j bigint, weight double")
    nodes = spark.createDataFrame([(0, 99)], "graph int, node bigint")
    for method in ("moves", "greedy"):
        found = {x.node: x.community for x in graphs.communities(df, "graph", nodes, method).collect()}
        assert len({found[n] for n in range(18)}) == 3 and all(found[n] == found[n // 6 * 6] for n in range(18)) and 99 in found
        assert modularity(found, edges) == pytest.approx(modularity({n: n // 6 for n in range(18)}, edges))
    people = spark.createDataFrame([(n, "ab"[n % 2]) for n in range(18)] + [(200, "a")], "node bigint, genero string")
    rows = {x.community: x for x in graphs.summaries(graphs.communities(df, "graph").select("node", "community"), people, "genero").collect()}
    assert rows[-1].size == 1 and sorted(x.size for x in rows.values()) == [1, 6, 6, 6] and all(x.counts == {"a": 3, "b": 3} and x.purity == 0.5 for c, x in rows.items() if c != -1)


def test_density_clusters_match_brute_force(spark, tmp_path):
    r = random.Random(8)
    points = [(r.gauss(c, 0.3), r.gauss(0, 0.3)) for c in (0, 5) for _ in range(15)] + [(20.0, 20.0), (2.5, 9.0)]
    gap = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    pairs = [(i, j, gap(points[i], points[j])) for i in range(len(points)) for j in range(i + 1, len(points))]
    reach, least = 0.6, 4
    near = {i: [j for j in range(len(points)) if gap(points[i], points[j]) <= reach] for i in range(len(points))}
    cores = [i for i in near if len(near[i]) >= least]
    label = {i: i for i in cores}
    for _ in cores:
        label = {i: min(label[j] for j in near[i] if j in label) for i in label}
    want = {i: label[i] if i in label else min(((gap(points[i], points[j]), j) for j in near[i] if j in label), default=(0, None))[1] for i in near}
    want = {i: -1 if c is None else label.get(c, c) for i, c in want.items()}
    nodes = spark.createDataFrame([(i,) for i in range(len(points))], "n bigint")
    got = graphs.density_clusters(spark.createDataFrame(pairs, "i bigint, j bigint, distance double"), nodes, "n", reach, least, lambda e, n: vectors.components(e, n, "node", f"file://{tmp_path}"))
    assert {x.node: x.cluster for x in got.collect()} == want and list(want.values()).count(-1) >= 2


def test_components_of_a_long_chain(spark, tmp_path):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "i bigint, j bigint")
    found = vectors.components(edges, spark.range(n + 1).withColumnRenamed("id", "n"), "n", f"file://{tmp_path}").collect()
    assert {x.component for x in found} == {0, n} and len(found) == n + 1


def test_pair_statistics_of_tiny_groups(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 1.0], "b")], "m int, embedding array<double>, t string")
    pairs = vectors.pair_analysis(df, "m", ["t"])
    assert pairs.where("analysis = 'filtered'").count() == 1 and pairs.where("analysis = 'centering'").count() == 6
    groups = spark.createDataFrame([("t", "a", "filtered", 2), ("t", "b", "filtered", 1)], "trait string, value string, analysis string, group_size int")
    rows = {r.value: r for r in vectors.pair_statistics(pairs, groups).collect()}
    assert rows["b"].status == "insufficient_data" and rows["b"].total_pairs is None and rows["a"].total_pairs == 1
    assert rows["a"].centred_mean == -1.0 and rows["a"].original_mean == 0.0 and rows["a"].match_mean == 100.0


def test_silhouette_in_blocks(spark):
    r = random.Random(5)
    rows = [(i, i % 3, [r.gauss(i % 3, 0.5), r.gauss(0, 1)]) for i in range(60)] + [(100, 7, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id int, g int, embedding array<double>")
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    total = 0.0
    for i, g, v in rows:
        d = {}
        for j, h, w in rows:
            if i != j:
                d.setdefault(h, []).append(gap(v, w))
        a, b = d.get(g), min(sum(x) / len(x) for h, x in d.items() if h != g)
        total += 0 if a is None else (b - sum(a) / len(a)) / max(b, sum(a) / len(a))
    assert vectors.silhouette(df, "id", "g", block=16).first()[0] == pytest.approx(total / len(rows))


def test_one_limit_for_all_tasks(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        def client_of(key):
            async def client(config, messages):
                import time
                import uuid

                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(repr(time.time()))
                return "ok"

            return client

        return connect.Registry({"openai": client_of}, {"openai": ["k"]}, {"m": "openai"})

    items = spark.range(30, numPartitions=10).select("id", F.lit("m").alias("model"), F.lit("hello").alias("message"))
    got = connect.asked(items, "message", "model", make, tasks=3, limits={"openai": (7, 1.5)}, concurrency=20)
    assert got.rdd.getNumPartitions() == 3
    assert len(got.where("error IS NULL").collect()) == 30
    starts = sorted(float(p.read_text()) for p in tmp_path.iterdir())
    # a little slack for the time between the limiter and the file
    assert all(b - a > 1.2 for a, b in zip(starts, starts[7:]))
    assert [connect.share(7, 3, i) for i in range(3)] == [3, 2, 2]
    few = connect.asked(items, "message", "model", make, tasks=8, limits={"openai": (2, 0.1)})
    assert few.rdd.getNumPartitions() == 2
