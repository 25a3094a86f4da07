"""Queries over the driver's tables, each beside the SQL that gives the same rows.

``QUERIES`` maps a name to (function of (spark, sf_dir), SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quilate.functions import text as T
from quilate.operators import conllu, enrich, frames, lexical, metrics, prompts, stats, themes, vectors
from quilate.operators.batches import measured
from quilate.sources import stores
from quilate.sources.tables import spread, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _docs(s, d):
    return table(s, d, "documents")


def _texts(s, d):
    """Documents, for work that is costly by text."""
    return spread(_docs(s, d))


def _labelled(s, d):
    return _docs(s, d).select("doc_id", "lang", "source").join(table(s, d, "labels"), "doc_id")


def r6(c):
    return F.round(c, 6)


# filters, projections, cleaning


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def filter_eq(s, d):
    return _docs(s, d).where(F.col("lang") == "fr").select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE lang <> ''")
def filter_neq(s, d):
    return _docs(s, d).where(F.col("lang") != "").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE NOT coalesce(lang IN ('fr', 'es'), false)")
def prior_complement(s, d):
    return _docs(s, d).where(~F.coalesce(F.col("lang").isin("fr", "es"), F.lit(False))).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE length(text) > 0")
def nonempty(s, d):
    return _docs(s, d).where(F.length("text") > 0).select("doc_id")


@query("SELECT doc_id, length(trim(text)) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def clean_text(s, d):
    return _docs(s, d).where(F.col("text").isNotNull() & (F.trim("text") != "")).select("doc_id", F.length(F.trim("text")).cast("bigint").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_type, 'A')")
def contains(s, d):
    return table(s, d, "part").where(F.col("p_type").contains("A")).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents d JOIN labels l USING (doc_id) WHERE lang = 'en' AND toxic = 0 AND quality = 1")
def find_by_config(s, d):
    out = _labelled(s, d)
    for column, value in {"lang": "en", "toxic": 0, "quality": 1}.items():
        out = out.where(F.col(column) == value)
    return out.select("doc_id")


@query("SELECT doc_id, lang FROM documents")
def project(s, d):
    return _docs(s, d).select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents")
def drop_cols(s, d):
    return _docs(s, d).drop("text", "n_chars")


_LEFT = "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _left(s, d):
    return _docs(s, d).select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left")


@query(f"SELECT d.doc_id, quality {_LEFT} WHERE (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT >= 2")
def dropna_thresh(s, d):
    return _left(s, d).na.drop(thresh=2, subset=["quality", "toxic"]).select("doc_id", "quality")


@query(f"SELECT d.doc_id, coalesce(CAST(toxic AS VARCHAR), '') AS toxic {_LEFT}")
def fillna(s, d):
    return _left(s, d).select("doc_id", F.col("toxic").cast("string").alias("toxic")).na.fill("")


@query(f"SELECT d.doc_id, CASE WHEN toxic IS NULL THEN 'empty' ELSE CAST(toxic AS VARCHAR) END AS toxic {_LEFT}")
def replace_empty(s, d):
    return _left(s, d).select("doc_id", F.col("toxic").cast("string").alias("toxic")).na.fill("").na.replace("", "empty", ["toxic"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c FROM orders")
def cast_str(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_expand(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.*")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS row_id FROM documents")
def row_ids(s, d):
    return stats.ranked(_docs(s, d), "doc_id", "source").select("doc_id", (F.col("k") - 1).cast("bigint").alias("row_id"))


@query("SELECT doc_id, n_chars, label_doc, toxic FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS r FROM documents) FULL JOIN (SELECT doc_id AS label_doc, toxic, row_number() OVER (ORDER BY doc_id) AS r FROM labels) USING (r)")
def aligned(s, d):
    a, b = _docs(s, d).select("doc_id", "n_chars"), table(s, d, "labels").select(F.col("doc_id").alias("label_doc"), "toxic")
    return frames.aligned(a, b, ("doc_id",), ("label_doc",))


@query("SELECT " + ", ".join(("l_orderkey", "l_linenumber")) + ", l_quantity FROM lineitem")
def numeric_columns(s, d):
    return frames.numeric(frames.require(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang}) AS j FROM documents")
def json_rows(s, d):
    return _docs(s, d).select("doc_id", stores.as_json("doc_id", "lang").alias("j"))


# joins


@query(f"SELECT d.doc_id, lang, quality, toxic {_LEFT}")
def join_left(s, d):
    return _left(s, d)


@query("SELECT d.doc_id, lang, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_inner(s, d):
    return _labelled(s, d).select("doc_id", "lang", "toxic")


@query("SELECT b.item_id, d.doc_id FROM benchmark b LEFT JOIN documents d ON b.text IS NOT DISTINCT FROM d.text")
def join_text(s, d):
    b, docs = table(s, d, "benchmark"), _docs(s, d).select("doc_id", "text")
    return b.join(docs, b["text"].eqNullSafe(docs["text"]), "left").select("item_id", "doc_id")


@query(f"SELECT count(*) AS total, count(l.doc_id) AS matched, round(100.0 * count(l.doc_id) / count(*), 6) AS pct {_LEFT}")
def join_coverage(s, d):
    right = table(s, d, "labels").select(F.col("doc_id").alias("r"))
    both = _docs(s, d).select("doc_id").join(right, F.col("doc_id") == F.col("r"), "left")
    return both.agg(F.count("*").alias("total"), F.count("r").alias("matched"), r6(100.0 * F.count("r") / F.count("*")).alias("pct"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_pending(s, d):
    return enrich.pending(_docs(s, d).select("doc_id"), table(s, d, "labels"), "doc_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def emb_lookup(s, d):
    return table(s, d, "embeddings").join(table(s, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "label")


@query("SELECT n.n_nationkey AS node_id, n_name, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def node_rows(s, d):
    return table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node_id"), "n_name", "r_name")


# prompts

_VALUES = lambda xs: "(VALUES " + ", ".join("('" + x + "')" for x in xs) + ")"
_GRID = f"{_VALUES(prompts.TRAITS['genero'])} g(genero), {_VALUES(prompts.TRAITS['raca'])} r(raca), {_VALUES(prompts.TRAITS['regiao'])} e(regiao)"
_SHOWN = "CASE genero WHEN 'homem' THEN 'o' ELSE 'a' END AS artigo, CASE genero WHEN 'homem' THEN 'ele' WHEN 'mulher' THEN 'ela' ELSE 'elu' END AS pronome"


@query(f"SELECT item_id, genero, raca, regiao, {_SHOWN} FROM benchmark, {_GRID}")
def persona_grid(s, d):
    """Every item with every persona."""
    return prompts.with_personas(table(s, d, "benchmark").select("item_id")).select("item_id", "genero", "raca", "regiao", "artigo", "pronome")


@query(rf"SELECT item_id, genero, raca, regiao, sha256(trim(regexp_replace('Descreva  uma pessoa ' || genero || ' ' || raca || ' ' || regiao || ' : ' || text, '\s+', ' ', 'g'))) AS message FROM benchmark, {_GRID}")
def prompt_render(s, d):
    """Every item as a template, rendered for every persona."""
    original = F.concat(F.lit("\n   Descreva  uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}}: "), F.col("text"))
    templates = table(s, d, "benchmark").select("item_id", F.lit("describe").alias("template_name"), original.alias("original_prompt"))
    return prompts.designed(templates, ["gpt-4o"]).select("item_id", "genero", "raca", "regiao", F.sha2("message", 256).alias("message"))


_SLUG_RULES_SQL = " ".join("WHEN " + " AND ".join(f"contains(x, '{n}')" for n in needed) + f" THEN '{name}'" for needed, name in T.SLUG_RULES)
_SLUG_EXACT_SQL = " ".join(f"WHEN x = '{a}' THEN '{b}'" for a, b in T.SLUGS.items())
_SLUG_PROMPTS = [*T.SLUGS, "Descreva uma pessoa qualquer.", "Conte, por favor, uma história", "123", "<user>Imagine uma pessoa. Por favor</user>", "Um texto {{sobre}} nada"]
_SLUG_TABLE = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_SLUG_PROMPTS)) + ") t(k, prompt)"


@query(rf"WITH r AS (SELECT -k - 1 AS id, prompt FROM {_SLUG_TABLE} UNION ALL SELECT doc_id, text FROM documents), c AS (SELECT id, trim(replace(replace(prompt, '<user>', ''), '</user>', '')) AS x FROM r), w AS (SELECT id, x, list_filter(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')[1:3], lambda y: regexp_full_match(regexp_replace(y, '[{{}}]', '', 'g'), '\p{{L}}+')) AS w FROM c) SELECT CAST(id AS BIGINT) AS id, CASE {_SLUG_EXACT_SQL} {_SLUG_RULES_SQL} WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda y: lower(regexp_replace(y, '[.,?!]', '', 'g'))), '_') ELSE 'unknown_prompt' END AS slug FROM w")
def prompt_slug(s, d):
    fixed = s.range(1).select(F.posexplode(F.array(*map(F.lit, _SLUG_PROMPTS))).alias("k", "prompt")).select((-F.col("k") - 1).cast("bigint").alias("id"), "prompt")
    rows = fixed.unionAll(_docs(s, d).select(F.col("doc_id").cast("bigint"), "text"))
    return rows.select("id", T.prompt_slug(F.col("prompt")).alias("slug"))


_UUID_H = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(p_name))"


@query(f"SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INTEGER + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT p_partkey, {_UUID_H} AS h FROM part)")
def uuid5(s, d):
    return table(s, d, "part").select("p_partkey", T.uuid5_dns(F.col("p_name")).alias("id"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def ws_collapse(s, d):
    return _docs(s, d).select("doc_id", F.sha2(T.collapse_spaces(F.col("text")), 256).alias("h"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def truncate(s, d):
    return _docs(s, d).select("doc_id", T.truncate(F.col("text"), 100).alias("preview"))


@query("SELECT doc_id, CASE label WHEN 'LABEL_0' THEN 'negative' WHEN 'LABEL_1' THEN 'neutral' WHEN 'LABEL_2' THEN 'positive' WHEN 'UNKNOWN' THEN 'unknown' ELSE lower(label) END AS name FROM (SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN upper(lang) ELSE 'LABEL_' || (doc_id % 5) END AS label FROM documents)")
def label_norm(s, d):
    k = F.col("doc_id") % 5
    label = F.when(k == 3, F.lit("UNKNOWN")).when(k == 4, F.upper("lang")).otherwise(F.concat(F.lit("LABEL_"), k.cast("string")))
    return _docs(s, d).select("doc_id", T.label_name(label).alias("name"))


@query(r"SELECT doc_id, replace(replace(translate(text, './ ', '_'), '/', ''), ' ', '') AS name, sha256(replace(trim(replace(replace(replace(text, '<user>', ''), '</user>', ''), chr(10), ' ')), '', '')) AS plain FROM documents")
def file_names(s, d):
    return _docs(s, d).select("doc_id", T.file_name(F.col("text")).alias("name"), F.sha2(T.without_tags(F.col("text")), 256).alias("plain"))


# aggregation


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(s, d):
    return table(s, d, "events").where("event_type IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY 1")
def value_counts_pct(s, d):
    n = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.lit(total), 2))


_DESCRIBE = ", ".join(["count(value) AS count", "round(avg(value), 6) AS mean", "round(stddev_samp(value), 6) AS std", "min(value) AS min", *(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75)), "max(value) AS max"])


def _described(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "p25", "p50", "p75")})


@query(f"SELECT {_DESCRIBE} FROM events")
def describe(s, d):
    return _described(stats.describe(table(s, d, "events"), "value"))


@query(f"SELECT event_type, {_DESCRIBE} FROM events GROUP BY 1")
def describe_by(s, d):
    return _described(stats.describe(table(s, d, "events"), "value", "event_type"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def group_stats(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"))


@query("SELECT count(DISTINCT source) AS n FROM documents")
def nunique(s, d):
    return _docs(s, d).agg(F.countDistinct("source").alias("n"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct(s, d):
    return _docs(s, d).select("lang", "source").distinct()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def count_by(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT source, lang AS mode FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def mode(s, d):
    n = _docs(s, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("m")).select("source", F.col("m.lang").alias("mode"))


@query("SELECT event_type, CAST(row_number() OVER (ORDER BY avg(value), event_type) AS INTEGER) AS place FROM events GROUP BY 1")
def order_by_mean(s, d):
    means = table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return means.select("event_type", F.row_number().over(Window.orderBy("m", "event_type")).alias("place"))


_CROSS = ", ".join(f"count(*) FILTER (WHERE toxic = {t}) AS toxic_{t}" for t in (0, 1))


def _cross(df, *by):
    return df.groupBy(*by).agg(*[F.count_if(F.col("toxic") == t).alias(f"toxic_{t}") for t in (0, 1)])


@query(f"SELECT lang, {_CROSS} FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def crosstab(s, d):
    wide = _labelled(s, d).groupBy("lang").pivot("toxic", [0, 1]).count().na.fill(0)
    return wide.withColumnsRenamed({"0": "toxic_0", "1": "toxic_1"})


@query(f"SELECT coalesce(lang, 'All') AS lang, {_CROSS}, count(*) AS all_rows FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def crosstab_margins(s, d):
    both = _labelled(s, d).rollup("lang").agg(*[F.count_if(F.col("toxic") == t).alias(f"toxic_{t}") for t in (0, 1)], F.count("*").alias("all_rows"))
    return both.withColumn("lang", F.coalesce("lang", F.lit("All")))


@query("SELECT lang, round(100.0 * count(*) FILTER (WHERE toxic = 0) / count(*), 6) AS pct_0, round(100.0 * count(*) FILTER (WHERE toxic = 1) / count(*), 6) AS pct_1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def crosstab_pct(s, d):
    n = F.col("toxic_0") + F.col("toxic_1")
    return _cross(_labelled(s, d), "lang").select("lang", *[r6(100.0 * F.col(f"toxic_{t}") / n).alias(f"pct_{t}") for t in (0, 1)])


@query("SELECT doc_id, 'quality' AS variable, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def unpivot(s, d):
    return table(s, d, "labels").unpivot("doc_id", ["quality", "toxic"], "variable", "value")


# statistics


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def iqr_outliers(s, d):
    return stats.without_outliers(table(s, d, "events"), "value").select("event_id", "value")


@query("SELECT event_type, event_id, value, round(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type), 9) AS y FROM events")
def ecdf(s, d):
    return stats.ecdf(table(s, d, "events"), "value", "event_id", "event_type").withColumn("y", F.round("y", 9))


@query("SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type), 6) AS z FROM events")
def zscore(s, d):
    return stats.zscores(table(s, d, "events"), "value", "event_type").select("event_id", r6(F.col("z")).alias("z"))


@query("WITH m AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT CAST(least(floor((value - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM events, m WHERE value IS NOT NULL GROUP BY 1")
def histogram(s, d):
    return stats.histogram(table(s, d, "events"), "value", 20)


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{i}" for i, q in enumerate((0.5, 0.25, 0.125, 0.0625))) + " FROM events GROUP BY 1")
def letter_values(s, d):
    q = (0.5, 0.25, 0.125, 0.0625)
    return stats.quantiles(table(s, d, "events"), "value", q, "event_type").select("event_type", *[r6(F.col(f"q{i}")).alias(f"q{i}") for i in range(4)])


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def corr(s, d):
    return table(s, d, "lineitem").agg(r6(stats.correlation("l_quantity", "l_extendedprice")).alias("r"))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT " + ", ".join(f"round(corr({a}, {b}), 6) AS r_{a[2:]}_{b[2:]}" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]) + " FROM lineitem")
def corr_matrix(s, d):
    return table(s, d, "lineitem").agg(*[r6(stats.correlation(a, b)).alias(f"r_{a[2:]}_{b[2:]}") for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]])


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var FROM events GROUP BY 1")
def tukey_inputs(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), F.round(F.var_samp("value"), 4).alias("var"))


@query()
def tukey(s, d):
    return stats.tukey(table(s, d, "events"), "event_type", "value")


# ordering and samples


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, n FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 10 ORDER BY n_chars, doc_id LIMIT 5)")
def topk_nested(s, d):
    return _docs(s, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10).orderBy("n_chars", "doc_id").limit(5)


@query("SELECT doc_id, n_chars FROM (SELECT * FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 20) ORDER BY n_chars DESC, doc_id LIMIT 10)")
def topk_nested2(s, d):
    return _docs(s, d).select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(20).orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("SELECT doc_id AS id, 'documents' AS origin FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def union_all(s, d):
    a = _docs(s, d).select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"))
    return a.unionByName(table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin")), allowMissingColumns=True)


@query("SELECT lang, doc_id, CAST(r AS INTEGER) AS r FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def sample_per_group(s, d):
    return stats.sampled_per_group(_docs(s, d).select("lang", "doc_id"), 5, "lang", "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 20")
def sample_seeded(s, d):
    return stats.sampled(_docs(s, d).select("doc_id", "source"), 20, "doc_id")


# text


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS n FROM documents")
def tokens(s, d):
    return _texts(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n"))


_COUNTS = r"t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents WHERE lang IS NOT NULL AND length(text) > 0), c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2)"


@query(f"WITH {_COUNTS} SELECT lang, term, n FROM c")
def term_counts(s, d):
    return lexical.term_counts(_texts(s, d))


@query(f"WITH {_COUNTS} SELECT lang, term, n FROM c WHERE term NOT IN ('the', 'de', 'la', 'der')")
def stopwords(s, d):
    return lexical.term_counts(_texts(s, d), stop=("the", "de", "la", "der"))


@query("SELECT doc_id, sha256(lower(trim(text))) AS h, length(text) AS n FROM documents")
def text_basic(s, d):
    return _docs(s, d).select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("h"), F.length("text").cast("bigint").alias("n"))


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 6) ELSE 0 END AS ttr FROM t")
def ttr(s, d):
    w = _texts(s, d).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.when(F.size("w") > 0, r6(F.size(F.array_distinct("w")) / F.size("w"))).otherwise(0.0).alias("ttr"))


def _syllables_sql(x: str) -> str:
    a = f"regexp_replace(lower(trim({x})), '[^{T.PORTUGUESE_LETTERS}]', '', 'g')"
    cut = " - ".join(f"(length({a}) - length(replace({a}, '{p}', ''))) // 2" for p in T.DIPHTHONGS)
    return f"CASE WHEN trim({x}) = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({a}, '[{T.VOWELS}]+')) - {cut}) END"


@query(f"WITH {_COUNTS}, u AS (SELECT DISTINCT term FROM c) SELECT term, CAST({_syllables_sql('term')} AS INTEGER) AS n FROM u")
def syllables(s, d):
    return lexical.term_counts(_texts(s, d)).select("term").distinct().select("term", T.syllables(F.col("term")).alias("n"))


_STYLE = rf"w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w, list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '') AS s, text FROM documents), f AS (SELECT doc_id, text, len(w) AS words, len(s) AS sents, s, w, coalesce(list_sum(list_transform(w, lambda y: {_syllables_sql('y')})), 0) AS syl FROM w)"


def _styled(s, d):
    w = _texts(s, d).select("doc_id", T.tokens(F.col("text")).alias("w"), F.size(T.sentences(F.col("text"))).alias("sents"))
    return measured(w.select("doc_id", F.size("w").alias("words"), "sents", F.array("w").alias("w")), {"w": metrics.WORDS})


_FLESCH = "CASE WHEN words > 0 AND sents > 0 THEN round(248.835::DOUBLE - 1.015::DOUBLE * words / sents - 84.6::DOUBLE * syl / words, 4) ELSE 0 END"


@query(f"WITH {_STYLE} SELECT doc_id, {_FLESCH} AS flesch FROM f")
def flesch(s, d):
    return _styled(s, d).select("doc_id", F.round(T.flesch(F.col("words"), F.col("sents"), F.col("syl")), 4).alias("flesch"))


@query("SELECT * FROM (VALUES (90.0::DOUBLE, 'Very Easy'), (80.0, 'Easy'), (70.0, 'Fairly Easy'), (60.0, 'Standard'), (50.0, 'Fairly Difficult'), (30.0, 'Difficult'), (29.99, 'Very Difficult')) t(score, band)")
def flesch_band(s, d):
    rows = s.range(1).select(F.explode(F.array(*map(F.lit, (90.0, 80.0, 70.0, 60.0, 50.0, 30.0, 29.99)))).alias("score"))
    return rows.select("score", T.flesch_band(F.col("score")).alias("band"))


@query(f"WITH {_STYLE} SELECT doc_id, CASE WHEN words > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / words, 4) ELSE 0 END AS avg_word_length, CASE WHEN words > 0 THEN round(100.0 * len(list_filter(w, lambda x: length(x) > 6)) / words, 4) ELSE 0 END AS long_words_ratio FROM f")
def lexical_metrics(s, d):
    w = _texts(s, d).select("doc_id", T.tokens(F.col("text")).alias("w"))
    total = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    some = lambda c: F.when(F.size("w") > 0, F.round(c, 4)).otherwise(0.0)
    return w.select("doc_id", some(total / F.size("w")).alias("avg_word_length"), some(100.0 * F.size(F.filter("w", lambda x: F.length(x) > 6)) / F.size("w")).alias("long_words_ratio"))


_LENGTHS = r"WITH n AS (SELECT doc_id, unnest(list_transform(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> ''), lambda x: len(regexp_extract_all(lower(x), '[\p{L}\p{N}_]{2,}')))) AS k FROM documents)"


@query(f"{_LENGTHS} SELECT doc_id, CASE WHEN count(*) > 1 THEN round(var_pop(k), 4) ELSE 0 END AS sentence_length_variance FROM n GROUP BY 1")
def syntactic_metrics(s, d):
    n = _texts(s, d).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("x")).select("doc_id", F.size(T.tokens(F.col("x"))).alias("k"))
    return n.groupBy("doc_id").agg(F.when(F.count("*") > 1, F.round(F.var_pop("k"), 4)).otherwise(0.0).alias("sentence_length_variance"))


# class-level lexical statistics

_TFIDF = f"{_COUNTS}, k AS (SELECT lang, sum(n) AS ct FROM c GROUP BY 1), a AS (SELECT trunc(sum(n) / count(DISTINCT lang)) AS a FROM c), f AS (SELECT term, sum(n) AS f FROM c GROUP BY 1), x AS (SELECT lang, term, sqrt(n / ct) * ln(1 + (a - f + 0.5) / (f + 0.5)) AS score FROM c JOIN k USING (lang) JOIN f USING (term), a), r AS (SELECT lang, term, score, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank FROM x)"


def _tfidf(s, d):
    return lexical.ctfidf(lexical.term_counts(_texts(s, d))).withColumn("score", F.round("score", 9))


def _best(s, d):
    """The ten best terms of each language, their scores not rounded."""
    return lexical.top_terms(lexical.ctfidf(lexical.term_counts(_texts(s, d))), 10, digits=9)


@query(f"WITH {_TFIDF} SELECT lang, term, round(score, 9) AS score FROM x")
def ctfidf(s, d):
    return _tfidf(s, d).drop("n")


@query(f"WITH {_TFIDF} SELECT lang, rank, term, round(score, 9) AS score FROM r WHERE rank <= 10")
def ctfidf_topk(s, d):
    return lexical.top_terms(_tfidf(s, d), 10)


@query(f"WITH {_TFIDF} SELECT lang, rank, term || ' (' || printf('%.4f', score) || ')' AS cell FROM r WHERE rank <= 10")
def ctfidf_fmt(s, d):
    return _best(s, d).select("lang", "rank", lexical.cell().alias("cell"))


@query(f"WITH {_TFIDF} SELECT rank, " + ", ".join(f"max(CASE WHEN lang = '{x}' THEN term || ' (' || printf('%.4f', score) || ')' END) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM r WHERE rank <= 10 GROUP BY 1")
def ctfidf_wide(s, d):
    return lexical.wide(_best(s, d), ["de", "en", "es", "fr"])


_VOCAB = r"w AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-ZÀ-ÿ]{2,}')) AS w FROM documents), g AS (SELECT * FROM w WHERE len(w) > 0), e AS (SELECT lang, doc_id, unnest(w) AS term FROM g), v AS (SELECT term FROM (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM e GROUP BY 1) WHERE df <= 0.95 * (SELECT count(*) FROM g) ORDER BY tf DESC, term LIMIT 10000), c AS (SELECT lang, term, count(*) AS n FROM e JOIN v USING (term) GROUP BY 1, 2)"


def _odds_sql(target: str, reference: str) -> str:
    return f"""{_VOCAB}, q AS (SELECT term, coalesce(sum(n) FILTER (WHERE lang = '{target}'), 0) AS a, coalesce(sum(n) FILTER (WHERE lang = '{reference}'), 0) AS b, coalesce(sum(n) FILTER (WHERE lang IS DISTINCT FROM '{target}' AND lang IS DISTINCT FROM '{reference}'), 0) AS p FROM c GROUP BY 1),
    t AS (SELECT CAST(sum(a) AS DOUBLE) AS ta, CAST(sum(b) AS DOUBLE) AS tb, CAST(sum(p) AS DOUBLE) AS tp FROM q),
    z AS (SELECT term, round((ln((a + p) / (ta + tp - (a + p)) + 1e-10) - ln((b + p) / (tb + tp - (b + p)) + 1e-10)) / sqrt(1 / (a + p + 1e-10) + 1 / (b + p + 1e-10)), 6) AS z FROM q, t)"""


@query(f"WITH {_odds_sql('fr', 'es')} SELECT term, z FROM z WHERE z > 1.96")
def logodds(s, d):
    counts = lexical.group_counts(_texts(s, d), "lang")
    return lexical.log_odds(counts, "fr", "es").select("term", r6(F.col("z")).alias("z")).where("z > 1.96")


@query(f"WITH {_odds_sql('de', 'en')} SELECT term || ': ' || printf('%.2f', z) AS line FROM z WHERE z > 1.96")
def logodds_report(s, d):
    counts = lexical.group_counts(_texts(s, d), "lang")
    found = lexical.log_odds(counts, "de", "en").select("term", r6(F.col("z")).alias("z")).where("z > 1.96")
    return found.select(lexical.report_line().alias("line"))


def _traits(s, d):
    """Documents with the traits of a design, by their ids."""
    pick = lambda name, k: F.get(F.array(*map(F.lit, prompts.TRAITS[name])), k.cast("int")).alias(name)
    k = F.col("doc_id")
    return _texts(s, d).select("doc_id", "text", pick("genero", k % 3), pick("raca", k % 5), pick("regiao", F.floor(k / 5) % 5))


def _trait_sql(name: str) -> str:
    k = {"genero": "doc_id % 3", "raca": "doc_id % 5", "regiao": "(doc_id // 5) % 5"}[name]
    return "[" + ", ".join(f"'{x}'" for x in prompts.TRAITS[name]) + f"][{k} + 1]"


def _batch_sql() -> str:
    by = ", ".join(f"{_trait_sql(n)} AS {n}" for n in ("genero", "raca", "regiao"))
    sums = " UNION ALL ".join(
        f"SELECT '{c}' AS trait, '{t}' AS target, '{r}' AS reference, term, coalesce(sum(n) FILTER (WHERE {c} = '{t}'), 0) AS a, coalesce(sum(n) FILTER (WHERE {c} = '{r}'), 0) AS b, coalesce(sum(n) FILTER (WHERE {c} NOT IN ('{t}', '{r}')), 0) AS p FROM k GROUP BY term"
        for c, t, r in lexical.COMPARISONS
    )
    return f"""WITH {_VOCAB}, k AS (SELECT {by}, term, count(*) AS n FROM e JOIN v USING (term) GROUP BY ALL), q AS ({sums}),
    t AS (SELECT trait, target, reference, sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb, sum(p)::DOUBLE AS tp FROM q GROUP BY ALL)
    SELECT * FROM (SELECT trait, target, reference, term, round((ln((a + p) / (ta + tp - (a + p)) + 1e-10) - ln((b + p) / (tb + tp - (b + p)) + 1e-10)) / sqrt(1 / (a + p + 1e-10) + 1 / (b + p + 1e-10)), 6) AS z FROM q JOIN t USING (trait, target, reference)) WHERE z > 1.96"""


@query(_batch_sql())
def logodds_all(s, d):
    counts = lexical.group_counts(_traits(s, d), ["genero", "raca", "regiao"])
    return lexical.log_odds_batch(counts).withColumn("z", r6(F.col("z"))).where("z > 1.96")


# themes

#: The themes, and word parts of the languages of the test corpus.
_KEYWORDS = themes.KEYWORDS | {"motion": ("ation", "heit", "mente", "tion"), "people": ("elle", "ouh", "ihr", "los"), "nature": ("stein", "eau", "mar", "thre"), "change": ("wh", "ung", "ció")}

_THEMES = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', [{', '.join(repr(k) for k in ks)}])" for t, ks in _KEYWORDS.items()) + ") t(tema, ks)), m AS (SELECT doc_id, tema, len(ks) AS total, list_filter(ks, lambda x: contains(lower(text), x)) AS m FROM documents, k), h AS (SELECT doc_id, tema, len(m) AS keywords_count, len(m) / total AS intensity, array_to_string(m[1:3], ', ') AS matched_keywords FROM m WHERE len(m) > 0)"


def _themes(s, d):
    return themes.detect(_texts(s, d), "doc_id", "text", _KEYWORDS)


@query(f"WITH {_THEMES} SELECT doc_id, tema, keywords_count, round(intensity, 6) AS intensity, matched_keywords FROM h")
def theme_detect(s, d):
    return _themes(s, d).withColumn("intensity", r6(F.col("intensity")))


@query(f"WITH {_THEMES} SELECT tema, count(*) AS n, CAST(sum(keywords_count) AS BIGINT) AS keywords, round(avg(intensity), 3) AS intensity FROM h GROUP BY 1")
def theme_stats(s, d):
    return _themes(s, d).groupBy("tema").agg(F.count("*").alias("n"), F.sum("keywords_count").alias("keywords"), F.round(F.avg("intensity"), 3).alias("intensity"))


@query(f"WITH {_THEMES} SELECT doc_id, " + ", ".join(f"max(CASE WHEN tema = '{t}' THEN 1 ELSE 0 END) AS \"{t}\"" for t in _KEYWORDS) + " FROM h GROUP BY 1")
def theme_matrix(s, d):
    return _themes(s, d).groupBy("doc_id").agg(*[F.max(F.when(F.col("tema") == t, 1).otherwise(0)).alias(t) for t in _KEYWORDS])


@query(f"WITH {_THEMES} SELECT x.tema AS a, y.tema AS b, count(*) AS n FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.tema <> y.tema GROUP BY 1, 2")
def theme_cooc(s, d):
    return themes.together(_themes(s, d), "doc_id")


@query(f"WITH {_THEMES} SELECT tema, lang, count(*) AS n FROM h JOIN documents USING (doc_id) GROUP BY 1, 2")
def theme_demo(s, d):
    return _themes(s, d).join(_docs(s, d).select("doc_id", "lang"), "doc_id", "left").groupBy("tema", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {_THEMES}, c AS (SELECT doc_id, count(*) AS themes FROM h GROUP BY 1) SELECT themes, count(*) AS n FROM c GROUP BY 1")
def themes_per_doc(s, d):
    return _themes(s, d).groupBy("doc_id").agg(F.count("*").alias("themes")).groupBy("themes").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS tag FROM documents), f AS (SELECT tag FROM t GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 10), u AS (SELECT * FROM t WHERE tag IN (SELECT tag FROM f)) SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.tag <> b.tag GROUP BY 1, 2")
def tag_cooc(s, d):
    """Pairs of the ten words that most documents have."""
    return themes.top_in_lists(_texts(s, d).select(F.split("text", " ").alias("tags")), "tags")


# parses (a stand-in parse of every document)


def _parses(s, d):
    words = F.transform(T.sentences(F.col("text")), lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    labels = F.array(*map(F.lit, ("PER", "ORG", "LOC", "GPE", "MISC")))
    names = F.transform(F.filter(F.split("text", " "), lambda w: w.rlike("^[A-Z]")), lambda w: F.get(labels, F.length(w) % 5))
    return _texts(s, d).select("doc_id", "text", conllu.generated(words).alias("parse"), names.alias("entities"))


_PARSED = r"""ps AS (SELECT doc_id, generate_subscripts(s, 1) AS sid, unnest(s) AS x FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '') AS s FROM documents)),
pw AS (SELECT * FROM (SELECT doc_id, sid, list_filter(string_split_regex(x, '\s+'), lambda y: y <> '') AS w FROM ps) WHERE len(w) > 0),
pt AS (SELECT doc_id, sid, len(w) AS n, unnest(w) AS y, generate_subscripts(w, 1) AS k FROM pw),
tok AS (SELECT *, ['NOUN', 'VERB', 'ADJ', 'ADV', 'DET', 'PUNCT'][length(y) % 6 + 1] AS upos, ['nsubj', 'obj', 'ccomp', 'xcomp', 'advcl', 'acl', 'conj', 'cc', 'punct', 'nummod', 'advmod'][(length(y) + k) % 11 + 1] AS rel FROM pt),
ws AS (SELECT doc_id, sid, CAST(floor(log2(any_value(n))) AS BIGINT) AS depth, coalesce(string_agg(lower(y), ' ' ORDER BY k) FILTER (WHERE rel NOT IN ('punct', 'nummod')), '') AS lem FROM tok GROUP BY 1, 2),
dd AS (SELECT doc_id, count(*) AS ns, sum(depth)::BIGINT AS ds, max(depth) AS dm, coalesce(string_agg(lem, ' ' ORDER BY sid) FILTER (WHERE lem <> ''), '') AS lemmas FROM ws GROUP BY 1),
cc AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE rel <> 'punct') AS tok, count(*) FILTER (WHERE upos <> 'PUNCT') AS words, count(*) FILTER (WHERE rel IN ('ccomp', 'xcomp', 'advcl', 'acl')) AS cl, count(*) FILTER (WHERE rel IN ('advcl', 'acl')) AS dep, count(*) FILTER (WHERE rel IN ('ccomp', 'conj', 'cc')) AS co,
  count(*) FILTER (WHERE rel <> 'punct' AND upos IN ('NOUN', 'ADJ', 'VERB')) AS lex, count(*) FILTER (WHERE rel = 'advmod' OR upos IN ('NOUN', 'ADJ', 'VERB')) AS lex_b, count(DISTINCT y) FILTER (WHERE rel <> 'punct') AS types, count(DISTINCT y) AS types_b,
  count(*) FILTER (WHERE upos = 'NOUN') AS c_noun, count(*) FILTER (WHERE upos = 'VERB') AS c_verb, count(*) FILTER (WHERE upos = 'ADJ') AS c_adj, count(*) FILTER (WHERE upos = 'ADV') AS c_adv FROM tok GROUP BY 1),
z AS (SELECT documents.doc_id, coalesce(ns, 0) AS ns, coalesce(ds, 0) AS ds, coalesce(dm, 0) AS dm, coalesce(lemmas, '') AS lemmas, coalesce(total, 0) AS total, coalesce(tok, 0) AS tok, coalesce(words, 0) AS words, coalesce(cl, 0) AS cl, coalesce(dep, 0) AS dep, coalesce(co, 0) AS co, coalesce(lex, 0) AS lex, coalesce(lex_b, 0) AS lex_b, coalesce(types, 0) AS types, coalesce(types_b, 0) AS types_b, coalesce(c_noun, 0) AS c_noun, coalesce(c_verb, 0) AS c_verb, coalesce(c_adj, 0) AS c_adj, coalesce(c_adv, 0) AS c_adv FROM documents LEFT JOIN dd USING (doc_id) LEFT JOIN cc USING (doc_id))"""


def _half_up(a: str, b: str, places: int) -> str:
    """a / b of whole numbers, rounded half up; 0 where b is 0."""
    return f"CASE WHEN {b} > 0 THEN ({2 * 10**places} * ({a}) + ({b})) // (2 * ({b})) / {10**places}.0::DOUBLE ELSE 0 END"


_COMPLEXITY_SQL = ", ".join(f"{_half_up(a, b, n)} AS {name}" for name, a, b, n in (("MLC", "tok", "cl", 2), ("MLS", "tok", "ns", 2), ("DCC", "dep", "cl", 2), ("CPC", "co", "cl", 2), ("profundidade_media", "ds", "ns", 2), ("ttr", "types", "tok", 4), ("lexical_density", "lex", "tok", 4))) + ", CAST(dm AS INTEGER) AS profundidade_max, CAST(tok AS INTEGER) AS token_quantity"
_POS_SQL = ", ".join(f"{_half_up(f'100 * c_{p}', 'words', 2)} AS {p}_freq" for p in ("noun", "verb", "adj", "adv"))


@query(f"WITH {_PARSED} SELECT doc_id, ns AS sentences, total AS tokens FROM z")
def conllu_parse(s, d):
    p = _parses(s, d).select("doc_id", conllu.parsed(F.col("parse")).alias("p"))
    return p.select("doc_id", F.size("p").cast("bigint").alias("sentences"), F.size(F.flatten("p")).cast("bigint").alias("tokens"))


@query(f"WITH {_PARSED} SELECT doc_id, sha256(lemmas) AS lemmas FROM z")
def lemmas(s, d):
    return conllu.complexity(_parses(s, d), "doc_id", "parse").select("doc_id", F.sha2("lemmas", 256).alias("lemmas"))


@query(f"WITH {_PARSED} SELECT doc_id, {_COMPLEXITY_SQL} FROM z")
def complexity(s, d):
    return conllu.complexity(_parses(s, d), "doc_id", "parse").drop("lemmas")


_RATIO = lambda a, b: f"CASE WHEN {b} > 0 THEN round(({a})::DOUBLE / ({b}), 6) ELSE 0 END"


@query(f"WITH {_PARSED} SELECT doc_id, {_RATIO('total', 'cl')} AS MLC, {_RATIO('total', 'ns')} AS MLS, {_RATIO('dep', 'cl')} AS DCC, {_RATIO('co', 'cl')} AS CPC, {_RATIO('ds', 'ns')} AS profundidade_media, CAST(dm AS INTEGER) AS profundidade_max, {_RATIO('types_b', 'words')} AS ttr, {_RATIO('lex_b', 'total')} AS lexical_density, CAST(total AS INTEGER) AS token_quantity FROM z")
def complexity_b(s, d):
    c = conllu.complexity(_parses(s, d), "doc_id", "parse", notebook=True).drop("lemmas")
    return c.select(*[r6(F.col(n)).alias(n) if t == "double" else n for n, t in c.dtypes])


@query(f"WITH {_PARSED} SELECT doc_id, {_POS_SQL} FROM z")
def pos_freq(s, d):
    return conllu.pos_frequencies(_parses(s, d), "doc_id", "parse")


_METRICS_SQL = rf"""{_PARSED},
ms AS (SELECT doc_id, len(w) AS k, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS chars, coalesce(list_sum(list_transform(w, lambda y: {_syllables_sql('y')})), 0)::BIGINT AS syl, len(list_filter(w, lambda y: length(y) > 6)) AS long FROM (SELECT doc_id, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM ps)),
md AS (SELECT doc_id, count(*)::BIGINT AS s, sum(k)::BIGINT AS k, sum(chars)::BIGINT AS chars, sum(syl)::BIGINT AS syl, sum(long)::BIGINT AS long, sum(k * k)::BIGINT AS k2 FROM ms GROUP BY 1),
mp AS (SELECT doc_id, trim(coalesce(text, '')) = '' AS blank, length(regexp_replace(coalesce(text, ''), '[\p{{L}}\p{{N}}_\s]', '', 'g')) AS p, list_transform(list_filter(string_split(text, ' '), lambda y: regexp_matches(y, '^[A-Z]')), lambda y: ['PER', 'ORG', 'LOC', 'GPE', 'MISC'][length(y) % 5 + 1]) AS e FROM documents),
m AS (SELECT mp.doc_id, blank, p, e, coalesce(s, 0) AS s, coalesce(k, 0) AS k, coalesce(chars, 0) AS chars, coalesce(syl, 0) AS syl, coalesce(long, 0) AS long, coalesce(k2, 0) AS k2 FROM mp LEFT JOIN md USING (doc_id))
SELECT doc_id, {_COMPLEXITY_SQL}, {_POS_SQL}, {_half_up('chars', 'k', 2)} AS avg_word_length, {_half_up('100 * long', 'k', 2)} AS long_words_ratio, CASE WHEN s > 1 THEN {_half_up('s * k2 - k * k', 's * s', 2)} ELSE 0 END AS sentence_length_variance, {_half_up('100 * p', 'k + p', 2)} AS punctuation_ratio,
CASE WHEN k > 0 AND s > 0 THEN round(248.835::DOUBLE - 1.015::DOUBLE * k / s - 84.6::DOUBLE * syl / k, 2) ELSE 0 END AS flesch_reading_ease,
CAST(len(list_filter(e, lambda x: x IN ('PER', 'PERSON'))) AS INTEGER) AS per_count, CAST(len(list_filter(e, lambda x: x = 'ORG')) AS INTEGER) AS org_count, CAST(len(list_filter(e, lambda x: x IN ('LOC', 'GPE', 'PLACE'))) AS INTEGER) AS loc_count, sha256(lemmas) AS lemmas FROM m JOIN z USING (doc_id)"""


@query(f"WITH {_METRICS_SQL} WHERE NOT blank")
def metrics_row(s, d):
    docs = _parses(s, d).where(F.coalesce(F.trim("text"), F.lit("")) != "")
    return metrics.analyzed(docs, "doc_id", "text", "parse", "entities").withColumn("lemmas", F.sha2("lemmas", 256))


@query(f"WITH x AS (WITH {_METRICS_SQL}) SELECT CAST(sum(per_count) AS BIGINT) AS total_per_count, CAST(sum(org_count) AS BIGINT) AS total_org_count, CAST(sum(loc_count) AS BIGINT) AS total_loc_count, " + ", ".join(f"round(avg({p}_freq), 6) AS mean_{p}_freq" for p in ("noun", "verb", "adj", "adv")) + " FROM x")
def corpus_totals(s, d):
    t = metrics.corpus_totals(metrics.analyzed(_parses(s, d), "doc_id", "text", "parse", "entities"))
    return t.select(*[r6(F.col(c)).alias(c) if c.startswith("mean") else c for c in t.columns])


# embeddings

_MEAN = "x AS (SELECT vec_id, label, vec_id % 50 AS m, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def _vectors(s, d):
    return vectors.doubles(table(s, d, "embeddings")).withColumn("m", F.col("vec_id") % 50)


def _means(s, d):
    return vectors.mean_vectors(_vectors(s, d), ["m"])


@query(f"WITH {_MEAN} SELECT m, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS v FROM x GROUP BY 1, 2")
def mean_embedding(s, d):
    return _means(s, d).select("m", F.posexplode("embedding").alias("pos", "v")).withColumn("v", r6(F.col("v")))


@query(f"WITH {_MEAN} SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS v FROM x GROUP BY 1, 2")
def config_centroids(s, d):
    return vectors.mean_vectors(_vectors(s, d), ["label"]).select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", r6(F.col("v")))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vec_norm(s, d):
    return _vectors(s, d).select("vec_id", r6(vectors.norm(F.col("embedding"))).alias("norm"))


_GROUPS = f"{_MEAN}, e AS (SELECT m, pos, avg(v) AS v FROM x GROUP BY 1, 2), g AS (SELECT m, list(v ORDER BY pos) AS v FROM e GROUP BY 1), p AS (SELECT a.m AS i, b.m AS j, list_cosine_similarity(a.v, b.v) AS sim FROM g a JOIN g b ON a.m < b.m)"


def _pairs(s, d):
    return vectors.pairs(_means(s, d), "m", "embedding")


@query(f"WITH {_GROUPS} SELECT i, j, round(sim, 6) AS sim FROM p")
def cosine_pairs(s, d):
    return _pairs(s, d).withColumn("sim", r6(F.col("sim")))


@query(f"WITH {_GROUPS}, q AS (SELECT i, j, round(sim, 6) AS sim FROM p) SELECT * FROM (SELECT 'top' AS kind, * FROM q ORDER BY sim DESC, i, j LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bottom', * FROM q ORDER BY sim, i, j LIMIT 10) UNION ALL SELECT * FROM (SELECT 'orthogonal', * FROM q ORDER BY abs(sim), i, j LIMIT 10)")
def pairs_topk(s, d):
    q = _pairs(s, d).withColumn("sim", r6(F.col("sim")))
    best = lambda name, *order: q.orderBy(*order, "i", "j").limit(10).select(F.lit(name).alias("kind"), "i", "j", "sim")
    return best("top", F.desc("sim")).unionAll(best("bottom", "sim")).unionAll(best("orthogonal", F.abs("sim")))


@query(f"WITH {_GROUPS} SELECT count(*) AS n, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, round(min(sim), 6) AS min, round(max(sim), 6) AS max FROM p")
def pair_stats(s, d):
    return _pairs(s, d).agg(F.count("*").alias("n"), *[r6(f("sim")).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


_CENTRED = f"{_MEAN}, c AS (SELECT label, pos, avg(v) AS c FROM x GROUP BY 1, 2)"


@query(f"WITH {_CENTRED} SELECT vec_id, round(sqrt(sum((v - c) * (v - c))), 6) AS distance FROM x JOIN c USING (label, pos) GROUP BY 1")
def centering(s, d):
    v = _vectors(s, d)
    centre = vectors.mean_vectors(v, ["label"]).withColumnRenamed("embedding", "c")
    return v.join(centre, "label").select("vec_id", r6(vectors.norm(vectors.minus(F.col("embedding"), F.col("c")))).alias("distance"))


_AXIS = f"{_MEAN}, u AS (SELECT pos, avg(v) AS u FROM x WHERE label = 0 GROUP BY 1), uu AS (SELECT sum(u * u) AS uu FROM u), k AS (SELECT vec_id, any_value(label) AS label, sum(v * u) AS vu, sum(v * v) AS vv FROM x JOIN u USING (pos) GROUP BY 1), r AS (SELECT vec_id, label, vu / sqrt(uu) AS coefficient, sqrt(greatest(vv - vu * vu / uu, 0)) AS residual FROM k, uu)"


def _projection(s, d):
    v = _vectors(s, d)
    axis = vectors.mean_vectors(v.where("label = 0").withColumn("one", F.lit(1)), ["one"]).first()
    u = F.array(*map(F.lit, axis["embedding"])) if axis else F.array().cast("array<double>")
    p = v.select("vec_id", "label", "embedding", vectors.projected(F.col("embedding"), u).alias("p"), u.alias("u"))
    return p.select("vec_id", "label", (vectors.dot(F.col("p"), F.col("u")) / F.greatest(vectors.norm(F.col("u")), F.lit(1e-12))).alias("coefficient"), vectors.norm(vectors.minus(F.col("embedding"), F.col("p"))).alias("residual"))


@query(f"WITH {_AXIS} SELECT vec_id, round(coefficient, 6) AS coefficient, round(residual, 6) AS residual FROM r")
def projection(s, d):
    return _projection(s, d).select("vec_id", r6(F.col("coefficient")).alias("coefficient"), r6(F.col("residual")).alias("residual"))


@query(f"WITH {_AXIS} SELECT label, count(*) AS n, round(avg(coefficient), 6) AS mean, round(stddev_samp(coefficient), 6) AS std FROM r GROUP BY 1")
def projection_stats(s, d):
    return _projection(s, d).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("coefficient")).alias("mean"), r6(F.stddev_samp("coefficient")).alias("std"))


@query(f"WITH {_MEAN}, m AS (SELECT pos, avg(v) AS a, stddev_pop(v) AS sd FROM x GROUP BY 1) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - a) / sd, 6) AS z FROM x JOIN m USING (pos)")
def standardize(s, d):
    x = _vectors(s, d).select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    m = x.groupBy("pos").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("sd"))
    return x.join(m, "pos").select("vec_id", "pos", r6((F.col("v") - F.col("a")) / F.nullif("sd", F.lit(0.0))).alias("z"))


@query(f"WITH {_CENTRED}, w AS (SELECT label, vec_id, sum((v - c) * (v - c)) AS d2 FROM x JOIN c USING (label, pos) GROUP BY 1, 2), n AS (SELECT label, count(*) AS n, sum(d2) AS w FROM w GROUP BY 1), a AS (SELECT pos, avg(v) AS a FROM x GROUP BY 1), b AS (SELECT label, sum((c - a) * (c - a)) AS b FROM c JOIN a USING (pos) GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS k, round(sum(w), 4) AS wcss, round(sum(n * b), 4) AS bcss, round(stddev_pop(n) / avg(n), 6) AS size_cv, round((sum(n * b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM n JOIN b USING (label)")
def cluster_quality(s, d):
    q = vectors.cluster_quality(_vectors(s, d), "label")
    return q.select("n", "k", F.round("wcss", 4).alias("wcss"), F.round("bcss", 4).alias("bcss"), r6(F.col("size_cv")).alias("size_cv"), r6(F.col("calinski_harabasz")).alias("calinski_harabasz"))


@query("WITH v AS (SELECT vec_id AS i, label AS g, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT a.i, a.g AS gi, b.g AS gj, avg(list_distance(a.v, b.v)) AS d FROM v a JOIN v b ON a.i <> b.i GROUP BY 1, 2, 3), s AS (SELECT i, max(d) FILTER (WHERE gi = gj) AS a, min(d) FILTER (WHERE gi <> gj) AS b FROM d GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s")
def silhouette(s, d):
    return vectors.silhouette(_vectors(s, d), "vec_id", "label").select(r6(F.col("silhouette")).alias("silhouette"))


@query(f"WITH {_GROUPS} SELECT i, j, round(sim, 6) AS weight FROM p WHERE sim >= 0.3")
def sim_graph(s, d):
    return _pairs(s, d).where("sim >= 0.3").select("i", "j", r6(F.col("sim")).alias("weight"))


@query(f"WITH {_GROUPS}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (WHERE sim >= threshold) AS edges FROM p, t GROUP BY 1")
def sim_graph_stats(s, d):
    t = _pairs(s, d).select("sim", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7)))).alias("threshold"))
    return t.groupBy("threshold").agg(F.count_if(F.col("sim") >= F.col("threshold")).alias("edges"))


@query("SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM embeddings GROUP BY 1")
def composition(s, d):
    n = table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1
    return n.withColumn("pct", r6(100.0 * F.col("n") / F.lit(total)))


@query("WITH c AS (SELECT label, vec_id % 3 AS v, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT label, round(max(n) / sum(n), 6) AS purity, arg_max(v, n * 10 - v) AS dominant FROM c GROUP BY 1")
def purity(s, d):
    c = table(s, d, "embeddings").groupBy("label", (F.col("vec_id") % 3).alias("v")).agg(F.count("*").alias("n"))
    return c.groupBy("label").agg(r6(F.max("n") / F.sum("n")).alias("purity"), F.max_by("v", F.col("n") * 10 - F.col("v")).alias("dominant"))


# corpus summaries


@query("SELECT count(*) AS records, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens, round(avg(len(string_split(text, ' '))), 6) AS mean_tokens FROM conversations")
def prompt_stats(s, d):
    n = table(s, d, "conversations").select(F.size(F.split("text", " ")).alias("n"))
    return n.agg(F.count("*").alias("records"), F.sum("n").alias("tokens"), r6(F.avg("n")).alias("mean_tokens"))


@query("SELECT count(*) AS n, max(len(embedding))::BIGINT AS dims, count(DISTINCT label) AS labels FROM embeddings")
def emb_metadata(s, d):
    return table(s, d, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("bigint").alias("dims"), F.countDistinct("label").alias("labels"))


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def negatives(s, d):
    t = table(s, d, "labels")
    for column, wanted in (("sentiment", F.lit("negative")), ("sentiment_label", F.lit("negative")), ("toxic", F.lit(1))):
        if column in t.columns:
            return t.where(F.col(column) == wanted).select("doc_id")
    raise ValueError("no column tells which rows are negative")


@query("SELECT u.conv_id, u.turn, u.text AS message, coalesce(a.text, '') AS response FROM conversations u LEFT JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
def merged(s, d):
    c = table(s, d, "conversations")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    asked = c.where("role = 'user'").select(name(F.col("turn")).alias("messageId"), "conv_id", "turn", F.col("text").alias("message"))
    said = c.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("messageId"), F.col("text").alias("response"))
    return enrich.merged(asked, said).select("conv_id", "turn", "message", "response")


@query("SELECT count(*) AS n_rows, count(l.doc_id) AS ok, count(*) - count(l.doc_id) AS failed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def enrich_summary(s, d):
    r = table(s, d, "labels").select(F.col("doc_id").alias("r"))
    both = _docs(s, d).select("doc_id").join(r, F.col("doc_id") == F.col("r"), "left")
    return both.agg(F.count("*").alias("n_rows"), F.count("r").alias("ok"), (F.count("*") - F.count("r")).alias("failed"))
