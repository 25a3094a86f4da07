"""Command line: ``python -m quilate.cli COMMAND ...``; every command reads and writes Parquet, CSV or text folders."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilate.operators import connect, conllu, enrich, frames, lexical, metrics, prompts
from quilate.sources import stores, tables


def _made(path: str) -> Callable:
    """The function that ``module:name`` stands for."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def add_text_metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Text metrics of every row, resumed from the checkpoints of a stopped run."""
    df = frames.require(spark.read.parquet(a.input_file), a.text_column)
    parse = a.udpipe_column if a.udpipe_column in df.columns else None
    # metrics follow from the text and its parse, so each distinct pair is analysed once and known by its digest
    digest = F.sha2(F.concat_ws("\x01", F.coalesce(a.text_column, F.lit("")), F.coalesce(parse, F.lit("")) if parse else F.lit("")), 256)
    rows = df.withColumn("_row", digest)
    distinct = rows.select("_row", *[c for c in (a.text_column, parse) if c]).dropDuplicates(["_row"])
    store = stores.Checkpoint(spark, a.checkpoint_dir or f"{a.output_file}.checkpoint")
    work = lambda part: metrics.analyzed(part, "_row", a.text_column, parse=parse)
    found = stores.resumed(distinct, "_row", work, store, not a.no_resume, a.parts)
    names = {m.lower() for m in metrics.DEFAULTS}
    out = rows.select(*[c for c in rows.columns if c.lower() not in names]).join(found, "_row", "left").drop("_row")
    out.write.mode("overwrite").parquet(a.output_file)
    store.clean()


def ctf_idf(spark: SparkSession, a: argparse.Namespace) -> None:
    """The ten terms of highest class-based TF-IDF of each class, as CSV."""
    df = frames.require(spark.read.parquet(a.data_file), "model", a.agg_column, a.text_column).where(F.col("model") == a.model_name)
    stop = lexical.all_stop_words(spark, ("portuguese",))
    scores = lexical.ctfidf(lexical.term_counts(df, a.agg_column, a.text_column, stop), a.agg_column, required=True)
    top = lexical.top_terms(scores, 10, a.agg_column)
    classes = [r[0] for r in df.select(a.agg_column).where(F.col(a.agg_column).isNotNull()).distinct().orderBy(a.agg_column).collect()]
    stores.write_csv(lexical.wide(top, classes, a.agg_column), f"{a.output_dir}/{a.model_name}_{a.agg_column}")


def masked_personas(spark: SparkSession, a: argparse.Namespace) -> None:
    """Terms of a target group against an unmarked one, with z-scores above 1.96, as text."""
    df = frames.require(spark.read.parquet(a.input_file), a.target_col, a.text_col)
    if a.model_name:
        df = frames.require(df, "model").where(F.col("model") == a.model_name)
    counts = lexical.group_counts(df, a.target_col, a.text_col, stop=lexical.all_stop_words(spark), required=True)
    found = lexical.log_odds(counts, a.target_name, a.unmarked_name, a.target_col).where("z > 1.96").orderBy(F.desc("z"), "term")
    tables.write_report(found.select(lexical.report_line().alias("line")), a.output_dir, "%s", "line")


def sentiment(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sentiment labels from an injected model (text -> "LABEL:score"); failures are UNKNOWN with score 0."""
    from quilate.functions.text import label_name

    df = frames.require(spark.read.parquet(a.input_file), a.text_column).na.fill("", [a.text_column]).where(F.length(a.text_column) > 0)
    called = enrich.call(df, "", a.text_column, _made(a.connector), into="_said")
    parts = F.split(F.coalesce("_said", F.lit("UNKNOWN:0.0")), ":")
    out = called.withColumns({"sentiment_label": label_name(parts[0]), "sentiment_score": parts[1].cast("double")}).drop("_said", "error")
    out.write.mode("overwrite").parquet(f"{a.output_dir}/sentiment")
    stores.write_csv(out.groupBy("sentiment_label").agg(F.count("*").alias("n")), f"{a.output_dir}/summary")


def promptl(spark: SparkSession, a: argparse.Namespace) -> None:
    """Render all prompts of a folder's templates for every persona and model."""
    traits: dict[str, list[str]] = {}
    for r in tables.read_traits(spark, a.trait_list_path).collect():
        traits.setdefault(r.trait, []).append(r.value)
    models = [r.model for r in spark.read.json(a.model_config_folder, multiLine=True).select("model").distinct().orderBy("model").collect()]
    grid = prompts.personas(spark, {k: tuple(v) for k, v in traits.items()})
    out = prompts.messages(grid, tables.read_templates(spark, a.prompt_path), models)
    out.write.mode("overwrite").partitionBy("template_name").parquet(f"{a.prompt_path}/rendered/messages")


def call_llm(spark: SparkSession, a: argparse.Namespace) -> None:
    """Responses that a record still lacks, from chat clients made by ``--registry module:name``."""
    record = stores.load_record(spark, a.record_path)
    messages = frames.require(record["messages"], "messageId", "message", "model")
    done = record.get("responses")
    counts = done.where("response IS NOT NULL").groupBy("messageId").agg(F.count("*").alias("_n")) if done is not None else None
    left = messages.withColumn("_times", F.lit(a.ntimes)) if counts is None else messages.join(counts, "messageId", "left").withColumn("_times", F.lit(a.ntimes) - F.coalesce("_n", F.lit(0))).drop("_n")
    found = connect.asked(left.where("_times > 0"), "message", "model", _made(a.registry), times="_times", concurrency=a.concurrency)
    new = found.where("error IS NULL").select("messageId", F.expr("uuid()").alias("responseId"), "response")
    new.write.mode("append").parquet(f"{a.record_path}/responses")


def call_udpipe(spark: SparkSession, a: argparse.Namespace) -> None:
    """Parses that a record's responses still lack; failures go to a dead-letter table."""
    record = stores.load_record(spark, a.record_path)
    items = record["responses"].select("responseId", "response")
    if "parses" in record:
        items = enrich.pending(items, record["parses"], "responseId")
    called = stores.written_once(enrich.call(items, "responseId", "response", connect.parser(a.url), into="udpipe_result"), f"{a.record_path}/called")
    called.where("error IS NULL").select("responseId", "udpipe_result").write.mode("append").parquet(f"{a.record_path}/parses")
    enrich.dead_letters(called, "responseId", "response").write.mode("overwrite").json(f"{a.record_path}/failed_items")


def to_parquet(spark: SparkSession, a: argparse.Namespace) -> None:
    """All records of a folder as one wide table."""
    out = stores.load_records(spark, a.record_folder, a.templates)
    out.select(*[F.col(c).cast("string") if t == "void" else F.col(c) for c, t in out.dtypes]).write.mode("overwrite").parquet(a.output_file)


def generate_prompt_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    """Numbers and lengths in words of a folder's messages and responses."""
    n = stores.load_records(spark, a.record_folder, a.templates).select(F.size(F.split("message", " ")).alias("asked"), F.size(F.split("response", " ")).alias("said"))
    n.agg(F.count("*").alias("records"), F.sum("asked").alias("asked"), F.sum("said").alias("said"), F.avg("asked").alias("mean_asked"), F.avg("said").alias("mean_said")).show(truncate=False)


def lemmatize(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lemma strings of a column of parses."""
    df = frames.require(spark.read.parquet(a.input_file), a.column)
    out = df.withColumn("lemmas", conllu.lemmas(F.flatten(conllu.parsed(F.coalesce(a.column, F.lit(""))))))
    out.write.mode("overwrite").parquet(a.output_file)


def parsed_arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quilate", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(f: Callable, *required: str, **optional) -> None:
        one = commands.add_parser(f.__name__, help=f.__doc__)
        for name in required:
            one.add_argument(f"--{name}", required=True)
        for name, default in optional.items():
            if isinstance(default, bool):
                one.add_argument(f"--{name}", action="store_true")
            elif isinstance(default, list):
                one.add_argument(f"--{name}", nargs="+", default=default)
            else:
                one.add_argument(f"--{name}", default=default, type=type(default) if default is not None else str)
        one.set_defaults(run=f)

    add(add_text_metrics, "input_file", "output_file", text_column="response", udpipe_column="udpipe_result", parts=1, checkpoint_dir=None, no_resume=False)
    add(ctf_idf, "model_name", "agg_column", "data_file", "output_dir", text_column="response")
    add(masked_personas, "input_file", "target_col", "target_name", "unmarked_name", "output_dir", text_col="response", model_name=None)
    add(sentiment, "input_file", "output_dir", "connector", text_column="response")
    add(promptl, "prompt_path", "trait_list_path", "model_config_folder")
    add(call_llm, "record_path", "registry", ntimes=1, concurrency=6)
    add(call_udpipe, "record_path", "url")
    add(to_parquet, "record_folder", "output_file", templates=[])
    add(generate_prompt_stats, "record_folder", templates=[])
    add(lemmatize, "input_file", "output_file", column="udpipe_result")
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parsed_arguments().parse_args(arguments)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
