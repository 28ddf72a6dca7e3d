"""Text logs and reports as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfspark.runtime import lookup
from perfspark.functions.text import regex_groups, with_groups

# One pattern per kind of line, with (column, type) per group.
PATTERNS = {
    "training": (
        r"Time\s+(\d+\.\d+|\d+) s - Epoch\s+(\d+) step (\d+) bs (\d+) - loss_train=(\d+\.\d+|\d+), (\{.*\})",
        [("time", "double"), ("epoch", "int"), ("step", "bigint"), ("bs", "int"), ("loss_train", "double"), ("metric", "string")],
    ),
    "replay_task": (
        r"Task (\d+) \(workload key: \[\"(\w+)\.{3}\): T'=([\d.]+), W=(\d+), N_leaf=(-1|[.\d]+)(?:, src=(random|tenset))?",
        [("task_id", "bigint"), ("workload_key", "string"), ("cost", "double"), ("weight", "int"), ("n_leaf", "int"), ("src", "string")],
    ),
    "replay_total": (
        r"Estimated total latency of (\w+): ([.\d]+) ms",
        [("network", "string"), ("iter_time", "double")],
    ),
    "search": (
        r"ElapsedTime\(s\)\t(\d+)\tEstimatedLatency\(ms\)\t(N/A|[+-]?(?:[0-9]*[.])?[0-9]+)\t",
        [("elapsed", "bigint"), ("latency", "double")],
    ),
    "selection": (
        r"Selected (\d+) tasks: (\d+(?:,\d+)*) \((\d+(?:,\d+)*)\) using the '(\w+)' method, with the diff2origin of ([-e\d.]+)$",
        [("task_num", "int"), ("ids", "string"), ("names", "string"), ("method", "string"), ("diff", "double")],
    ),
    "cluster": (r"Cluster (\d+), error=([\d.]+)", [("cluster_id", "int"), ("error", "double")]),
    "cross_task": (r"Cross-task, error=([\d.]+)", [("error", "double")]),
    "task_error": (r"file \S*?_(\d+)\.npy, error=([\d.]+)", [("task_id", "bigint"), ("error", "double")]),
}
# Fixed value: model, batch size, device and method in a search log name.
SEARCH_NAME = r"(\w+)-B(\d+)-cuda-(\w+)-([\w-]+)\.tsv"
METRIC = "map<string,double>"


def parse_lines(lines: DataFrame, kind: str, text: str = "value") -> DataFrame:
    """Rows of the lines that fit the pattern of a kind; the others go."""
    pattern, groups = PATTERNS[kind]
    fit = lines.withColumn("__g", regex_groups(F.col(text), pattern, len(groups))).where(F.size("__g") > 0)
    cols = [F.get("__g", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(groups)]
    return fit.select(*[c for c in lines.columns if c != text], *cols)


def training_log(lines: DataFrame) -> DataFrame:
    """Training lines; undefined metrics become 1e6, errors are percentages,
    RMSE is in ms."""
    rows = parse_lines(lines, "training")
    text = F.regexp_replace(F.regexp_replace("metric", "'", '"'), "nan|inf", "1e6")
    m = rows.withColumn("__m", F.from_json(text, METRIC)).drop("metric")
    return m.select(
        *[c for c in m.columns if c != "__m"],
        (F.col("__m")["mape"] * 100).alias("mape"), (F.col("__m")["rmse"] * 1000).alias("rmse"),
        *[F.col("__m")[f"{p}%accuracy"].alias(f"acc{p}") for p in (20, 10, 5)])


def replay_log(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, "replay_task").withColumn("src", F.coalesce("src", F.lit("old_random")))


def search_log(lines: DataFrame) -> DataFrame:
    """Search trajectories with model, batch size, device, method from the file
    name; points without a latency go."""
    rows = parse_lines(lines, "search").where(F.col("latency").isNotNull())
    named = with_groups(rows, "path", SEARCH_NAME, ["model", "bs", "device", "method"])
    return named.withColumn("bs", F.col("bs").cast("int"))


def selection_log(lines: DataFrame) -> DataFrame:
    rows = parse_lines(lines, "selection")
    return rows.withColumns({c: F.split(c, ",").cast("array<bigint>") for c in ("ids", "names")})


def bracketed_dict(text: str) -> Column:
    """Map from ``{'k': 'v', ...}`` text."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"('[^',]+': '[^']*')"), F.lit(1))
    pairs = F.transform(found, lambda s: F.split(F.regexp_replace(s, r"^'|'$", ""), "': '"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))


def config_map(text: str) -> Column:
    """Map from ``k=v,k=v`` text."""
    return F.str_to_map(F.col(text), F.lit(","), F.lit("="))


def report_section(lines: DataFrame, title: str, schema: str) -> DataFrame:
    """Table of a report: the header is two lines below the title, the rows go
    on to the next blank line.  ``lines``: path, line_no, value.

    Three small facts per file frame the section; rows are picked by range.
    """
    starts = lines.where(F.col("value").contains(title)).groupBy("path").agg((F.min("line_no") + 2).alias("__head"))
    blank = lines.where(F.trim("value") == "").join(starts, "path").where(F.col("line_no") > F.col("__head")).groupBy(
        "path").agg(F.min("line_no").alias("__end"))
    # three numbers per file, so the lines stay where they are
    frame = lookup(starts.join(blank, "path", "left"))
    framed = lines.join(frame, "path")
    inside = (F.col("line_no") > F.col("__head")) & (F.col("__end").isNull() | (F.col("line_no") < F.col("__end")))
    row = F.from_csv("value", schema, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return framed.where(inside).select("path", "line_no", row.alias("r")).select("path", "line_no", "r.*")


TUNE = "state int, time string, best_target double, target double, config map<string,string>"


def tune_log(spark: SparkSession, path: str) -> DataFrame:
    """Tuning trials from JSON lines; broken lines are skipped."""
    return spark.read.schema(TUNE).option("mode", "DROPMALFORMED").json(path)
