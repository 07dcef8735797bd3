"""Files of captures, evaluations and experiments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators.evaluate import artifact_columns

TARGET = "struct<id:string,bounds:array<int>,expected:string,acceptable:array<string>>"
RUN = f"""runId string, createdAtMs long, testsetId string, image string, inputMode string, targetCount int, imageEncoding string,
encodedImageBytes int, imagePrepareMs long, modelLoadMs long, inferenceMs long, totalMs long, batchSize int, batchCount int, prompt string,
targets array<{TARGET}>, rawOutput string, parsedOutput array<struct<id:string,desc:string>>, error struct<code:string,message:string>, file string"""
UNKNOWN_MS = ("imagePrepareMs", "modelLoadMs", "inferenceMs", "totalMs")


def scan_captures(spark: SparkSession, *roots: str) -> DataFrame:
    """Artifacts under ``captures/{baseline}/runs/{run}/{plugin}/{raw|transformed}/{file}``; evaluations are left out.

    ``roots`` are folders at or below which they are. Rows come in no order: ``sort_artifacts`` sorts what is shown.
    """
    return artifacts_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots)))


def artifacts_of(files: DataFrame) -> DataFrame:
    """The artifacts among files (``path``, ``length``, ``content``), also of a stream of them."""
    where = r"captures/([^/]+)/runs/([^/]+)/([^/]+)/(raw|transformed)/([^/]+)$"
    parts = [F.regexp_extract("path", where, k + 1).alias(n) for k, n in enumerate(("baseline_id", "run_id", "plugin", "stage", "file"))]
    found = files.where(F.col("path").rlike(where)).select(*parts, "path", F.col("length").alias("bytes"), F.col("content").cast("string").alias("content"))
    return artifact_columns(found.where("plugin <> 'evaluation'"))


#: File endings by content type.
ENDINGS = {"text/xml": ".xml", "text/yaml": ".yml", "application/json": ".json", "text/html": ".html"}


#: Columns of ``write_captures``.
CAPTURES = "run_id string, plugin string, stage string, source string, ts long, content_type string, content string, file string, baseline_id string"


def read_captures(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """The table of ``write_captures`` as artifacts with their content, also as a stream of its files."""
    found = (spark.readStream if stream else spark.read).schema(CAPTURES).parquet(root)
    return artifact_columns(found.drop("content_type").withColumn("bytes", F.octet_length("content")))


def write_captures(df: DataFrame, root: str) -> None:
    """``baseline_id, run_id, plugin, stage, source, ts, content_type, content`` as a table with file names.

    Partitioned by baseline alone. Rows are dealt by baseline, then evened out by their size: small baselines share a task and
    have a file each, and one that outweighs ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` is written by several.
    """
    ending = F.lit(".txt")
    for kind, e in ENDINGS.items():
        ending = F.when(F.col("content_type") == kind, e).otherwise(ending)
    named = df.withColumn("file", F.concat("source", F.lit("_"), F.col("ts").cast("string"), ending))
    dealt = named.hint("rebalance", "baseline_id")
    dealt.sortWithinPartitions("baseline_id", "run_id", "plugin", "stage").write.mode("append").partitionBy("baseline_id").parquet(root)


def write_evaluation(counts: DataFrame, targets: DataFrame, results: DataFrame, summary: DataFrame, root: str) -> None:
    """One JSON line per run: summary, counts, and targets with their evidence, partitioned by baseline.

    Everything is gathered by run, so that tables which are dealt by run stay where they are: evidence finds its target within the run.
    """
    keys = ["baseline_id", "run_id"]
    evidence = results.groupBy(*keys, "target_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", "capability", "role", "name", "min_count", "actual_count", "status"))).alias("_list"))
    evidence = evidence.where("target_id IS NOT NULL").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("target_id", "_list"))).alias("_evidence"))
    t = targets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("target_id", "passed", "total", "score", "status"))).alias("_targets"))
    c = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("target_id", "role", "name", "min_count", "actual_count", "status"))).alias("countResults"))
    s = summary.select(*keys, F.struct(*(x for x in summary.columns if x not in keys)).alias("summary"))
    told = s.join(c, keys, "left").join(t, keys, "left").join(evidence, keys, "left")
    with_evidence = F.transform("_targets", lambda x: x.withField("evidenceResults", F.try_element_at("_evidence", x["target_id"])))
    write_evaluated(told.select(*keys, "summary", "countResults", with_evidence.alias("targetResults")), root)


def write_evaluated(runs: DataFrame, root: str) -> None:
    """Rows of ``evaluate_runs`` as JSON lines, partitioned by baseline. They name each other's evidence over and over, so files are gzipped."""
    runs.write.mode("overwrite").option("compression", "gzip").partitionBy("baseline_id").json(root)


def read_testsets(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Targets of icon test sets, in the order of their file: a file for each set, or with ``lines`` a line."""
    sets = spark.read.schema(f"testset_id string, image string, targets array<{TARGET}>").json(path, multiLine=not lines)
    rows = sets.select("testset_id", "image", F.posexplode("targets").alias("position", "t"))
    b = F.col("t.bounds")
    box = F.when(F.size(b) == 4, F.struct(*(b[k].alias(s) for k, s in enumerate(("left", "top", "right", "bottom")))))
    return rows.select("testset_id", "image", "position", F.col("t.id").alias("target_id"), box.alias("bounds"), F.coalesce("t.expected", F.lit("")).alias("expected"), F.coalesce("t.acceptable", F.array().cast("array<string>")).alias("acceptable"))


def read_experiment_runs(spark: SparkSession, path: str) -> DataFrame:
    """Results of runs, newest first. Files that can't be read are skipped; unknown times are -1."""
    runs = spark.read.schema(RUN).json(path, mode="DROPMALFORMED").where("runId IS NOT NULL")
    given = {c: F.coalesce(c, F.lit(-1)) for c in UNKNOWN_MS} | {c: F.coalesce(c, F.lit("")) for c in ("image", "inputMode", "testsetId", "rawOutput", "prompt")} | {"batchCount": F.coalesce("batchCount", F.lit(1))}
    return runs.withColumns(given).orderBy(F.desc("createdAtMs"), F.desc("runId"))


def safe_file_name(c):
    """A run id as a file name."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^a-zA-Z0-9._-]", "_")
    return F.when(bare == "", "icon_experiment_run").otherwise(bare)


def write_experiment_runs(df: DataFrame, root: str) -> None:
    """One JSON line per run, with the ``file`` name that the run goes by; no folder or file of its own."""
    df.withColumn("file", safe_file_name(F.col("runId"))).write.mode("append").json(root)


SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {}
CONTRACT = "tree_id source node_id parent_id depth path sibling_pos role role_source role_confidence name text content_desc resource_id class_name bounds states web_idx ref".split()


def register_source(name: str, to_nodes: Callable[[DataFrame], DataFrame]) -> None:
    """A user's reader of a source; what it returns must follow the node contract."""
    SOURCES[name] = to_nodes


def read_source(name: str, df: DataFrame) -> DataFrame:
    nodes = SOURCES[name](df)
    if missing := [c for c in CONTRACT if c not in nodes.columns]:
        raise ValueError(f"the source {name} lacks {', '.join(missing)}")
    return nodes.select(*CONTRACT)
