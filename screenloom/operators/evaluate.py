"""Snapshots held against annotated evidence, and the scores that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.schema import ROLES

EVIDENCE = ["baseline_id", "target_id", "evidence_id"]


def verdict(test: Column) -> Column:
    return F.when(test, F.lit("PASS")).otherwise(F.lit("FAIL"))


def match_evidence(nodes: DataFrame, evidence: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """``evidence`` per run with ``actual_count``: nodes of the role and of the name; an empty role or name is any.

    ``nodes``: baseline_id, run_id, role, name, of all sources of a run. ``runs`` (baseline_id, run_id): all runs that are
    judged; those without nodes find nothing. Without it they are the runs of the nodes.

    Nodes are counted by role and name before they meet anything. Names that no evidence of the baseline asks for become
    one, so what is gathered of a run is bounded by its roles and the names asked for, however many nodes it has.
    """
    keys = ["baseline_id", "run_id"]
    named = asked_names(nodes.groupBy(*keys, "role", "name").agg(F.count("*").alias("n")), evidence)
    # a name that several pieces of evidence ask for has come out as often, with the same count
    named = named.groupBy(*keys, "role", "name").agg(F.max("n").alias("_same"), F.sum("n").alias("_all"))
    named = named.select(*keys, "role", "name", F.when(F.col("name") != "", F.col("_same")).otherwise(F.col("_all")).alias("n"))
    return match_counts(named, evidence, runs)


def asked_names(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``nodes`` with the names that no evidence of their baseline asks for as ''; a row for each piece of evidence that asks."""
    asked = evidence.where("name <> ''").select("baseline_id", "name", F.lit(True).alias("_asked"))
    return nodes.join(asked, ["baseline_id", "name"], "left").withColumn("name", F.when(F.col("_asked"), F.col("name")).otherwise("")).drop("_asked")


def match_counts(named: DataFrame, evidence: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """``match_evidence`` from counts ``n`` by run, role and name; a run may also come with a null role alone."""
    keys = ["baseline_id", "run_id"]
    counts = named.groupBy(*keys).agg(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("role", "name", "n"))).alias("_counts"))
    if runs is not None:
        counts = runs.select(*keys).distinct().join(counts, keys, "left")
    met = counts.join(evidence, "baseline_id")
    return met.withColumn("actual_count", nodes_met(F.col("_counts"), F.col("role"), F.col("name"))).drop("_counts")


def nodes_met(counts: Column, role: Column, name: Column) -> Column:
    """How many nodes of a run's ``counts`` (role, name, n) have the role and the name; an empty one is any."""
    fits = lambda c: ((role == "") | (c["role"] == role)) & ((name == "") | (c["name"] == name))
    count = F.aggregate(F.filter(counts, fits), F.lit(0).cast("long"), lambda total, c: total + c["n"])
    return F.coalesce(count, F.lit(0).cast("long"))


def evaluate_counts(matched: DataFrame) -> DataFrame:
    return matched.withColumn("status", verdict(F.col("actual_count") >= F.col("min_count")))


def score_targets(results: DataFrame) -> DataFrame:
    """Per run and target: evidence passed and in all, score and status."""
    passed = F.sum((F.col("status") == "PASS").cast("int"))
    out = results.groupBy("baseline_id", "run_id", "target_id").agg(passed.alias("passed"), F.count("evidence_id").alias("total"))
    score = F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0)
    return out.withColumn("score", score).withColumn("status", verdict(F.col("passed") == F.col("total")))


def summarize_run(artifacts: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per run: artifacts, count targets, targets and evidence passed and in all. A run without artifacts fails."""
    keys = ["baseline_id", "run_id"]
    ok = lambda: F.sum((F.col("status") == "PASS").cast("int"))
    a = artifacts.groupBy(*keys).agg(F.count("*").alias("artifact_count"), F.bool_and(F.col("schema_status") == "PASS").alias("artifacts_ok"))
    c = counts.groupBy(*keys).agg(ok().alias("count_passed"), F.count("*").alias("count_total"))
    t = targets.groupBy(*keys).agg(ok().alias("target_passed"), F.count("*").alias("target_total"), F.sum("passed").alias("evidence_passed"), F.sum("total").alias("evidence_total"))
    runs = a.select(*keys).unionByName(c.select(*keys)).unionByName(t.select(*keys)).distinct()
    out = runs.join(a, keys, "left").join(c, keys, "left").join(t, keys, "left")
    numbers = ["artifact_count", "count_passed", "count_total", "target_passed", "target_total", "evidence_passed", "evidence_total"]
    out = out.select(*keys, F.coalesce("artifacts_ok", F.lit(False)).alias("ok"), *(F.coalesce(n, F.lit(0)).alias(n) for n in numbers))
    good = F.col("ok") & (F.col("count_passed") == F.col("count_total")) & (F.col("target_passed") == F.col("target_total")) & (F.col("evidence_passed") == F.col("evidence_total"))
    return out.withColumn("status", verdict(good)).drop("ok")


def evaluate_runs(nodes: DataFrame, counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row per run with its whole evaluation: ``summary``, ``countResults``, and ``targetResults`` with their evidence.

    The same as ``match_evidence``, ``evaluate_counts``, ``score_targets`` and ``summarize_run`` in one pass: nodes that are dealt
    by run stay where they are, and nothing is written or shuffled in between.

    ``nodes``: baseline_id, run_id, role, name, schema_status. The last is that of an artifact on one of its rows and null on
    the others; a row with a null role is no node. ``counted``: baseline_id, target_id, role, name, min_count; ``wanted``: the
    evidence. What is asked of a baseline is gathered, as its annotations are one text.
    """
    keys, piece = ["baseline_id", "run_id"], ["role", "name", "min_count"]
    ok = F.bool_and(F.col("schema_status") == "PASS")
    rows = nodes.groupBy(*keys, "role", "name").agg(F.count("*").alias("n"), F.count("schema_status").alias("artifact_count"), ok.alias("_ok"))
    rows = asked_names(rows, counted.select("baseline_id", "name").unionByName(wanted.select("baseline_id", "name")).distinct())
    totals = [F.sum("artifact_count").alias("artifact_count"), F.bool_and("_ok").alias("_ok")]
    rows = rows.groupBy(*keys, "role", "name").agg(F.sum("n").alias("n"), *totals)
    runs = rows.groupBy(*keys).agg(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("role", "name", "n"))).alias("_counts"), *totals)

    gathered = lambda *columns: F.sort_array(F.collect_list(F.struct(*columns)))
    asked = counted.groupBy("baseline_id").agg(gathered("target_id", *piece).alias("_counted"))
    targets = wanted.groupBy("baseline_id", "target_id").agg(gathered("evidence_id", "capability", *piece).alias("_evidence"))
    targets = targets.groupBy("baseline_id").agg(gathered("target_id", "_evidence").alias("_wanted"))

    def judged(pieces: Column) -> Column:
        met = F.transform(pieces, lambda e: e.withField("actual_count", nodes_met(F.col("_counts"), e["role"], e["name"])))
        return F.transform(met, lambda e: e.withField("status", verdict(e["actual_count"] >= e["min_count"])))

    def scored(t: Column) -> Column:
        passed, total = passing(t["_evidence"]), F.size(F.filter(t["_evidence"], lambda e: e["evidence_id"].isNotNull())).cast("long")
        score = F.when(total > 0, passed / total).otherwise(0.0)
        shown = F.when(t["target_id"].isNotNull(), t["_evidence"])
        return F.struct(t["target_id"].alias("target_id"), passed.alias("passed"), total.alias("total"), score.alias("score"), verdict(passed == total).alias("status"), shown.alias("evidenceResults"))

    passing = lambda pieces: F.size(F.filter(pieces, lambda e: e["status"] == "PASS")).cast("long")
    summed = lambda c, name: F.aggregate(c, F.lit(0).cast("long"), lambda n, t: n + t[name])
    told = runs.join(asked, "baseline_id", "left").join(targets, "baseline_id", "left")
    told = told.select(*keys, "artifact_count", "_ok", judged(F.col("_counted")).alias("countResults"), F.transform("_wanted", lambda t: t.withField("_evidence", judged(t["_evidence"]))).alias("_wanted"))
    told = told.withColumn("targetResults", F.transform("_wanted", scored))
    c, t = F.col("countResults"), F.col("targetResults")
    numbers = {
        "artifact_count": F.col("artifact_count"), "count_passed": passing(c), "count_total": F.size(c).cast("long"), "target_passed": passing(t), "target_total": F.size(t).cast("long"),
        "evidence_passed": summed(t, "passed"), "evidence_total": summed(t, "total"),
    }
    # what isn't asked of a baseline is null, and of nulls nothing has passed
    told = told.withColumn("_s", F.struct(*(F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)).cast("long").alias(k) for k, v in numbers.items())))
    s = F.col("_s")
    good = F.coalesce("_ok", F.lit(False)) & (s["count_passed"] == s["count_total"]) & (s["target_passed"] == s["target_total"]) & (s["evidence_passed"] == s["evidence_total"])
    return told.select(*keys, s.withField("status", verdict(good)).alias("summary"), "countResults", "targetResults")


def capability_coverage(results: DataFrame) -> DataFrame:
    """Evidence passed and in all by capability, by baseline and over all of them (null).

    A baseline's numbers, few rows by then, count for it and for all baselines, so that ``results`` are worked out once.
    """
    named = results.withColumn("capability", F.coalesce(F.nullif("capability", F.lit("")), F.lit("default")))
    out = named.groupBy("capability", "baseline_id").agg(F.sum((F.col("status") == "PASS").cast("int")).alias("passed"), F.count("*").alias("total"))
    both = out.withColumn("_every", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("baseline_id", F.when(~F.col("_every"), F.col("baseline_id")))
    summed = both.groupBy("capability", "baseline_id", "_every").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    return summed.drop("_every")


def size_reduction(sizes: DataFrame, key: str) -> DataFrame:
    """Raw and snapshot bytes by ``key`` and in all, with their ratio."""
    out = sizes.rollup(key).agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("snapshot_bytes").alias("snapshot_bytes"))
    return out.withColumn("ratio", F.col("snapshot_bytes") / F.col("raw_bytes"))


def entry_outcomes(plan: DataFrame, captures: DataFrame, transforms: DataFrame) -> DataFrame:
    """One row per planned plugin: its capture and, if that went well and it is wanted, its transform.

    ``plan``: run_id, plugin, transform; ``captures``, ``transforms``: run_id, plugin, ok, error.
    """
    c = captures.select("run_id", "plugin", F.col("ok").alias("capture_ok"), F.col("error").alias("capture_error"))
    t = transforms.select("run_id", "plugin", F.col("ok").alias("found_ok"), F.col("error").alias("found_error"))
    out = plan.join(c, ["run_id", "plugin"], "left").join(t, ["run_id", "plugin"], "left")
    captured = F.coalesce("capture_ok", F.lit(False))
    tried = captured & F.col("transform")
    return out.select(
        "run_id", "plugin", captured.alias("captured"), F.when(F.col("capture_ok").isNull(), "unsupported capture").when(~captured, F.col("capture_error")).alias("capture_error"),
        tried.alias("transform_tried"), (tried & F.coalesce("found_ok", F.lit(False))).alias("transformed"),
        F.when(tried & F.col("found_ok").isNull(), "unsupported transform").when(tried & ~F.col("found_ok"), F.col("found_error")).alias("transform_error"),
    )


#: Content types by file ending.
CONTENT_TYPES = {".xml": "text/xml", ".yml": "text/yaml", ".yaml": "text/yaml", ".json": "application/json", ".html": "text/html"}


def content_type(file: Column) -> Column:
    out = F.lit("")
    for ending, kind in CONTENT_TYPES.items():
        out = F.when(F.endswith(file, F.lit(ending)), kind).otherwise(out)
    return out


def artifact_columns(df: DataFrame) -> DataFrame:
    """``content_type``, ``type``, ``artifact_id`` and ``schema_status`` of files: plugin, stage, file, bytes."""
    file, plugin, stage = F.col("file"), F.col("plugin"), F.col("stage")
    kind = content_type(file)
    stem = F.replace(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit("-"))
    type_ = (
        F.when((plugin == "native") & (stage == "raw") & F.startswith(file, F.lit("native_xml_")) & (kind == "text/xml"), "raw_xml")
        .when((plugin == "native") & (stage == "transformed") & F.startswith(file, F.lit("native_semantic_snapshot_")) & (kind == "text/yaml"), "llm_input")
        .when((stage == "transformed") & F.startswith(file, F.lit("llm_input_")) & (kind == "text/yaml"), "llm_input")
        .when(kind == "text/xml", "xml")
        .when(kind == "text/yaml", "yaml")
        .when(kind == "application/json", "json")
        .when(kind == "text/html", "html")
        .otherwise(stem)
    )
    return df.withColumns({"content_type": kind, "type": type_, "artifact_id": F.concat(plugin, F.lit("."), type_), "schema_status": verdict((kind != "") & (F.col("bytes") > 0))})


def latest_run(runs: DataFrame) -> DataFrame:
    """The greatest run id of each baseline, in the order of strings."""
    row = F.struct(*runs.columns)
    return runs.groupBy("baseline_id").agg(F.max_by(row, "run_id").alias("_row")).select("_row.*").select(*runs.columns)


def newest_result(runs: DataFrame) -> DataFrame:
    """Of the latest runs of all baselines the one with the newest result (``result_at``); runs without one don't count."""
    latest = latest_run(runs).where("result_at IS NOT NULL")
    return latest.orderBy(F.desc("result_at"), "baseline_id").limit(1)


def sort_artifacts(artifacts: DataFrame) -> DataFrame:
    return artifacts.orderBy("plugin", "path")


def unknown_roles(targets: DataFrame) -> DataFrame:
    """Roles in use that the vocabulary hasn't."""
    return targets.select("role").where("role <> ''").distinct().where(~F.col("role").isin(*ROLES))


def validate_targets(targets: DataFrame) -> DataFrame:
    """``folder``, ``target_id``, ``problem``: what is wrong with annotations (folder, page, target_id, role, required_ref)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "missing page": empty("page"),
        "page differs from folder": ~empty("page") & (F.col("page") != F.col("folder")),
        "missing id": empty("target_id"),
        "missing role": empty("role"),
        "unknown role": ~empty("role") & ~F.col("role").isin(*ROLES),
        "missing requiredRef": empty("required_ref"),
        "requiredRef is neither true nor false": ~empty("required_ref") & ~F.col("required_ref").isin("true", "false"),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return targets.select("folder", F.coalesce("target_id", F.lit("")).alias("target_id"), F.explode(found).alias("problem"))
