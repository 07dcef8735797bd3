"""Snapshots and annotations: texts of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _said(text: Column) -> Column:
    """``pos`` and ``line`` of the lines of a snapshot that are nodes."""
    body = lambda line: F.trim(F.regexp_replace(F.trim(F.substring(line, 3, 1 << 30)), r":$", ""))
    lines = F.transform(F.split(text, r"\r?\n"), lambda line, pos: F.struct(pos.alias("pos"), F.trim(line).alias("line")))
    lines = F.transform(F.filter(lines, lambda x: F.startswith(x["line"], F.lit("- "))), lambda x: F.struct(x["pos"].alias("pos"), body(x["line"]).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def _role(line: Column) -> Column:
    return F.regexp_extract(line, r"^([^ \[]*)", 1)


def _name(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, r'^[^"]*+"((?:[^"\\]++|\\.)*+)"', 1), r"\\(.)", "$1")


def parse_snapshots(df: DataFrame, key: list[str], text: str = "snapshot", outer: bool = False) -> DataFrame:
    """``pos``, ``role`` and ``name`` of each line of a snapshot that is a node; with ``outer`` one without nodes has a row of nulls."""
    explode = F.explode_outer if outer else F.explode
    rows = df.select(*key, explode(_said(F.col(text))).alias("x")).select(*key, "x.pos", "x.line")
    return rows.select(*key, "pos", _role(F.col("line")).alias("role"), _name(F.col("line")).alias("name"))


def snapshot_nodes(text: Column) -> Column:
    """``role`` and ``name`` of the nodes of a snapshot, as an array."""
    return F.transform(_said(F.coalesce(text, F.lit(""))), lambda x: F.struct(_role(x["line"]).alias("role"), _name(x["line"]).alias("name")))


def artifact_nodes(artifacts: DataFrame) -> DataFrame:
    """``baseline_id, run_id, role, name`` of the nodes of artifacts that hold a snapshot, and ``schema_status`` on the first of an artifact.

    An artifact without nodes has a row with a null role, so that none is lost.
    """
    shown = F.when((F.col("type") == "llm_input") & (F.col("schema_status") == "PASS"), snapshot_nodes(F.col("content")))
    rows = artifacts.select("baseline_id", "run_id", "schema_status", F.posexplode_outer(shown).alias("pos", "node"))
    return rows.select("baseline_id", "run_id", "node.role", "node.name", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("schema_status")).alias("schema_status"))


def _lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Lines of annotations: comments and blank ones gone; indent, whether an item begins, key and value."""
    rows = df.select(*key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.rtrim(F.regexp_replace("line", "#.*$", ""))).where(F.trim("line") != "")
    indent = F.length("line") - F.length(F.ltrim("line"))
    body = F.trim("line")
    item = F.startswith(body, F.lit("- "))
    body = F.when(item, F.trim(F.substring(body, 3, 1 << 30))).otherwise(body)
    value = F.trim(F.regexp_extract(body, r"^[^:]*:(.*)$", 1))
    out = rows.select(*key, "pos", indent.alias("indent"), item.alias("item"), F.trim(F.regexp_extract(body, r"^([^:]*):", 1)).alias("key"), value.alias("value"))
    return out.withColumn("value", F.regexp_replace("value", r"""^(["'])(.*)\1$""", "$2"))


def _valid(count: Column) -> Column:
    return F.coalesce(F.expr("try_cast(min_count AS int)"), F.lit(0))


def _entries(rows: DataFrame, group: list[str]) -> DataFrame:
    """The last value of each key of a group, as columns. An empty ``minCount`` rules the entry out, others count from 0."""
    out = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "value"))).alias("_said"))
    get = lambda k: F.try_element_at(F.filter("_said", lambda x: x["key"] == k), F.lit(-1))["value"]
    named = {"id": "id", "role": "role", "name": "name", "capability": "capability", "minCount": "min_count", "type": "type", "description": "description"}
    out = out.select(*group, *(get(k).alias(n) for k, n in named.items()))
    return out.withColumn("min_count", F.coalesce("min_count", F.lit("1")))


def read_targets(df: DataFrame, key: list[str], text: str = "yaml") -> tuple[DataFrame, DataFrame]:
    """Annotations to count targets (entries with a role) and to evidence (``target_id, evidence_id`` ...)."""
    rows = _lines(df, key, text)
    order = W.partitionBy(*key).orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    starts = (F.col("indent") == 0) & ~F.col("item") & (F.col("key") == "targets")
    began = F.max(starts.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_in", F.coalesce(began, F.lit(0)) == 1)
    ended = F.max((F.col("_in") & (F.col("indent") == 0)).cast("int")).over(upto)
    rows = rows.withColumn("_end", ended).where(F.col("_in") & (F.col("_end") == 0))
    level = F.first(F.when(F.col("item"), F.col("indent")), ignorenulls=True).over(upto)
    rows = rows.withColumn("_level", level).where("_level IS NOT NULL")
    top = F.col("item") & (F.col("indent") == F.col("_level"))
    rows = rows.withColumn("_target", F.sum(top.cast("int")).over(upto)).withColumn("_top", top)
    inside = W.partitionBy(*key, "_target").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    opens = (F.col("key") == "evidence") & ~F.col("item")
    rows = rows.withColumn("_ev", F.max(opens.cast("int")).over(inside)).withColumn("_opens", opens)
    rows = rows.withColumn("_evidence", F.sum((F.col("item") & ~F.col("_top") & (F.col("_ev") == 1)).cast("int")).over(inside))
    # one group for a target's own lines (number 0) and one for each of its evidence
    rows = rows.where("NOT _opens AND (_ev = 0 OR _evidence > 0)").withColumn("_entry", F.when(F.col("_ev") == 0, 0).otherwise(F.col("_evidence")))
    entries = _entries(rows, [*key, "_target", "_entry"])
    counted = [F.coalesce("capability", F.lit("")).alias("capability"), "role", F.coalesce("name", F.lit("")).alias("name"), _valid(F.col("min_count")).alias("min_count")]
    whole = F.expr("id <> '' AND role <> '' AND min_count <> ''")
    counts = entries.where((F.col("_entry") == 0) & whole).select(*key, F.col("id").alias("target_id"), *counted)
    own = F.first(F.when(F.col("_entry") == 0, F.struct("id", "type", "description")), ignorenulls=True).over(W.partitionBy(*key, "_target"))
    evidence = entries.withColumn("_own", own).where((F.col("_entry") > 0) & whole & (F.col("_own.id") != ""))
    about = [F.col("_own.id").alias("target_id"), F.coalesce("_own.type", F.lit("information")).alias("target_type"), F.coalesce("_own.description", F.lit("")).alias("description")]
    return counts, evidence.select(*key, *about, F.col("id").alias("evidence_id"), *counted)
