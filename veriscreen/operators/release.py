"""Gates of a released collection: provenance, archived blobs, sampled membership, model and threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def provenance_violations(manifest: DataFrame, status: str = "verified-historical") -> DataFrame:
    """Cohorts of manifest(cohort, data_status, verified) with another status, or that claim to be a study's own cohort."""
    wrong = ~F.col("data_status").eqNullSafe(F.lit(status)) | ~F.col("verified").eqNullSafe(F.lit(False))
    return manifest.where(wrong).select("cohort", "data_status", "verified")


def blob_violations(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, rule) of archived files found(name, size, git_sha1, rows, ids) that differ from what is expected, or are missing."""
    both = expected.alias("e").join(found.alias("f"), "name", "left")
    rules = [F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")), F.lit(c)) for c in ("size", "git_sha1", "rows", "ids")]
    return both.select("name", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def sampled_differences(recorded: DataFrame, chunks: DataFrame, key: str = "pmid") -> DataFrame:
    """(pmid, n_chunks, only_in): where a manifest's sampled articles and the window file's own counts differ."""
    own = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
    recorded = recorded.select(key, F.col("n_chunks").cast("long").alias("n_chunks"))
    return recorded.exceptAll(own).withColumn("only_in", F.lit("manifest")).union(own.exceptAll(recorded).withColumn("only_in", F.lit("file")))


def check_threshold(threshold: dict, run_id: str | None, aggregation: str = "mean") -> float:
    """The cut-off of a threshold document that belongs to a run and to averaged scores."""
    value = threshold.get("threshold")
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not 0 <= value <= 1:
        raise ValueError("the threshold must be a number between 0 and 1")
    if run_id is not None and threshold.get("run_id") != run_id:
        raise ValueError("the threshold belongs to another run")
    if threshold.get("aggregation", aggregation) != aggregation:
        raise ValueError("article scores must be means of window scores")
    return float(value)


#: The cohorts that a release's relationship checks are about.
INTERNAL = ("internal_positive_pool", "internal_negative_top_china", "internal_negative_top_other_train", "internal_negative_top_taiwan")
CHINA, OTHER = "audit_china_5000", "audit_other_5000"
RAW, CLEAN, POSITIVE = "external_negative_raw", "external_negative_clean", "external_positive_pubpeer"


def relationships(members: DataFrame, present: set[str], key: str = "pmid") -> dict:
    """The recorded checks, recomputed from members(pmid, cohort) in one pass; none for a release without these cohorts."""
    if not {*INTERNAL, CHINA, OTHER, RAW, CLEAN, POSITIVE} <= present:
        return {}
    own = members.groupBy(key).agg(F.collect_set("cohort").alias("own"))
    has = lambda *names: F.arrays_overlap("own", F.array(*(F.lit(n) for n in names)))
    internal = has(*INTERNAL)
    counts = {
        "internal_unique_articles": internal, "external_raw_internal_overlap": has(RAW) & internal, "clean_equals_raw_minus_internal": has(CLEAN) != (has(RAW) & ~internal),
        "audit_group_overlap": has(CHINA) & has(OTHER), "audit_china_internal_overlap": has(CHINA) & internal, "audit_other_internal_overlap": has(OTHER) & internal,
        "audit_china_external_positive_overlap": has(CHINA) & has(POSITIVE), "audit_other_external_positive_overlap": has(OTHER) & has(POSITIVE), "audit_other_external_negative_overlap": has(OTHER) & has(RAW),
    }
    row = own.agg(*(F.count_if(c).alias(k) for k, c in counts.items())).first().asDict()
    return row | {"clean_equals_raw_minus_internal": row["clean_equals_raw_minus_internal"] == 0}
