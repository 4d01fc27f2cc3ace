"""Named analysis steps over table versions, from profile to preview."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from rowassay import constants as C
from rowassay.operators.comparison import any_entry, category_counts, distribution_drift, drift_flags, population_stability, schema_diff, score_drift
from rowassay.operators.detectors import run_detectors, with_finding_ids
from rowassay.operators.previews import operations_of, preview_operations
from rowassay.operators.profile import profile
from rowassay.operators.recommendations import keep_best, recommend
from rowassay.operators.row_duplicates import row_duplicates
from rowassay.operators.scoring import quality_scores, scored_findings, score_breakdown, table_sizes
from rowassay.session import settle
from rowassay.sources.store import ResultStore
from rowassay.sources.structure import table_columns

DISTRIBUTION = "column string, metric string, base_value double, target_value double, psi double, absolute_change double, relative_change double, band string"
NO_SCORE = "dataset_id string, score double, grade string"

STEPS = ("profile", "detect", "score", "recommendations", "validations", "history")


def assess(df: DataFrame, name: str, threshold: float = C.NULL_RATE_THRESHOLD, exact_duplicates: bool = True, max_recommendations: int | None = C.MAX_RECOMMENDATIONS) -> dict[str, DataFrame]:
    """Profile, findings, score, breakdown and recommendations of one table.

    The table is profiled at once and the profile, one row per column, settled in the shared folder;
    everything after it is lazy and never reads the table again.
    """
    profiled = settle(profile(df, keys={"dataset_id": name}), "profile")
    counts = settle(row_duplicates(df).select(F.lit(name).alias("dataset_id"), "*"), "rows") if exact_duplicates else None
    return {"profile": profiled, **judge(profiled, counts, threshold, max_recommendations)}


def judge(profiled: DataFrame, row_counts: DataFrame | None = None, threshold: float = C.NULL_RATE_THRESHOLD, max_recommendations: int | None = C.MAX_RECOMMENDATIONS) -> dict[str, DataFrame]:
    """Findings, score, breakdown and recommendations of profiled tables keyed by ``dataset_id``.

    ``max_recommendations`` keeps the best per table; None keeps all.
    """
    keys = ["dataset_id"]
    findings = with_finding_ids(run_detectors(profiled, row_counts, threshold, keys), keys)
    scored = scored_findings(findings)
    sizes = table_sizes(profiled, keys)
    return {
        "findings": findings,
        "scored": scored,
        "scores": quality_scores(sizes, scored, keys),
        "breakdown": score_breakdown(scored, sizes, keys),
        "recommendations": keep_best(recommend(findings, keys), max_recommendations, keys),
    }


def compare(
    base: DataFrame, target: DataFrame, name: str, threshold: float = C.NULL_RATE_THRESHOLD
) -> dict[str, DataFrame]:
    """Everything that differs between two versions of a table."""
    if base is target:
        raise ValueError("base and target are the same version")
    sides = [assess(df, name, threshold) for df in (base, target)]
    psi = settle(population_stability(category_counts(base), category_counts(target)), "psi")
    scores = [settle(side["scores"], "score") for side in sides]
    return compare_stored(table_columns(base), table_columns(target), sides[0]["profile"], sides[1]["profile"], *scores, psi)


def compare_stored(base_columns, target_columns, base_profile, target_profile, base_score, target_score, psi=None) -> dict[str, DataFrame]:
    """The comparison from stored columns, profiles and scores.

    Where a profile is missing (None) there is no distribution to compare, and the schema and the scores remain.
    """
    schema = schema_diff(base_columns, target_columns)
    if base_profile is None or target_profile is None:
        distribution = base_columns.sparkSession.createDataFrame([], DISTRIBUTION)
    else:
        distribution = distribution_drift(base_profile, target_profile, psi=psi)
    scores = score_drift(base_score, target_score, ["dataset_id"])
    return {
        "schema": schema,
        "distribution": distribution,
        "scores": scores,
        "flags": drift_flags(schema, distribution, scores),
        "any_entry": any_entry(schema, distribution, scores),
    }


class StepError(ValueError):
    """A step that cannot run as asked; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _step(store: ResultStore, dataset_id: str, kind: str, version: int, parameters: dict, run_id: str) -> dict:
    owned = F.lit(version).alias("version_number")

    def results_of(step: str, table: str) -> DataFrame | None:
        """What the newest run of a step wrote, maybe no rows; None without such a run or any rows of the table."""
        run = store.last_run(dataset_id, step, version)
        if run is None or not store.exists(table):
            return None
        return store.read(table, dataset_id).where(F.col("run_id") == run)

    def put(table: str, rows: DataFrame) -> DataFrame:
        store.append(table, rows.select("*", owned), dataset_id, run_id)
        return store.read(table, dataset_id).where(F.col("run_id") == run_id) if store.exists(table) else rows.limit(0)

    def profile_of(number: int) -> DataFrame:
        found = store.latest_profile(dataset_id, number)
        if found is None:
            raise StepError("missing_profile", f"version {number} has no profile")
        return found

    if kind == "profile":
        return {"columns": put("profiles", profile(store.version(dataset_id, version))).count()}
    if kind == "detect":
        profiled = profile_of(version)
        counts = row_duplicates(store.version(dataset_id, version)).select(F.lit(dataset_id).alias("dataset_id"), "*")
        found = run_detectors(profiled, counts, parameters.get("threshold", C.NULL_RATE_THRESHOLD), ["dataset_id"])
        return {"finding_count": put("findings", with_finding_ids(found, ["dataset_id"])).count(), "profile_run_id": profiled.first().run_id}
    if kind == "score":
        profiled, findings = profile_of(version), results_of("detect", "findings")
        # a detect run without findings is a clean table, which gets its score too
        scored = scored_findings(_no_findings(profiled) if findings is None else findings)
        sizes = table_sizes(profiled, ["dataset_id"])
        row = put("scores", quality_scores(sizes, scored, ["dataset_id"])).first()
        put("score_breakdowns", score_breakdown(scored, sizes, ["dataset_id"]))
        put("scored_findings", scored.drop("run_id", "created_at", "formula_version", "version_number"))
        return {"score": row.score, "grade": row.grade, "detect_run_id": store.last_run(dataset_id, "detect", version)}
    if kind == "recommendations":
        findings = results_of("detect", "findings")
        if findings is None:
            return {"count": 0}
        limit = parameters.get("max_recommendations", C.MAX_RECOMMENDATIONS)
        return {"count": put("recommendations", keep_best(recommend(findings, ["dataset_id"]), limit, ["dataset_id"])).count()}
    if kind == "validations":
        recommendations = results_of("recommendations", "recommendations")
        operations = operations_of(recommendations) if recommendations is not None else []
        if not operations:
            return {"count": 0}
        return {"count": put("validations", preview_operations(store.version(dataset_id, version), operations)).count()}
    if kind == "history":
        base, target = parameters.get("base_version"), parameters.get("target_version")
        if base is None or target is None:
            raise StepError("missing_versions", "history needs base_version and target_version")
        if base == target:
            raise StepError("same_version", "base and target are the same version")
        columns = [store.columns(dataset_id, v) for v in (base, target)]
        profiles = [store.latest_profile(dataset_id, v) for v in (base, target)]
        psi = None if None in profiles else population_stability(*[category_counts(store.version(dataset_id, v)) for v in (base, target)])
        result = compare_stored(*columns, *profiles, *[_score_of(store, dataset_id, v) for v in (base, target)], psi)
        for table, part in (("schema_diffs", "schema"), ("distribution_drifts", "distribution"), ("score_drifts", "scores")):
            store.append(table, result[part].select("*", F.lit(base).alias("base_version"), F.lit(target).alias("target_version")), dataset_id, run_id)
        return {"has_drift": result["flags"].first().has_drift}
    raise StepError("unsupported_step", f"unknown step: {kind}")


def _score_of(store: ResultStore, dataset_id: str, version: int) -> DataFrame:
    """The score of the newest score run of a version, or no row."""
    run = store.last_run(dataset_id, "score", version)
    if run is None:
        return store.spark.createDataFrame([], NO_SCORE)
    return store.read("scores", dataset_id).where(F.col("run_id") == run)


def _no_findings(profiled: DataFrame) -> DataFrame:
    return run_detectors(profiled, None, C.NULL_RATE_THRESHOLD, ["dataset_id"]).where(F.lit(False))


def run_steps(store: ResultStore, dataset_id: str, steps, version: int, parameters: dict | None = None) -> DataFrame:
    """Run named steps in order and record the outcome of each as a ``runs`` row (C4).

    A failing step is recorded with its error code and the following steps still run. The driver only
    sequences Spark jobs; every step reads and writes stored tables.
    """
    schema = "step_run_id string, kind string, version_number int, status string, result map<string,string>, error_code string, error_message string, started_at timestamp_ntz"
    rows = []
    for kind in steps:
        run_id, started = uuid.uuid4().hex, datetime.now(UTC).replace(tzinfo=None)
        try:
            result, status, code, message = _step(store, dataset_id, kind, version, parameters or {}, run_id), "succeeded", None, None
        except StepError as error:
            result, status, code, message = {}, "failed", error.code, str(error)
        except PySparkException as error:
            result, status, code, message = {}, "failed", error.getCondition() or "spark_error", str(error).splitlines()[0]
        rows.append((run_id, kind, version, status, {k: None if v is None else str(v) for k, v in result.items()}, code, message, started))
        # written as each step ends: later steps look their predecessor up, and a crash loses nothing
        store.append("runs", store.spark.createDataFrame(rows[-1:], schema), dataset_id)
    return store.spark.createDataFrame(rows, schema)
