"""Fixed values of the quality model.

Fixed values: every number and word in this file is part of the result
contract (weights, thresholds, labels) and must not be tuned here.
"""

# Finding kinds.
MISSINGNESS = "missingness"
CARDINALITY = "cardinality"
DUPLICATES = "duplicates"
INVALID_VALUES = "invalid_values"
OUTLIER = "outlier"
FINDING_KINDS = (MISSINGNESS, CARDINALITY, DUPLICATES, INVALID_VALUES, OUTLIER)

# Severities, worst first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_PENALTY_WEIGHT = {"critical": 1.0, "high": 0.75, "medium": 0.45, "low": 0.20, "info": 0.05}
SEVERITY_PRIORITY_WEIGHT = {"critical": 100, "high": 75, "medium": 45, "low": 20, "info": 5}
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}

# Detector thresholds.
NULL_RATE_THRESHOLD = 0.5
CARDINALITY_THRESHOLD = 0.8
DUPLICATE_THRESHOLD = 0.05
SKEW_THRESHOLD = 0.1
PLACEHOLDERS = ("", "n/a", "na", "null", "none", "undefined", "-")

# Confidence that a finding is a real data error: base + slope * clamp(value / scale).
ERROR_CONFIDENCE = {
    MISSINGNESS: (0.55, 0.45, 1.0),
    INVALID_VALUES: (0.75, 0.25, 5.0),
    OUTLIER: (0.50, 0.30, 1.0),
    DUPLICATES: (0.50, 0.25, 1.0),
    CARDINALITY: (0.40, 0.20, 1.0),
}
UNKNOWN_KIND_CONFIDENCE = 0.5
CONFIDENCE_EPSILON = 1e-9

# Grades and health words: lower bound -> label, highest first.
GRADE_BANDS = ((90.0, "A"), (75.0, "B"), (60.0, "C"), (40.0, "D"))
LOWEST_GRADE = "F"
HEALTH_BANDS = ((90.0, "Excellent"), (80.0, "Good"), (70.0, "Fair"), (60.0, "Needs work"))
LOWEST_HEALTH = "Poor"

# Drift.
DRIFT_METRICS = ("mean", "median", "std", "min", "max")
PSI_EPSILON = 1e-9
NUMERIC_DRIFT_BANDS = ((0.50, "high"), (0.20, "medium"))
PSI_DRIFT_BANDS = ((0.20, "medium"), (0.10, "low"))
SCORE_DRIFT_BANDS = ((20.0, "high"), (10.0, "medium"), (5.0, "low"))
NO_DRIFT_BAND = "info"

# Recommendations.
RECOMMENDATION_KIND = {
    MISSINGNESS: "missingness_treatment",
    DUPLICATES: "duplicate_removal",
    INVALID_VALUES: "data_quality_fix",
    OUTLIER: "outlier_treatment",
    CARDINALITY: "cardinality_reduction",
}
REVIEW_KIND = "pipeline_review"
DROP_COLUMN_NULL_RATE = 0.80
RARE_CATEGORY_MIN_COUNT = 5
MAX_RECOMMENDATIONS = 50
NUMERIC_METRIC_NAMES = ("mean", "median", "std", "min", "max", "sum")

# Wording of results: finding descriptions, recommendation titles, context lines.
DESCRIPTION = {
    MISSINGNESS: "Column '%s' has %d null values (%s) which is above the threshold (%s).",
    CARDINALITY: "Column '%s' has %d distinct values across %d non-null rows (%s); it may be a primary key or free-form text.",
    DUPLICATES: "Approximately %d of %d rows (%s) are exact duplicates in the sampled frame.",
    INVALID_VALUES: "Column '%s' contains placeholder values (e.g. 'N/A', 'null') in its top entries.",
    OUTLIER: "Numeric column '%s' shows a large mean-vs-median skew (%s), which often indicates outliers.",
}
TITLE = {
    "drop_column": "Drop sparse column '%s'",
    "impute_missing": "Impute missing values in '%s'",
    "review_missing": "Review null rate for '%s'",
    "drop_duplicates": "Drop exact duplicate rows",
    "cast_type": "Cast or normalize column '%s'",
    "cap_outliers": "Cap outliers in '%s'",
    "review_outliers": "Review outliers in '%s'",
    "group_rare_categorical": "Group rare categories in '%s'",
    "review_unknown": "Review unsupported finding",
}
CONTEXT_LINE = "  - id=%s kind=%s severity=%s column=%s value=%s threshold=%s summary=%s"

# Profile, context and listing sizes.
TOP_VALUES = 10
SAMPLE_ROWS = 100_000
MAX_COLUMN_NAME = 255
CONTEXT_FINDINGS = 20
HYPOTHESES = 3
HYPOTHESIS_CONFIDENCE = 0.1

# Headline indicators.
VALIDITY_DEFAULT = 0.99
TIMELINESS_DEFAULT = 0.986
TIMELINESS_DAYS = 1800.0

DATASET_SCOPE = "<dataset>"
FORMULA_VERSION = "1.0"
