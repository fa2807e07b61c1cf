"""Readable names for features, models and metrics."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered rewrite of feature names, per kind of model. "all" rewrites every
# match, "first" only the first one; "sentence" and "trim" act on the whole text.
LABEL_RULES = {
    "rf": [
        ("all", "_", " "),
        ("first", "craving", ""),
        ("first", " yes", ""),
        ("first", " true", ""),
        ("first", " false", ""),
        ("first", ":::", ""),
        ("first", "Craving", ""),
        ("all", "occupation", "activity"),
        ("all", "env", "with"),
        ("all", "with alone", "alone"),
        ("all", "severity", "craving severity"),
        ("all", "qd", "quit date"),
        ("all", "prev rep", "previous report"),
        ("sentence",),
        ("all", " x6.30", ": 6-30 mins"),
        ("all", " x31.60", ": 31-60 mins"),
        ("all", "mins", "minutes"),
        ("all", "Mins", "Minutes"),
        ("all", "Cigs", "Cigarettes"),
        ("all", "cig", "cigarette"),
        ("all", "Activity", "Activity:"),
        ("all", "Feeling", "Feeling:"),
        ("trim",),
    ],
    "svm": [
        ("all", "_", " "),
        ("first", "craving", ""),
        ("first", " true", ""),
        ("all", "occupation", "activity"),
        ("all", "env", "with"),
        ("all", "with alone", "alone"),
        ("all", "severity", "craving severity"),
        ("all", " false", ": false"),
        ("all", "qd", "quit date"),
        ("all", " yes", ": yes"),
        ("all", "prev rep", "previous report"),
        ("sentence",),
        ("all", " x6.30", ": 6-30 mins"),
        ("all", "Activity", "Activity:"),
        ("all", "Feeling", "Feeling:"),
        ("trim",),
    ],
    "elnet": [
        ("all", "_", " "),
        ("first", "craving", ""),
        ("first", "true", ""),
        ("first", "false", ""),
        ("first", "yes", ""),
        ("all", "occupation", "activity"),
        ("all", "env", "with"),
        ("all", "with alone", "alone"),
        ("all", "severity", "craving severity"),
        ("all", "qd", "quit date"),
        ("all", "prev rep", "previous report"),
        ("sentence",),
        ("all", " x6.30", ": 6-30 mins"),
        ("all", "Activity", "Activity:"),
        ("all", "Feeling", "Feeling:"),
        ("trim",),
    ],
    "xgb": [
        ("all", "_", " "),
        ("first", "craving", ""),
        ("first", "true", ""),
        ("first", "false", ""),
        ("first", "yes", ""),
        ("all", "occupation", "activity"),
        ("all", "env", "with"),
        ("all", "with alone", "alone"),
        ("all", "severity", "craving severity"),
        ("all", "qd", "quit date"),
        ("all", "prev rep", "previous report"),
        ("all", "wkday", "day of the week:"),
        ("sentence",),
        ("all", " x6.30", ": 6-30 mins"),
        ("all", "1", "Monday"),
        ("all", "5", "Friday"),
        ("all", "Cigs", "Cigarettes"),
        ("all", "cig", "cigarette"),
        ("all", "Mins", "Minutes"),
        ("all", "mins", "Minutes"),
        ("all", "2", "Tuesday"),
        ("trim",),
    ],
    "individual": [
        ("first", "craving", ""),
        ("all", "_", " "),
        ("all", "occupation", "activity"),
        ("all", "env", "with"),
        ("all", "with alone", "alone"),
        ("all", "severity", "craving severity"),
        ("all", " true", ": true"),
        ("all", " false", ": false"),
        ("all", " yes", ": yes"),
        ("all", "time of day", "Time of day:"),
        ("all", "wkday", "day of the week:"),
        ("sentence",),
        ("all", "1", "Monday"),
        ("all", "2", "Tuesday"),
        ("all", "3", "Wednesday"),
        ("all", "4", "Thursday"),
        ("all", "5", "Friday"),
        ("all", "6", "Saturday"),
        ("trim",),
    ],
}
# Feature groups by the words in a label, first match wins.
GROUP_RULES = [
    ("Feeling|Craving", "Feeling state"),
    ("Activity", "Activity"),
    ("With|Alone", "Social context"),
    ("Prior event|Day|Time", "Temporal"),
]
# Display names.
METRIC_LABELS = {"sens": "Sensitivity", "spec": "Specificity", "accuracy": "Accuracy", "roc_auc": "AUC"}
MODEL_LABELS = {
    "rf": "Random Forest",
    "xgb": "XGBoost",
    "svm": "Support Vector Machine",
    "elnet": "Penalised Logistic Regression",
}


def sentence_case(text: Column) -> Column:
    """First letter upper, the rest lower; leading blanks stay."""
    start = F.ltrim(text)
    blanks = F.repeat(F.lit(" "), F.length(text) - F.length(start))
    return F.concat(blanks, F.upper(F.left(start, F.lit(1))), F.lower(F.substring(start, 2, 1 << 20)))


def clean_feature_label(name: Column, rules: str = "individual") -> Column:
    """Apply the ordered rules of one kind of model."""
    for kind, *args in LABEL_RULES[rules]:
        if kind == "all":
            name = F.regexp_replace(name, *args)
        elif kind == "first":
            name = F.regexp_replace(name, f"^(.*?){args[0]}", f"$1{args[1]}")
        elif kind == "sentence":
            name = sentence_case(name)
        else:
            name = F.trim(name)
    return name


def feature_group(label: Column) -> Column:
    """Group of a readable label; a label of no group is its own."""
    out = F
    for pattern, group in GROUP_RULES:
        out = out.when(label.rlike(pattern), group)
    return out.otherwise(label)


def name_suffix(name: Column) -> Column:
    """Text after the last underscore."""
    return F.substring_index(name, "_", -1)


def lookup(key: Column, names: dict[str, str]) -> Column:
    out = F
    for old, new in names.items():
        out = out.when(key == old, new)
    return out.otherwise(F.lit(None))


def level_order(value: Column, levels) -> Column:
    """1-based position in a declared level list; null for a value outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), value), F.lit(0))
