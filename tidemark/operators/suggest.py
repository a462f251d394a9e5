"""Suggested fixes, from the data itself or from stored profiles and failed checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .eda import Exploration
from .transforms import apply_transform
from .transforms.result import TransformResult

SCHEMA = "type string, priority string, title string, columns array<string>, method string, description string"
# Order of priorities.
PRIORITY = {"high": 0, "medium": 1, "low": 2}


def from_data(df: DataFrame) -> DataFrame:
    """Fill gaps, drop duplicates, cap outliers, encode text; or nothing to do."""
    x = Exploration(df)
    out = []
    gaps = [(c, s["nulls"]) for c, s in x.stats.items() if s["nulls"]]
    if gaps:
        worst = sorted(gaps, key=lambda g: -round(g[1] / x.rows * 100, 1))[:3]
        shown = ", ".join(f"{c} ({round(n / x.rows * 100, 1)}%)" for c, n in worst)
        out.append(("imputation", "high", "Fill the gaps", [c for c, _ in gaps], "mode",
                    f"{len(gaps)} columns have gaps, the widest are {shown}"))
    if x.duplicates:
        out.append(("dedup", "medium", "Keep each row once", [], "exact",
                    f"{x.duplicates} rows ({round(x.duplicates / x.rows * 100, 1)} %) repeat another"))
    wild = [c for c, o in x.outliers.items()
            if o["iqr"] > o["n"] * 0.05 and o["n"] > 10 and x.quartiles[c][0] != x.quartiles[c][2] and x.distinct[c] > 2]
    if wild:
        out.append(("outlier", "medium", "Cap extreme values", wild, "iqr_cap",
                    f"over a twentieth of the values lie beyond the fences: {', '.join(wild[:5])}"))
    if x.text:
        out.append(("encoding", "medium", "Turn texts into numbers", x.text, "one_hot",
                    f"{len(x.text)} text columns: {', '.join(x.text[:5])}"))
    if not out:
        out.append(("info", "low", "Nothing to do", [], "profile", "no gaps, repeated rows, extreme values or texts"))
    return df.sparkSession.createDataFrame(out, SCHEMA)


TEXT_TYPES = frozenset(("object", "string", "category", "str"))
NUMBER_TYPES = frozenset(("int64", "float64", "number", "numeric", "int", "bigint", "smallint", "tinyint", "float", "double"))
# What a column's profile may call for: test, priority, wording, and the transform with its method.
COLUMN_NEEDS = [
    (lambda p: (p.get("null_pct") or 0) > 5, "high", "Fill gaps", "imputation", "median"),
    (lambda p: p.get("type") in NUMBER_TYPES and abs(p.get("skew") or 0) > 2, "medium", "Cap extreme values", "outlier", "iqr"),
    (lambda p: p.get("type") in TEXT_TYPES and 0 < (p.get("unique") or 0) < (p.get("count") or 0) / 2, "medium", "Turn texts into codes", "encoding", "label"),
    (lambda p: p.get("type") in TEXT_TYPES and (p.get("unique") or 0) > 0.9 * (p.get("count") or 0) > 0, "low", "Look at near-unique texts", "review", "none"),
]
# What a failed check calls for, by its type.
CHECK_NEEDS = {"completeness": ("high", "Fill gaps", "imputation", "median"), "uniqueness": ("high", "Drop repeated rows", "dedup", "keep_first"),
               "validity": ("medium", "Watch the format", "quality_rule", "validity"), "anomaly": ("medium", "Cap extreme values", "outlier", "iqr")}


def from_profile(columns: list[dict], checks: list[dict], row_count: int = 0, column_count: int = 0,
                 limit: int | None = None) -> list[dict]:
    """Suggestions from column profiles (name, type, null_pct, unique, count, skew) and check results
    (type, status, column), most urgent first: one for each kind of need, with all its columns."""
    needs: dict[tuple, list[str]] = {}
    for c in checks:
        if c.get("status") == "failed" and c.get("type") in CHECK_NEEDS:
            needs.setdefault(CHECK_NEEDS[c["type"]], []).append(c.get("column") or "")
    for test, *need in COLUMN_NEEDS:
        for p in columns:
            if test(p):
                needs.setdefault(tuple(need), []).append(p["name"])
    if 0 < row_count < 1000 and column_count:
        needs["medium", "Gather more rows", "review", "none"] = []
    found = [{"type": kind, "priority": priority, "label": label, "config": {"columns": sorted(set(names) - {""}), "method": method}}
             for (priority, label, kind, method), names in needs.items()]
    return sorted(found, key=lambda s: (PRIORITY[s["priority"]], s["label"]))[:limit]


def from_profile_frame(df: DataFrame, checks: list[dict], limit: int | None = None) -> DataFrame:
    """`from_profile` on a fresh measurement of a table."""
    x = Exploration(df)
    columns = [{"name": c, "type": df.schema[c].dataType.simpleString(), "unique": x.distinct[c], "count": x.rows,
                "null_pct": s["nulls"] / x.rows * 100 if x.rows else 0, "skew": s.get("skew")}
               for c, s in x.stats.items()]
    found = from_profile(columns, checks, x.rows, len(df.columns), limit)
    rows = [(i + 1, s["type"], s["priority"], s["label"], json.dumps(s["config"], sort_keys=True))
            for i, s in enumerate(found)]
    return df.sparkSession.createDataFrame(
        rows, "position int, type string, priority string, label string, config string")


# Words of a message or rule name, and the transform that fits; the first row that matches counts.
FIX_FOR_WORDS = [("duplicate|unique|repeated", "dedup"), ("outlier|extreme|anomal", "outlier"), ("encod|categor", "encoding"),
                 ("normaliz|scale", "normalization"), ("date|timestamp", "date_parse"), ("type|cast", "type_conversion"),
                 ("format|valid|email|pattern", "string_clean"), ("null|missing|complete", "imputation")]


def fix_type(text: Column) -> Column:
    """Transform that fits a text, by the table of words; imputation when none fits."""
    matches = [F.when(F.lower(text).rlike(words), fix) for words, fix in FIX_FOR_WORDS]
    return F.coalesce(*matches, F.lit("imputation"))


def propose_fixes(failed_checks: DataFrame) -> DataFrame:
    """One proposal per failed check (columns: id, rule_name, message, score)."""
    words = F.concat_ws(" ", "message", "rule_name")
    fix = fix_type(words)
    return failed_checks.withColumn("fix_type", fix).withColumn("explanation", F.concat_ws("", F.lit("Score "), F.col("score").cast("string"), F.lit(": try "), fix))


def apply_fix(df: DataFrame, kind: str, config: dict | None = None) -> TransformResult:
    """Run an approved fix."""
    return apply_transform(df, kind, config)
