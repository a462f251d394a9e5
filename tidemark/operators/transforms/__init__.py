"""Transforms: `config -> DataFrame -> TransformResult`, found by name or alias."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import date_parse, dedup, encoding, imputation, outliers, scaling, splits, text_clean, types
from .result import TransformResult

TRANSFORMS: dict[str, tuple[Callable[[DataFrame, dict], TransformResult], list[str]]] = {
    "imputation": (imputation.impute, imputation.METHODS),
    "outlier": (outliers.treat_outliers, outliers.METHODS),
    "dedup": (dedup.deduplicate, dedup.METHODS),
    "encoding": (encoding.encode, encoding.METHODS),
    "normalization": (scaling.scale, scaling.METHODS),
    "string_clean": (text_clean.clean_text, text_clean.METHODS),
    "date_parse": (date_parse.parse_dates, date_parse.METHODS),
    "data_split": (splits.split_rows, splits.METHODS),
    "type_conversion": (types.convert_types, types.METHODS),
}

# Other names users may write. An alias picks the transform, never its method.
ALIASES = {
    "imputation": ["fill_missing", "impute"],
    "outlier": ["remove_outliers", "cap_outliers", "winsorize", "outlier_removal"],
    "dedup": ["remove_duplicates", "deduplicate", "deduplication"],
    "encoding": ["one_hot", "label_encode", "ordinal_encode", "target_encode"],
    "normalization": ["scale", "standardize", "minmax", "normalize", "zscore", "scaling"],
    "string_clean": ["clean_string", "trim", "strip", "text_clean"],
    "date_parse": ["parse_date", "extract_date"],
    "data_split": ["split_data", "train_test_split"],
    "type_conversion": ["convert_type", "cast_type"],
}


def find_transform(name: str) -> Callable[[DataFrame, dict], TransformResult]:
    for canonical, (fn, _) in TRANSFORMS.items():
        if name == canonical or name in ALIASES.get(canonical, []):
            return fn
    raise ValueError(f"Unknown transform type: {name}")


def register_transform(name: str, fn: Callable[[DataFrame, dict], TransformResult],
                       methods: list[str] | None = None) -> None:
    """Add a transform of one's own."""
    TRANSFORMS[name] = (fn, methods or [])


def list_transforms() -> list[dict]:
    return [{"type": name, "description": (fn.__doc__ or "").strip(), "supported_methods": methods}
            for name, (fn, methods) in TRANSFORMS.items()]


def apply_transform(df: DataFrame, name: str, config: dict | None = None) -> TransformResult:
    return find_transform(name)(df, config or {})
