"""Entry points: each runs the queries of one study and writes their tables; ``studies`` has those over a user's own tables.

``python -m spectrafield.plans.reports STUDY INPUT OUTPUT [--dates N R]`` or
``run(spark, study, sf_dir, out)``. Tables are CSV with 6 digits, or Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import write_table
from . import catalog

#: Tables of each study: name of the table, query.
STUDIES: dict[str, dict[str, str]] = {
    "aggregate_spectra": {"spectra": "hyper_aggregate_min_bands", "sets": "sets_per_point"},
    "audit": {"baseline": "baseline_mean_r2", "folds": "kfold_line_dates", "buffers": "random_vs_buffered_inflation", "permutations": "permutation_test", "groups": "repeated_group_folds"},
    "band_correlation": {"correlations": "correlation_profile", "top3": "top3_per_element", "heatmap": "corr_heatmap_pivot"},
    "dependence": {"distance": "distance_correlation", "kernel": "hsic_p", "information": "mutual_information", "partial": "partial_two", "sparse": "sparse_links", "canonical": "canonical", "ranks": "kendall_p"},
    "forests": {"predictions": "forest_folds", "scores": "forest_scores", "importance": "forest_importance", "buffered": "forest_buffered", "map": "forest_pixels"},
    "processes": {"predictions": "gaussian_process", "scores": "gaussian_scores"},
    "tuning": {"candidates": "tuned_models", "ridge": "ridge_curve", "stacked": "stacked_models"},
    "patches": {"windows": "reflected_windows", "squares": "point_patches", "copies": "patch_copies"},
    "windows": {"correlation": "window_correlation", "points": "clamped_windows"},
    "textures": {"cooccurrence": "glcm_texture", "patterns": "binary_patterns", "waves": "wave_textures"},
    "variograms": {"lags": "variogram_lags", "fits": "variogram_ranges", "neighbours": "morans_p", "buffers": "fitted_buffers"},
    "spectra_correlation": {"correlogram": "correlogram_profile", "best": "mean_target_top20"},
    "buffered_models": {"predictions": "ridge_two", "metrics": "metrics_join", "interval": "bootstrap_interval", "sweep": "buffer_sweep", "targets": "target_loo", "permutations": "permutation_targets"},
    "uncertainty": {"interval": "bootstrap_interval", "ranking": "category_ladder", "inflation": "inflation_summary"},
    "pixel_maps": {"statistics": "map_stats", "blended": "tile_blend", "passes": "pass_statistics"},
}


def tables(spark: SparkSession, study: str, sf_dir: str, dates: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a study; ``dates`` keeps these in tables that have dates. An unknown study raises ``ValueError``."""
    if study not in STUDIES:
        raise ValueError(f"unknown study: {study}")
    found = {name: catalog.queries()[query](spark, sf_dir) for name, query in STUDIES[study].items()}
    if dates is not None:
        found = {name: df.where(F.col("date").isin(dates)) if "date" in df.columns else df for name, df in found.items()}
    return found


def run(spark: SparkSession, study: str, sf_dir: str, out: str, dates: list[str] | None = None, kind: str = "csv") -> list[str]:
    """Write the tables of a study under ``out`` and return their paths."""
    paths = []
    for name, df in tables(spark, study, sf_dir, dates).items():
        paths.append(f"{out}/{name}.{kind}")
        write_table(df, paths[-1], 6)
    return paths


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Write the tables of a study.")
    parser.add_argument("study", choices=sorted(STUDIES))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--dates", nargs="+")
    parser.add_argument("--kind", choices=("csv", "parquet"), default="csv")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(asked.study).getOrCreate()
    print(*run(spark, asked.study, asked.input, asked.output, asked.dates, asked.kind), sep="\n")


if __name__ == "__main__":
    main()
