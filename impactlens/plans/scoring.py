"""Weekly batch scoring of the newest papers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from impactlens.plans.training import Artifacts, predict_with_uncertainty
from impactlens.sources.tables import newest_week, write_json


def score_newest_week(papers: DataFrame, artifacts: Artifacts, path: str, horizon: int | None = None) -> DataFrame:
    """Forecast the latest submission week, write one JSON object per paper, return the rows."""
    rows = predict_with_uncertainty(newest_week(papers), artifacts, horizon).select(
        "paper_id", "published", "primary_cat", "mean", "q10", "q90"
    )
    write_json(rows, path)
    return rows
