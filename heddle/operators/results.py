"""What a search gives back: its first results in order, and around them the search itself, counts and notes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import truncate
from heddle.operators.ranking import OPEN

# Characters of criteria that are shown and scored, and texts of the envelope.
PREVIEW = 2000
NOTICE = "\n[Truncated. Read the full criteria at the study link or rerun with --full-criteria.]"
STATUS_NOTES = {
    "NOT_YET_RECRUITING": "This site is expected to open but cannot screen patients yet.",
    "ENROLLING_BY_INVITATION": "Enrollment is by invitation only; patients cannot volunteer directly.",
}
RANKING = "Condition and --terms matches, treatment focus, phase, recruitment status, record recency, and API relevance."
WARNING = (
    "These are screening candidates, not eligibility determinations or treatment recommendations. "
    "Confirm current availability and eligibility with the treating oncologist and trial site."
)
TRUNCATED = (
    "The search matched more studies than this tool retrieves. Narrow the condition, terms, or location to see everything relevant."
)
HINT = (
    "No open sites matched. Location matching is exact: use full names such as 'United States' or 'California' "
    "(common abbreviations like USA or CA are expanded automatically), check spelling, or widen the search by "
    "dropping --city or --state, or by using --near LAT,LON with a larger --radius-miles."
)


def criteria(text: Column, full: bool = False) -> Column:
    """The criteria that are shown and scored: cut after PREVIEW characters, with a notice, unless `full`."""
    return F.coalesce(text, F.lit("")) if full else truncate(text, PREVIEW, NOTICE)


def echo(condition: str, terms: str = "", country: str = "", state: str = "", city: str = "", near: tuple[float, float] | None = None, radius_miles: float = 50.0) -> str:
    """The search as JSON."""
    return json.dumps(
        {
            "condition": condition, "terms": terms, "country": country, "state": state, "city": city, "near": list(near) if near else None,
            "radius_miles": radius_miles if near else None, "open_site_statuses": list(OPEN), "status_notes": STATUS_NOTES,
        },
        ensure_ascii=False,
    )


def envelope(results: DataFrame, order: list[Column], search: str, limit: int, truncated: DataFrame | bool = False) -> DataFrame:
    """One row: search, ranking, search_truncated, result_count_before_limit, results (structs, in order, `limit` at most),
    warning, truncation_note and hint (null where they don't apply).

    truncated: whether the source had more than was read, or a table of one row that says so. The count is a sum of its
    own, so that only `limit` rows meet in a task.
    """
    if limit < 0:
        raise ValueError("a limit is 0 or more")
    first = results.orderBy(*order).limit(limit).withColumn("rank_", F.row_number().over(Window.orderBy(*order)))
    columns = [c for c in first.columns if c != "rank_"]
    held = first.agg(F.sort_array(F.collect_list(F.struct("rank_", F.struct(*columns).alias("row")))).alias("x")).select(F.col("x.row").alias("results"))
    counted = results.agg(F.count(F.lit(1)).alias("result_count_before_limit"))
    more = results.sparkSession.range(1).select(F.lit(truncated).alias("truncated")) if isinstance(truncated, bool) else truncated
    d = held.crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(more))  # a row each
    return d.select(
        F.lit(search).alias("search"), F.lit(RANKING).alias("ranking"), F.col("truncated").alias("search_truncated"), "result_count_before_limit", "results",
        F.lit(WARNING).alias("warning"), F.when(F.col("truncated"), F.lit(TRUNCATED)).alias("truncation_note"),
        F.when(F.col("result_count_before_limit") == 0, F.lit(HINT)).alias("hint"),
    )
