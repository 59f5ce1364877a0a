"""Relevance of studies to a search, and stable rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.geo import box, haversine
from heddle.functions.text import any_marker, clean, date_ordinal, tokens

# States of a study or site that take patients.
OPEN = ("RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION")
# Kinds of intervention that count as treatment.
TREATMENTS = [
    "BIOLOGICAL", "COMBINATION_PRODUCT", "DEVICE", "DIETARY_SUPPLEMENT",
    "DRUG", "GENETIC", "PROCEDURE", "RADIATION",
]
# Signs of supportive studies.
SUPPORTIVE = (
    "behavioral", "e-health", "exercise", "fear of", "interview",
    "quality of life", "supportive care", "survey",
)
# Weights of phases; any other weighs 0.
PHASES = {"PHASE3": 5, "PHASE2": 3, "PHASE1": 1, "EARLY_PHASE1": 1}


def phase_priority(phases: Column) -> Column:
    """The largest weight of an array of phases; none: 0."""
    weights = F.create_map(*[F.lit(x) for p in PHASES.items() for x in p])
    return F.coalesce(F.array_max(F.transform(phases, lambda p: F.coalesce(weights[F.upper(clean(p))], F.lit(0)))), F.lit(0))


def relevance(title: Column, interventions: Column, criteria: Column, phases: Column, kinds: Column, status: Column, condition: str, terms: str) -> Column:
    """An integer score of a study's texts against the words of a condition and of further terms."""
    wanted, further = tokens(F.lit(condition)), tokens(F.lit(terms))
    joined = F.array_join(interventions, " ")

    def hits(text: Column, weigh) -> Column:
        """weigh() of the numbers of words of the condition and of the terms in a text, which is taken apart once."""
        return F.transform(F.array(tokens(text)), lambda t: weigh(F.size(F.array_intersect(wanted, t)), F.size(F.array_intersect(further, t))))[0]

    score = hits(title, lambda c, t: 3 * c + 5 * t) + hits(joined, lambda c, t: 2 * c + 3 * t)
    score = score + hits(criteria, lambda c, t: F.least(F.lit(3), c) + 2 * t) + phase_priority(phases)
    score = score + F.when(F.arrays_overlap(F.transform(kinds, lambda k: F.upper(clean(k))), F.array(*map(F.lit, TREATMENTS))), 4).otherwise(0)
    score = score + F.when(status == "RECRUITING", 2).otherwise(0)
    supportive = any_marker(F.lower(F.concat(clean(title), F.lit(" "), joined)), SUPPORTIVE)
    return score - F.when(supportive, 4).otherwise(0)


def rank_order(score: Column, status: Column, phases: Column, updated: Column, position: Column) -> list[Column]:
    """Sort keys: score, recruiting first, phase, latest update, then the source's own order."""
    recruiting = F.when(status == "RECRUITING", 0).otherwise(1)
    return [score.desc(), recruiting.asc(), phase_priority(phases).desc(), date_ordinal(clean(updated)).desc(), position.asc()]


def top(df: DataFrame, order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first rows in an order, with their rank: sorted and cut by TakeOrderedAndProject, then numbered."""
    return df.orderBy(*order).limit(limit).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def is_open(site_status: Column, study_status: Column) -> Column:
    """A site takes patients by its own state, or by its study's where its own is blank."""
    own = F.upper(clean(site_status))
    return F.when(own != "", own.isin(*OPEN)).otherwise(F.upper(study_status).isin(*OPEN))


def matches(actual: Column, wanted: str) -> Column:
    """Equal without regard to case; a blank wish matches anything."""
    return F.lit(True) if not wanted.strip() else F.lower(clean(actual)) == " ".join(wanted.split()).lower()


def within_miles(df: DataFrame, lat: str, lon: str, at: tuple[float, float], miles: float, out: str = "miles") -> DataFrame:
    """Rows whose point is at most so many miles off, with the distance; a row without point fails."""
    near = df.where(box(F.col(lat), F.col(lon), at, miles))
    return near.withColumn(out, haversine(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lon))).where(F.col(out) <= miles)
