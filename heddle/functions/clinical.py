"""Lookup tables of laboratory values, as bucketing expressions. A missing value stays missing, never normal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower ends of ranges with the label from there on.
KIDNEY = [(float("-inf"), "G5"), (15, "G4"), (30, "G3b"), (45, "G3a"), (60, "G2"), (90, "G1")]
GLUCOSE = [(float("-inf"), "low"), (70, "normal"), (100, "prediabetes"), (126, "diabetes")]
A1C = [(float("-inf"), "normal"), (5.7, "prediabetes"), (6.5, "diabetes")]
LDL = [(float("-inf"), "optimal"), (100, "near optimal"), (130, "borderline"), (160, "high")]
TRIGLYCERIDES = [(float("-inf"), "optimal"), (150, "borderline"), (200, "high")]
CHOLESTEROL = [(float("-inf"), "optimal"), (200, "borderline"), (240, "high")]
PLATELETS = [(float("-inf"), "critical"), (20, "bleeding"), (50, "significant"), (100, "mild"), (150, "normal")]
TRANSAMINASE = [(float("-inf"), "normal"), (40, "mild"), (100, "moderate")]
VITAMIN_D = [(float("-inf"), "deficient"), (20, "insufficient"), (30, "sufficient")]
B12 = [(float("-inf"), "deficient"), (200, "borderline")]
ANAEMIA = {"M": [(float("-inf"), "severe"), (8, "moderate"), (11, "mild"), (13.5, "normal")], "F": [(float("-inf"), "severe"), (8, "moderate"), (10, "mild"), (12, "normal")]}
AGES = [(0, "child"), (12, "adolescent"), (18, "young adult"), (40, "middle"), (65, "early elderly"), (75, "late elderly")]
PSA = [(40, 2.5), (50, 3.5), (60, 4.5), (70, 6.5)]


def bucket(c: Column, table: list[tuple[float, str]]) -> Column:
    """The label of the last lower end that isn't over the value."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(None).cast("string"))
    for low, name in reversed(table):
        out = out.otherwise(F.lit(name)) if low == float("-inf") else out.when(c >= low, name)
    return out


def above(c: Column, table: list[tuple[float, str]], top: float, name: str) -> Column:
    """bucket(), but strictly over `top` another label."""
    return F.when(c > top, name).otherwise(bucket(c, table))


def albuminuria(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(c < 30, "A1").when(c <= 300, "A2").otherwise("A3")


def mcv(c: Column) -> Column:
    return F.when(c < 80, "microcytic").when(c <= 100, "normocytic").when(c > 100, "macrocytic")


def leukocytes(c: Column) -> Column:
    """From 4 to 4.5 the table has no label: unclassified."""
    return F.when(c < 4, "leukopenia").when(c < 4.5, "unclassified").when(c <= 11, "normal").when(c > 11, "leukocytosis")


def anaemia(c: Column, sex: Column) -> Column:
    return F.when(sex == "M", bucket(c, ANAEMIA["M"])).when(sex == "F", bucket(c, ANAEMIA["F"]))


def psa_limit(age: Column) -> Column:
    out = F.when(age < 40, F.lit(None).cast("double"))
    for low, limit in reversed(PSA):
        out = out.when(age >= low, limit)
    return out


def esr_limit(age: Column, sex: Column) -> Column:
    return F.when(sex == "M", age / 2).when(sex == "F", (age + 10) / 2)


def tsh(c: Column, age: Column) -> Column:
    """Over 70 up to 6 counts as normal."""
    return F.when(c < 0.4, "suppressed").when(c <= F.when(age > 70, 6.0).otherwise(4.0), "normal").when(c.isNotNull(), "elevated")


def text_range(c: Column) -> tuple[Column, Column]:
    """The ends of a printed range: '70 - 100', '< 5.7' or '> 40'."""
    low = F.when(c.rlike(r"^\s*>"), F.regexp_extract(c, r">\s*([\d.]+)", 1)).otherwise(F.regexp_extract(c, r"^\s*([\d.]+)\s*-", 1))
    high = F.when(c.rlike(r"^\s*<"), F.regexp_extract(c, r"<\s*([\d.]+)", 1)).otherwise(F.regexp_extract(c, r"-\s*([\d.]+)", 1))
    return low.try_cast("double"), high.try_cast("double")


def flag(value: Column, reference: Column) -> Column:
    """low, high or normal against a printed range; '<' and '>' ends are strict."""
    low, high = text_range(reference)
    over = F.when(reference.rlike(r"^\s*<"), value >= high).otherwise(value > high)
    under = F.when(reference.rlike(r"^\s*>"), value <= low).otherwise(value < low)
    return F.when(value.isNull(), F.lit(None)).when(F.coalesce(over, F.lit(False)), "high").when(F.coalesce(under, F.lit(False)), "low").otherwise("normal")


# Tone of a report by age bracket, and the form of address.
TONES = [(0, "with a parent", "first name"), (12, "direct", "first name, tú"), (18, "peer-like", "first name, tú"), (40, "practical", "tú or usted"), (65, "respectful", "usted"), (75, "warm", "usted, Don/Doña")]
# Goals of HbA1c under treatment from an age on.
A1C_GOALS = [(18, "<7"), (65, "<7-7.5"), (75, "<7.5-8")]


def a1c_goal(age: Column, frail: Column) -> Column:
    """The goal of HbA1c for a patient with diabetes; frail elderly (65 on) have their own; children none."""
    out = F.when(frail & (age >= 65), "<8.5")
    for low, goal in reversed(A1C_GOALS):
        out = out.when(age >= low, goal)
    return out


def hdl(c: Column, sex: Column) -> Column:
    """Low under 40 (men) or 50 (women), borderline under 60, else high. The source's rows overlap: its borderline row is
    read as the lower part of its optimal one."""
    low = F.when(sex == "M", 40).when(sex == "F", 50)
    return F.when(c < low, "low").when((c >= low) & (c < 60), "borderline").when(c >= F.greatest(low, F.lit(60)), "high")


def uric_acid(c: Column, sex: Column) -> Column:
    low, high = F.when(sex == "M", 3.4).when(sex == "F", 2.4), F.when(sex == "M", 7.0).when(sex == "F", 6.0)
    return F.when(c < low, "low").when(c > high, "high").when(c.between(low, high), "normal")


def tone(age: Column) -> tuple[Column, Column]:
    """Tone and form of address of a report to a patient."""
    return tuple(bucket(age, [(r[0], r[i]) for r in TONES]) for i in (1, 2))


def egfr(creatinine: Column, age: Column, sex: Column) -> Column:
    """CKD-EPI 2021, ml/min/1.73 m2; approximate."""
    woman = sex == "F"
    ratio = creatinine / F.when(woman, 0.7).otherwise(0.9)
    small = F.pow(F.least(ratio, F.lit(1.0)), F.when(woman, -0.241).otherwise(-0.302))
    return 142 * small * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age) * F.when(woman, 1.012).otherwise(1.0)
