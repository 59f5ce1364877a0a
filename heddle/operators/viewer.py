"""Volumes from slices, crops, and what a viewer's settings must satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def load_volume(slices: DataFrame, key: str, order: str, pos: str, value: str, step: float, low: int = -32768, high: int = 32767) -> DataFrame:
    """Slices at even positions: key, k (from 0), value, clipped.

    Of the slices at one position the first in `order` stays, of several the one with the smallest value. Positions are the first slice's plus k steps, up to the
    last's; a value between two slices is interpolated, then rounded (halves to even) and cut to low..high, and `clipped`
    says whether it had to be. Null positions take no part; a key with one position has one slice.
    """
    one = slices.where(F.col(pos).isNotNull()).groupBy(key, pos).agg(F.min(F.struct(order, value)).getField(value).alias("a"))
    series = Window.partitionBy(key)
    one = one.select(
        key, F.col(pos).alias("p"), "a", F.lead(pos).over(series.orderBy(pos)).alias("q"), F.lead("a").over(series.orderBy(pos)).alias("b"),
        F.min(pos).over(series).alias("first"),
    )
    begin = F.ceil((F.col("p") - F.col("first")) / step - 1e-6)
    # the places from this slice to before the next; after the last slice its own place alone
    end = F.when(F.col("q").isNull(), F.floor((F.col("p") - F.col("first")) / step + 1e-6)).otherwise(F.ceil((F.col("q") - F.col("first")) / step - 1e-6) - 1)
    placed = one.where(begin <= end).withColumn("k", F.explode(F.sequence(begin, end)))
    share = F.when(F.col("q").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.col("first") + F.col("k") * step - F.col("p")) / (F.col("q") - F.col("p"))))
    v = F.bround(F.when(share == 0, F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b")), 0)
    return placed.select(key, F.col("k").cast("long").alias("k"), v.alias("v")).select(
        key, "k", F.least(F.greatest("v", F.lit(low)), F.lit(high)).cast("int").alias("value"), ((F.col("v") < low) | (F.col("v") > high)).alias("clipped")
    )


def crop(low: Column, high: Column, auto: Column, auto_low: Column, auto_high: Column, size: Column, factor: Column) -> tuple[Column, Column, Column]:
    """Begin, end and error of a crop along one axis: a bound that is given, else the automatic one where `auto`, else the
    whole axis; cut to the axis, and shortened to a multiple of the factor."""
    begin = F.greatest(F.coalesce(low, F.when(auto, auto_low), F.lit(0)), F.lit(0))
    end = F.least(F.coalesce(high, F.when(auto, auto_high), size), size)
    length = F.floor((end - begin) / factor) * factor
    return begin.cast("long"), (begin + length).cast("long"), F.when(length <= 0, "empty crop")


def broken(rows: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks: the kept columns and `rule`. A rule that is null isn't broken."""
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())
    return rows.select(*keep, F.explode(found).alias("rule"))


def mode_violations(modes: DataFrame, views: DataFrame, sequences: DataFrame, options: DataFrame) -> DataFrame:
    """mode_id, place, rule. modes: place, mode_id, label, view, module, lumen, wall, sequence, option, phase; the others
    have an `id` each, different in every row. Unknown names are looked up by joins, and only what a module needs counts."""
    same = Window.partitionBy("mode_id").orderBy("place")
    d = modes.withColumn("repeat", F.row_number().over(same) > 1)
    for name, known in (("view", views), ("sequence", sequences), ("option", options)):
        d = d.join(known.select(F.col("id").alias(name), F.lit(True).alias(f"known_{name}")), name, "left")
    known = lambda c: F.coalesce(F.col(f"known_{c}"), F.lit(False))
    module = F.coalesce(F.col("module"), F.lit(""))
    return broken(d, ["mode_id", "place"], {
        "repeated id": F.col("repeat"),
        "no label": F.col("label").isNull(),
        "unknown view": F.col("view").isNotNull() & ~known("view"),
        "unknown module": ~module.isin("", "normal", "etapas", "reseccion"),
        "lumen and wall needed": (module == "normal") & (F.col("lumen").isNull() | F.col("wall").isNull()),
        "unknown sequence": (module == "etapas") & ~known("sequence"),
        "unknown option": (module == "reseccion") & ~known("option"),
        "unknown phase": (module == "reseccion") & ~F.coalesce("phase", F.lit("saca")).isin("saca", "queda"),
    })


def step_violations(steps: DataFrame, keep: list[str]) -> DataFrame:
    """keep and rule. steps: caption, kind, factor, scaled (it scales structures), lumen and wall (arrays, one value for
    each point of the span), first and last (the span). A step of kind `escala` needs its factor alone; others need lumen
    and wall, together and as long as the span, or a scale."""
    lumen, wall, only = F.col("lumen").isNotNull(), F.col("wall").isNotNull(), F.coalesce(F.col("kind") == "escala", F.lit(False))
    span, open_end = F.col("last") - F.col("first") + 1, F.col("first").isNull() | F.col("last").isNull()
    return broken(steps, keep, {
        "no caption": F.col("caption").isNull(),
        "factor too small": only & (F.coalesce("factor", F.lit(0.0)) < 0.01),
        "lumen and wall go together": ~only & (lumen != wall),
        "no span": ~only & lumen & open_end,
        "lumen isn't as long as the span": ~only & lumen & (F.size("lumen") != span),
        "wall isn't as long as the span": ~only & lumen & wall & (F.size("wall") != span),
        "nothing to do": ~only & ~lumen & ~F.coalesce("scaled", F.lit(False)),
    })


def block_lines(docs: DataFrame, key: str, blocks: str) -> DataFrame:
    """key, place (two numbers), depth, kind, text: the lines of blocks (kind, text, children with kind and text), each
    block's own before its children's. A block without children is one line; null or empty blocks give none."""
    top = docs.select(key, F.posexplode(blocks).alias("i", "b"))
    own = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).alias("depth"), F.col("b.kind").alias("kind"), F.col("b.text").alias("text")))
    below = F.transform(F.coalesce("b.children", F.array()), lambda c, j: F.struct((j + 1).alias("j"), F.lit(1).alias("depth"), c.kind.alias("kind"), c.text.alias("text")))
    return top.select(key, "i", F.explode(F.concat(own, below)).alias("l")).select(key, F.array(F.col("i"), F.col("l.j")).alias("place"), "l.depth", "l.kind", "l.text")


#: The subjects of a shift's account, and the signs that come first, by the words that name them.
SUBJECTS = {
    "vital signs": "blood pressure|pulse|temperature|glucose|saturation",
    "feeding": "breakfast|lunch|dinner|ate|meal|tolerance",
    "fluids and output": "drank|iv fluids|urine|stool|vomit",
    "procedures": "catheter|blood draw|puncture|wound|imaging",
    "medications": "medication|chemotherapy|dose",
    "doctor visits": "doctor|specialist|nutritionist",
    "condition": "pain|slept|mood|oriented|mobility|fall",
    "documents": "handed over|received|record",
}
SIGNS = {
    "fever": "fever",
    "vomiting": "persistent vomiting|bloody vomit",
    "black stools": "black stool",
    "bleeding": "bleeding",
    "new severe pain": "severe pain",
    "new confusion": "confus",
    "fall": "\\ba fall\\b|\\bfell\\b",
    "shortness of breath": "short(ness)? of breath",
    "no urine": "no urine",
    "nothing eaten": "ate nothing|eating nothing",
    "catheter site": "(redness|pain) at the catheter",
}


def shift_record(accounts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, signs (array), and the sentences that name each subject, joined: null where the account doesn't mention it,
    which isn't "normal". Accounts with warning signs are to be shown first: `first` is true."""
    sentences = accounts.withColumn("__s", F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?<=[.!?])\s+|\n"))
    said = lambda pattern: F.filter("__s", lambda s: s.rlike(pattern))
    signs = F.filter(F.array(*[F.when(F.size(said(p)) > 0, F.lit(n)) for n, p in SIGNS.items()]), lambda s: s.isNotNull())
    subject = [F.when(F.size(said(p)) > 0, F.array_join(said(p), " ")).alias(n.replace(" ", "_")) for n, p in SUBJECTS.items()]
    return sentences.select(*keep, signs.alias("signs"), (F.size(signs) > 0).alias("first"), *subject)

