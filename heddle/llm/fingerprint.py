"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

A text's terms are its five-word shingles (fewer words: the whole sequence), weighted by how often they occur. For each
term and sample, two hashes give r and c, each Gamma(2, 1), and b, uniform on [0, 1). With t = floor(ln w / r + b) the
term competes with a = c exp(-r (t + 1 - b)), and the sample is the (term, t) of the smallest a. Two texts agree on a
sample with a probability equal to the generalised Jaccard similarity of their term weights.

A sample is one long: ln a, fixed point, in its upper half and a hash of (term, t) in its lower, so that the smallest is
found by a plain min() that combines before any exchange. Documents are dealt once, by ranges of their id; a range
also gets the first document of the next, so every later step (the next document's text, counts, minima, likeness)
stays where the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import SPACE, Work, partitions, ranked, table

SAMPLES, SHINGLE = 32, 5
#: Ranges of ids, at most; their bounds are collected, and looked up in two steps of FAN at most.
RANGES, FAN = 1 << 16, 1 << 8
_STEP = float(1 << 21)


def shingles(df: DataFrame, text: str, n: int = SHINGLE) -> DataFrame:
    """df without `text`, with a row for each run of n words and its hash in `term`; of fewer words, one run filled up
    with empty strings. Each step is a projection of its own, so the text is split once."""
    keep = [c for c in df.columns if c != text]
    words = df.select(*keep, F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), SPACE).alias("__w"))
    words = words.select(*keep, F.when(F.size("__w") >= n, F.col("__w")).otherwise(F.concat("__w", F.array_repeat(F.lit(""), F.lit(n)))).alias("__w"), F.greatest(F.size("__w") - (n - 1), F.lit(1)).alias("__n"))
    runs = F.arrays_zip(*[F.slice("__w", F.lit(i + 1), F.col("__n")).alias(f"w{i}") for i in range(n)])
    return words.select(*keep, F.explode(runs).alias("__s")).select(*keep, F.xxhash64(*[f"__s.w{i}" for i in range(n)]).alias("term"))


def _draws() -> dict[str, Column]:
    """r, ln c, b and a name of sample k of term."""
    one, two = F.xxhash64("term", F.col("k") * 2), F.xxhash64("term", F.col("k") * 2 + 1)
    bits = lambda h, at: (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 21) - 1).cast("long")).cast("double") + 0.5) / _STEP
    return {"r": -F.log(bits(one, 43) * bits(one, 22)), "c": F.log(-F.log(bits(one, 0) * bits(two, 43))), "b": bits(two, 22), "name": two}


def _sample() -> Column:
    """The competitor of a term with the logarithm of its weight in `w`: ln a above, the hash of (term, t) below."""
    t = F.col("t")
    value = F.floor((F.col("c") - F.col("r") * (t.cast("double") + 1.0 - F.col("b")) + 100.0) * 16777216.0)
    return F.shiftleft(value, 32).bitwiseOR(F.col("name").bitwiseXOR(t * F.lit(0x9E3779B1).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def samples_of(weights: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """weights: keys, term, n0, n1. Returns keys, own and new: the samples under the weights n0 and n1, in order; null
    where all weights are 0. A term that both sides weigh alike is drawn once."""
    side = lambda n, m: F.struct(F.col(n).alias("n"), F.lit(m).alias("m"))
    sides = F.when(F.col("n1") == 0, F.array(side("n0", 1))).when(F.col("n0") == 0, F.array(side("n1", 2))).when(F.col("n0") == F.col("n1"), F.array(side("n0", 3))).otherwise(F.array(side("n0", 1), side("n1", 2)))
    rows = weights.select(*keys, "term", F.explode(sides).alias("x")).select(*keys, "term", F.log(F.col("x.n").cast("double")).alias("w"), F.col("x.m").alias("m"))
    rows = rows.select(*keys, "term", "w", "m", F.explode(F.array(*[F.lit(k) for k in range(samples)])).alias("k"))
    drawn = rows.select(*keys, "w", "m", "k", *[c.alias(n) for n, c in _draws().items()])
    drawn = drawn.select(*keys, "m", "k", "r", "c", "b", "name", F.floor(F.col("w") / F.col("r") + F.col("b")).alias("t")).select(*keys, "m", "k", _sample().alias("v"))
    least = [F.min(F.when(F.col("m").bitwiseAND(F.lit(i)) != 0, F.col("v"))).alias(n) for i, n in ((1, "own"), (2, "new"))]
    found = drawn.groupBy(*keys, "k").agg(*least)
    held = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "own", "new"))).alias("all"))
    return held.select(*keys, F.col("all.own").alias("own"), F.col("all.new").alias("new"))


def _alike(one: str | Column, two: str | Column) -> Column:
    """The share of equal samples."""
    same = F.zip_with(one, two, lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda x, y: x + y) / F.size(one).cast("double")


def _text(samples: str) -> Column:
    low = lambda s: F.lower(F.lpad(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))
    return F.array_join(F.transform(samples, low), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has the last floor(n_chars / 2) characters replaced by as many of the next document in order of
    doc_id (after the last: the first; a lone document is its own next). Null texts count as empty; an empty text has
    one term, the empty one. Null ids come last, and rows that repeat an id follow each other in order of text. Other
    columns aren't read; an empty table gives an empty one.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession, "fingerprint")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("doc_id is null or n > 1").isEmpty():
        d = d.withColumn("id", F.col("doc_id"))
    else:  # numbers in order, dealt by (doc_id, text, place), so that a frequent id or document falls in many ranges
        d = ranked(work, d.withColumn("place", F.monotonically_increasing_id()), [], ["doc_id", "text", "place"], "id").drop("place")
        d = work.save(d, "numbered")
    n = min(RANGES, 8 * partitions(spark))
    row = d.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("cuts"), F.min("id").alias("low")).first()
    low, cuts = row["low"], sorted({c for c in (row["cuts"] or []) if c != row["low"]})
    step = max(1, -(-len(cuts) // FAN))
    coarse, fine = (F.from_json(F.lit(str(x)), t) for x, t in ((cuts[::step], "array<bigint>"), ([cuts[i : i + step] for i in range(0, len(cuts), step)], "array<array<bigint>>")))
    below = lambda held: F.size(F.filter(held, lambda c: c <= F.col("id")))
    d = d.withColumn("block", below(coarse))
    own = F.when(F.col("block") > 0, F.element_at(fine, F.col("block")))
    place = F.when(F.col("block") == 0, F.lit(0)).otherwise((F.col("block") - 1) * step + below(own))
    # the first document of a range closes the range before it, and the first of all closes the last
    closes = F.when(F.col("id") == F.lit(low), F.lit(len(cuts))).when(F.array_contains(own, F.col("id")), F.col("range") - 1)
    both = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("tail")), F.struct(closes.alias("range"), F.lit(1).alias("tail")))
    dealt = d.withColumn("range", place).select("doc_id", "id", "text", F.explode(both).alias("to")).select("doc_id", "id", "text", "to.range", "to.tail").where("range is not null")
    order = Window.partitionBy("range").orderBy("tail", "id", "doc_id")  # doc_id only so that both uses below share one exchange
    rows = dealt.repartition(n, "range").withColumn("after", F.lead("text").over(order)).withColumn("row", F.row_number().over(order))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.when(F.col("tail") == 0, F.concat(F.substring("text", F.lit(1), size - half), F.substring(F.coalesce("after", F.lit("")), F.lit(1), half)))
    rows = rows.withColumn("edited", edited)
    meta = rows.select("range", "row", "tail", "doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    texts = rows.select("range", "row", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"))
    texts = texts.select("range", "row", "x.v", "x.t").where("t is not null")
    weights = shingles(texts, "t").groupBy("range", "row", "term").agg(F.sum(1 - F.col("v")).alias("n0"), F.sum("v").alias("n1"))
    out = meta.join(samples_of(weights, ["range", "row"], samples), ["range", "row"])
    follow = Window.partitionBy("range").orderBy("row")
    out = out.withColumn("after", F.lead("own").over(follow)).where("tail = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", _text("own").alias("fingerprint"), _text("new").alias("edited_fingerprint"), _alike("own", "new").alias("near_edited"), _alike("own", "after").alias("near_next"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
