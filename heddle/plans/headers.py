"""Headers of image files, from bytes that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import Catalog, table
from heddle.sources import headers as H

CATALOG = Catalog()


def _bytes(number: int, size: int) -> str:
    return number.to_bytes(size, "little").hex()


def _short(n: Column) -> Column:
    """A number below 65,536 in two bytes, the lower first."""
    digits = F.lpad(F.hex(n.cast("long")), 4, "0")
    return F.unhex(F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2)))


def element(tag: int, kind: str, value: Column, explicit: bool, length: int | None = None) -> list[Column]:
    """One element's bytes, in parts: text is padded to an even length. Its stated length may be another than its own."""
    long = kind in H.LONG
    head = _bytes(tag >> 16, 2) + _bytes(tag & 0xFFFF, 2) + (kind.encode().hex() + "0000" * long if explicit else "")
    size = 4 if long or not explicit else 2
    if length is not None:
        return [F.unhex(F.lit(head + _bytes(length, size))), value]
    value = F.when(F.octet_length(value) % 2 == 1, F.concat(value, F.unhex(F.lit("20")))).otherwise(value)
    return [F.unhex(F.lit(head)), _short(F.octet_length(value)), F.unhex(F.lit("0000" if size == 4 else "")), value]


@CATALOG.add(
    "header_fields",
    """SELECT p_partkey, CASE WHEN ok THEN 'i' || p_partkey END AS sop_instance, CASE WHEN ok THEN CASE p_partkey % 3 WHEN 0 THEN 'CT' ELSE 'MR' END END AS modality, CASE WHEN ok THEN p_name END AS series_description,
         CASE WHEN ok THEN p_size + 0.5::DOUBLE END AS slice_thickness, CASE WHEN ok AND p_partkey % 4 > 0 THEN p_size - 20 END AS instance_number, CASE WHEN ok THEN CAST(p_partkey % 60000 AS INTEGER) END AS rows,
         CASE WHEN ok THEN p_size / 4.0::DOUBLE END AS across, CASE WHEN NOT ok THEN 'cut short' END AS error
       FROM (SELECT *, p_partkey % 11 > 0 AS ok FROM part)""",
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part: with or without kinds of values, a list in the middle, stated pixels that never come, and every
    eleventh cut off within an element."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: F.encode(c.cast("string"), "utf-8")

    def file(explicit: bool) -> Column:
        own = lambda name, value: element(H.FIELDS[name][0], H.FIELDS[name][1], value, explicit)
        syntax = text(F.lit("1.2.840.10008.1.2.1" if explicit else H.IMPLICIT))
        begin = [
            F.unhex(F.lit("00" * 128)), text(F.lit("DICM")), *element(H.SYNTAX, "UI", syntax, True), *own("sop_class", text(F.lit("1.2.3"))),
            *own("sop_instance", text(F.concat(F.lit("i"), k.cast("string")))), *own("modality", text(F.when(k % 3 == 0, "CT").otherwise("MR"))), *own("series_description", text(F.col("p_name"))),
        ]
        rest = [
            *element(0x00081110, "SQ", F.unhex(F.lit("feff00e0ffffffff" + "feff0de000000000" + "feffdde000000000")), explicit, H.ENDLESS),
            *own("slice_thickness", text(F.concat(size.cast("string"), F.lit(".5")))), *own("instance_number", text(F.when(k % 4 > 0, (size - 20).cast("string")).otherwise(""))), *own("rows", _short(k % 60000)),
            *own("pixel_spacing", text(F.concat(F.lit("2.5\\"), (size / 4.0).cast("string")))), *element(0x7FE00010, "OW", text(F.lit("never")), explicit, 1 << 30),
        ]
        return F.when(k % 11 > 0, F.concat(*begin, *rest)).otherwise(F.concat(*begin, *element(0x00081110, "LO", text(F.lit("too short")), explicit, 1000)))

    raw = F.when(k % 2 == 0, file(True)).otherwise(file(False))
    names = ["sop_instance", "modality", "series_description", "slice_thickness", "instance_number", "rows", "pixel_spacing", "error"]
    d = H.parsed(table(spark, sf_dir, "part").select(k, raw.alias("raw")), "raw", names)
    return d.withColumn("across", F.get("pixel_spacing", F.lit(1))).drop("pixel_spacing")
