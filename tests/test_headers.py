import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from heddle.sources import headers as H

BIG = {k: v for k, v in H.BINARY.items()}


def el(tag, kind, value, order="<", explicit=True, length=None):
    value = value if isinstance(value, bytes) else value.encode()
    value += b" " * (len(value) % 2)
    length = len(value) if length is None else length
    head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack(order + "I", length) + value
    return head + kind.encode() + (struct.pack(order + "2xI", length) if kind in H.LONG else struct.pack(order + "H", length)) + value


def item(body, endless=False, order="<"):
    return struct.pack(order + "HHI", 0xFFFE, 0xE000, H.ENDLESS if endless else len(body)) + body + (struct.pack(order + "HHI", 0xFFFE, 0xE00D, 0) if endless else b"")


def listed(tag, bodies, endless=False, order="<", explicit=True):
    whole = b"".join(item(b, endless, order) for b in bodies)
    return el(tag, "SQ", whole + (struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0) if endless else b""), order, explicit, H.ENDLESS if endless else None)


def field(name, value, order="<", explicit=True):
    tag, kind, _ = H.FIELDS[name]
    return el(tag, kind, struct.pack(order + BIG[kind], value) if kind in BIG else value, order, explicit)


def body(order="<", explicit=True, endless=False, pixels=4096):
    f = lambda n, v: field(n, v, order, explicit)
    parts = [
        f("image_type", "ORIGINAL\\PRIMARY"), f("sop_class", "1.2.3"), f("sop_instance", "9.8"), f("modality", "CT"),
        listed(0x00081110, [f("rows", 77)], endless, order, explicit), f("slice_thickness", "1.5"), f("instance_number", "7"),
        f("position", "1\\2\\-3.5"), f("rows", 512), f("columns", 256), f("pixel_spacing", "0.5\\0.25"),
        el(0x7FE00010, "OW", b"\0" * pixels, order, explicit),
    ]
    return b"".join(parts)


def whole(syntax="1.2.840.10008.1.2.1", **how):
    return b"\0" * 128 + b"DICM" + el(0x00020000, "UL", struct.pack("<I", 20)) + el(H.SYNTAX, "UI", syntax + "\0" * (len(syntax) % 2)) + body(**how)


def read(raw, wanted=None, equal=None):
    return H.header(io.BytesIO(raw), len(raw), set(wanted or H.SCHEMA.names), equal)


@pytest.mark.parametrize("endless", [False, True])
@pytest.mark.parametrize("syntax, order, explicit", [("1.2.840.10008.1.2.1", "<", True), (H.IMPLICIT, "<", False), (H.BIG, ">", True)])
def test_every_form_reads_alike(syntax, order, explicit, endless):
    got = read(whole(syntax, order=order, explicit=explicit, endless=endless))
    assert (got["image_type"], got["modality"], got["instance_number"], got["rows"], got["columns"]) == (["ORIGINAL", "PRIMARY"], "CT", 7, 512, 256)
    assert (got["position"], got["pixel_spacing"], got["slice_thickness"], got["kvp"], got.get("error")) == ([1.0, 2.0, -3.5], [0.5, 0.25], 1.5, None, None)


def test_deflated_and_plain_elements():
    raw = whole()
    at = len(raw) - len(body())
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    head = b"\0" * 128 + b"DICM" + el(H.SYNTAX, "UI", H.DEFLATED)
    assert read(head + pack.compress(raw[at:]) + pack.flush())["rows"] == 512
    assert read(body())["rows"] == 512 and read(body(explicit=False))["rows"] == 512


def test_what_cannot_be_read_is_told():
    assert read(whole()[:190])["error"] == "cut short" and read(b"")["error"] and read(b"\1\2\3")["error"]
    assert read(el(0x00100010, "PN", "x"))["error"] == "not an image file"
    assert read(field("sop_class", H.DIRECTORY) + body()) is None
    deep = b""
    for _ in range(40):
        deep = listed(0x00081110, [deep], endless=True)
    assert read(field("sop_class", "1") + deep + field("rows", 1))["error"] == "lists too deep"


def test_odd_values_are_null():
    raw = field("sop_class", "1") + field("slice_thickness", "1\\2") + field("kvp", "x") + field("instance_number", "99999999999") + field("rows", 1)
    got = read(raw)
    assert [got[c] for c in ("slice_thickness", "kvp", "instance_number", "rows", "frames")] == [None, None, None, 1, None]


def test_frames_take_their_own_values_then_the_shared():
    shared = listed(0x00289110, [field("pixel_spacing", "2\\3")]) + listed(H.TURN, [field("orientation", "1\\0\\0\\0\\1\\0")]) + listed(H.SCALE, [field("slope", "2") + field("intercept", "-5")])
    each = [listed(H.PLACE, [field("position", f"0\\0\\{z}")]) + (listed(H.SCALE, [field("slope", "3")]) if z else b"") for z in range(3)]
    for endless in (False, True):
        raw = field("sop_class", "1") + field("frames", "3") + field("rows", 9) + listed(H.SHARED, [shared], endless) + listed(H.EACH, each, endless)
        got = read(raw)
        assert got["pixel_spacing"] == [2.0, 3.0] and got["slope"] == 2.0
        assert [(f["position"][2], f["orientation"][0], f["slope"], f["intercept"]) for f in got["frame_values"]] == [(0.0, 1.0, 2.0, -5.0), (1.0, 1.0, 3.0, -5.0), (2.0, 1.0, 3.0, -5.0)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("series")
    (at / "a").mkdir()
    for name, raw in {"a/1": whole(pixels=1 << 20), "a/2.dcm": whole(pixels=1 << 20).replace(b"9.8 ", b"9.7 "), "a/3": whole()[:190], "4.txt": b"x", "DICOMDIR": whole(), "5": whole().replace(b"CT", b"MR")}.items():
        (at / name).write_bytes(raw)
    return at


def test_a_folder(spark, folder):
    d = H.headers(spark, str(folder), files=2)
    got = {r.path[len(str(folder)) + 1 :]: r for r in d.collect()}
    assert set(got) == {"a/1", "a/2.dcm", "a/3", "5"} and got["a/3"].error == "cut short" and got["a/1"].rows == 512
    assert max(r.bytes_read for r in got.values()) <= 2 * H.BLOCK  # a megabyte of pixels each isn't read
    kept = H.records(d).collect()
    assert sorted((r.sop_instance, r.path[len(str(folder)) + 1 :], r.slope, r.frames, r.series) for r in kept) == [("9.7", "a/2.dcm", 1.0, 1, "sin-uid--CT"), ("9.8", "5", 1.0, 1, "sin-uid--MR")]


def test_fewer_columns_and_filters_read_less(spark, folder, tmp_path):
    long = b"".join([field("sop_class", "1"), field("modality", "CT"), *[el(0x00190000 + i, "OB", b"x" * 60_000) for i in range(20)], field("rows", 5), listed(0x00289999, [b""])])
    (tmp_path / "x").write_bytes(long)
    full = H.headers(spark, str(tmp_path), ["modality", "rows", "bytes_read"]).first()
    few = H.headers(spark, str(tmp_path), ["modality", "bytes_read"]).first()
    assert full.rows == 5 and few.modality == "CT" and few.bytes_read <= H.BLOCK < full.bytes_read
    d = H.headers(spark, str(folder))
    assert [r.path.rsplit("/", 1)[1] for r in d.where("modality = 'MR'").collect()] == ["5"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in d.where(F.col("path").startswith(f"{folder}/a")).select("path").collect()) == ["1", "2.dcm", "3"]
    assert d.where((F.col("rows") == 512) & (F.col("modality") == "CT")).count() == 2
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("heddle_headers").schema("path string, colour int").load(str(folder)).collect()


def test_an_archive(spark, folder, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.write(folder / "a/1", "in/1")
        z.write(folder / "a/3", "in/3")
        z.writestr("in/readme.txt", "x")
    got = {r.path: r for r in H.headers(spark, str(tmp_path / "s.zip"), ["rows", "error"], files=1).collect()}
    assert {k: (r.rows, r.error) for k, r in got.items()} == {"in/1": (512, None), "in/3": (None, "cut short")}


def test_bytes_in_a_column(spark):
    d = spark.createDataFrame([(1, bytearray(whole())), (2, None), (3, bytearray(b"?"))], "id int, raw binary")
    got = {r.id: (r.rows, r.error) for r in H.parsed(d, "raw", ["rows", "error"]).collect()}
    assert got == {1: (512, None), 2: (None, "no bytes"), 3: (None, "cut short")}
    assert H.parsed(d.where("id > 9"), "raw").count() == 0
    with pytest.raises(ValueError, match="rows"):
        H.parsed(d.withColumn("rows", F.lit(1)), "raw")
