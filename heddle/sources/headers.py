"""Headers of tag-length-value image files, without their pixels: a batch source over folders and zip archives, and the same
reading of bytes that are already in a column."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

from heddle.sources.files import SKIPPED

# Fixed values of the file format: column, group and element, kind of value, whether it has several parts.
FIELDS = {
    "image_type": (0x00080008, "CS", True), "sop_class": (0x00080016, "UI", False), "sop_instance": (0x00080018, "UI", False),
    "series_time": (0x00080031, "TM", False), "acquisition_time": (0x00080032, "TM", False), "content_time": (0x00080033, "TM", False),
    "modality": (0x00080060, "CS", False), "series_description": (0x0008103E, "LO", False), "contrast_agent": (0x00180010, "LO", False),
    "body_part": (0x00180015, "CS", False), "scanning_sequence": (0x00180020, "CS", False), "sequence_variant": (0x00180021, "CS", False),
    "sequence_name": (0x00180024, "SH", False), "slice_thickness": (0x00180050, "DS", False), "kvp": (0x00180060, "DS", False),
    "repetition_time": (0x00180080, "DS", False), "echo_time": (0x00180081, "DS", False), "inversion_time": (0x00180082, "DS", False),
    "echo_number": (0x00180086, "IS", False), "field_strength": (0x00180087, "DS", False), "slice_spacing": (0x00180088, "DS", False),
    "protocol": (0x00181030, "LO", False), "contrast_route": (0x00181040, "LO", False), "gantry_tilt": (0x00181120, "DS", False),
    "kernel": (0x00181210, "SH", False), "flip_angle": (0x00181314, "DS", False), "patient_position": (0x00185100, "CS", False),
    "pulse_sequence_name": (0x00189005, "SH", False), "echo_pulse_sequence": (0x00189008, "CS", False), "inversion_times": (0x00189079, "FD", True),
    "effective_echo_time": (0x00189082, "FD", False), "b_value": (0x00189087, "FD", False), "series": (0x0020000E, "UI", False),
    "series_number": (0x00200011, "IS", False), "acquisition_number": (0x00200012, "IS", False), "instance_number": (0x00200013, "IS", False),
    "position": (0x00200032, "DS", True), "orientation": (0x00200037, "DS", True), "temporal_position": (0x00200100, "IS", False),
    "samples": (0x00280002, "US", False), "frames": (0x00280008, "IS", False), "rows": (0x00280010, "US", False), "columns": (0x00280011, "US", False),
    "pixel_spacing": (0x00280030, "DS", True), "intercept": (0x00281052, "DS", False), "slope": (0x00281053, "DS", False),
}
# Fields that a file of many frames may keep in its groups, shared by all frames or one for each.
GROUPED = {
    "pixel_spacing", "slice_thickness", "slice_spacing", "orientation", "slope", "intercept", "scanning_sequence", "echo_pulse_sequence", "sequence_variant",
    "sequence_name", "pulse_sequence_name", "echo_time", "effective_echo_time", "repetition_time", "inversion_time", "inversion_times", "field_strength", "flip_angle", "b_value",
}
SHARED, EACH, CHARSET, SYNTAX, PIXELS, ITEM, ITEM_END, LIST_END = 0x52009229, 0x52009230, 0x00080005, 0x00020010, 0x7FE00008, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
PLACE, TURN, SCALE = 0x00209113, 0x00209116, 0x00289145
IMPLICIT, BIG, DEFLATED, DIRECTORY = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.3.10"
LONG, BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}, {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}
ENDLESS, DEEPEST, BLOCK = 0xFFFFFFFF, 32, 4096

DOUBLES = T.ArrayType(T.DoubleType())
FRAME = T.StructType().add("position", DOUBLES).add("orientation", DOUBLES).add("slope", "double").add("intercept", "double")


def _type(kind: str, many: bool) -> T.DataType:
    one = T.DoubleType() if kind in ("DS", "FD") else T.IntegerType() if kind in ("IS", "US") else T.StringType()
    return T.ArrayType(one) if many else one


SCHEMA = T.StructType([T.StructField(name, _type(kind, many)) for name, (_, kind, many) in FIELDS.items()])
SCHEMA = SCHEMA.add("frame_values", T.ArrayType(FRAME)).add("error", "string").add("bytes_read", "long")


class _Bytes:
    """A file that is read in blocks and skipped by seeking; `fetched` bytes were read."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.held, self.start, self.fetched = f, size, 0, b"", 0, 0

    def take(self, n: int) -> bytes:
        begin = self.at - self.start
        if not 0 <= begin <= begin + n <= len(self.held):
            if self.at + n > self.size:
                raise ValueError("cut short")
            self.f.seek(self.at)
            self.held, self.start, begin = self.f.read(max(n, BLOCK)), self.at, 0
            self.fetched += len(self.held)
            if len(self.held) < n:
                raise ValueError("cut short")
        self.at += n
        return self.held[begin : begin + n]

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise ValueError("cut short")
        self.at += n


class _Reader:
    def __init__(self, src: _Bytes, order: str, explicit: bool):
        self.src, self.order, self.explicit = src, order, explicit

    def tag(self) -> int:
        group, element = struct.unpack(self.order + "HH", self.src.take(4))
        return group << 16 | element

    def head(self, tag: int) -> tuple[str, int]:
        """The kind and length of an element; items and files without kinds have a length alone."""
        if not self.explicit or tag >> 16 == 0xFFFE:
            return "", struct.unpack(self.order + "I", self.src.take(4))[0]
        kind = self.src.take(2).decode("latin-1")
        if not (kind.isalpha() and kind.isupper()):
            raise ValueError("no kind of value")
        if kind in LONG:
            return kind, struct.unpack(self.order + "2xI", self.src.take(6))[0]
        return kind, struct.unpack(self.order + "H", self.src.take(2))[0]

    def items(self, length: int, keep: bool, depth: int = 0) -> list[dict]:
        """A list's items; those that aren't kept are walked over."""
        if depth > DEEPEST:
            raise ValueError("lists too deep")
        if length != ENDLESS and not keep:
            self.src.skip(length)
            return []
        end, found = self.src.at + length, []
        while length == ENDLESS or self.src.at < end:
            tag = self.tag()
            _, size = self.head(tag)
            if tag == LIST_END:
                break
            if tag != ITEM:
                raise ValueError("no item in a list")
            if size != ENDLESS and not keep:
                self.src.skip(size)
            else:
                found.append(self.item(size, keep, depth + 1))
        return found

    def item(self, length: int, keep: bool, depth: int) -> dict:
        end, found = self.src.at + length, {}
        while length == ENDLESS or self.src.at < end:
            tag = self.tag()
            kind, size = self.head(tag)
            if tag == ITEM_END:
                break
            if kind == "SQ" or size == ENDLESS or not kind and tag in (PLACE, TURN, SCALE):
                found[tag] = self.items(size, keep, depth)
            elif not kind and keep and size >= 8 and tag not in TAGS and self._is_list(size):
                found[tag] = self.items(size, keep, depth)
            elif keep:
                found[tag] = kind, self.src.take(size)
            else:
                self.src.skip(size)
        return found

    def _is_list(self, size: int) -> bool:
        """Without kinds, a value that begins with an item is a list."""
        at = self.src.at
        tag = self.tag()
        self.src.at = at
        return tag == ITEM


TAGS = {tag: name for name, (tag, _, _) in FIELDS.items()}


def _value(name: str, kind: str, raw: bytes, order: str, charset: str):
    """A field's value; one of several parts where one is asked for, or one that can't be read, is null."""
    _, own, many = FIELDS[name]
    kind = kind if kind and kind != "UN" else own
    if kind in BINARY:
        code = BINARY[kind]
        parts = [x for (x,) in struct.iter_unpack(order + code, raw[: len(raw) // struct.calcsize(code) * struct.calcsize(code)])]
    else:
        text = raw.decode(charset, "replace").rstrip("\0 ")
        parts = [p.strip() for p in text.split("\\")] if text else []
    try:
        if own in ("DS", "FD"):
            parts = [float(p) for p in parts]
        elif own in ("IS", "US"):
            parts = [int(float(p)) for p in parts]
            if any(abs(p) >= 1 << 31 for p in parts):
                return None
        elif not many:
            return "\\".join(str(p) for p in parts) or None
    except (ValueError, OverflowError):
        return None
    if many:
        return parts or None
    return parts[0] if len(parts) == 1 else None


def _opened(src: _Bytes) -> tuple[_Reader, bool]:
    """A reader at the first element, and whether the file names its own format; others are read as plain elements."""
    if src.size >= 132 and src.take(132)[128:] == b"DICM":
        meta, syntax = _Reader(src, "<", True), ""
        while src.at + 8 <= src.size:
            at = src.at
            tag = meta.tag()
            if tag >> 16 != 2:
                src.at = at
                break
            _, size = meta.head(tag)
            if tag == SYNTAX:
                syntax = src.take(size).decode("latin-1").rstrip("\0 ")
            else:
                src.skip(size)
        if syntax == DEFLATED:
            whole = zlib.decompress(src.take(src.size - src.at), -15)
            inner = _Bytes(io.BytesIO(whole), len(whole))
            inner.fetched = src.fetched
            src = inner
        return _Reader(src, ">" if syntax == BIG else "<", syntax != IMPLICIT), True
    src.at = 0
    kind = src.take(6)[4:]
    src.at = 0
    return _Reader(src, "<", kind.isalpha() and kind.isupper()), False


def header(f, size: int, wanted: set[str], equal: dict | None = None) -> dict | None:
    """The wanted columns of one file. Reading ends after the last wanted element, before the pixels at the latest, or where a
    field isn't as `equal` has it: None then, and for a directory of files. What can't be read has an `error` and nulls."""
    src, equal = _Bytes(f, size), equal or {}
    out: dict = {}
    reader = None
    try:
        reader, named = _opened(src)
        need = {FIELDS[n][0] for n in (wanted | set(equal)) & set(FIELDS)} | {FIELDS["sop_class"][0]}
        grouped = {FIELDS[n][0] for n in wanted & GROUPED}
        if "frame_values" in wanted:
            need.add(FIELDS["frames"][0])
        raw, groups, charset, own = {}, {}, "latin-1", reader.src
        while own.at + 8 <= own.size:
            tag = reader.tag()
            left = (need if named or FIELDS["sop_class"][0] in raw else need | {FIELDS["rows"][0]}) - set(raw)
            late = "frame_values" in wanted or bool(grouped & left)
            if tag >= PIXELS or tag > max(left, default=0) and not (late and tag <= EACH):
                break
            kind, length = reader.head(tag)
            if tag in (SHARED, EACH) and late:
                groups[tag] = reader.items(length, True)
            elif kind == "SQ" or length == ENDLESS:
                reader.items(length, False)
            elif tag in left or tag == CHARSET:
                raw[tag] = kind, own.take(length)
                if tag == CHARSET and b"192" in raw[tag][1]:
                    charset = "utf-8"
                name = TAGS.get(tag)
                if name in equal and _value(name, *raw[tag], reader.order, charset) != equal[name]:
                    return None
            else:
                own.skip(length)
        if not named and not {FIELDS["sop_class"][0], FIELDS["rows"][0]} & set(raw):
            raise ValueError("not an image file")
        get = lambda name, at: _value(name, *at[FIELDS[name][0]], reader.order, charset) if FIELDS[name][0] in at else None
        if get("sop_class", raw) == DIRECTORY:
            return None
        for name in (wanted | set(equal)) & set(FIELDS):
            out[name] = get(name, raw)
            if name in GROUPED and FIELDS[name][0] not in raw:
                out[name] = next((v for g in (SHARED, EACH) for part in (groups.get(g) or [{}])[0].values() if isinstance(part, list) and part and (v := get(name, part[0])) is not None), None)
        if "frame_values" in wanted:
            out["frame_values"] = _frames(groups, get) if (get("frames", raw) or 1) > 1 and groups.get(EACH) else None
        if any(out.get(name) != v for name, v in equal.items()):
            return None
    except (ValueError, struct.error, zlib.error, OSError, zipfile.BadZipFile) as e:
        if equal:
            return None
        out = {"error": str(e) or type(e).__name__}
    out["bytes_read"] = max(src.fetched, reader.src.fetched if reader else 0)
    return out


def _frames(groups: dict, get) -> list[dict]:
    shared = (groups.get(SHARED) or [{}])[0]

    def of(frame: dict, part: int, name: str):
        for place in (frame, shared):
            found = place.get(part)
            if isinstance(found, list) and found and (v := get(name, found[0])) is not None:
                return v
        return None

    one = lambda x, default: default if x is None else x
    return [
        {"position": of(f, PLACE, "position"), "orientation": of(f, TURN, "orientation"), "slope": one(of(f, SCALE, "slope"), 1.0), "intercept": one(of(f, SCALE, "intercept"), 0.0)}
        for f in groups[EACH]
    ]


def parsed(df: DataFrame, content: str, columns: list[str] | None = None) -> DataFrame:
    """df without its bytes, with the header's columns (all of SCHEMA by default); a null has the error `no bytes`. A column of
    df that is called as one of those is an error."""
    names = columns or SCHEMA.names
    rest = [c for c in df.columns if c != content]
    if set(rest) & set(names):
        raise ValueError(f"columns that the header has too: {sorted(set(rest) & set(names))}")
    own = T.StructType([SCHEMA[n] for n in names])
    arrow = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [header(io.BytesIO(raw), len(raw), set(names)) if raw is not None else {"error": "no bytes"} for raw in b.column(len(rest)).to_pylist()]
            found = [r is not None for r in rows]
            new = pa.Table.from_pylist([r for r in rows if r is not None], schema=arrow)
            kept = pa.Table.from_batches([b]).filter(pa.array(found, pa.bool_()))
            t = pa.table([*(kept.column(i) for i in range(len(rest))), *new.columns], names=[*rest, *names])
            yield from t.to_batches()

    return df.select(*rest, content).mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), *own]))


class Headers(DataSource):
    """Headers of the files in a folder, at any depth, or in a zip archive: a row each, also for those that can't be read.

    Options: path, and files (of a partition, 500 by default). With a schema of fewer columns a file is read up to the last
    of them only. Filters on path choose files before they are opened; an equality on another field ends a file's reading."""

    @classmethod
    def name(cls) -> str:
        return "heddle_headers"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), *SCHEMA])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _HeadersReader(self.options, schema)


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _store(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)


class _HeadersReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        unknown = set(schema.names) - set(SCHEMA.names) - {"path"}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.path, self.per, self.names = options["path"], int(options.get("files", 500)), schema.names
        self.of_path: list = []
        self.equal: dict = {}

    def pushFilters(self, filters):
        scalars = {n for n, (_, _, many) in FIELDS.items() if not many}
        for f in filters:
            at = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if at == "path" and isinstance(f, EqualTo):
                self.of_path.append(("in", (f.value,)))
            elif at == "path" and isinstance(f, In):
                self.of_path.append(("in", tuple(f.value)))
            elif at == "path" and isinstance(f, StringStartsWith):
                self.of_path.append(("begins", f.value))
            elif at in scalars and isinstance(f, EqualTo) and self.equal.get(at, f.value) == f.value:
                self.equal[at] = f.value
            else:
                yield f

    def _chosen(self, name: str) -> bool:
        return all(name in v if how == "in" else name.startswith(v) for how, v in self.of_path)

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == afs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == afs.FileType.Directory:
            names = [i.path for i in store.get_file_info(afs.FileSelector(path, recursive=True)) if i.is_file]
        elif zipfile.is_zipfile(f := store.open_input_file(path)):
            f.seek(0)
            names = [n for n in zipfile.ZipFile(f).namelist() if not n.endswith("/")]
        else:
            names = [path]
        names = sorted(n for n in names if not n.lower().endswith(SKIPPED) and n.rsplit("/", 1)[-1].upper() != "DICOMDIR" and self._chosen(n)) if names != [path] else names
        return [_Files(names[i : i + self.per]) for i in range(0, len(names), self.per)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, path = _store(self.path)
        wanted, archive = set(self.names) - {"path"}, None
        if partition.names and store.get_file_info(path).is_file and partition.names != [path]:
            archive = zipfile.ZipFile(store.open_input_file(path))
        for name in partition.names:
            try:
                size = archive.getinfo(name).file_size if archive else store.get_file_info(name).size
                with archive.open(name) if archive else store.open_input_file(name) as f:
                    found = header(f, size, wanted, self.equal)
            except (OSError, zipfile.BadZipFile, RuntimeError) as e:
                found = None if self.equal else {"error": str(e)}
            if found is not None:
                found["path"] = name
                yield tuple(_plain(found.get(n)) for n in self.names)


def _plain(value):
    """Frames as rows are given to Spark as tuples in the order of FRAME."""
    if isinstance(value, list) and value and isinstance(value[0], dict):
        return [tuple(v[c] for c in FRAME.names) for v in value]
    return value


def headers(spark: SparkSession, path: str, columns: list[str] | None = None, files: int = 500) -> DataFrame:
    """path and the columns (all by default) of every file under a path; see Headers. Turns on that filters are pushed down."""
    spark.dataSource.register(Headers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own = T.StructType([T.StructField("path", T.StringType()), *(SCHEMA[n] for n in columns or SCHEMA.names)])
    return spark.read.format("heddle_headers").schema(own).option("files", files).load(path)


def records(found: DataFrame) -> DataFrame:
    """Headers as records of one instance each: fields that stand for others, the usual defaults, and of files with the same
    instance the one with the smallest path. Files that can't be read are left out; count them by `error`."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = found.where("error is null").withColumn("sop_instance", F.coalesce("sop_instance", "path"))
    number = F.coalesce(F.col("series_number").cast("string"), F.lit(""))
    # Fixed value: the name of a series without one.
    d = d.withColumns({
        "series": F.coalesce("series", F.concat(F.lit("sin-uid-"), number, F.lit("-"), text("modality"))),
        "time": F.coalesce("acquisition_time", "content_time", "series_time", F.lit("")),
        "scanning_sequence": F.coalesce("scanning_sequence", "echo_pulse_sequence", F.lit("")),
        "sequence_name": F.coalesce("sequence_name", "pulse_sequence_name", F.lit("")),
        "echo_time": F.coalesce(F.nullif("echo_time", F.lit(0.0)), "effective_echo_time"),
        "inversion_time": F.coalesce(F.nullif("inversion_time", F.lit(0.0)), F.get("inversion_times", F.lit(0))),
        "instance_number": F.coalesce("instance_number", F.lit(0)), "samples": F.coalesce(F.nullif("samples", F.lit(0)), F.lit(1)),
        "frames": F.coalesce(F.nullif("frames", F.lit(0)), F.lit(1)), "slope": F.coalesce(F.nullif("slope", F.lit(0.0)), F.lit(1.0)), "intercept": F.coalesce("intercept", F.lit(0.0)),
    })
    rest = [c for c in d.columns if c != "sop_instance"]
    return d.groupBy("sop_instance").agg(F.min_by(F.struct(*rest), "path").alias("r")).select("sop_instance", "r.*")
