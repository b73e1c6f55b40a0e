"""ENVI scenes: headers, a byte-range data source for binaries, the chunk index, and sinks."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Type codes of the format: NumPy type and Spark type. Code 1 is an unsigned byte. Fixed values.
TYPES = {
    1: ("u1", "smallint"), 2: ("i2", "smallint"), 3: ("i4", "int"), 4: ("f4", "float"), 5: ("f8", "double"), 6: ("c8", "struct<re:double,im:double>"),
    9: ("c16", "struct<re:double,im:double>"), 12: ("u2", "int"), 13: ("u4", "bigint"), 14: ("i8", "bigint"), 15: ("u8", "decimal(20,0)"),
}
ORDER = {"0": "<", "1": ">"}
_FIELD = r"(?m)^[ \t]*([^;=\n]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)"


def parse_header(text: str) -> dict[str, str | list[str]]:
    """Fields of a header: names in lower case; braced values are lists, but ``description`` a string."""
    if not text.lstrip("﻿").startswith("ENVI"):
        raise ValueError("the first line must start with ENVI")
    out: dict[str, str | list[str]] = {}
    for name, value in re.findall(_FIELD, text):
        name, value = name.strip().lower(), value.strip()
        if value.startswith("{"):
            inner = value.strip("{}").strip()
            out[name] = inner if name == "description" else [v.strip() for v in inner.split(",")]
        else:
            out[name] = value
    return out


def header_fields(text: Column) -> Column:
    """The same for a column of whole header texts: a map of name to raw value; null for other texts."""
    names = F.transform(F.regexp_extract_all(text, F.lit(_FIELD), 1), lambda n: F.lower(F.trim(n)))
    values = F.transform(F.regexp_extract_all(text, F.lit(_FIELD), 2), lambda v: F.trim(v))
    return F.when(text.startswith("ENVI"), F.map_from_arrays(names, values))


def header_list(value: Column) -> Column:
    """The entries of a braced value."""
    return F.split(F.regexp_replace(value, r"^[{\s]+|[}\s]+$", ""), r"\s*,\s*")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, fields of all headers below a path."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.hdr").select(F.input_file_name().alias("path"), header_fields(F.col("value")).alias("fields"))


@dataclass
class Layout:
    """Where the values of a binary lie."""

    samples: int
    lines: int
    bands: int
    code: int = 4
    interleave: str = "bil"
    offset: int = 0
    order: str = "<"
    nodata: float | None = None
    wavelength: list[float] = field(default_factory=list)
    fwhm: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, h: dict) -> Layout:
        floats = lambda k: [float(v) for v in h.get(k, [])]
        return cls(
            int(h["samples"]), int(h["lines"]), int(h["bands"]), int(h["data type"]), h.get("interleave", "bil").lower(), int(h.get("header offset", 0)),
            ORDER[h.get("byte order", "0")], float(h["data ignore value"]) if "data ignore value" in h else None, floats("wavelength"), floats("fwhm"),
        )

    @property
    def size(self) -> int:
        return np.dtype(TYPES[self.code][0]).itemsize

    def line_range(self, line: int) -> tuple[int, int]:
        """Offset and length of the bytes of one line of all bands (line-interleaved files)."""
        n = self.samples * self.bands * self.size
        return self.offset + line * n, n


def _open(path: str):
    """File system and name of a path; Hadoop's names of object stores are taken for the stores' own."""
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    if not rest:
        return fs.FileSystem.from_uri("file://" + path)
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)


def read_layout(path: str, header: str | None = None) -> tuple[Layout, dict]:
    """Layout and header fields of a binary."""
    system, name = _open(header or header_of(path))
    with system.open_input_stream(name) as f:
        fields = parse_header(f.read().decode())
    return Layout.of(fields), fields


def header_of(path: str) -> str:
    return re.sub(r"\.(bin|img|dat)$", "", path) + ".hdr"


def _range(text: str | None, n: int) -> tuple[int, int]:
    low, _, high = (text or ":").partition(":")
    return max(int(low or 0), 0), min(int(high or n), n)


class _Lines(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class EnviReader(DataSourceReader):
    """Reads byte ranges of the lines, bands and samples asked for, nothing between them."""

    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.block = int(options.get("lines", 100))
        lay = self.layout = read_layout(self.path, options.get("header"))[0]
        keep = options.get("bands")
        self.keep = [int(b) for b in keep.split(",")] if keep else list(range(lay.bands))
        self.y, self.x = _range(options.get("y"), lay.lines), _range(options.get("x"), lay.samples)

    def partitions(self):
        return [_Lines(y, min(y + self.block, self.y[1])) for y in range(self.y[0], self.y[1], self.block)] or [_Lines(0, 0)]

    def _line(self, f, line: int) -> np.ndarray:
        """(sample, band) of one line."""
        lay, (x0, x1) = self.layout, self.x
        kind = np.dtype(lay.order + TYPES[lay.code][0])

        def values(first: int, n: int) -> np.ndarray:
            f.seek(lay.offset + first * lay.size)
            return np.frombuffer(f.read(n * lay.size), kind)

        if lay.interleave == "bip":
            return values((line * lay.samples + x0) * lay.bands, (x1 - x0) * lay.bands).reshape(x1 - x0, lay.bands)[:, self.keep]
        start = (lambda b: (line * lay.bands + b) * lay.samples) if lay.interleave == "bil" else (lambda b: (b * lay.lines + line) * lay.samples)
        if lay.interleave == "bil" and (x0, x1) == (0, lay.samples):  # neighbouring bands in one read
            parts, k = [], 0
            while k < len(self.keep):
                n = 1
                while k + n < len(self.keep) and self.keep[k + n] == self.keep[k] + n:
                    n += 1
                parts.append(values(start(self.keep[k]), n * lay.samples).reshape(n, lay.samples))
                k += n
            return np.concatenate(parts).T
        return np.stack([values(start(b) + x0, x1 - x0) for b in self.keep], axis=1)

    def _values(self, flat: np.ndarray):
        import pyarrow as pa
        import pyarrow.compute as pc

        lay = self.layout
        flat = flat.astype(flat.dtype.newbyteorder("="))
        if flat.dtype.kind == "c":
            null = np.isnan(flat)
            return pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], ["re", "im"], mask=pa.array(null))
        if flat.dtype.kind == "f":
            null = np.isnan(flat)
            if lay.nodata is not None:
                null |= np.abs(flat - lay.nodata) <= 1e-8 + 1e-5 * abs(lay.nodata)
        else:
            null = flat == lay.nodata if lay.nodata is not None else np.zeros(len(flat), bool)
        made = pa.array(flat, mask=null)
        kind = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}
        return pc.cast(made, kind[TYPES[lay.code][1]])

    def read(self, partition):
        import pyarrow as pa

        if partition.start >= partition.stop:
            return
        system, name = _open(self.path)
        x0, x1 = self.x
        n, names = max(x1 - x0, 0), ["y", "x", "bands"]
        with system.open_input_file(name) as f:
            for line in range(partition.start, partition.stop) if n else ():
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(self.keep)), self._values(self._line(f, line).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, line, np.int32)), pa.array(np.arange(x0, x1, dtype=np.int32)), lists], names=names)


class EnviSource(DataSource):
    """``spark.read.format("envi")``: y, x, bands (null is nodata) of one binary, in the header's type.

    Options: ``header`` (else beside the file), ``lines`` in a partition, ``y`` and ``x`` (``start:stop``,
    half-open), ``bands`` (positions to keep). Only the bytes of what is asked for are read.
    """

    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        lay = read_layout(self.options["path"], self.options.get("header"))[0]
        return f"y int, x int, bands array<{TYPES[lay.code][1]}>"

    def reader(self, schema):
        return EnviReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(EnviSource)


def read_cube(spark: SparkSession, path: str, dataset: str = "reflectance", ortho: bool = False, filter_bands=False, subset=None, **options) -> DataFrame:
    """The pixels that ``reader.open_scene`` gives for these choices."""
    from . import reader

    return reader.open_scene(spark, path, dataset, ortho, filter_bands, subset, **options).pixels


# -- chunk index -----------------------------------------------------------------------------------
def chunk_index(files: DataFrame) -> DataFrame:
    """source_path, var, time_ix, line, byte_offset, byte_length for each line of each layer.

    ``files``: source_path, var, time_ix, samples, lines, bands, layer (null: all bands together), size,
    header_offset.
    """
    line = files.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)))
    each = F.col("samples").cast("long") * F.col("size")
    whole = F.col("layer").isNull()
    start = F.col("line") * F.col("bands") + F.when(whole, 0).otherwise(F.col("layer"))
    return line.select(
        "source_path", "var", "time_ix", "line",
        (F.col("header_offset") + start * each).cast("long").alias("byte_offset"),
        F.when(whole, each * F.col("bands")).otherwise(each).cast("long").alias("byte_length"),
    )


def array_entries(name: str, data: np.ndarray, dims: list[str]) -> dict[str, object]:
    """The three entries of an inline array."""
    meta = {"zarr_format": 2, "shape": list(data.shape), "chunks": list(data.shape), "dtype": data.dtype.str, "compressor": None, "fill_value": None, "filters": None, "order": "C"}
    return {
        f"{name}/.zarray": json.dumps(meta),
        f"{name}/.zattrs": json.dumps({"_ARRAY_DIMENSIONS": dims}),
        f"{name}/" + ".".join(["0"] * data.ndim): "base64:" + base64.b64encode(data.tobytes()).decode(),
    }


def write_index(index: DataFrame, output: str, inline: dict[str, object] | None = None) -> None:
    """A reference store as JSON, beside the parquet form that jobs read. One file: for one scene's lines."""
    if not output.endswith(".json"):
        raise ValueError("the output must end in .json")
    refs = dict(inline or {})
    for r in index.orderBy("var", "time_ix", "line").toLocalIterator():
        refs[f"{r['var']}/{r['time_ix']}.{r['line']}.0.0"] = [r["source_path"], r["byte_offset"], r["byte_length"]]
    system, name = _open(output)
    with system.open_output_stream(name) as f:
        f.write(json.dumps({"version": 1, "refs": refs}, indent=2).encode())


def write_bil(pixels: DataFrame, path: str, layout: Layout, fields: dict[str, str] | None = None, block: int = 100) -> None:
    """Write pixels as one line-interleaved binary and a header that ``EnviSource`` reads.

    Each block of lines is written by one task under a temporary name and then moved, so a task may run again; blocks without
    pixels are nodata. The driver then joins the blocks, one buffer at a time. Nulls become the sentinel. ``fields`` are further
    header lines.
    """
    import pandas as pd

    from ..session import ship

    spark = pixels.sparkSession
    ship(spark)
    kind = np.dtype(layout.order + TYPES[layout.code][0])
    blocks = -(-layout.lines // block)
    fill = layout.nodata if layout.nodata is not None else np.nan if kind.kind in "fc" else 0

    def work(key, frame: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * block
        lines = min(block, layout.lines - first)
        cube = np.full((lines, layout.bands, layout.samples), fill, kind)
        for y, x, bands in zip(frame["y"], frame["x"], frame["bands"]):
            if bands is not None and not pd.isna(y):
                cube[int(y) - first, :, int(x)] = [fill if v is None or v != v else v for v in bands]
        system, name = _open(f"{path}.block{int(key[0])}")
        with system.open_output_stream(name + ".tmp") as f:
            f.write(cube.tobytes())
        system.move(name + ".tmp", name)
        return pd.DataFrame({"first": [first], "lines": [lines]})

    system, name = _open(path)
    if "/" in name:
        system.create_dir(name.rpartition("/")[0])
    inside = pixels.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "bands")
    inside = inside.where((F.col("y") >= 0) & (F.col("y") < layout.lines) & (F.col("x") >= 0) & (F.col("x") < layout.samples))
    empty = spark.range(blocks).select((F.col("id") * block).cast("int").alias("y"), F.lit(0).alias("x"), F.lit(None).cast(inside.schema["bands"].dataType).alias("bands"))
    inside.unionByName(empty).groupBy(F.floor(F.col("y") / block).alias("b")).applyInPandas(work, "first int, lines int").count()
    system, name = _open(path)
    with system.open_output_stream(name) as out:
        for k in range(blocks):
            with system.open_input_stream(f"{name}.block{k}") as part:
                while piece := part.read(1 << 24):
                    out.write(piece)
            system.delete_file(f"{name}.block{k}")
    text = (
        f"ENVI\nsamples = {layout.samples}\nlines = {layout.lines}\nbands = {layout.bands}\nheader offset = 0\nfile type = ENVI Standard\n"
        f"data type = {layout.code}\ninterleave = bil\nbyte order = {0 if layout.order == '<' else 1}\n"
    )
    text += "" if layout.nodata is None else f"data ignore value = {layout.nodata}\n"
    for key in ("wavelength", "fwhm"):
        if values := getattr(layout, key):
            text += f"{key} = {{ {', '.join(map(str, values))} }}\n"
    text += "".join(f"{k} = {v}\n" for k, v in (fields or {}).items())
    system, name = _open(header_of(path))
    with system.open_output_stream(name) as f:
        f.write(text.encode())
