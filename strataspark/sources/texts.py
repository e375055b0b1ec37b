"""Surfaces and wells in text and STORM files: what a surface file holds, readers of each kind, LAS wells, and writers.

Writers give every line a fixed width, so that each task knows the place of its lines in the files and no file needs one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from strataspark.operators.lateral import Geometry

from .files import MISSING, MISSING_SURFACE, PIECE, _files
from .ranges import Layout, RangeReader, head_of, reachable, write_files

#: Names that a column of a text surface may have, in upper case; the code of a missing node in them.
COLUMNS = {"x": ("X", "UTMX"), "y": ("Y", "UTMY"), "z": ("ATTRIBUTE", "Z", "TWT"), "il": ("INLINE", "IL"), "xl": ("CROSSLINE", "XL")}
MISSING_TEXT, HEADER_LINES = -999.25, 200
#: Names of coordinate logs, in the order in which they are tried; microseconds a foot to metres a second.
X_LOGS, Y_LOGS, FEET = ("X", "UTMX", "EASTING"), ("Y", "UTMY", "NORTHING"), 304800.0
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: The first word of a STORM surface, and the bytes that its header may have.
STORM, STORM_HEADER = b"STORMGRID_BINARY", 4096
_SURFACE = "path string, at long, nx int, dx double, dy double, x0 double, y0 double, z array<double>"


def _lines(content: Column) -> Column:
    return F.split(F.decode(content, "ISO-8859-1"), r"\r?\n")


def _numbers(n: int):
    """Whether a line is n numbers."""
    return lambda line: line.rlike(rf"^\s*{NUMBER}(?:\s+{NUMBER}){{{n - 1}}}\s*$")


def surface_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of files of surfaces: irap, storm, sgri, xyz, multicolumn, or unknown; an empty file has no row, as Spark leaves it out.

    By the first word; else by which comes among the first 200 lines, one of three numbers (xyz) being asked for first."""
    head = F.col("content")
    words = F.split(F.ltrim(F.translate(F.decode(head, "ISO-8859-1"), "\t\r\n", "   ")), " +", 6)
    lines = F.slice(_lines(head), 1, HEADER_LINES)
    first, version = F.get(words, F.lit(0)), F.get(words, F.lit(4))
    kind = F.when(first == "-996", "irap").when(first == STORM.decode(), "storm").when((first == "NORSAR") & version.isin("v1.0", "v2.0"), "sgri")
    kind = kind.when(first == "NORSAR", "unknown").when(F.exists(lines, _numbers(3)), "xyz").when(F.exists(lines, _numbers(5)), "multicolumn").otherwise("unknown")
    return _heads(spark, path, 1 << 16).select("path", kind.alias("kind"))


def _heads(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, content) with the first `size` bytes of each file that isn't empty. Files that pyarrow.fs doesn't reach are read whole by Spark."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                if content := head_of(name, size):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content])], names=["path", "content"])

    if not reachable(path):
        return _files(spark, path).select("path", F.substring("content", 1, size).alias("content"))
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(read, "path string, content binary")


def text_surface(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """(path, n, x, y, z, il, xl) of text surfaces of three columns (x, y, z; il and xl are null) or five, in any order.

    The line before the first numbers names them; without such a line, three columns are x, y, z. What stands before is
    information. A column without a name it may have, and a later line that isn't as many numbers, are errors; blank
    lines at the end aren't lines. -999.25 is a missing z. One file is one row until its lines are dealt out."""
    if columns not in (3, 5):
        raise ValueError("three or five columns")
    numeric = _numbers(columns)
    rows = _files(spark, path).select("path", F.split(F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\s+$", ""), r"\r?\n").alias("lines"))
    rows = rows.withColumn("at", F.array_position(F.transform(F.slice("lines", 1, HEADER_LINES), numeric), F.lit(True)).cast("int"))
    rows = rows.withColumn("names", F.when(F.col("at") > 1, F.split(F.upper(F.trim(F.element_at("lines", F.greatest(F.col("at") - 1, F.lit(1))))), r"\s+")))
    if columns == 3:
        rows = rows.withColumn("names", F.when(F.size("names") == 3, F.col("names")).otherwise(F.when(F.col("at") == 1, F.array(F.lit("X"), F.lit("Y"), F.lit("Z")))))
    place, wanted = {}, ("x", "y", "z", "il", "xl")[:columns]
    for c in wanted:
        at = F.array_max(F.array(*[F.array_position("names", n) for n in COLUMNS[c]]))
        place[c] = F.when(F.coalesce(at, F.lit(0)) > 0, at.cast("int")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(f": no column {' or '.join(COLUMNS[c])}"))))
    good = F.when(F.col("at") > 0, F.col("at")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(f": no line of {columns} numbers"))))
    rows = rows.select("path", *[v.alias(f"at_{c}") for c, v in place.items()], F.posexplode(F.slice("lines", good, F.size("lines"))).alias("n", "line"))
    words = F.when(numeric(F.col("line")), F.split(F.trim("line"), r"\s+")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(f": expected {columns} numbers, found "), F.col("line"))))
    rows = rows.withColumn("words", words)
    value = lambda c: F.element_at("words", F.col(f"at_{c}")).cast("double") if c in wanted else F.lit(None).cast("double")
    return rows.select("path", "n", value("x").alias("x"), value("y").alias("y"), F.nullif(value("z"), F.lit(MISSING_TEXT)).alias("z"), F.floor(value("il") + 0.5).cast("int").alias("il"), F.floor(value("xl") + 0.5).cast("int").alias("xl"))


def on_lines(nodes: DataFrame, geometry: Geometry | None = None) -> DataFrame:
    """Nodes of text surfaces with (i, j), their place in the even grid of their inlines and crosslines.

    il and xl come from the coordinates where `geometry` is given. A surface whose lines aren't evenly spaced (some lie off the grid
    of its least lines and its smallest step) is an error. One aggregate a surface, one lattice of lines each."""
    if geometry is not None:
        il, xl = geometry.lines(F.col("x"), F.col("y"))
        nodes = nodes.withColumn("il", il).withColumn("xl", xl)
    found = None
    for c in ("il", "xl"):
        # The lines of a surface are few; their steps stand in one row a surface.
        lines = F.array_sort(F.collect_set(c))
        steps = nodes.groupBy("path").agg(lines.alias("_l"))
        gaps = F.zip_with(F.slice("_l", 2, F.size("_l")), F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0))), lambda b, a: b - a)
        steps = steps.select("path", F.get("_l", F.lit(0)).alias(f"_{c}0"), F.coalesce(F.array_min(F.filter(gaps, lambda g: g.isNotNull())), F.lit(1)).alias(f"_{c}d"))
        found = steps if found is None else found.join(steps, "path")
    rows = nodes.join(found, "path")
    for c, k in (("il", "i"), ("xl", "j")):
        off = F.col(c) - F.col(f"_{c}0")
        rows = rows.withColumn(k, F.when(off % F.col(f"_{c}d") == 0, off / F.col(f"_{c}d")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(f": {c} is not evenly spaced at "), F.col(c)))).cast("int"))
    return rows.drop("_il0", "_ild", "_xl0", "_xld")


class StormSurfaceReader(RangeReader):
    """One record is a node, a 64-bit big-endian float."""

    block = 1 << 19

    def layout(self, path: str, size: int) -> Layout:
        return self.of(path, head_of(path, STORM_HEADER), size)

    @staticmethod
    def of(path: str, content: bytes, size: int) -> Layout:
        words, at = [], 0
        while len(words) < 9:
            end = content.find(b"\n", at)
            if end < 0:
                raise ValueError(f"{path}: not a STORM surface")
            words += content[at:end].split()
            at = end + 1
        if words[0] != STORM or len(words) != 9:
            raise ValueError(f"{path}: not a STORM surface")
        nx, ny, dx, dy, x0, _, y0, _ = int(words[1]), int(words[2]), *map(float, words[3:])
        if size - at < 8 * nx * ny:
            raise ValueError(f"{path}: {nx} x {ny} values expected, {(size - at) // 8} found")
        return Layout(at, 8, nx * ny, {"nx": nx, "dx": dx, "dy": dy, "x0": x0, "y0": y0})

    def decode(self, path: str, layout: Layout, first: int, data: bytes) -> pa.RecordBatch:
        z, h = np.frombuffer(data, ">f8").astype(float), layout.header
        starts = np.arange(0, len(z), PIECE)
        n = len(starts)
        columns = [pa.repeat(path, n), pa.array(first + starts), pa.array(np.full(n, h["nx"]), pa.int32()), *(pa.array(np.full(n, h[c])) for c in ("dx", "dy", "x0", "y0")), pa.ListArray.from_arrays(pa.array([*starts, len(z)], pa.int32()), pa.array(z))]
        return pa.RecordBatch.from_arrays(columns, names=["path", "at", "nx", "dx", "dy", "x0", "y0", "z"])


class StormSurface(DataSource):
    """Nodes of STORM binary surfaces, in pieces."""

    @classmethod
    def name(cls) -> str:
        return "storm_surface"

    def schema(self) -> str:
        return _SURFACE

    def reader(self, schema) -> DataSourceReader:
        return StormSurfaceReader(self.options)


def storm_surface(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, i, j, x, y, z) of STORM binary surfaces: nx ny dx dy, then least and largest x and y, then big-endian doubles, i fastest; -999 is missing.

    Files are split over tasks by nodes (`split` is the bytes a task reads); those that pyarrow.fs doesn't reach are read whole by Spark."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = StormSurfaceReader({})
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = memoryview(content.as_buffer())
                at = reader.of(name, bytes(content[:STORM_HEADER]), len(content))
                for k in range(0, at.count, reader.block // 8):
                    yield reader.decode(name, at, k, content[at.start + 8 * k : at.start + 8 * min(k + reader.block // 8, at.count)])

    if reachable(path):
        spark.dataSource.register(StormSurface)
        rows = spark.read.format("storm_surface").options(**options).load(path)
        rows = rows.withColumn("path", F.regexp_replace("path", "^(file:)?/+", "file:/"))
    else:
        rows = _files(spark, path).mapInArrow(parse, _SURFACE)
    rows = rows.select("*", F.posexplode("z").alias("p", "value")).withColumn("node", F.col("at") + F.col("p"))
    rows = rows.withColumns({"i": (F.col("node") % F.col("nx")).cast("int"), "j": F.expr("node div nx").cast("int")})
    return rows.select("path", "i", "j", *[(F.col(f"{a}0") + F.col(c) * F.col(f"d{a}")).alias(a) for a, c in (("x", "i"), ("y", "j"))], F.when((F.col("value") != MISSING[0]) & ~F.isnan("value"), F.col("value")).alias("z"))


def las_wells(spark: SparkSession, path: str, logs: list[str]) -> DataFrame:
    """(well, seq, one column for each of `logs`) of LAS 2.0 wells; the file's NULL, the other missing codes, and logs that a file lacks are null.

    Names of curves are compared without case; wrapped files too. A file whose numbers don't fill its last depth is an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                section, curves, well, missing, numbers = "", [], "", list(MISSING), []
                for line in content.decode("latin-1").splitlines():
                    line = line.strip()
                    if not line or line.startswith("#"):
                        continue
                    if line.startswith("~"):
                        section = line[1:2].upper()
                    elif section == "A":
                        numbers += line.split()
                    elif section in "WC":
                        mnemonic, _, rest = line.partition(".")
                        # Behind the unit, which touches the point, stands the value, up to the last colon.
                        value = rest.rpartition(":")[0].partition(" ")[2].strip()
                        if section == "C":
                            curves.append(mnemonic.strip().upper())
                        elif mnemonic.strip().upper() == "NULL":
                            missing.append(float(value))
                        elif mnemonic.strip().upper() == "WELL":
                            well = value
                if not curves or len(numbers) % len(curves):
                    raise ValueError(f"{name}: {len(numbers)} numbers for {len(curves)} curves")
                data = np.array(numbers, float).reshape(-1, len(curves))
                data = np.where(np.isin(data, missing), np.nan, data)
                out = {"well": well, "seq": np.arange(len(data))}
                yield pd.DataFrame(out | {c: data[:, curves.index(c.upper())] if c.upper() in curves else np.nan for c in logs})

    schema = "well string, seq int" + "".join(f", `{c}` double" for c in logs)
    rows = _files(spark, path).mapInPandas(parse, schema)
    return rows.select(*[F.col(f"`{c}`") if t != "double" else F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")).alias(c) for c, t in rows.dtypes])


def prepared_logs(wells: DataFrame, time: str, vp: str, vs: str, rho: str, facies: str | None = None, porosity: str | None = None, x: str | None = None, y: str | None = None, slowness: tuple[bool, bool] = (False, False), kilometres: bool = False) -> DataFrame:
    """(well, seq, x, y, z, vp, vs, rho[, facies][, porosity]) of wells as read, in metres, milliseconds and metres a second.

    Coordinates are the named logs, else the first of X, UTMX, EASTING (Y, UTMY, NORTHING) that the table has, without
    case. `slowness` says which of vp and vs are times a foot; `kilometres` that lengths are in km and times in s. Samples
    without x, y or time go; a facies code is cut to a whole number; a porosity log that is not there is null. Missing codes are null."""
    have = {c.upper(): c for c in wells.columns}

    def log(names: tuple[str, ...], what: str, needed: bool = True) -> Column:
        for n in names:
            if n.upper() in have:
                return F.when(~F.col(f"`{have[n.upper()]}`").isin(*MISSING), F.col(f"`{have[n.upper()]}`"))
        if needed:
            raise ValueError(f"no log for {what}; tried {', '.join(names)}")
        return F.lit(None).cast("double")

    scale = 1000.0 if kilometres else 1.0
    velocity = lambda n, what, slow: F.try_divide(F.lit(FEET), log((n,), what)) if slow else log((n,), what)
    out = [(log((x,) if x else X_LOGS, "x") * scale).alias("x"), (log((y,) if y else Y_LOGS, "y") * scale).alias("y"), (log((time,), "time") * scale).alias("z"),
           velocity(vp, "vp", slowness[0]).alias("vp"), velocity(vs, "vs", slowness[1]).alias("vs"), log((rho,), "density").alias("rho")]
    if facies:
        out.append(log((facies,), "facies").cast("int").alias("facies"))
    if porosity:
        out.append(log((porosity,), "porosity", False).alias("porosity"))
    return wells.select("well", "seq", *out).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def _fixed(value: Column, width: int, digits: int, missing: float) -> Column:
    """A number in `width` characters; one that needs more is an error."""
    text = F.format_string(f"%{width}.{digits}f", F.coalesce(value.cast("double"), F.lit(missing)))
    return F.when(F.length(text) == width, text).otherwise(F.raise_error(F.concat(F.lit(f"a value needs more than {width} characters: "), text)))


def _bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def write_rms_wells(samples: DataFrame, folder: str, logs: list[str], facies: dict[int, str] | None = None, digits: int = 4, width: int = 16) -> None:
    """Writes (well, seq, x, y, z, logs[, facies]) as one RMS file a well, <well>.rms, with blanks and slashes of its name turned to _.

    seq counts a well's samples from 0 without holes: one missing or twice there is an error and leaves no file. Missing values
    are -999. `facies` names the codes of the log `facies`, which is then written as a discrete log, after the others."""
    names = [*logs, *(["facies"] if facies else [])]
    kinds = [f"{c} UNK lin" for c in logs] + (["Facies DISC " + " ".join(f"{k} {n}" for k, n in sorted(facies.items()))] if facies else [])
    well, line = F.translate(F.col("well").cast("string"), " /", "__"), (width + 1) * (3 + len(names))
    place = F.concat(F.lit("1.0\nstrataspark\n"), F.col("w"), F.lit(" "), _fixed(F.col("a.x"), width, digits, MISSING[0]), F.lit(" "), _fixed(F.col("a.y"), width, digits, MISSING[0]), F.lit(f"\n{len(names)}\n" + "".join(k + "\n" for k in kinds)))
    heads = samples.groupBy(well.alias("w")).agg(F.min_by(F.struct("x", "y"), "seq").alias("a")).select("w", place.alias("head"))
    lines = samples.select(well.alias("w"), "seq", F.concat(F.concat_ws(" ", *[_fixed(F.col(c), width, digits, MISSING[0]) for c in ("x", "y", "z", *names)]), F.lit("\n")).alias("line"))
    start = heads.select("w", F.length("head").alias("start"))
    body = lines.join(start, "w").select(F.concat("w", F.lit(".rms")).alias("name"), (F.col("start") + F.col("seq") * line).alias("place"), _bytes(F.col("line")).alias("data"))
    write_files(body.unionByName(heads.select(F.concat("w", F.lit(".rms")).alias("name"), F.lit(0).alias("place"), _bytes(F.col("head")).alias("data"))), folder)


def write_irap_surfaces(nodes: DataFrame, grids: DataFrame, folder: str, digits: int = 4, width: int = 16) -> None:
    """Writes (name, i, j, z) as Irap classic files <name>.irap, given (name, nx, ny, dx, dy, x0, y0, angle in degrees) of each.

    Six nodes a line; a missing node is 9999900. Every node of the grid has its row: one missing or twice there leaves no file."""
    number = lambda c: _fixed(F.col(c), width, digits, 0.0)
    far = [_fixed(F.col(f"{a}0") + (F.col(f"n{a}") - 1) * F.col(f"d{a}"), width, digits, 0.0) for a in "xy"]
    whole = lambda c: F.format_string("%d", F.col(c).cast("long"))
    lines = [F.concat_ws(" ", F.lit("-996"), whole("ny"), number("dx"), number("dy")), F.concat_ws(" ", number("x0"), far[0], number("y0"), far[1]), F.concat_ws(" ", whole("nx"), number("angle"), number("x0"), number("y0")), F.lit("0 0 0 0 0 0 0")]
    heads = grids.select("name", "nx", "ny", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("head"))
    at, count = F.col("j") * F.col("nx") + F.col("i"), F.col("nx") * F.col("ny")
    inside = F.col("i").between(0, F.col("nx") - 1) & F.col("j").between(0, F.col("ny") - 1)
    end = F.when(((at + 1) % 6 == 0) | (at + 1 == count), "\n").otherwise(" ")
    text = F.when(inside, F.concat(_fixed(F.col("z"), width, digits, MISSING_SURFACE), end)).otherwise(F.raise_error(F.concat(F.col("name"), F.lit(": a node outside the grid"))))
    file = F.concat("name", F.lit(".irap"))
    body = nodes.join(heads, "name").select(file.alias("name"), (F.length("head") + at * (width + 1)).alias("place"), _bytes(text).alias("data"))
    # An empty row at the end of each file, so that a last node that is missing is found.
    ends = heads.select(file.alias("name"), (F.length("head") + count * (width + 1)).alias("place"), F.lit(b"").alias("data"))
    write_files(body.unionByName(heads.select(file.alias("name"), F.lit(0).alias("place"), _bytes(F.col("head")).alias("data"))).unionByName(ends), folder)


def write_storm_surfaces(nodes: DataFrame, grids: DataFrame, folder: str) -> None:
    """As `write_irap_surfaces`, in STORM's binary form, <name>.storm; it has no angle, so one that isn't 0 is an error."""

    def packed(z: pd.Series) -> pd.Series:
        data = z.fillna(MISSING[0]).to_numpy(float).astype(">f8").tobytes()
        return pd.Series([data[k : k + 8] for k in range(0, len(data), 8)], index=z.index)

    number = lambda c: F.format_string("%.6f", c.cast("double"))
    col, straight = F.col, F.when(F.col("angle") == 0, F.lit("STORMGRID_BINARY\n\n")).otherwise(F.raise_error(F.concat(F.col("name"), F.lit(": a STORM surface can't be turned"))))
    whole = lambda c: F.format_string("%d", F.col(c).cast("long"))
    far = [number(col(f"{a}0") + (col(f"n{a}") - 1) * col(f"d{a}")) for a in "xy"]
    head = F.concat(straight, F.concat_ws(" ", whole("nx"), whole("ny"), number(col("dx")), number(col("dy"))), F.lit("\n"), F.concat_ws(" ", number(col("x0")), far[0], number(col("y0")), far[1]), F.lit("\n"))
    heads = grids.select(F.concat("name", F.lit(".storm")).alias("file"), "name", "nx", "ny", head.alias("head"))
    at = col("j") * col("nx") + col("i")
    inside = F.when(col("i").between(0, col("nx") - 1) & col("j").between(0, col("ny") - 1), at).otherwise(F.raise_error(F.concat(F.col("name"), F.lit(": a node outside the grid"))))
    body = nodes.join(heads, "name").select(col("file").alias("name"), (F.length("head") + inside * 8).alias("place"), F.pandas_udf(packed, "binary")(col("z").cast("double")).alias("data"))
    ends = heads.select(col("file").alias("name"), (F.length("head") + col("nx") * col("ny") * 8).alias("place"), F.lit(b"").alias("data"))
    write_files(body.unionByName(heads.select(col("file").alias("name"), F.lit(0).alias("place"), _bytes(col("head")).alias("data"))).unionByName(ends), folder)


def write_jason_wavelets(wavelets: DataFrame, folder: str) -> None:
    """Writes (name, shift, dz, amp) as JASON files <name>.txt; amp is as `jason_wavelet` gives it, and is turned back here."""
    lines = F.concat_ws("\n", F.lit('* wavelet\n"amplitudes'), F.format_string("%.6f", F.col("shift").cast("double")), F.format_string("%.6f", F.col("dz").cast("double")), F.format_string("%d", F.size("amp")), F.array_join(F.transform(F.reverse("amp"), lambda v: F.format_string("%.9f", v.cast("double"))), "\n"))
    write_files(wavelets.select(F.concat("name", F.lit(".txt")).alias("name"), F.lit(0).alias("place"), _bytes(F.concat(lines, F.lit("\n"))).alias("data")), folder)
