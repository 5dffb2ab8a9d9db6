"""Reading evidence tables: text first, types beside it, provenance in every row."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vestige.functions.times import parse_time
from vestige.operators.lookups import sized

#: The columns that say where a row is from.
PROVENANCE = ["_run_id", "_host", "_identity", "_output_file"]
UBIGINT_MOST = 18_446_744_073_709_551_615


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """``wanted`` names that clash with none, ignoring case: ``_1``, ``_2``, ... are put behind."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        k, free = 0, name
        while free.lower() in used:
            k += 1
            free = f"{name}_{k}"
        used.add(free.lower())
        out.append(free)
    return out


def view_name(text: str) -> str:
    import re

    clean = re.sub(r"[^A-Za-z0-9_]+", "_", text).strip("_").lower() or "unnamed"
    return "_" + clean if clean[0].isdigit() else clean


#: Distinct headers in one scan: each is a scan of the plan.
MOST_HEADERS = 500
#: Threads of the driver that read files' first lines.
HEADER_READERS = 32
FILES = "path string, host string, identity string"


def one_slash(address: Column) -> Column:
    """An address with one slash behind its scheme: listings and scans differ in that."""
    return F.regexp_replace(address, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def scanned_path() -> Column:
    """The address of the file that a scanned row is from, as a listing gives it: other characters aren't escaped."""
    return one_slash(F.try_url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, length) of every file under a folder whose name ends with ``suffix``; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return listed.where(F.endswith("path", F.lit(suffix))) if suffix else listed


def _split_header(line: str) -> list[str]:
    return next(csv.reader([line])) if line else []


@dataclass(frozen=True)
class Header:
    """Where a path leads, whether that is a folder, and the names in its first record."""

    address: str
    folder: bool
    names: tuple[str, ...]


def headers(spark: SparkSession, paths: list[str]) -> dict[str, Header]:
    """The header of every file, or of the first file of a folder. Only these lines reach the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first_record(path: str) -> Header:
        where = jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(conf)
        where = store.makeQualified(where)
        opened, folder = where, store.getFileStatus(where).isDirectory()
        if folder:
            names = sorted(f.getPath().toString() for f in store.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", ".")) and f.getLen())
            if not names:
                return Header(where.toString(), True, ())
            opened = jvm.org.apache.hadoop.fs.Path(names[0])
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(store.open(opened), "UTF-8"))
        try:
            line = reader.readLine() or ""
            while line.count('"') % 2 and (more := reader.readLine()) is not None:  # a name may hold a line end
                line += "\n" + more
        finally:
            reader.close()
        return Header(where.toString(), folder, tuple(_split_header(line.removeprefix("\ufeff"))))

    with ThreadPoolExecutor(HEADER_READERS) as pool:
        return dict(zip(paths, pool.map(first_record, paths)))


def scan_text(spark: SparkSession, files: list[tuple[str, str, str]] | DataFrame, run_id: str, multi_line: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """CSV files (path, host, identity) as text with provenance, joined by column name.

    Files of one header are one scan, so the plan grows with the headers
    (``MOST_HEADERS`` of them), not with the files. Host and identity are joined by
    the address that the scan gives. A path may be a folder of files with one header. Provenance
    gets names that no header has; a name that a header repeats is numbered; files without a header have no rows.
    """
    rows = [tuple(r) for r in files.select("path", "host", "identity").collect()] if isinstance(files, DataFrame) else list(files)
    found = headers(spark, list(dict.fromkeys(r[0] for r in rows)))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for header in found.values():
        if header.names:
            by_header.setdefault(header.names, []).append(header.address)
    if len(by_header) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} headers in one scan")
    names = {h: free_names([], [c or f"column{i}" for i, c in enumerate(h)]) for h in by_header}
    every = [c for ns in names.values() for c in ns]
    own = free_names(every, PROVENANCE)
    at, key, source = free_names([*every, *own], ["_at", "_key", "_source"])
    out = None
    for header, paths in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names[header]])
        df = spark.read.schema(schema).options(**(options or {})).csv(paths, header=True, quote='"', escape='"', multiLine=multi_line)
        df = df.withColumn(at, scanned_path())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in own))
    data = [c for c in out.columns if c != at]
    given = [(found[path].address, found[path].folder, host, identity) for path, host, identity in rows]
    origin = spark.createDataFrame(given, "address string, folder boolean, host string, identity string").withColumn(key, one_slash(F.col("address"))).withColumn(source, F.struct("host", "identity"))
    origin = sized(origin.groupBy(key, "folder").agg(F.min(source).alias(source)))
    if not any(h.folder for h in found.values()):
        placed = out.join(origin.select(key, source), F.col(at) == F.col(key), "left")
    else:
        inside = F.regexp_replace(at, "/[^/]*$", "")
        of_file = origin.where("NOT folder").select(key, source)
        of_folder = origin.where("folder").select(F.col(key).alias(f"{key}_"), F.col(source).alias(f"{source}_"))
        placed = out.join(of_file, F.col(at) == F.col(key), "left").join(of_folder, inside == F.col(f"{key}_"), "left").withColumn(source, F.coalesce(source, f"{source}_"))
    values = [F.lit(run_id), F.col(source)["host"], F.col(source)["identity"], F.col(at)]
    return placed.select(*[F.col(f"`{c}`") for c in data], *[v.alias(n) for v, n in zip(values, own)])


def merge_user_files(spark: SparkSession, files: list[tuple[str, str]], multi_line: bool = False) -> DataFrame:
    """(user, path) files of one dataset as one table with ``TriageUser``: one scan. Headers must be the same; files without one have no rows."""
    found = {h.names for h in headers(spark, [path for _, path in files]).values() if h.names}
    if len(found) > 1:
        raise ValueError("the headers differ: " + " / ".join(",".join(h) for h in sorted(found)))
    scanned = scan_text(spark, [(path, "", user or "system") for user, path in files], "", multi_line)
    identity = scanned.columns[-2]
    return scanned.select(*[F.col(f"`{c}`") for c in scanned.columns[: -len(PROVENANCE)]], F.col(identity).alias("TriageUser"))


def as_type(text: Column, kind: str) -> Column:
    """``text`` as timestamp, bigint, ubigint or boolean; NULL where it isn't one."""
    if kind == "timestamp":
        return parse_time(text)
    if kind == "ubigint":
        number = F.when(text.rlike(r"^\+?\d{1,20}$"), text).try_cast(T.DecimalType(20, 0))
        return F.when(number.between(F.lit(0).cast("decimal(20,0)"), F.lit(str(UBIGINT_MOST)).cast("decimal(20,0)")), number)
    if kind == "bigint":
        return F.when(text.rlike(r"^[+-]?\d{1,19}$"), text).try_cast("bigint")
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Declared columns as their type, their text beside them as ``<column>__text``."""
    return df.withColumns({f"{c}__text": F.col(c) for c in kinds}).withColumns({c: as_type(F.col(f"{c}__text"), k) for c, k in kinds.items()})


def typed_if_utc(text: Column) -> Column:
    return F.when(text.endswith("Z"), parse_time(text))


def infer_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The kind that every non-blank cell of a column has, if there is one; one aggregate for all columns."""
    kinds = ["boolean", "bigint", "ubigint", "timestamp"]
    filled = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns}
    counts = df.agg(*[F.count(filled[c]).alias(f"{c}|n") for c in columns], *[F.count(as_type(filled[c], k)).alias(f"{c}|{k}") for c in columns for k in kinds]).first()
    return {c: next((k for k in kinds if counts[f"{c}|{k}"] == counts[f"{c}|n"]), "text") if counts[f"{c}|n"] else "text" for c in columns}


def load_loose(df: DataFrame) -> DataFrame:
    """A file without declared types: text columns, and ``<column>__typed`` for those whose kind is certain."""
    kinds = {c: k for c, k in infer_kinds(df, df.columns).items() if k != "text"}
    return df.withColumns({f"{c}__typed": as_type(F.nullif(F.trim(F.col(c)), F.lit("")), k) for c, k in kinds.items()})


def merge_per_user(slices: list[tuple[str, DataFrame]]) -> DataFrame:
    """Slices of users as one table with the user; headers must be the same."""
    first = slices[0][1].columns
    out = None
    for user, df in sorted(slices, key=lambda x: x[0]):
        if df.columns != first:
            raise ValueError(f"the header of {user} differs")
        part = df.withColumn("TriageUser", F.lit(user or "system"))
        out = part if out is None else out.unionByName(part)
    return out


def append_by_name(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def channel_file(channel: Column) -> Column:
    """A channel's output name: other characters than letters, digits and ``-`` are ``_``, trimmed."""
    clean = F.regexp_replace(F.regexp_replace(channel, "[^A-Za-z0-9-]", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(clean)


def export_per_channel(df: DataFrame, channel: str, path: str) -> None:
    df.withColumn("channel_file", channel_file(F.col(channel))).write.partitionBy("channel_file").csv(path, header=True, quoteAll=True)


def inventory(manifest: DataFrame) -> DataFrame:
    """One row a dataset of a run manifest (tool, datasets: array of struct)."""
    return manifest.select("tool", F.explode("datasets").alias("d")).select("tool", F.col("d.id").alias("id"), F.col("d.view").alias("view"), F.size("d.files").alias("files"), F.size(F.map_keys("d.types")).alias("typed_columns"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file under a folder, by path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")
