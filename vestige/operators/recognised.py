"""Execution and deletion evidence from tables that their exact header tells: each is read by its own select, all into one shape."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.operators.search import ascii_fold
from vestige.sources.tables import headers, scan_text

# The headers of the tables that are known.
HEADERS = {
    "amcache_file_entries": "ApplicationName,ProgramId,FileKeyLastWriteTimestamp,SHA1,IsOsComponent,FullPath,Name,FileExtension,LinkDate,ProductName,Size,Version,ProductVersion,LongPathHash,BinaryType,IsPeFile,BinFileVersion,BinProductVersion,Usn,Language,Description",
    "amcache_driver_binaries": "KeyName,KeyLastWriteTimestamp,DriverTimeStamp,DriverLastWriteTime,DriverName,DriverInBox,DriverIsKernelMode,DriverSigned,DriverCheckSum,DriverCompany,DriverId,DriverPackageStrongName,DriverType,DriverVersion,ImageSize,Inf,Product,ProductVersion,Service,WdfVersion",
    "appcompat_cache": "ControlSet,CacheEntryPosition,Path,LastModifiedTimeUTC,Executed,Duplicate,SourceFile",
    "mft": "EntryNumber,SequenceNumber,InUse,ParentEntryNumber,ParentSequenceNumber,ParentPath,FileName,Extension,FileSize,ReferenceCount,ReparseTarget,IsDirectory,HasAds,IsAds,SI<FN,uSecZeros,Copied,SiFlags,NameType,Created0x10,Created0x30,LastModified0x10,LastModified0x30,LastRecordChange0x10,LastRecordChange0x30,LastAccess0x10,LastAccess0x30,UpdateSequenceNumber,LogfileSequenceNumber,SecurityId,ObjectIdFileDroid,LoggedUtilStream,ZoneIdContents,SourceFile",
    "prefetch": "Note,SourceFilename,SourceCreated,SourceModified,SourceAccessed,ExecutableName,Hash,Size,Version,RunCount,LastRun,PreviousRun0,PreviousRun1,PreviousRun2,PreviousRun3,PreviousRun4,PreviousRun5,PreviousRun6,Volume0Name,Volume0Serial,Volume0Created,Volume1Name,Volume1Serial,Volume1Created,Directories,FilesLoaded,ParsingError",
    "recycle_bin": "SourceName,FileType,FileName,FileSize,DeletedOn",
}


@dataclass(frozen=True)
class Select:
    """The columns that hold a table's path, its time, and its SHA-1 if it has one."""

    path: str
    time: str
    sha1: str | None = None


SELECTS = {
    "amcache_file_entries": Select("FullPath", "FileKeyLastWriteTimestamp", "SHA1"),
    "amcache_driver_binaries": Select("DriverName", "DriverLastWriteTime", "DriverId"),
    "appcompat_cache": Select("Path", "LastModifiedTimeUTC"),
    "mft": Select("FileName", "Created0x10"),
    "prefetch": Select("ExecutableName", "LastRun"),
    "recycle_bin": Select("FileName", "DeletedOn"),
}


def recognise(columns: list[str] | tuple[str, ...]) -> str | None:
    """The kind of table with exactly these columns in this order."""
    return next((kind for kind, header in HEADERS.items() if header.split(",") == list(columns)), None)


def candidates(df: DataFrame, kind: str, **more: Column) -> DataFrame:
    """kind, evidence_path, basename (lower case), sha1 (null if there is none), evidence_timestamp, and ``more`` columns of the rows."""
    select = SELECTS[kind]
    cell = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    path = cell(select.path)
    return df.select(
        F.lit(kind).alias("kind"),
        path.alias("evidence_path"),
        ascii_fold(F.regexp_extract(path, r"(?s)([^\\/]*)\z", 1)).alias("basename"),
        (F.nullif(ascii_fold(cell(select.sha1)), F.lit("")) if select.sha1 else F.lit(None).cast("string")).alias("sha1"),
        cell(select.time).alias("evidence_timestamp"),
        *[c.alias(name) for name, c in more.items()],
    )


@dataclass(frozen=True)
class Recognised:
    """``rows``: the candidates of all known tables; ``unknown``: paths of files with another header."""

    rows: DataFrame
    unknown: list[str]


def candidates_of_files(spark: SparkSession, files: list[tuple[str, str, str]], run_id: str = "") -> Recognised:
    """Candidates of CSV files (path, host, identity), with their host: a scan for each kind there is. Rows with more or fewer cells than the header are left out."""
    found = headers(spark, [path for path, _, _ in files])
    by_kind: dict[str, list[tuple[str, str, str]]] = {}
    unknown = []
    for file in files:
        kind = recognise(found[file[0]].names)
        if kind is None:
            unknown.append(file[0])
        else:
            by_kind.setdefault(kind, []).append(file)
    parts = []
    for kind, known in by_kind.items():
        scanned = scan_text(spark, known, run_id, multi_line=True, options={"mode": "DROPMALFORMED", "columnPruning": "false"})
        host, file = scanned.columns[-3], scanned.columns[-1]
        parts.append(candidates(scanned, kind, source_file=F.col(f"`{file}`"), host=F.col(f"`{host}`")))
    if not parts:
        return Recognised(spark.createDataFrame([], "kind string, evidence_path string, basename string, sha1 string, evidence_timestamp string, source_file string, host string"), unknown)
    return Recognised(reduce(DataFrame.unionByName, parts), unknown)
