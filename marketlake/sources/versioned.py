"""A bar lake with versions (K1-K3, E11, X-S1): what is live is said by a manifest, not by the folders that lie there.

Layout under the lake's root:

* ``_data/batch=<writer>-<attempt>/asset_class=/timeframe=/symbol_bucket=``: one folder per attempt to write. A failed
  attempt leaves a folder that no manifest names, so it is never read (nor by a scan of a plain lake's own folders);
* ``_manifest/v0000000007.json``: the live folders, the last batch number of every writer, and the folder of the series
  state. The file appears by one rename that fails if the version is there already: a commit is all or nothing, and of two
  writers one starts over from the other's version;
* ``_state/…``: one row per series (``operators.catalog.series_state``), merged with every batch, so that the catalog never
  needs a scan of the lake.

Symbols are dealt over a fixed number of buckets: a folder per symbol and year would be some hundred thousand files of a few
rows in a lake of sixty thousand symbols. Lakes with folders of that kind (``symbol=/year=``) are read as before.

A batch number that its writer has committed is a replay and changes nothing. Replacing series writes the new rows first,
then the other series of the buckets they share, and then names a manifest without the old folders of these buckets; readers
see the old series until the rename and the new ones after it. A lake of plain partition folders is taken over as it lies, by
its first commit. Only folder names pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.catalog import CATALOG_KEY, in_universe, merge_states, series_state
from ..schemas import OHLCV, PARTITION_COLUMNS, SYMBOL_BUCKET, SYMBOL_BUCKETS

MANIFESTS, STATES, DATA, BATCH = "_manifest", "_state", "_data", "batch"
LEVELS = ["asset_class=*", "timeframe=*"]
MAX_ATTEMPTS = 20


class CommitConflict(RuntimeError):
    """Another writer committed the same version first, more often than ``MAX_ATTEMPTS``."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    folders: tuple[str, ...] = ()
    #: Extra columns (name -> type) by folder prefix; "" is the plain lake as a whole.
    layouts: dict[str, dict[str, str]] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)
    state: str | None = None


class Files:
    """The few calls on the lake's file system that a commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.no_options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(self.conf)
        self.root = self.root.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def glob(self, pattern: str) -> list[str]:
        """Names under the root that match, relative to it."""
        found = self.fs.globStatus(self.path(pattern)) or []
        head = self.root.toUri().getPath().rstrip("/") + "/"
        return sorted(status.getPath().toUri().getPath()[len(head):] for status in found)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """The file appears whole, under a name that is free; False if it is taken."""
        draft = self.path(f"{name.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        try:
            context.rename(draft, self.path(name), self.no_options)
            return True
        except Exception as e:  # noqa: BLE001  (py4j wraps the file system's own)
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise


def is_versioned(spark: SparkSession, root: str) -> bool:
    return bool(Files(spark, root).glob(f"{MANIFESTS}/v*.json"))


def bucket_of(symbol: str) -> Column:
    """The bucket of a stored (upper-case) symbol."""
    return F.pmod(F.xxhash64(symbol), F.lit(SYMBOL_BUCKETS)).cast("int")


def below(folder: str, last: str) -> str:
    """The pattern of the folders called ``last`` in the classes and timeframes at or below ``folder``."""
    return "/".join([*([folder] if folder else []), *LEVELS[len(partitions(folder)):], last])


def partitions(folder: str) -> list[str]:
    """``asset_class=…`` and so on of a folder of the lake."""
    return [p for p in folder.split("/")[2 if folder.startswith(DATA) else 0:] if p]


def by_layout(files: Files, folders: Sequence[str]) -> dict[bool, list[str]]:
    """The folders with buckets (True) and those with one folder per symbol (False); one that holds both is given by its parts."""
    found: dict[bool, list[str]] = {}
    for f in folders:
        if len(at := partitions(f)) > 2:
            found.setdefault(at[2].startswith(f"{SYMBOL_BUCKET}="), []).append(f)
            continue
        buckets, symbols = (files.glob(below(f, last)) for last in (f"{SYMBOL_BUCKET}=*", "symbol=*"))
        if buckets and symbols:
            found.setdefault(True, []).extend(buckets)
            found.setdefault(False, []).extend(symbols)
        else:
            found.setdefault(bool(buckets), []).append(f)
    return found


def read_folders(spark: SparkSession, root: str, schema: StructType, folders: Sequence[str], base: str = "") -> DataFrame:
    """Rows of the folders, whichever layout each has, with their bucket."""
    scans = []
    for buckets, some in by_layout(Files(spark, root), folders).items():
        read = StructType([*schema.fields, StructField(SYMBOL_BUCKET, IntegerType())]) if buckets else schema
        found = spark.read.schema(read).option("basePath", f"{root}/{base}" if base else root).parquet(*[f"{root}/{f}" if f else root for f in some])
        scans.append(found if buckets else found.withColumn(SYMBOL_BUCKET, bucket_of("symbol")))
    return reduce(DataFrame.unionByName, scans)


_INTEGRAL = ["tinyint", "smallint", "int", "bigint"]


def wider(a: str, b: str) -> str:
    """The type that holds both: the larger integer, double for other numbers, timestamp for dates, else text."""
    if a == b:
        return a
    if a in _INTEGRAL and b in _INTEGRAL:
        return max(a, b, key=_INTEGRAL.index)
    if all(x in (*_INTEGRAL, "float", "double") or x.startswith("decimal") for x in (a, b)):
        return "double"
    return "timestamp_ntz" if {a, b} == {"date", "timestamp_ntz"} else "string"


def _without(rows: DataFrame, series: DataFrame) -> DataFrame:
    """The rows of other series (a null in the key is a value like any other)."""
    keys = series.select(*[F.col(c).alias(f"__{c}") for c in CATALOG_KEY])
    return rows.join(keys, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in CATALOG_KEY]), "left_anti")


class VersionedLake:
    """Bars under ``root``; every method that writes is one commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # ---- reading

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the given one; of a plain lake, its folders."""
        names = self.files.glob(f"{MANIFESTS}/v*.json")
        if version is not None:
            names = [n for n in names if n.endswith(f"v{version:010d}.json")]
            if not names:
                raise ValueError(f"no version {version}")
        if not names:
            return Manifest(folders=tuple(self.files.glob("asset_class=*")), layouts=self._discovered())
        read = json.loads(self.files.read(names[-1]))
        return Manifest(**{**read, "folders": tuple(read["folders"])})

    def _discovered(self) -> dict[str, dict[str, str]]:
        """Layouts of a plain lake, from the footers of its files, which Spark reads in a job. Where types clash, one
        layout per asset class and timeframe."""
        def extras(folder: str) -> dict[str, str]:
            own: dict[str, str] = {}
            for some in by_layout(self.files, [folder]).values():
                try:
                    found = self.spark.read.option("mergeSchema", True).option("basePath", self.root).parquet(
                        *[f"{self.root}/{f}" if f else self.root for f in some]).schema
                except AnalysisException:
                    continue
                for f in found.fields:
                    if f.name not in OHLCV.names and f.name != SYMBOL_BUCKET:
                        kind = f.dataType.simpleString()
                        if own.setdefault(f.name, kind) != kind:
                            raise ValueError(f"CANNOT_MERGE_SCHEMAS: {f.name} is {own[f.name]} and {kind}")
            return own

        if not self.files.glob("asset_class=*"):
            return {}
        try:
            whole = extras("")
            return {"": whole} if whole else {}
        except Exception as e:  # noqa: BLE001  (not one of PySpark's error classes)
            if "CANNOT_MERGE_SCHEMAS" not in str(e):
                raise
            return {p: own for p in self.files.glob("asset_class=*/timeframe=*") if (own := extras(p))}

    def scan(self, version: int | None = None, extra_schema: StructType | None = None) -> DataFrame:
        """S1 over the live folders, partition columns typed as in ``scan_bars``. Without ``extra_schema``, the extra
        columns of all layouts come along (S3): null where a layout has none, in the widest type where they differ."""
        at = self.manifest(version)
        if extra_schema is not None:
            return self._read(at.folders, {"": {f.name: f.dataType.simpleString() for f in extra_schema.fields}}, forced=True)
        return self._read(at.folders, at.layouts)

    def _layout_of(self, folder: str, layouts: dict[str, dict[str, str]]) -> tuple[tuple[str, str], ...]:
        """Extra columns of a live folder: those of the longest prefix that has any."""
        best = max((p for p in layouts if folder == p or folder.startswith(p + "/") or (not p and not folder.startswith(DATA))),
                   key=len, default=None)
        return tuple(layouts[best].items()) if best is not None else ()

    def _read(self, folders: tuple[str, ...], layouts: dict[str, dict[str, str]] | None = None, forced: bool = False) -> DataFrame:
        return self._read_buckets(folders, layouts, forced).drop(SYMBOL_BUCKET)

    def _read_buckets(self, folders: tuple[str, ...], layouts: dict[str, dict[str, str]] | None = None, forced: bool = False) -> DataFrame:
        layouts = layouts or {}
        if any(p and not p.startswith(DATA) for p in layouts):  # a plain lake of clashing layouts is read by class and timeframe
            folders = tuple(g for f in folders for g in (self.files.glob(f"{f}/timeframe=*") if "/" not in f else [f]))
        groups: dict[tuple, list[str]] = {}
        for f in folders:
            own = tuple(layouts[""].items()) if forced else self._layout_of(f, layouts)
            groups.setdefault((f.startswith(DATA), own), []).append(f)
        merged: dict[str, str] = {}
        for _, own in groups:
            for name, kind in own:
                merged[name] = wider(merged.get(name, kind), kind)
        scans = []
        for (batch, own), paths in groups.items():
            ddl = ", ".join(f"`{n}` {k}" for n, k in own)
            schema = StructType([*OHLCV.fields, *(StructType.fromDDL(ddl).fields if own else [])])
            read = StructType([*schema.fields, StructField(BATCH, StringType())]) if batch else schema
            found = read_folders(self.spark, self.root, read, paths, DATA if batch else "")
            have = dict(own)
            scans.append(found.select(*OHLCV.names, SYMBOL_BUCKET, *[
                (F.col(f"`{n}`") if n in have else F.lit(None)).cast(k).alias(n) for n, k in merged.items()]))
        return reduce(DataFrame.unionByName, scans) if scans else self.spark.createDataFrame([], OHLCV).withColumn(SYMBOL_BUCKET, bucket_of("symbol"))

    def state(self, version: int | None = None) -> DataFrame:
        """One row per series. The lake is scanned only where no commit has written a state yet."""
        at = self.manifest(version or None)
        return self.spark.read.parquet(f"{self.root}/{at.state}") if at.state else series_state(self._read(at.folders))

    # ---- writing

    def _parts_of(self, folder: str) -> list[str]:
        """Bucket folders below a folder, relative to the root; where it has symbol folders, its classes and timeframes."""
        parts = []
        for buckets, some in by_layout(self.files, [folder]).items():
            if buckets:
                parts.extend(p for f in some for p in ([f] if len(partitions(f)) > 2 else self.files.glob(below(f, f"{SYMBOL_BUCKET}=*"))))
            else:
                parts.extend(p for f in some for p in ([f] if len(partitions(f)) > 1 else self.files.glob(below(f, "")[:-1])))
        return parts

    def _with_layout(self, m: Manifest, df: DataFrame, folder: str) -> dict[str, dict[str, str]]:
        extras = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in OHLCV.names}
        return {**m.layouts, folder: extras} if extras else m.layouts

    def _write(self, df: DataFrame, name: str) -> tuple[str, list[str]]:
        from .lake import bar_writer

        folder = f"{DATA}/{BATCH}={name}-{uuid.uuid4().hex[:12]}"
        bar_writer(df).partitionBy(*PARTITION_COLUMNS).parquet(f"{self.root}/{folder}")
        return folder, self.files.glob(below(folder, f"{SYMBOL_BUCKET}=*"))

    def _save_state(self, state: DataFrame) -> str:
        name = f"{STATES}/{uuid.uuid4().hex}"
        state.write.parquet(f"{self.root}/{name}")
        return name

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> Manifest | None:
        for _ in range(MAX_ATTEMPTS):
            before = self.manifest()
            after = change(before)
            if after is None:
                return None
            after = replace(after, version=before.version + 1)
            if self.files.publish(f"{MANIFESTS}/v{after.version:010d}.json", json.dumps(asdict(after))):
                return after
        raise CommitConflict(self.root)

    def append(self, df: DataFrame, writer: str | None = None, number: int = 0, after: int | None = None) -> DataFrame | None:
        """K1: add a batch. Returns the state of its rows alone, or None if ``writer`` has committed this number (or a
        later one) before. ``after``: fail if any version newer than this one is there at the commit."""
        def known(m: Manifest) -> bool:
            return writer is not None and m.writers.get(writer, -1) >= number

        if known(self.manifest()):
            return None
        folder, series = self._write(df, writer or "write")
        own_state = self._save_state(series_state(self._read((folder,) if series else ())))
        own = self.spark.read.parquet(f"{self.root}/{own_state}")
        replayed = False

        def change(m: Manifest) -> Manifest | None:
            nonlocal replayed
            replayed = known(m)
            if after is not None and m.version > after:
                raise CommitConflict(f"{self.root}: version {m.version} came after {after}")
            writers = m.writers if writer is None else {**m.writers, writer: number}
            if replayed or (not series and writer is None):
                return None
            if not series:
                return replace(m, writers=writers)
            state = self._save_state(merge_states(self.state(m.version), own)) if m.folders else own_state
            return replace(m, folders=(*m.folders, folder), layouts=self._with_layout(m, df, folder), writers=writers, state=state)

        self._commit(change)
        return None if replayed else own

    def replace_series(self, df: DataFrame) -> Manifest | None:
        """K2: the series of ``df`` are replaced as a whole, with all their years; other series stay, and are written again where
        they share a bucket with one of those. ``df`` is read once, before anything of the lake changes, so it may derive from
        the lake itself."""
        folder, series = self._write(df, "replace")
        gone = {tuple(partitions(s)) for s in series}
        shared = gone | {g[:2] for g in gone}
        own_state = self._save_state(series_state(self._read((folder,)))) if series else None

        def touched(part: str) -> bool:
            at = tuple(partitions(part))
            return (at if len(at) == 2 or at[2].startswith(f"{SYMBOL_BUCKET}=") else at[:2]) in shared

        def change(m: Manifest) -> Manifest | None:
            if not series:
                return None
            new = self.spark.read.parquet(f"{self.root}/{own_state}")
            live, cut = [], []
            for old in m.folders:
                own = self._parts_of(old)
                kept = [p for p in own if not touched(p)]
                live.extend([old] if len(kept) == len(own) else kept)
                cut.extend(p for p in own if touched(p))
            layouts = self._with_layout(m, df, folder)
            if cut:
                stay = _without(self._read(tuple(cut), m.layouts), new)
                rest, any_left = self._write(stay, "kept")
                live.extend([rest] if any_left else [])
                layouts = self._with_layout(replace(m, layouts=layouts), stay, rest) if any_left else layouts
            state = self._save_state(_without(self.state(m.version), new).unionByName(new)) if m.state else None
            return replace(m, folders=(*live, folder), layouts=layouts, state=state)

        return self._commit(change)

    def rewrite(self, keep: DataFrame, after: int | None = None) -> Manifest:
        """K3: ``keep`` becomes the whole lake (a universe cut, or a compaction of many batches into one). Fails if another
        commit comes in between, since its rows would be lost."""
        started = self.manifest().version if after is None else after
        folder, series = self._write(keep, "rewrite")

        def change(m: Manifest) -> Manifest:
            if m.version != started:
                raise CommitConflict(f"{self.root}: the lake changed while it was rewritten")
            folders = (folder,) if series else ()
            layouts = self._with_layout(replace(m, layouts={}), keep, folder)
            return replace(m, folders=folders, layouts=layouts, state=self._save_state(series_state(self._read(folders))))

        return self._commit(change)

    def keep_universe(self, universe: DataFrame, stock_class: str = "stocks") -> Manifest:
        """K3 in place: non-stock series and the stock series of the universe stay. The universe prunes the folders while the
        query runs, so buckets without any of its symbols are not read."""
        at = self.manifest()
        return self.rewrite(self.in_universe(universe, stock_class, at.version), after=at.version)

    def in_universe(self, universe: DataFrame, stock_class: str = "stocks", version: int | None = None) -> DataFrame:
        """F3/J2 on the partition columns. Blank symbols belong to no universe (and the filter lets Spark prune by it)."""
        listed = universe.select(F.upper("symbol").alias("symbol")).where(F.length(F.trim("symbol")) > 0)
        at = self.manifest(version or None)
        rows = self._read_buckets(at.folders, at.layouts)
        return in_universe(rows, listed.withColumn(SYMBOL_BUCKET, bucket_of("symbol")), stock_class, ["symbol", SYMBOL_BUCKET]).select(
            *[c for c in rows.columns if c != SYMBOL_BUCKET])
