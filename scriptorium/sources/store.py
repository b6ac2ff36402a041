"""Collections: Parquet files of chunks with group-level upserts.

A collection is a folder of data files and of numbered versions. A version says
which files a change added and removed; every ``BASE``-th lists all files, so a
reader reads the last such list and at most ``BASE`` changes, and an append
writes a few lines however many files there are. A change writes new files, for
the rows that it adds and for what is left of the files that it touches, and
then the next version, which appears whole or not at all. So a reader, or a
writer that is stopped, never sees half a change; inserts rewrite nothing, and
upserts and deletes rewrite only files that hold their groups. Rows that are
written are computed once: keys and counts are read from the new files. Two
writers cannot both write one version: the later gets an error.

Each data folder has a table of key filters beside its files: for each file and
key column a Bloom filter in pieces (bitmaps of 2^15 bits, as many as the keys
need). Lookups and upserts of few keys test them first and open only files that
may hold a key; a filter never misses one. Where keys times files exceed
``MOST_TESTS``, the key column of all files is read instead.

A change may carry the id of a stream's batch; one that is already recorded is
not written again. ``compact`` joins small files, ordered by a key's hash. Old
files stay for readers with open plans until ``vacuum``. Folders are reached
through Hadoop's file systems, so a collection may be in any store that Spark
reads and that renames without overwriting.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Versions from one full list of files to the next.
BASE = 50
#: Columns that get key filters, where a collection has them.
KEYS = ("id", "source", "case_identifier", "prompt_hash")
#: Bits of a piece of a key filter, a property of Spark's bitmap functions; bits a key, and tests of one.
PIECE, BITS, TESTS = 1 << 15, 16, 2
#: Numbers of pieces that a file may have: 1, 2, 4, ... (2^20 are for 2^31 rows).
SIZES = 21
#: Keys times files up to which filters are tested.
MOST_TESTS = 100_000_000
#: Bytes of a compacted file, about.
FILE_BYTES = 256 << 20

_FILTERS = "file string, key string, pieces int, piece int, bits binary"


class Collection:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, create: bool = True, keys: tuple[str, ...] = KEYS, properties: dict | None = None):
        """Open, or create from ``schema`` with ``properties`` (as its embedder); with ``create`` off a missing collection is an error."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._file = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(self._conf)
        if not self._numbers():
            if not create or schema is None:
                raise FileNotFoundError(f"no collection at {path}")
            self._publish(0, schema.json(), [], properties=properties)

    # versions: a head as JSON in the first line, then a change a line: + or - and a file

    def _numbers(self) -> list[int]:
        top = self._file(f"{self.path}/_versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _publish(self, number: int, schema: str, added: list[str], removed: list[str] = (), batches: dict[str, int] | None = None, properties: dict | None = None) -> None:
        """Write version ``number``: changes to the one before, or every file if it is a full list."""
        before = self._state(number - 1) if number and number - 1 in self._numbers() else {"files": [], "batches": {}, "properties": properties or {}}
        head = {"schema": schema, "properties": before["properties"], "batches": before["batches"] | (batches or {}), "full": number % BASE == 0}
        if head["full"]:
            gone = set(removed)
            lines = [f"+{f}" for f in [*before["files"], *added] if f not in gone]
        else:
            lines = [*(f"-{f}" for f in removed), *(f"+{f}" for f in added)]
        final, tmp = self._file(f"{self.path}/_versions/{number:020d}"), self._file(f"{self.path}/_versions/_next-{uuid.uuid4().hex}")
        out = self._fs.create(tmp)
        out.write(bytearray("\n".join([json.dumps(head), *lines]).encode()))
        out.close()
        try:  # fails if the version is there already
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(tmp), self._fs.makeQualified(final), self._no_options())
        except Exception as e:
            self._fs.delete(tmp, False)
            raise RuntimeError(f"version {number} of {self.path} was written by another: read it and try again") from e

    def _no_options(self):
        return self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _lines(self, number: int) -> tuple[dict, list[str]]:
        stream = self._fs.open(self._file(f"{self.path}/_versions/{number:020d}"))
        try:
            head, *lines = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
        return json.loads(head), lines

    def _state(self, number: int | None = None) -> dict:
        """A version: its number, schema, files and the last batch of each stream."""
        number = self._numbers()[-1] if number is None else number
        changes, at = [], number
        while True:
            head, lines = self._lines(at)
            changes.append((head, lines))
            if head["full"]:
                break
            at -= 1
        files: dict[str, None] = {}
        for _, lines in reversed(changes):
            for x in lines:
                if x[0] == "-":
                    files.pop(x[1:], None)
                else:
                    files[x[1:]] = None
        return {"number": number, "schema": changes[0][0]["schema"], "files": list(files), "batches": changes[0][0]["batches"], "properties": changes[0][0]["properties"]}

    def _version(self, number: int | None = None) -> tuple[int, str, list[str]]:
        s = self._state(number)
        return s["number"], s["schema"], s["files"]

    @property
    def properties(self) -> dict:
        """What the collection was created with, such as ``embedder`` and ``dim``."""
        return self._state()["properties"]

    def batch(self, stream: str) -> int:
        """The last batch of a stream that is in the collection; -1 if none."""
        return self._state()["batches"].get(stream, -1)

    def _open(self, schema: str, files: list[str]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, *columns: str) -> DataFrame:
        """All rows; only the ``columns`` if named (the rest is never read)."""
        _, schema, files = self._version()
        df = self._open(schema, files)
        return df.select(*columns) if columns else df

    def _written(self, rows: DataFrame) -> list[str]:
        """Rows as new files with their key filters; the files' names. The rows are computed once."""
        name = f"d-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        found = [x.getPath().getName() for x in self._fs.listStatus(self._file(f"{self.path}/{name}"))]
        files = sorted(f"{name}/{f}" for f in found if f.endswith(".parquet"))
        if keys := [k for k in self.keys if k in rows.columns]:
            _filters(self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/{f}" for f in files]), keys).write.parquet(f"{self.path}/{name}/_keys")
        return files

    def _rows(self, files: list[str]) -> int:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in files]).count() if files else 0

    def candidates(self, keys: DataFrame, key: str, files: list[str] | None = None) -> list[str]:
        """The files that may hold one of the ``keys``, by the key filters alone: no data file is opened.

        All files, where there are no filters for ``key`` or so many keys that reading is cheaper.
        """
        files = self._version()[2] if files is None else files
        if key not in self.keys or not files:
            return files
        folders = sorted({f.split("/")[0] for f in files})
        filters = self.spark.read.schema(_FILTERS).parquet(*[f"{self.path}/{d}/_keys" for d in folders]).where(F.col("key") == key)
        keys = keys.select(F.xxhash64(F.col(key).cast("string")).alias("h"))
        if keys.limit(MOST_TESTS // len(files) + 1).count() * len(files) > MOST_TESTS:
            return files
        # a key's piece for every number of pieces that a file may have
        asked = keys.withColumn("pieces", F.explode(F.array(*[F.lit(1 << i) for i in range(SIZES)]))).withColumn("piece", _piece(F.col("h"), F.col("pieces")))
        hit = filters.join(F.broadcast(asked), ["pieces", "piece"])  # MOST_TESTS / files keys at most
        for t in range(TESTS):
            hit = hit.where(_has(F.col("bits"), _place(F.col("h"), t)))
        may = {r[0] for r in hit.select("file").distinct().collect()}  # a name a file
        return [f for f in files if f in may]

    def _holding(self, schema: str, files: list[str], hits) -> list[str]:
        """Those of the files that hold rows of ``hits(all rows)``."""
        if not files:
            return []
        named = self._open(schema, files).withColumn("_file", _file_name())
        return [r[0] for r in hits(named).select("_file").distinct().collect()]  # a name a touched file

    def vacuum(self, keep: int = 1, older_than: float = 7 * 24 * 3600.0) -> int:
        """Delete data and versions that none of the last ``keep`` versions has and that are so many seconds old; how many."""
        numbers = self._numbers()
        used = {f.split("/")[0] for n in numbers[-keep:] for f in self._version(n)[2]}
        stale = lambda x: x.getModificationTime() <= (time.time() - older_than) * 1000
        gone = [x.getPath() for x in self._fs.listStatus(self._file(self.path)) if x.getPath().getName().startswith("d-") and x.getPath().getName() not in used and stale(x)]
        # changes stand on the full list before them
        first = numbers[-keep:][0] // BASE * BASE
        kept = {f"{n:020d}" for n in numbers if n >= first}
        gone += [x.getPath() for x in self._fs.listStatus(self._file(f"{self.path}/_versions")) if x.getPath().getName() not in kept and stale(x)]
        for x in gone:
            self._fs.delete(x, True)
        return len(gone)

    # reads

    def count(self) -> int:
        return self.read().count()

    def where(self, **equal) -> DataFrame:
        """Rows with the given values, of files that may hold them; pushed to Parquet."""
        _, schema, files = self._version()
        for k, v in equal.items():
            if k in self.keys and v is not None:
                files = self.candidates(self._literals([v], k, schema), k, files)
        df = self._open(schema, files)
        for k, v in equal.items():
            df = df.where(F.col(k) == v)
        return df

    def _literals(self, values: list, key: str, schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))[key]
        return self.spark.createDataFrame([(v,) for v in values if v is not None], T.StructType([T.StructField(key, kind.dataType)]))

    def by_ids(self, ids: list | DataFrame, id: str = "id") -> DataFrame:
        """Rows with the given ids: a literal list, or a table of any size by a semi join; of files that may hold them."""
        _, schema, files = self._version()
        if isinstance(ids, DataFrame):
            return self._open(schema, self.candidates(ids, id, files)).join(ids.select(id), id, "left_semi")
        return self._open(schema, self.candidates(self._literals(ids, id, schema), id, files)).where(F.col(id).isin(*ids))

    def has(self, value, id: str = "id") -> bool:
        return not self.by_ids([value], id).isEmpty()

    def peek(self, n: int = 3) -> DataFrame:
        return self.read().limit(n)

    # changes

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows; how many."""
        s = self._state()
        if self._seen(s, batch):
            return 0
        new = self._written(self._fitted(rows))
        self._publish(s["number"] + 1, s["schema"], new, batches=dict([batch] if batch else []))
        return self._rows(new)

    @staticmethod
    def _seen(state: dict, batch: tuple[str, int] | None) -> bool:
        return batch is not None and state["batches"].get(batch[0], -1) >= batch[1]

    def insert_absent(self, rows: DataFrame, id: str = "id") -> tuple[int, int]:
        """Insert rows whose id is new, once each; (inserted, skipped). The rows are computed once."""
        number, schema, files = self._version()
        given = self._written(self._fitted(rows))
        df = self._open(schema, given)
        total = self._rows(given)
        fresh = absent(df, self._open(schema, self.candidates(df, id, files)), id)
        new = given if fresh.count() == total else self._written(fresh)
        self._publish(number + 1, schema, new)
        return (n := self._rows(new)), total - n

    def replace_groups(self, rows: DataFrame, key: str, batch: tuple[str, int] | None = None) -> DataFrame:
        """Replace every group of ``key`` that ``rows`` has; others stay. Returns the rows as they are stored.

        The rows are written first, so what is computed once decides both the
        groups that go and what replaces them. With ``batch`` (stream, id), a
        batch that the collection has is left out.
        """
        s = self._state()
        if self._seen(s, batch):
            return self._open(s["schema"], [])
        new = self._written(self._fitted(rows))
        df = self._open(s["schema"], new)
        keys = df.select(key).distinct()
        may = self.candidates(keys, key, s["files"])
        touched = self._holding(s["schema"], may, lambda df: df.join(keys, key, "left_semi"))
        rest = self._written(self._open(s["schema"], touched).join(keys, key, "left_anti")) if touched else []
        self._publish(s["number"] + 1, s["schema"], rest + new, touched, dict([batch] if batch else []))
        return df

    def replace_changed(self, rows: DataFrame, key: str = "source", mark: str = "file_hash") -> DataFrame:
        """As ``replace_groups``, for groups whose ``mark`` is not stored yet; returns (key, status), of the store as it was."""
        state = changed(rows.select(key, mark).distinct(), self.read(key, mark), key, mark)
        self.replace_groups(rows.join(state.where("status = 'ingested'").select(key), key, "left_semi"), key)
        return state

    def _drop(self, may: list[str], hits, left) -> int:
        """Rewrite the files that hold hits with what is left of them; how many rows went."""
        number, schema, _ = self._version()
        touched = self._holding(schema, may, hits)
        if not touched:
            return 0
        new = self._written(left(self._open(schema, touched)))
        self._publish(number + 1, schema, new, touched)
        return self._rows(touched) - self._rows(new)

    def delete(self, condition: Column) -> int:
        """Delete the rows for which ``condition`` is true; how many."""
        return self._drop(self._version()[2], lambda df: df.where(condition), lambda df: df.where(~F.coalesce(condition, F.lit(False))))

    def delete_ids(self, ids: DataFrame, id: str = "id") -> int:
        ids = ids.select(id).distinct()
        return self._drop(self.candidates(ids, id), lambda df: df.join(ids, id, "left_semi"), lambda df: df.join(ids, id, "left_anti"))

    def truncate(self, group: str | None = None) -> DataFrame | None:
        """Delete everything; with ``group``, returns the rows that each group had (from the files, which stay until ``vacuum``)."""
        number, schema, files = self._version()
        self._publish(number + 1, schema, [], files)
        if group:
            return self._open(schema, files).groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(group)
        return None

    def compact(self, file_bytes: int = FILE_BYTES, key: str | None = None) -> int:
        """Join files of under half of ``file_bytes``, ordered by the hash of ``key`` if named; how many went."""
        number, schema, files = self._version()
        sizes = {f: self._fs.getFileStatus(self._file(f"{self.path}/{f}")).getLen() for f in files}
        small = [f for f in files if sizes[f] * 2 < file_bytes]
        if len(small) < 2:
            return 0
        n = max(1, -(-sum(sizes[f] for f in small) // file_bytes))
        rows = self._open(schema, small)
        rows = rows.repartitionByRange(n, F.xxhash64(key)) if key else rows.coalesce(n)
        self._publish(number + 1, schema, self._written(rows), small)
        return len(small)

    def _fitted(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the collection's columns; what they lack is null."""
        have = {f.name: f for f in T.StructType.fromJson(json.loads(self._version()[1]))}
        return rows.select(*[(F.col(k) if k in rows.columns else F.lit(None)).cast(f.dataType).alias(k) for k, f in have.items()])


def _file_name() -> Column:
    return F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2))


def _piece(h: Column, pieces: Column) -> Column:
    """The piece of a filter of so many that a key's hash is in: its upper bits."""
    return F.pmod(F.shiftrightunsigned(h, 40), pieces).cast("int")


def _place(h: Column, test: int) -> Column:
    """The bit of a test, 0 .. PIECE - 1: two runs of the hash's lower bits."""
    return F.shiftrightunsigned(h, 15 * test).bitwiseAND(F.lit(PIECE - 1))


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)).cast("int"))) != 0


def _filters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The key filters of files: (file, key, pieces, piece, bits). A file has as many pieces as its rows may need, a power of two; empty ones are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.when(F.col(k).isNotNull(), F.xxhash64(F.col(k).cast("string"))).alias("h")) for k in keys]))
    named = rows.select(_file_name().alias("file"), each.alias("x")).select("file", "x.key", "x.h").where("h is not null")
    # one shuffle, by file and key: their rows are counted and folded where they are
    n = F.count(F.lit(1)).over(Window.partitionBy("file", "key"))
    sized = named.withColumn("pieces", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), n * BITS / PIECE)))).cast("int"))
    places = F.explode(F.array(*[_place(F.col("h"), t) for t in range(TESTS)]))
    spread = sized.withColumn("piece", _piece(F.col("h"), F.col("pieces"))).select("file", "key", "pieces", "piece", places.alias("place"))
    return spread.groupBy("file", "key", "pieces", "piece").agg(F.bitmap_construct_agg("place").alias("bits"))


def absent(rows: DataFrame, stored: DataFrame, id: str) -> DataFrame:
    """Rows whose id is not stored, one for each id."""
    return rows.join(stored.select(id), id, "left_anti").dropDuplicates([id])


def upserted(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Stored rows of other groups, and ``rows``."""
    return stored.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def changed(rows: DataFrame, stored: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, status): skipped if any stored row of the key has its mark, else ingested."""
    known = stored.select(key, mark).distinct().withColumn("known", F.lit(True))
    return rows.join(known, [key, mark], "left").select(key, F.when(F.col("known"), "skipped").otherwise("ingested").alias("status"))


def without_nulls(df: DataFrame, filler: str = "") -> DataFrame:
    """``filler`` (the notebook's store has "unknown") for null strings: stored metadata has no nulls."""
    return df.fillna(filler, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])
