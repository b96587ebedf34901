"""A log-structured table: every write adds one segment, and small segments are merged into larger ones.

A segment holds rows and, for each key that it writes, a head with the sequence number of the write and a hash of the
key's content; a head without a hash is a tombstone.  The newest head of a key decides which of its rows are live, so
replacing a key writes its rows and one head, however large the table is.  Segments of like size are merged once there
are enough of them, so a row is written again only about as often as the table has levels.

Rows lie in buckets by the hash of their key.  The number of buckets of a segment follows from its size, so that the
rows of a few keys are found by reading a few bounded folders in each segment.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_SEQ, _HASH, _BUCKET, _PART = "_seq", "_hash", "_bucket", "_part"
MOST_BUCKETS = 4096


@dataclass(frozen=True)
class Segment:
    name: str
    level: int
    rows: int
    heads: int
    buckets: int
    #: number of the last write that it holds, below zero for a merge; 0 if not known
    write: int = 0


@dataclass(frozen=True)
class Staged:
    """Rows that lie in the table's folder, but are not seen before they are put."""

    name: str
    buckets: int
    seq: int
    n: int
    rows: DataFrame


class LogTable:
    """A keyed table in a folder.  ``fan`` segments of one level make one of the next; a bucket has about ``bucket_rows``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", fan: int = 4, small_rows: int = 10_000, bucket_rows: int = 50_000):
        self.spark, self.path, self.key = spark, path, key
        self.fan, self.small_rows, self.bucket_rows = fan, small_rows, bucket_rows

    # -- the list of segments

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        place, system = self._folder("log")
        if not system.exists(place):
            return []
        done = (f.getPath().getName() for f in system.listStatus(place) if f.isDirectory())
        return sorted(int(n) for n in done if n.isdigit() and system.exists(self._folder(f"log/{n}/_SUCCESS")[0]))

    def state(self) -> tuple[int, int, list[Segment]]:
        """Version of the list, number of the last write and the segments; a list is seen only when it is whole."""
        versions = self._versions()
        if not versions:
            return 0, 0, []
        saved = json.loads(self.spark.read.text(f"{self.path}/log/{versions[-1]}").first()[0])
        return versions[-1], saved["seq"], [Segment(**s) for s in saved["segments"]]

    def last_batch(self) -> int | None:
        versions = self._versions()
        return json.loads(self.spark.read.text(f"{self.path}/log/{versions[-1]}").first()[0])["batch"] if versions else None

    def _commit(self, version: int, seq: int, batch: int | None, segments: list[Segment]) -> None:
        line = json.dumps({"seq": seq, "batch": batch, "segments": [asdict(s) for s in segments]})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.path}/log/{version}")

    # -- writing

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def buckets_for(self, n: int) -> int:
        buckets = 1
        while buckets * self.bucket_rows < n and buckets < MOST_BUCKETS:
            buckets *= 2
        return buckets

    def deal(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Rows in the partitions from which buckets are written, the rows of a key together; the columns say where."""
        part = F.pmod(F.xxhash64(self.key, F.lit(3)), F.lit(4)).cast("int")
        return rows.withColumns({_BUCKET: self._bucket(buckets), _PART: part}).repartition(_BUCKET, _PART)

    def stage(self, rows: DataFrame, buckets: int, seq: int | None = None) -> Staged:
        """Write rows, those of ``deal`` as they lie, for a ``put`` to come; without one they are as good as not there."""
        name, seq = str(uuid.uuid4()), self.state()[1] + 1 if seq is None else seq
        if _SEQ not in rows.columns:
            rows = rows.withColumn(_SEQ, F.lit(seq).cast("long"))
        if buckets > 1:
            path = f"{self.path}/data/{name}/dealt"
            dealt = rows if _BUCKET in rows.columns else self.deal(rows, buckets)
            dealt.drop(_PART).write.partitionBy(_BUCKET).parquet(path)
        else:
            path = f"{self.path}/data/{name}/rows"
            rows.write.parquet(path)
        kept = [f for f in rows.schema if f.name not in (_BUCKET, _PART)]
        # without any row there are no folders from which the type of the bucket could be read
        written = self.spark.read.schema(StructType([*kept, StructField(_BUCKET, IntegerType())] if buckets > 1 else kept)).parquet(path)
        n = written.count()
        if buckets > 1 and not n:
            return self.stage(self.spark.createDataFrame([], StructType(kept)), 1, seq)
        return Staged(name, buckets, seq, n, written.drop(_BUCKET))

    def unstage(self, staged: Staged) -> None:
        place, system = self._folder(f"data/{staged.name}")
        system.delete(place, True)

    def _write(self, rows: DataFrame | Staged, heads: DataFrame, expect: int | None, seq: int) -> Segment:
        """A segment: in one pass if ``expect`` says about how many rows there will be, which gives the buckets."""
        staged = rows if isinstance(rows, Staged) else self.stage(rows, 1 if expect is None else self.buckets_for(expect), seq)
        if expect is None and staged is not rows and self.buckets_for(staged.n) > 1:
            plain, staged = staged, self.stage(staged.rows, self.buckets_for(staged.n), seq)
            self.unstage(plain)
        name = staged.name
        heads.write.parquet(f"{self.path}/data/{name}/heads")
        keys = self.spark.read.schema(heads.schema).parquet(f"{self.path}/data/{name}/heads").count()
        level = 0
        while max(staged.n, keys) >= self.small_rows * self.fan ** (level + 1):
            level += 1
        return Segment(name, level, staged.n, keys, staged.buckets, seq)

    def put(self, rows: DataFrame | Staged, heads: DataFrame, batch: int | None = None, expect: int | None = None) -> bool:
        """Replace the keys of ``heads (key, content_hash)`` by ``rows``; a null hash removes a key.

        ``expect`` is about how many rows there are; without it rows are written twice, to be counted first.  Staged
        rows must be those of all ``heads``, staged since the last write.  A batch number that is not above the last
        one has been written before, and is left out: False.
        """
        version, seq, segments = self.state()
        if batch is not None and version and (self.last_batch() or -1) >= batch:
            return False
        marked = heads.select(self.key, F.lit(seq + 1).cast("long").alias(_SEQ), F.col("content_hash").cast("string").alias(_HASH))
        if isinstance(rows, Staged) and rows.seq != seq + 1:
            raise ValueError("the table was written after these rows were staged")
        segment = self._write(rows, marked, expect, seq + 1)
        if segment.heads:
            segments = [*segments, segment]
        self._commit(version + 1, seq + 1, batch if batch is not None else self.last_batch(), segments)
        self.compact()
        return True

    def compact(self) -> int:
        """Merge levels that have enough segments; the number of merges."""
        merges = 0
        while True:
            version, seq, segments = self.state()
            level = next((v for v in sorted({s.level for s in segments}) if sum(s.level == v for s in segments) >= self.fan), None)
            if level is None:
                return merges
            chosen = [s for s in segments if s.level == level]
            heads = self._newest(chosen)
            # a tombstone is needed as long as an older segment may hold rows of its key
            if len(chosen) == len(segments):
                heads = heads.where(f"{_HASH} is not null")
            last = max(abs(s.write) for s in chosen) if all(s.write for s in chosen) else 0
            merged = self._write(self._live(chosen, None), heads, sum(s.rows for s in chosen), last)
            # a merge may stay on its level, as keys are replaced; it counts as the next one, or merging would not end
            merged = Segment(merged.name, max(merged.level, level + 1), merged.rows, merged.heads, merged.buckets, -last)
            kept = [s for s in segments if s.level != level]
            self._commit(version + 1, seq, self.last_batch(), [*kept, merged])
            merges += 1

    def vacuum(self) -> int:
        """Delete segments that the present list does not name, and older lists; for times without readers of those."""
        version, _, segments = self.state()
        named, gone = {s.name for s in segments}, 0
        for folder, keep in (("data", named), ("log", {str(version)})):
            place, system = self._folder(folder)
            for f in system.listStatus(place) if system.exists(place) else ():
                if f.getPath().getName() not in keep:
                    system.delete(f.getPath(), True)
                    gone += 1
        return gone

    # -- reading

    def _newest(self, segments: list[Segment]) -> DataFrame:
        every = None
        for s in segments:
            part = self.spark.read.parquet(f"{self.path}/data/{s.name}/heads")
            every = part if every is None else every.unionByName(part)
        newest = every.groupBy(self.key).agg(F.max(F.struct(_SEQ, _HASH)).alias("_head"))
        return newest.select(self.key, f"_head.{_SEQ}", f"_head.{_HASH}")

    def _live(self, segments: list[Segment], keys: DataFrame | None) -> DataFrame:
        last = max(segments, key=lambda s: abs(s.write))
        # no head is newer than those of the last write, so its rows need not meet any
        newest = [last] if last.write > 0 and all(s.write for s in segments) else []
        rest = self._latest([s for s in segments if s not in newest], segments, keys)
        if not newest:
            return rest
        rows = self._rows(newest, keys)
        return rows if rest is None else rest.unionByName(rows, allowMissingColumns=True)

    def _rows(self, segments: list[Segment], keys: DataFrame | None) -> DataFrame | None:
        """All rows, or those of some keys."""
        out = None
        for s in segments:
            part = self.spark.read.parquet(f"{self.path}/data/{s.name}/{'dealt' if s.buckets > 1 else 'rows'}")
            if s.buckets > 1:
                if keys is not None:
                    # at most MOST_BUCKETS numbers
                    wanted = [r[0] for r in keys.select(self._bucket(s.buckets)).distinct().collect()]
                    part = part.where(F.col(_BUCKET).isin(wanted))
                part = part.drop(_BUCKET)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if keys is not None and out is not None:
            out = out.join(keys.select(self.key).distinct(), self.key, "left_semi")
        return out

    def _latest(self, chosen: list[Segment], segments: list[Segment], keys: DataFrame | None) -> DataFrame | None:
        """The rows of the chosen segments that no head of any segment replaces."""
        out = self._rows(chosen, keys)
        if out is None:
            return None
        # only keys that were written twice or removed have dead rows
        heads = None
        for s in segments:
            part = self.spark.read.parquet(f"{self.path}/data/{s.name}/heads")
            heads = part if heads is None else heads.unionByName(part)
        replaced = heads.groupBy(self.key).agg(F.max(F.struct(_SEQ, _HASH)).alias("_head"), F.count("*").alias("_n")).where(
            f"_n > 1 or _head.{_HASH} is null").select(self.key, F.when(F.col(f"_head.{_HASH}").isNotNull(), F.col(f"_head.{_SEQ}")).otherwise(-1).alias("_at"))
        return out.join(replaced, self.key, "left").where(F.col("_at").isNull() | (F.col("_at") == F.col(_SEQ))).drop("_at")

    def read(self, keys: DataFrame | None = None, version: str | None = None) -> DataFrame | None:
        """The live rows, or those of some keys; ``version`` names a column for the number of the write.  None before a write."""
        _, _, segments = self.state()
        if not segments:
            return None
        rows = self._live(segments, keys)
        return rows.withColumnRenamed(_SEQ, version) if version else rows.drop(_SEQ)

    def heads(self) -> DataFrame | None:
        """``(key, content_hash)`` of the keys that are there."""
        _, _, segments = self.state()
        if not segments:
            return None
        return self._newest(segments).where(f"{_HASH} is not null").select(self.key, F.col(_HASH).alias("content_hash"))
