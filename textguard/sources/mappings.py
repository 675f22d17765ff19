"""The stored mapping table.

``write_mappings`` and ``read_mappings`` are the plain form: a parquet folder that only grows,
partitioned by day of expiry. ``MappingTable`` is the kept form: a log of versions names the folders in force,
so that stores of a stream can be repeated, days can be merged and old days dropped
while others read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textguard.operators.protection import SET_SCHEMA, live_sets, utc_day
from textguard.operators.sketches import LG_K, request_sketches
from textguard.sources.storage import remove

TABLE_SCHEMA = SET_SCHEMA + ", expires_on date"


def write_mappings(sets: DataFrame, path: str) -> None:
    """Append mapping sets. A failed job commits nothing."""
    dated = sets.withColumn("expires_on", F.to_date("expires_at"))
    dated.write.mode("append").partitionBy("expires_on").parquet(path)


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """All stored sets; choose the newest per request with ``newest_sets``."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def purge_expired(
    spark: SparkSession, path: str, target: str, now: Column, one_ttl: bool = False
) -> DataFrame:
    """Copy the live sets of the plain form into a new folder, leaving out expired and replaced ones.

    A replaced set may outlive its successor, so the newest is chosen first: dropping
    only the expired successor would bring the older set back. With ``one_ttl`` that
    cannot happen and whole expired days are never read. ``MappingTable.purge`` copies less.
    """
    kept = live_sets(read_mappings(spark, path), now, one_ttl)
    kept.write.partitionBy("expires_on").parquet(target)
    return read_mappings(spark, target)


def day_of(moment: datetime) -> date:
    """The UTC day of a Python time; one without a zone is UTC."""
    return (moment if moment.tzinfo is None else moment.astimezone(timezone.utc)).date()


class MappingTable:
    """Mapping sets in folders by day of expiry (UTC), and a log of which folders are in force.

    A version of the log is one small JSON file that is written aside and renamed to its number, which
    fails if the number is taken; a writer that comes second reads the new version and tries
    again. Whoever reads has the folders of one version, so nobody sees a change by half. Folders
    that no version names, such as those of a job that died, are never read. The rename must
    not replace a file, as on HDFS and local disks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._place("").getFileSystem(self._conf)

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names below a folder with their times of change, in ms."""
        place = self._place(folder)
        if not self._fs.exists(place):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(place)]

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._names("_log") if n.endswith(".json"))

    def log(self, version: int | None = None) -> dict:
        """``entries`` (folder, day, stream, batch) in force and the last batch of each stream."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"entries": [], "streams": {}}
        stream = self._fs.open(self._place(f"_log/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, log: dict) -> bool:
        aside = self._place(f"_log/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(log).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = self._place(f"_log/{version}.json")
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), none)
            return True
        except Exception:
            self._fs.delete(aside, False)
            if not self._fs.exists(target):  # not because someone else was first
                raise
            return False

    def _change(self, change: Callable[[dict], dict | None]) -> bool:
        """Commit what ``change`` makes of the log, of a newer one if need be; None gives up."""
        while True:
            version = max(self.versions(), default=0)
            new = change(self.log(version))
            if new is None:
                return False
            if self._commit(version + 1, new):
                return True

    def _write(self, sets: DataFrame) -> tuple[str, list[dict]]:
        """Sets in a new folder, a part for each day, sorted so that files know their range of ids."""
        folder = f"data/{uuid.uuid4().hex}"
        names = ["request_id", "mappings", "stored_at", "expires_at"]
        rows = sets.select(*names, utc_day("expires_at").alias("expires_on")).withColumn("day", F.col("expires_on"))
        rows.write.partitionBy("day").parquet(f"{self.path}/{folder}")
        days = [n.removeprefix("day=") for n, _ in self._names(folder) if n.startswith("day=")]
        entries = [{"folder": f"{folder}/day={d}", "day": d} for d in sorted(days)]
        # beside them, as names with an underscore are no data: who expires when, in a few KB a day
        request_sketches(self._frame(entries)).coalesce(1).write.parquet(f"{self.path}/{folder}/_requests")
        return folder, entries

    def store(self, sets: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        """Add sets. A batch of a stream that is stored again takes the place of what it stored before;
        one that has been merged already is left as it is."""
        if stream is not None:
            log = self.log()
            if batch <= log["streams"].get(stream, -1) and not any((e.get("stream"), e.get("batch")) == (stream, batch) for e in log["entries"]):
                return
        folder, added = self._write(sets)
        if stream is not None:
            added = [{**e, "stream": stream, "batch": batch} for e in added]

        def change(log: dict) -> dict:
            kept = [e for e in log["entries"] if stream is None or (e.get("stream"), e.get("batch")) != (stream, batch)]
            last = {} if stream is None else {stream: max(batch, log["streams"].get(stream, -1))}
            return {"entries": kept + added, "streams": {**log["streams"], **last}}

        self._change(change)

    def _frame(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], TABLE_SCHEMA)
        return self.spark.read.schema(TABLE_SCHEMA).parquet(*[f"{self.path}/{e['folder']}" for e in entries])

    def read(self, since: date | None = None, version: int | None = None) -> DataFrame:
        """Sets in force that expire on ``since`` or later; other days are not even listed. Choose the
        newest per request with ``newest_sets``."""
        entries = self.log(version)["entries"]
        return self._frame([e for e in entries if since is None or e["day"] >= since.isoformat()])

    def _replace(self, old: list[dict], rows: DataFrame) -> bool:
        """Put rows in the place of the folders they were made from, unless those changed meanwhile."""
        folder, added = self._write(rows)

        def change(log: dict) -> dict | None:
            if not all(e in log["entries"] for e in old):
                return None
            return {**log, "entries": [e for e in log["entries"] if e not in old] + added}

        done = self._change(change)
        if not done:
            remove(self.spark, f"{self.path}/{folder}")
        return done

    def compact(self) -> bool:
        """Merge each day that lies in several folders to the newest set per request; other days are not
        read. Of one day, a replaced set never matters; over days the reader still
        chooses. False if there was nothing to do or another writer was first."""
        entries = self.log()["entries"]
        days = [e["day"] for e in entries]
        old = [e for e in entries if days.count(e["day"]) > 1]
        if not old:
            return False
        latest = Window.partitionBy("request_id", "expires_on").orderBy(
            F.col("stored_at").desc(), F.col("expires_at").desc(), F.xxhash64("mappings")
        )
        rows = self._frame(old).withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")
        return self._replace(old, rows.sortWithinPartitions("expires_on", "request_id"))

    def purge(self, now: datetime, max_ttl: timedelta) -> None:
        """Forget what can no longer matter if no set lives longer than ``max_ttl``.

        Days before ``now - max_ttl`` hold neither live sets nor their successors: they leave the log unread.
        From there to today expired sets lose their sealed values, but stay as marks that they
        have replaced older ones. Later days are untouched.
        """
        first, today = day_of(now - max_ttl).isoformat(), day_of(now).isoformat()
        self._change(lambda log: {**log, "entries": [e for e in log["entries"] if e["day"] >= first]})
        moment = now if now.tzinfo is not None else now.replace(tzinfo=timezone.utc)
        at = F.timestamp_micros(F.lit(int(moment.timestamp() * 1_000_000)))
        while True:
            border = [e for e in self.log()["entries"] if e["day"] <= today]
            dead = (F.col("expires_at") <= at) & (F.size("mappings") > 0)
            if not border or not self._frame(border).filter(dead).head(1):
                return
            nothing = F.filter("mappings", lambda m: F.lit(False))
            if self._replace(border, self._frame(border).withColumn("mappings", F.when(dead, nothing).otherwise(F.col("mappings")))):
                return

    def sketched_requests(self, now: datetime) -> DataFrame:
        """``live_requests``: about how many requests have a live set, see ``operators.sketches`` for the error.

        Days after today are counted by the sketches that each store has left; only today's
        sets are read, and of those no sealed value. A request stored again counts once. One whose set was
        replaced by a set that expires earlier counts until the older one would have expired.
        """
        entries, today = self.log()["entries"], day_of(now).isoformat()
        moment = now if now.tzinfo is not None else now.replace(tzinfo=timezone.utc)
        border = self._frame([e for e in entries if e["day"] == today])
        border = border.filter(F.unix_micros("expires_at") > int(moment.timestamp() * 1_000_000))
        sketches = border.agg(F.hll_sketch_agg("request_id", LG_K).alias("requests"))
        roots = sorted({e["folder"].rsplit("/", 1)[0] for e in entries if e["day"] > today})
        if roots:
            later = self.spark.read.schema("expires_on date, requests binary").parquet(*[f"{self.path}/{r}/_requests" for r in roots])
            sketches = sketches.unionByName(later.filter(F.col("expires_on") > F.lit(today).cast("date")).select("requests"))
        return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("requests")).alias("live_requests"))

    def vacuum(self, older_than: timedelta = timedelta(hours=1)) -> None:
        """Delete older versions and the folders that the newest does not name, if nothing has changed in
        them for ``older_than``: the time that readers and jobs under way may take."""
        cut = (datetime.now(timezone.utc) - older_than).timestamp() * 1000
        for version in self.versions()[:-1]:
            status = self._fs.getFileStatus(self._place(f"_log/{version}.json"))
            if status.getModificationTime() <= cut:
                self._fs.delete(status.getPath(), False)
        named = {e["folder"] for v in self.versions() for e in self.log(v)["entries"]}
        for folder, changed in self._names("data"):
            if changed <= cut:
                days = [n for n, _ in self._names(f"data/{folder}") if n.startswith("day=")]
                for day in days:
                    if f"data/{folder}/{day}" not in named:
                        self._fs.delete(self._place(f"data/{folder}/{day}"), True)
                if not any(f"data/{folder}/{d}" in named for d in days):
                    self._fs.delete(self._place(f"data/{folder}"), True)
