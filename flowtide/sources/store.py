"""The table store: partial-aggregate Parquet tables partitioned by day and batch.

A batch appends rows that can still be merged instead of updating rows in
place. ``d`` (UTC day of the bucket) prunes scans; ``batch`` lets a replayed
batch overwrite exactly what it wrote before. Compaction folds finished batches
of a day into ``batch=-1``; those rows are merged already and are read without
a shuffle as far as no later batch has touched their buckets.

With the compacted rows of a rollup go the same sums by hour and by day, as
batches -2 and -3. A window is answered from days inside it, hours at its
edges and minutes beside those (``spans``); rows of later batches are added at
the minute. Levels are replaced together with the rows they are made of. So is
the list of each day's heaviest sources and destinations (batch -4), from which
a report learns how heavy a key must be to matter (``heavy_parts``).

Folded conversations and statistics are ordered by the interleaved hashes of
source, destination and exporter and carry Bloom filters, so that a filter on
one of them skips most row groups.

A write notes the first and last bucket of its rows per day and batch (a name
in a small folder per day, or one file for a write of many days). A read lists
the days of its window only and opens only batches whose note meets it; a
missing note means that the batch may hold anything, so notes may get lost.

Retention never rewrites data: whole days are dropped, and a horizon per table
hides what is left over on the day it falls into until compaction removes it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide import schemas
from flowtide.operators import clustering, condense, rollups
from flowtide.operators.filters import BUCKET, between, instant, on_days, utc
from flowtide.sources import files

COMPACTED = -1
LEVELS = {-2: 3_600, -3: 86_400}
HOURS, DAYS = LEVELS
# The heaviest keys of a folded day, of rollups that may have very many.
HEAVY, HEAVY_KEYS = -4, 1_000
LISTED = ("src_1m", "dst_1m")
KEPT_NOTES = 8
# Up to so many days are listed and noted one by one, more of them together.
FEW_DAYS = 4
# Folder of the files that note many days.
MANY = "many"
# Exact borders of settled rows per day, as far as they have few times of day; else they are rounded down to hours.
BORDERS = 24
UNIX_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

EVENT_TABLES = {
    "conversations": (schemas.CONVERSATION_PARTIALS, "bucket_start"),
    "statistics": (schemas.STATISTICS, "bucket_start"),
    **{name: (schema, "bucket") for name, schema in schemas.ROLLUPS.items()},
    "distinct_1m": (schemas.SKETCHES, "bucket"),
}
# Folded days of these are laid out for filters on one host or device.
CLUSTERED = ("conversations", "statistics")
LEVELED = (*schemas.ROLLUPS, "distinct_1m")
LOG_TABLES = {
    "batch_log": (schemas.BATCH_LOG, "ts"),
    "quarantine": (schemas.QUARANTINE, "received_at"),
    "stream_progress": (schemas.STREAM_PROGRESS, "ts"),
}
TABLES = {**EVENT_TABLES, **LOG_TABLES}
DIMENSIONS = {
    "exporters": schemas.EXPORTERS,
    "interfaces": schemas.INTERFACES,
    "ip_names": schemas.IP_NAMES,
    "dns_cache": schemas.DNS_CACHE,
    "port_descriptions": schemas.PORT_DESCRIPTIONS,
}
_SPAN = [T.StructField("first", T.TimestampType()), T.StructField("last", T.TimestampType())]
_PARTITION = [T.StructField("d", T.DateType()), T.StructField("batch", T.LongType())]


def merge_table(name: str, rows: DataFrame) -> DataFrame:
    """One row per key of an event table."""
    if name == "conversations":
        return condense.merge(rows)
    if name == "statistics":
        return rollups.merge_sums(rows, rollups.STATS_KEY)
    if name in schemas.ROLLUPS:
        return rollups.merge_sums(rows, rollups.rollup_key(name))
    if name == "distinct_1m":
        return rollups.merge_sketches(rows)
    return rows


def _micros(moment: datetime) -> int:
    return (utc(moment) - UNIX_EPOCH) // timedelta(microseconds=1)


def midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=timezone.utc)


@dataclass(frozen=True)
class Zone:
    """What a batch holds of a day: first and last bucket, and rows."""

    low: datetime
    high: datetime
    rows: int


@dataclass(frozen=True)
class HeavyParts:
    """A window's rows: heaviest keys of its whole days, those days' rows (one per key and day), the rest; number of days."""

    lists: DataFrame
    whole: DataFrame
    rest: DataFrame
    days: int


@dataclass(frozen=True)
class TableStore:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def staging(self) -> str:
        return f"{self.root}/_staging"

    def recover(self) -> None:
        files.resume_swaps(self.spark, self.staging)

    # -- partitions ---------------------------------------------------------

    def partitions(self, name: str) -> dict[date, list[int]]:
        """Batch numbers stored per day; levels are no batches."""
        return {day: [b for b in found if b >= COMPACTED] for day, found in self.folders(name, self.days(name)).items()}

    def days(self, name: str) -> list[date]:
        return [date.fromisoformat(d[2:]) for d in files.subdirs(self.spark, self.path(name), "d=")]

    def _folders(self, name: str, day: date) -> list[int]:
        return sorted(int(b[6:]) for b in files.subdirs(self.spark, f"{self.path(name)}/d={day}", "batch="))

    def folders(self, name: str, days: list[date]) -> dict[date, list[int]]:
        """Batch numbers and levels stored per day."""
        if len(days) <= FEW_DAYS:
            return {day: self._folders(name, day) for day in days}
        out: dict[date, list[int]] = {day: [] for day in days}
        for day, batch in files.partitions(self.spark, self.path(name), "d", "batch"):
            out.get(date.fromisoformat(day), []).append(int(batch))
        return {day: sorted(found) for day, found in out.items()}

    def batches(self, name: str, day: date) -> list[int]:
        return [b for b in self._folders(name, day) if b >= COMPACTED]

    # -- notes about batches -----------------------------------------------------

    def _zone_dir(self, name: str, day: date) -> str:
        return f"{self.root}/_zones/{name}/{day}"

    def zones(self, name: str, day: date) -> dict[int, Zone]:
        """What is noted about the batches of a day."""
        return self._zones_of(name, [day])[day]

    def _zones_of(self, name: str, days: list[date]) -> dict[date, dict[int, Zone]]:
        moment = lambda m: UNIX_EPOCH + timedelta(microseconds=m)
        out: dict[date, dict[int, Zone]] = {day: {} for day in days}
        folders = set(files.marks(self.spark, f"{self.root}/_zones/{name}"))
        for _, noted in self._many(f"{self.root}/_zones/{name}") if MANY in folders else []:
            for day, batch, low, high, rows in noted:
                if (day := date.fromisoformat(day)) in out:
                    out[day][batch] = Zone(moment(low), moment(high), rows)
        for day in days:
            for mark in files.marks(self.spark, self._zone_dir(name, day)) if str(day) in folders else []:
                batch, low, high, rows = map(int, mark.split("_"))
                out[day][batch] = Zone(moment(low), moment(high), rows)
        return out

    def _many(self, folder: str) -> list[tuple[str, list]]:
        """The files of a folder that note many days, and what they say."""
        out = []
        for mark in files.marks(self.spark, f"{folder}/{MANY}"):
            if not mark.startswith("."):
                out.append((f"{folder}/{MANY}/{mark}", files.note(self.spark, f"{folder}/{MANY}/{mark}")))
        return out

    def _note(self, name: str, found: list) -> None:
        if len({row.d for row in found}) > FEW_DAYS:
            rows = [(str(row.d), row.batch, row.low, row.high, row.rows) for row in found]
            files.add_note(self.spark, f"{self.root}/_zones/{name}/{MANY}/{uuid.uuid4().hex}", rows)
            return
        for row in found:
            files.add_mark(self.spark, f"{self._zone_dir(name, row.d)}/{row.batch}_{row.low}_{row.high}_{row.rows}")

    def _forget(self, name: str, days: list[date], batch: int | None = None) -> None:
        """Drop notes before the rows change: without a note a batch is always read."""
        if not days:
            return
        root, struck = f"{self.root}/_zones/{name}", {str(day) for day in days}
        folders = set(files.marks(self.spark, root))
        for path, noted in self._many(root) if MANY in folders else []:
            kept = [row for row in noted if row[0] not in struck or batch not in (None, row[1])]
            if len(kept) < len(noted):
                files.drop(self.spark, path)
                if kept:
                    files.add_note(self.spark, f"{root}/{MANY}/{uuid.uuid4().hex}", kept)
        for day in struck & folders:
            if batch is None:
                files.drop(self.spark, f"{root}/{day}")
                continue
            for mark in files.marks(self.spark, f"{root}/{day}"):
                if mark.startswith(f"{batch}_"):
                    files.drop(self.spark, f"{root}/{day}/{mark}")

    @staticmethod
    def _bounds(rows: DataFrame, at: str) -> list:
        """(d, batch, low, high, rows) of written rows; one row per folder."""
        micros = F.unix_micros(F.col(at))
        return rows.groupBy("d", "batch").agg(F.min(micros).alias("low"), F.max(micros).alias("high"), F.count("*").alias("rows")).collect()

    def written_days(self, name: str, batch: int) -> list[date]:
        """The days a recent batch was written to."""
        folder = f"{self.root}/_written/{name}/{batch}"
        found = set(files.marks(self.spark, folder))
        for _, days in self._many(folder) if MANY in found else []:
            found |= set(days)
        return sorted(map(date.fromisoformat, found - {MANY}))

    def _note_written(self, name: str, batch: int, before: list[date], days: list[date]) -> None:
        """The days of ``before`` that are no longer written to have been dropped; a crash leaves a day too many at most."""
        folder = f"{self.root}/_written/{name}/{batch}"
        marked = files.marks(self.spark, folder)
        if MANY not in marked and len(days) <= FEW_DAYS:
            for day in sorted({*before} - {*days}):
                files.drop(self.spark, f"{folder}/{day}")
            for day in days:
                files.add_mark(self.spark, f"{folder}/{day}")
            return
        old = [f"{folder}/{mark}" for mark in marked if mark != MANY]
        old += [path for path, _ in self._many(folder)] if MANY in marked else []
        if days:
            files.add_note(self.spark, f"{folder}/{MANY}/{uuid.uuid4().hex}", [str(day) for day in days])
        for path in old:
            files.drop(self.spark, path)

    # -- writing ------------------------------------------------------------

    def append(self, name: str, rows: DataFrame, batch: int) -> None:
        """Write one batch; writing it again replaces what it wrote before, on whatever days that was."""
        schema, at = TABLES[name]
        before, seen, micros = self.written_days(name, batch), Observation(), F.unix_micros(F.col(at))
        self._forget(name, before, batch)
        (
            rows.observe(seen, F.count("*").alias("rows"), F.min(micros).alias("low"), F.max(micros).alias("high"))
            .select(*schema.names, F.to_date(F.col(at)).alias("d"), F.lit(batch).cast("long").alias("batch"))
            # Gathers each day's rows into few files of even size.
            .hint("rebalance", F.col("d"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("d", "batch")
            .parquet(self.path(name))
        )
        self._settle(name, batch, before, seen.get)

    def _settle(self, name: str, batch: int, before: list[date], seen: dict) -> None:
        """Drop what an earlier attempt left on other days and note the bounds of what is there."""
        days = []
        if seen["low"] is not None:
            low, high = (UNIX_EPOCH + timedelta(microseconds=seen[c]) for c in ("low", "high"))
            days = [low.date() + timedelta(days=n) for n in range((high.date() - low.date()).days + 1)]
        here = lambda day: f"{self.path(name)}/d={day}/batch={batch}"
        if len(days) > 1:
            stored = {day for day, _ in files.partitions(self.spark, self.path(name), "d", "batch", batch=str(batch))}
            days = [day for day in days if str(day) in stored]
            reader = self.spark.read.schema(TABLES[name][0]).option("basePath", self.path(name))
            rows = reader.parquet(*map(here, days)).withColumn("d", F.to_date(TABLES[name][1]))
            self._note(name, self._bounds(rows.withColumn("batch", F.lit(batch)), TABLES[name][1]))
        elif days:
            self._note(name, [Row(d=days[0], batch=batch, **seen)])
        for day in sorted({*before} - {*days}):
            files.drop(self.spark, here(day))
        self._note_written(name, batch, before, days)
        folder = f"{self.root}/_written/{name}"
        # Only a batch that may still come again needs its days.
        for old in files.marks(self.spark, folder):
            if int(old) < batch - KEPT_NOTES:
                files.drop(self.spark, f"{folder}/{old}")

    def replace_days(self, name: str, rows: DataFrame, days: list[date], keep_batch: bool = True) -> None:
        """Replace whole days by ``rows``, which may read the very same days."""
        schema, at = TABLES[name]
        staged = f"{self.staging}/{name}-{uuid.uuid4().hex}"
        batch = F.col("batch") if keep_batch else F.lit(COMPACTED).cast("long")
        kept = rows.select(*schema.names, F.to_date(F.col(at)).alias("d"), batch.alias("batch"))
        if name in CLUSTERED:
            writer = clustering.clustered(kept, "d", "batch").write.options(**clustering.bloom_options())
        else:
            writer = kept.hint("rebalance", F.col("d"), F.col("batch")).write
        writer.mode("overwrite").partitionBy("d", "batch").parquet(staged)
        shape = T.StructType([*schema.fields, *_SPAN, *_PARTITION])
        bounds = self._bounds(self.spark.read.schema(shape).parquet(staged), at)
        if name in LEVELED and any(row.batch == COMPACTED for row in bounds):
            finer = COMPACTED
            for level, seconds in LEVELS.items():
                stored = self.spark.read.schema(shape).parquet(staged).filter(F.col("batch") == finer)
                if finer == COMPACTED:
                    stored = stored.select(*schema.names)
                coarse = rollups.coarsened(stored, name, seconds)
                coarse = coarse.withColumns({"d": F.to_date("bucket"), "batch": F.lit(level).cast("long")}).hint("rebalance", F.col("d"))
                if name in LISTED and level == DAYS:
                    # Heavy keys first: a lower bound on bytes skips the row groups behind them.
                    coarse = coarse.sortWithinPartitions("d", "batch", F.desc("bytes"))
                coarse.write.mode("append").partitionBy("d", "batch").parquet(staged)
                finer = level
            if name in LISTED:
                stored = self.spark.read.schema(shape).parquet(staged).filter(F.col("batch") == DAYS)
                rollups.heaviest(stored, name, HEAVY_KEYS).withColumn("batch", F.lit(HEAVY).cast("long")).write.mode("append").partitionBy(
                    "d", "batch"
                ).parquet(staged)
        self._forget(name, sorted({*days, *(row.d for row in bounds)}))
        # Days that are replaced move as a whole, into others single folders do.
        old = [f"d={day}" for day in sorted({*days} & {*self.days(name)})]
        whole = {f"d={day}" for day in days}
        new = sorted({f"d={day}" if f"d={day}" in whole else f"d={day}/batch={b}" for day, b in files.partitions(self.spark, staged, "d", "batch")})
        files.swap(self.spark, staged, self.path(name), old, new)
        # Days that were not replaced may hold other rows of the same batches, which the notes then do not know.
        self._note(name, [row for row in bounds if row.d in days])

    def drop_day(self, name: str, day: date) -> None:
        self.drop_days(name, [day])

    def drop_days(self, name: str, days: list[date]) -> None:
        self._forget(name, days)
        for day in days:
            files.drop(self.spark, f"{self.path(name)}/d={day}")

    def drop_batch(self, name: str, batch: int) -> None:
        """Take back what a recent batch wrote."""
        days = self.written_days(name, batch)
        self._forget(name, days, batch)
        for day in days:
            files.drop(self.spark, f"{self.path(name)}/d={day}/batch={batch}")
        files.drop(self.spark, f"{self.root}/_written/{name}/{batch}")

    def write_dimension(self, name: str, rows: DataFrame) -> None:
        """Replace a naming table; ``rows`` may be derived from its present content."""
        schema = DIMENSIONS[name]
        staged = f"{self.staging}/{name}-{uuid.uuid4().hex}"
        rows.select(
            *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)
        ).write.parquet(f"{staged}/data")
        files.swap(self.spark, staged, self.path(name), ["data"], ["data"])

    # -- retention ----------------------------------------------------------

    def set_horizon(self, name: str, moment: datetime) -> None:
        """Rows before a moment no longer exist for readers."""
        files.mark(self.spark, f"{self.root}/_horizon/{name}", _micros(moment))

    def horizon(self, name: str) -> datetime | None:
        micros = files.latest_mark(self.spark, f"{self.root}/_horizon/{name}")
        return None if micros is None else UNIX_EPOCH + timedelta(microseconds=micros)

    def _lowest(self, name: str, low: datetime | None) -> datetime | None:
        """The later of a lower bucket bound and the horizon. A conversation
        may have been seen up to five minutes after its bucket began."""
        horizon = self.horizon(name)
        if horizon is None:
            return low
        if name == "conversations":
            horizon -= BUCKET
        return max(horizon, utc(low)) if low else horizon

    # -- reading ------------------------------------------------------------

    def dimension(self, name: str) -> DataFrame:
        schema, path = DIMENSIONS[name], f"{self.path(name)}/data"
        if not files.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _window(self, name: str, low: datetime | None, high: datetime | None) -> dict[date, list[int]]:
        """Days of a window and their batches that may hold something of it."""
        days = [day for day in self.days(name) if not ((low and day < utc(low).date()) or (high and day > utc(high).date()))]
        # A read of everything opens everything: no note could spare it a batch.
        zones = self._zones_of(name, days) if low or high else {day: {} for day in days}

        def met(zone: Zone | None) -> bool:
            return zone is None or not ((low and zone.high < utc(low)) or (high and zone.low > utc(high)))

        return {day: [b for b in found if met(zones[day].get(b))] for day, found in self.folders(name, days).items()}

    def _open(self, name: str, found: dict[date, list[int]], more: list[T.StructField] | None = None) -> DataFrame:
        """Rows of the given folders, nothing else being listed."""
        full = T.StructType([*TABLES[name][0].fields, *(more or []), *_PARTITION])
        paths = [f"{self.path(name)}/d={day}/batch={b}" for day, batches in found.items() for b in batches]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path(name)).parquet(*paths)

    @staticmethod
    def _within(rows: DataFrame, at: str, low: datetime | None, high: datetime | None) -> DataFrame:
        if low:
            rows = rows.filter(F.col("d") >= F.lit(utc(low).date()))
        if high:
            rows = rows.filter(F.col("d") <= F.lit(utc(high).date()))
        for predicate in between(F.col(at), low, high):
            rows = rows.filter(predicate)
        return rows

    def partials(
        self, name: str, low: datetime | None = None, high: datetime | None = None
    ) -> DataFrame:
        """Stored rows, day-pruned; keys may still be spread over batches."""
        low = self._lowest(name, low)
        found = {day: [b for b in batches if b >= COMPACTED] for day, batches in self._window(name, low, high).items()}
        return self._within(self._open(name, found), TABLES[name][1], low, high)

    def day_partials(self, name: str, days: list[date]) -> DataFrame:
        """Stored rows of some days."""
        low = self._lowest(name, None)
        found = {day: [b for b in batches if b >= COMPACTED] for day, batches in self.folders(name, days).items()}
        return self._within(self._open(name, found), TABLES[name][1], low, None)

    def batch(self, name: str, batch: int) -> DataFrame | None:
        """What a recent batch wrote, listing nothing but its own directories."""
        days = self.written_days(name, batch)
        if not days:
            return None
        rows = self._open(name, {day: [batch] for day in days})
        return rows.select(*TABLES[name][0].names)

    def merged(
        self, name: str, low: datetime | None = None, high: datetime | None = None
    ) -> DataFrame:
        """One row per key.

        Compacted rows are merged already. They take part in a merge only from
        the oldest bucket on that later batches of their day have touched.
        """
        rows = self._merged(name, low, high)
        horizon = self.horizon(name) if name == "conversations" else None
        return rows if horizon is None else rows.filter(F.col("last_seen") >= instant(horizon))

    def _merged(self, name: str, low: datetime | None, high: datetime | None, only: Column | None = None) -> DataFrame:
        """``only`` selects keys before they are merged."""
        low = self._lowest(name, low)
        at, columns = TABLES[name][1], TABLES[name][0].names
        found = {day: [b for b in batches if b >= COMPACTED] for day, batches in self._window(name, low, high).items()}
        rows = self._within(self._open(name, found), at, low, high)
        if only is not None:
            rows = rows.filter(only)
        open_days = [day for day, batches in found.items() if batches and batches != [COMPACTED]]
        if not open_days:
            return rows.select(*columns)
        settled = ~on_days(open_days)
        for offset, days in self._borders(name, {day: found[day] for day in open_days if COMPACTED in found[day]}).items():
            since = F.col("d").cast("timestamp") + F.expr(f"make_dt_interval(0, 0, 0, {offset})")
            settled = settled | (on_days(days) & (F.col("batch") == COMPACTED) & (F.col(at) < since))
        done = rows.filter(settled).select(*columns)
        return done.unionByName(merge_table(name, rows.filter(~settled)).select(*columns))

    def _borders(self, name: str, found: dict[date, list[int]]) -> dict[int, list[date]]:
        """Second of the day -> days on which no later batch has touched a bucket before it. An earlier one is right too."""
        zones, since = self._zones_of(name, list(found)), {}
        for day, batches in found.items():
            first = min(zones[day][b].low if b in zones[day] else midnight(day) for b in batches if b != COMPACTED)
            since[day] = int((first - midnight(day)).total_seconds())
        if len(set(since.values())) > BORDERS:
            since = {day: second // 3_600 * 3_600 for day, second in since.items()}
        out: dict[int, list[date]] = {}
        for day, second in since.items():
            if second > 0:
                out.setdefault(second, []).append(day)
        return out

    def spans(
        self, name: str, low: datetime | None = None, high: datetime | None = None, grain: int = 86_400
    ) -> DataFrame:
        """Rows that add up to a window of minute buckets, in buckets of at most ``grain`` seconds.

        ``first`` and ``last`` are the first and last minute of a row. Compacted
        days inside the window are read by the day, those at its edges by the
        hour with minutes beside it, and whatever came later by the minute.
        """
        out, days = self._edges_and_days(name, low, high, grain)
        return out.unionByName(self._whole_days(name, days)) if days else out

    def _whole_days(self, name: str, days: dict[date, list[int]]) -> DataFrame:
        return self._open(name, {day: [DAYS] for day in days}, _SPAN).select(*TABLES[name][0].names, "first", "last")

    def heavy_parts(self, name: str, low: datetime | None = None, high: datetime | None = None) -> HeavyParts | None:
        """A window in parts for finding its heaviest keys; None where a whole day of it has no list."""
        rest, days = self._edges_and_days(name, low, high, LEVELS[DAYS])
        if not days or any(HEAVY not in batches for batches in days.values()):
            return None
        lists = self._open(name, {day: [HEAVY] for day in days}, _SPAN).select(*TABLES[name][0].names)
        return HeavyParts(lists, self._whole_days(name, days), rest, len(days))

    def _edges_and_days(
        self, name: str, low: datetime | None, high: datetime | None, grain: int
    ) -> tuple[DataFrame, dict[date, list[int]]]:
        """Rows of a window outside the days that can be read as a whole, and these days with their folders."""
        low = self._lowest(name, low)
        found = self._window(name, low, high)
        after = None if high is None else utc(high) + timedelta(microseconds=1)
        minutes: dict[date, list[int]] = {}
        whole: dict[int, dict[date, list[int]]] = {level: {} for level in LEVELS}
        edges = []
        for day, batches in found.items():
            minutes[day] = [b for b in batches if b > COMPACTED]
            if COMPACTED not in batches:
                continue
            start, end = midnight(day), midnight(day) + timedelta(days=1)
            first, last = (start if low is None else max(start, utc(low))), (end if after is None else min(end, after))
            levels = [level for level, seconds in LEVELS.items() if level in batches and seconds <= grain]
            if DAYS in levels and first == start and last == end:
                whole[DAYS][day] = [DAYS]
            elif HOURS in levels:
                hour = timedelta(hours=1)
                first = start + -(-(first - start) // hour) * hour
                last = start + (last - start) // hour * hour
                if first < last:
                    whole[HOURS][day] = [HOURS]
                if first > start or last < end:
                    edges.append((day, first, max(first, last)))
            else:
                minutes[day].append(COMPACTED)
        names = TABLES[name][0].names
        fine = self._within(self._open(name, minutes), "bucket", low, high)
        for day, first, last in edges:
            rest = self._within(self._open(name, {day: [COMPACTED]}), "bucket", low, high)
            fine = fine.unionByName(rest.filter((F.col("bucket") < instant(first)) | (F.col("bucket") >= instant(last))))
        out = fine.select(*names, F.col("bucket").alias("first"), F.col("bucket").alias("last"))
        inside = self._open(name, whole[HOURS], _SPAN)
        cut = [day for day, _, _ in edges]
        kept = ~on_days(cut)
        for day, first, last in edges:
            kept = kept | ((F.col("bucket") >= instant(first)) & (F.col("bucket") < instant(last)))
        if whole[HOURS]:
            out = out.unionByName(inside.filter(kept).select(*names, "first", "last"))
        return out, {day: found[day] for day in whole[DAYS]}

    def sketches(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        return self.spans("distinct_1m", low, high)

    def conversations(
        self, low: datetime | None = None, high: datetime | None = None
    ) -> DataFrame:
        return condense.finish(self.merged("conversations", low, high))

    def statistics(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        return self.merged("statistics", low, high)

    def statistics_parts(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        """Statistics for readers that sum them: keys may still be spread over batches."""
        return self.partials("statistics", low, high).select(*schemas.STATISTICS.names)

    def conversation_parts(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        """Conversation rows for readers that sum them, without a merge where it would change no sum.

        Both bounds are meant for ``last_seen``, which the reader checks: rows
        of a bucket that lies inside as a whole pass in any case, the buckets
        at the edges are merged. Rows without any port in the key take theirs
        from the conversation's first flow, so these are merged too.
        """
        horizon = self.horizon("conversations")
        if horizon is not None:
            low = max(utc(low), horizon) if low else horizon
        start = F.col("bucket_start")
        plain = F.coalesce("key_src_port", "key_dst_port").isNotNull()
        if low is not None:
            plain = plain & (start >= instant(UNIX_EPOCH + -(-(utc(low) - UNIX_EPOCH) // BUCKET) * BUCKET))
        if high is not None:
            plain = plain & (start < instant(UNIX_EPOCH + (utc(high) - UNIX_EPOCH) // BUCKET * BUCKET))
        names, since = TABLES["conversations"][0].names, low - BUCKET if low else None
        # Bucket and key ports belong to the key: each conversation is on one side with all its rows.
        rest = self._merged("conversations", since, high, ~plain)
        if horizon is not None:
            rest = rest.filter(F.col("last_seen") >= instant(horizon))
        return condense.finish(self.partials("conversations", since, high).filter(plain).select(*names).unionByName(rest))

    def rollup(
        self, name: str, low: datetime | None = None, high: datetime | None = None
    ) -> DataFrame:
        """Rollup rows; every reader sums them again, so they are not merged here."""
        return self.partials(name, low, high).select(*schemas.ROLLUPS[name].names)

    def newest_bucket(self) -> datetime | None:
        """Newest conversation bucket, looked up in the newest day only."""
        days = self.days("conversations")
        if not days:
            return None
        low = datetime(days[-1].year, days[-1].month, days[-1].day)
        top = self.partials("conversations", low).agg(F.unix_micros(F.max("bucket_start")))
        micros = top.first()[0]
        return None if micros is None else UNIX_EPOCH + timedelta(microseconds=micros)

    @property
    def exporters(self) -> DataFrame:
        return self.dimension("exporters")

    @property
    def interfaces(self) -> DataFrame:
        return self.dimension("interfaces")

    @property
    def ip_names(self) -> DataFrame:
        return self.dimension("ip_names")

    @property
    def dns_cache(self) -> DataFrame:
        return self.dimension("dns_cache")

    @property
    def port_descriptions(self) -> DataFrame:
        return self.dimension("port_descriptions")
