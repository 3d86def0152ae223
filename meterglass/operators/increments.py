"""First-wins dedup and daily rollups that follow the fact table's increments.

Two tables by day are kept: the row that wins each key, and the daily rollup of these rows. After
an update of the facts only keys with rows in changed units are decided again, over all live rows
that hold them: a file that sorts earlier takes a key from a later one, a file that vanished gives it
back. Days that such a key leaves or comes to are made again, all others stay as they are.

Keys and days are found by joins. A day's rows are replaced as one partition; an update that is lost
between two days is made whole by the next, as both the old and the new day of a key count as touched
until then. The facts' versions that the tables reflect are written last; if they aren't the ones
before the last update, all is made anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import once
from ..sources.files import MESSAGE_COLUMNS, Config, children, existing
from ..sources.ingest import Facts, removed
from ..sources.logs import SOURCES
from . import messages, rollup

REFLECTED = "client string, version string"
STAGE = ("key", *MESSAGE_COLUMNS)


@dataclass(frozen=True)
class Touched:
    """Keys decided again, days made again, days in all."""

    keys: int
    days: int
    all_days: int


def keyed(rows: DataFrame) -> DataFrame:
    """Messages with their keys; those without a time are of no day."""
    return rows.withColumn("date", F.coalesce("date", F.lit("none"))).select(messages.content_key().alias("key"), *MESSAGE_COLUMNS)


def winners(rows: DataFrame) -> DataFrame:
    """Of each key the first row."""
    return messages.first_wins(rows, F.col("key"), ["ord"]).select(*STAGE)


class Increments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.facts = Facts(spark, f"{self.path}/log")

    def update(self, config: Config, clients: list[str] | None = None) -> Touched:
        """Brings facts, winners and rollups up to date."""
        self.facts.update(config, clients)
        now = {c: v[-1].rpartition("/")[2] for c in SOURCES if (v := self.facts.versions(c))}
        had = self.reflected()
        moved = [c for c in now if had.get(c) != now[c]]
        if not had or any(had.get(c) != self.before(c) for c in moved):
            return self.replaced(winners(keyed(self.facts.read())), None, None, now)
        if not moved:
            return Touched(0, 0, len(self.days("winners")))
        keys = None
        for c in moved:
            own = self.facts.client_changes(c).withColumn("client", F.lit(c)).select(messages.content_key().alias("key"))
            keys = own if keys is None else keys.unionByName(own)
        keys = once(keys.distinct())
        fresh = winners(keyed(self.facts.read()).join(keys, "key", "left_semi"))
        return self.replaced(fresh, keys, self.winners().join(keys, "key", "left_semi"), now)

    def before(self, client: str) -> str | None:
        """The client's version before the last one."""
        found = self.facts.versions(client)
        return found[-2].rpartition("/")[2] if len(found) > 1 else None

    def reflected(self) -> dict[str, str]:
        path = f"{self.path}/reflected"
        return dict(self.spark.read.schema(REFLECTED).parquet(path).collect()) if existing(self.spark, [f"{path}/_SUCCESS"]) else {}  # a row a client

    def days(self, name: str) -> list[str]:
        return [d.rpartition("=")[2] for d in children(self.spark, f"{self.path}/{name}") if "/date=" in d]

    def replaced(self, fresh: DataFrame, keys: DataFrame | None, old: DataFrame | None, now: dict[str, str]) -> Touched:
        fresh = once(fresh)
        if keys is None:
            removed(self.spark, f"{self.path}/winners")
            removed(self.spark, f"{self.path}/daily")
            rows, touched, n_keys = fresh, once(fresh.select("date").distinct()), fresh.count()
        else:
            touched = once(fresh.select("date").unionByName(old.select("date")).distinct())
            kept = self.winners().join(F.broadcast(touched), "date", "left_semi").join(keys, "key", "left_anti")
            rows, n_keys = once(kept.unionByName(fresh)), keys.count()
        day_list = [r.date for r in touched.collect()]  # days: a few thousand at most
        rows = rows.select(*STAGE)
        self.put("winners", rows, day_list)
        self.put("daily", rollup.daily_client(messages.with_cost(messages.with_provider(messages.valid(rows.drop("key"))))), day_list)
        self.spark.createDataFrame(list(now.items()), REFLECTED).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/reflected")
        return Touched(n_keys, len(day_list), len(self.days("winners")))

    def put(self, name: str, rows: DataFrame, days: list[str]) -> None:
        """The rows of some days, in place of what was there; days without rows go."""
        path = f"{self.path}/{name}"
        rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
        full = {r.date for r in rows.select("date").distinct().collect()}
        for day in set(days) - full:
            removed(self.spark, f"{path}/date={day}")

    def read(self, name: str, empty: DataFrame) -> DataFrame:
        path = f"{self.path}/{name}"
        if not self.days(name):
            return empty.limit(0)
        return self.spark.read.schema(empty.schema).parquet(path).select(*empty.columns)

    def winners(self) -> DataFrame:
        """key and message of each key's first row."""
        return self.read("winners", keyed(self.facts.nothing(())))

    def daily(self) -> DataFrame:
        """``rollup.daily_client`` of all days."""
        return self.read("daily", rollup.daily_client(messages.enriched(self.facts.nothing(()))))
