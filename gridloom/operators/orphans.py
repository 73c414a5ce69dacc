"""References to records that do not exist.

Keyed pending-orphan state that lasts: a named folder holds, epoch by epoch, what came in
and what was found. Its tables are the *parent index* (versions of each key), the log of
references, the log of *verdicts* on them, and the *pending orphans* (references whose key
has had no parent so far). In each epoch

* new references probe the index as of their time of use;
* parents that arrive resolve waiting orphans (their state becomes ``later``);
* a registration or withdrawal of which the state learns late - it lies before the use of
  references judged in earlier epochs - has those judged again: a withdrawal reopens them
  as ``deleted``, a registration may settle them;
* verdicts are written as changes, so the counts after every epoch are sums over the log.

A reference is shuffled in its own epoch only, unless a parent's late change touches it or
it still waits. Further epochs may be added at any time, by another session too.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions.columns import pick
from gridloom.functions.text import fold_key
from gridloom.session import own_dir, cut

#: Versions of one key that are held in one array; keys with more go by time slots.
LIGHT_VERSIONS = 32
#: References of one key, within an hour of many versions or altogether, that meet their parent in one task, about.
HOT_ROWS = 1_000_000
#: The time of use of a reference that states none, and, later still, of a withdrawal that hasn't come.
LAST_USE, FAR_FUTURE = "9999-12-30 00:00:00", "9999-12-31 00:00:00"

VERSION = "struct<at:timestamp_ntz,gone:timestamp_ntz,n:int>"
REFERENCE = "ref_table string, ref_id bigint, index_field string, key string, used timestamp_ntz, idxs array<int>"
REF_COLUMNS = ["ref_table", "ref_id", "index_field", "key", "used", "idxs"]
VERDICT = REFERENCE + ", state string, lacking array<int>, was string, epoch int"


@dataclass(frozen=True)
class Orphans:
    """orphans: one row per orphan reference; snapshots: (epoch, until, ref_table, period, orphan_state, n) after each epoch."""

    orphans: DataFrame
    snapshots: DataFrame


def parents_of(manifest: DataFrame) -> DataFrame:
    """Versions (key, at, gone, n) of each parent; n positions can be referred to.

    Repeated rows collapse. A version without key or time of registration is never in force.
    """
    return pick(manifest, "sample_id", "registered_at", "withdrawn_at", "ocr_tokens").select(
        fold_key(F.col("sample_id")).alias("key"),
        F.col("registered_at").cast("timestamp_ntz").alias("at"),
        F.col("withdrawn_at").cast("timestamp_ntz").alias("gone"),
        F.greatest(F.size("ocr_tokens"), F.lit(0)).alias("n"),
    ).where("key is not null and at is not null")


def references_of(table: DataFrame, name: str, id_col: str, used_col: str, index_field: str, known_col: str | None = None) -> DataFrame:
    """References (REFERENCE, and ``known``, when it came in); a null key is no reference.

    Null indexes refer to nothing. A reference without time of use sees the whole history;
    one without ``known_col`` came in when it was used.
    """
    slim = pick(table, id_col, "sample_id", index_field, *dict.fromkeys([used_col, known_col or used_col]))
    indexes = F.col(index_field) if slim.schema[index_field].dataType.typeName() == "array" else F.array(index_field)
    return slim.select(
        F.lit(name).alias("ref_table"),
        F.col(id_col).cast("bigint").alias("ref_id"),
        F.lit(index_field).alias("index_field"),
        fold_key(F.col("sample_id")).alias("key"),
        F.coalesce(F.col(used_col).cast("timestamp_ntz"), F.lit(LAST_USE).cast("timestamp_ntz")).alias("used"),
        F.array_distinct(F.filter(F.coalesce(indexes, F.array().cast("array<int>")), lambda x: x.isNotNull())).alias("idxs"),
        F.coalesce(F.col(known_col or used_col).cast("timestamp_ntz"), F.col(used_col).cast("timestamp_ntz"), F.lit(LAST_USE).cast("timestamp_ntz")).alias("known"),
    ).where("key is not null")


def _in_force_by_slot(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """The version in force for keys with many versions in the epoch.

    The time line of a key is cut into hours. The last version of each hour is
    carried forward over the hours, one row each; within an hour the versions and the
    references are merged by time. An hour with more than HOT_ROWS references of a key is
    merged in several shares, each with all the versions of that hour.
    """
    slot = lambda c: F.date_trunc("hour", F.col(c))
    versions = versions.withColumn("slot", slot("at"))
    refs = refs.withColumn("slot", slot("used")).withColumn("rid", F.monotonically_increasing_id())
    shares = refs.groupBy("key", "slot").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("shares"))
    last = versions.groupBy("key", "slot").agg(F.max("v").alias("v"))
    hours = last.unionByName(refs.select("key", "slot").distinct().withColumn("v", F.lit(None).cast(VERSION)))
    hours = hours.groupBy("key", "slot").agg(F.max("v").alias("v"))
    before = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select("key", "slot", F.last("v", ignorenulls=True).over(before).alias("carried"))
    cols = [c for c in refs.columns if c not in ("key", "slot")]
    spread_refs = refs.join(shares, ["key", "slot"]).withColumn("share", F.pmod(F.xxhash64("ref_id", "used"), "shares").cast("int")).drop("shares")
    versions = versions.join(shares, ["key", "slot"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    events = (
        versions.select("key", "slot", "share", F.col("at").alias("t"), F.lit(0).alias("kind"), "v", *[F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in cols])
        .unionByName(spread_refs.select("key", "slot", "share", F.col("used").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(VERSION).alias("v"), *cols))
    )
    upto = Window.partitionBy("key", "slot", "share").orderBy("t", "kind", "v").rowsBetween(Window.unboundedPreceding, 0)
    merged = events.withColumn("now", F.last("v", ignorenulls=True).over(upto)).where("kind = 1")
    return merged.join(carried, ["key", "slot"], "left").select("key", *[c for c in cols if c != "rid"], F.coalesce("now", "carried").alias("v"))


class OrphanState:
    """The state in a folder that all executors share; without a name, one among the application's copies (``session.clear``)."""

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark = spark
        self.home = (home or f"{own_dir(spark)}/orphans-{uuid.uuid4().hex}").rstrip("/")

    def epochs(self) -> list[tuple[int, object, object]]:
        """(epoch, its end, the latest use seen by then) of the epochs that are done; what a broken run left is not among them."""
        try:
            return sorted((r.epoch, r.until, r.last_used) for r in self.spark.read.schema("epoch int, until timestamp_ntz, last_used timestamp_ntz").parquet(f"{self.home}/log").collect())
        except AnalysisException:
            return []

    def _table(self, name: str, schema: str, upto: int) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.home}/{name}").where(F.col("epoch") <= upto)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str) -> None:
        """Epochs that a broken run left are overwritten."""
        df.write.partitionBy("epoch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.home}/{name}")

    def add(self, parents: DataFrame, references: DataFrame) -> None:
        """One more epoch, from ``parents_of`` and ``references_of``. A parent's row replaces what was known of the same key and time of registration."""
        self._load(parents.withColumn("known", F.lit(None).cast("timestamp_ntz")), references.withColumn("known", F.lit(None).cast("timestamp_ntz")), [None])

    def load(self, parents: DataFrame, references: DataFrame, unit: str = "month") -> None:
        """An epoch for each month (or other ``unit``) in which something came in, registration and withdrawal of a parent each in its own."""
        far = F.lit(FAR_FUTURE).cast("timestamp_ntz")
        last = parents.groupBy("key", "at").agg(F.max(F.struct(F.coalesce("gone", far).alias("gone"), "n")).alias("v")).select("key", "at", "v.gone", "v.n")
        known = lambda at, gone: F.struct(at.alias("known"), gone.alias("gone"))
        later = F.date_trunc(unit, "gone") > F.date_trunc(unit, "at")
        events = F.when(later & (F.col("gone") < far), F.array(known(F.col("at"), far), known(F.col("gone"), F.col("gone")))).otherwise(F.array(known(F.col("at"), F.col("gone"))))
        parents, references = cut(last.select("key", "at", "n", F.inline(events))), cut(references)
        ends = parents.select("known").union(references.select("known")).where(f"known < '{LAST_USE}'").select(F.date_trunc(unit, "known").alias("p")).distinct()
        self._load(parents, references, sorted(r.p for r in ends.collect()) or [None])

    def _load(self, parents: DataFrame, references: DataFrame, starts: list) -> None:
        done = self.epochs()
        first = done[-1][0] + 1 if done else 0
        number = first + sum((F.when(F.coalesce(F.col("known") >= F.lit(m), F.lit(True)), 1).otherwise(0) for m in starts[1:]), F.lit(0))
        gone = F.coalesce("gone", F.lit(FAR_FUTURE).cast("timestamp_ntz"))
        rows = parents.groupBy("key", "at", number.cast("int").alias("epoch")).agg(F.max(F.struct(gone.alias("gone"), "n")).alias("v"))
        self._write(rows.select("key", F.struct("at", "v.gone", "v.n").cast(VERSION).alias("v"), "epoch"), "versions")
        self._write(references.select(*REF_COLUMNS, number.cast("int").alias("epoch")), "references")
        final = first + len(starts) - 1
        versions, refs = self._table("versions", f"key string, v {VERSION}, epoch int", final), self._table("references", REFERENCE + ", epoch int", final)
        # What the epochs need to know beforehand, in one pass each: times of change and use, keys with many versions or references.
        facts = {r.epoch: r for r in versions.where(F.col("epoch") >= first).groupBy("epoch").agg(F.min(F.least("v.at", "v.gone")).alias("t")).collect()}
        used = {r.epoch: r.t for r in refs.where(F.col("epoch") >= first).where(f"used < '{LAST_USE}'").groupBy("epoch").agg(F.max("used").alias("t")).collect()}
        heavy = not versions.groupBy("key").agg(F.countDistinct("v.at").alias("n")).where(F.col("n") > LIGHT_VERSIONS).isEmpty()
        hot = refs.groupBy("key").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("shares")).where("shares > 1")
        hot = None if hot.isEmpty() else cut(hot)
        seen, log = done[-1][2] if done else None, []
        for e, start in zip(range(first, final + 1), starts):
            late = seen is not None and e in facts and facts[e].t <= seen
            self._advance(e, versions, refs, heavy, hot, late)
            seen = max((t for t in (seen, used.get(e)) if t is not None), default=None)
            log.append((e, start, seen))
        self.spark.createDataFrame(log, "epoch int, until timestamp_ntz, last_used timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{self.home}/log")

    def _advance(self, e: int, versions: DataFrame, refs: DataFrame, heavy: bool, hot: DataFrame | None, late: bool) -> None:
        now = lambda df: df.where(F.col("epoch") == e)
        known = versions.where(F.col("epoch") <= e)
        work = now(refs).select(*REF_COLUMNS, F.lit(None).cast("string").alias("was"))
        waiting = self._table("pending", REFERENCE + ", epoch int", e - 1).where(F.col("epoch") == e - 1).select(*REF_COLUMNS)
        touched = now(versions).groupBy("key").agg(F.min(F.least("v.at", "v.gone")).alias("since"))
        work = work.unionByName(waiting.join(touched, "key", "left_semi").withColumn("was", F.lit("pending")))
        if late:
            # References judged before, used at or after what is only now known of their parent.
            past = refs.where(F.col("epoch") < e).select(*REF_COLUMNS).join(touched, "key").where("used >= since").drop("since")
            before = self._verdicts(e - 1).select(*REF_COLUMNS, "state")
            again = past.join(before, REF_COLUMNS, "left").select(*REF_COLUMNS, F.coalesce("state", F.lit("ok")).alias("was"))
            work = work.unionByName(again.where("was != 'pending'"))
        judged = _judge(_probe(work, known, heavy, hot))
        kept = judged.where("state != 'ok' or (was is not null and was != 'ok')").where("was is null or was != state or state = 'lacking'")
        # Repeated deliveries count once. Here, where few rows are left.
        self._write(kept.distinct().withColumn("epoch", F.lit(e)), "verdicts")
        still = waiting.join(touched, "key", "left_anti").unionByName(now(self._table("verdicts", VERDICT, e)).where("state = 'pending'").select(*REF_COLUMNS))
        self._write(still.withColumn("epoch", F.lit(e)), "pending")

    def _verdicts(self, upto: int) -> DataFrame:
        """The last verdict on each reference that is or was an orphan."""
        log = self._table("verdicts", VERDICT, upto)
        return log.groupBy(*REF_COLUMNS).agg(F.max_by(F.struct("state", "lacking"), "epoch").alias("v")).select(*REF_COLUMNS, "v.*")

    def orphans(self) -> DataFrame:
        """ref_table, ref_id, ref_field, token_index, orphan_state, used, each once; those still pending are ``missing``."""
        done = self.epochs()
        last = self._verdicts(done[-1][0] if done else -1)
        whole = last.where("state in ('pending', 'later', 'deleted')").select("ref_table", "ref_id", F.lit("sample_id").alias("ref_field"), F.lit(-1).alias("token_index"), F.when(F.col("state") == "pending", "missing").otherwise(F.col("state")).alias("orphan_state"), "used")
        parts = last.where("state = 'lacking'").select("ref_table", "ref_id", F.col("index_field").alias("ref_field"), F.explode("lacking").alias("token_index"), F.lit("missing").alias("orphan_state"), "used")
        return whole.unionByName(parts).distinct()

    def snapshots(self, unit: str = "month") -> DataFrame:
        """(epoch, until, ref_table, period, orphan_state, n): orphan references known after each epoch, by time of use; ``lacking`` are those with an index that is no position. A delivery repeated in a later epoch counts again."""
        done = self.epochs()
        log = self._table("verdicts", VERDICT, done[-1][0] if done else -1)
        step = F.array(F.struct(F.col("state").alias("orphan_state"), F.lit(1).alias("d")), F.struct(F.col("was").alias("orphan_state"), F.lit(-1).alias("d")))
        steps = log.select("epoch", "ref_table", F.date_trunc(unit, "used").alias("period"), F.inline(step)).where("orphan_state is not null and orphan_state != 'ok'")
        by = ["ref_table", "period", "orphan_state"]
        steps = steps.groupBy("epoch", *by).agg(F.sum("d").alias("d"))
        # A few rows per epoch: each counts from its epoch on.
        ends = self.spark.createDataFrame([(e, until) for e, until, _ in done], "at int, until timestamp_ntz")
        counted = steps.join(F.broadcast(ends), F.col("at") >= F.col("epoch")).groupBy(F.col("at").alias("epoch"), "until", *by).agg(F.sum("d").alias("n"))
        return counted.where("n != 0")


def _judge(probed: DataFrame) -> DataFrame:
    """Verdicts (VERDICT without epoch) on references with ``v``, the version in force, and ``known``, whether their key has any."""
    state = F.when(~F.col("known"), "pending").when(F.col("v").isNull(), "later").when(F.col("v.gone") <= F.col("used"), "deleted")
    lacking = F.when(state.isNull(), F.filter("idxs", lambda i: (i < 0) | (i >= F.col("v.n"))))
    step = probed.withColumn("lacking", lacking)
    return step.select(*REF_COLUMNS, F.coalesce(state, F.when(F.size("lacking") > 0, "lacking").otherwise("ok")).alias("state"), "lacking", "was")


def track_orphans(parents: DataFrame, references: DataFrame, unit: str = "month", home: str | None = None) -> Orphans:
    """All orphan references of ``references`` into ``parents``, and the counts after each month, by a state of their own or the one in ``home``.

    orphans: ref_table, ref_id, ref_field, token_index, orphan_state, used. Field
    ``sample_id`` with index -1: ``missing`` (the key has no parent at all), ``later``
    (all its versions are registered after the time of use), ``deleted`` (the version in
    force was withdrawn at or before it). Else one row per index that is no position of
    the version in force (``missing``). Equal deliveries of a reference count once; of
    versions of a key registered at the same instant the one withdrawn last, then the
    longest, is in force. Empty inputs give empty results. Other columns are ignored.
    """
    state = OrphanState(references.sparkSession, home)
    state.load(parents, references, unit)
    return Orphans(state.orphans(), state.snapshots(unit))


def _probe(work: DataFrame, versions: DataFrame, heavy: bool, hot: DataFrame | None) -> DataFrame:
    """work with ``v``, the version in force at the time of use, and ``known``, whether the key has versions.

    versions: the log; of a key's rows for one time of registration the last epoch's counts.
    hot: keys with many references and the number of shares in which these meet their parent.
    """
    current = versions.groupBy("key", "v.at").agg(F.max_by("v", "epoch").alias("v"))
    if heavy:
        current = cut(current)
        many = current.groupBy("key").count().where(F.col("count") > LIGHT_VERSIONS).select("key")
        slow_versions = current.join(many, "key", "left_semi").select("key", "at", "v")
        current = current.join(many, "key", "left_anti")
    light = current.groupBy("key").agg(F.array_sort(F.collect_list("v")).alias("light"))
    keys = ["key"]
    if hot is not None:
        work = work.join(hot, "key", "left").withColumn("share", F.pmod(F.xxhash64("ref_id", "used"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
        light = light.join(hot, "key", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
        keys = ["key", "share"]
    upto = F.filter("light", lambda v: v["at"] <= F.col("used"))
    out = [*REF_COLUMNS, "was"]
    quick = work.join(light, keys, "left").select(*out, F.col("light").isNotNull().alias("known"), F.when(F.size(upto) > 0, F.element_at(upto, -1)).alias("v"))
    if not heavy:
        return quick
    slow = _in_force_by_slot(work.select(*out).join(many, "key", "left_semi"), slow_versions).withColumn("known", F.lit(True))
    return quick.join(many, "key", "left_anti").unionByName(slow.select(*quick.columns))
