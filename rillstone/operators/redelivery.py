"""Messages delivered more than once: keep exactly one copy of each (problem 7)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillstone.operators.similarity import connected
from rillstone.runtime import materialise, scratch_path


def identify(deliveries: DataFrame) -> DataFrame:
    """Adds ``id_key`` (the folded identifier, null if there is none) and ``set_key`` (of the set of record ids, null if that is null)."""
    folded = F.lower(F.regexp_replace("event_id", r"^[\s ]+|[\s ]+$", ""))
    members = F.array_sort(F.array_distinct("source_record_ids"))
    return deliveries.withColumn("id_key", F.when(folded != "", folded)).withColumn("set_key", F.when(F.col("source_record_ids").isNotNull(), F.sha2(F.to_json(members), 256)))


def message_keys(identities: DataFrame) -> DataFrame:
    """``delivery_id, message``: which message each delivery carries, from ``delivery_id, id_key, set_key``.

    Equal identifiers mean one message. A set of record ids joins deliveries if one of those with that set has no identifier; identifiers
    and such sets form a bipartite graph whose components, found by labels and pointer jumping, are the messages. A delivery with neither is a
    message of its own.
    """
    loose = identities.filter("id_key IS NULL AND set_key IS NOT NULL").select("set_key").distinct()
    links = identities.filter("id_key IS NOT NULL AND set_key IS NOT NULL").select("id_key", "set_key").distinct().join(loose, "set_key", "left_semi")
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    links = materialise(links.select(named("i:", "id_key").alias("a"), named("s:", "set_key").alias("b")), "links")
    label = connected(links.select(F.col("a").alias("item_id")).unionByName(links.select(F.col("b").alias("item_id"))).distinct(), links) if not links.isEmpty() else None
    of_set, of_id = named("s:", "set_key"), named("i:", "id_key")
    keyed = identities.select("delivery_id", of_id.alias("i"), of_set.alias("s"))
    loose = loose.select(of_set.alias("s"))
    if label is not None:
        keyed = keyed.join(label.toDF("i", "of_id"), "i", "left")
        loose = loose.join(label.toDF("s", "linked"), "s", "left").select("s", F.coalesce("linked", "s").alias("of_set"))
    else:
        keyed, loose = keyed.withColumn("of_id", F.lit(None).cast("string")), loose.withColumn("of_set", F.col("s"))
    own = F.concat(F.lit("d:"), F.col("delivery_id").cast("string"))
    return keyed.join(loose, "s", "left").select("delivery_id", F.coalesce("of_set", "of_id", "i", own).alias("message"))


#: Directories of the identifier index, by hash of the identifier, and how many parts each version of it may have before they are written as one.
INDEX_BUCKETS, INDEX_PARTS = 64, 8
_IDENTITY = ["delivery_id", "id_key", "set_key", "store_period"]


_INDEX = "of string, key string, delivery_id bigint, id_key string, set_key string, store_period string, bucket int"


def _entries(identities: DataFrame) -> DataFrame:
    """What the index holds of deliveries: a row for each identifier they have."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("key")) for c in ("id_key", "set_key")]), lambda x: x["key"].isNotNull())
    return identities.withColumn("x", F.explode(pairs)).select("x.of", "x.key", *_IDENTITY).withColumn("bucket", _bucket(F.col("key")))


class MergedMeanwhile(RuntimeError):
    """Another merge has published the version that this one was about to publish."""


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(INDEX_BUCKETS)).cast("int")


class DeliveryStore:
    """Winners of all messages seen so far, in partitions by period of delivery, with an identifier index over every delivery.

    A version is a manifest file naming the directory of each partition and the parts of the index. ``merge`` looks the incoming
    identifiers up in the index, whose directories are hash buckets of the identifiers, reads only the partitions that hold deliveries of the same
    messages, recomputes their winners, writes the changed partitions to new directories and then renames a manifest of the next version into place:
    readers see the old or the new version, never a mixture. A rename does not replace a manifest, so of two merges that began at the same version
    one publishes and the other begins again. Parts of the index are compacted when there are more than ``INDEX_PARTS``. The winner of a message is its
    delivery with the smallest ``delivery_id``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "deliveries")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def manifest(self) -> dict:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._p())] if self._fs.exists(self._p()) else []
        versions = sorted(n for n in names if n.startswith("MANIFEST-"))
        if not versions:
            return {"version": 0, "partitions": {}, "index": [], "schema": None}
        return json.loads(self.spark.read.text(f"{self.path}/{versions[-1]}", wholetext=True).head()[0])

    def _publish(self, manifest: dict) -> None:
        temp = self._p(f".manifest.{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.NONE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temp, self._p(f"MANIFEST-{manifest['version']:012d}"), array)
        except Exception as e:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise MergedMeanwhile(manifest["version"]) from e
            raise

    def winners(self) -> DataFrame | None:
        """The kept deliveries, with the store's columns ``id_key``, ``set_key`` and ``store_period``."""
        m = self.manifest()
        return self._read(m, sorted(m["partitions"]))

    def index(self) -> DataFrame | None:
        """``of, key, delivery_id, id_key, set_key, store_period, bucket``: a row per delivery and identifier."""
        return self._index_of(self.manifest())

    def _index_of(self, m: dict) -> DataFrame | None:
        # parts are read one by one, so that the buckets of each are its partitions
        parts = [self.spark.read.schema(_INDEX).parquet(p) for p in m["index"]]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _read(self, m: dict, periods: list[str]) -> DataFrame | None:
        paths = [m["partitions"][p] for p in periods if p in m["partitions"]]
        return self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(*paths) if paths else None

    def merge(self, incoming: DataFrame) -> dict:
        """Merge a batch; returns ``{"version", "affected", "rewritten"}``. Deliveries that the store has seen already change nothing. Columns of
        the batch besides those that identify are kept, but for ones named ``id_key``, ``set_key`` or ``store_period``, which the store sets."""
        new = identify(incoming).withColumn("store_period", F.coalesce(F.date_format("delivered_at", "yyyy-MM"), F.lit("none")))
        if not new.groupBy("delivery_id").count().filter("count > 1").isEmpty():
            new = materialise(new.dropDuplicates(["delivery_id"]), "incoming")
        identities = materialise(new.select(*_IDENTITY), "identities")
        while True:
            try:
                return self._merged(new, identities)
            except MergedMeanwhile:
                continue

    def _merged(self, new: DataFrame, identities: DataFrame) -> dict:
        m, token = self.manifest(), uuid.uuid4().hex
        old_index = self._index_of(m)
        if old_index is None:
            related, affected = identities, set()
        else:
            related = self._related(identities, old_index)
            affected = {r[0] for r in related.select("store_period").distinct().collect()}  # periods: bounded by time, not by rows
        keys = message_keys(related)
        winning = keys.groupBy("message").agg(F.min("delivery_id").alias("delivery_id")).select("delivery_id")
        stored = self._read(m, sorted(affected))
        if stored is None:
            result = new.join(winning, "delivery_id", "left_semi")
        else:
            unseen = new.join(stored.select("delivery_id"), "delivery_id", "left_anti")
            # what is stored stays unless its message has another winner
            lost = related.select("delivery_id").join(winning, "delivery_id", "left_anti")
            result = unseen.join(winning, "delivery_id", "left_semi").unionByName(stored.join(lost, "delivery_id", "left_anti"), allowMissingColumns=True)
        staged = f"{self.path}/data-{token}"
        result.withColumn("store_part", F.col("store_period")).write.partitionBy("store_part").option("compression", "zstd").parquet(staged)
        entries = {s.getPath().getName().partition("=")[2]: f"{staged}/{s.getPath().getName()}" for s in self._fs.listStatus(self._p(f"data-{token}")) if s.getPath().getName().startswith("store_part=")}
        partitions = {p: d for p, d in m["partitions"].items() if p not in affected} | entries
        index = [*m["index"], self._write_index(_entries(identities), f"index-{token}")]
        if len(index) > INDEX_PARTS:
            index = [self._write_index(self._index_of({"index": index}).dropDuplicates(["of", "key", "delivery_id"]), f"compact-{token}")]
        self._publish({"version": m["version"] + 1, "partitions": partitions, "index": index, "schema": m["schema"] or result.schema.jsonValue()})
        return {"version": m["version"] + 1, "affected": sorted(affected), "rewritten": sorted(entries)}

    def _write_index(self, entries: DataFrame, name: str) -> str:
        entries.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return f"{self.path}/{name}"

    def _related(self, new: DataFrame, index: DataFrame) -> DataFrame:
        """The new identities and all indexed ones that may carry the same messages, found by repeated lookup until none is added. Only the buckets of
        the identifiers asked for are read."""
        found, fresh = new, new
        while True:
            hit = None
            for key in ("id_key", "set_key"):
                asked = fresh.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), _bucket(F.col(key)).alias("bucket")).distinct()
                part = index.filter(F.col("of") == key).join(asked, ["bucket", "key"], "left_semi")
                hit = part if hit is None else hit.unionByName(part)
            fresh = materialise(hit.select(*new.columns).dropDuplicates(["delivery_id"]).join(found.select("delivery_id"), "delivery_id", "left_anti"), "related")
            if fresh.isEmpty():
                return materialise(found, "found")
            found = found.unionByName(fresh)


def redelivered(deliveries: DataFrame, cut: float = 0.9) -> DataFrame:
    """``delivery_id`` of every delivery that is not the kept copy of its message.

    The deliveries up to the quantile ``cut`` of arrival time form the history, the rest is merged into it as a later batch. The outcome
    does not depend on where the cut is. An empty table gives no rows; a null ``delivered_at`` counts as history.
    """
    spark = deliveries.sparkSession
    at = deliveries.approxQuantile(["at"], [cut], 0.01) if "at" in deliveries.columns else deliveries.select(F.unix_micros("delivered_at").cast("double").alias("at")).approxQuantile("at", [cut], 0.01)
    at = at[0] if at and isinstance(at[0], float) else None
    store = DeliveryStore(spark)
    if at is None:
        store.merge(deliveries)
    else:
        late = F.coalesce(F.unix_micros("delivered_at") > F.lit(at), F.lit(False))
        store.merge(deliveries.filter(~late))
        store.merge(deliveries.filter(late))
    winners = store.winners()
    ids = deliveries.select("delivery_id").distinct()
    return ids if winners is None else ids.join(winners.select("delivery_id"), "delivery_id", "left_anti")
