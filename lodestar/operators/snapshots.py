"""What changed between full snapshots: validity intervals by gaps and islands.

All rows of a key meet once, in one exchange on the key: the row that holds for a snapshot is picked by
aggregation, snapshots get consecutive ordinals (a snapshot never delivered leaves no hole), and runs of
equal row hashes over adjacent ordinals are islands. An island is a validity interval; its start, its end
and its adjacency to the next one are the change events.

Only the key, two numbers and a 64-bit row hash are shuffled. Defined results: rows without a key or a
snapshot number are ignored; the first snapshot has no events; blank text counts as null; a key present
in every snapshot with one hash has no events; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import small_side


def plain(c: Column) -> Column:
    """A text without case, outer space and the difference between blank and null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def instant(c: Column) -> Column:
    """Canonical text of a UTC time however written; other texts as :func:`plain` leaves them."""
    s = F.nullif(F.trim(c), F.lit(""))
    zoned = F.when(s.rlike(r"(?i)([zZ]|[+-]\d{2}:?\d{2}|\b[a-z]{2,5})$"), s).otherwise(F.concat(s, F.lit("Z")))
    micros = F.unix_micros(zoned.try_cast("timestamp"))
    return F.coalesce(micros.cast("string"), plain(c))


def row_hash(columns: list[Column]) -> Column:
    """64-bit hash in which a null differs from every value and positions count."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns])


def holding_rows(snapshots: DataFrame, key: str, number: str, loaded: str, hashed: Column) -> DataFrame:
    """(key, no, h): for each snapshot and key the row loaded last, partitioned by key. Equal load times: the larger hash."""
    src = snapshots.select(F.col(key).alias("key"), F.col(number).alias("no"), F.col(loaded).alias("at"), hashed.alias("h")).where("key is not null and no is not null")
    return src.repartition("key").groupBy("key", "no").agg(F.max(F.struct(F.col("at"), F.col("h"))).alias("last")).select("key", "no", F.col("last.h").alias("h"))


def snapshot_ordinals(snapshots: DataFrame, number: str) -> DataFrame:
    """(no, ord, last_ord): delivered snapshots in order; as small as the number of deliveries."""
    d = snapshots.select(F.col(number).alias("no")).where("no is not null").distinct()
    return d.select("no", F.row_number().over(Window.orderBy("no")).alias("ord")).withColumn("last_ord", F.max("ord").over(Window.partitionBy()))


def validity_intervals(snapshots: DataFrame, hashed: Column, key: str = "id", number: str = "snapshot_no", loaded: str = "loaded_at") -> DataFrame:
    """(key, h, from_ord, to_ord, last_ord): maximal runs of adjacent snapshots in which the key has one row hash."""
    rows = holding_rows(snapshots, key, number, loaded, hashed).join(small_side(snapshot_ordinals(snapshots, number)), "no")
    w = Window.partitionBy("key").orderBy("no")  # the order of ord, and the one the aggregation leaves
    starts = (F.lag("ord").over(w).isNull() | (F.lag("ord").over(w) != F.col("ord") - 1) | (F.lag("h").over(w) != F.col("h"))).cast("int")
    runs = rows.withColumn("new", starts).withColumn("island", F.sum("new").over(w))
    return runs.groupBy("key", "island").agg(F.first("h").alias("h"), F.min("ord").alias("from_ord"), F.max("ord").alias("to_ord"), F.first("last_ord").alias("last_ord")).drop("island")


def change_events(snapshots: DataFrame, hashed: Column, key: str = "id", number: str = "snapshot_no", loaded: str = "loaded_at") -> DataFrame:
    """(number, key, change_kind): ``added``, ``removed``, ``changed`` against the delivered snapshot before."""
    iv = validity_intervals(snapshots, hashed, key, number, loaded)
    w = Window.partitionBy("key").orderBy("from_ord")
    adjacent_before = F.coalesce(F.lag("to_ord").over(w) == F.col("from_ord") - 1, F.lit(False))
    adjacent_after = F.coalesce(F.lead("from_ord").over(w) == F.col("to_ord") + 1, F.lit(False))
    start = F.when(F.col("from_ord") == 1, F.lit(None)).when(adjacent_before, F.struct(F.col("from_ord").alias("ord"), F.lit("changed").alias("change_kind"))).otherwise(F.struct(F.col("from_ord").alias("ord"), F.lit("added").alias("change_kind")))
    end = F.when(~adjacent_after & (F.col("to_ord") < F.col("last_ord")), F.struct((F.col("to_ord") + 1).alias("ord"), F.lit("removed").alias("change_kind")))
    events = iv.select("key", start.alias("s"), end.alias("e")).select("key", F.explode(F.array_compact(F.array("s", "e"))).alias("x")).select("key", "x.ord", "x.change_kind")
    ords = small_side(snapshot_ordinals(snapshots, number).select("no", "ord"))
    return events.join(ords, "ord").select(F.col("no").alias(number), F.col("key").alias(key), "change_kind")
