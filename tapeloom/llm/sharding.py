"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents are linked when their texts are equal (null counts as empty). Propagation runs on a table with one row for
each (group of equal texts, shard) and the number of the group's documents there, which is far smaller than the
documents, and the same for a group of three and one of a billion. In a round each group picks as its target the
shard with most of it that still has room; parts of it elsewhere move there, and where more want in than fit, every
part sends the fraction that the quota allows. What propagation leaves cut is then made whole: groups above 1/64 of a shard,
of which there are at most 64 a shard, are packed by size; of the smaller ones those whole in a shard with room for
them stay, and the others are laid end to end over the room that is left, where no more than one a shard can meet an
edge. Those take the first room that fits. Documents without a twin follow no neighbour: they fill what is left.
At the end counts differ by one at most.

Native: DataFrame functions only; on the driver are numbers of one row a shard, and at most 64 groups a shard. Defined results: null and empty texts
have size 1 and crc32 0 and are one group; equal rows are placed as separate documents; extra columns are dropped; an
empty table gives an empty result; rows with equal ids and texts take their slots in any order. Of a text of any length
only its size and digests travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, rank_within, spread_of, text_of

#: Groups of one document have this key, which no text has (keys of texts are hex digits).
ALONE = "-"


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, key): what sharding needs of a document; key is the text's SHA-256."""
    text = text_of(df, text_col)
    return df.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(F.encode(text, "UTF-8"), 256).alias("key"))


def loads(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def scattered(state: DataFrame) -> int:
    """Documents that are in another shard than most of their group."""
    best = state.groupBy("key").agg((F.sum("n") - F.max("n")).alias("n"))
    return best.agg(F.sum("n").alias("n")).first()["n"] or 0


def propagate(state: DataFrame, caps: list[int], gain: float = 1 / 16) -> tuple[DataFrame, list[int]]:
    """Rounds of balanced label propagation on state (key, shard, n), as long as a round brings a share of `gain` of the
    scattered documents home. What is left then is for `finish`, which leaves no group cut that fits."""
    shards = len(caps)
    spark = state.sparkSession
    load, turn, left = loads(state, shards), 0, scattered(state)
    while left:
        room = [max(0, c - n) for c, n in zip(caps, load, strict=True)]
        if not any(room):
            break
        free = F.array(*[F.lit(r > 0) for r in room])
        of_key = Window.partitionBy("key").orderBy(F.when(F.get(free, F.col("shard")), F.col("n")).otherwise(-1).desc(), F.xxhash64("key", "shard"))
        aimed = state.withColumn("target", F.first(F.when(F.get(free, F.col("shard")), F.col("shard")), ignorenulls=False).over(of_key))
        aimed = cut(aimed.withColumn("at_target", F.max(F.when(F.col("shard") == F.col("target"), F.col("n"))).over(Window.partitionBy("key"))))
        # Parts in open shards are smaller than the target's; a part in a full shard stays unless it is smaller, too.
        wants = (F.col("shard") != F.col("target")) & (F.get(free, F.col("shard")) | (F.col("n") < F.col("at_target")))
        asked = {r["target"]: r["n"] for r in aimed.filter(wants).groupBy("target").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        part = F.get(F.array(*[F.lit(min(1.0, room[s] / asked[s]) if asked.get(s) else 0.0) for s in range(shards)]), F.col("target"))
        lot = F.pmod(F.xxhash64("key", "shard", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moved = aimed.withColumn("moved", F.when(wants, F.least(F.col("n"), F.floor(F.col("n") * part + lot))).otherwise(F.lit(0)).cast("long"))
        both = F.explode(F.array(F.struct(F.col("shard"), (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("moved").alias("n"))))
        state = cut(moved.select("key", both.alias("x")).select("key", "x.*").filter("n > 0").groupBy("key", "shard").agg(F.sum("n").alias("n")))
        load, turn, before, left = loads(state, shards), turn + 1, left, scattered(state)
        if left > before * (1 - gain):
            break
    return state, load


def pack(groups: list[tuple[str, int, int | None]], room: list[int]) -> list[tuple[str, int, int]]:
    """(key, shard, n) of groups (key, n, shard with most of it), the largest first: whole in that shard if it fits, else
    where it leaves least; what fits nowhere fills the shards with most room. Of both orders the one that cuts less."""

    def tried(stay: bool) -> tuple[int, list[tuple[str, int, int]]]:
        left, out, whole, parts = list(room), [], 0, []
        for key, n, at in sorted(groups, key=lambda g: (-g[1], g[0])):
            fits = [s for s in range(len(left)) if left[s] >= n]
            if fits:
                s = at if stay and at in fits else min(fits, key=lambda s: (left[s], s))
                left[s] -= n
                out.append((key, s, n))
                whole += n
            elif n > max(room):
                out += filled(key, n, left)
            else:
                parts.append((key, n))  # after those that fit
        for key, n in parts:
            out += filled(key, n, left)
        return whole, out

    def filled(key: str, n: int, left: list[int]) -> list[tuple[str, int, int]]:
        out = []
        while n:
            s = max(range(len(left)), key=lambda s: (left[s], -s))
            x = min(n, left[s])
            left[s] -= x
            n -= x
            out.append((key, s, x))
        return out

    return max((tried(True), tried(False)), key=lambda x: x[0])[1]


def upto_within(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds upto, the sum of n up to and with each row among those of equal keys, with no key's rows in one task."""
    df = df.withColumn("__bucket", spread_of(F.col("key"), buckets=buckets))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = df.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__n")).withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.sum("n").over(Window.partitionBy(*keys, "__bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("upto", within).join(offs, [*keys, "__bucket"]).withColumn("upto", F.col("upto") + F.col("__off")).drop("__bucket", "__off")


def finish(state: DataFrame, caps: list[int], buckets: int = 1024) -> tuple[DataFrame, list[int]]:
    """State with every group whole that fits, and no shard over its quota."""
    shards, spark = len(caps), state.sparkSession
    most = F.max(F.struct("n", (-F.col("shard")).alias("s")))
    groups = cut(state.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("shards"), (-most["s"]).alias("shard")))
    large = F.col("n") > max(min(caps) // 64, 1)
    placed = pack([(r["key"], r["n"], r["shard"]) for r in groups.filter(large).select("key", "n", "shard").collect()], caps)
    room = list(caps)
    for _, s, n in placed:
        room[s] -= n

    small = groups.filter(~large)
    held = upto_within(small.filter("shards = 1").select("key", "shard", "n"), ["shard"], buckets)
    free = F.get(F.array(*[F.lit(r).cast("long") for r in room]), F.col("shard"))
    held = cut(held.withColumn("stays", F.col("upto") <= free))
    kept = held.filter("stays").select("key", "shard", "n")
    room = [r - n for r, n in zip(room, loads(kept, shards), strict=True)]
    pool = held.filter(~F.col("stays")).select("key", "n").unionByName(small.filter("shards > 1").select("key", "n"))
    ends = [sum(room[: s + 1]) for s in range(shards)]
    at = lambda x: F.filter(F.array(*[F.struct(F.lit(e).cast("long").alias("e"), F.lit(s).alias("s")) for s, e in enumerate(ends)]), lambda p: p["e"] > x)[0]["s"]
    laid = upto_within(pool.withColumn("all", F.lit(ALONE)), ["all"], buckets).drop("all")
    laid = cut(laid.withColumn("shard", at(F.col("upto") - F.col("n"))).withColumn("last", at(F.col("upto") - 1)))
    inside = laid.filter("shard = last").select("key", "shard", "n")
    room = [r - n for r, n in zip(room, loads(inside, shards), strict=True)]
    placed += pack([(r["key"], r["n"], None) for r in laid.filter("shard != last").select("key", "n").collect()], room)  # at most one a shard
    few = spark.createDataFrame(placed, "key string, shard int, n long")
    state = cut(kept.unionByName(inside).unionByName(few))
    return state, loads(state, shards)


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """(id, size, text_crc32, law 'rows', shard, slot, grown_shard null, group_rows, group_shards).

    slot counts the rows of a shard from 0. group_rows and group_shards: documents with the text, and shards they lie in.
    """
    docs = cut(narrow(df, id_col, text_col).withColumn("part", spread_of(F.col(id_col), F.col("text_crc32"), buckets=buckets)))
    caps = quotas(docs.count(), shards)

    # Sizes of groups without their rows in one task: counts by (key, part) first.
    parts = docs.groupBy("key", "part").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("group_rows")).filter("group_rows > 1")
    first = F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int").alias("shard")
    state = cut(parts.join(sizes, "key", "left_semi").groupBy("key", first).agg(F.sum("n").alias("n")))
    state, load = finish(propagate(state, caps)[0], caps, buckets)

    # Where each group's documents go, by rank in the group: up to one row a shard, as an array.
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("shard"))
    places = state.withColumn("upto", upto).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("places"), F.max("upto").alias("group_rows"))
    tagged = parts.join(places, "key", "left")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    grouped = tagged.filter("places is not null").withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy(id_col)) - 1
    ranked = docs.withColumn("rank", within).join(grouped, ["key", "part"], "left")
    rank = F.col("rank") + F.col("before")
    where = F.filter("places", lambda p: p["upto"] > rank)[0]["shard"]
    placed = cut(ranked.select(id_col, "size", "text_crc32", F.coalesce("group_rows", F.lit(1)).alias("group_rows"), F.size(F.col("places")).alias("group_shards"), where.alias("shard")))

    # A shard over its quota releases the excess; those and the documents without a twin fill the rest, by intervals.
    linked = placed.filter("shard is not null")
    if any(n > c for n, c in zip(load, caps, strict=True)):
        over = rank_within(linked, ["shard"], [id_col, "text_crc32"], "rank", buckets)
        cap = F.get(F.array(*[F.lit(c) for c in caps]), F.col("shard"))
        linked = cut(over.withColumn("shard", F.when(F.col("rank") < cap, F.col("shard"))).drop("rank"))
        load = [min(n, c) for n, c in zip(load, caps, strict=True)]
        loose = linked.filter("shard is null").unionByName(placed.filter("shard is null"))
        linked = linked.filter("shard is not null")
    else:
        loose = placed.filter("shard is null")
    ends, total = [], 0
    for n, c in zip(load, caps, strict=True):
        total += c - n
        ends.append(total)
    filled = rank_within(loose.withColumn("all", F.lit(ALONE)), ["all"], [id_col, "text_crc32"], "rank", buckets).drop("all")
    which = F.filter(F.array(*[F.struct(F.lit(e).alias("upto"), F.lit(s).alias("shard")) for s, e in enumerate(ends)]), lambda p: p["upto"] > F.col("rank"))[0]["shard"]
    every = cut(linked.unionByName(filled.withColumn("shard", which).drop("rank")))
    out = rank_within(every, ["shard"], [id_col, "text_crc32"], "slot", buckets)
    return out.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "group_rows", F.greatest(F.coalesce("group_shards", F.lit(1)), F.lit(1)).alias("group_shards"))
