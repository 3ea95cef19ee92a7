"""References to records that do not exist.

Distinct non-null foreign keys are anti-joined against the parents' keys; only
the broken keys, few as a rule, are joined back to the records that refer. A
key that a third of all rows refer to is one row in the anti-join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.compact import compact, restore
from lodeflow.functions.text import normalised
from lodeflow.session import stored

#: A broken key is hot if it has more references than this share of a shuffle partition; its references are then split.
HOT_SHARE = 0.5
#: Parts of a hot key, at most.
MOST_SALTS = 1024


@dataclass(frozen=True)
class Parent:
    """A table referred to: its key, its arrival time, and the keys declared removed (a frame of one column)."""

    rows: DataFrame
    key: str
    time: str
    removed: DataFrame | None = None


def _key(c: str):
    """The normalised sid in its short form."""
    return compact(normalised(c))


@dataclass(frozen=True)
class Child:
    """A table that refers to others: its name, the record's identifier, its arrival time, and the parent of each reference field."""

    rows: DataFrame
    table: str
    record: str
    time: str
    parents: Mapping[str, Parent]


def references(child: Child, first: int = 0) -> DataFrame:
    """record_sid, first_seen, slot, ref_sid: each record's distinct non-null references; sids normalised and compact.

    slot: the number of the reference field, from `first` on. first_seen is the
    earliest arrival of any row of the record. Rows without a record identifier
    refer for nobody and give nothing; a blank reference is a reference to the
    empty key, a NULL one is none.
    """
    n = range(len(child.parents))
    rows = child.rows.select(_key(child.record).alias("_record"), F.col(child.time).alias("_time"), *[_key(f).alias(f"_f{i}") for i, f in enumerate(child.parents)]).where("_record IS NOT NULL")
    per_record = rows.groupBy("_record").agg(F.min("_time").alias("first_seen"), *[F.collect_set(f"_f{i}").alias(f"_f{i}") for i in n])
    numbered = lambda i: F.transform(f"_f{i}", lambda x: F.struct(F.lit(first + i).alias("slot"), x.alias("ref_sid")))
    pairs = F.flatten(F.array(*[numbered(i) for i in n]))
    return per_record.select(F.col("_record").alias("record_sid"), "first_seen", F.explode(pairs).alias("_r")).select("record_sid", "first_seen", "_r.slot", "_r.ref_sid")


def broken_keys(refs: DataFrame, parents: list[Parent]) -> DataFrame:
    """slot, ref_sid, parent_seen, _removed, _missing, _n (references): keys that are removed, absent, or later than their first use.

    The anti-join is written as an outer join, so that one pass also has the
    time of the parents that exist; all fields go through it together.
    """
    keys = refs.groupBy("slot", "ref_sid").agg(F.min("first_seen").alias("_used"), F.count("*").alias("_n"))
    side = ["slot", "ref_sid"]
    there = gone = None
    for slot, p in enumerate(parents):
        rows = p.rows.select(F.lit(slot).alias("slot"), _key(p.key).alias("ref_sid"), F.col(p.time).alias("_t"))
        there = rows if there is None else there.unionByName(rows)
        if p.removed is not None:
            rows = p.removed.select(F.lit(slot).alias("slot"), _key(p.removed.columns[0]).alias("ref_sid"))
            gone = rows if gone is None else gone.unionByName(rows)
    there = there.where("ref_sid IS NOT NULL").groupBy(*side).agg(F.min("_t").alias("parent_seen"), F.lit(True).alias("_there"))
    found = keys.join(there, side, "left")
    if gone is None:
        found = found.withColumn("_removed", F.lit(False))
    else:
        found = found.join(gone.where("ref_sid IS NOT NULL").distinct().withColumn("_removed", F.lit(True)), side, "left")
    found = found.select(*side, "parent_seen", F.coalesce("_removed", F.lit(False)).alias("_removed"), F.col("_there").isNull().alias("_missing"), "_used", "_n")
    return found.where("_removed OR _missing OR parent_seen > _used").drop("_used")


def find_orphans(*children: Child) -> DataFrame:
    """table_name, record_sid, ref_field, ref_sid, status, first_seen: each broken reference once.

    status is `removed` (declared removed, whether or not a row is left), else
    `missing` (no such key), else `late` (the parent's earliest arrival is after
    the referring record's). Several rows of one record count once for each
    distinct reference. Empty tables give no rows, or all references missing.
    All tables go through one pass.
    """
    slots = [(c.table, f, p) for c in children for f, p in c.parents.items()]
    all_ = None
    for c in children:
        r = references(c, next(i for i, (t, _, _) in enumerate(slots) if t == c.table))
        all_ = r if all_ is None else all_.unionByName(r)
    # Stored: the keys are counted from them, and broken keys are joined back to them.
    refs = stored(all_, "references")
    broken = stored(broken_keys(refs, [p for *_, p in slots]), "broken")
    # A broken key of a third of all rows must not gather in one task. Hot keys are told by their counts; there are
    # fewer of them than twice the shuffle partitions. All other keys, broken or not, go unsplit.
    partitions = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = broken.agg(F.max("_n").alias("n")).first().n or 0
    room = max(1, int(HOT_SHARE * refs.count() / partitions))
    if most > room:
        salts = min(MOST_SALTS, -(-most // room))
        hot = broken.where(F.col("_n") > room).select("slot", "ref_sid", F.lit(salts).alias("_parts"))
        refs = refs.join(F.broadcast(hot), ["slot", "ref_sid"], "left")
        refs = refs.withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("record_sid"), F.lit(salts))).otherwise(0).cast("int")).drop("_parts")
        broken = broken.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_n") > room, salts - 1).otherwise(0))))
        side = ["slot", "ref_sid", "_salt"]
    else:
        side = ["slot", "ref_sid"]
    status = F.when(F.col("_removed"), "removed").when(F.col("_missing"), "missing").when(F.col("parent_seen") > F.col("first_seen"), "late")
    named = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in slots]), F.col("slot") + 1)
    return (
        refs.join(broken, side)
        .withColumn("status", status)
        .where("status IS NOT NULL")
        .select(named(0).alias("table_name"), restore(F.col("record_sid")).alias("record_sid"), named(1).alias("ref_field"), restore(F.col("ref_sid")).alias("ref_sid"), "status", "first_seen")
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Broken references per table, field, status and period (the day the referring record first arrived)."""
    return orphans.groupBy("table_name", "ref_field", "status", F.to_date("first_seen").alias("period")).agg(F.count("*").alias("n_orphans"), F.countDistinct("ref_sid").alias("n_keys"))
