"""Schemas that drift between files: one table of all records, and a report of each change.

The schema of a file is a tree: a root with one node per key, keys of nested
objects below their parent's. Two kinds of edit scripts are worked out by the
tree edit distance of tree_distance.py:

* from a file's tree to the tree of the target schema. It says which quantity a
  key stands for and is compiled into a projection (target field <- key) that is
  applied to all records of the file;
* from the tree of a feed's previous file to that of the file. Its inserts,
  deletes, renames and moves are the changes reported. Leaves that stand for the
  same quantity may be renamed into each other, others may not.

Scripts depend on one file or on two successive ones, so they are found in
parallel, once for each distinct pair of schemas of a batch.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.uint256 import hex_to_text
from lodeflow.operators.tree_distance import DELETE, INSERT, Node, edit_script, tree_of
from lodeflow.session import stored

#: The raw block header.
BLOCK_FIELDS = (
    "block_hash", "parent_hash", "uncles_hash", "author", "state_root", "transactions_root", "receipts_root", "block_number",
    "gas_used", "gas_limit", "extra_data", "logs_bloom", "timestamp", "difficulty", "total_difficulty_binary",
    "total_difficulty_string", "total_difficulty_f64", "size", "mix_hash", "nonce", "base_fee_per_gas", "withdrawals_root", "chain_id",
)

#: The forms of a value, in the order in which ties are decided.
FORMS = ("integer", "real", "digits", "hex", "text", "list", "object", "boolean")

#: Words of block explorers and clients for the words of the header.
WORDS = {
    "wd": "withdrawals", "withdrawal": "withdrawals", "td": "total difficulty", "bf": "base fee", "basefee": "base fee", "bfpg": "base fee per gas",
    "diff": "difficulty", "work": "difficulty", "cumulative": "total", "bin": "binary", "bytes": "binary", "raw": "binary", "str": "string", "dec": "string", "decimal": "string", "float": "f64", "double": "f64",
    "ommers": "uncles", "ommer": "uncles", "uncle": "uncles", "sha3": "hash", "miner": "author", "coinbase": "author", "beneficiary": "author", "recipient": "author",
    "ts": "timestamp", "time": "timestamp", "mined": "timestamp", "epoch": "timestamp", "tx": "transactions", "txs": "transactions", "txn": "transactions", "transaction": "transactions", "receipt": "receipts", "trie": "root",
    "num": "number", "height": "number", "no": "number", "prevrandao": "mix hash", "randao": "mix hash", "bloom": "logs bloom", "log": "logs", "extra": "extra data", "graffiti": "extra data", "len": "size", "length": "size",
    "max": "limit", "consumed": "used", "usage": "used", "network": "chain", "ident": "id", "parents": "parent", "previous": "parent",
}
#: Words that add no meaning to a name.
NOISE = frozenset("of the block pow wei in at field value prev fee_recipient header eth".split())
#: Words that may stand for each other.
ALIKE = (frozenset({"root", "hash"}),)

#: A rename must be cheaper than a delete and an insert by a clear margin.
RENAME_LIMIT = 0.75


def form_of(value) -> str | None:
    """The form of a JSON value; None for null. Numbers come as _Number."""
    if value is None:
        return None
    if isinstance(value, _Number):
        return "integer" if re.fullmatch(r"-?\d+", value) else "real"
    if isinstance(value, str):
        return "digits" if re.fullmatch(r"[0-9]+", value) else "hex" if value[:2].lower() == "0x" else "text"
    return "boolean" if isinstance(value, bool) else "list" if isinstance(value, list) else "object"


class _Number(str):
    """A JSON number as it was written."""


def shape_of(value) -> str:
    """What a value looks like, apart from its form: address, word8 (16 hex digits) or other."""
    if isinstance(value, str) and value[:2].lower() == "0x":
        return {42: "address", 18: "word8"}.get(len(value), "other")
    return "other"


@functools.cache
def words(name: str) -> frozenset[str]:
    """The meaning-bearing words of a field name, in the header's vocabulary."""
    parts = re.findall(r"[A-Z]+(?![a-z])[0-9]*|[A-Z]?[a-z]+[0-9]*|[0-9]+", name)
    known = [w for p in parts for w in WORDS.get(p.lower(), p.lower()).split()]
    content = [w for w in known if w not in NOISE]
    return frozenset(content or known)


@functools.cache
def spelling(path: str) -> str:
    """What all spellings of a key outside the header share: its meaning-bearing words."""
    return " ".join(sorted(words(path.rsplit(".", 1)[-1])))


@functools.cache
def _vocabulary() -> frozenset[str]:
    return frozenset(w for f in BLOCK_FIELDS for w in words(f))


@functools.lru_cache(maxsize=1 << 16)
def rename_cost(path: str, shape: str, field: str) -> float:
    """0 for the same name, under RENAME_LIMIT for another name of the same quantity, else more."""
    name = path.rsplit(".", 1)[-1]
    if name == field:
        return 0.0
    mine, theirs = words(name), words(field)
    unknown = [w for w in mine if w not in _vocabulary() and not (w in ("fee",) and field == "author")]
    if unknown:
        # A name of foreign words can only be told by values no other field has.
        return 0.7 if (shape, field) in {("address", "author"), ("word8", "nonce")} else 2.0
    both = mine & theirs
    left, right = mine - both, theirs - both
    for a in ALIKE:
        if left & a and right & a:
            both, left, right = both | (left & a), left - a, right - a
    if "author" in both:
        left = left - {"fee"}
    if not both or (shape == "address") != (field == "author"):
        return 2.0
    return 0.1 + 1.2 * (1 - 2 * len(both) / (2 * len(both) + len(left) + len(right)))


@functools.cache
def _target_tree(target: tuple[str, ...]) -> Node:
    return tree_of(dict.fromkeys(target))


def target_script(nodes: tuple[tuple[str, str], ...], target: tuple[str, ...] = BLOCK_FIELDS) -> dict[str, str]:
    """Path -> field for the leaves that stand for a field of the target, by the script from a file's tree (path, shape) to the target's."""

    def cost(x: Node, y: Node) -> float:
        c = rename_cost(x.path, x.data, y.path)
        return c if c < RENAME_LIMIT else INSERT + DELETE

    _, ops = edit_script(tree_of(dict(nodes)), _target_tree(target), cost)
    return {x: y for op, x, y in ops if op in ("keep", "rename", "move")}


def file_script(before: tuple[tuple[str, str], ...], after: tuple[tuple[str, str], ...]) -> list[tuple[str, str | None, str | None]]:
    """The script from one file's tree to the next one's. Leaves: path and what it stands for (equal texts: the same quantity)."""

    def cost(x: Node, y: Node) -> float:
        return INSERT + DELETE if x.data != y.data else 0.0 if x.path == y.path else 0.3

    return edit_script(tree_of(dict(before)), tree_of(dict(after)), cost)[1]


def _nodes(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for k, v in obj.items():
        if isinstance(v, dict) and v:
            yield from _nodes(v, f"{prefix}{k}.")
        else:
            yield prefix + k, v


def parse(record: str | None) -> dict | None:
    try:
        obj = json.loads(record, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except (TypeError, ValueError, RecursionError):
        return None
    return obj if isinstance(obj, dict) else None


def _profile(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of (file, path, form, shape), counted within each Arrow batch."""
    for b in batches:
        seen: Counter = Counter()
        for feed, seq, record in zip(b.feed, b.file_seq, b.record, strict=True):
            for path, value in _nodes(parse(record) or {}):
                seen[feed, seq, path, form_of(value), shape_of(value)] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feed", "file_seq", "path", "form", "shape", "n"])


@functools.lru_cache(maxsize=4096)
def _script(nodes: tuple[tuple[str, str], ...]) -> dict[str, str]:
    return target_script(nodes)


def _scripts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for feed, seq, nodes in zip(b.feed, b.file_seq, b.nodes, strict=True):
            shapes = tuple(sorted((x["path"], x["shape"]) for x in nodes))
            script = _script(shapes)
            out += [(feed, seq, x["path"], script.get(x["path"], x["path"]), x["path"] in script, x["form"], spelling(x["path"])) for x in nodes]
        yield pd.DataFrame(out, columns=["feed", "file_seq", "path", "field", "in_target", "form", "spelling"])


_compare = functools.lru_cache(maxsize=4096)(file_script)
#: What the operations of a script are called in the report.
CHANGES = {"insert": "added", "delete": "removed", "rename": "renamed", "move": "renamed"}


def _differences(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The changes of each file against its predecessor, by the script between their trees."""
    for b in batches:
        out = []
        for feed, seq, before, after in zip(b.feed, b.file_seq, b.before, b.after, strict=True):
            trees = [tuple(sorted((x["path"], x["thing"]) for x in side)) if side is not None else () for side in (before, after)]
            if trees[0] != trees[1]:
                field = {x["path"]: x["field"] for side in (before, after) if side is not None for x in side}
                out += [(feed, seq, field[y or x], CHANGES[op]) for op, x, y in _compare(*trees) if op in CHANGES]
        yield pd.DataFrame(out, columns=["feed", "file_seq", "field", "change"])


def file_fields(records: DataFrame) -> DataFrame:
    """feed, file_seq, path, field, in_target, form, spelling: each file's fields, named as in the target, with their usual form.

    records: feed, file_seq, record (a JSON object; others are ignored). A record
    that is no JSON object adds no field. The form is the most frequent one of
    the non-null values (ties: the order of FORMS), NULL if there is none.
    """
    counts = records.select("feed", "file_seq", "record").mapInPandas(_profile, "feed string, file_seq bigint, path string, form string, shape string, n bigint").groupBy("feed", "file_seq", "path", "form", "shape").agg(F.sum("n").alias("n"))
    by_form = counts.groupBy("feed", "file_seq", "path", "form").agg(F.sum("n").alias("n"), F.max(F.struct("n", "shape")).alias("_s"))
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMS]), F.col("form"))
    best = F.max(F.when(F.col("form").isNotNull(), F.struct("n", (-rank).alias("_r"), "form", F.col("_s.shape").alias("shape"))))
    fields = by_form.groupBy("feed", "file_seq", "path").agg(best.alias("_b"))
    node = F.struct("path", F.col("_b.form").alias("form"), F.coalesce("_b.shape", F.lit("other")).alias("shape"))
    # Few bytes, but work for each: as many tasks as there are shuffle partitions, whatever the size.
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schemas = fields.repartition(parts, "feed", "file_seq").groupBy("feed", "file_seq").agg(F.collect_list(node).alias("nodes"))
    return schemas.mapInPandas(_scripts, "feed string, file_seq bigint, path string, field string, in_target boolean, form string, spelling string")


def changes(records: DataFrame) -> DataFrame:
    """feed, file_seq, field, change: one row per change of a file against the feed's previous file.

    change: added, removed, renamed (moves to another depth included), retyped.
    The first file of a feed has none. A file without any readable record still
    counts as a file (all its fields are removed). A file in which a field is
    NULL throughout leaves its form as it was; after an absence the form starts
    anew. Keys stand for the same quantity if their scripts name the same field
    of the target; outside the target, if they spell the same words, unless a
    file of the feed has two such keys side by side.
    """
    of_words = Window.partitionBy("feed", "in_target", "spelling")
    beside = F.max(F.col("_twin")).over(of_words)
    thing = F.when(F.col("in_target"), F.concat(F.lit("="), "field")).when((F.col("spelling") != "") & ~beside, F.concat(F.lit("~"), "spelling")).otherwise(F.concat(F.lit("-"), "path"))
    twin = F.coalesce(F.lag("file_seq").over(of_words.orderBy("file_seq")) == F.col("file_seq"), F.lit(False))
    # Stored: a few rows per file, of which both reports are made.
    fields = stored(file_fields(records).withColumn("_twin", twin).withColumn("thing", thing), "fields")
    in_feed = Window.partitionBy("feed").orderBy("file_seq")
    files = records.select("feed", "file_seq").distinct()
    trees = files.join(fields.groupBy("feed", "file_seq").agg(F.collect_list(F.struct("path", "thing", "field")).alias("after")), ["feed", "file_seq"], "left")
    pairs = trees.select("feed", "file_seq", F.lag("file_seq").over(in_feed).alias("_b"), F.lag("after").over(in_feed).alias("before"), "after").where("_b IS NOT NULL").drop("_b")
    pairs = pairs.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "feed", "file_seq")
    schema = "feed string, file_seq bigint, field string, change string"
    differences = pairs.mapInPandas(_differences, schema)

    numbered = files.select("*", F.row_number().over(in_feed).alias("_n"))
    of_field = Window.partitionBy("feed", "thing").orderBy("_n")
    rows = fields.join(numbered, ["feed", "file_seq"]).select("feed", "file_seq", "field", "thing", "form", "_n", (F.col("_n") - F.row_number().over(of_field)).alias("_run"))
    in_run = Window.partitionBy("feed", "thing", "_run").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    retyped = rows.withColumn("_form", F.last("form", ignorenulls=True).over(in_run)).where("form <> _form").select("feed", "file_seq", "field", F.lit("retyped").alias("change"))
    return differences.unionByName(retyped)


#: Fields that hold whole numbers, with their types, those that hold bytes, and bytes that are a number.
NUMBERS = {
    "block_number": "bigint", "gas_used": "bigint", "gas_limit": "bigint", "timestamp": "bigint", "difficulty": "decimal(38,0)", "total_difficulty_string": "decimal(38,0)", "size": "bigint", "base_fee_per_gas": "decimal(38,0)", "chain_id": "bigint",
}
BYTES = ("withdrawals_root", "extra_data")
NUMBER_BYTES = ("total_difficulty_binary",)
DOUBLES = ("total_difficulty_f64",)


def _from_hex(v: Column) -> Column:
    """decimal(38,0) of '0x' and up to 64 hex digits; NULL beyond its range or for other texts."""
    return F.when(v.rlike("^0[xX][0-9a-fA-F]{1,64}$"), hex_to_text(F.concat(F.lit("0x"), F.substring(v, 3, 64))).try_cast("decimal(38,0)"))


def _number(v: Column) -> Column:
    """decimal(38,0) of a decimal, hexadecimal or real number, or the epoch seconds of a time; NULL for others and for real numbers of 16 digits or more, which have lost some."""
    real = v.try_cast("double")
    whole = F.when(v.rlike("^[0-9]{1,38}$"), v.try_cast("decimal(38,0)"))
    exact = F.when(v.rlike(r"^[0-9]+(\.[0-9]+)?([eE][+]?[0-9]+)?$") & (real < 1e15), F.floor(real).cast("decimal(38,0)"))
    when = F.when(v.rlike(r"^\d{4}-\d\d-\d\dT"), F.unix_seconds(v.try_cast("timestamp")).cast("decimal(38,0)"))
    return F.coalesce(_from_hex(v), whole, exact, when)


def _bytes(v: Column) -> Column:
    """0x text in lower case of bytes given as hexadecimal, as a list of its pieces or in base 64; NULL for others."""
    pieces = F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), ""))
    base64 = F.when(v.rlike(r"^[A-Za-z0-9+/]{20,}={0,2}$") & ~v.rlike("^[0-9]+$") & (F.length(v) % 4 == 0), F.concat(F.lit("0x"), F.hex(F.unbase64(v))))
    found = F.lower(F.coalesce(pieces, base64, v))
    return F.when(found.rlike("^0x[0-9a-f]*$"), found)


def _number_bytes(v: Column) -> Column:
    """0x text, without zeros ahead, of a number given as bytes or as whole number; NULL where digits were lost."""
    n = _number(v)
    two64 = F.lit(str(1 << 64)).cast("decimal(20,0)")
    high, low = ((n - n % two64) / two64).cast("decimal(20,0)").cast("string"), (n % two64).cast("decimal(20,0)").cast("string")
    made = F.when(n.isNotNull(), F.lower(F.concat(F.conv(high, 10, 16), F.lpad(F.conv(low, 10, 16), 16, "0"))))
    hexed = F.coalesce(F.substring(_bytes(v), 3, 200), made)
    return F.when(hexed.isNotNull(), F.concat(F.lit("0x"), F.regexp_replace(hexed, "^0+(?=.)", "")))


def consolidate(records: DataFrame) -> DataFrame:
    """file_seq, feed, file_name, record_no, the target's fields, and other (map of all other keys).

    Every record comes out once, by the projection its file's script compiles
    to; a record that is no JSON object has only NULLs. Each field has one type
    and one form, whichever the file uses: whole numbers as bigint or
    decimal(38,0), total_difficulty_f64 as double, bytes as lower-case 0x text,
    all else as text. A value that can't be brought into its field's form (a
    real number that has lost digits, say) is NULL there and in `other` under
    the field's name and "!".
    """
    projection = file_fields(records).where("in_target").groupBy("feed", "file_seq").agg(F.map_from_entries(F.collect_list(F.struct("field", "path"))).alias("_keys"))
    rows = records.select("file_seq", "feed", "file_name", "record_no", "record").join(projection, ["feed", "file_seq"], "left").withColumn("_r", F.from_json("record", "map<string,string>"))

    def raw(field: str) -> Column:
        key = F.element_at("_keys", F.lit(field))
        return F.coalesce(F.element_at("_r", key), F.when(key.contains("."), F.call_function("get_json_object", F.col("record"), F.concat(F.lit("$."), key))))

    rows = rows.withColumn("_v", F.struct(*[raw(f).alias(f) for f in BLOCK_FIELDS]))

    def value(field: str) -> Column:
        v = F.col(f"_v.{field}")
        if field in NUMBERS:
            return _number(v).try_cast(NUMBERS[field])
        if field in DOUBLES:
            return v.try_cast("double")
        return _number_bytes(v) if field in NUMBER_BYTES else _bytes(v) if field in BYTES else v

    formed = [f for f in BLOCK_FIELDS if f in NUMBERS or f in BYTES or f in NUMBER_BYTES or f in DOUBLES]
    used = F.map_values("_keys")
    other = F.map_filter("_r", lambda k, _: ~F.coalesce(F.array_contains(used, k), F.lit(False)))
    lost = F.filter(F.array(*[F.when(F.col(f).isNull() & F.col(f"_v.{f}").isNotNull(), F.struct(F.lit(f"{f}!").alias("key"), F.col(f"_v.{f}").alias("value"))) for f in formed]), lambda x: x.isNotNull())
    rows = rows.select("file_seq", "feed", "file_name", "record_no", "_v", other.alias("other"), *[value(f).alias(f) for f in BLOCK_FIELDS])
    both = F.when(F.size(lost) > 0, F.map_concat("other", F.map_from_entries(lost))).otherwise(F.col("other"))
    return rows.select("file_seq", "feed", "file_name", "record_no", *BLOCK_FIELDS, both.alias("other"))
