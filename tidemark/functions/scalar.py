"""Scalar functions on columns: digests, names, keys, and the middle of a text change. All are Catalyst expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No text is longer, so a binary search by these steps finds any prefix length.
_STEPS = [1 << k for k in range(30, -1, -1)]


def digest(data: Column) -> Column:
    """The content address of a string's or binary's bytes."""
    return F.sha2(data, 256)


def is_intact(data: Column, address: Column) -> Column:
    """Whether the bytes hash to their address."""
    return digest(data) == address


def encode_key(scope: Column, resource: Column) -> Column:
    """One string for a resource key, in the keys' order."""
    return F.concat(scope, F.lit("\0"), resource)


def object_name(identity: Column) -> Column:
    return F.concat(digest(identity), F.lit(".json"))


def segment_name(first: Column, last: Column, address: Column) -> Column:
    """Names sort as their counters do."""
    pad = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.concat_ws("-", pad(first), pad(last), F.concat(address, F.lit(".json")))


def oplog_name(sequence: Column, client: Column) -> Column:
    return F.concat(sequence.cast("string"), F.lit("_"), client, F.lit(".oplog"))


def parse_oplog_name(name: Column) -> Column:
    """struct<sequence, client>; null for a name that isn't one. The client may hold underscores."""
    part = lambda k: F.regexp_extract(name, r"^(\d+)_(.+)\.oplog$", k)
    return F.when(part(2) != "", F.struct(part(1).try_cast("long").alias("sequence"), part(2).alias("client")))


def snapshot_generation(millis: int, client: str) -> int:
    """Later snapshots have greater numbers; clients differ in the same millisecond."""
    return max(0, millis) << 16 | int.from_bytes(hashlib.sha256(client.encode()).digest()[:2], "big")


def snapshot_generation_of(millis: Column, client: Column) -> Column:
    suffix = F.conv(F.substring(digest(client), 1, 4), 16, 10).cast("long")
    return F.shiftleft(F.greatest(millis, F.lit(0)), 16).bitwiseOR(suffix)


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def sorted_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def decoded(data: Column) -> Column:
    """The text of bytes, null where they aren't UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def _longest(same, most: Column) -> Column:
    """The greatest n up to most for which same(n) holds, found bit by bit; same(n) must hold for all smaller n too."""
    steps = F.array(*map(F.lit, _STEPS))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & same(n + s), n + s).otherwise(n))


def diff_middle(old: Column, new: Column) -> Column:
    """struct<start, delete_len, insert>: replacing delete_len characters of old at start by insert gives new. In characters, so no surrogate pair is ever cut."""
    # each transform binds what the next one uses, so that nothing is evaluated twice
    pair = F.array(F.struct(old.alias("a"), new.alias("b"), F.char_length(old).alias("n"), F.char_length(new).alias("m")))
    first = F.lit(1)
    start = F.transform(pair, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["n"].alias("n"), p["m"].alias("m"), _longest(lambda k: p["a"].substr(first, k) == p["b"].substr(first, k), F.least(p["n"], p["m"])).alias("s")))
    tail = F.transform(start, lambda p: F.struct(p["b"].alias("b"), p["n"].alias("n"), p["m"].alias("m"), p["s"].alias("s"), _longest(lambda k: F.right(p["a"], k) == F.right(p["b"], k), F.least(p["n"], p["m"]) - p["s"]).alias("t")))
    return F.transform(tail, lambda p: F.struct(p["s"].alias("start"), (p["n"] - p["s"] - p["t"]).alias("delete_len"), p["b"].substr(p["s"] + 1, p["m"] - p["s"] - p["t"]).alias("insert")))[0]


def apply_diff(old: Column, change: Column) -> Column:
    rest = change["start"] + change["delete_len"] + 1
    return F.concat(old.substr(F.lit(1), change["start"]), change["insert"], old.substr(rest, F.greatest(F.char_length(old) - rest + 1, F.lit(0))))
