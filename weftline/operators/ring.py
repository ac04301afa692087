"""The consistent-hash ring as data: ids are 40 lower-case hex digits, so text order is numeric order."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

VNODES = 16
BITS = 160


def build(members: DataFrame, vnodes: int = VNODES) -> DataFrame:
    own = members.select("addr", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    return own.select(F.sha1(F.concat("addr", F.lit(":"), F.col("i").cast("string"))).alias("vnode_id"), "addr", F.col("i").cast("long").alias("i"))


def between(key: Column, a: Column, b: Column) -> Column:
    """key in the open arc from a to b; the arc from a to itself is all but a."""
    return F.when(a > b, (key > a) | (key < b)).when(a < b, (key > a) & (key < b)).otherwise(key != a)


def _sorted(ring: DataFrame) -> list[tuple[str, str]]:
    """The membership on the driver; it grows with the machines, not with the data."""
    return sorted((r["vnode_id"], r["addr"]) for r in ring.select("vnode_id", "addr").collect())


def _lookup(ring: DataFrame, side: str):
    """Ids and addresses by key, a batch at a time by binary search. Marked as not deterministic, so that a filter on the result stays above the aggregate that makes the keys distinct."""
    nodes = _sorted(ring)
    ids, addrs = np.array([x for x, _ in nodes], "S40"), np.array([a for _, a in nodes] + [None], object)
    names = np.array([x for x, _ in nodes] + [None], object)

    @F.pandas_udf("vnode_id string, addr string")
    def find(key: pd.Series) -> pd.DataFrame:
        own = key.isna().to_numpy()
        k = key.fillna("").to_numpy().astype("S40")
        at = np.searchsorted(ids, k, "left") % max(1, len(ids)) if side == "owner" else np.searchsorted(ids, k, "right") - 1
        at = np.where(own | (len(ids) == 0), len(ids), at % max(1, len(ids)))
        return pd.DataFrame({"vnode_id": names[at], "addr": addrs[at]})

    return find.asNondeterministic()


def owner(keys: DataFrame, ring: DataFrame, key: str = "key") -> DataFrame:
    """keys with `vnode_id` and `owner`: the first vnode at or after the key, else the first of all; null for a null key or without members."""
    return keys.withColumn("__n", _lookup(ring, "owner")(F.col(key))).withColumns({"vnode_id": F.col("__n.vnode_id"), "owner": F.col("__n.addr")}).drop("__n")


def closest(keys: DataFrame, ring: DataFrame, key: str = "key") -> DataFrame:
    """keys with `vnode_id`: the last vnode at or before the key, else the last of all."""
    return keys.withColumn("__n", _lookup(ring, "closest")(F.col(key))).withColumn("vnode_id", F.col("__n.vnode_id")).drop("__n")


def neighbours(ring: DataFrame, successors: int = 2) -> DataFrame:
    """(vnode_id, succ1, ..., pred) around the ring; the one window is over the membership table only."""
    order, every = W.orderBy("vnode_id"), W.orderBy("vnode_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ids = F.collect_list("vnode_id").over(every)
    n, at = F.size(ids), F.row_number().over(order)
    step = lambda k: F.get(ids, (at - 1 + k + n) % n)
    return ring.select("vnode_id", *(step(k).alias(f"succ{k}") for k in range(1, successors + 1)), step(-1).alias("pred"))


def moved(hosts: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(host, old_owner, new_owner) of hosts that another member owns now."""
    keyed = hosts.select("host", F.sha1("host").alias("key"))
    before = owner(keyed, old).select("host", "key", F.col("owner").alias("old_owner"))
    return owner(before, new).select("host", "old_owner", F.col("owner").alias("new_owner")).filter("old_owner <> new_owner")


def batches(urls: DataFrame, ring: DataFrame, most: int = 1000) -> DataFrame:
    """(owner, number, urls): urls (seq, host, url) by owner, in order of arrival and with repeats; a batch spans `most` values of seq, which bounds it."""
    owned = owner(urls.withColumn("key", F.sha1("host")), ring).withColumn("number", F.floor(F.col("seq") / most))
    return owned.groupBy("owner", "number").agg(F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("x")).select("owner", "number", F.transform("x", lambda r: r["url"]).alias("urls"))


def finger_id(vnode_id: str, k: int, bits: int = BITS) -> str:
    """The start of finger k of 0..bits-1, padded to 40 digits."""
    return f"{(int(vnode_id, 16) + (1 << max(0, k - 1))) % (1 << bits):040x}"


def fingers(ring: DataFrame, bits: int = BITS) -> DataFrame:
    """(vnode_id, k, finger, succ): every finger of every vnode with the vnode that follows it."""

    @F.pandas_udf("string")
    def start(vnode: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([finger_id(v, int(x), bits) for v, x in zip(vnode, k, strict=True)])

    own = ring.select("vnode_id", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("k")).select("vnode_id", "k", start("vnode_id", "k").alias("finger"))
    renamed = owner(own.withColumnRenamed("vnode_id", "node"), ring, "finger")
    return renamed.select(F.col("node").alias("vnode_id"), F.col("k").cast("long").alias("k"), "finger", F.col("vnode_id").alias("succ"))


def key_of(name: str) -> str:
    return hashlib.sha1(name.encode()).hexdigest()
