"""Decisions on all pairs of reports within some hours, in blocks of numpy arrays: the rules of ``identity.decide``.

Reports further apart are never one event, so only those of the same or the next time bucket meet: what is decided grows with the
pairs within the hours. A bucket is cut into tiles of about ``TILE`` reports, and each two tiles are one task's block. Words
are compared by 64-bit hashes. What a block gives is up to the caller: pairs, or counts of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions import fixed as V
from wirelake.operators import identity as I
from wirelake.session import stage

#: Reports of a tile, about.
TILE = 4096
#: Word comparisons made at once, about.
AT_ONCE = 4_000_000
#: What a pair can be decided by, besides roundups and far times.
RULINGS = (
    "reject:different kinds of event", "reject:different prize or field", "reject:opposite claims about the same actor and action", "reject:different central actors", "neutral:no shared words",
    "accept:shared wording", "accept:two distinctive phrases in common", "neutral:one distinctive phrase only", "neutral:no distinctive shared words",
)
VERDICTS = np.array([r.split(":")[0] for r in RULINGS])
RANKS = np.array([{"accept": 0, "reject": 1, "neutral": 2}[v] for v in VERDICTS])


def verdict(code: Column) -> Column:
    return F.split(F.array(*[F.lit(r) for r in RULINGS])[code], ":")[0]


def reason(code: Column) -> Column:
    return F.split(F.array(*[F.lit(r) for r in RULINGS])[code], ":")[1]


def _bits(col: Column, values: list[Column]) -> Column:
    return sum((F.when(F.array_contains(col, v), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(values)), F.lit(0))


def coded(features: DataFrame, key: str) -> DataFrame:
    """Reports with ``identity.FEATURES`` as numbers: words as hashes, word groups as bits."""
    c = F.col
    hashed = lambda a: F.transform(a, lambda w: F.xxhash64(w))
    dates = F.array(*[F.lit(w) for w in V.DATE_WORDS])
    marks = F.transform("toks", lambda t: F.array_contains(dates, t).cast("int") + 2 * F.array_contains("rare", t).cast("int") + 4 * F.array_contains("names", t).cast("int"))
    heads = [F.lit(sorted(g.split())[0]) for g in V.ACTIONS]
    return features.where(F.size("toks") >= 2).select(
        c(key).alias("k"), "time", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day"), hashed("toks").alias("toks"), marks.alias("marks"), hashed("claim").alias("claim"), hashed("actor").alias("actor"),
        hashed("names").alias("names"), _bits(c("fam"), [F.lit(i) for i in range(len(V.EVENT_FAMILIES))]).alias("fam"), _bits(c("fld"), [F.lit(i) for i in range(len(V.FIELDS))]).alias("fld"), _bits(c("claim"), heads).alias("acts"),
        F.xxhash64("actor").alias("actor_key"), I._specific("actor").alias("specific"), F.when(c("bound") != "", F.xxhash64("bound")).otherwise(F.lit(0)).alias("bound"), c("negative").alias("negative"),
    )


def _numbered(frames: list[pd.DataFrame], col: str) -> list[np.ndarray]:
    """A list column of several frames as tables of numbers, filled up with ones that match nothing."""
    sizes = [f[col].map(len).to_numpy(np.int64) for f in frames]
    flat = [np.concatenate([*f[col], np.zeros(0, np.int64)]).astype(np.int64) for f in frames]
    ids = np.unique(np.concatenate(flat), return_inverse=True)[1].astype(np.int32)
    out = []
    for i, (n, part) in enumerate(zip(sizes, np.split(ids, [len(flat[0])]))):
        t = np.full((len(n), max(1, int(n.max()))), -1 - i, np.int32)
        t[np.arange(t.shape[1]) < n[:, None]] = part
        out.append(t)
    return out


def _sharing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two tables of numbers that share two of them: words of many rows by a product of matrices, others by their lists."""
    count = int(max(a.max(), b.max())) + 1
    (ra, ca), (rb, cb) = np.nonzero(a >= 0), np.nonzero(b >= 0)
    ta, tb = a[ra, ca], b[rb, cb]
    na, nb = np.bincount(ta, minlength=count), np.bincount(tb, minlength=count)
    many = na * nb > len(a) * len(b) // 2000 + 16
    at = np.cumsum(many) - 1
    width = int(many.sum())
    xa, xb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
    xa[ra[many[ta]], at[ta[many[ta]]]] = 1
    xb[rb[many[tb]], at[tb[many[tb]]]] = 1
    shared = (xa @ xb.T).astype(np.int32)
    few = ~many & (na > 0) & (nb > 0)
    ra, ta = ra[few[ta]], ta[few[ta]]
    rb, tb = rb[few[tb]], tb[few[tb]]
    order = np.argsort(tb, kind="stable")
    rb = rb[order]
    start = np.cumsum(np.where(few, nb, 0)) - np.where(few, nb, 0)
    times = nb[ta]
    left = np.repeat(ra, times)
    right = rb[np.repeat(start[ta], times) + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)]
    np.add.at(shared, (left, right), 1)
    return np.nonzero(shared >= 2)


def decide_block(left: pd.DataFrame, right: pd.DataFrame, same: bool, seconds: int) -> pd.DataFrame:
    """(a, b, code, support, n, union) of the pairs of two tiles of ``coded`` reports that share two words and lie within the seconds."""
    # a tile with itself: each two reports once
    toks = _numbered([left, right], "toks")
    i, j = _sharing(*toks)
    ta, tb = (f.time.to_numpy(float, na_value=np.nan) for f in (left, right))
    keep = ~(np.abs(ta[i] - tb[j]) > seconds)  # a time that isn't known is never far
    if same:
        keep &= i < j
    i, j = i[keep], j[keep]
    marks = [np.zeros(t.shape, np.int8) for t in toks]
    for m, t, f in zip(marks, toks, (left, right)):
        m[t >= 0] = np.concatenate([*f.marks, np.zeros(0, np.int64)])
    size = [(t >= 0).sum(1) for t in toks]
    lists = {c: _numbered([left, right], c) for c in ("claim", "actor", "names")}
    lens = {c: [(t >= 0).sum(1) for t in v] for c, v in lists.items()}
    facts = {c: (left[c].to_numpy(), right[c].to_numpy()) for c in ("fam", "fld", "acts", "actor_key", "specific", "bound", "negative")}
    days = [f.day.to_numpy(float, na_value=np.nan) for f in (left, right)]
    last = [np.where(n > 0, t[np.arange(len(t)), np.maximum(n - 1, 0)], -9 - s) for s, (t, n) in enumerate(zip(lists["actor"], lens["actor"]))]
    order = np.argsort(np.maximum(size[0][i], size[1][j]), kind="stable")  # long titles apart from short ones
    i, j = i[order], j[order]
    wide = np.maximum(size[0][i], size[1][j])
    code, support, n, union = np.zeros(len(i), np.int64), np.zeros(len(i), bool), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    step = 0
    while step < len(i):
        until = min(len(i), step + max(256, AT_ONCE // int(wide[min(len(i), step + 20_000) - 1]) ** 2))
        s = slice(step, until)
        code[s], support[s], n[s], union[s] = _rule(i[s], j[s], int(wide[until - 1]), toks, marks, size, lists, lens, facts, days, last)
        step = until
    ka, kb = left.k.to_numpy()[i], right.k.to_numpy()[j]
    turn = ka > kb
    return pd.DataFrame({"a": np.where(turn, kb, ka), "b": np.where(turn, ka, kb), "code": code, "support": support, "n": n, "union": union})


def _common(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many numbers each pair of rows shares."""
    out = np.zeros(len(i), np.int64)
    a, b = tables
    step = max(1, AT_ONCE // (a.shape[1] * b.shape[1]))
    for at in range(0, len(i), step):
        s = slice(at, at + step)
        out[s] = (a[i[s]][:, :, None] == b[j[s]][:, None, :]).sum((1, 2))
    return out


def _rule(i, j, wide, toks, marks, size, lists, lens, facts, days, last):
    a, b = toks[0][i, :wide], toks[1][j, :wide]
    ma, mb = marks[0][i, :wide], marks[1][j, :wide]
    met = a[:, :, None] == b[:, None, :]
    shared = met.any(2)
    place = met.argmax(2)  # in b, of what is shared
    both = shared & (ma & 1 == 0)
    n = both.sum(1)
    sa, sb = size[0][i], size[1][j]
    union = sa + sb - shared.sum(1)
    rare = both & (ma & 2 > 0)
    named = (ma & 4 > 0) | (np.take_along_axis(mb, np.minimum(place, mb.shape[1] - 1), 1) & 4 > 0)
    some, what = rare.sum(1), (rare & ~named).sum(1)
    code = np.full(len(i), -1, np.int64)

    def settle(at: np.ndarray, number: int) -> None:
        code[(code < 0) & at] = number

    for number, c in enumerate(("fam", "fld")):
        x, y = facts[c][0][i], facts[c][1][j]
        settle((x != 0) & (y != 0) & (x & y == 0), number)
    # opposite claims about the same actor and action, on one day
    day = np.flatnonzero((code < 0) & (days[0][i] == days[1][j]) & (facts["acts"][0][i] & facts["acts"][1][j] != 0))
    if len(day):
        p, q = i[day], j[day]
        claim = _common(lists["claim"], p, q)
        share = claim / np.maximum(1, lens["claim"][0][p] + lens["claim"][1][q] - claim)
        first = lists["actor"][0][p, 0], lists["actor"][1][q, 0]
        one = [lens["actor"][0][p] == 1, lens["actor"][1][q] == 1]
        equal = (facts["actor_key"][0][p] == facts["actor_key"][1][q]) | (one[0] & (first[0] == last[1][q])) | (one[1] & (first[1] == last[0][p]))
        x, y = facts["bound"][0][p], facts["bound"][1][q]
        differ = ~equal | ((x != 0) & (y != 0) & (x != y)) | (facts["negative"][0][p] != facts["negative"][1][q])
        against = (share >= 0.4) & differ
        against[against] = _common(lists["names"], p[against], q[against]) > 0
        code[day[against]] = 2
    apart = np.flatnonzero((code < 0) & facts["specific"][0][i] & facts["specific"][1][j])
    code[apart[_common(lists["actor"], i[apart], j[apart]) == 0]] = 3
    settle(n == 0, 4)
    wording = (n >= 2) & (n / union >= 0.25)
    beside = np.zeros(len(i), bool)
    two = np.flatnonzero(wording & (n == 2))
    if len(two):
        r, at = np.nonzero(both[two])
        at = at.reshape(-1, 2)
        there = place[two][np.arange(len(two))[:, None], at]
        beside[two] = (np.diff(at, axis=1)[:, 0] == 1) & (np.abs(np.diff(there, axis=1)[:, 0]) == 1)
    settle(wording & ((n >= 3) | (n == sa) | (n == sb) | ~beside), 5)
    phrases = np.minimum(some, 1)
    open_ = np.flatnonzero((code < 0) & (some >= 2) & (what >= 1))
    if len(open_):
        ra, pl = rare[open_], place[open_]
        rb = (met[open_] & ra[:, :, None]).any(1)
        here, there = ra[:, :-1] & ra[:, 1:], rb[:, :-1] & rb[:, 1:]
        again = here & (np.abs(pl[:, :-1] - pl[:, 1:]) == 1)
        phrases[open_] = np.maximum(1, some[open_] - here.sum(1) - there.sum(1) + again.sum(1))
    settle((phrases >= 2) & (what >= 1), 6)
    settle(some > 0, 7)
    settle(code < 0, 8)
    fine = RANKS[code]
    return code, (fine == 0) | ((fine == 2) & (what > 0)), n, union


def near_pairs(rows: DataFrame, seconds: int, give: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``give`` makes of the decided pairs of each block; every pair of ``coded`` rows within the seconds comes in one block.

    A row without a time may be near to any other, so its tiles meet all tiles.
    """
    rows = rows.withColumn("bucket", F.floor(F.col("time") / seconds))
    count = rows.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = stage(rows.join(F.broadcast(count), rows["bucket"].eqNullSafe(count["bucket"])).drop(count["bucket"]).withColumn("tile", F.pmod(F.xxhash64("k"), "tiles").cast("int")).drop("tiles"), "coded")
    tiles = rows.select("bucket", "tile").distinct()
    x, y = tiles.selectExpr("bucket as lb", "tile as lt"), tiles.selectExpr("bucket as rb", "tile as rt")
    on = ((F.col("lb") == F.col("rb")) & (F.col("lt") <= F.col("rt"))) | (F.col("rb") == F.col("lb") + 1) | (F.col("lb").isNull() & (F.col("rb").isNotNull() | (F.col("lt") <= F.col("rt"))))
    blocks = stage(x.join(F.broadcast(y), on), "blocks")
    at = ["lb", "lt", "rb", "rt"]
    lefts = rows.join(F.broadcast(blocks), rows["bucket"].eqNullSafe(F.col("lb")) & (F.col("tile") == F.col("lt")))
    rights = rows.join(F.broadcast(blocks), rows["bucket"].eqNullSafe(F.col("rb")) & (F.col("tile") == F.col("rt")))
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in rows.columns if c not in ("bucket", "tile")]
    block = F.xxhash64(*[F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 60))) for c in at]).alias("block")
    same = (F.col("lb").eqNullSafe(F.col("rb")) & (F.col("lt") == F.col("rt"))).alias("same")
    columns = [p.split() for p in schema.split(", ")]

    def decide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        same = len(left) > 0 and bool(left.same.iloc[0])
        if not len(left) or not (same or len(right)):
            return pd.DataFrame({c: [] for c, _ in columns})
        return give(decide_block(left, left if same else right, same, seconds))

    side = [s.select(block, same, *names).toDF("block", "same", *names).repartition(parts, "block").groupBy("block") for s in (lefts, rights.where(~same))]
    return side[0].cogroup(side[1]).applyInPandas(decide, schema)
