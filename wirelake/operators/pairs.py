"""Pair operators: inverted-index joins, vector search in blocks, pair scores, groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.session import stage

#: Bytes of query vectors that are broadcast at a time.
QUERY_BYTES = 32 << 20
#: Rows of a posting list that meet at a time.
BLOCK = 512
#: Rows above which rows are counted by the set of their frequent tokens, not one by one.
FREQUENT = 512


def token_pairs(rows: DataFrame, key: str, tokens: str, least: int, share: float = 0.0, upto: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, that share at least ``least`` tokens and ``share`` of the larger one's, counted over all tokens.

    rows: key (unique), tokens (distinct in a row, compared by 64-bit hashes); other columns come back with _a and _b, beside
    shared, size_a and size_b. A row is listed under its rarest tokens, all but so few that a pair must share one more: of two rows
    that make a pair, the rarest shared token is listed for both. No token is dropped for its frequency. A pair is made at its
    rarest shared token only, so it comes once and no pairs are shuffled to be counted. Lists longer than ``BLOCK`` are cut into
    blocks, and each two blocks meet on their own. upto: only pairs that share a token of at most so many rows.
    """
    rest = [c for c in rows.columns if c not in (key, tokens)]
    packed = rows.select(F.col(key).alias("_k"), F.struct(F.lit(1).alias("_"), *rest).alias("_rest"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("_toks"))
    each = packed.select("_k", "_rest", F.explode("_toks").alias("_token"))
    df = each.groupBy("_token").agg(F.count("*").alias("_df"))
    ranked = each.join(df, "_token").groupBy("_k").agg(F.first("_rest").alias("_rest"), F.array_sort(F.collect_list(F.struct("_df", "_token"))).alias("_toks"))  # tokens of one row
    size = F.size("_toks")
    listed = F.slice("_toks", 1, F.greatest(F.lit(0), size + 1 - F.greatest(F.lit(least), F.ceil(size * share - 1e-9).cast("int"))))
    rare = ranked.select("_k", "_rest", F.transform("_toks", lambda t: t["_token"]).alias("_toks"), F.explode(F.filter(listed, lambda t: (t["_df"] > 1) & (F.lit(upto is None) | (t["_df"] <= (upto or 0))))).alias("_at"))
    rare = rare.withColumn("_blocks", F.ceil(F.col("_at._df") / BLOCK).cast("int")).withColumn("_own", F.pmod(F.xxhash64("_k"), "_blocks").cast("int"))
    rare = rare.select("_k", "_rest", "_toks", F.col("_at._token").alias("_token"), "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # bytes say little of the pairs that a list makes
    on = ["_token", "_i", "_j"]
    a, b = (
        rare.select("_token", F.col(i).alias("_i"), F.col(j).alias("_j"), F.col("_k").alias(x), F.col("_toks").alias(f"_toks_{x}"), F.col("_rest").alias(f"_rest_{x}")).repartition(parts, *on)
        for x, i, j in (("a", "_own", "_other"), ("b", "_other", "_own"))
    )
    both = F.filter(F.array(F.array_intersect("_toks_a", "_toks_b")), lambda s: (F.size(s) >= least) & (s[0] == F.col("_token")))
    met = a.hint("merge").join(b, on).where("a < b").withColumn("_both", F.explode(both))
    others = [F.col(f"_rest_{x}")[c].alias(f"{c}_{x}") for c in rest for x in "ab"]
    out = met.select("a", "b", F.size("_both").cast("bigint").alias("shared"), F.size("_toks_a").alias("size_a"), F.size("_toks_b").alias("size_b"), *others)
    return out.where(F.col("shared") >= F.greatest("size_a", "size_b") * share - 1e-9)


def jaccard() -> Column:
    """Of the pairs of ``token_pairs``."""
    return F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))


def partner_counts(rows: DataFrame, key: str, tokens: str, flag: str) -> DataFrame:
    """(key, flag, others, flagged): with how many other rows each row shares two tokens, and how many of those have the flag.

    Counted without listing the pairs: rows with the same frequent tokens (more than ``FREQUENT`` rows) are one class, and classes are
    paired and weighed by their rows. Pairs that share a rarer token are few and found one by one; of these, the ones that share two
    frequent tokens are in the count of the classes already.
    """
    hashed = rows.select(F.col(key).alias("_k"), F.col(flag).cast("long").alias("_f"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("_all"))
    each = hashed.select("_k", F.explode("_all").alias("_t"))
    often = each.groupBy("_t").agg(F.count("*").alias("_n")).where(F.col("_n") > FREQUENT).select("_t")
    frequent = each.join(often, "_t").groupBy("_k").agg(F.array_sort(F.collect_list("_t")).alias("_often"))  # tokens of one row
    sets = stage(hashed.join(frequent, "_k", "left").withColumn("_often", F.coalesce("_often", F.array().cast("array<bigint>"))).withColumn("_c", F.xxhash64("_often")), "token_classes")
    classes = stage(sets.where(F.size("_often") >= 2).groupBy("_c", "_often").agg(F.count("*").alias("n"), F.sum("_f").alias("f")), "classes")
    links = token_pairs(classes, "_c", "_often", 2)
    sides = links.select(F.explode(F.array(F.struct(F.col("a").alias("_c"), F.col("n_b").alias("n"), F.col("f_b").alias("f")), F.struct(F.col("b").alias("_c"), F.col("n_a").alias("n"), F.col("f_a").alias("f")))).alias("s")).select("s.*")
    weighed = sides.unionByName(classes.select("_c", "n", "f")).groupBy("_c").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    by_class = sets.join(weighed, "_c").select("_k", (F.col("n") - 1).alias("n"), (F.col("f") - F.col("_f")).alias("f"))
    rare = token_pairs(sets.select("_k", "_all", "_often", "_f"), "_k", "_all", 2, upto=FREQUENT).where(F.size(F.array_intersect("_often_a", "_often_b")) < 2)
    one = rare.select(F.explode(F.array(F.struct(F.col("a").alias("_k"), F.col("_f_b").alias("f")), F.struct(F.col("b").alias("_k"), F.col("_f_a").alias("f")))).alias("s")).select("s._k", F.lit(1).cast("long").alias("n"), "s.f")
    total = by_class.unionByName(one).groupBy("_k").agg(F.sum("n").alias("others"), F.sum("f").alias("flagged"))
    return sets.join(total, "_k", "left").select(F.col("_k").alias(key), (F.col("_f") > 0).alias(flag), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


def vector_search(vectors: DataFrame, queries: DataFrame, key: str, col: str, k: int, floor: float) -> DataFrame:
    """(query, other, cosine, rank): exact k nearest of each query among all vectors with a cosine of at least ``floor``.

    The query set goes out in blocks of a bounded size; each task keeps its own k best per query, so what is shuffled is k rows
    for each query and task. Cosines are computed in double precision; ties go to the smaller key.
    """
    spark = vectors.sparkSession
    dims = queries.agg(F.max(F.size(col))).first()[0] or 1
    n = queries.count()
    blocks = max(1, -(-n * dims * 8 // QUERY_BYTES))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        rows = part.select(key, col).toPandas()
        if not len(rows):
            continue
        q = np.vstack(rows[col].map(lambda v: np.asarray(v, float)))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        hits = _search(vectors, spark.sparkContext.broadcast((rows[key].to_numpy(), q)), key, col, k, floor)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "query long, other long, cosine double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), F.asc("other")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(vectors: DataFrame, block, key: str, col: str, k: int, floor: float) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        best: dict[str, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.vstack(b.column(col).to_numpy(zero_copy_only=False)).astype(float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            keys = b.column(key).to_numpy()
            sims = np.round(q @ x.T, 9)
            sims[ids[:, None] == keys[None, :]] = -np.inf
            both = (np.tile(keys, (len(q), 1)), sims) if best is None else (np.hstack([best["k"], np.tile(keys, (len(q), 1))]), np.hstack([best["s"], sims]))
            order = np.lexsort((both[0], -both[1]), axis=1)[:, :k]
            best = {"k": np.take_along_axis(both[0], order, 1), "s": np.take_along_axis(both[1], order, 1)}
        if best is not None:
            at = np.isfinite(best["s"]) & (best["s"] >= floor)
            r, c = np.nonzero(at)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"query": ids[r], "other": best["k"][r, c], "cosine": best["s"][r, c]}), preserve_index=False)

    return vectors.select(key, col).mapInArrow(scan, "query long, other long, cosine double")


def pair_counts(assigned: DataFrame, cluster: str, gold: str) -> DataFrame:
    """Pairs in one cluster, in one gold group, and in both, by contingency counts; then precision, recall and F1."""
    cell = assigned.where(F.col(cluster).isNotNull() & F.col(gold).isNotNull()).groupBy(cluster, gold).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = cell.agg(pairs(F.col("n")).alias("in_both"))
    made = cell.groupBy(cluster).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("made"))
    true = cell.groupBy(gold).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("true_pairs"))
    one = both.withColumn("j", F.lit(1)).join(made.withColumn("j", F.lit(1)), "j").join(true.withColumn("j", F.lit(1)), "j").drop("j")
    p, r = F.col("in_both") / F.col("made"), F.col("in_both") / F.col("true_pairs")
    return one.select("in_both", "made", "true_pairs", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def cohesive_groups(pairs: DataFrame, component: str, nodes: DataFrame | None = None, seconds: int = 0) -> DataFrame:
    """Greedy cohesive merging inside each component of accepted pairs.

    pairs: component, a, b, verdict (accept, neutral, reject), support, cosine. Accepted pairs are taken by falling cosine; two
    groups merge only if no pair across them is rejected and more than half of all pairs across them support the merge. A
    component is a safe shard, since merges only follow accepted pairs. Gives component, node, group (its smallest node). The merging
    is sequential by definition, so a component is one task. Pairs are kept as flat arrays; what stands between two groups is counted
    when an accepted pair asks for it, and again only after one of them has grown.

    nodes: component, node, time (seconds), words; with them, two nodes further apart than ``seconds`` that share two words are a rejected
    pair too. Those pairs aren't listed but looked for across two groups that would merge otherwise.
    """

    def merge(frame: pd.DataFrame, facts: pd.DataFrame | None) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate([frame.a, frame.b]), return_inverse=True)
        a, b = np.split(ends.astype(np.int32), 2)
        flags = np.tile(frame.rejected.to_numpy(np.int8) + 2 * frame.supports.to_numpy(np.int8), 2)
        order = np.argsort(ends, kind="stable")
        other, flags = np.concatenate([b, a])[order], flags[order]
        start = np.searchsorted(ends[order], np.arange(len(names) + 1))
        time = words = None
        if facts is not None:
            facts = facts.set_index("node").loc[names]
            time, held = facts.time.to_numpy(float, na_value=np.nan), facts.words.map(len).to_numpy()
            words = np.full((len(names), max(1, int(held.max()))), -1, np.int64)
            words[np.arange(words.shape[1]) < held[:, None]] = np.unique(np.concatenate([*facts.words]), return_inverse=True)[1]

        def far(x: list[int], y: list[int]) -> bool:
            """Whether some two nodes are far apart and share two words."""
            if time is None or not max(np.nanmax(time[x]) - np.nanmin(time[y]), np.nanmax(time[y]) - np.nanmin(time[x])) > seconds:
                return False
            for n in x:
                z = words[[m for m in y if abs(time[n] - time[m]) > seconds]]
                own = words[n][words[n] >= 0]
                if len(z) and (np.isin(z, own).sum(1) >= 2).any():
                    return True
            return False

        of = np.arange(len(names))
        members: dict = {n: [n] for n in range(len(names))}
        never: dict = {}  # groups with a rejected pair across, at both
        failed: dict = {}  # sizes at which two groups had too little support
        best = np.lexsort((b, a, -frame.cosine.to_numpy(float)))
        best = best[frame.accepted.to_numpy(bool)[best]]
        for at in range(0, len(best), 8192):
            e = best[at : at + 8192]
            e = e[of[a[e]] != of[b[e]]]
            for i, j in zip(a[e].tolist(), b[e].tolist()):
                x, y = int(of[i]), int(of[j])
                if x == y or y in never.get(x, ()):
                    continue
                mx, my = members[x], members[y]
                if len(mx) < len(my):
                    x, y, mx, my = y, x, my, mx
                if failed.get((x, y)) == (len(mx), len(my)):
                    continue
                across = [slice(start[n], start[n + 1]) for n in my]
                hit = np.concatenate([flags[s] for s in across])[of[np.concatenate([other[s] for s in across])] == x]
                if (hit & 1).any():
                    stop = True
                elif 2 * (hit & 2 > 0).sum() <= len(mx) * len(my):
                    failed[x, y] = len(mx), len(my)
                    continue
                else:
                    stop = far(my, mx)
                if stop:
                    never.setdefault(x, set()).add(y)
                    never.setdefault(y, set()).add(x)
                    continue
                of[my] = x
                mx += members.pop(y)
                for z in never.pop(y, ()):
                    never[z].discard(y)
                    never[z].add(x)
                    never.setdefault(x, set()).add(z)
        least = np.full(len(names), len(names))
        np.minimum.at(least, of, np.arange(len(names)))
        return pd.DataFrame({component: frame[component].iloc[0], "node": names, "grp": names[least[of]]})

    kind = dict(pairs.dtypes)
    out = f"{component} {kind[component]}, node {kind['a']}, grp {kind['a']}"
    c = F.col
    facts = pairs.select(component, "a", "b", (c("verdict") == "reject").alias("rejected"), (F.coalesce("support", F.lit(False)) | (c("verdict") == "accept")).alias("supports"), (c("verdict") == "accept").alias("accepted"), "cosine")
    if nodes is None:
        return facts.groupBy(component).applyInPandas(lambda frame: merge(frame, None), out)
    hashed = nodes.select(component, "node", "time", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    return facts.groupBy(component).cogroup(hashed.groupBy(component)).applyInPandas(lambda frame, told: merge(frame, told), out)
