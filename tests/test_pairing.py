import datetime as dt
from itertools import combinations

import pytest

from wirelake.operators import graph as G
from wirelake.operators import identity as I
from wirelake.operators import pairs as P
from wirelake.plans import pairing

AT = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def _items(spark, path, titles):
    rows = [(i, t, AT, "Tech") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "item_id long, title string, item_time timestamp, inferred_category string").write.parquet(f"{path}/cleaned_items.parquet")


def _rows(spark, titles):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(titles)], "id long, words array<string>")


@pytest.mark.parametrize("block", [512, 7])
def test_words_of_many_titles_make_pairs_once(spark, monkeypatch, block):
    """Three words in 60 titles each, and rare words that count beside them; lists longer than a block are cut."""
    monkeypatch.setattr(P, "BLOCK", block)
    titles = [f"alpha bravo charlie {'delta echo' if i < 2 else f'word{chr(97 + i // 26)}{chr(97 + i % 26)}'}" for i in range(60)]
    words = [set(t.split()) for t in titles]
    want = sorted((a, b, len(words[a] & words[b])) for a, b in combinations(range(60), 2))
    rows = _rows(spark, titles).selectExpr("*", "id + 1 as _toks", "'x' as token")  # names that clash
    got = P.token_pairs(rows, "id", "words", 3, 0.25)
    assert sorted((r.a, r.b, r.shared) for r in got.collect()) == want and {"token_a", "_toks_b"} <= set(got.columns)


def test_odd_rows_make_no_pairs(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, ["x"]), (4, ["x"])], "id long, words array<string>")
    assert [(r.a, r.b) for r in P.token_pairs(rows, "id", "words", 1).collect()] == [(3, 4)]
    assert P.token_pairs(rows.limit(0), "id", "words", 1).count() == 0


def test_links_count_classes_not_copies(spark, tmp_path):
    _items(spark, tmp_path, ["alpha bravo charlie delta", "delta charlie bravo alpha", "alpha bravo charlie echoes", "nothing like them", "zulu"])
    got = sorted(tuple(r) for r in pairing.lexical_pairs(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 1), (1, 0, 1), (2, 2, 1), (3, 3, 0), (4, 4, 0)]


CASES = [
    ("Markets fall as storm hits Avon harbour wall", "Storm hits Avon harbour wall and markets fall", 0, "accept", "shared wording"),
    ("Markets fall as storm hits Avon harbour wall", "Storm hits Avon harbour wall and markets fall", 80, "reject", "reports far apart"),
    ("Firm launches driverless tractor in Avon", "Driverless tractor outage in Avon", 0, "reject", "different kinds of event"),
    ("Nobel prize in physics goes to Avon lab", "Nobel prize in chemistry goes to Avon lab", 0, "reject", "different prize or field"),
    ("News wrap: storm hits Avon harbour wall", "Storm hits Avon harbour wall", 0, "reject", "multi-story roundup"),
    ("Jane Miller will speak on harbour wall costs", "Peter Olson will speak on harbour wall repairs", 0, "reject", "different central actors"),
    ("Talks on the harbour resume", "Harbour and talks of the town", 0, "neutral", "one distinctive phrase only"),
]


@pytest.mark.parametrize("a,b,hours,verdict,reason", CASES)
def test_pair_rules(spark, a, b, hours, verdict, reason):
    rows = spark.createDataFrame([(0, a, 0, "2026-01-01"), (1, b, hours * 3600, "2026-01-01")], "id long, title string, time long, day string")
    f = I.features(rows).withColumn("rare", I.F.col("toks"))
    x, y = (f.where(f"id = {i}").select(*[I.F.col(c).alias(f"{c}_{s}") for c in I.FEATURES]) for i, s in ((0, "a"), (1, "b")))
    got = I.decide(x.crossJoin(y)).first()
    assert (got.verdict, got.reason) == (verdict, reason)


def brute_groups(nodes, facts):
    """The definition: accepted pairs by falling cosine; all pairs across two groups looked at again."""
    group = {n: [n] for n in nodes}
    of = {n: n for n in nodes}
    for (a, b), (v, s, c) in sorted(facts.items(), key=lambda f: (-f[1][2], f[0])):
        x, y = of[a], of[b]
        if v != "accept" or x == y:
            continue
        across = [facts.get((min(i, j), max(i, j)), ("neutral", False, 0)) for i in group[x] for j in group[y]]
        if any(f[0] == "reject" for f in across) or 2 * sum(f[1] or f[0] == "accept" for f in across) <= len(across):
            continue
        group[x] += group.pop(y)
        of.update(dict.fromkeys(group[x], x))
    return {(n, min(group[of[n]])) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cohesive_groups_as_defined(spark, seed):
    import random

    rng = random.Random(seed)
    facts = {(a, b): (rng.choices(["accept", "neutral", "reject"], [6, 3, 1])[0], rng.random() < 0.5, round(rng.random(), 3)) for a, b in combinations(range(12), 2) if rng.random() < 0.6}
    rows = spark.createDataFrame([(7, a, b, *f) for (a, b), f in facts.items()], "shard long, a long, b long, verdict string, support boolean, cosine double")
    nodes = sorted({n for p in facts for n in p})
    assert {(r.node, r.grp) for r in P.cohesive_groups(rows, "shard").collect()} == brute_groups(nodes, facts)


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 201), (200, 201)]
    got = {(r.node, r.root) for r in G.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(100 + i, 100) for i in range(1, 30)} | {(201, 200)}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_search_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r.query, r.other) for r in P.vector_search(df, df.where("id % 50 = 0"), "id", "v", 4, -1.0).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    assert got == {(q, int(o)) for q in range(0, 200, 50) for o in np.argsort(-sims[q])[:4]}

@pytest.mark.parametrize("tile", [4096, 6])
def test_near_pairs_are_decided_as_by_the_column(spark, monkeypatch, tmp_path, tile):
    """Random titles over days, one without a time, against ``identity.decide`` on all pairs; the counts come out the same."""
    import random

    from pyspark.sql import functions as F

    from wirelake.operators import nearby as N

    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(P, "FREQUENT", 5)
    rng = random.Random(4)
    words = "storm Harbour wall Miller launch outage attack strike physics chemistry resign not january monday Olson before will talks".split()
    rows = [(i, " ".join(rng.sample(words, rng.randint(2, 7))) + (" news wrap" if i % 9 == 0 else ""), None if i == 7 else AT + dt.timedelta(hours=rng.randint(0, 400)), "Tech") for i in range(60)]
    spark.createDataFrame(rows, "item_id long, title string, item_time timestamp, inferred_category string").write.parquet(f"{tmp_path}/cleaned_items.parquet")
    f = pairing._reports(spark, str(tmp_path))
    x, y = (f.select(*[F.col(c).alias(f"{c}_{s}") for c in I.FEATURES], F.col("item_id").alias(s)) for s in "ab")
    every = I.decide(x.join(y.toDF(*y.columns), F.expr("a < b and size(array_intersect(toks_a, toks_b)) >= 2"))).select("a", "b", "verdict", "reason", "support", "shared", "jaccard").collect()
    want = {(r.a, r.b): (r.verdict, r.reason, r.support, r.shared) for r in every if r.reason not in ("multi-story roundup", "reports far apart")}
    near = pairing._near(f, lambda d: d, "a long, b long, code int, support boolean, n long, union long").withColumn("r", F.concat_ws(":", N.verdict(F.col("code")), N.reason(F.col("code")))).collect()
    assert {(r.a, r.b): (*r.r.split(":"), r.support, r.n) for r in near} == want and len(near) == len(want) > 50
    counts = {(r.verdict, r.reason): r.pairs for r in pairing.reason_counts(spark, str(tmp_path)).collect()}
    assert counts == {k: sum((r.verdict, r.reason) == k for r in every) for k in {(r.verdict, r.reason) for r in every}}
    ends = [(i, r.verdict, r.reason) for r in every for i in (r.a, r.b)]
    assert {(r.item_id, r.verdict, r.reason): r.pairs for r in pairing.pair_decisions(spark, str(tmp_path)).collect()} == {k: ends.count(k) for k in set(ends)}


def test_the_log_holds_far_pairs_if_few_are_accepted(spark, monkeypatch, tmp_path):
    _items(spark, tmp_path, ["Storm hits Avon harbour wall", "Storm hits Avon harbour wall again", "Talks on the harbour wall", "Storm hits Avon bridge"])
    whole = [tuple(r) for r in pairing.pair_log(spark, str(tmp_path)).collect()]
    assert len(whole) >= 4
    monkeypatch.setattr(pairing, "LOGGED", 2)
    assert [tuple(r) for r in pairing.pair_log(spark, str(tmp_path)).collect()] == whole[:2]


@pytest.mark.parametrize("seed", [1, 2])
def test_story_groups_are_those_of_all_pairs(spark, tmp_path, seed):
    """Titles over weeks: far pairs that share two words part groups though they aren't listed."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(seed)
    words = "storm harbour wall bridge canal tunnel ferry pier quay mast".split()
    rows = [(i, " ".join(rng.sample(words, rng.randint(3, 5))), None if i == 7 else AT + dt.timedelta(hours=rng.randint(0, 200)), "Tech") for i in range(60)]
    spark.createDataFrame(rows, "item_id long, title string, item_time timestamp, inferred_category string").write.parquet(f"{tmp_path}/cleaned_items.parquet")
    f = pairing._reports(spark, str(tmp_path))
    x, y = (f.select(*[F.col(c).alias(f"{c}_{s}") for c in I.FEATURES], F.col("item_id").alias(s)) for s in "ab")
    every = I.decide(x.join(y.toDF(*y.columns), F.expr("a < b and size(array_intersect(toks_a, toks_b)) >= 2"))).select("a", "b", "verdict", "reason", "support", "jaccard").collect()
    facts = {(r.a, r.b): (r.verdict, r.support, r.jaccard) for r in every}
    nodes = sorted({n for p, v in facts.items() if v[0] == "accept" for n in p})
    facts = {p: v for p, v in facts.items() if p[0] in nodes and p[1] in nodes}
    want = brute_groups(nodes, facts)
    assert {(r.node, r.grp) for r in pairing.cohesive_story_groups(spark, str(tmp_path)).collect()} == want
    assert want != brute_groups(nodes, {p: v for p, v in facts.items() if (*p, "reports far apart") not in {(r.a, r.b, r.reason) for r in every}})
