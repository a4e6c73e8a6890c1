from wirelake.operators import editions as D
from wirelake.plans import editions


def test_events_of_common_stems_are_continuity(spark, tmp_path):
    """The stems alpha, bravo and charl are in 60 headlines, the other two only in the first two."""
    rows = [(f"e{i:02}", f"alpha bravo charlie {'delta echos' if i < 2 else f'x{i:04}x y{i:04}y'}") for i in range(60)]
    spark.createDataFrame(rows, "event_id string, headline string").write.parquet(f"{tmp_path}/registry_events.parquet")
    assert [tuple(r) for r in editions.continuity_check(spark, str(tmp_path)).collect()] == [("e00", "e01", 5, 1.0)]


def test_a_long_chain_of_copies_is_one_origin(spark):
    """Twenty reports, each linked to the next by outlet or title in turn, against the order of refs."""
    rows = [("s", 19 - i, f"o{i // 2}", f"t{(i + 1) // 2}") for i in range(20)] + [("s", 20, "other", "")]
    got = D.evidence_groups(spark.createDataFrame(rows, "story string, ref long, outlet string, title_key string"), "story").collect()
    assert {r.origin for r in got} == {0, 20}


def test_strength_counts_origins_channels_signals_and_age(spark):
    rows = [("s", 0, "a", False, True, 30.0), ("s", 0, "a", False, True, 30.0), ("s", 1, "b", False, True, 30.0), ("s", None, "a", True, True, 30.0), ("s", None, None, False, False, 30.0), ("t", 0, "a", False, True, 2.0)]
    rows += [("u", i, "ab"[i % 2], False, True, 2.0) for i in range(5)]
    got = D.strength(spark.createDataFrame(rows, "story string, origin long, channel string, signal boolean, counted boolean, age_hours double"), "story")
    assert {r.story: (r.independent, r.repeats, r.signals, r.channels, r.points, r.level) for r in got.collect()} == {"s": (2, 1, 1, 2, 3, "moderate"), "t": (1, 0, 0, 1, 1, "limited"), "u": (5, 0, 0, 2, 6, "strong")}


def brute_top(stories, top, per, share, shared):
    taken, counts = [], {}
    for capped in (True, False):
        for key, cat, score in sorted(stories, key=lambda s: (-s[2], s[0])):
            if len(taken) < top and key not in taken and not (capped and (counts.get(cat, 0) >= per or (cat == shared and counts.get(cat, 0) + 1 > share * top))):
                taken.append(key)
                counts[cat] = counts.get(cat, 0) + 1
    return taken


def test_top_list_equals_the_uncut_form(spark):
    """Far more stories of one category than the cut keeps."""
    import random

    rng = random.Random(4)
    stories = [(f"k{i:04}", rng.choices(["Tech", "News", "Arts"], [90, 8, 2])[0], round(rng.random(), 2)) for i in range(900)]
    frame = spark.createDataFrame([("e", *s) for s in stories], "edition string, key string, category string, score double")
    got = [r.key for r in D.greedy_top(frame, "edition").orderBy("place").collect()]
    assert got == brute_top(stories, 10, 4, 0.34, "Tech")


def test_incumbents_give_way_to_much_better_ones_only(spark):
    cols = "category string, key string, score double"
    old = spark.createDataFrame([("c", "a", 1.0), ("c", "b", 0.5)], cols)
    new = spark.createDataFrame([("c", "x", 0.59), ("c", "y", 0.6), ("c", "z", 0.61), ("d", "q", 0.1)], cols)
    got = sorted((r.category, r.key, r.old) for r in D.hold(old, new, "category", 2).collect())
    assert got == [("c", "a", True), ("c", "z", False), ("d", "q", False)]


def test_repeats_go_below_what_they_repeat(spark):
    stories = spark.createDataFrame([("e", k, r) for r, k in enumerate("abcd")] + [("f", "a", 1)], "edition string, key string, rank int")
    pairs = spark.createDataFrame([("e", "a", "b"), ("e", "b", "c"), ("e", "c", "d")], "edition string, a string, b string")
    got = sorted((r.edition, r.key, r.place) for r in D.keep_first(stories, pairs, "edition").collect())
    assert got == [("e", "a", 1), ("e", "c", 2), ("f", "a", 1)]
