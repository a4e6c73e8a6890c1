"""Whether two reports tell of one event: features of each report, and the decision on a pair as one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions import fixed as V
from wirelake.functions import text as X

# Words that a claim is compared without.
CLAIM_STOP = "a an the of to in on for and or with at by from as is are was be not before after says said us new will promises promise resume again january february march april may june july august september october november december".split()
FAR_HOURS = 72


def _ids(tokens: Column, groups: tuple[str, ...]) -> Column:
    """Numbers of the word groups that the tokens touch."""
    return F.filter(F.array(*[F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in g.split()])), F.lit(i)) for i, g in enumerate(groups)]), lambda x: x.isNotNull())


def claim_words(title: Column) -> Column:
    """Words of the main claim: up to a trailing clause, without plural s, verbs of one action made one."""
    t = F.regexp_replace(F.replace(F.lower(title), F.lit("u.s."), F.lit("us")), r"\s+as\s+.*$", "")
    words = F.array_except(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), F.array(*[F.lit(w) for w in CLAIM_STOP]))
    bare = F.transform(words, lambda w: F.regexp_replace(w, "s$", ""))
    one = {w: sorted(g.split())[0] for g in V.ACTIONS for w in g.split()}
    mapped = F.create_map(*[F.lit(x) for kv in one.items() for x in kv])
    return F.array_distinct(F.transform(bare, lambda w: F.coalesce(mapped[w], w)))


def actor(title: Column) -> Column:
    """The words before a title's verb, without roles."""
    t = F.regexp_replace(F.lower(title), r"^(?:sources?|reports?|exclusive|breaking)\s*:\s*", "")
    words = F.regexp_extract_all(F.regexp_replace(t, V.ACTOR_ENDS + ".*$", ""), F.lit("[a-z]+"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in V.ROLES]))


def features(items: DataFrame) -> DataFrame:
    """Adds to key, title, time (epoch seconds), day what pairs are decided by: toks, fam, fld, roundup, claim, actor, bound, negative, names, steps."""
    t = F.col("title")
    items = items.withColumn("toks", X.significant_tokens(t))
    caps = F.transform(F.regexp_extract_all(t, F.lit(r"[a-z,;] ([A-Z][A-Za-z']+)"), F.lit(1)), lambda w: F.lower(w))
    steps = F.when(F.size("toks") > 1, F.transform(F.sequence(F.lit(1), F.size("toks") - 1), lambda i: F.concat_ws(" ", F.array_sort(F.slice("toks", i, 2))))).otherwise(F.array().cast("array<string>"))
    return items.withColumns(
        {
            "fam": _ids(F.col("toks"), V.EVENT_FAMILIES), "fld": _ids(F.col("toks"), V.FIELDS), "roundup": X.is_roundup(t), "claim": claim_words(t), "actor": actor(t),
            "bound": F.lower(F.regexp_extract(t, r"(?i)\b(before|after|during|until)\b", 1)), "negative": t.rlike(V.NEGATIONS), "names": F.array_distinct(caps), "steps": steps,
        }
    )


#: What ``decide`` needs of both sides.
FEATURES = ["toks", "fam", "fld", "roundup", "claim", "actor", "bound", "negative", "names", "steps", "time", "day", "rare"]


def _apart(a: str, b: str) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _specific(actor_: str) -> Column:
    return (F.size(actor_) >= 2) | ((F.size(actor_) == 1) & (F.length(F.get(actor_, F.lit(0))) > 4))


def decide(pairs: DataFrame) -> DataFrame:
    """Adds verdict (accept, reject, neutral), reason, shared, jaccard and support to pairs with ``FEATURES`` as _a and _b columns.

    rare: a side's tokens that few titles have. In order: what excludes one event (roundups, far times, kinds of event, fields, opposite
    claims, other actors) rejects; shared wording or two distinctive phrases accept; the rest is neutral, with support if a rare
    word that is no name is shared. Words that stand beside each other in either title are one phrase.
    """
    c = F.col
    both = F.filter(F.array_intersect("toks_a", "toks_b"), lambda w: ~w.isin(V.DATE_WORDS))
    p = pairs.withColumn("both", both).withColumn("n", F.size("both"))
    p = p.withColumn("jac", c("n") / F.size(F.array_union("toks_a", "toks_b")))
    name = F.array_union("names_a", "names_b")
    p = p.withColumn("rare2", F.array_intersect(F.array_intersect("rare_a", "rare_b"), "both")).withColumn("what", F.array_except("rare2", name))
    joined = F.filter(F.array_union("steps_a", "steps_b"), lambda s: F.array_contains("rare2", F.element_at(F.split(s, " "), 1)) & F.array_contains("rare2", F.element_at(F.split(s, " "), 2)))
    p = p.withColumn("phrases", F.greatest(F.least(F.size("rare2"), F.lit(1)), F.size("rare2") - F.size(joined)))
    beside = F.array_contains("steps_a", F.concat_ws(" ", F.array_sort("both"))) & F.array_contains("steps_b", F.concat_ws(" ", F.array_sort("both")))
    claim = F.size(F.array_intersect("claim_a", "claim_b")) / F.greatest(F.lit(1), F.size(F.array_union("claim_a", "claim_b")))
    heads = F.array(*[F.lit(sorted(g.split())[0]) for g in V.ACTIONS])
    same_act = F.arrays_overlap(F.array_intersect("claim_a", "claim_b"), heads)
    other_actor = ~((c("actor_a") == c("actor_b")) | ((F.size("actor_a") == 1) & (F.get("actor_a", F.lit(0)) == F.try_element_at("actor_b", F.lit(-1)))) | ((F.size("actor_b") == 1) & (F.get("actor_b", F.lit(0)) == F.try_element_at("actor_a", F.lit(-1)))))
    differ = F.coalesce(other_actor, F.lit(True)) | ((c("bound_a") != "") & (c("bound_b") != "") & (c("bound_a") != c("bound_b"))) | (c("negative_a") != c("negative_b"))
    opposite = F.arrays_overlap("names_a", "names_b") & F.coalesce(c("day_a") == c("day_b"), F.lit(False)) & (claim >= 0.4) & same_act & differ
    wording = (c("n") >= 2) & (c("jac") >= 0.25) & ((c("n") >= 3) | (c("n") == F.size("toks_a")) | (c("n") == F.size("toks_b")) | ~beside)
    reason = (
        F.when(c("roundup_a") | c("roundup_b"), "reject:multi-story roundup")
        .when(F.abs(c("time_a") - c("time_b")) > FAR_HOURS * 3600, "reject:reports far apart")
        .when(_apart("fam_a", "fam_b"), "reject:different kinds of event")
        .when(_apart("fld_a", "fld_b"), "reject:different prize or field")
        .when(opposite, "reject:opposite claims about the same actor and action")
        .when(_apart("actor_a", "actor_b") & _specific("actor_a") & _specific("actor_b"), "reject:different central actors")
        .when(c("n") == 0, "neutral:no shared words")
        .when(wording, "accept:shared wording")
        .when((c("phrases") >= 2) & (F.size("what") >= 1), "accept:two distinctive phrases in common")
        .when(F.size("rare2") > 0, "neutral:one distinctive phrase only")
        .otherwise("neutral:no distinctive shared words")
    )
    p = p.withColumn("ruled", F.split(reason, ":"))
    return p.withColumns({"verdict": c("ruled")[0], "reason": c("ruled")[1], "shared": c("n").cast("bigint"), "jaccard": F.round("jac", 6), "support": (c("ruled")[0] == "accept") | ((c("ruled")[0] == "neutral") & (F.size("what") > 0))})
