import itertools

import numpy as np

from wirelake.llm import quality as Q

PROSE = "The council met in the town on Monday and it was clear that most of them would vote for the plan.\nIt had been a long day for the members, who said that they were tired of the talks."
LIST = "- Red apples\n- Green pears\n- Fresh plums\n- Ripe cherries"
TABLE = "Town\tSeats\tVotes\nAvon\t12\t3,400\nLong\t7\t1,200\nHill\t3\t900"
JUNK = "@@## $$ %% ^^ && ** (( ))\n{}[]<> ;; :: == ++ ~~"


def test_kinds_of_text():
    got = Q.statistics([PROSE, LIST, TABLE, JUNK, None, "", "  \n "])
    assert got["prose"][0] > 0.9 and got["list"][1] > 0.9 and got["table"][2] > 0.9 and got["prose"][3] == 0
    assert list(got["words"][4:]) == [0, 0, 0] and np.isnan(got["mean_word"][4:]).all()


def test_states_are_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 1, 5, 2])
    x = rng.normal(size=(sizes.sum(), 4))
    got, at = Q.decode(x, sizes, Q.GIVEN), 0
    for n in sizes:
        if n:
            best = max(itertools.product(range(4), repeat=n), key=lambda p: Q.GIVEN.first[p[0]] + sum(x[at + i, s] for i, s in enumerate(p)) + sum(Q.GIVEN.next[a, b] for a, b in itertools.pairwise(p)))
            assert tuple(got[at : at + n]) == best
        at += n


def test_a_language_without_a_list_learns_its_common_words(spark):
    """Made-up function words in running sentences, and lists of names in the same language."""
    rng = np.random.default_rng(3)
    small = ["ku", "lo", "mi", "ne", "po"]

    def sentence():
        words = [w for _ in range(7) for w in (small[rng.integers(5)], f"n{''.join(rng.choice(list('abcdefgh'), 6))}")]
        return " ".join(words).capitalize() + "."

    rows = [(i, "xx", "\n".join(" ".join(sentence() for _ in range(2)) for _ in range(4))) for i in range(40)]
    rows += [(100 + i, "xx", "\n".join(f"- N{''.join(rng.choice(list('abcdefgh'), 6))}" for _ in range(12))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    prose = {r.doc_id: r.prose for r in Q.document_statistics(docs).collect()}
    assert min(prose[i] for i in range(40)) > 0.5 and max(prose[100 + i] for i in range(10)) < 0.5


def test_rows_without_text_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, PROSE, 3), (3, PROSE, 3)], "doc_id long, text string, words int")
    got = Q.document_statistics(docs).collect()
    assert sorted((r.doc_id, r.words) for r in got)[:1] == [(2, 0)] and len(got) == 3 and [r.mean_word for r in got if r.doc_id == 2] == [None]
    assert Q.document_statistics(docs.limit(0)).count() == 0


def test_all_documents_are_fitted_on(spark, monkeypatch):
    """Twice the documents count twice, as the tables do; a language's common words come from all its documents."""
    monkeypatch.setattr(Q, "FIT_DOCS", 12)
    rows = [(i, f"della casa parola{chr(97 + i)} fino.\n- uno\n\n12 | 13 | 14\n" * (1 + i % 3), "it") for i in range(12)]
    once = Q.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    twice = Q.fit(spark.createDataFrame(rows + [(100 + i, t, g) for i, t, g in rows], "doc_id long, text string, lang string"))
    assert {"della", "casa", "fino", "uno"} <= twice.common == once.common
    assert np.allclose(once.next, twice.next) and all(np.allclose(v, twice.seen[k]) for k, v in once.seen.items())
