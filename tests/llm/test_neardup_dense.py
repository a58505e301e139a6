"""Near pairs among thousands of texts that share most of their shingles and are not linked with one another."""

import random

from chorale.llm.neardup import near_duplicates
from chorale.llm.store import Scratch


def family(n, pairs, shared=110, own=15):
    """Texts of one family: a licence that all hold, then words of their own; each of the first ``pairs`` texts gets a near
    copy. Of 121 shingles 106 are the licence's (similarity 106 / 136 = 0.78) and 13 are new in a copy (108 / 134 = 0.81)."""
    r = random.Random(11)
    licence = [f"c{i}" for i in range(shared)]
    rows = [licence + [f"o{i}x{j}" for j in range(own)] for i in range(n)]
    for i in range(pairs):
        w = list(rows[i])
        at = shared + r.randrange(3)
        w[at:at + 9] = [f"e{i}x{j}" for j in range(9)]
        rows.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def missed(spark, percent=80, n=700, pairs=150, **how):
    rows = family(n, pairs, **how)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), percent=percent).collect()}
    assert all(got[i] == i for i in range(n))
    return [i for i in range(pairs) if got[n + i] != i]


def test_pairs_inside_a_family_just_under_the_threshold(spark):
    assert missed(spark) == []


def test_pairs_among_thousands_of_half_shared_texts(spark):
    assert missed(spark, n=3000, shared=90, own=44) == []
