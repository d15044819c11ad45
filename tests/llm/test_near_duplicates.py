"""Classes and links against every pair's similarity."""

import random

import pytest
from llm.conftest_llm import LOWER, SCHEMA, SF, odd_rows, words_of

from vacancy_spark.llm import near_duplicates as N
from vacancy_spark.llm._components import components


def shingles(text):
    w = words_of((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """(sorted class members, links) of each row, by position."""
    sets = [shingles(t) for _, t in rows]
    links = [set() for _ in rows]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if both and 10 * both >= 8 * (len(x) + len(y) - both):
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min([root[i], *(root[j] for j in links[i])])
    return root, [len(x) for x in links]


def check(rows, found):
    root, links = brute(rows)
    # documents without a word are alone, but rows that share an id share its class number
    root = [r if shingles(t) else str(i) for r, (i, t) in zip(root, rows)]
    classes = {}
    for (i, _), r in zip(rows, root):
        classes.setdefault(r, []).append(i)
    want = sorted((str(rows[k][0]), links[k], sorted(map(str, classes[root[k]]))) for k in range(len(rows)))
    members = {}
    for f in found:
        members.setdefault(f.class_id, []).append(str(f.doc_id))
    assert sorted((str(f.doc_id), f.n_links, sorted(members[f.class_id])) for f in found) == want
    for c, m in members.items():
        known = [int(x) for x in m if x != "None"]
        assert c == min(known) if known else c < 0
    wordless = sum(not shingles(t) for _, t in rows)
    assert sum(f.is_first for f in found) == len(set(r for r in root if not isinstance(r, str))) + wordless


def near_copies(seed, groups, size, words):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, common = [], [word() for _ in range(words // 3)]
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                own[rng.randrange(words)] = word()
            rows.append(" ".join(own))
        rows.append(" ".join(common + base[:words // 3] + [word() for _ in range(words)]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_odd_rows(spark, odd, none):
    check([(i, t) for i, t, *_ in odd_rows()], N.near_duplicates(odd).collect())
    assert N.near_duplicates(none).count() == 0
    kept = N.one_of_each(odd)
    assert kept.columns == odd.columns
    first = [f for f in N.near_duplicates(odd).collect() if f.is_first]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(f.doc_id) for f in first)
    assert N.one_of_each(none).count() == 0


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "block": 8}])
def test_groups_of_near_copies(spark, options):
    """Also with nodes that must be split and groups that must be compared in blocks."""
    rows = near_copies(2, 3, 40, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, N.near_duplicates(docs, **options).collect())


def test_driver_documents(spark, sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    root, links = brute(rows)
    found = {r.doc_id: r for r in N.op4_ngram_jaccard_join(spark, SF).collect()}
    assert [found[i].n_links for i, _ in rows] == links
    assert [found[i].class_id for i, _ in rows] == [min(
        rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root]


def test_threshold_below_the_sampled_one_is_refused(none):
    with pytest.raises(ValueError):
        N.near_duplicates(none, threshold=0.7)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 5), (6, 7), (7, 6), (20, 21), *((k, k + 1) for k in range(30, 60))]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 6, 7: 6, 20: 20, 21: 20, **{k: 30 for k in range(30, 61)}}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
