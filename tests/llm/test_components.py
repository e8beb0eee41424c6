"""Connected components against union-find, and the rows that they take."""

import random

from chatloom.llm import components


def classes(links):
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {x: root(x) for x in parent}


def found_classes(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    rows = components.connected_components(frame).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.label for r in rows}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    names = rng.sample(range(10_000), 400)
    path = list(zip(names[:60], names[1:61]))
    ascending = [(i, i + 1) for i in range(20_000, 20_040)]
    star = [(names[100], x) for x in names[101:160]]
    loose = [tuple(rng.sample(names[160:], 2)) for _ in range(130)]
    links = path + ascending + star + loose + [(names[0], names[1]), (7_777_777, 7_777_777)]
    assert found_classes(spark, links) == classes(links)
    assert found_classes(spark, []) == {}


def test_links_of_a_class_are_not_joined_again_in_every_round(spark, monkeypatch):
    """Links that a round has settled leave the table; a long path keeps few rows in later rounds."""
    rng = random.Random(9)
    names = rng.sample(range(10_000), 80)
    dense = [(0, x) for x in range(10_001, 10_301)] + [(1, x) for x in range(10_001, 10_301)]
    links = dense + list(zip(names, names[1:]))
    rows, plain = [], components.land

    def counted(frame, purpose):
        landed = plain(frame, purpose)
        rows.append((purpose, landed.count()))
        return landed

    monkeypatch.setattr(components, "land", counted)
    assert found_classes(spark, links) == classes(links)
    nodes = len({x for link in links for x in link})
    assert sum(n for _, n in rows) <= 3 * len(links) + 5 * nodes, rows
