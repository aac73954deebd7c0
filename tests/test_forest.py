"""Selection on the preference forest: published sizes, and brute force on small graphs."""

import random
from itertools import combinations

import pytest

from kmerloom.functions.shape import Shape
from kmerloom.operators import forest, links, selection, suffixes, tables
from kmerloom.plans.index import GappedIndex
from tests.test_index import GOLDEN


@pytest.fixture(scope="module")
def problem(spark):
    some = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "text_id long, dna string")
    ranked = tables.kept(suffixes.gsa(some, Shape("#.#")), "gsa")
    own = tables.kept(suffixes.intervals(ranked), "intervals")
    return some, tables.kept(links.candidates(ranked, own, 3), "found"), ranked, own


def test_published_sizes(spark, problem):
    """|C| of tree-dp, and with repaired cycles where it is given."""
    some, found, ranked, own = problem
    built = GappedIndex.of_links(some, Shape("#.#"), ranked, own, forest.forest_rounds(found, ranked, own))
    assert [r.c_count for r in built.stats().orderBy("text_id").collect()] == [g[5] for g in GOLDEN]
    assert built.differences().isEmpty()
    repaired = GappedIndex.of_links(some, Shape("#.#"), ranked, own, forest.forest_rounds(found, ranked, own, repair=True))
    assert repaired.differences().isEmpty()
    sizes = [r.c_count for r in repaired.stats().orderBy("text_id").collect()]
    assert (sizes[2], sizes[4]) == (9, 13)


def drawn(seed, n):
    """A functional graph: a parent of most names, some cycles among them."""
    draw = random.Random(seed)
    return {x: (draw.choice([y for y in range(n) if y != x]), draw.randint(3, 9)) for x in range(n) if draw.random() < 0.85}


def cut(parents, repair):
    """The graph less an edge a cycle."""
    parents, out = dict(parents), dict(parents)
    for start in parents:
        path, at = [], start
        while at in parents and at not in path:
            path.append(at)
            at = parents[at][0]
        if at == start and path and start == max(path):
            weakest = min(path, key=lambda x: (parents[x][1], x))
            del out[weakest if repair and parents[weakest][1] < parents[start][1] else start]
    return out


@pytest.mark.parametrize("repair", [False, True])
def test_forest_and_choice(spark, repair):
    graphs = {seed: drawn(seed, 9) for seed in range(25)}
    edges = spark.createDataFrame([(t, x, s, c) for t, g in graphs.items() for x, (s, c) in g.items()], "text_id long, name long, src_name long, cov int")
    trees = tables.kept(forest.forest(edges, repair), "forest")
    got = {t: {} for t in graphs}
    for r in trees.collect():
        got[r.text_id][r.name] = (r.src_name, r.cov)
    assert got == {t: cut(g, repair) for t, g in graphs.items()}
    chosen = {t: set() for t in graphs}
    for r in forest.wanted(trees).collect():
        chosen[r.text_id].add(r.name)
    for t, tree in got.items():
        valid = lambda some, tree=tree: not any(tree[x][0] in some for x in some)
        most = max(sum(tree[x][1] for x in some) for k in range(len(tree) + 1) for some in combinations(tree, k) if valid(some))
        assert valid(chosen[t]) and sum(tree[x][1] for x in chosen[t]) == most


def test_nothing_to_choose(spark):
    none = spark.createDataFrame([], "text_id long, name long, src_name long, cov int")
    assert forest.wanted(forest.forest(none)).isEmpty() and forest.on_cycles(none).isEmpty()
    ring = spark.createDataFrame([(0, x, (x + 1) % 40, 3 + x % 2) for x in range(40)], "text_id long, name long, src_name long, cov int")
    assert forest.on_cycles(ring).count() == 40 and {r.top for r in forest.on_cycles(ring).collect()} == {39}
    ranked = suffixes.gsa(spark.createDataFrame([(0, "ACGT")], "text_id long, dna string"), Shape("#.#"))
    own = suffixes.intervals(ranked)
    found = links.candidates(ranked, own, 3)
    assert forest.forest_rounds(found, ranked, own).isEmpty() and selection.dependency_rounds(found, ranked, own).isEmpty()
