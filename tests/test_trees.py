"""Trees as rows against trees walked one by one."""

import random

import pytest

from stemma.operators import distances, trees
from stemma.plans import panel
from stemma.sources import newick


def drawn(rng, tips):
    """A random tree: joins of two or three, supports on some inner branches, names with a blank."""
    parts = [f"t{i}" if i else "'t 0'" for i in range(tips)]
    while len(parts) > rng.choice([2, 3]) and len(parts) > 2:
        some = [parts.pop(rng.randrange(len(parts))) for _ in range(min(len(parts) - 1, rng.choice([2, 2, 3])))]
        parts.append(f"({','.join(f'{p}:{rng.uniform(0.01, 2):.4f}' for p in some)}){rng.choice(['', '87', '3.5'])}")
    return f"({','.join(f'{p}:{rng.uniform(0.01, 2):.4f}' for p in parts)});"


def nested(rows):
    """A tree without the order of branches: name, support, length and what is below, sorted."""
    below = {}
    for r in rows:
        below.setdefault(r[1], []).append(r)

    def of(r):
        return (r[2], None if r[3] is None else round(r[3], 2), None if r[4] is None else round(r[4], 3), tuple(sorted(map(of, below.get(r[0], [])), key=repr)))

    return of(below[None][0])


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(6)
    texts = {i: drawn(rng, rng.randint(2, 24)) for i in range(500)}
    return texts, newick.read(spark.createDataFrame(list(texts.items()), "tree int, value string"))


def close(a, b):
    same = (a[0], a[1]) == (b[0], b[1]) and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 2e-3)
    return same and len(a[3]) == len(b[3]) and all(any(close(x, y) for y in b[3]) for x in a[3])


def test_midpoint_roots_of_500_trees(forest):
    texts, nodes = forest
    got = {r.tree: r.value for r in trees.texts(trees.midpoint_rooted(nodes)).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert close(nested(newick.nodes(got[i])), nested(newick.nodes(distances.midpoint_rooted(text)))), (text, got[i])


def test_root_is_halfway(spark, forest):
    texts, nodes = forest
    rooted = trees.midpoint_rooted(nodes)
    steps = trees.ladder(rooted)
    deep = {}
    for r in trees.heights(rooted, steps).join(rooted, ["tree", "node"]).collect():
        if r.name:
            deep.setdefault(r.tree, []).append(r.height)
    for i, text in texts.items():
        rows = newick.nodes(text)
        up = {r[0]: (r[1], r[4] or 0.0) for r in rows}

        def path(x, up=up):
            out, far = {}, 0.0
            while x is not None:
                out[x] = far
                x, far = up[x][0], far + up[x][1]
            return out

        tips = [path(r[0]) for r in rows if r[2]]
        widest = max(min(a[x] + b[x] for x in a if x in b) for a in tips for b in tips)
        assert sorted(deep[i])[-1] == pytest.approx(widest / 2, abs=1e-9) and sorted(deep[i])[-2] == pytest.approx(widest / 2, abs=1e-9)


def test_texts_keep_what_was_read(forest):
    texts, nodes = forest
    for r in trees.texts(nodes).collect():
        assert nested(newick.nodes(r.value)) == nested(newick.nodes(texts[r.tree]))


def test_lone_nodes_and_confidences(spark):
    one = newick.read(spark.createDataFrame([(1, "A;"), (2, "(A:1,B:3);"), (3, "((A:1,B:1)87.456:2,C:9,D:1);")], "tree int, value string"))
    got = {r.tree: r.value for r in trees.texts(trees.midpoint_rooted(one)).collect()}
    assert got[1] == "A;" and close(nested(newick.nodes(got[2])), nested(newick.nodes("(A:2,B:2);")))
    assert "87.46:" in got[3]


def test_rooted_trees_have_supports(spark):
    rows = panel.rooted_trees(spark, "/root/testdata/sf0.001").collect()
    assert {r.tree for r in rows} == {"de", "en", "es", "fr"}
    for r in rows:
        found = newick.nodes(r.value)
        assert sum(x[1] == 0 for x in found) == 2 and any(x[3] is not None for x in found) and ".00:" in r.value
