"""Mind maps by hand and against a plain second version."""

import random

from corpusloom.operators import mindmaps as M

TEXT = """# Algebra
## Vectors
### Basis
- spans the space
- https://example.org/long
### Dimension
**Rank of maps**
## Matrices
1. rows and columns
- logo of the school
### Basis
## Maps
- kernel
## Lonely
"""


def shape(tree):
    return {tree.text[b]: [(tree.text[k], [tree.text[j] for j in tree.kids[k]]) for k in tree.kids[b]] for b in tree.kids[0]}


def test_outline_by_a_stack():
    tree = M.outlined(TEXT.splitlines(), None, 60)
    assert tree.text[0] == "Algebra"
    assert shape(tree) == {
        "Vectors": [("Basis", ["spans the space"]), ("Dimension", []), ("Rank of maps", [])], "Matrices": [("rows and columns", [])], "Maps": [("kernel", [])]
    }
    assert M.outlined(["# A only", "## B branch"], None, 60) is None
    assert len(M.outlined([f"## Head {k}\n" for k in range(100)], "T", 12).text) <= 12


def test_supporting_modules_and_other_maps_are_merged():
    tree = M.Tree("T")
    a, b, c = (tree.add(0, x) for x in ("Linear vectors", "Chemical bonds", "Cell biology"))
    M.study_nodes(tree, a, [["Basis", "Span"], ["Basis", "Rank"], ["logo"], ["Norm"]], ["The basis of a space", "Nothing common"], 2)
    assert [(tree.text[k], [tree.text[j] for j in tree.kids[k]]) for k in tree.kids[a]] == [("Basis", ["Span", "Rank", "The basis of a space"]), ("Norm", [])]
    M.merge_supporting(tree, ["Chemical reactions", "Bonds and atoms", "Chemical reactions"])
    assert [tree.text[k] for k in tree.kids[b]] == ["Chemical reactions", "Bonds and atoms"]
    other = M.outlined("## Cell biology\n- membranes\n- nucleus\n## Other\n- x one\n## Third\n- y two".splitlines(), "O", 60)
    assert M.merge_map(tree, other) == 2 and [tree.text[k] for k in tree.kids[c]] == ["membranes", "nucleus"]


def test_graph_nodes_go_to_the_best_parent():
    tree = M.Tree("T")
    a, b, c = (tree.add(0, x) for x in ("Vectors", "Reactions", "Cells"))
    g = M.Graph(tree, 9)
    g.node("vectors", "v", True, "vectors")
    g.node("Basis change", "n1", True, "basis of vectors in spaces")
    g.node("weak", "w", False, "vectors")
    g.node("Unrelated thing", "u", True, "nothing shared")
    g.node("Basis matrix", "n2", True, "basis change of vectors")
    assert g.at["v"] == a and tree.up[g.at["n1"]] == a and "w" not in g.at and "u" not in g.at
    assert tree.up[g.at["n2"]] == g.at["n1"]
    for target in ("v", "n1", "n2", "n2"):
        g.relation("n2", target, "prerequisite_of")
    assert [tree.text[k] for k in tree.kids[g.at["n2"]]] == ["Prerequisite Of: Vectors", "Prerequisite Of: Basis change"]
    g.node("Beyond budget", "z", True, "vectors")
    g.node("Beyond budget again", "zz", True, "vectors")
    assert tree.size() == 9 and "zz" not in g.at


def plain_trim(tree, most):
    while tree.size() > most:
        leaves = [(-d, -len(tree.text[n]), k, n) for k, (n, d) in enumerate(tree.walk()) if d > 1 and not tree.kids[n]]
        if not leaves:
            break
        node = min(leaves)[-1]
        tree.kids[tree.up[node]].remove(node)
    return [tree.text[n] for n, _ in tree.walk()]


def test_balancing_equals_the_plain_version():
    rng = random.Random(3)
    for _ in range(200):
        trees = []
        seed = rng.random()
        for _ in range(2):
            r, tree = random.Random(seed), M.Tree("T")
            for k in range(40):
                at = r.randrange(len(tree.text))
                if len(tree.kids[at]) < 7:
                    tree.add(at, f"{k}" * r.randrange(1, 9))
            trees.append(tree)
        most = rng.randrange(3, 40)
        whole = M.balanced(trees[1], 1000)
        assert not any(n and len(whole.kids[n]) == 1 and whole.kids[whole.kids[n][0]] for n, _ in whole.walk())
        assert [t for *_, t in M.balanced(trees[0], most).rows(1)] == plain_trim(whole, most)


def test_maps_of_scopes(spark):
    modules = [(s, k, "supporting" if k == 9 else "main", f"Module {k} of {s}", [[f"Head {k} {j}", f"Sub {j}"] for j in range(3)], [f"about head {k}"]) for s in (1, 2) for k in range(10)]
    modules += [(3, 1, "main", "Alone", None, None), (4, 1, None, None, None, None), (None, 1, "main", "No scope", None, None)]
    m = spark.createDataFrame(modules, "scope bigint, rank bigint, role string, title string, paths array<array<string>>, details array<string>")
    nodes = [(1, "a", "concept", "Head zero", "a long description of it", "head sub", 1), (1, "b", "skill", "Head 0 1", None, None, 1), (1, "c", "unknown", "Gone", None, None, 1), (1, "d", "concept", None, None, None, 1)]
    n = spark.createDataFrame(nodes, "scope bigint, id string, kind string, name string, description string, evidence string, n_sources bigint")
    e = spark.createDataFrame([(1, "a", "b", "requires", 0.9), (1, "a", "b", "hides", 0.9), (1, "b", "a", "requires", 0.1)], "scope bigint, source string, target string, relation string, confidence double")
    got = M.module_maps(m, n, e, 200).collect()
    assert {r.scope for r in got} == {1, 2} and all(sum(r.scope == s and r.depth == 1 for r in got) == 7 for s in (1, 2))
    texts = {r.text for r in got if r.scope == 1}
    assert {"Head zero", "Requires: Head 0 1"} <= texts and "Gone" not in texts
    assert M.module_maps(m.limit(0)).count() == 0
