"""Light parts of a heavy graph go on until they are settled."""

from sparkloom.operators import communities


def test_light_cliques_settle_beside_a_heavy_edge(spark):
    links = [(f"n{k:03d}", f"n{j:03d}", 1.0) for c in range(40) for k in range(5 * c, 5 * c + 5) for j in range(k + 1, 5 * c + 5)]
    links += [(f"n{20 * r + 5 * c + 4:03d}", f"n{20 * r + (5 * c + 5) % 20:03d}", 1.0) for r in range(10) for c in range(4)]
    edges = spark.createDataFrame([*links, ("x", "y", 1e9)], "source string, target string, weight double")
    found = {x.node: x.part for x in communities.communities(edges, 0.5, modular=False).collect()}
    assert found == {**{f"n{k:03d}": f"n{k // 5 * 5:03d}" for k in range(200)}, "x": "x", "y": "x"}


def ring_of_cliques(spark):
    """Sixty cliques of five in rings of four, whose best communities are the cliques."""
    links = [(f"n{k:03d}", f"n{j:03d}", 1.0) for c in range(60) for k in range(5 * c, 5 * c + 5) for j in range(k + 1, 5 * c + 5)]
    links += [(f"n{20 * r + 5 * c + 4:03d}", f"n{20 * r + (5 * c + 5) % 20:03d}", 1.0) for r in range(15) for c in range(4)]
    return spark.createDataFrame(links, "source string, target string, weight double")


def test_rounds_and_refinements_get_smaller(spark, monkeypatch):
    """Rounds of moves go on in the parts they touch, those of a refinement on what has been joined; nodes are numbers."""
    moved, merged, moves, merges = [], [], communities._moves, communities._merges
    monkeypatch.setattr(communities, "_moves", lambda edges, nodes: moved.append((nodes.count(), nodes.schema["u"].dataType.simpleString())) or moves(edges, nodes))
    monkeypatch.setattr(communities, "_merges", lambda inner, nodes, theta: merged.append((inner.count(), nodes.count())) or merges(inner, nodes, theta))
    edges = ring_of_cliques(spark)
    found = {x.node: x.part for x in communities.communities(edges, 0.5, modular=False).collect()}
    assert found == {f"n{k:03d}": f"n{k // 5 * 5:03d}" for k in range(300)}
    assert {kind for _, kind in moved} == {"bigint"}
    assert moved[0][0] == 300 and any(n <= 150 for n, _ in moved[:5])  # of the first level
    assert merged[0] == (1200, 300) and len(merged) > 1 and all(b[0] < a[0] and b[1] < a[1] for a, b in zip(merged, merged[1:]))


def test_parts_of_all_levels_have_names(spark):
    for x in communities.coarsened(ring_of_cliques(spark), 0.5, modular=False).collect():
        assert x.part[0] == "n" and int(x.part[1:]) // 5 == int(x.node[1:]) // 5
