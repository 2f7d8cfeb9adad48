"""Fragment plans and their reduction against plain recursion."""

import random

import pytest

from sparkloom.operators import fragments, search

TREE = "part string, parent string, number long"


def random_case(seed):
    """A forest of communities, members at all depths, relations within and across, claims on both, also on what isn't there."""
    rng = random.Random(seed)
    tree = [("a", None, 0), ("b", None, 1)]
    for i in range(rng.randint(3, 25)):
        parent = rng.choice(tree)[0]
        tree.append((f"c{i}", parent, sum(x[1] == parent for x in tree)))
    rng.shuffle(tree)
    members = [(n, rng.choice(tree)[0]) for n in range(rng.randint(5, 60))]
    entities = [(n, rng.choice([n, -n]) if seed % 2 else n, rng.randint(1, 9)) for n, _ in members] + [(1000, 0, 5)]
    relations = [(100 + i, rng.randrange(70), rng.randrange(70), i, rng.randint(1, 9)) for i in range(rng.randint(0, 120))]
    claims = [(300 + i, *rng.choice([("entity", rng.randrange(70)), ("relation", 100 + rng.randrange(130))]), -i, rng.randint(1, 9)) for i in range(rng.randint(0, 80))]
    return tree, members, entities, relations, claims


def plans_by_recursion(tree, members, entities, relations, claims, budget, header):
    children, parent = {}, {}
    for part, above, number in sorted(tree, key=lambda x: x[2]):
        parent[part] = above
        children.setdefault(above, []).append(part)
    deepest = dict(members)

    def holds(part, node):
        at = deepest.get(node)
        while at is not None and at != part:
            at = parent[at]
        return at is not None

    def evidence(part):
        rows = []
        for kind, items in (("entity", entities), ("relation", relations)):
            for item in sorted(items, key=lambda x: x[-2]):
                inside = holds(part, item[0]) if kind == "entity" else holds(part, item[1]) and holds(part, item[2])
                if inside and (kind == "relation" or item[0] in deepest):
                    rows.append((kind, item[0], item[-1]))
                    rows += [("claim", x[0], x[4]) for x in sorted(claims, key=lambda x: x[3]) if (x[1], x[2]) == (kind, item[0])]
        return rows

    def fits(rows):
        return header + sum(x[2] for x in rows) <= budget

    def pack(batches):
        out = []
        for batch in batches:
            if out and fits(out[-1] + batch):
                out[-1] = out[-1] + batch
            else:
                out.append(list(batch))
        return out

    def split(part, rows, may_stay):
        if may_stay and fits(rows):
            return [rows]
        out, owned = [], set()
        for child in children.get(part, []):
            below = evidence(child)
            if below:
                out += split(child, below, True)
                owned |= set(below)
        return out + pack([[x] for x in rows if x not in owned])

    found = []
    for part, _, _ in tree:
        rows = evidence(part)
        if fits(rows):
            continue
        large = [x for x in rows if not fits([x])]
        if large:
            found += [(part, None, kind, id_, "too large") for kind, id_, _ in large]
            continue
        for number, fragment in enumerate(pack(split(part, rows, False))):
            found += [(part, number, kind, id_, None) for kind, id_, _ in fragment]
    return sorted(found, key=str)


@pytest.mark.parametrize(("seed", "budget", "header"), [(1, 40, 3), (2, 25, 0), (3, 90, 10), (4, 9, 3), (5, 14, 6), (6, 10_000, 1)])
def test_plans_against_recursion(spark, seed, budget, header):
    tree, members, entities, relations, claims = random_case(seed)
    paths = fragments.community_paths(spark.createDataFrame(tree, TREE))
    tables = [
        spark.createDataFrame(members, "node long, part string"), spark.createDataFrame(entities, "id long, place long, tokens long"),
        spark.createDataFrame(relations, "id long, source long, target long, place long, tokens long"), spark.createDataFrame(claims, "id long, subject_kind string, subject long, place long, tokens long"),
    ]
    rows = fragments.evidence_rows(paths, *tables)
    got = sorted(((x.part, x.fragment, x.kind, x.id, x.fault) for x in fragments.fragment_plans(paths, rows, budget, header).collect()), key=str)
    assert got == plans_by_recursion(tree, members, entities, relations, claims, budget, header)


def test_plan_of_nothing(spark):
    paths = fragments.community_paths(spark.createDataFrame([("lost", "nowhere", 0)], TREE))
    assert paths.count() == 0
    empty = [spark.createDataFrame([], x) for x in ("node long, part string", "id long, place long, tokens long", "id long, source long, target long, place long, tokens long", "id long, subject_kind string, subject long, place long, tokens long")]
    assert fragments.fragment_plans(paths, fragments.evidence_rows(paths, *empty), 10).count() == 0


def reduce_by_hand(texts, budget, merge, final, model, last):
    rounds = 0
    while True:
        size = [len(x.split(" ")) for x in texts]
        if final + sum(size) <= budget:
            try:
                return last("\n".join(texts)), len(texts), rounds, None
            except RuntimeError as e:
                return None, len(texts), rounds, f"RuntimeError: {e}"
        if len(texts) == 1:
            return None, 1, rounds, "final prompt"
        groups = []
        for x, n in zip(texts, size, strict=True):
            if groups and merge + groups[-1][1] + n <= budget:
                groups[-1] = ([*groups[-1][0], x], groups[-1][1] + n)
            else:
                groups.append(([x], n))
        if all(len(g) == 1 for g, _ in groups):
            return None, len(texts), rounds, "no pair"
        try:
            texts, before = [model("\n".join(g)) if len(g) > 1 else g[0] for g, _ in groups], texts
        except RuntimeError as e:
            return None, len(texts), rounds, f"RuntimeError: {e}"
        rounds += 1


def test_reduction_against_a_loop(spark):
    def model(prompt):
        if "broken" in prompt:
            raise RuntimeError("no answer")
        return search.stub_model(prompt)

    rng = random.Random(3)
    texts = {f"p{i}": [" ".join(["w"] * rng.randint(1, 7)) + f" {i}" for _ in range(rng.randint(1, 25))] for i in range(12)}
    texts |= {"long": ["x " * 40], "apart": ["x " * 18, "y " * 18], "broken": ["broken", *["w w w"] * 9], "end": ["broken"], "one": ["fits"]}
    rows = [(part, i, x) for part, found in texts.items() for i, x in enumerate(found)]
    frame = spark.createDataFrame(rows, "part string, place long, text string").repartition(3)
    got = {x.part: (x.text, x.fragments, x.rounds, x.fault) for x in fragments.reduce_fragments(frame, 20, 2, 9, model, model).collect()}
    assert got == {part: reduce_by_hand(found, 20, 2, 9, model, model) for part, found in texts.items()}
    assert {x[3] for x in got.values()} == {None, "final prompt", "no pair", "RuntimeError: no answer"}
    assert fragments.reduce_fragments(frame.limit(0), 20, 2, 9).count() == 0


def test_outcomes_of_models(spark):
    def model(prompt):
        if prompt == "raise":
            raise ValueError("bad")
        return prompt

    def corrector(prompt, rejected, reason):
        if prompt == "hopeless":
            return "still " + rejected
        if prompt == "raise later":
            raise OSError("gone")
        return f"good after {reason}"

    prompts = spark.createDataFrame(list(enumerate(["good", "raise", "bad", "hopeless", "raise later"])), "key long, prompt string")
    check = lambda x: None if x.startswith("good") else f"not good: {x}"
    got = [tuple(x) for x in search.ask_outcomes(prompts, model, check, corrector).orderBy("key").collect()]
    assert got == [
        (0, "good", "succeeded", None, 1), (1, None, "model failure", "ValueError: bad", 1), (2, "good after not good: bad", "succeeded", None, 2),
        (3, None, "invalid response", "not good: still hopeless", 2), (4, None, "model failure", "OSError: gone", 2),
    ]
    assert [x.outcome for x in search.ask_outcomes(prompts, model, check).orderBy("key").collect()] == ["succeeded", "model failure", *["invalid response"] * 3]
