"""Leaves, differences and digests of nested documents, and lightest slices, against plain recursion and every partition."""

import itertools
import json
import random

import numpy as np
import pytest

from lodequery.operators import slices, trees


def leaves_of(x, path="$"):
    if isinstance(x, dict) and x:
        return [y for k, v in x.items() for y in leaves_of(v, path + (f".{k}" if k.isidentifier() else f"[{json.dumps(k)}]"))]
    if isinstance(x, list) and x:
        return [y for i, v in enumerate(x) for y in leaves_of(v, f"{path}[{i}]")]
    return [(path, x if isinstance(x, str) else json.dumps(x, separators=(",", ":")))]


def made(rng, depth):
    kind = rng.randrange(7) if depth else rng.randrange(3, 7)
    if kind < 2:
        return {rng.choice(["a", "b_1", "two words", "", 'q"t']): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == 2:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 7, -3, "text", "", "[1]"])


def test_leaves_to_any_depth(spark):
    rng = random.Random(4)
    documents = [made(rng, 6) for _ in range(60)] + [json.loads("[" * 30 + "1" + "]" * 30), [None], [[]], {}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)] + [(-1, "bad"), (-2, None)], "id int, raw string").select("id", trees.parsed("raw").alias("doc"))
    got = {}
    for r in trees.leaves(rows, ["id"], "doc").collect():
        got.setdefault(r.id, []).append((r.path, r.value))
    assert {i: sorted(x) for i, x in got.items() if i >= 0} == {i: sorted(leaves_of(d)) for i, d in enumerate(documents)}
    assert got[-1] == got[-2] == [("$", "null")] and trees.leaves(rows.limit(0), ["id"], "doc").count() == 0


def test_differences_and_digests(spark):
    table = lambda *docs: spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, raw string").select("id", trees.parsed("raw").alias("doc"))
    left = table({"a": [1, 2], "timing_ms": {"verify": 3}}, {"x": 1}, {"same": [{}]})
    right = table({"a": [1, "2"], "timing_ms": {"verify": 4}, "b": None}, {"y": 1}, {"same": [{}]})
    found = {(r.id, r.path, r.kind) for r in trees.differences(left, right, ["id"], "doc").collect()}
    assert found == {(0, "$.a[1]", "changed"), (0, "$.timing_ms.verify", "changed"), (0, "$.b", "added"), (1, "$.x", "removed"), (1, "$.y", "added")}
    told = [{r.id: r.digest for r in trees.semantic_digests(x, ["id"], "doc", r"timing_ms").collect()} for x in (left, table({"timing_ms": 9, "a": [1, 2]}), right)]
    assert told[0][0] == told[1][0] != told[2][0] and told[0][2] == told[2][2]


@pytest.mark.parametrize("seed", range(5))
def test_lightest_slices(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n, most, first = int(rng.integers(0, 8)), int(rng.integers(1, 5)), float(rng.choice([0.0, 3.0, 30.0]))
        costs = rng.choice([0.0, 1.0, 2.5, 9.0, 0.1], n)
        ends = slices.least_heaviest(costs.tolist(), most, first)
        loads = [costs[i:j].sum() + (first if k == 0 else 0) for k, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]
        best = min(max([costs[i:j].sum() + (first if i == 0 and k == 0 else 0) for k, (i, j) in enumerate(zip([0, *c], [*c, n], strict=True))]) for c in itertools.combinations_with_replacement(range(n + 1), most - 1))
        assert ends[-1] == n and len(ends) <= most and max(loads) == pytest.approx(best, abs=1e-9), (costs, most, first)
    with pytest.raises(ValueError, match="negative"):
        slices.least_heaviest([-1.0], 2)
