"""Dimensions with several references meet classes of owners: every pair comes once, and none is shuffled to find that out."""

import collections
import random

from assetgraph.operators import drawings as d
from assetgraph.scratch import saved

SCHEMAS = ("dim long, ref string", "ref string, owner string", "ref string, parent string, name string")


def _brute(dims, targets, features):
    """(dim, owner, feature) and (dim, feature) by walking up from every reference."""
    owners, up = collections.defaultdict(set), {ref: (parent, name) for ref, parent, name in features}
    for ref, owner in targets:
        owners[ref].add(owner)
    found, lost = set(), set()
    for dim, ref in dims:
        name = None
        for _ in range(100):
            if ref in owners or ref not in up:
                break
            name, ref = name or up[ref][1], up[ref][0]
        own = up[ref][1] if ref in owners and ref in up else None
        found |= {(dim, o, name or own) for o in owners.get(ref, ())}
        if ref not in owners:
            lost.add((dim, name))
    return found, lost


def test_pairs_come_once_and_are_not_grouped(spark, monkeypatch):
    monkeypatch.setattr(d, "OWNERS", 3)
    monkeypatch.setattr(d, "DIMENSIONS", 2, raising=False)
    rng = random.Random(5)
    for _ in range(3):
        names = [f"t{k}" for k in range(8)]
        targets = [(rng.choice(names), rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", None])) for _ in range(24)] + [("z", "a"), ("z", "a"), ("y", "b")]
        features = [(f"f{k}", rng.choice([f"f{k // 2}", "t1", "y", "gone"]) if k else "t2", rng.choice([None, f"n{k}"])) for k in range(9)] + [("t3", "f1", "own"), ("loop", "loop", None)]
        refs = [*names, "z", "y", "nowhere", None, "loop", *(f"f{k}" for k in range(9))]
        dims = [(rng.choice([*range(25), None]), rng.choice(refs)) for _ in range(90)]
        found, lost = d.owned(*(spark.createDataFrame(rows, s) for rows, s in zip((dims, targets, features), SCHEMAS, strict=True)), "dim", "ref", saved)
        pairs, rest = [tuple(r) for r in found.select("dim", "owner", "feature").collect()], [tuple(r) for r in lost.select("dim", "feature").collect()]
        assert len(pairs) == len(set(pairs)) and len(rest) == len(set(rest))
        assert (set(pairs), set(rest)) == _brute(dims, targets, features)
        assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
