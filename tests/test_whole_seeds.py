"""Queries over all seeds, against brute force on a small shop."""

import datetime

import pytest
from meshwright.plans import registry
from meshwright.plans import graph_queries, trace_queries  # noqa: F401  (importing registers)

DAY = datetime.datetime(1997, 1, 1)
NATION = {n: n % 2 for n in range(1, 9)}
CUSTOMER = {c: 1 + c % 8 for c in (1, 2, 10, 21, 35)}
ORDER = {o: list(CUSTOMER)[o % 5] for o in (3, 7, 10, 12, 15, 20, 101, 250)}
LINE = [(o, 1 + (o * k) % 6, 1 + (o + k) % 3, "NAR"[(o + k) % 3]) for o in ORDER for k in (1, 2, 5)]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("shop"))
    save = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.parquet(f"{top}/{name}.parquet")
    save("region", [(0,), (1,)], "r_regionkey int")
    save("nation", list(NATION.items()), "n_nationkey int, n_regionkey int")
    save("customer", list(CUSTOMER.items()), "c_custkey int, c_nationkey int")
    save("orders", [(o, c, DAY) for o, c in ORDER.items()], "o_orderkey int, o_custkey int, o_orderdate timestamp")
    save("part", [(p, 7 * p if p % 2 else 1, f"TYPE {p % 2}", "Brand 1") for p in range(1, 7)], "p_partkey int, p_size int, p_type string, p_brand string")
    save("supplier", [(s, s) for s in range(1, 4)], "s_suppkey int, s_nationkey int")
    save("lineitem", [(*x, "O") for x in LINE], "l_orderkey int, l_partkey int, l_suppkey int, l_returnflag string, l_linestatus string")
    return top


def calls(cyclic=False):
    out = {(f"shop/region.R{r}", f"shop/nation.N{n}") for n, r in NATION.items()} | {(f"shop/nation.N{n}", f"shop/customer.C{c}") for c, n in CUSTOMER.items()}
    out |= {(f"shop/customer.C{c}", f"shop/order.O{o}") for o, c in ORDER.items()} | {(f"shop/order.O{o}", f"shop/part.P{p}") for o, p, *_ in LINE}
    out |= {(f"shop/part.P{p}", f"shop/supplier.S{s}") for _, p, s, _ in LINE}
    return out | ({(f"shop/supplier.S{s}", f"shop/nation.N{s}") for s in range(1, 4)} if cyclic else set())


def reach(seed, edges):
    """What is reached in one step or more, with the least shortest path."""
    found, front = {}, {seed: [seed]}
    while front:
        step = {}
        for node, path in front.items():
            for a, b in edges:
                if a == node and b not in found:
                    step[b] = min(step.get(b, [*path, b]), [*path, b])
        found |= step
        front = step
    return found


def rows(spark, shop, name):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, shop).collect())


def test_paths_of_all_customers(spark, shop):
    want = []
    for c in CUSTOMER:
        seed = f"shop/customer.C{c}"
        want += [(seed, node, " > ".join(p)) for node, p in ({seed: [seed]} | reach(seed, calls())).items()]
    assert rows(spark, shop, "shortest_paths_all") == sorted(want)


def test_bypasses_of_all_customers(spark, shop):
    edges = {e for e in calls() if not (e[1].startswith("shop/order.") and e[1].endswith("0"))}
    n = {f"shop/customer.C{c}": sum(x.startswith("shop/part.") for x in reach(f"shop/customer.C{c}", edges)) for c in CUSTOMER}
    assert rows(spark, shop, "must_pass_through_all") == sorted((k, v) for k, v in n.items() if v)


def test_cards_of_all_orders(spark, shop):
    edges = calls()
    back = {(b, a) for a, b in edges}
    kinds = {1: "UnresolvedCall", 3: "ExternalBoundaryCall", 5: "UnresolvedCall"}  # odd parts have a spot, none is HighFanOut
    want = []
    for o in ORDER:
        seed = f"shop/order.O{o}"
        up, down = reach(seed, back), {seed, *reach(seed, edges)}
        roots = [x for x in up if not reach(x, back)]
        effects = {(f, p % 2) for a, p, _, f in LINE if a == o}
        spots = [p for p in kinds if f"shop/part.P{p}" in down]
        want.append((seed, len(roots), len(up), len(effects), len(spots), False))
    assert rows(spark, shop, "impact_card_all") == sorted(want)


def test_reach_from_all_nations(spark, shop):
    edges = calls(cyclic=True)
    down = {s: reach(s, edges) for s in [*(f"shop/region.R{r}" for r in (0, 1)), *(f"shop/nation.N{n}" for n in NATION)]}
    assert rows(spark, shop, "reach_cyclic_all") == sorted((s, len(d), int(s in d)) for s, d in down.items() if d)


def test_all_users_are_gated_and_graded(spark, tmp_path):
    at = lambda day: datetime.datetime(2024, 1, day)
    events = [(u, op, at(day)) for u, days in {3: (2, 25), 10: (3, 26), 61: (2, 22), 99: (25,), 120: (1, 2, 28), 200: (2,)}.items() for day, op in zip(days, "aba", strict=False)]
    spark.createDataFrame(events, "user_id int, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    gate, grades = [], set()
    for u in {e[0] for e in events}:
        old, new = ({op for v, op, t in events if v == u and (t < at(6) if early else t >= at(20))} for early in (True, False))
        verdict = "skipped" if not new else "ungated" if not old else "fail" if new - old else "pass"
        gate.append((str(u), *((",".join(sorted(new - old)), ",".join(sorted(old - new))) if old and new else (None, None)), verdict))
        seen = {op for v, op, t in events if v == u and t < at(4)}
        for claim in {op if u % 3 == 0 else None for v, op, _ in events if v == u}:
            grades.add((u, claim, "unwitnessed" if not seen else "witnessed" if claim is None else "confirmed" if claim in seen else "unconfirmed"))
    assert {tuple(r) for r in registry.QUERIES["effect_gate_all"](spark, str(tmp_path)).collect()} == set(gate)
    assert {tuple(r) for r in registry.QUERIES["annotation_grades_all"](spark, str(tmp_path)).collect()} == grades
