"""Stand-ins read whole tables and give rows at every size."""

import math
import os

import pandas as pd
import pytest
from test_operators import brute_betweenness

from tessera.operators import graph
from tessera.plans import spatial

ROOT = "/root/testdata"
SIZES = [x for x in ("sf0.001", "sf0.01", "sf0.1") if os.path.isdir(f"{ROOT}/{x}")]
tables = pytest.mark.skipif(len(SIZES) < 3, reason="no tables")


@tables
def test_every_line_reaches_the_arcs_and_places_grow(spark):
    nodes = []
    for size in SIZES[:2]:
        lines = pd.read_parquet(f"{ROOT}/{size}/lineitem.parquet").merge(pd.read_parquet(f"{ROOT}/{size}/orders.parquet"), left_on="l_orderkey", right_on="o_orderkey")
        want = set(zip(lines.l_suppkey.astype(str), lines.o_custkey.astype(str), lines.l_linenumber, strict=True))
        got = spatial.arcs(spark, f"{ROOT}/{size}").toPandas()
        assert {*zip(got.u, got.v, got.key, strict=True)} == want and len(got) == len(want)
        nodes.append(len({*got.u, *got.v}))
    assert nodes[0] > 25 and nodes[1] >= 9 * nodes[0]


#: Supplier, customer, line number, price and quantity of each order line; places 1 to 6, with ties, a loop and a sink.
LINES = [(1, 2, 1, 2, 1), (2, 3, 1, 6, 2), (3, 1, 1, 4, 1), (1, 3, 1, 5, 1), (1, 3, 2, 9, 1), (3, 4, 1, 8, 4), (4, 5, 1, 3, 1), (5, 3, 1, 2, 2), (4, 4, 1, 1, 1), (5, 6, 1, 7, 1), (1, 5, 1, 10, 1)]


@pytest.fixture
def small(tmp_path):
    pd.DataFrame([(k, *x) for k, x in enumerate(LINES)], columns=["l_orderkey", "l_suppkey", "c", "l_linenumber", "l_extendedprice", "l_quantity"]).drop(columns="c").to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": range(len(LINES)), "o_custkey": [x[1] for x in LINES]}).to_parquet(tmp_path / "orders.parquet")
    for t, key in (("supplier", "s_"), ("customer", "c_")):
        pd.DataFrame({f"{key}{'suppkey' if t == 'supplier' else 'custkey'}": range(1, 7), f"{key}nationkey": [k % 2 for k in range(6)]}).to_parquet(tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_graph_queries_against_brute_force(spark, small):
    arcs = [(str(u), str(v), round(price / n)) for u, v, _, price, n in LINES]
    nodes, edges = brute_betweenness(arcs)
    near = lambda d: {k: pytest.approx(v, abs=1e-6) for k, v in d.items()}
    q = {k: spatial.QUERIES[k](spark, small).collect() for k in ("betweenness_nodes", "betweenness_arcs", "betweenness_sampled", "arc_to_segment", "components", "strong_components", "closeness", "clustering", "degree_table")}
    assert {r.node: r.bc for r in q["betweenness_nodes"]} == near(nodes) == {r.node: r.bc for r in q["betweenness_sampled"]}
    assert {(r.u, r.v): r.bc for r in q["betweenness_arcs"]} == near(edges)
    both = {}
    for (u, v), bc in edges.items():
        both[min(u, v), max(u, v)] = both.get((min(u, v), max(u, v)), 0) + bc
    segments = {r.tramo_id: r.bc for r in q["arc_to_segment"]}
    assert len(segments) == 9 and segments == near({f"{u}-{v}-1": bc for (u, v), bc in both.items()} | {"1-3-2": 0.0})

    far = {(a, b): 0 if a == b else math.inf for a in nodes for b in nodes}
    for u, v, w in arcs:
        far[u, v] = min(far[u, v], w)
    for k in nodes:
        far |= {(a, b): min(d, far[a, k] + far[k, b]) for (a, b), d in far.items()}
    assert {r.node: r.component for r in q["components"]} == dict.fromkeys(nodes, "1")
    strong = {a: min(b for b in nodes if far[a, b] + far[b, a] < math.inf) for a in nodes}
    assert {r.node: r.component for r in q["strong_components"]} == strong
    inside = [a for a in nodes if strong[a] == "1"]
    assert {r.node: r.closeness for r in q["closeness"]} == near({b: (len(inside) - 1) / sum(far[a, b] for a in inside) for b in inside})
    linked = {frozenset(a[:2]) for a in arcs if a[0] != a[1]}
    beside = {a: [b for b in nodes if frozenset((a, b)) in linked] for a in nodes}
    each = [sum(frozenset((b, c)) in linked for b in x for c in x if b < c) * 2 / (len(x) * (len(x) - 1)) if len(x) > 1 else 0 for x in beside.values()]
    assert (q["clustering"][0].nodes, q["clustering"][0].clustering) == (6, pytest.approx(sum(each) / 6, abs=1e-6))
    pairs = {a[:2] for a in arcs if a[0] != a[1]}
    assert {r.node: (r.n_in, r.n_out) for r in q["degree_table"]} == {a: (sum(p[1] == a for p in pairs), sum(p[0] == a for p in pairs)) for a in nodes}
    assert graph.segments(spatial.arcs(spark, small)).count() == 10


@tables
@pytest.mark.parametrize("size", SIZES)
def test_every_size_has_strata(spark, size):
    got = spatial.matched_strata(spark, f"{ROOT}/{size}").toPandas()
    e = pd.read_parquet(f"{ROOT}/{size}/events.parquet").query("event_type == 'purchase'")
    days = (pd.to_datetime(e.ts) - pd.Timestamp(spatial.FIRST)).dt.days
    n = e.groupby([e.user_id % 3, days]).size().unstack(fill_value=0).reindex(columns=range(spatial.DAYS), fill_value=0)
    crowd = n.ge(n.quantile(spatial.CROWD, axis=1), axis=0) & (n > 0)
    assert all(got.groupby("stadium").size().reindex(range(3), fill_value=0) > 0)
    assert all(crowd.loc[s, d] and not crowd.loc[s, c] for s, d, c in zip(got.stadium, got.day, got.ctrl_day, strict=True))
    assert 3 <= got[["stadium", "day"]].drop_duplicates().shape[0] < 45


@tables
def test_bootstrap_takes_two_thousand_draws(spark):
    assert max(r.finite for r in spatial.bootstrap_ci(spark, f"{ROOT}/sf0.1").collect()) == 2000
