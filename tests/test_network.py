"""Small networks with hand answers, and brute force next to the iterative programs."""

import itertools
import random

from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators import components, contraction, distance, elevation, loops, network as net, walks
from cairn.plans import build, families
from cairn.session import Stages

SEG = "region_id long, seg_id long, name string, start_node long, end_node long, node_ids array<long>, length_mi double, gain_ft long, loss_ft long"


def segments(spark, edges):
    rows = [(1, i, f"T{i}", a, b, [a, b], float(mi), 100, 50) for i, (a, b, mi) in enumerate(edges)]
    return spark.createDataFrame(rows, SEG)


def brute_walks(edges, anchors, lo, hi, cap=2000, deep=40):
    out = []
    for anchor in anchors:
        found = []

        def go(node, path, mi):
            if len(found) >= cap or len(path) > deep:
                return
            if path and node == anchor:
                found.append((anchor, tuple(path), round(mi, 6)))
                return
            for i, (a, b, w) in enumerate(edges):
                for way, (x, y) in enumerate([(a, b), (b, a)] if a != b else [(a, b)]):
                    d = 2 * i + way
                    if x != node or d in path or mi + w > hi:
                        continue
                    if y == anchor and mi + w < lo:
                        continue
                    go(y, path + [d], mi + w)
                    if len(found) >= cap:
                        return

        go(anchor, [], 0.0)
        out += found
    return out


def got_walks(df):
    return sorted((r["anchor"], tuple(r["path"]), round(r["miles"], 6)) for r in df.collect())


SQUARE = [(1, 2, 6.909), (2, 3, 6.909), (3, 4, 6.909), (4, 1, 6.909)]


def test_square_walks_in_order(spark):
    segs = segments(spark, SQUARE)
    heads = spark.createDataFrame([(1, 1, "A")], "region_id long, node_id long, name string")
    anchors = walks.start_nodes(segs, heads)
    assert [r["anchor"] for r in anchors.collect()] == [1]
    found = walks.closed_walks(segs, anchors)
    rows = sorted(found.collect(), key=lambda r: list(r["path"]))
    assert [round(r["miles"], 3) for r in rows] == [27.636, 41.454, 27.636, 27.636, 41.454, 27.636]
    unique = loops.unique_loops(found)
    assert sorted(r["print"] for r in unique.collect()) == [
        "0x1|1x1|2x1|3x1", "0x2|1x2", "0x2|1x2|2x2", "1x2|2x2|3x2", "2x2|3x2",
    ]
    ranked = unique.select(
        "region_id", "loop_id", F.transform("path", lambda d: F.floor(d / 2).cast("long")).alias("seg_ids"),
        F.struct(geo.round_to(F.col("miles"), 1).alias("m"), "path").alias("rank"),
    )
    prints = {r["loop_id"]: r["print"] for r in unique.collect()}
    fam = {}
    for r in loops.loop_families(ranked).collect():
        fam.setdefault(prints[r["leader_id"]], set()).add(prints[r["loop_id"]])
    assert sorted(map(sorted, fam.values())) == [
        ["0x1|1x1|2x1|3x1", "1x2|2x2|3x2"], ["0x2|1x2", "0x2|1x2|2x2"], ["2x2|3x2"],
    ]


def random_edges(seed, nodes=8, count=12):
    rnd = random.Random(seed)
    return [(rnd.randrange(nodes), rnd.randrange(nodes), round(rnd.uniform(3, 12), 3)) for _ in range(count)]


def test_walks_against_depth_first_search(spark):
    for seed in (1, 2):
        edges = [e for e in random_edges(seed)]
        segs = segments(spark, edges)
        anchors = sorted({n for a, b, _ in edges for n in (a, b)})[:4]
        given = spark.createDataFrame([(1, a) for a in anchors], "region_id long, anchor long")
        want = brute_walks(edges, anchors, 15, 26)
        assert want
        assert got_walks(walks.closed_walks(segs.repartition(3), given, 15.0, 26.0)) == sorted(want)
        few = brute_walks(edges, anchors, 15, 26, cap=5)
        assert got_walks(walks.closed_walks(segs, given, 15.0, 26.0, cap=5)) == sorted(few)
        assert got_walks(walks.closed_walks(segs, given, 15.0, 26.0, cap=5, frontier=4)) == sorted(few)


def test_families_against_greedy_walk(spark):
    rnd = random.Random(3)
    sets = {f"l{i:03d}": frozenset(rnd.sample(range(9), rnd.randint(2, 7))) for i in range(70)}
    order = sorted(sets)
    leaders, want = [], {}
    for name in order:
        for lead in leaders:
            a, b = sets[name], sets[lead]
            if len(a & b) / len(a | b) > 0.60:
                want[name] = lead
                break
        else:
            leaders.append(name)
            want[name] = name
    rows = [(1, n, sorted(s), n) for n, s in sets.items()]
    df = spark.createDataFrame(rows, "region_id long, loop_id string, seg_ids array<long>, rank string")
    got = {r["loop_id"]: r["leader_id"] for r in loops.loop_families(df.repartition(5)).collect()}
    assert got == want


def test_overlap_pairs_complete(spark):
    rnd = random.Random(8)
    sets = {i: frozenset(rnd.sample(range(12), rnd.randint(1, 9))) for i in range(60)}
    df = spark.createDataFrame([(1, i, sorted(s)) for i, s in sets.items()], "region_id long, set_id long, items array<long>")
    got = {(r["a"], r["b"]) for r in loops.overlapping_pairs(df, 0.5).collect()}
    want = {
        (a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.5
    }
    assert got == want


def test_components_and_distances(spark):
    chain = [(i, i + 1, 1.0) for i in range(0, 40)] + [(100, 101, 2.0), (101, 102, 2.5), (100, 102, 9.0)]
    segs = segments(spark, chain)
    nodes = spark.createDataFrame([(1, n) for n in [*range(41), 100, 101, 102, 500]], "region_id long, node_id long")
    labels = components.components(nodes, segs.select("region_id", F.col("start_node").alias("src"), F.col("end_node").alias("dst")))
    got = {r["node_id"]: r["component"] for r in labels.collect()}
    assert {n: got[n] for n in range(41)} == {n: 0 for n in range(41)}
    assert got[102] == 100 and got[500] == 500
    anchors = spark.createDataFrame([(1, 100), (1, 0)], "region_id long, anchor long")
    dist = {(r["anchor"], r["node_id"]): r["dist"] for r in walks.shortest_miles(anchors, walks.directed_edges(segs), 6.0).collect()}
    assert dist[100, 102] == 4.5 and dist[0, 6] == 6.0 and (0, 7) not in dist
    seeds = spark.createDataFrame([(1, "T40")], "region_id long, seed_trail string")
    main = components.main_component(segs, labels, seeds)
    assert {r["node_id"] for r in main.collect()} == {100, 101, 102}


def brute_contract(pieces, limit, strict):
    """Pieces in index order; a list of [nodes, miles]."""
    subs = [[list(n), mi] for n, mi in pieces]
    at = {}
    for i, (n, _) in enumerate(pieces):
        for x in (n[0], n[-1]):
            at.setdefault(x, []).append(i)
    gone, kept = set(), set()
    for i, (nodes, mi) in enumerate(subs):
        if mi >= limit:
            continue
        done = False
        for end in (nodes[0], nodes[-1]):
            if not strict and len(at.get(end, [])) != 2:
                continue
            near = [j for j in at.get(end, []) if j != i and j not in gone]
            if not near:
                continue
            t = min(near, key=lambda j: (subs[j][1] < limit, j))
            w, p = subs[t][0], nodes
            if w[-1] == p[0]:
                new = w + p[1:]
            elif w[0] == p[-1]:
                new = p[:-1] + w
            elif w[-1] == p[-1]:
                new = w + p[:-1][::-1]
            elif w[0] == p[0]:
                new = p[1:][::-1] + w
            else:
                continue
            subs[t] = [new, subs[t][1] + mi]
            gone.add(i)
            done = True
            break
        if not done and strict:
            gone.add(i)
    return sorted((i, tuple(s[0])) for i, s in enumerate(subs) if i not in gone)


def test_contraction_against_sequential_walk(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        pieces = []
        for _ in range(40):
            a, b = rnd.sample(range(22), 2)
            mi = rnd.choice([0.002, 0.004, 0.007, 1.0, 2.0, 3.0])
            pieces.append(([a, 100 + len(pieces), b], mi))
        df = spark.createDataFrame(
            [(1, i, n, m) for i, (n, m) in enumerate(pieces)], "region_id long, idx long, node_ids array<long>, miles double"
        )
        for strict in (True, False):
            got = contraction.contract(df.repartition(3), 0.01, strict).collect()
            assert sorted((r["idx"], tuple(r["node_ids"])) for r in got) == brute_contract(pieces, 0.01, strict)


def test_profile_with_known_answer(spark):
    meters = [100.0, 110.0, 130.0, 125.0, 160.0, 150.0, 150.0]
    series = spark.createDataFrame([(1, i, m * 3.28084) for i, m in enumerate(meters)], "s int, pos long, elev_ft double")
    for chunk in (3, 1000):
        smooth = elevation.smooth(series, ["s"], chunk=chunk)
        rows = [round(r["smooth_ft"], 2) for r in smooth.orderBy("pos").collect()]
        assert rows == [328.08, 381.4, 410.11, 442.91, 469.16, 479.82, 492.13]
        assert [tuple(r)[1:] for r in elevation.gain_loss(smooth, ["s"]).collect()] == [(164, 0)]


def node(i, lat, lon, **tags):
    return (1, "node", i, lat, lon, None, tags)


def way(i, nodes, **tags):
    return (1, "way", i, None, None, nodes, tags)


ELEMENTS = [
    node(1, 37.00, -119.00, highway="trailhead", name="North Gate"),
    node(2, 37.00, -118.90),
    node(3, 37.10, -118.90),
    node(4, 37.10, -119.00),
    node(5, 37.05, -118.95),
    node(10, 37.0, -118.9058, natural="peak", name="Near Peak"),
    node(11, 37.0, -118.8920, natural="peak", name="Second Peak"),
    node(12, 37.0, -118.8880, natural="peak", name="Third Peak"),
    node(13, 37.1, -118.9, natural="peak", name="Giant Stairway"),
    node(14, 37.1003, -119.0, natural="spring", name="Cold Spring"),
    node(15, 37.1, -119.003, mountain_pass="yes", name="Low Pass"),
    node(16, 37.1, -119.0, tourism="viewpoint", historic="yes", name="Old View"),
    node(21, 37.1029, -118.9),
    node(22, 37.2, -118.9),
    way(50, [1, 2, 3], highway="path", name="East Trail"),
    way(51, [3, 4, 1], highway="footway", name="West Trail"),
    way(52, [4, 2], route="hiking"),
    way(53, [21, 22], natural="water", name="Blue Lake"),
    way(54, [21, 22], waterway="river"),
    way(55, [5, 2], highway="track"),
    node(2, 37.00, -118.90),
]


def elements(spark):
    schema = "region_id long, type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>, pos long"
    return spark.createDataFrame([(*e, i) for i, e in enumerate(ELEMENTS)], schema)


def test_graph_from_elements(spark):
    classes = {(r["id"], r["class"]) for r in net.classify(elements(spark)).collect()}
    assert (13, "landmark") in classes and (13, "peak") not in classes
    assert {(16, "landmark"), (15, "pass"), (14, "spring"), (53, "lake"), (54, "stream"), (50, "trail")} <= classes
    assert not any(i == 55 for i, _ in classes)
    g = build.graph(elements(spark))
    rows = {(r["way_id"], r["sub"]): r for r in g.segments.collect()}
    assert sorted(rows) == [(50, 0), (50, 1), (51, 0), (51, 1), (52, 0)]
    east = rows[50, 0]
    assert east["length_mi"] == 5.518 and east["start_node"] == 1 and east["end_node"] == 2
    assert [f["name"] for f in east["nearby_peaks"]] == ["Near Peak", "Second Peak"]
    assert [f["name"] for f in rows[51, 0]["nearby_lakes"]] == ["Blue Lake"]
    assert [f["name"] for f in rows[51, 0]["nearby_springs"]] == ["Cold Spring"]
    assert [f["type"] for f in rows[51, 0]["nearby_passes"]] == ["pass"]
    box = spark.createDataFrame([(1, 37.0, -119.0, 37.1, -118.9)], "region_id long, min_lat double, min_lon double, max_lat double, max_lon double")
    kept = {(r["type"], r["id"]) for r in net.extract(elements(spark), box).collect()}
    assert ("way", 55) not in kept and ("node", 5) not in kept and ("node", 22) not in kept
    assert ("way", 50) in kept and ("node", 10) in kept and ("node", 2) in kept


def test_clusters_from_elements(spark):
    heights = spark.createDataFrame([(n, 1000.0 + 100 * n) for n in (1, 2, 3, 4)], "node_id long, elev_m double")
    found = families.clusters_of(elements(spark), heights, min_mi=10.0, max_mi=30.0).collect()
    assert found
    for c in found:
        assert c["miles"] >= 10 and c["miles"] <= 30
        assert c["total_gain_ft"] == c["total_loss_ft"]
        assert len(c["segments"]) >= 2
        assert round(sum(s["length_mi"] for s in c["segments"]), 1) == c["miles"]
        heads = [s["from_junction"] for s in c["segments"]]
        assert heads[0] == c["start"]
        assert [s["to_junction"] for s in c["segments"]] == heads[1:] + heads[:1]


def test_distance_join_against_all_pairs(spark):
    rnd = random.Random(1)
    for lat0 in (0.0, 37.0, -60.0):
        pts = [(1, i, lat0 + rnd.uniform(-0.1, 0.1), 10 + rnd.uniform(-0.1, 0.1)) for i in range(120)]
        feats = [(1, i, "n", "peak", lat0 + rnd.uniform(-0.1, 0.1), 10 + rnd.uniform(-0.1, 0.1)) for i in range(80)]
        p = spark.createDataFrame(pts, "region_id long, seg_id long, lat double, lon double")
        f = spark.createDataFrame(feats, "region_id long, feature_id long, name string, type string, lat double, lon double")
        got = {(r["seg_id"], r["feature_id"]): r["dist_mi"] for r in distance.nearby(p, f, 0.93).collect()}
        from tests.test_scoring import miles

        want = {
            (a[1], b[1]) for a in pts for b in feats if miles(a[2:], b[4:]) <= 0.93
        }
        assert set(got) == want


def test_missing_points_break_lines_but_do_not_join_them(spark):
    pts = [(1, 0, 37.0, -119.0), (1, 1, None, None), (1, 2, 37.1, -119.0), (1, 3, 37.2, -119.0)]
    df = spark.createDataFrame(pts, "s long, pos long, lat double, lon double")
    assert round(net.polyline_miles(df, ["s"]).first()["miles"], 3) == 6.909


def test_walks_on_a_grid_at_full_limits(spark):
    """5 x 5 grid of 1-mile edges: the cap ends the search long before all walks are seen."""
    edges = [(5 * r + c, 5 * r + c + 1, 1.0) for r in range(5) for c in range(4)]
    edges += [(5 * r + c, 5 * r + c + 5, 1.0) for r in range(4) for c in range(5)]
    given = spark.createDataFrame([(1, 12)], "region_id long, anchor long")
    got = got_walks(walks.closed_walks(segments(spark, edges), given))
    assert len(got) == 2000 and got == sorted(brute_walks(edges, [12], 25, 45))


def union_find(nodes, pairs):
    head = {n: n for n in nodes}

    def find(n):
        while head[n] != n:
            n = head[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        head[b] = a
    return {n: find(n) for n in nodes}


def test_components_by_contraction(spark):
    source = random.Random(5)
    path = [(i, i + 1) for i in range(400)]
    hub = [(10_000, 10_000 + i) for i in range(1, 2000)]
    loose = [(source.randrange(20_000, 21_000), source.randrange(20_000, 21_000)) for _ in range(700)]
    pairs = [(a, b) if source.random() < 0.5 else (b, a) for a, b in path + hub + loose + hub[:50]]
    every = {n for p in pairs for n in p} | {50_000}
    nodes = spark.createDataFrame([(1, n) for n in every] + [(2, 7), (2, 7)], "region_id long, node_id long")
    edges = spark.createDataFrame([(1, *p) for p in pairs] + [(2, 7, 7), (2, 7, None)], "region_id long, src long, dst long")
    got = {(r["region_id"], r["node_id"]): r["component"] for r in components.components(nodes, edges).collect()}
    assert got == {(1, n): c for n, c in union_find(every, pairs).items()} | {(2, 7): 7}
    assert components.components(nodes, edges.limit(0)).filter("component <> node_id").count() == 0
    assert components.components(nodes.limit(0), edges.limit(0)).count() == 0


def test_contraction_shrinks_and_drops_what_is_settled(spark):
    links = spark.createDataFrame([(1, i, i + 1) for i in range(1000)] + [(2, 1, 2)], "region_id long, a long, b long")
    rounds = components.contracted(links, Stages(spark))
    sizes = [r.count() for r in rounds]
    assert all(b <= 0.6 * a for a, b in zip(sizes, sizes[1:]) if a > 200) and sum(sizes) < 3 * sizes[0]
    assert all(r.filter("region_id = 2").count() == (2 if i == 0 else 0) for i, r in enumerate(rounds))


def test_regions_of_one_task_need_no_rounds(spark, monkeypatch):
    """Tasks join what they hold; only pieces that share nodes with others are contracted, with the same labels."""
    paths = [(r, i, i + 1) for r in range(50) for i in range(40) if i % 10 != 9]
    edges = spark.createDataFrame(paths, "region_id long, src long, dst long")
    nodes = edges.select("region_id", F.col("src").alias("node_id"))
    rounds, plain = [], components.contracted
    monkeypatch.setattr(components, "contracted", lambda links, stages: rounds.append(links.count()) or plain(links, stages))
    want = {(r, i, i // 10 * 10) for r in range(50) for i in range(40)}
    assert {tuple(r) for r in components.components(nodes, edges).collect()} == want
    assert not rounds
    small = components.stars
    monkeypatch.setattr(components, "stars", lambda links: small(links, 5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in components.components(nodes, edges).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rounds


def test_walks_grow_by_several_edges_a_round(spark, monkeypatch):
    """A ring of 12 edges takes a third of the rounds."""
    segs = spark.createDataFrame([(1, i, i, (i + 1) % 12, 3.0) for i in range(12)], "region_id long, seg_id long, start_node long, end_node long, length_mi double")
    anchors = spark.createDataFrame([(1, 0)], "region_id long, anchor long")
    rounds, plain = [], walks._Search.step
    monkeypatch.setattr(walks._Search, "step", lambda self, grown: rounds.append(1) or plain(self, grown))
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    found = sorted(tuple(r["path"]) for r in walks.closed_walks(segs, anchors, 35.0, 36.5).collect())
    ahead, back = [2 * i for i in range(12)], [2 * i + 1 for i in reversed(range(12))]
    assert found == sorted(map(tuple, (ahead, back, ahead[:6] + back[6:], back[:6] + ahead[6:])))
    assert len(rounds) <= 5
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


def test_settled_pieces_leave_the_rounds(spark, monkeypatch):
    """Pieces that no open one touches any more are not written again."""
    from cairn import session
    from cairn.operators import contraction

    # a chain of micro pieces that takes several rounds, and pairs that one round settles
    rows = [(1, i, [i, i + 1], 0.001) for i in range(6)]
    for i in range(1000, 5000, 100):
        rows += [(1, i, [i, i + 1], 0.001), (1, i + 1, [i + 1, i + 2], 1.0)]
    subs = spark.createDataFrame(rows, "region_id long, idx long, node_ids array<long>, miles double")
    sizes, plain = [], session.Stages.cut

    def counted(self, df, *flags):
        out = plain(self, df, *flags)
        if "status" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(session.Stages, "cut", counted)
    kept = contraction.contract(subs)
    assert sizes[-1] < 10
    merged = {r["idx"]: r["node_ids"] for r in kept.filter("idx >= 1000").collect()}
    assert merged == {i + 1: [i, i + 1, i + 2] for i in range(1000, 5000, 100)}


def test_settled_anchors_leave_the_rounds(spark, monkeypatch):
    """Many anchors with one neighbour and one long chain: later rounds write the chain only."""
    chain = [(i, i + 1, 1.0) for i in range(12)]
    pairs = [(100 + 2 * i, 101 + 2 * i, 1.0) for i in range(120)]
    segs = segments(spark, chain + pairs)
    anchors = spark.createDataFrame([(1, 0)] + [(1, a) for a, _, _ in pairs], "region_id long, anchor long")
    rows, cut = [], walks.Stages.cut

    def counted(self, df, *flags):
        made = cut(self, df, *flags)
        if "true" in flags:
            rows.append(self.seen["true"])
        return made

    monkeypatch.setattr(walks.Stages, "cut", counted)
    got = sorted((r.anchor, r.node_id, r.dist) for r in walks.shortest_miles(anchors, walks.directed_edges(segs), 20.0).collect())
    assert got == sorted([(0, i, float(i)) for i in range(13)] + [(a, x, float(x != a)) for a, b, _ in pairs for x in (a, b)])
    assert max(rows) > 240 and rows[-1] <= 13


def test_all_walks_without_a_cap(spark):
    """More walks than the cap leaves, some of them parked on the way: without it none is missing."""
    edges = [(a, b, 1.0) for a in range(6) for b in range(a + 1, 6)]
    segs = segments(spark, edges)
    given = spark.createDataFrame([(1, 0)], "region_id long, anchor long")
    want = brute_walks(edges, [0], 6, 7, cap=10**9)
    assert len(want) > walks.ANCHOR_CAP
    assert got_walks(walks.closed_walks(segs, given, 6.0, 7.0, cap=None, frontier=64)) == sorted(want)
