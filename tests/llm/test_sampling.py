from millrace.llm.sampling import sample_categories, sample_to_targets

TARGETS = "cat string, target_share double, min_docs int, note string"


def sampled(spark, nb, records, targets, **options):
    made = [(i, doc, label, "t", 1) for i, (doc, label) in enumerate(records)]
    sample, report = sample_categories(nb(made), spark.createDataFrame([(*t, "x") for t in targets], TARGETS), **options)
    return {r["id"] for r in sample.collect()}, {r.cat: (r.quota, r.available, r.sampled, r.gap) for r in report.collect()}


def test_shares_minimum_and_gap(spark, nb):
    records = [(i, "A.x" if i % 2 else "a X ") for i in range(200)] + [(1000 + i, "b") for i in range(190)] + [(2000 + i, "c") for i in range(10)] + [(3000, None), (None, "b")]
    ids, report = sampled(spark, nb, records, [("a.x", 0.5, 0), ("b", 0.4, 0), ("c", 0.1, 0), ("d", 0.0, 3)])
    # 400 labelled records, so half of them are shared out
    assert report == {"a.x": (100, 200, 100, 0), "b": (80, 190, 80, 0), "c": (20, 10, 10, 10), "d": (3, 0, 0, 3)}
    assert len(ids) == 190 and not ids & {3000, None}


def test_minimum_beats_share(spark, nb):
    _, report = sampled(spark, nb, [(i, "a") for i in range(30)] + [(100 + i, "b") for i in range(9)], [("a", 1.0, 0), ("b", 0.0, 4)])
    assert report["b"] == (4, 9, 4, 0)


def test_same_seed_same_sample_whatever_the_order(spark, nb):
    records = [(i, "ab"[i % 2]) for i in range(300)]
    targets = [("a", 0.7, 0), ("b", 0.3, 0)]
    first, _ = sampled(spark, nb, records, targets)
    again, _ = sampled(spark, nb, records[::-1] + records[:50], targets)
    other, _ = sampled(spark, nb, records, targets, seed=8)
    assert first == again != other


def test_empty_tables(spark, nb):
    assert sampled(spark, nb, [], [("a", 1.0, 2)]) == (set(), {"a": (2, 0, 0, 2)})
    assert sampled(spark, nb, [(1, "a")], []) == (set(), {})


def test_several_margins_meet_their_quotas_together(spark):
    import random

    rng = random.Random(5)
    members = []
    for i in range(4000):
        members += [(i, "colour", rng.choice("rrrg")), (i, "size", rng.choice("sslm"))]
    df = spark.createDataFrame(members, "id long, margin string, label string")
    wanted = [("colour", "r", 0.5), ("colour", "g", 0.5), ("size", "s", 0.3), ("size", "l", 0.4), ("size", "m", 0.3)]
    targets = spark.createDataFrame([(*t, 0) for t in wanted], "margin string, label string, target_share double, min_count int")
    _, report = sample_to_targets(df, targets, sample_share=0.2)
    got = {(r.margin, r.label): (r.quota, r.sampled) for r in report.collect()}
    for quota, n in got.values():
        assert quota == n


def two_margins(spark, members, wanted, **options):
    df = spark.createDataFrame(members, "id long, margin string, label string")
    targets = spark.createDataFrame([(*t, 0) for t in wanted], "margin string, label string, target_share double, min_count int")
    sample, report = sample_to_targets(df, targets, **options)
    return {r["id"]: round(r["probability"], 9) for r in sample.collect()}, {(r.margin, r.label): (r.quota, r.available, r.sampled, r.gap, r.excess) for r in report.collect()}


def mixed(n, seed):
    import random

    rng = random.Random(seed)
    members = []
    for i in range(n):
        members += [(i, "colour", rng.choice("rrrg")), (i, "size", rng.choice("sslm"))]
        if i % 7 == 0:
            members.append((i, "size", "m"))
        if i % 11 == 0:
            members.append((i, "colour", "no target"))
    return members


WANTED = [("colour", "r", 0.6), ("colour", "g", 0.4), ("size", "s", 0.3), ("size", "l", 0.4), ("size", "m", 0.3)]


def test_contradicting_margins_report_their_excess(spark):
    members = [(i, m, "a" if i < 3000 else "b") for i in range(6000) for m in ("one", "two")]
    _, report = two_margins(spark, members, [("one", "a", 0.8), ("one", "b", 0.2), ("two", "a", 0.2), ("two", "b", 0.8)])
    assert report == {("one", "a"): (2400, 3000, 2400, 0, 0), ("one", "b"): (600, 3000, 2400, 0, 1800), ("two", "a"): (600, 3000, 2400, 0, 1800), ("two", "b"): (2400, 3000, 2400, 0, 0)}


def test_fitting_in_the_cluster_and_on_the_driver_are_one(spark):
    held, report = two_margins(spark, mixed(1500, 3), WANTED, sample_share=0.3)
    cells = len({tuple(sorted(x)) for x in _labels(mixed(1500, 3)).values()})
    spread, again = two_margins(spark, mixed(1500, 3), WANTED, sample_share=0.3, held=cells - 1)
    assert set(held.values()) == set(spread.values())
    assert all(gap == 0 for *_, gap, _ in report.values()) and all(gap == 0 for *_, gap, _ in again.values())


def _labels(members):
    by_id = {}
    for i, m, x in members:
        if x != "no target":
            by_id.setdefault(i, set()).add((m, x))
    return by_id


def test_report_counts_the_sample(spark):
    members = mixed(2000, 9)
    sample, report = two_margins(spark, members, WANTED, sample_share=0.2)
    labels = _labels(members)
    counts = {}
    for i in sample:
        for k in labels[i]:
            counts[k] = counts.get(k, 0) + 1
    assert {k: r[2] for k, r in report.items()} == counts
    assert all(r[3] == 0 for r in report.values())


def test_without_raking_other_records_are_drawn(spark, monkeypatch):
    from millrace.llm import sampling

    raked, report = two_margins(spark, mixed(3000, 4), WANTED, sample_share=0.2)
    monkeypatch.setattr(sampling, "rake_held", lambda _, quotas: sampling.Fitting(quotas).factor)
    flat, _ = two_margins(spark, mixed(3000, 4), WANTED, sample_share=0.2)
    assert set(raked) != set(flat)


def test_repair_reaches_every_quota_that_two_margins_allow():
    import random

    from millrace.llm.sampling import Repair

    rng = random.Random(2)
    for _ in range(60):
        rows, columns = rng.randint(1, 5), rng.randint(1, 5)
        cells = [((("a", i), ("b", j))) for i in range(rows) for j in range(columns) if rng.random() < 0.7]
        n = [rng.randint(0, 9) for _ in cells]
        truth, taken = [rng.randint(0, k) for k in n], [rng.randint(0, k) for k in n]
        need = {}
        for c, t, k in zip(cells, truth, taken):
            for x in c:
                need[x] = need.get(x, 0) + t - k
        left = Repair(cells, n, taken[:], need)
        result = left.run()
        assert all(0 <= k <= most for k, most in zip(result, n))
        assert not any(left.need.values())


def test_two_margins_of_nb(spark):
    from millrace.llm.queries import p2_margins

    report = p2_margins(spark, "/root/testdata/sf0.001").collect()
    assert {r.margin for r in report} == {"cat", "quarter"}
    assert all(r.gap == max(r.quota - r.available, 0) and (r.gap == 0 or r.excess == 0) for r in report)


def test_repair_looks_at_all_cells_whatever_the_driver_holds(spark):
    import random

    rng = random.Random(5)
    members = [(i, m, f"{m}{rng.randint(0, 9)}") for i in range(3000) for m in "ab"]
    wanted = [(m, f"{m}{i}", 0.1) for m in "ab" for i in range(10)]
    for held in (5, 1):
        sample, report = two_margins(spark, members, wanted, sample_share=0.3, held=held)
        assert len(sample) == 900
        assert all((quota, got, gap, excess) == (90, 90, 0, 0) for quota, _, got, gap, excess in report.values())


def spread_repair(spark, cells, n, taken, need, held):
    from millrace.llm.sampling import SpreadRepair

    df = spark.createDataFrame(list(zip(cells, n, taken)), "members array<struct<margin string, label string>>, n long, taken long")
    got = {tuple(tuple(m) for m in r.members): (r.n, r.taken) for r in SpreadRepair(df, need, held).run().collect()}
    return [got[c] for c in cells]


def test_spread_repair_finds_chains_over_several_cells(spark):
    cells = [(("a", "1"), ("b", "1")), (("a", "2"), ("b", "1")), (("a", "2"), ("b", "2")), (("a", "3"), ("b", "2"))]
    need = {("a", "1"): 1, ("a", "2"): 0, ("a", "3"): -1, ("b", "1"): 0, ("b", "2"): 0}
    assert spread_repair(spark, cells, [1] * 4, [0, 1, 0, 1], need, 1) == [(1, 1), (1, 0), (1, 1), (1, 0)]
    assert not any(need.values())


def test_spread_repair_reaches_every_quota_that_two_margins_allow(spark):
    import random

    rng = random.Random(8)
    for held in (1, 4, 9):
        cells = [(("a", str(i)), ("b", str(j))) for i in range(5) for j in range(5) if rng.random() < 0.6]
        n = [rng.randint(0, 5) for _ in cells]
        truth, taken = [rng.randint(0, k) for k in n], [rng.randint(0, k) for k in n]
        need = {}
        for c, t, k in zip(cells, truth, taken):
            for x in c:
                need[x] = need.get(x, 0) + t - k
        result = spread_repair(spark, cells, n, taken, need, held)
        assert all(0 <= k <= most for most, k in result)
        assert not any(need.values())


def test_spread_repair_fills_by_force_and_keeps_the_excess(spark):
    members = [(i, m, "a" if i < 600 else "b") for i in range(1200) for m in ("one", "two")] + [(2000, "one", "a"), (2001, "two", "b")]
    wanted = [("one", "a", 0.8), ("one", "b", 0.2), ("two", "a", 0.2), ("two", "b", 0.8)]
    _, held = two_margins(spark, members, wanted)
    _, spread = two_margins(spark, members, wanted, held=1)
    assert {k: v[3:] for k, v in held.items()} == {k: v[3:] for k, v in spread.items()} and any(v[4] for v in spread.values())
