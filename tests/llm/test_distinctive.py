import numpy as np

from millrace.llm.distinctive import distinctive_terms, fit_two_poisson


def test_mixture_is_recovered():
    rng = np.random.default_rng(1)
    n, share = 50_000, 0.1
    counts = np.where(rng.random(n) < share, rng.poisson(6.0, n), rng.poisson(0.4, n))
    values, weights = np.unique(counts[counts > 0], return_counts=True)
    p, high, low = fit_two_poisson(np.zeros(len(values), np.int64), values.astype(float), weights.astype(float), n, 1, rounds=200)
    assert abs(p[0] - share) < 0.01 and abs(high[0] - 6) < 0.2 and abs(low[0] - 0.4) < 0.03


def test_many_terms_at_once_as_one_by_one():
    cells = [([1.0, 2.0, 9.0], [50.0, 5.0, 7.0]), ([1.0], [3.0]), ([4.0, 5.0], [1.0, 1.0])]
    owner = np.repeat(np.arange(3), [len(c) for c, _ in cells])
    together = fit_two_poisson(owner, np.concatenate([c for c, _ in cells]), np.concatenate([w for _, w in cells]), 1000, 3)
    for t, (c, w) in enumerate(cells):
        alone = fit_two_poisson(np.zeros(len(c), np.int64), np.array(c), np.array(w), 1000, 1)
        assert np.allclose([x[t] for x in together], [x[0] for x in alone])


def test_scores_rise_with_the_count_and_common_terms_count_little(nb):
    made, k = [], 0
    for doc in range(300):
        k += 1
        made.append((k, doc, "c", "the", 3 + doc % 3))
        if doc % 50 == 0:
            k += 1
            made.append((k, doc, "c", "quark", 8))
        elif doc % 25 == 0:
            k += 1
            made.append((k, doc, "c", "quark", 1))
    scored = {(r.docno, r.term): r for r in distinctive_terms(nb(made)).collect()}
    assert len(scored) == k
    assert scored[0, "quark"].score > 0.99 > scored[25, "quark"].score > 0
    assert all(0 <= r.score <= 1 for r in scored.values())
    assert scored[0, "quark"].total == 8 + 3 and scored[0, "quark"].df == 12 and scored[0, "quark"].records == 300
    assert {r.score for r in scored.values() if r.term == "quark" and r.tf == 8} == {scored[0, "quark"].score}


def test_empty_and_dirty(nb, rows):
    assert rows(distinctive_terms(nb([]))) == []
    assert rows(distinctive_terms(nb([(1, None, "c", "x", 1), (2, 1, "c", None, 1), (3, 1, "c", "x", -1)]))) == []
    only = rows(distinctive_terms(nb([(1, 1, "c", "x", 1)])))
    assert only[0][:6] == (1, "x", 1, 1, 1, 1)


def test_fitting_goes_on_until_nothing_moves_and_likelihood_never_falls():
    from millrace.llm.distinctive import log_likelihood

    rng = np.random.default_rng(5)
    owner, count, weight = [], [], []
    for t in range(40):
        values, n = np.unique(np.where(rng.random(2000) < 0.05, rng.poisson(rng.uniform(2, 9), 2000), rng.poisson(rng.uniform(0.01, 0.5), 2000)), return_counts=True)
        held = values > 0
        owner.append(np.full(held.sum(), t))
        count.append(values[held].astype(float))
        weight.append(n[held].astype(float))
    owner, count, weight = map(np.concatenate, (owner, count, weight))
    fits = [fit_two_poisson(owner, count, weight, 2000, 40, rounds=r) for r in (1, 5, 20, 100, 300)]
    likely = [log_likelihood(owner, count, weight, 2000, *f) for f in fits]
    for worse, better in zip(likely, likely[1:]):
        assert np.all(better >= worse - 1e-6)
    assert np.allclose(fit_two_poisson(owner, count, weight, 2000, 40, rounds=3000), fits[-1], rtol=1e-3)


def test_top_terms_are_those_of_the_posterior(nb, monkeypatch):
    from millrace.llm import distinctive

    made, k = [], 0
    for doc in range(200):
        for term, tf in [("the", 4), (f"own{doc // 20}", 9 if doc % 20 == 0 else 1), ("of", 2), (f"name{doc // 2}", 3)]:
            k += 1
            made.append((k, doc, "c", term, tf))
    scored = distinctive.distinctive_terms(nb(made)).cache()
    found = {}
    for r in distinctive.top_terms(scored, 2).collect():
        found.setdefault(r.docno, []).append((r["rank"], r.term))
    truth = {}
    for r in sorted(scored.collect(), key=lambda r: (-r.log_odds, r.term)):
        if r.score >= 0.5 and len(truth.setdefault(r.docno, [])) < 2:
            truth[r.docno].append((len(truth[r.docno]) + 1, r.term))
    assert {d: sorted(x) for d, x in found.items()} == {d: x for d, x in truth.items() if x}
    assert found[0][0][1] == "own0" or found[0][1][1] == "own0"


def test_top_terms_of_an_empty_table(nb, rows):
    from millrace.llm.distinctive import top_terms

    assert rows(top_terms(distinctive_terms(nb([])))) == []
