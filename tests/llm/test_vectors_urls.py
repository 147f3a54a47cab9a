"""Vector and URL operators against brute force, and their edge cases."""

import numpy as np

from docpipe.llm.ann import nearest
from docpipe.llm.components import components
from docpipe.llm.embedding_dedup import embedding_groups, linked_pairs
from docpipe.llm.url_filter import RULES, filter_urls, fit_urls, labelled_urls, ruled

SCHEMA = "vec_id long, embedding array<float>, label int, score string"
ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [1.0] * 7 + [None], 1),
       (905, [float("inf")] + [1.0] * 7, 1), (906, [1.0] * 8, None)]


def vectors(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[100:200] = x[50] + 0.05 * rng.normal(size=(100, 8))
    x[200:260] = x[60]
    label = np.where(np.arange(n) % 3 == 0, 2, 1)
    rows = [(i, x[i].tolist(), int(label[i]), "clash") for i in range(n)]
    return x.astype(float), label, spark.createDataFrame(rows + [(*r, "clash") for r in ODD], SCHEMA)


def test_embedding_groups_against_all_pairs(spark):
    x, label, df = vectors(spark)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    for tile in (64, 4096):
        got = {r.vec_id: r for r in embedding_groups(df, tile=tile).collect()}
        assert len(got) == len(x) + len(ODD)
        assert all((got[i].n_links, got[i].component_id) == (near[i].sum(), root[i]) for i in range(len(x)))
        assert all(got[r[0]].n_links == 0 and got[r[0]].kept for r in ODD)
    assert embedding_groups(df.limit(0)).count() == 0


def test_bound_loses_no_pair():
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(size=(300, 16)) * 2)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if unit[i] @ unit[j] >= 0.8}
    assert {(a, b) for i, j in linked_pairs(x, x, 0.8, True, rows=37) for a, b in zip(i, j)} == want and want


def test_nearest_recall_ties_and_odd_rows(spark):
    x, _, df = vectors(spark, 3000)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and q not in {v for _, v, _ in rows}
        assert all(s == (x[q] * x[v]).sum() for _, v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        hits += len({v for _, v, _ in rows} & set(np.lexsort((np.arange(3000), -scores))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)
    few = df.where("vec_id < 5")
    assert nearest(few, few).count() == 20 and nearest(few.limit(0), few).count() == 0


def test_nearest_counts_repeated_ids_once(spark):
    # Every id has several equal rows, one worse row of its own, and near lists.
    rng = np.random.default_rng(4)
    n, repeats = 1500, 12
    x = rng.normal(size=(n, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 1, "") for i, v in enumerate(x) for _ in range(repeats)] + [(i, (v * 0.5).tolist(), 1, "") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(10_000 + i, x[i].tolist(), 1, "") for i in range(0, n, 25)], SCHEMA)
    got, hits, x = {}, 0, x.astype(float)
    for r in nearest(df, asked).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == n // 25
    for q, found in got.items():
        scores = (x * x[q - 10_000]).sum(1)
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        assert all(s == scores[v] for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


URLS = [(1, "http://www.Example.ORG/es/1"), (2, "https://example.org/en/12"), (3, "http://a.org/x"), (4, "http://a.com/de/?q"), (5, "x.com/fr/"),
        (6, None), (7, ""), (8, "ftp://b.com#/fr/"), (9, "http://com/fr/1#a"), (10, "http://a.org"), (10, "http://a.org"), (11, "http://" + "a" * 50_000)]


def test_url_rules(spark):
    rows = {r.page_id: r for r in ruled(spark.createDataFrame(URLS, "page_id long, url string")).collect()}
    assert {i: r.rule for i, r in rows.items()} == {
        1: "example.org/es/", 2: "example.org/en/1", 3: "org/", 4: "com/de/", 5: None, 6: None, 7: None, 8: None, 9: "com/fr/", 10: None, 11: None}
    assert (rows[1].host, rows[1].path) == ("www.example.org", "/es/1") and (rows[8].host, rows[8].path) == ("b.com", "") and rows[5].host == ""


def test_url_model_learns_and_agrees_with_plain_scores(spark):
    hosts = [f"h{i}.net" for i in range(400)]
    paths = [f"/{'bad' if i % 2 else 'good'}/{i}" for i in range(400)]
    model = fit_urls(hosts[:300], paths[:300], [i % 2 for i in range(300)])
    assert ((model.score(hosts[300:], paths[300:]) >= 0.5) == np.arange(300, 400) % 2).mean() > 0.95
    assert np.allclose(model.score(hosts[:5], paths[:5]), [model.score([h], [p])[0] for h, p in zip(hosts, paths[:5])])


def test_url_filter_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = filter_urls(pages, labelled_urls(pages)).collect()
    assert len(got) == pages.count() and {r.verdict for r in got} <= {"allow", "block"}
    by = {r.text: r.verdict for r in RULES}
    assert all(r.verdict == by[r.rule] for r in got if r.rule)
    odd = spark.createDataFrame(URLS, "page_id long, url string")
    assert filter_urls(odd, labelled_urls(odd.limit(0))).count() == len(URLS)
