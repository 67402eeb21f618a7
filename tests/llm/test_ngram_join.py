import random

import pytest

from tallywick.llm import ngram_join as J


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(rows, threshold=0.8):
    ids = [k for k, _ in rows]
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: least[root(i)] for i in range(len(rows))}


def corpus(seed, groups, size, edits, length=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(length)] = word()
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("groups", "size", "edits"), [(12, 4, 2), (1, 120, 3), (2, 60, 1)])
def test_classes_equal_brute_force(make, groups, size, edits):
    """Small and large buckets, dense groups and groups that hubs alone do not connect."""
    rows = corpus(groups, groups, size, edits)
    got = {r.doc_id: r.class_id for r in J.ngram_jaccard_join(make(rows), recall=0.99999).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize(("size", "block"), [(150, 256), (150, 40)])
def test_links_equal_brute_force(make, monkeypatch, size, block):
    """Groups far larger than a small bucket: every link of every text counts once."""
    monkeypatch.setattr(J, "BLOCK_TEXTS", block)
    monkeypatch.setattr(J, "WIDTH", 64)
    rows = corpus(size, 1, size, 3) + [(1000 + k, t) for k, t in corpus(7, 3, 5, 1)]
    sets = {" ".join(t.split()): grams(t) for _, t in rows}
    want = {k: sum(len(sets[t] & g) / len(sets[t] | g) >= 0.8 for x, g in sets.items() if x != t) for k, t in rows}
    got = {r.doc_id: r.n_links for r in J.ngram_jaccard_join(make(rows), recall=0.99999).collect()}
    assert got == want and max(want.values()) > 26


def test_links_do_not_depend_on_the_size_of_a_bucket(make):
    rows = corpus(21, 3, 30, 2) + [(1000 + k, t) for k, t in corpus(7, 5, 4, 2)]
    got = [{r.doc_id: r.n_links for r in J.ngram_jaccard_join(make(rows), recall=0.99999, small=small).collect()} for small in (2, 16, 1000)]
    assert got[0] == got[1] == got[2] and max(got[0].values()) > 10


def test_edge_rows(make):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A  b"), (6, long), (7, long + " x"), (8, "a b c d e"), (8, "a b c d e"), (9, "f g h i j"), (None, "a b")]
    got = {r.doc_id: r for r in J.ngram_jaccard_join(make(rows)).collect()}
    assert {k: r.class_id for k, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9}
    assert got[6].n_links == 1 and got[4].n_links == 0 and got[4].n_copies >= 2
    assert J.ngram_jaccard_join(make(rows)).filter("doc_id = 8").count() == 1


def test_empty(make):
    assert J.ngram_jaccard_join(make([])).count() == 0


def test_plan_reaches_recall():
    for t in (0.5, 0.8, 0.95):
        bands, rows = J.plan_bands(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999 and bands * rows <= 160


def test_large_buckets_dealt_to_many_tasks(make, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_ROWS", 7)
    rows = corpus(1, 1, 120, 3)
    assert {r.doc_id: r.class_id for r in J.ngram_jaccard_join(make(rows), recall=0.99999).collect()} == brute_classes(rows)


def test_one_per_class_tells_rows_apart_by_id_and_text(make):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "twelve of these words stand alone")
    rows = [(1, a), (1, b), (5, b), (3, a), (9, a), (9, c), (7, c), (7, c), (8, None), (8, ""), (None, a)]
    kept = sorted(((r.doc_id or 0), r.text or "") for r in J.one_per_class(make(rows)).collect())
    assert kept == [(0, a), (1, a), (1, b), (7, c), (8, "")]
    assert J.one_per_class(make(rows)).columns == make(rows).columns
    plain = corpus(3, 6, 3, 1)
    assert sorted(r.doc_id for r in J.one_per_class(make(plain)).collect()) == sorted(set(brute_classes(plain).values()))


def test_recall_with_the_default_bands(spark):
    """Links of every text whose id is divisible by 50 to all texts, against brute force; the defaults."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: " ".join((r.text or "").lower().split()) for r in docs.collect()}
    sets = {t: grams(t) for t in set(texts.values()) if t}
    holders = {}
    for t, g in sets.items():
        for x in g:
            holders.setdefault(x, []).append(t)
    got = {r.doc_id: r.n_links for r in J.ngram_jaccard_join(docs).filter("doc_id % 50 = 0").collect()}
    true = found = 0
    for k, t in texts.items():
        if k % 50 == 0 and t:
            near = {u for x in sets[t] for u in holders[x]} - {t}
            n = sum(len(sets[t] & sets[u]) / len(sets[t] | sets[u]) >= 0.8 for u in near)
            true, found = true + n, found + got[k]
            assert got[k] <= n
    assert true >= 5 and found >= 0.99 * true
