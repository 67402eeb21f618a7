"""SimHash components, conversation repair and ranked search against plain versions and SQL."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from tallywick.llm import impact_search, queries, simhash_trie, turn_repair
from tallywick.session import Scratch

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(150_000))


@pytest.mark.parametrize("name", ["op12_turn_repair", "op13_impact_search"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    assert [c[0] for c in found.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprints_equal_the_definition():
    rng = random.Random(2)
    bits = ["a", "B", "É", " ", "\t", "\x0b", "\x1c", "  ", "word", " ", "Straße"]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randint(0, 40)))
        assert simhash_trie.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash_trie.fingerprint(b"") == simhash_trie.fingerprint(b" \n") == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def close_prints(seed, centres, size, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.append(x)
            if rng.random() < 0.3:  # chains leave the centre
                x = out[rng.randrange(len(out))]
            for _ in range(rng.randint(1, flips)):
                x ^= 1 << rng.randrange(64)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("most", "pairs", "leaves"), [(1_000_000, 1_000_000, 250_000), (30, 7, 11), (3, 1_000_000, 1)])
def test_components_equal_brute_force(spark, monkeypatch, most, pairs, leaves):
    """Whole nodes, and nodes cut deeper again and again; many pairs at a time, and few."""
    monkeypatch.setattr(simhash_trie, "MOST_PAIRS", pairs)
    monkeypatch.setattr(simhash_trie, "TASK_LEAVES", leaves)
    prints = close_prints(most, 25, 12, 4)
    scratch = Scratch(spark, "test")
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    nodes = simhash_trie.bounded_nodes(frame, scratch, most)
    assert max(r["count"] for r in nodes.groupBy(*simhash_trie.NODE).count().collect()) <= most
    labels = {r.node: r.label for r in simhash_trie.connected_components(simhash_trie.local_links(nodes), scratch).collect()}
    got = [labels.get(signed(x), signed(x)) for x in prints]
    want = plain_components(prints)
    assert len(set(want)) < len(prints) and len(set(want)) > 20
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_links_grow_with_leaves_not_pairs():
    """A dense ball of 700 leaves emits at most one link per leaf."""
    rng = random.Random(1)
    centre = rng.getrandbits(48)
    bits = np.unique(np.array([centre ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) for _ in range(700)], np.uint64))
    n = len(bits)
    zero = np.zeros(n, np.int64)
    label = simhash_trie.trie_links(zero, zero + 16, zero, zero, zero, bits)
    assert len(set(label)) == len(set(plain_components(bits.tolist())))


def test_simhash_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op11_simhash_trie(spark, DATA).collect()}
    ids = sorted(rows)
    prints = [plain_fingerprint(rows[i]) for i in ids]
    assert [int(got[i].fingerprint, 16) for i in ids] == prints
    assert [got[i].component_id for i in ids] == [ids[c] for c in plain_components(prints)]


def test_simhash_edges(make):
    rows = [(1, None), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, LONG), (5, LONG + " x"), (6, "other words stand here"), (6, "one two"), (None, "one two"), (None, "alone in its row"), (9, LONG)]
    got = sorted(map(tuple, simhash_trie.near_duplicates(make(rows)).collect()), key=repr)
    assert len(got) == len(rows)
    component = {(k, f): c for k, f, c in got}
    zero, two = "0" * 16, f"{plain_fingerprint('one two'):016x}"
    assert component[1, zero] == component[2, zero] == 1
    assert {component[k, two] for k in (3, 4, 6, None)} == {3}
    assert {component[k, f"{simhash_trie.fingerprint(LONG.encode()):016x}"] for k in (5, 9)} == {5}
    assert component[None, f"{plain_fingerprint('alone in its row'):016x}"] is None
    assert simhash_trie.near_duplicates(make([])).collect() == []
    with pytest.raises(ValueError):
        simhash_trie.near_duplicates(make(rows), budget=4)


# conversation repair


def plain_repair(codes):
    """A table of least (cost, audit) per state, row by row."""
    never, after = (10**9, ""), (2, 2, 3, 2)

    def inserted(states):
        for _ in range(3):
            for s in range(4):
                if states[s] < never:
                    states[after[s]] = min(states[after[s]], (states[s][0] + 5, states[s][1] + "I"))
        return states

    states = inserted([(0, ""), never, never, never])
    for code in codes:
        new = [never] * 4
        for s, (cost, audit) in enumerate(states):
            if cost >= never[0]:
                continue
            new[s] = min(new[s], (cost + 2, audit + "D"))
            extra, role = 5 * code.isupper(), code.lower()
            if role != "x":
                if role == "uuau"[s]:
                    new[after[s]] = min(new[after[s]], (cost + extra, audit + "K"))
                if role == "s" and s == 0:
                    new[1] = min(new[1], (cost + extra, audit + "K"))
                new[after[s]] = min(new[after[s]], (cost + extra + 1, audit + "R"))
        states = inserted(new)
    return min(states[0], states[3])


def test_repair_of_all_short_conversations():
    for n in range(5):
        for codes in itertools.product("xuasoUASO", repeat=n):
            assert turn_repair.repair("".join(codes)) == plain_repair(codes)


@pytest.mark.parametrize("weights", [{"u": 8, "a": 8, "s": 1, "x": 2, "U": 1, "A": 1, "o": 1}, {"s": 1, "S": 1, "o": 1}, {"u": 1, "U": 1}])
def test_repair_of_long_conversations(weights):
    rng = random.Random(4)
    codes = "".join(rng.choices(list(weights), list(weights.values()), k=600))
    assert turn_repair.repair(codes) == plain_repair(codes)


def test_bounds_never_exceed_what_is_left():
    rng = random.Random(8)
    for _ in range(40):
        codes = "".join(rng.choices("xuasoUASO", k=12))
        bounds = turn_repair.lower_bounds(codes)
        assert all(bounds[i][0] <= plain_repair(codes[i:])[0] for i in range(13))


def plain_conversation(rows):
    """The contract, row by row: rows of (turn, role, text) as they were stored."""
    after = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    counts, seen, codes = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), ""
    for _, role, text in after:
        held = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        code = role[:1] if role[:1] in ("u", "a", "s") else "o"
        codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
    turns = [t for t, _, _ in after if t is not None]
    cost, audit = plain_repair(codes)
    out, row, shift = [], 0, len(audit.replace("D", "")) % 2
    for e in audit:
        wanted = "assistant" if (len(out) - shift) % 2 else "user"
        if e != "D":
            out.append(f"{after[row][1] if e == 'K' else wanted}:{'' if e == 'I' else after[row][2]}")
        row += e != "I"
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repaired_conversations_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(conv, turn, rng.choice(["user", "user", "assistant", "assistant", "system", "", "tool", None]), rng.choice(["a.", "b!", "b!", "cut", " ", "é?\n", "…", None])) for conv in range(60) for turn in range(rng.randint(1, 12))]
    rows += [(99, None, "user", "x."), (99, None, "assistant", "y"), (99, 3, "user", "x."), (None, 1, "user", "alone."), (None, 2, "assistant", "\x1c."), (98, 5, "assistant", LONG), (98, 6, "user", LONG)]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)]
    dropped = next(k for k in range(2000, 9000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone"))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], "conv_id long, turn long, role string, text string, place string, code string")
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair_conversations(turn_repair.damaged(frame)).collect()}
    assert got == {k: plain_conversation([r for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair_conversations(turn_repair.damaged(empty)).collect() == []


# ranked search


def plain_search(docs, items, k=10):
    def split(text):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    held = [(key, split(t)) for key, t in docs]
    held = [(key, w) for key, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item in {i for i, _ in items}:
        asked = [t for i, text in items if i == item for t in split(text)]
        scores = []
        for key, words in held:
            score = 0
            for t in asked:
                if tf := words.count(t):
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in held) + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(words) * n) // total)))
            if score > 0:
                scores.append((-score, key is not None, key or 0))
        out += [(item, r + 1, key if there else None, -score) for r, (score, there, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("lot", "block", "step"), [(1_000_000, 200_000, 16), (40, 3, 1)])
def test_search_equals_brute_force(make, spark, monkeypatch, lot, block, step):
    """One lot and one block of items; and many of each, with the scores known from lot to lot."""
    monkeypatch.setattr(impact_search, "LOT_POSTINGS", lot)
    monkeypatch.setattr(impact_search, "FIRST_STEP", step)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "Straße", "日本"]
    docs = [(k, rng.choice([" ", "-", "\n"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 30)))) for k in range(150)]
    docs += [(k + 500, docs[3][1]) for k in range(25)] + [(3, docs[3][1]), (3, "w1 w2"), (None, docs[3][1]), (900, None), (901, " \n"), (902, "W29 " * 400)]
    items = [(1, "w1 W2 w2 w9"), (2, "w29 é unknown"), (2, "w28"), (3, docs[3][1]), (4, "unknown"), (5, None), (None, "straße 日本")]
    frame = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, score string")
    got = impact_search.search(make(docs), frame, block_terms=block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items)


def test_search_of_nothing(make, spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert impact_search.search(make([]), items).collect() == []
    assert impact_search.search(make([(1, "a b")]), items.limit(0)).collect() == []


def test_best_positions_stop_early():
    """A document that leads every list ends the item long before the lists do."""
    n = 5000
    doc = np.tile(np.arange(n), 3)
    count = np.where(doc < 10, 60, 1 + doc % 3)
    lists = impact_search.ImpactLists([100] * n, doc, np.repeat(np.arange(3), n), count, n, 100 * n, np.array([900, 800, 700]))
    docs, scores, read = impact_search.best_positions(lists, np.arange(3), np.ones(3, np.int64), 10, 0)
    assert sorted(docs[np.argsort(-scores, kind="stable")][:10].tolist()) == list(range(10))
    assert read < 3 * n / 50
