"""Near-duplicates, lines and links against brute force."""

import random
import re

import numpy as np

from kgeo.llm import cap_join, graph, line_dedup, minhash, shingles


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def word_sets(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows, base = [], [[word() for _ in range(rng.randint(20, 120))] for _ in range(12)]
    for i in range(160):
        w = list(rng.choice(base)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, 12))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = word()
        rows.append((i * 3, " ".join(w) if rng.random() < 0.5 else "\t".join(w).upper()))
    return rows + [(1, None), (2, ""), (4, " \n "), (5, "One"), (7, "one"), (8, "b c"), (None, "one"), (10, "w " * 30_000), (3, rows[1][1])]


def test_shingle_sets_are_exact():
    texts = [(t or "").encode() for _, t in corpus()] + [b"a\x0bb\x0cc", " é É".encode(), *(f"x {w} y z u".encode() for w in alike(11))]
    for k in (1, 3, 5, 40):
        sets, sizes, hashes = shingles.shingle_sets([*map(shingles.normal, texts)], k)
        want = [word_sets(t.decode(), k) for t in texts]
        assert sizes.tolist() == [len(x) for x in want]
        parts, hashed = (np.split(x, np.cumsum(sizes)[:-1]) for x in (sets, hashes))
        for i in range(0, len(texts), 7):
            alone = shingles.shingle_sets([shingles.normal(texts[i])], k)[2]
            assert np.isin(alone, hashed[i]).all() and len(alone) == len(hashed[i])
            for j in range(len(texts)):
                assert len(np.intersect1d(parts[i], parts[j])) == len(np.intersect1d(hashed[i], hashed[j])) == len(want[i] & want[j])


def alike(n):
    """Two different words that any polynomial hash modulo 2**64 takes for one, from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_hash_alike_link_nothing(spark):
    x, y = alike(11)
    rows = [(1, f"one {x} two"), (2, f"one {y} two"), (3, x), (4, y), (5, f"ONE\n{x}\ttwo "), (6, " ".join(f"w{i} {x}" for i in range(50))), (7, " ".join(f"w{i} {y}" for i in range(50)))]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (1, 1), 6: (6, 98), 7: (7, 98)}


def test_minhash_links_what_brute_force_links(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS component", "1 AS rep", "2 AS kept", "'l' AS lang")
    for k, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(df, k, percent, block_shingles=3000).collect()
        sets = [(d, word_sets(t, k)) for d, t in rows if d is not None]
        links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
        want = components({d for d, _ in sets}, links)
        assert len(got) == len(rows)
        assert {(r.doc_id, r.component_id) for r in got} == {(d, want.get(d)) for d, _ in rows}
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_collection_size_meets_the_miss():
    m = minhash.collection_size(0.85, 4, 1e-4)
    assert 1 - (1 - (1 - 0.85**4) ** m) ** 2 <= 1e-4 * 1.001
    assert 2 * m * 4 < (m * m) * 8 / 4  # far fewer minhashes than tables of their own would take


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (5, 4), (4, 5)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 1000: 1000, **{2000 + i: 1000 for i in range(50)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_blocks_let_any_two_meet(spark):
    df = spark.range(57).selectExpr("id", "id % 2 AS k", "id AS x")
    met = graph.pair_blocks(df, "k", "id", size=5).groupBy("k", "block_a", "block_b").agg({"id": "collect_list"}).collect()
    pairs = {(a, b) for r in met for a in r[3] for b in r[3]}
    assert pairs == {(a, b) for a in range(57) for b in range(57) if a % 2 == b % 2}
    assert max(len(r[3]) for r in met) <= 22


def test_edit_distance():
    def table(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            q = [i]
            for j, d in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
            p = q
        return p[-1]

    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in "ab")
        assert line_dedup.edit_distance(a, b, 99) == table(a, b)
        assert (line_dedup.edit_distance(a, b, 2) <= 2) == (table(a, b) <= 2)
        found = line_dedup.few_edits(a, b, 3)
        assert found == (table(a, b) if table(a, b) <= 3 else None)
    for _ in range(60):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(70, 160)))
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            i = rng.randrange(len(b))
            b[i : i + 1] = rng.choice(("x", "", "ab"))
        b = "".join(b)
        assert line_dedup.edit_distance(a, b, 999) == table(a, b)
        assert (line_dedup.edit_distance(a, b, 10) <= 10) == (table(a, b) <= 10)
        for percent in (80, 90):
            assert line_dedup.similar(a, b, percent) == (table(a, b) <= (100 - percent) * max(len(a), len(b)) // 100)


def brute_lines(rows, percent=90):
    occ = {}
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if n := line_dedup.normalise(x):
                occ.setdefault(n, []).append((-(1 << 63) if d is None else d, k))
    names = [*occ]
    near = line_dedup.near(np.array([*map(len, names)]), line_dedup.simhashes(names)) if names else np.zeros((0, 0), bool)
    links = [(a, b) for a in range(len(names)) for b in range(a) if near[a, b] and line_dedup.similar(names[a], names[b], percent)]
    group = components(range(len(names)), links)
    first = {}
    for i, n in enumerate(names):
        first[group[i]] = min(first.get(group[i], (1 << 62, 0)), min(occ[n]))
    stays = {n: first[group[i]] for i, n in enumerate(names)}
    out = []
    for d, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if not (n := line_dedup.normalise(x)) or stays[n] == (-(1 << 63) if d is None else d, k)]
        out.append((d, t if t is None else "\n".join(kept)))
    return out, len(links)


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    pool = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice(pool))
            if rng.random() < 0.6:
                x[rng.randrange(len(x))] = rng.choice("xyz ")
            lines.append("".join(x) if rng.random() < 0.7 else "  " + "".join(x).upper())
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, pool[0] + "\n" + pool[0]), (None, pool[1]), (104, "y" * 20_000)]
    want, links = brute_lines(rows)
    assert links > 3
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row_id", "'g' AS gone", "'d' AS digest", "0 AS n_lines")
    for block in (1024, 4):
        got = line_dedup.dedup_lines(df, block=block)
        assert got.columns == ["doc_id", "text", "row_id", "gone", "digest", "n_lines", "n_removed"]
        assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)
        assert {r.row_id for r in got.collect()} == {1}
    twice = spark.createDataFrame([(1, "a b c d\ne"), (1, "a b c d\ne"), (2, "A  b c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(twice).collect()) == [(1, "a b c d\ne", 2, 0)] * 2 + [(2, "", 1, 1)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_caps_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 64))
    near = base[:80] + 0.3 * rng.standard_normal((80, 64))
    chain = [base[0]]
    for _ in range(6):
        chain.append(chain[-1] + 0.35 * rng.standard_normal(64))
    v = [*base, *near, *chain, *base[:5], *([base[7]] * 40)]
    rows = [(i * 2, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    odd = [(9001, None), (9003, [0.0] * 64), (9005, [float("nan")] + [1.0] * 63), (9007, [1.0, None]), (9009, [1.0, 0.0]), (9011, [2.0, 0.0]), (9013, []), (None, rows[0][1]), (9015, [3.0]), (9017, [5.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'k' AS key", "2 AS rep")
    got = cap_join.near_pairs(df).collect()
    assert len(got) == len(rows) + len(odd)
    m = np.array([r[1] for r in rows])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    ids = [r[0] for r in rows]
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    by = {r.vec_id: r for r in got}
    missed = sum(int(link[i].sum()) != by[d].n_links for i, d in enumerate(ids))
    assert missed == 0 and all(by[d].component_id == want[d] for d in ids)
    assert (by[9009].n_links, by[9011].component_id, by[9015].n_links) == (1, 9009, 1)
    assert all(by[d].n_links == 0 and by[d].kept for d in (9001, 9003, 9005, 9007, 9013))
    assert by[None].n_links == 0 and by[None].component_id is None and by[None].kept
    assert cap_join.near_pairs(df.limit(0)).count() == 0


def test_filters_are_all_that_reach():
    code = cap_join.ProductCode(16, 20, 2.0, 5)
    x = np.random.default_rng(1).standard_normal((30, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, keys = code.filters(x)
    near = [(x @ code.turn)[:, c] @ b for c, b in zip(code.cuts, code.books, strict=True)]
    want = {(r, a * code.n + b) for r in range(30) for a in range(code.n) for b in range(code.n) if near[0][r, a] + near[1][r, b] >= code.reach}
    assert {*zip(rows.tolist(), keys.tolist(), strict=True)} == want


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (3, b), (7, b + " more"), (8, a), (8, "c d e f g h"), (9, "c d e f g h"), (20, "x y z u v w"), (5, a.replace("a0 ", "n0 "))]
    for data in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (7, 3), (8, 3), (9, 3), (20, 20)}


def test_a_worker_hands_back_what_it_no_longer_needs():
    import re

    from kgeo.llm.storage import lean

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Private_Dirty:\s+(\d+)", f.read())[1]) / 1024

    def run(batches):
        for _ in batches:
            parts = [bytearray(1000) for _ in range(200_000)]
            last.append(bytearray(1000))  # on top of the heap, so that nothing below it goes back by itself
            del parts
            yield None

    last = []
    before = held()
    list(lean(run)([None]))
    assert held() - before < 60
