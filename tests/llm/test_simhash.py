import re
from itertools import combinations

import numpy as np
import xxhash

from lanewise.llm import near_duplicates as N
from lanewise.llm import simhash as S


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(rows, radius=3):
    fp = [brute_fingerprint(t) for _, t in rows]
    part = components(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if bin(fp[i] ^ fp[j]).count("1") <= radius])
    low = {}
    for (d, _), p in zip(rows, part):
        if d is not None:
            low[p] = min(d, low.get(p, d))
    return sorted(((d, f"{f:016x}", low.get(p)) for (d, _), f, p in zip(rows, fp, part)), key=str)


def test_query_against_brute_force(spark, data, small):
    from lanewise.llm.queries import op1_simhash_near_dedup

    got = op1_simhash_near_dedup(spark, data).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(small)


def test_edge_cases(docs, rows, none):
    got = S.simhash_components(docs).collect()
    want = brute([(r[0], r[1]) for r in rows])
    assert sorted(((r.id, f"{r.fingerprint & S.ONES:016x}", r.component) for r in got), key=str) == want
    assert S.simhash_components(none).count() == 0


def test_all_pairs_within_radius_meet(spark):
    rng = np.random.default_rng(3)
    for radius in (0, 1, 2, 3):
        base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
        found = set(base)
        for b in base:
            for _ in range(4):
                x = b
                for k in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                    x ^= 1 << int(k)
                found.add(x)
        fps = sorted(found)
        df = spark.createDataFrame([(S._signed(x),) for x in fps], "fingerprint bigint")
        place = {S._signed(x): i for i, x in enumerate(fps)}
        got = components(len(fps), [(place[r.a], place[r.b]) for r in S.links(df, radius).collect()])
        want = components(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= radius])
        assert got == want


def test_large_bucket_is_linked_like_a_small_one():
    rng = np.random.default_rng(5)
    for keep, flips in S.plan(3):
        drop, base = S.ONES ^ keep, int(rng.integers(0, 1 << 63))
        low = [b for b in range(64) if drop >> b & 1][:9]
        members = set()
        while len(members) < 250:
            x = (base & keep) ^ (0 if rng.random() < 0.2 else flips[int(rng.integers(1, len(flips)))])
            rest = base & drop
            for b in rng.choice(low, int(rng.integers(0, 6))):
                rest ^= 1 << int(b)
            members.add(x | rest)
        a = np.array(sorted(members), dtype=np.uint64)
        off = np.bitwise_count((a & np.uint64(keep)) ^ np.uint64(base & keep)).astype(int)
        apart = np.bitwise_count((a[:, None] ^ a[None, :]) & np.uint64(drop)).astype(int)
        want = components(len(a), [(i, j) for i, j in combinations(range(len(a)), 2) if off[i] + off[j] + apart[i, j] <= 3])
        assert components(len(a), S.link_bucket(a, base & keep, keep, 3, direct=0)) == want


def test_long_text_in_chunks_equals_whole(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = S.simhash(text, 3)
    monkeypatch.setattr(S, "CHUNK", 64)
    assert S.simhash(text, 3) == whole == brute_fingerprint(text.decode())


def shingle_set(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def brute_kept(texts):
    """The first of each component of the pairs at 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    return set(components(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= 0.8]))


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id for r in N.keep_one_of_each(df).select("doc_id").collect()}


def edited_copies(seed, copies, words=100, edits=(2,)):
    """An original and copies of it with other words in a few places."""
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = [base]
    for c in range(copies):
        text = list(base)
        for at in rng.choice(words, int(rng.choice(edits)), replace=False):
            text[at] = f"c{seed}x{c}x{at}"
        out.append(text)
    return [" ".join(t) for t in out]


def test_keep_one_of_each_against_brute_force(spark, data, small):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id for r in N.keep_one_of_each(docs).select("doc_id").collect()}
    sets = [shingle_set(t) for _, t in small]
    part = components(len(small), [(i, j) for i, j in combinations(range(len(small)), 2) if jaccard(sets[i], sets[j]) >= 0.8])
    low = {}
    for (d, _), p in zip(small, part):
        low[p] = min(d, low.get(p, d))
    assert got == set(low.values())


def test_keep_one_of_each_edge_cases(docs, none):
    got = N.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, 6, 7, 8, None]
    assert N.keep_one_of_each(none).count() == 0


def test_repeated_rows_leave_one(spark):
    rows = [(1, "some words that stand here twice over", "a"), (1, "some words that stand here twice over", "a"), (2, "and words that stand alone in a row", "b"), (None, None, "c"), (None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, other string")
    assert sorted(((r.doc_id, r.other) for r in N.keep_one_of_each(df).collect()), key=str) == [(1, "a"), (2, "b"), (None, "c")]


def test_estimated_forest_has_the_components_of_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sketches = rng.integers(0, 3, (14, 20)).astype(np.uint8)
        same = (sketches[:, None, :] == sketches[None, :, :]).mean(axis=2)
        for t in (0.0, 0.4, 0.5, 0.6):
            every = [(i, j) for i, j in combinations(range(14), 2) if same[i, j] >= t]
            tree = N.estimated_forest(sketches, t)
            assert components(14, every) == components(14, tree) and len(tree) == 14 - len(set(components(14, every)))


def random_sets(rng, n):
    """Sets near one or two centres, with repeats, empty and foreign ones."""
    centres = [rng.choice(400, 40, replace=False), rng.choice(400, 25, replace=False)]
    out = []
    for _ in range(n):
        s = set(centres[int(rng.random() < 0.3)].tolist())
        for x in rng.integers(0, 400, int(rng.integers(0, 9))):
            s ^= {int(x)}
        out.append(np.array(sorted(s if rng.random() < 0.95 else set()), dtype=np.uint64))
    return out


def test_exact_links_against_all_pairs():
    rng = np.random.default_rng(7)
    for trial in range(200):
        sets = random_sets(rng, int(rng.integers(1, 40)))
        n, sizes = len(sets), np.array([len(s) for s in sets])
        near = {(i, j) for i, j in combinations(range(n), 2) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8 and len(sets[i])}
        want = components(n, near)
        links = [x for x in N.exact_links(sets, sizes, 0.8) if sizes[x[0]]]
        assert components(n, links) == want
        # the same from differences, with what links to the reference given
        apart = [np.setxor1d(s, sets[0]) for s in sets]
        core = np.array([(0, j) in near or j == 0 for j in range(n)])
        given = [(0, j) for j in range(1, n) if core[j]]
        links = [x for x in N.exact_links(apart, sizes, 0.8, core) if sizes[x[0]]]
        assert components(n, links + given) == want
        side = rng.integers(0, 2, n)
        links = [x for x in N.exact_links(apart, sizes, 0.8, core, side) if sizes[x[0]]]
        assert components(n, links + given) == components(n, [(i, j) for i, j in near if side[i] != side[j]] + given)


def test_thousands_of_random_clusters_keep_their_links(spark):
    """Six copies of 120 words each, near the original but often not each other."""
    texts, want = [], set()
    for seed in range(2000):
        one = edited_copies(seed, 6, words=120, edits=(1, 2, 3, 4))
        want |= {len(texts) + k for k in brute_kept(one)}
        texts += one
    got = kept(spark, texts)
    # a pair that meets in no band is lost by design: 0.17 % of those at 0.8
    assert want <= got and len(got) - len(want) <= 20


def test_one_large_cluster_keeps_its_links(spark):
    texts = edited_copies(3, 1500, words=120, edits=(1, 2, 3, 4))
    assert kept(spark, texts) == brute_kept(texts)


def test_families_beyond_a_cell_are_compared_whole(spark, monkeypatch):
    texts = [t for seed in range(3) for t in edited_copies(seed, 80, edits=(1, 2, 3, 4))]
    want = brute_kept(texts)
    assert kept(spark, texts) == want
    seen = []
    monkeypatch.setattr(N, "links_of_large", lambda apart, s, f=N.links_of_large: seen.append(apart.count()) or f(apart, s))
    monkeypatch.setattr(N, "CELL", 5000)
    assert kept(spark, texts) == want
    assert seen and seen[0] > 200


def test_members_of_an_oversized_bucket_are_one_family(spark, monkeypatch):
    """An original and its copy must meet wherever they stand in the bucket."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "CELL", 40_000)
    monkeypatch.setattr(N, "band_edges", lambda nodes, f=N.band_edges: f(nodes.withColumn("bands", F.array(F.lit(7).cast("bigint")))))
    texts = [t for seed in range(300) for t in edited_copies(seed, 1)]
    assert kept(spark, texts) == brute_kept(texts)


def test_connected_components(spark):
    from lanewise.llm.common import connected_components

    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, 1000 + i) for i in range(1, 300)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    place = {n: i for i, n in enumerate(nodes)}
    want = components(len(nodes), [(place[a], place[b]) for a, b in pairs if a != b])
    assert got == {n: nodes[w] for n, w in zip(nodes, want)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
