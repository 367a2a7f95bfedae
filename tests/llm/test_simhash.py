import numpy as np
import pytest
import xxhash

from docloom.llm import vp_tree
from docloom.llm.components import connected_components
from docloom.llm.simhash import _masks, drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates
from tests.llm.rows import awkward, empty, plain


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    group = {i: {i} for i in range(len(pairs))}
    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= 4 and group[i] is not group[j]:
                joined = group[i] | group[j]
                for k in joined:
                    group[k] = joined
    name = lambda g: min((pairs[k][0] for k in g if pairs[k][0] is not None), default=None)
    return sorted(((d, f"{f:016x}", name(group[i])) for i, (d, f) in enumerate(pairs)), key=repr)


def test_fingerprint_of_texts():
    for text in ("", " \n\t ", "one", "Two words", "A b c D e f g h", "a a a a a a a", "é😀 \x85 ÉCOLE x y"):
        assert fingerprint(text.encode()) == slow_fingerprint(text), text


def test_awkward_rows_agree_with_brute_force(spark):
    docs = awkward(spark)
    pairs = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
    got = near_duplicates(docs)
    assert plain(got) == slow_components(pairs)
    assert near_duplicates(empty(spark)).count() == 0


def test_documents_with_near_copies(spark):
    base = [" ".join(f"w{(i * 31 + k * k) % 211}" for k in range(300)) for i in range(12)]
    docs = [(i, t) for i, t in enumerate(base)] + [(50 + i, t.replace("w7 ", "w8 ", 1)) for i, t in enumerate(base)]
    pairs = [(i, slow_fingerprint(t)) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert plain(near_duplicates(df, shard_size=4)) == slow_components(pairs)
    kept = {r["doc_id"] for r in drop_near_duplicates(df).collect()}
    assert kept == {c for _, _, c in slow_components(pairs)}


def _points(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))) for b in base[:200] for _ in range(3)]
    ball = [base[300] ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))) for _ in range(1500)]
    return np.unique(np.concatenate([base, np.array(near + ball, np.uint64)]))


@pytest.mark.parametrize("blocks", [1, 2, 3, 5])
def test_trees_find_all_links(blocks):
    points = _points()
    want = vp_tree.Forest(len(points))
    want.link(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4))
    got = vp_tree.Forest(len(points))
    for mask in _masks(blocks):
        tree, n = vp_tree.build(points[::5], mask, 4 // blocks, 60)
        shards, places = vp_tree.route(tree, points, mask, 4 // blocks)
        for shard in range(n):
            at = places[shards == shard]
            got.link(at, at[vp_tree.link_shard(points[at], mask, 4 // blocks, 4)])
    assert (got.roots() == want.roots()).all()


def test_links_of_a_table_join_the_right_groups(spark):
    points = _points(1).view(np.int64)
    df = spark.createDataFrame([(int(p),) for p in points], "fp long")
    nodes = {r["node"]: r["root"] for r in connected_components(fingerprint_links(df, shard_size=100)).collect()}
    want = vp_tree.Forest(len(points))
    u = points.view(np.uint64)
    want.link(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4))
    roots = want.roots()
    groups = {}
    for i, p in enumerate(points):
        groups.setdefault(int(roots[i]), set()).add(nodes.get(int(p), int(p)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)] + [(300, 300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(200, 260)) and 300 not in got


def test_components_of_long_chains_in_any_order(spark):
    rng = np.random.default_rng(4)
    # The smallest node at the far end of a rising chain, the two smallest at both ends, and random order.
    orders = [[*range(1, 1000), 0], [1, *(rng.permutation(998) + 2).tolist(), 0], rng.permutation(1000).tolist()]
    links = [(k * 1000 + a, k * 1000 + b) for k, order in enumerate(orders) for a, b in zip(order, order[1:])]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: i // 1000 * 1000 for i in range(3000)}
