import re

import xxhash
from hudlake.llm import simhash


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def groups(prints):
    """Components by comparing all pairs."""
    ids = list(prints)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                ra, rb = root[a], root[b]
                for k in ids:
                    if root[k] in (ra, rb):
                        root[k] = min(ra, rb)
    return root


def test_every_pair_within_the_radius_shares_a_table():
    m = simhash.masks()
    assert len(m) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not x & (1 << i | 1 << j) for x in m)


def test_fingerprints_and_components(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    texts = {0: None, 1: "", 2: "\t \n", 3: "One", 4: "one TWO", 5: base, 6: base.upper(), 7: base + " x", 8: base,
             9: "Ünï cödé É é words ß", 10: "a " * 3000, 11: "one"}
    docs = spark.createDataFrame([(k, v, "x", k) for k, v in texts.items()], "doc_id long, text string, fp string, component_id long")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {k: brute(v) for k, v in texts.items()}
    assert {k: r.fp & (2**64 - 1) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == groups(prints)


def test_links_form_the_components_of_all_pairs(spark):
    import random

    rng = random.Random(3)
    prints = {}
    for k in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            prints[len(prints)] = x
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
    distinct = spark.createDataFrame([(simhash.signed(p),) for p in set(prints.values())], "fp long")
    from hudlake.llm import shared

    got = {r.node: r.component for r in shared.components(simhash.links(distinct)).collect()}
    want = groups(prints)
    for a in prints:
        for b in prints:
            ga, gb = (got.get(simhash.signed(prints[x]), simhash.signed(prints[x])) for x in (a, b))
            assert (ga == gb) == (want[a] == want[b])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
