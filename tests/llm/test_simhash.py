import random

from xxhash import xxh64_intdigest

from quire.llm.components import components
from quire.llm.simhash import close_pairs, deduplicate, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component_id int"
SPACE = " \t\n\r\x0b\x0c"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], rng.choices(vocabulary, k=500)
    for i in range(60):
        words = base[:]
        for _ in range(i % 4):
            words[rng.randrange(500)] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "A"), (2004, "a"), (2005, "É é\x85É"),
             (2006, "x" * 200_000), (2007, "tie " * 50_000), (2000, None), (None, "A")]
    return [(i, t, "x", 7) for i, t in rows]


def test_classes_equal_brute_force(spark):
    rows = documents()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    distinct = sorted({fp for _, fp in prints})
    pairs = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2]
    roots = brute_roots(distinct, pairs)
    assert any(a != b for a, b in roots.items())
    least = {}
    for i, fp in prints:
        if i is not None:
            least[roots[fp]] = min(i, least.get(roots[fp], i))
    want = sorted(((i, fp, least[roots[fp]]) for i, fp in prints), key=repr)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=repr) == want


def test_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            mask = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7)))
            prints.add(base ^ mask)
    prints |= {0, 1, 1 << 63, (1 << 64) - 1}
    signed = [(p - (p >> 63 << 64),) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    for distance in (0, 1, 2, 3, 5):
        want = {
            (a, b) for (a,) in signed for (b,) in signed
            if a < b and ((a ^ b) % 2**64).bit_count() <= distance
        }
        got = [tuple(r) for r in close_pairs(df, distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want, distance


def test_one_document_of_each_group_stays(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    groups = {r[0]: r[2] for r in near_duplicates(df).collect() if r[0] is not None}
    kept = deduplicate(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(groups.values()))
    assert ids.count(None) == 1


def test_components_of_chains_and_random_graphs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, 5), (-7, 3), (3, -7)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    got = [tuple(r) for r in components(df).collect()]
    assert len(got) == len(nodes) and dict(got) == brute_roots(nodes, [e for e in edges if e[0] != e[1]])


def test_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
