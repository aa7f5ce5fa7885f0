import random

import numpy as np
import xxhash
from llm_tables import awkward, docs_of, rows

from kerbside.llm import simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """Smallest position reachable, per position."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def family(draw):
    """A text and near copies that differ in a few words."""
    words = [f"w{draw.randint(0, 9999)}" for _ in range(300)]
    for _ in range(6):
        copy = list(words)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(300)] = f"x{draw.randint(0, 9999)}"
        yield " ".join(copy)


def test_components_equal_brute_force(spark):
    draw = random.Random(5)
    texts = [t for _ in range(12) for t in family(draw)] + ["One two", "one TWO", "", None, "a b c d", "a b c d e"]
    got = simhash.components(docs_of(spark, texts)).orderBy("doc_id").collect()
    prints = [fingerprint(t) for t in texts]
    assert [r["fp"] % (1 << 64) for r in got] == prints
    assert [r["component_id"] for r in got] == components(prints)
    kept = simhash.deduplicate(docs_of(spark, texts, fp=1, n=2))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components(prints)))


def test_deduplicate_goes_by_row(spark):
    draw = random.Random(7)
    a, b, c, d = ([f"{k}{draw.randint(0, 9999)}" for _ in range(3000)] for k in "abcd")
    near = " ".join([*a[:-1], "other"])
    a, b, c, d = map(" ".join, (a, b, c, d))
    assert bin(fingerprint(a) ^ fingerprint(near)).count("1") <= 4
    cases = [(None, c), (None, c), (None, d), (8, d),             # copies without an id, and of a numbered document
             (1, a), (5, near), (5, b), (9, b + " x y"), (9, c + d)]  # unrelated texts of one id
    docs = spark.createDataFrame(cases, "doc_id BIGINT, text STRING")
    prints = [fingerprint(t) for _, t in cases]
    order = sorted(range(len(cases)), key=lambda i: (cases[i][0] is None, cases[i][0] or 0))
    roots = components([prints[i] for i in order])
    want = [cases[order[k]] for k in sorted(set(roots))]
    assert (None, c) in want and (8, d) in want and (5, b) in want and (5, near) not in want
    assert rows(simhash.deduplicate(docs)) == sorted(want, key=repr)
    pair = spark.createDataFrame([(5, a), (5, b)], "doc_id BIGINT, text STRING")
    assert simhash.deduplicate(pair).count() == 2


def test_links_are_exact_in_crowded_cells(spark):
    """Chains of single-bit steps, a dense ball and noise, with cells cut into chunks."""
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.int64)}
    centre = int(rng.integers(0, 1 << 63))
    prints |= {centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(150)}
    chain = int(rng.integers(0, 1 << 63))
    for step in range(12):
        chain ^= sum(1 << b for b in range(5 * step, 5 * step + 4))
        prints.add(chain)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = components(prints)
    for cell_rows in (8192, 20):
        links = simhash.near_links(spark.createDataFrame(signed, "fp BIGINT"), cell_rows=cell_rows).collect()
        place = {s[0]: i for i, s in enumerate(signed)}
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in links:
            x, y = sorted((find(place[a]), find(place[b])))
            root[y] = x
        assert [find(i) for i in range(len(prints))] == want


def test_popcounts_bound_the_distance():
    rng = np.random.default_rng(1)
    for a, b in rng.integers(0, 1 << 63, (200, 2)).tolist():
        counts = [[bin(x >> 2 * i & 3).count("1") for i in range(32)] for x in (a, b)]
        assert sum(abs(p - q) for p, q in zip(*counts)) <= bin(a ^ b).count("1")


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.components(docs)
    assert got.count() == docs.count()
    found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    # null, empty and blank texts share the fingerprint zero; a null id belongs to its copies
    assert (found[2], found[3], found[4], found[1], found[None]) == (2, 2, 2, 1, 1)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 5, 6, 7]
    assert simhash.components(docs.limit(0)).count() == 0
    assert rows(simhash.deduplicate(docs.limit(0))) == []


def test_deduplicate_with_and_without_files(spark, tmp_path):
    """Rows read from files, computed rows and rows repeated by a join all lose their copies only."""
    from pyspark.sql import functions as F
    docs = awkward(spark)
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    twice = read.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    kept = [sorted(r["doc_id"] for r in simhash.deduplicate(t).collect()) for t in (docs, read, twice)]
    assert kept == [[1, 2, 5, 6, 7]] * 3
