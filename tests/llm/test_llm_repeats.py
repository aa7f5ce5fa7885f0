import hashlib
import random

import pytest
from llm_tables import awkward, docs_of

from kerbside.llm import repeats


def brute(texts, window):
    seen, out = set(), []
    for doc, text in texts:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def texts(kind):
    draw = random.Random(kind)
    if kind == "few words":       # many runs and chance repeats
        return [" ".join(draw.choice("ab") for _ in range(draw.randint(0, 90))) for _ in range(25)]
    if kind == "one word":        # runs longer than any window
        return [" ".join(["a"] * n) for n in (3, 19, 20, 21, 50, 33)] + ["b " + " ".join(["a"] * 40) + " c"]
    passage = " ".join(f"p{i}" for i in range(60))
    out = []
    for _ in range(40):           # shared passages at every offset, whole copies, edited copies
        own = [f"w{draw.randint(0, 10**6)}" for _ in range(draw.randint(0, 60))]
        cut = draw.randint(0, 40)
        part = passage.split()[cut:cut + draw.choice([10, 19, 20, 21, 45])]
        at = draw.randint(0, len(own))
        out.append(" ".join(own[:at] + part + own[at:]))
    return out + out[:5] + [out[6] + " x", "x " + out[7]]


@pytest.mark.parametrize("kind", ["few words", "one word", "passages"])
def test_equals_brute_force(spark, kind):
    case = texts(kind)
    for window in (20,) if kind != "few words" else (20, 6):
        got = repeats.report(docs_of(spark, case).repartition(3), window)
        assert sorted(map(tuple, got.collect())) == brute(enumerate(case), window)


def test_busy_anchors(spark, monkeypatch):
    """Stretches of frequent anchors skip the comparison of stretches in some tasks and not in others."""
    monkeypatch.setattr(repeats, "_BUSY_ROWS", 2)
    for kind in ("few words", "passages"):
        case = texts(kind)
        got = repeats.report(docs_of(spark, case).repartition(3), 6)
        assert sorted(map(tuple, got.collect())) == brute(enumerate(case), 6)


def test_kept_texts(spark):
    case = texts("passages")
    kept = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs_of(spark, case, windows=1)).collect()}
    for (doc, _, removed, digest), text in zip(brute(enumerate(case), 20), case):
        assert hashlib.sha256(b" ".join(kept[doc].encode().split())).hexdigest() == digest
        assert removed or kept[doc] == text


def test_awkward_rows(spark):
    got = repeats.report(awkward(spark))
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got.collect()}
    assert rows == {1: (13, 0), 2: (0, 0), 3: (0, 0), None: (13, 0), 4: (0, 0), 5: (30_000, 29_999), 6: (3, 0), 7: (4, 0)}
    assert got.count() == 9 and repeats.report(awkward(spark).limit(0)).count() == 0
    assert repeats.remove_repeats(awkward(spark)).columns == awkward(spark).columns


def test_rows_of_one_id_and_other_ids(spark):
    """Rows of one id are documents of their own; ids may be missing, repeated or texts."""
    a, z, own = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 30), ("z", 50), ("o", 40)))
    table = [(7, a), (7, z), (3, own), (None, a + " end"), (None, own), (9, z + " x"), (7, a)]
    for kind in ("BIGINT", "STRING"):
        ids = [(None if i is None else i if kind == "BIGINT" else str(i), t) for i, t in table]
        df = spark.createDataFrame(ids, f"doc_id {kind}, text STRING").repartition(3)
        got = {}
        for r in repeats.report(df).collect():
            got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
        seven, three, nine = (7, 3, 9) if kind == "BIGINT" else ("7", "3", "9")
        # the null rows come first, so theirs are the first occurrences
        assert sorted(got[None]) == [(31, 0), (40, 0)] and got[three] == [(40, 40)]
        assert sorted(got[seven]) == [(30, 30), (30, 30), (50, 0)] and got[nine] == [(51, 50)]
        assert sorted(r["text"] or "" for r in repeats.remove_repeats(df).where("doc_id = '7'").collect()) == ["", "", z]
