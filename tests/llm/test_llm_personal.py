import hashlib
import re

from llm_tables import awkward, docs_of

from kerbside.llm import personal


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) % 10 + int(c) // 5 for i, c in enumerate(reversed(digits))) % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]
TEXTS = [
    "é\U0001f600 mail a.b+c@x-y.co.uk, not a@b or @c.d; x@y.z@q.w",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.002.3.255 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 378282246310005 0000000000000",
    "+1 (302) 555-0175. +44 20 7946 0958 +1 2 +123456789012345678 ++1234567890-",
    "9" * 20_000 + " " + "1-2 " * 5_000,
    "z" * 50_000 + " last@mail.example 4532015112830366",
    "plain words, none of them private",
]


def brute(text):
    spans = sorted(
        (m.start(), k, m.end(), kind) for k, (kind, pattern, check) in enumerate(BASE)
        for m in re.finditer(pattern, text or "") if check(m.group()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def test_base_spans_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in personal.report(docs_of(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert got[i]["spans"] == want
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in personal.KINDS] == [want.count(f"{k}:") for k in personal.KINDS]


def test_context_finds_unseen_identifiers(spark):
    seen = [f"Please write to user{i}@mail{i}.example soon" for i in range(12)]
    new = ["Please write to jane99#corp-internal soon", "Please write to them soon"]
    other = [f"the year of {1900 + i} was fine" for i in range(40)] + ["the year of 12345678"]
    mixed = [f"call code {i}77777" for i in range(6)] + [f"call code a{i}@b.example" for i in range(6)]  # half right only
    got = {r["doc_id"]: r["spans"] for r in personal.report(docs_of(spark, [*seen, *new, *other, *mixed])).collect()}
    assert all(got[i].startswith("email:16:") for i in range(12))
    assert got[12] == "" or got[12] == "context:16:36"
    assert got[13] == ""
    assert all("context" not in s for k, s in got.items() if k != 12)


def test_reliable_pattern_brings_in_tokens(spark):
    texts = [f"badge number {n}{i}@staff.example" for i, n in enumerate("abcdefghijkl" * 4)] + ["Badge  number QX-10457 expired", "number QX-10457"]
    got = {r["doc_id"]: r["spans"] for r in personal.report(docs_of(spark, texts)).collect()}
    assert got[48] == "context:14:22" and got[49] == ""


def test_words_before_a_token_may_be_tokens_or_long(spark):
    long = "z" * 100
    texts = [
        "the ids QX-10457, QX-20881 QX-30991", "room 12 code QX-10457", f"see {long} code QX-10457", f"{long} {long} QX-10457",
        "QX-10457 only", "a \t QX-10457\n\nQX-20881", "é\U0001f600 Mail a@b.example or  QX-10457"]
    got = {r["doc_id"]: [tuple(u)[:4] for u in r["tokens"]] for r in personal._scanned(docs_of(spark, texts)).collect()}
    patterns = {k: [u[3] for u in v] for k, v in got.items()}
    assert patterns == {
        0: ["the ids", "ids 0", "0 0"], 1: ["room", "0 code"], 2: [f"{long} code"], 3: [f"{long} {long}"],
        4: [""], 5: ["a", "a 0"], 6: ["é\U0001f600 mail", "0 or"]}
    assert all(texts[k][a:b] == t for k, v in got.items() for a, b, t, _ in v)


def test_spans_are_whole_instances(spark):
    texts = [
        "my phone +1 (487) 555-7209, or (302) 555-0175. now", "the card 4111 1111 1111 1111 and 4111 1111 1111 1112 x9",
        "two at a@b.example,c@d.example (+1 302 555-0175) QX-10457 10.0.0.1", "the ids QX-10457, 20881 30991 4x"]
    got = {r["doc_id"]: [tuple(u)[:5] for u in r["tokens"]] for r in personal._scanned(docs_of(spark, texts)).collect()}
    assert {k: [(t, p, s) for _, _, t, p, s in v] for k, v in got.items()} == {
        0: [("+1 (487) 555-7209", "my phone", 1), ("(302) 555-0175.", "0 or", 0)],
        1: [("4111 1111 1111 1111", "the card", 1), ("4111 1111 1111 1112", "0 and", 0), ("x9", "and 0", 0)],
        2: [("a@b.example", "two at", 1), ("c@d.example", "two at", 1), ("+1 302 555-0175", "at 0", 1),
            ("QX-10457", "0 0", 0), ("10.0.0.1", "0 0", 1)],
        3: [("QX-10457,", "the ids", 0), ("20881 30991", "ids 0", 0), ("4x", "0 0", 0)]}
    assert all(texts[k][a:b] == t for k, v in got.items() for a, b, t, _, _ in v)


def test_phone_contexts_bring_in_phones(spark):
    texts = [f"call me +1 (487) 555-72{i:02}" for i in range(12)] + ["call me (302) 555-0175 soon"]
    got = {r["doc_id"]: r["spans"] for r in personal.report(docs_of(spark, texts)).collect()}
    assert got[0] == "phone:8:25" and got[12] == "context:8:22"


def test_discovered_identifiers_induce_patterns(spark):
    texts = [f"badge number {'abcdefghij'[i % 10]}{i}@staff.example" for i in range(100)]
    texts += [f"badge number QX-1000{i}" for i in range(10)]    # first generation
    texts += [f"locker key QX-1000{i}" for i in range(10)] + ["locker key ZZ-99999"]
    texts += [f"version string {i}00000" for i in range(12)]    # nothing vouches for these
    got = {r["doc_id"]: r["spans"] for r in personal.report(docs_of(spark, texts)).collect()}
    assert all(got[i].startswith("email:13:") and "context" not in got[i] for i in range(100))
    assert {got[i] for i in range(100, 110)} == {"context:13:21"}
    assert {got[i] for i in range(110, 121)} == {"context:11:19"}
    assert {got[i] for i in range(121, 133)} == {""}


def test_adjacent_identifiers_are_found(spark):
    texts = [f"ids {n}{i}@staff.example, {n}{i + 50}@staff.example" for i, n in enumerate("abcdefghijkl")]
    texts = [f"the {t}" for t in texts] + ["the ids QX-10457, QX-20881"]
    got = {r["doc_id"]: r["spans"] for r in personal.report(docs_of(spark, texts)).collect()}
    assert got[12] == "context:8:17,context:18:26"


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = personal.report(docs)
    assert got.count() == docs.count() and {r["spans"] for r in got.collect()} == {""}
    assert personal.report(docs.limit(0)).count() == 0
    plan = personal.find(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
