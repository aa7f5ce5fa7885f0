import hashlib

from conftest import TESTDATA
from llm_tables import rows
from pyspark.sql import functions as F

from kerbside.llm import warc
from kerbside.session import scratch_path


def pages(spark):
    return spark.read.parquet(f"{TESTDATA.replace('0.001', '0.01')}/pages.parquet")


def test_round_trip(spark):
    path = scratch_path(spark, "warc-test")
    df = pages(spark)
    warc.write_warc(df, path, shard_bytes=100_000)
    back = warc.read_records(spark, path).toPandas()
    want = {f"<urn:page:{r['page_id']}>": r["html"].encode() for r in df.collect()}
    assert {r.record_id: bytes(r.payload) for r in back.itertuples()} == want and back["shard"].nunique() > 3
    leaves = warc.read_leaves(spark, path).orderBy("shard", "offset").toPandas()
    for _, shard in leaves.groupby("shard"):  # ranges adjoin
        assert shard["offset"].tolist() == [0, *shard["length"].cumsum().tolist()[:-1]]


def test_audit_finds_exactly_the_damage(spark):
    first, same, second = (scratch_path(spark, f"warc-{k}") for k in range(3))
    df = pages(spark)
    warc.write_warc(df, first, shard_bytes=100_000)
    warc.copy_replica(spark, first, same)
    assert warc.audit(spark, first, same).count() == 0

    def damage(record_id, data):
        kind = int(hashlib.md5(record_id.encode()).hexdigest(), 16) % 10
        return data[:-5] + bytes([data[-5] ^ 1]) + data[-4:] if kind == 0 else bytes(len(data)) if kind == 1 else data

    warc.copy_replica(spark, first, second, damage)
    found = {r["record_id"]: r["status"] for r in warc.audit(spark, first, second).collect()}
    kinds = {f"<urn:page:{r['page_id']}>": int(hashlib.md5(f"<urn:page:{r['page_id']}>".encode()).hexdigest(), 16) % 10
             for r in df.select("page_id").collect()}
    assert found == {k: "changed" if v == 0 else "unreadable" for k, v in kinds.items() if v in (0, 1)}


def test_tree_names_only_nodes_above_a_difference(spark):
    leaves = spark.range(5000).select(
        (F.col("id") % 3).alias("shard"), F.col("id") .alias("n"), (F.floor(F.col("id") / 3) * 70_000).alias("offset"),
        F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    other = leaves.withColumn("hash", F.when(F.col("n") == 1234, F.lit("x")).otherwise(F.col("hash")))
    for a, b in zip(warc.merkle_tree(leaves, 3), warc.merkle_tree(other, 3)):
        assert a.join(b, ["node", "hash"], "left_anti").count() == 1
    assert a.count() == 1


def test_awkward_rows(spark):
    df = spark.createDataFrame(
        [(1, "u v\n", "a\r\n\r\nWARC/1.1\r\nb"), (1, "u v\n", "a\r\n\r\nWARC/1.1\r\nb"), (2, None, None), (None, "x", ""), (3, "y", "é" * 50_000)],
        "page_id BIGINT, url STRING, html STRING").withColumns({c: F.lit(1) for c in ("shard", "value", "offset", "node")})
    path = scratch_path(spark, "warc-odd")
    warc.write_warc(df, path, shard_bytes=1000)
    got = sorted((r["record_id"], bytes(r["payload"]).decode()) for r in warc.read_records(spark, path).collect())
    text = "a\r\n\r\nWARC/1.1\r\nb"
    assert got == sorted([("<urn:page:1>", text), ("<urn:page:1>", text), ("<urn:page:2>", ""), ("<urn:page:>", ""), ("<urn:page:3>", "é" * 50_000)])
    assert rows(warc.trial(df.limit(0))) == []


def _plain_shards(spark, path, shards):
    """Write the records (id, payload) or other bytes of each shard."""
    def record(page, body):
        return f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    texts = ["".join(p if isinstance(p, str) else record(*p) for p in parts) for parts in shards]
    spark.createDataFrame([(k, t[:-4]) for k, t in enumerate(texts)], "shard BIGINT, value STRING").write.partitionBy(
        "shard").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    return [len(record(*p)) for p in shards[0] if not isinstance(p, str)]


def _found(spark, first, second):
    paths = [scratch_path(spark, f"warc-shift-{k}") for k in range(2)]
    sizes = _plain_shards(spark, paths[0], first)
    _plain_shards(spark, paths[1], second)
    rows = warc.audit(spark, *paths).collect()
    return sizes, sorted((r["shard"], r["offset"], r["status"], (r["record_id"] or "-").removeprefix("<urn:page:").removesuffix(">")) for r in rows)


def test_neighbouring_destroyed_records_are_unreadable_each(spark):
    records = [(k, chr(97 + k) * (900 * k + 10)) for k in range(8)]
    sizes, _ = _found(spark, [records], [records])
    starts = [sum(sizes[:k]) for k in range(8)]
    zeroed = [*records[:2], "\0" * sum(sizes[2:5]), *records[5:]]
    assert _found(spark, [records], [zeroed])[1] == [(0, starts[k], "unreadable", str(k)) for k in (2, 3, 4)]
    # the middle one of three survives
    islands = [*records[:2], "\0" * sizes[2], records[3], "\0" * sizes[4], *records[5:]]
    assert _found(spark, [records], [islands])[1] == [(0, starts[k], "unreadable", str(k)) for k in (2, 4)]
    # all of a shard is gone, another is as it was
    assert _found(spark, [records, records], [["\0" * sum(sizes)], records])[1] == [
        (0, a, "unreadable", str(k)) for k, a in enumerate(starts)]


def test_lost_and_added_records_do_not_damage_others(spark):
    records = [(k, chr(97 + k % 26) * (9000 + 700 * k)) for k in range(40)]  # several lowest nodes
    sizes, _ = _found(spark, [records], [records])
    starts = [sum(sizes[:k]) for k in range(40)]
    lost = records[:7] + records[8:]
    assert _found(spark, [records], [lost])[1] == sorted(
        [(0, starts[7], "missing", "7"), *[(0, starts[k], "moved", str(k)) for k in range(8, 40)]])
    more = records[:30] + [("new", "n" * 500)] + records[30:]
    assert _found(spark, [records], [more])[1] == sorted(
        [(0, starts[30], "extra", "new"), *[(0, starts[k], "moved", str(k)) for k in range(30, 40)]])
    # behind a lost record one is changed, two are destroyed, one has another id
    mixed = lost[:10] + [(11, "?" * 9), lost[11], "\0" * (sizes[13] + sizes[14]), lost[14], ("x", records[16][1])] + lost[16:]
    got = {r[3]: r[2] for r in _found(spark, [records], [mixed])[1]}
    want = {str(k): "moved" for k in range(8, 40)}
    want |= {"7": "missing", "11": "changed", "13": "unreadable", "14": "unreadable", "16": "changed"}
    assert got == want


def test_repeated_and_swapped_records(spark):
    same = (5, "same" * 100)
    records = [(1, "one"), same, same, same, (2, "two")]
    sizes, _ = _found(spark, [records], [records])
    fewer = [(1, "one"), same, same, (2, "two")]
    assert [r[2:] for r in _found(spark, [records], [fewer])[1]] == [("missing", "5"), ("moved", "2")]
    swapped = [(2, "two"), same, same, same, (1, "one")]
    assert [r[2:] for r in _found(spark, [records], [swapped])[1]] == [("moved", "1"), ("moved", "2")]
    assert [r[2:] for r in _found(spark, [records, records], [records])[1]] == [("missing", r) for r in "15552"]
    assert [r[2:] for r in _found(spark, [records], [records, records])[1]] == [("extra", r) for r in "15552"]
