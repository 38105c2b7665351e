import hashlib

from pyspark.sql import functions as F

from nuggetry.llm import queries, warc

from .helpers import SF, rows


def record(url, html):
    body = (html or "").encode()
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: " + (url or "").encode() + b"\r\nContent-Type: text/html\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_query_against_all_records(spark):
    files, want = {}, set()
    pages = sorted(spark.read.parquet(f"{SF}/pages.parquet").collect(), key=lambda r: r.page_id)
    for r in pages:
        name = "part-" + hashlib.md5(str(r.page_id).encode()).hexdigest()[:2]
        at, data, mark = files.get(name, 0), record(r.url, r.html), int(hashlib.md5(str(r.page_id).encode()).hexdigest()[:8], 16)
        files[name] = at + len(data)
        ours = hashlib.sha256(data).hexdigest()
        rotten = hashlib.sha256(record(r.url, r.html[:-1] + "\x01")).hexdigest()
        if mark % 101 == 1:
            want.add((name, at, r.page_id, ours, None, "missing"))
        elif mark % 97 == 0:
            want.add((name, at, r.page_id, ours, rotten, "altered"))
    got = {(r["file"], r["offset"], r["page_id"], r["expected"], r["found"], r["fault"]) for r in rows(queries.op4_warc(spark, SF))}
    assert got == want and want


def big(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("page_id"), F.lit("http://h").alias("url"), F.concat(F.repeat(F.lit("x"), 900), F.col("id").cast("string")).alias("html"))


def test_levels_above_ranges_find_every_fault(spark):
    ours = warc.records(big(spark), 2).withColumn("file", F.lit("one"))
    from pyspark.sql import Window

    ours = ours.withColumn("offset", F.sum("length").over(Window.orderBy("page_id")) - F.col("length"))  # 3 MB: more ranges than a node holds
    theirs = ours.where("page_id <> 17").withColumn("digest", F.when(F.col("page_id") == 2900, "rot").otherwise(F.col("digest")))
    theirs = theirs.unionByName(ours.where("page_id = 5").withColumn("offset", F.lit(1)).withColumn("page_id", F.lit(-1)))
    trace = []
    got = {(r["page_id"], r["fault"]) for r in rows(warc.audit(ours, theirs, trace))}
    # A root, its four nodes or less, then only the ranges below open nodes and their records.
    assert [x[1] for x in trace] == [1, 2, 2, 3] and trace[2][0] <= 32 and trace[3][0] <= 2 * 70
    assert got == {(17, "missing"), (2900, "altered"), (-1, "extra")}
    assert warc.audit(ours, ours).count() == 0


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "x"), (2, "", ""), (3, "v", "y" * 300_000)], "page_id long, url string, html string")
    recs = warc.records(pages.withColumn("file", F.lit("clash")).withColumn("Offset", F.lit(1)))
    got = rows(recs)
    assert len(got) == 5 and all(r["length"] > 0 for r in got)
    twins = sorted(r["offset"] for r in got if r["page_id"] == 1)
    assert twins[1] - twins[0] == len(record("u", None))
    assert warc.audit(recs, recs.limit(0)).count() == 5 and warc.audit(recs.limit(0), recs.limit(0)).count() == 0
    assert warc.audit_drill(pages.limit(0)).count() == 0


def test_files_follow_one_rule_in_sql_too(spark, monkeypatch):
    """With fewer pages to a file, names have more digits, in the query and in its SQL."""
    import duckdb

    monkeypatch.setattr(warc, "PAGES_PER_FILE", 0.05)
    got = rows(queries.op4_warc(spark, SF))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = db.sql(queries.OP4_SQL.replace("1000.0", "0.05")).df()
    assert {(r["file"], r["offset"], r["fault"]) for r in got} == set(zip(want["file"], want["offset"], want["fault"])) and len(got[0]["file"]) == 8


def test_stored_archives_are_read_and_audited(spark, tmp_path):
    pages = [("http://a/%d" % i, "body é %d" % i * (i % 7)) for i in range(40)]
    for side in ("one", "two"):
        (tmp_path / side).mkdir()
        for f in range(4):
            data = b"".join(record(u, h + ("!" if side == "two" and u.endswith("/13") else "")) for u, h in pages[f::4])
            (tmp_path / side / f"part-{f}.warc").write_bytes(data[:-10] if side == "two" and f == 3 else data)
    ours, theirs = (warc.stored_records(spark, f"file://{tmp_path}/{side}") for side in ("one", "two"))
    assert ours.count() == 40 and {r["uri"] for r in rows(ours)} == {u for u, _ in pages}
    at = sum(len(record(u, h)) for u, h in pages[1::4][:3])
    got = {(r["file"], r["offset"], r["fault"]) for r in rows(warc.audit(ours, theirs))}
    rest = {(f"part-1.warc", at, "altered")} | {x for x in got if x[0] == "part-1.warc" and x[1] > at}
    assert {x for x in got if x[0] == "part-1.warc"} == rest and {x[0] for x in got} == {"part-1.warc", "part-3.warc"}
    assert [x[2] for x in got if x[0] == "part-3.warc"] == ["altered"]


def test_repeated_offsets_do_not_multiply(spark):
    recs = spark.createDataFrame([("f", 0, 5, i, "d") for i in range(6)] + [("f", 9, 5, 7, "e")], "file string, offset long, length long, page_id long, digest string")
    assert warc.audit(recs, recs).count() == 0
    assert [r["fault"] for r in rows(warc.audit(recs, recs.where("page_id <> 3")))] == ["missing"]


def test_rows_without_an_id_are_dealt_by_url(spark):
    pages = spark.range(400).select(F.when(F.col("id") < 50, F.col("id")).alias("page_id"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.lit("x").alias("html"))
    files = rows(warc.records(pages, 2).where("page_id IS NULL").groupBy("file").count())
    assert len(files) > 100 and sum(r["count"] for r in files) == 350


def test_broken_heads_hide_only_their_own_record(spark, tmp_path):
    good = [record(f"http://a/{i}", f"body {i}") for i in range(3)]
    head = b"WARC/1.0\r\nWARC-Target-URI: http://bad\r\nContent-Length: %s\r\n\r\nxyz\r\n\r\n"
    for size in (b"abc", b"-37", b"-462", b"", b"+3", b"9" * 30, "\u0663".encode()):
        bad = head % size
        data = good[0] + bad + good[1] + good[2]
        got = list(warc.parse(data))
        assert [data[a:b] for a, b, _ in got] == [good[0], bad, good[1], good[2]] and [u for *_, u in got] == ["http://a/0", "http://bad", "http://a/1", "http://a/2"]
    low = good[0].replace(b"Content-Length", b"content-length").replace(b"WARC-Target-URI", b"warc-target-uri")
    assert [u for *_, u in warc.parse(low + good[1])] == ["http://a/0", "http://a/1"]
    for odd in (b"", b"x", b"WARC/", b"WARC/1.0\r\n\r\n", good[0][:-9], b"\r\n\r\n" * 9, good[0] + b"junk" + good[1], head % b"99999"):
        got = list(warc.parse(odd))
        assert b"".join(odd[a:b] for a, b, _ in got) == odd and all(a < b for a, b, _ in got)
    (tmp_path / "f.warc").write_bytes(good[0] + head % b"abc" + good[1])
    assert [r["uri"] for r in rows(warc.stored_records(spark, f"file://{tmp_path}/f.warc").orderBy("offset"))] == ["http://a/0", "http://bad", "http://a/1"]
