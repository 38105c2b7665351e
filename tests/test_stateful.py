import random

import numpy as np
from pyspark.sql import functions as F

from nuggetry.operators import bootstrap, clusters, cosine, matching, memory, ranking, similarity
from nuggetry.plans import queries
from nuggetry.sources.work import fresh, settle
from nuggetry.streaming import index
from nuggetry.streaming import memory as streaming


def loop(rows, threshold=0.72):
    made, out = [], []
    for domain, seq, text, _, conf in sorted(rows, key=lambda r: r[1]):
        t, best, at = set(text.split()), 0.0, None
        for c in made:
            u = t | c["t"]
            sim = len(t & c["t"]) / len(u) if u else 0.0
            if c["domain"] == domain and sim > best:
                best, at = sim, c
        if at and best >= threshold:
            at["n"] += 1
            if conf > at["conf"]:
                at["conf"], at["t"] = conf, t
        else:
            at = {"domain": domain, "t": t, "n": 1, "conf": conf, "id": f"cluster_{domain}_{seq}"}
            made.append(at)
        out.append((seq, at["id"], at["n"]))
    return sorted(out)


def arrivals(n=200):
    rnd = random.Random(9)
    return [(rnd.choice("xy"), i, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 5))), f"s{i}", rnd.random()) for i in range(n)]


SCHEMA = "domain string, seq long, text string, sample_id string, confidence double"


def test_batch_and_stream_agree_with_a_loop(spark):
    rows = arrivals()
    want = loop(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    members = clusters.assign_clusters(df)
    assert sorted((r.seq, r.cluster_id, r.cluster_size) for r in members.collect()) == want
    again = clusters.running_size(members.drop("cluster_size"))
    assert sorted((r.seq, r.cluster_id, r.cluster_size) for r in again.collect()) == want
    stats = clusters.cluster_stats(clusters.clusters(members)).first()
    assert stats.total_assignments == 200 and stats.total_clusters == len({c for _, c, _ in want})
    assert clusters.top_clusters(clusters.clusters(members), 1).first()["size"] == stats.max_cluster_size

    source, out, state = (fresh(spark, n) for n in ("in", "out", "state"))
    for half in (df.where("seq < 100"), df.where("seq >= 100")):  # the state lives on between runs
        half.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        streaming.append_incrementally(streaming.stream_clusters(stream), out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.seq, r.cluster_id, r.cluster_size) for r in got.collect()) == want


def test_stream_windows_equal_the_closed_batch_windows(spark):
    d = "/root/testdata/sf0.001"
    batch = {r.window_start: r.n for r in queries.rolling_approval(spark, d).collect()}
    stream = {r.window_start: r.n for r in queries.stream_decisions(spark, d).collect()}
    assert stream and all(batch[k] == n for k, n in stream.items()) and len(batch) - len(stream) <= 2


def test_similarity_join_is_complete(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 7))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set(t.split()) for t in texts]
    for threshold, strict in ((0.4, True), (0.5, False), (0.05, True)):
        got = {(r.left_id, r.right_id) for r in similarity.similar_pairs(df, df, threshold, strict).collect()}
        sim = lambda a, b: len(a & b) / len(a | b) if a | b else 0
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and (sim(a, b) > threshold if strict else sim(a, b) >= threshold)}
        assert got == want


def test_a_set_goes_to_a_cell_once(spark):
    """Two tables that share some sets, of 1 to 700 tokens: all pairs are found, and what moves is a few rows a set, not one for
    each token of its prefix."""
    rnd = random.Random(6)
    sets = [{f"w{rnd.randint(0, 2000)}" for _ in range(rnd.choice((1, 3, 20, 90, 300, 700)))} for _ in range(40)]
    sets += [set(sorted(s)[: max(1, int(len(s) * rnd.choice((0.42, 0.6, 0.8, 0.97))))]) for s in sets]
    rows = [(i, " ".join(sorted(s))) for i, s in enumerate(sets)]
    a, b = (spark.createDataFrame(x, "id long, text string") for x in (rows[:60], rows[20:]))
    for threshold in (0.4, 0.75):
        got = {(r.left_id, r.right_id) for r in similarity.similar_pairs(a, b, threshold).collect()}
        assert got == {(i, j) for i, _ in rows[:60] for j, _ in rows[20:] if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > threshold}
    keyed = similarity.sets_once(similarity.keyed_sets(a)).withColumn("side", F.lit(3))
    order = similarity.magnitudes_of(similarity.token_counts(keyed))
    cells = keyed.mapInArrow(similarity._cell_rows(order, 0.55, 4), similarity._CELL)
    assert cells.count() <= 2 * 4 * keyed.count()


def test_similar_sets_within_blocks(spark):
    """Texts of different blocks share no token, and equal sets are one node."""
    rnd = random.Random(4)
    rows = [(i, f"b{rnd.randint(0, 3)}", " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, domain string, text string")
    for threshold in (0.5,):
        got = {}
        for r in clusters.similar_parts(settle(df), threshold).collect():
            got.setdefault(r.part and bytes(r.part), set()).add(r.seq)
        sets, parent = {i: set(t.split()) for i, _, t in rows}, {i: i for i, _, _ in rows}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, a, _ in rows:
            for j, b, _ in rows:
                if i < j and a == b and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                    parent[find(i)] = find(j)
        want = {}
        for i in sets:
            want.setdefault(find(i) if sets[i] else None, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_clusters_by_component_equal_the_sequence(spark):
    """Chains of texts, of which only neighbours are similar, and centroids that move along them."""
    words = [f"w{i}" for i in range(60)]
    rnd = random.Random(8)
    rows = [("d", i, " ".join(words[a : a + 9]), f"s{i}", rnd.random()) for i, a in enumerate(rnd.randint(0, 50) for _ in range(200))]
    df = spark.createDataFrame(rows, "domain string, seq long, text string, sample_id string, confidence double")
    loop = clusters.Clusters("d")
    want = {(i, *loop.assign(i, t, c)) for _, i, t, _, c in rows}
    assert {(r.seq, r.cluster_id, r.cluster_size) for r in clusters.assign_clusters(df.repartition(3)).collect()} == want


def test_approval_as_of_against_a_loop(spark):
    rnd = random.Random(9)
    texts = ["dark mode please now", "dark mode please now thanks", "add undo", "add undo key", "", "other words here"]
    day = 86400
    log = [(i, rnd.choice(texts), rnd.choice(["accept", "reject"]), rnd.randint(0, 400) * day // 2) for i in range(300)] + [(300, texts[0], "accept", None)]
    asked = [(i, rnd.choice(texts), rnd.randint(0, 450) * day // 2) for i in range(120)] + [(120, texts[0], None)]
    d = spark.createDataFrame(log, "decision_id long, text string, decision string, s long").withColumn("ts", F.timestamp_seconds("s"))
    s = spark.createDataFrame(asked, "id long, text string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.past_approval_rate for r in memory.approval_as_of(s, d, days=30).collect()}
    for i, t, at in asked:
        a = set(t.split())
        near = [x for _, u, x, s_ in log if a and s_ is not None and at is not None and at - 30 * day <= s_ < at and len(a & set(u.split())) / len(a | set(u.split())) > 0.55]
        assert abs(got[i] - (near.count("accept") / len(near) if near else 0.5)) <= 0.0005 + 1e-9


def test_forms_by_descent_equal_all_forms(spark):
    rnd = random.Random(11)
    text = lambda: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 8)))
    asked, known = [(i, text()) for i in range(40)], [(text(),) for _ in range(80)]
    short = known[:20] + [("a b c",)]
    a, k, sh = spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame(known, "text string"), spark.createDataFrame(short, "text string")
    sim = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))

    def want(pool):
        return {(i, t, round(s, 12), n) for i, x in asked for n, (s, t) in enumerate(sorted({(-sim(x, t), t) for t in pool if sim(x, t) > 0})[:3], 1) for s in [-s]}

    got = lambda df: {(r.id, r.canonical_text, round(r.similarity, 12), r.pos) for r in df.collect()}
    assert got(memory.long_term_forms(a, k)) == want({t for t, in known})
    both = {(i, t) for i, x in asked for t, in short if sim(x, t) > 0.4}
    mixed = {(i, t, round(s, 12), n) for i, x in asked for n, (s, t) in enumerate(sorted({(-sim(x, t), t) for t in {t for t, in known} | {t for j, t in both if j == i} if sim(x, t) > 0})[:3], 1) for s in [-s]}
    assert got(memory.forms_of_both_stores(a, sh, k)) == mixed


def test_the_first_similar_pattern_decides(spark):
    known = spark.createDataFrame([("please add dark mode now", 1, 0.0, 1), ("please add dark mode soon", 3, 0.06, 2)], "pattern string, domain_count int, cross_domain_boost double, seq int")
    asked = spark.createDataFrame([(1, "please add dark mode"), (2, "please add dark mode soon")], "id long, text string")
    assert {r.id: (r.cross_domain, r.cross_domain_boost) for r in memory.cross_domain(asked, known).collect()} == {1: (False, 0.0), 2: (True, 0.06)}
    assert {r.id: r.cross_domain for r in memory.cross_domain(asked, known.withColumn("seq", -F.col("seq"))).collect()} == {1: True, 2: True}


def test_canonical_groups_merge_chains(spark):
    rows = [("s", "add a dark mode now"), ("s", "add a dark mode now please"), ("s", "Add a dark mode now please thanks"), ("s", "fix it"), ("t", "add a dark mode now"), ("t", ""), ("t", None), ("s", "now add a dark mode")]
    df = spark.createDataFrame([(a, t, 0.5, ["text"]) for a, t in rows], "sample_id string, text string, confidence double, supporting_modalities array<string>")
    got = {(r.sample_id, r.canonical_text): (r.frequency, r.n_merged) for r in ranking.canonical_groups(df, 0.7).collect()}
    assert got[("s", "add a dark mode now")] == (4, 4) and got[("s", "fix it")] == (1, 1) and got[("t", "add a dark mode now")] == (1, 1)
    assert sum(f for f, _ in got.values()) == 8


def _state_rows(spark, state, name):
    return spark.read.format("statestore").option("stateVarName", name).load(state).collect()


def test_state_expires_and_streams_equal_batches(spark):
    """Three runs of a stream against the loop over all rows; what is older than the days is gone from the state."""
    day = 86400
    rnd = random.Random(12)
    rows = [(i, f"text {rnd.randint(0, 4)}", rnd.choice(["accept", "reject"]), i * day // 4) for i in range(160)]
    df = spark.createDataFrame(rows, "decision_id long, text string, decision string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1))
    source, out, state = (fresh(spark, n) for n in ("in", "out", "state"))
    for part in (df.where("s < 10 * 86400"), df.where("s >= 10 * 86400 AND s < 30 * 86400"), df.where("s >= 30 * 86400")):
        part.coalesce(1).write.mode("append").parquet(source)
        streaming.append_incrementally(streaming.stream_approval(spark.readStream.schema(df.schema).parquet(source), 5), out, state).awaitTermination()
    got = {r.decision_id: r.past_approval_rate for r in spark.read.parquet(out).collect()}
    for i, t, _, at in rows:
        near = [x for _, u, x, s_ in rows if u == t and at - 5 * day <= s_ < at]
        assert abs(got[i] - (near.count("accept") / len(near) if near else 0.5)) <= 0.0005 + 1e-9
    assert len(_state_rows(spark, state, "decisions")) < 100


def test_clusters_on_a_stream_are_kept_for_some_days(spark):
    day, rnd = 86400, random.Random(13)
    rows = [("d", i, " ".join(rnd.choice("abcdef") for _ in range(4)), f"s{i}", rnd.random(), i * day // 5) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA + ", s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1))
    one = clusters.Clusters("d", keep=2 * day * 1_000_000)
    want = sorted((i, *one.assign(i, t, c, s * 1_000_000)) for _, i, t, _, c, s in rows)
    assert len(set(x[1] for x in want)) > len({c for _, c, _ in loop([r[:5] for r in rows])})  # some were founded anew
    batch = clusters.assign_clusters(df, keep_days=2)
    assert sorted((r.seq, r.cluster_id, r.cluster_size) for r in batch.collect()) == want
    source, out, state = (fresh(spark, n) for n in ("in", "out", "state"))
    for part in (df.where("seq < 70"), df.where("seq >= 70 AND seq < 120"), df.where("seq >= 120")):
        part.coalesce(1).write.mode("append").parquet(source)
        streaming.append_incrementally(streaming.stream_clusters(spark.readStream.schema(df.schema).parquet(source), keep_days=2), out, state).awaitTermination()
    assert sorted((r.seq, r.cluster_id, r.cluster_size) for r in spark.read.parquet(out).collect()) == want
    assert len(_state_rows(spark, state, "clusters")) < len({c for _, c, _ in want})


def test_three_batches_through_the_index_equal_one_join(spark):
    rnd = random.Random(21)
    rows = [(i, " ".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 8)))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, text string")
    source, out, state, at = (fresh(spark, n) for n in ("in", "out", "state", "index"))
    found = index.SimilarityIndex(spark, at, 0.5)
    for part in (df.where("id < 40"), df.where("id >= 40 AND id < 100"), df.where("id >= 100")):
        part.coalesce(1).write.mode("append").parquet(source)
        index.match_stream(spark.readStream.schema(df.schema).parquet(source), found, out, state).awaitTermination()
    pair = lambda a, b, s: (min(a, b), max(a, b), round(s, 9))
    got = {pair(bytes(r.left_key), bytes(r.right_key), r.similarity) for r in spark.read.parquet(out).collect()}
    keyed = similarity.keyed_sets(df)
    whole = similarity.similar_keys(keyed, keyed, 0.5)
    assert got == {pair(bytes(r.left_key), bytes(r.right_key), r.similarity) for r in whole.collect()}
    # A batch that runs again gives the same and leaves the index as it was; a compacted index answers alike.
    last = settle(keyed.where("id >= 100"))
    n = found.sets().count(), found.postings().count()
    again = {pair(bytes(r.left_key), bytes(r.right_key), r.similarity) for r in found.add(last, 2).collect()}
    assert again == {pair(bytes(r.left_key), bytes(r.right_key), r.similarity) for r in spark.read.parquet(f"{out}/batch=2").collect()} and n == (found.sets().count(), found.postings().count())
    more = similarity.keyed_sets(spark.createDataFrame([(1, "a b c d"), (2, "k l")], "id long, text string"))
    small, big = found.compacted(fresh(spark, "index")).add(more, 3).collect(), found.add(more, 3).collect()
    assert sorted(map(str, small)) == sorted(map(str, big)) and small


def test_cosine_topk_against_all_pairs(spark):
    """Around a few directions, so that bounds rule blocks out; ties, and vectors without a direction."""
    gen = np.random.default_rng(3)
    centres = gen.normal(size=(6, 8))
    v = {i: (centres[i % 6] * gen.uniform(0.5, 3) + 0.05 * gen.normal(size=8)).tolist() for i in range(600)}
    v |= {600 + i: v[5] for i in range(15)} | {700: None, 701: [], 702: [0.0] * 8, 703: [float("nan")] * 8, 704: [1.0] * 7 + [None], 705: [float("inf")] * 8}
    df = spark.createDataFrame(list(v.items()), "id long, vector array<double>")
    trace = []
    out = cosine.cosine_topk(df.where("id % 20 = 0 OR id >= 700"), df, 5, block=20, chunk=10, trace=trace)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.pos, r.id, round(r.cosine, 9)))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v.items() if i < 700}
    assert set(got) == {i for i in range(0, 700, 20) if i in unit}
    for q, found in got.items():
        best = sorted((-round(float(unit[q] @ u), 9), i) for i, u in unit.items() if i != q)[:5]
        assert [c for *_, c in sorted(found)] == [-c for c, _ in best]
    assert trace[0] < trace[1] / 2
    assert cosine.cosine_topk(df.where("id >= 700"), df, 5).count() == 0


def test_draws_of_cells_are_those_of_their_rows(spark):
    """Mean and spread of the number of rows of a cell in a resample are those of Poisson(n); intervals agree with rows."""
    cells = spark.createDataFrame([(f"c{n}", n) for n in (1, 7, 32, 33, 500, 40_000)], "cell string, n long").crossJoin(spark.range(1, 4001).withColumnRenamed("id", "resample"))
    draws = cells.select("cell", "n", bootstrap.cell_draw(F.col("cell"), F.col("n"), F.col("resample")).alias("w"))
    for r in draws.groupBy("n").agg(F.avg("w").alias("mean"), F.var_pop("w").alias("var"), F.min("w").alias("low"), F.skewness("w").alias("skew")).collect():
        assert abs(r["mean"] - r.n) < 5 * (r.n / 4000) ** 0.5 and abs(r["var"] / r.n - 1) < 0.12 and r.low >= 0 and abs(r.skew - r.n**-0.5) < 0.2
    df = spark.range(3000).select("id", (F.col("id") % 3 > 0).alias("gold"), (F.col("id") % 5 > 0).alias("pred"))
    one = bootstrap.interval(bootstrap.f1_statistic(df, "id", "gold", "pred", n=300), "stat").first()
    two = bootstrap.interval(bootstrap.cell_f1(df, "gold", "pred", n=3000), "stat").first()
    assert abs(one["mean"] - two["mean"]) < 0.002 and abs(one.low - two.low) < 0.004 and abs(one.high - two.high) < 0.004
    assert bootstrap.cell_mean(df.limit(0).select(F.lit(1).alias("v")), "v", n=10).count() == 0


def test_greedy_match_against_a_loop(spark):
    rnd = random.Random(5)
    preds = [(g, i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 4)))) for g in range(20) for i in range(6)]
    gold = [(g, i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 4)))) for g in range(20) for i in range(5)]
    want = set()
    for g in range(20):
        taken = set()
        for _, i, p in (x for x in preds if x[0] == g):
            best, at = 0.0, None
            for _, j, t in (x for x in gold if x[0] == g):
                a, b = set(p.split()), set(t.split())
                f = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
                if f > best:
                    best, at = f, j
            if at is not None and best >= 0.5 and at not in taken:
                taken.add(at)
                want.add((g, i, at))
    schema = "grp int, pos int, text string"
    got = matching.greedy_match(spark.createDataFrame(preds, schema), spark.createDataFrame(gold, schema))
    assert {(r.grp, r.p, r.g) for r in got.collect()} == want


def test_memory_edges(spark):
    log = spark.createDataFrame([(i, "dark mode please now", "accept" if i else "reject") for i in range(4)], "decision_id long, text string, decision string")
    s = spark.createDataFrame([(1, "dark mode please now"), (2, "unrelated"), (3, "")], "id long, text string")
    assert {r.id: r.past_approval_rate for r in memory.approval_rate(s, log).collect()} == {1: 0.75, 2: 0.5, 3: 0.5}
    edits = spark.createDataFrame([(1, "dark mode please now", "A"), (2, "now dark mode please", "B")], "edit_id long, original string, corrected string")
    assert {r.id: r.corrected_text for r in memory.corrections(s, edits).collect()} == {1: "A", 2: "unrelated", 3: ""}
    at = spark.createDataFrame([(0.5, "a"), (0.64, "a"), (0.65, "a"), (0.9, "a")], "alignment_score double, domain string").withColumn("dominant_modality", F.lit("text")).withColumn("decision", F.lit("accept"))
    q = spark.createDataFrame([(1, 0.5, "text", "a"), (2, 0.55, "text", "a")], "id long, alignment_score double, dominant_modality string, domain string")
    assert {r.id: r.modal_expected_acceptance for r in memory.expected_acceptance(q, at).collect()} == {1: 0.5, 2: 1.0}
    known = memory.patterns(spark.createDataFrame([("Dark mode please now", d, True) for d in "xyz"], "text string, domain string, accepted boolean"))
    got = {r.id: (r.cross_domain, round(r.cross_domain_boost, 3)) for r in memory.cross_domain(spark.createDataFrame([(1, "dark mode PLEASE now "), (2, "please dark mode now"), (3, "")], "id long, text string"), known).collect()}
    assert got == {1: (True, 0.06), 2: (True, 0.0), 3: (False, 0.0)}
    times = spark.createDataFrame([(d,) for d in (0, 10, 100)], "d int").select(F.timestamp_seconds(F.col("d") * 86400).alias("ts"))
    assert memory.recent(times, 90).count() == 2


def test_short_term_and_patterns_on_a_stream(spark):
    rows = [("Dark mode", "x", True, 60), ("dark mode ", "y", False, 3600), ("Dark mode", "x", True, 7200)]
    df = spark.createDataFrame(rows, "text string, domain string, accepted boolean, s int").withColumn("ts", F.timestamp_seconds("s")).withColumn("decision", F.when(F.col("accepted"), "accept").otherwise("reject")).withColumn("decision_id", F.col("s"))
    source, out, state = (fresh(spark, n) for n in ("in", "out", "state"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    # Every decision counts, a repeated text too; only a row that comes again does not.
    twice = stream.unionByName(stream.where("s = 7200"))
    streaming.append_incrementally(streaming.short_term(twice), out, state).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["Dark mode", "Dark mode", "dark mode "]
    running = streaming.running_patterns(stream).writeStream.format("memory").queryName("patterns").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    got = spark.table("patterns").first()
    assert (got.pattern, got["count"], got.accepted_count, got.domains) == ("dark mode", 3, 2, ["x", "y"])
    assert streaming.running_patterns(df).first()[:] == got[:]


def test_memory_lookup_takes_all_documents_and_edits(spark, tmp_path):
    from nuggetry.plans import queries

    texts = [(1, "make the big app much faster", "en"), (2, "make the big app much faster", "de"), (5, "nothing else like this", "es"), (7, "add a dark mode", "fr")]
    rows = [(i, t, g, f"s{i % 2}", len(t)) for i, t, g in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r for r in queries.memory_lookup(spark, str(tmp_path)).collect()}
    assert {i: r.corrected_text for i, r in got.items()} == {i: t.upper() for i, t, _ in texts}
    assert all(r.is_human_corrected and r.semantic_memory_hit for r in got.values())


def test_forms_from_blocks_equal_all_forms(spark, monkeypatch):
    monkeypatch.setattr(memory, "ASKED", 4)
    rnd = random.Random(31)
    text = lambda: "the of " + " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    asked, known = [(i, text()) for i in range(20)], sorted({text() for _ in range(60)})
    a, k = spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame([(t,) for t in known * 2], "text string")
    sim = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    want = {(i, t, n) for i, x in asked for n, (_, t) in enumerate(sorted((-sim(x, t), t) for t in known)[:3], 1)}
    assert {(r.id, r.canonical_text, r.pos) for r in memory.nearest_forms(memory.keyed_sets(a), k, 3, 0.0).collect()} == want


def test_decisions_of_a_stretch_are_one_entry(spark):
    df = spark.createDataFrame([(i, "t", "accept", i) for i in range(200)], "decision_id long, text string, decision string, s long").withColumn("ts", F.timestamp_seconds("s"))
    source, out, state = (fresh(spark, n) for n in ("in", "out", "state"))
    df.coalesce(1).write.parquet(source)
    streaming.append_incrementally(streaming.stream_approval(spark.readStream.schema(df.schema).parquet(source), 5), out, state).awaitTermination()
    assert len(_state_rows(spark, state, "decisions")) == 1


def test_unlike_centroids_with_common_tokens_are_ruled_out():
    rnd = random.Random(33)
    one, looked = clusters.Clusters("d"), 0
    for i in range(300):
        tokens = frozenset(rnd.sample([f"w{k}" for k in range(120)], 40))
        looked += len(one._near(tokens))
        one.assign(i, " ".join(tokens), 0.5)
    assert looked < 300


def test_known_patterns_are_not_compared(spark, monkeypatch):
    def never(*_):
        raise AssertionError("compared")

    monkeypatch.setattr(memory, "matched", never)
    known = spark.createDataFrame([("dark mode", 2, 0.03)], "pattern string, domain_count int, cross_domain_boost double")
    got = memory.cross_domain(spark.createDataFrame([(1, "Dark mode ")], "id long, text string"), known).first()
    assert got.cross_domain and got.cross_domain_boost == 0.03


def test_components_compare_a_few_pairs_of_each_copy(spark, monkeypatch):
    """A group of 60 near copies has 1770 pairs: a few of each set are compared, and its components are those of all pairs."""
    rnd = random.Random(11)
    base = [rnd.getrandbits(62) for _ in range(60)]
    sets = [(bytes([i]), sorted({*base, *(rnd.getrandbits(62) for _ in range(2))})) for i in range(60)]
    sets += [(bytes([100 + i]), sorted(rnd.getrandbits(62) for _ in range(30))) for i in range(5)]
    table, seen = settle(spark.createDataFrame(sets, "key binary, t array<long>")), []
    plain = similarity.compared
    monkeypatch.setattr(similarity, "compared", lambda pairs, *more: seen.append(pairs.count()) or plain(pairs, *more))
    got = {(bytes(r.node)[0], bytes(r.root)[0]) for r in similarity.connected(table, 0.72).collect()}
    assert got == {(i, 0) for i in range(1, 60)} and sum(seen) <= 4 * 60


def test_cells_cut_by_tokens_lose_no_pair(spark, monkeypatch):
    """Cells that are cut by tokens, and whose signatures are made in several rounds, give all pairs; a set has no more rows than its
    parts and the tokens that may be the rarest shared ones ask for."""
    monkeypatch.setattr(similarity, "SLICE", 10)
    monkeypatch.setattr(similarity, "SIGNATURES", 50)
    rnd = random.Random(9)
    sets = [{f"w{int(2000 * rnd.random() ** 3)}" for _ in range(rnd.choice((1, 2, 5, 9, 17, 40, 90, 300, 700)))} for _ in range(45)]
    sets += [set(sorted(s)[: max(1, int(len(s) * rnd.choice((0.42, 0.6, 0.8, 0.97))))]) for s in sets]
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "id long, text string")
    for threshold in (0.4, 0.55, 0.75):
        got = {(r.left_id, r.right_id) for r in similarity.similar_pairs(df, df, threshold).collect()}
        assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a & b) / len(a | b) > threshold}


def test_texts_that_are_asked_for_are_split_once(spark, monkeypatch):
    texts = ["Add a dark mode", "add a dark mode please", "Show prices", "", " show PRICES "]
    s = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    d = spark.createDataFrame([(i, t, "accept") for i, t in enumerate(texts)] + [(9, "add dark mode a", "reject")], "decision_id long, text string, decision string")
    split, plain = [], memory.with_tokens
    monkeypatch.setattr(memory, "with_tokens", lambda df, *more, **named: split.append(df.count()) or plain(df, *more, **named))
    got = {r.id: r.past_approval_rate for r in memory.approval_rate(s, d).collect()}
    assert got == {0: 0.667, 1: 0.667, 2: 1.0, 3: 0.5, 4: 1.0}
    assert split == [len(texts), 2]  # the suggestions, and what they don't hold: the other decision, and the text without a token
