import random

import pytest
from pyspark.sql import functions as F

from nuggetry.operators import evidence, memory, metrics, ml
from nuggetry.plans import fixtures, pipeline
from nuggetry.plans.providers import ModelProvider, RuleProvider, available, best_view, split_sentences
from nuggetry.sources import media, readers, sinks


def test_reviews_become_ranked_suggestions(spark):
    got = pipeline.run(fixtures.reviews(spark)).collect()
    assert {r.sample_id for r in got} <= {"v1", "v2", "v4"} and all(0 <= r.score <= 10 for r in got)
    top = {r.sample_id: r.text for r in got if r["rank"] == 1}
    assert "progress bar" in top["v1"].lower()


@pytest.mark.parametrize("name", ["text_only", "no_switch"])
def test_ablations_run(spark, name):
    full = {(r.sample_id, r.canonical_text) for r in pipeline.run(fixtures.reviews(spark), pipeline.ablation(name)).collect()}
    assert full


def test_sentences_and_offsets(spark):
    r = spark.createDataFrame([("a", "One two. One two! Three"), ("b", ""), ("c", None)], "sample_id string, raw_text string")
    got = [(x.sample_id, x.idx, x.text, x.start, x.end) for x in split_sentences(r).orderBy("sample_id", "idx").collect()]
    assert got == [("a", 0, "One two.", 0, 8), ("a", 1, "One two!", 9, 17), ("a", 2, "Three", 18, 23)]
    kinds = {x.text: x.span_confidence for x in RuleProvider().sentences(spark.createDataFrame([("a", "Please add tea. It is broken. Fine day.")], "sample_id string, raw_text string")).collect()}
    assert kinds == {"Please add tea.": 0.9, "It is broken.": 0.6, "Fine day.": 0.4}


def test_segments_and_times(spark):
    t = spark.createDataFrame([("a", "It broke, um again. It broke! … Done")], "sample_id string, transcript string")
    got = [(r.text, r.char_start, r.char_end, r.est_start, r.est_end) for r in evidence.segments(t).orderBy("idx").collect()]
    assert got[0] == ("It broke", 0, 8, 0.0, 0.8) and got[1][0] == "um again" and got[2][:2] == ("It broke", 20) and got[-1][0] == "Done"


def test_fuzzy_find(spark):
    df = spark.createDataFrame([(1, "brown fox", "The brown fox ran"), (2, "fox brown quick", "a quick, brown dog and fox"), (3, "zebra", "no such thing"), (4, None, "x"), (5, "a b c d", "a x")], "i int, q string, t string")
    got = {r.i: (r.s.start, r.s.end) if r.s else None for r in df.select("i", evidence.fuzzy_find("q", "t").alias("s")).collect()}
    assert got == {1: (4, 13), 2: (2, 26), 3: None, 4: None, 5: None}


def test_patterns_inside_earlier_evidence_are_skipped(spark):
    r = spark.createDataFrame([("a", "Please add a button. It is broken and broken again")], "sample_id string, raw_text string")
    s = split_sentences(r).withColumn("span_confidence", F.lit(0.5))
    asked = spark.createDataFrame([("a", "x", "add button"), ("a", "y", "broken thing")], "sample_id string, suggestion_id string, text string")
    found = evidence.keyword_evidence(asked, s)
    rows = evidence.pattern_evidence(asked, r, s, found).collect()
    spans = {(f.suggestion_id, f.start, f.end) for f in found.collect()}
    for p in rows:
        assert not any(i == p.suggestion_id and a <= p.start and b >= p.end for i, a, b in spans)
    image = evidence.image_evidence(asked, spark.createDataFrame([("a", 0, "a red button")], "sample_id string, image_index int, caption string"), spark.createDataFrame([("a", ["Progress Bar"], ["undo"], ["Error Dialog"], True, "broken", 0.8)], "sample_id string, ui_elements_shown array<string>, missing_ui_elements array<string>, error_states_shown array<string>, shows_error boolean, implied_suggestion string, confidence double"))
    kinds = {(i.suggestion_id, i.evidence_role, i.confidence) for i in image.collect()}
    assert {("x", "shows_problem", 0.4), ("x", "ui_context", 0.75), ("x", "missing_element", 0.7), ("y", "error_state", 0.85), ("y", "visual_proof", 0.8)} <= kinds
    assert evidence.highlights(image).count() == image.count()


def test_model_provider_retries_and_survives(spark, tmp_path):
    def client():
        seen = {}

        def call(p):
            seen[p] = seen.get(p, 0) + 1
            if p == "bad" or seen[p] < 2:
                raise RuntimeError
            return '```json\n{"p": "%s"}\n```' % p

        return call

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "i int, prompt string")
    got = {r.i: r.reply_json for r in ModelProvider(client, pause=0.0).ask(df).collect()}
    assert got == {1: '{"p": "good"}', 2: None, 3: None}
    assert not available(client) and available(lambda: lambda p: "pong")
    views = spark.createDataFrame([("a", 0, "x", 0.5), ("a", 1, "y", 0.9), ("a", 2, "z", 0.9)], "sample_id string, image_index int, view string, confidence double")
    assert best_view(views).first().view == "y"


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('entry_id,domain,raw_text,has_image,image_description,has_audio,audio_description,modality_combo,is_suggestion,extraction_path\n1,tech,"He said ""no"",\nthen left",True,—,0,nan,T,yes,P1\n2,tech,plain,False,a pic,1.0,loud,T+I,no,HN\n')
    got = readers.read_reviews(spark, str(path)).orderBy("entry_id").collect()
    assert got[0].raw_text == 'He said "no",\nthen left' and got[0].has_image and got[0].is_suggestion and not got[0].has_audio and got[0].image_description == ""
    assert got[1].audio_description == "loud" and got[1].has_audio and not got[1].is_suggestion
    with pytest.raises(ValueError, match="domain"):
        readers.require_columns(spark.range(1))
    bare = tmp_path / "s.csv"
    bare.write_text('1,"a, b",1\n2,,0\n3,c,x\n')
    assert [(r.id, r.text, r.label) for r in readers.read_labelled(spark, str(bare)).collect()] == [("1", "a, b", 1)]
    assert readers.text_column(spark.createDataFrame([("a", "b")], "text string, review_text string")) == "text"
    out = str(tmp_path / "o")
    sinks.write_states(spark.createDataFrame([(1, bytearray(b"abc"))], "i int, raw binary"), out)
    assert spark.read.text(out).first()[0] == '{"i":1,"raw":"<3 items>"}'


def test_media(spark, tmp_path):
    (tmp_path / "A-1.PNG").write_bytes(b"xx")
    (tmp_path / "b.txt").write_bytes(b"y")
    files = media.list_files(spark, str(tmp_path))
    assert [(r.name, r.mime_type) for r in media.usable(files).collect()] == [("a-1.png", "image/png")]
    assert media.read_contents(spark, media.usable(files), str(tmp_path)).first().base64 == "eHg="
    rows = spark.createDataFrame(fixtures.MEDIA_ROWS, "entry_id string, image_path string, image_description string, has_image boolean")
    found = media.resolve(rows, media.with_names(spark.createDataFrame(fixtures.MEDIA_FILES, "path string, length long")), "image_path", "image_description")
    assert {r.entry_id: r.media_source for r in found.collect()} == {"GEN-1": "file", "GEN-2": "entry_id", "GEN-3": "description", "GEN-4": "none", "GEN-5": "none"}
    done = media.completeness(found, "has_image").first()
    assert (done.need, done.have, done.missing, done.missing_ids) == (4, 2, 2, ["GEN-3", "GEN-4"])


def test_metrics_on_nothing(spark):
    empty = spark.createDataFrame([], "gold boolean, pred boolean")
    assert metrics.detection(empty).first()["f1"] == 0
    pairs = spark.createDataFrame([], "a int, b int")
    assert metrics.cohen_kappa(pairs).first()["kappa"] == 0 and metrics.krippendorff_alpha(pairs).first()["alpha"] == 0
    assert metrics.kendall_tau(*[spark.createDataFrame([], "item int, pos int")] * 2).first()["tau"] == 0
    same = spark.createDataFrame([(1, 1)], "a int, b int")
    assert metrics.cohen_kappa(same).first()["kappa"] == 1 and metrics.krippendorff_alpha(same).first()["alpha"] == 1


def test_models_learn(spark):
    rows = [(i, "good fine nice day" if i % 2 else "bad sad grim day", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label double")
    for model in (ml.logistic(df, 50), ml.svm(df, 50)):
        assert all(r.pred == r.id % 2 for r in ml.predict(model, df.drop("label")).collect())
    few = spark.createDataFrame([(0.5, 3.0)], "avg_confidence double, rating double")
    assert ml.learned_scorer(few) is None and ml.learned_score(None, few).first().score > 0


def test_kendall_tau_against_all_pairs(spark):
    rnd = random.Random(3)
    for n in (2, 7, 60):
        p, g = (rnd.sample(range(1, n + 5), n) for _ in range(2))
        pairs = [(i, j) for i in range(n) for j in range(i)]
        signs = [1 if (p[i] - p[j]) * (g[i] - g[j]) > 0 else -1 for i, j in pairs]
        frame = lambda pos: spark.createDataFrame(list(enumerate(pos)), "item int, pos int")
        assert abs(metrics.kendall_tau(frame(p), frame(g)).first()["tau"] - sum(signs) / len(signs)) < 1e-12


def scripted():
    """A model that answers from the prompt: labels with one suggestion, views for text, nothing valid for one review."""
    import json

    def call(p):
        if "soup" in p:
            return "sorry"
        if p.startswith("List"):
            return "Here: " + json.dumps({"suggestions": [{"text": "Add a progress bar to the upload page", "confidence": 0.9, "is_implied": False}]})
        if p.startswith("Read the review"):
            return json.dumps({"complaint_frame": "The upload is so slow", "urgency_score": 0.9, "tone": "angry"})
        if p.startswith("Compare"):
            return json.dumps({"overall_alignment": 0.1, "dominant_modality": "image", "has_contradiction": True})
        if p.startswith("Look"):
            return json.dumps({"missing_ui_elements": ["progress bar"], "shows_error": True, "confidence": 0.6})
        return json.dumps({"urgency_score": 0.95, "is_suggestion": 1, "label": 0})

    return call


def test_a_model_drives_the_pipeline(spark):
    from dataclasses import replace

    from nuggetry.plans.providers import zero_shot

    model = ModelProvider(lambda: scripted(), pause=0.0, vision=lambda: lambda p, image: scripted()(p))
    r = fixtures.reviews(spark).where("sample_id IN ('v1', 'v2', 'v3')").withColumn("image_base64", F.lit("abc"))
    views = {x.sample_id: x for x in model.text_views(r).collect()}
    assert views["v1"].complaint_frame == "The upload is so slow" and views["v1"].urgency_score == 0.9 and views["v3"].urgency_score == 0.3
    seen = {x.sample_id: x for x in model.image_views(r).collect()}
    assert set(seen) == {"v1"} and seen["v1"].missing_ui_elements == ["progress bar"] and seen["v1"].shows_error and seen["v1"].confidence == 0.6
    assert {x.sample_id: x.urgency_score for x in model.audio_views(r).collect()}["v2"] == 0.95
    got = pipeline.run(r, replace(pipeline.Config(), provider=model)).collect()
    assert {x.sample_id: x.text for x in got}["v1"] == "Add a progress bar to the upload page"
    one = next(x for x in got if x.sample_id == "v1")
    assert one.overall_alignment == 0.8 and "cross_modal_contradiction" in one.reasons
    unknown = pipeline.run(r.withColumn("overall_alignment", F.lit(None).cast("double")), replace(pipeline.Config(), provider=model)).where("sample_id = 'v1'").first()
    assert unknown.overall_alignment == 0.1 and unknown.switch_mode == "SPECIFIC" and unknown.weighted_score == round(unknown.score * 0.8, 2)
    pred = {(style, x.sample_id): x.pred for style in ("short", "detailed", "entailment") for x in zero_shot(model, r, style).collect()}
    assert pred["short", "v1"] and pred["detailed", "v1"] and not pred["entailment", "v1"] and not pred["short", "v3"]


def test_slow_calls_end(spark):
    import time as t

    model = ModelProvider(lambda: lambda p: t.sleep(3) or "{}", retries=1, pause=0.0, timeout=0.1)
    assert model.ask(spark.createDataFrame([("a",)], "prompt string")).first().reply is None


def test_a_call_that_hangs_loses_no_other(spark):
    import time as t

    def client():
        return lambda p: t.sleep(30) if "hang" in p else "ok"

    model = ModelProvider(client, retries=2, pause=0.0, timeout=0.3)
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "hang", "b", "hang", "hang", "c", "d"])], "i int, prompt string").coalesce(1)
    assert [r.reply for r in model.ask(asked).orderBy("i").collect()] == ["ok", None, "ok", None, None, "ok", "ok"]


def test_memories_reach_the_ranking(spark):
    r = fixtures.reviews(spark)
    plain = {(x.sample_id, x.canonical_text): x for x in pipeline.run(r, pipeline.ablation("no_memory")).collect()}
    (sid, key), one = next((k, x) for k, x in plain.items() if "progress bar" in k[1])
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    memories = pipeline.Memories(
        decisions=made([(i, one.text, "accept", 0) for i in range(3)], "decision_id long, text string, decision string, s int").select("decision_id", "text", "decision", F.timestamp_seconds("s").alias("ts")),
        canonical=made([(one.text,)], "text string"), edits=made([(1, one.text, "Show the progress of the upload")], "edit_id long, original string, corrected string"),
        alignments=made([(one.overall_alignment, "text", one.domain, "accept")] * 3, "alignment_score double, dominant_modality string, domain string, decision string"),
        patterns=memory.patterns(made([(one.text, d, True) for d in "xyz"], "text string, domain string, accepted boolean")),
    )
    got = {(x.sample_id, x.canonical_text): x for x in pipeline.run(r, memories=memories).collect()}
    assert got.keys() == plain.keys()
    x = got[sid, key]
    assert x.text == "Show the progress of the upload" and x.is_human_corrected and x.semantic_memory_hit and x.past_approval_rate == 1.0
    assert x.cross_domain and x.modal_alignment_score == 1.0 and x.confidence > one.confidence and x.score > one.score
    others = [k for k in got if k != (sid, key)]
    assert others and all(got[k].past_approval_rate == 0.5 and got[k].text == plain[k].text for k in others)


def test_views_give_evidence(spark):
    rows = fixtures.reviews(spark)
    seen = {x.sample_id: x for x in RuleProvider().image_views(rows.withColumn("image_description", F.when(F.col("sample_id") == "v2", "an error dialog, no cancel button").otherwise(F.col("image_description")))).collect()}
    assert seen["v1"].missing_ui_elements == ["progress bar"] and seen["v1"].ui_elements_shown == [] and not seen["v1"].shows_error
    assert seen["v2"].shows_error and seen["v2"].missing_ui_elements == ["cancel button"] and seen["v2"].error_states_shown == ["error dialog"]
    heard = {x.sample_id: x.urgency_score for x in RuleProvider().audio_views(rows).collect()}
    assert heard["v2"] == 0.75
    transcripts = spark.createDataFrame([("v2", "It keeps CRASHING, um, when I search")], "sample_id string, transcript string")
    asked = spark.createDataFrame([("v2", "x", "fix crashing search")], "sample_id string, suggestion_id string, text string")
    got = {(e.source_view, e.evidence_role, e.confidence) for e in evidence.audio_evidence(asked, transcripts, RuleProvider().audio_views(rows)).collect()}
    assert ("audio_pragmatic", "tone_shift", 0.75) in got and any(v == "audio_pragmatic" and r == "emphasis_word" for v, r, _ in got)


def plain_near(query, body):
    """Every window of every size, the smallest and then the first."""
    if (at := body.lower().find(query.lower())) >= 0:
        return at, at + len(query)
    wanted, parts = set(query.lower().split()), body.split()
    bare = [w.lower().strip(".,!?") for w in parts]
    most = len(wanted & set(bare))
    if not wanted or most <= 0.5 * len(wanted):
        return None
    for size in range(len(wanted), len(parts) + 1):
        for first in range(len(parts) - size + 1):
            if len(wanted & set(bare[first : first + size])) == most:
                at = len(" ".join(parts[:first])) + (1 if first else 0)
                return at, at + len(" ".join(parts[first : first + size]))
    return None


def test_fuzzy_find_against_all_windows():
    rnd = random.Random(1)
    for _ in range(3000):
        q = " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 5)))
        b = " ".join(rnd.choice("abcdefxyz") + rnd.choice(["", ".", ","]) for _ in range(rnd.randint(0, 14)))
        assert evidence._near(q, b) == plain_near(q, b), (q, b)


def test_segments_of_all_turns_against_a_loop(spark):
    import re

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    want = []
    for r in turns:
        cursor, at, i = 0, 0.0, 0
        for s in (x.strip(" ") for x in re.split(evidence.SEGMENT_CUTS, r.text)):
            if s:
                start = r.text.find(s, cursor)
                start = cursor if start < 0 else start
                later = at + len(re.split(r"\s+", s)) / 2.5
                want.append((f"{r.conv_id}-{r.turn}", i, s, start, start + len(s), round(at, 1), round(later, 1)))
                cursor, at, i = start + len(s), later, i + 1
    from nuggetry.plans import queries

    got = [tuple(x) for x in queries.transcript_segments(spark, "/root/testdata/sf0.001").collect()]
    key = lambda x: (x[0], x[1])
    assert [x[:5] for x in sorted(got, key=key)] == [x[:5] for x in sorted(want, key=key)]
    assert all(abs(a[5] - b[5]) < 0.11 and abs(a[6] - b[6]) < 0.11 for a, b in zip(sorted(got, key=key), sorted(want, key=key)))


def test_acoustic_texts(spark):
    from nuggetry.functions import rules

    features = "struct<tone: string, speaking_rate_wpm: double, emphasis: array<struct<word: string, energy_ratio: double>>, pause_count: int, longest_pause_seconds: double, pitch_variability: double, energy_variability: double, duration_seconds: double>"
    rows = [(("angry", 190.0, [("now", 1.5), ("late", 2.5), ("so", 2.0), ("very", 1.0)], 4, 2.25, 60.0, 0.06, 3.0),), (("neutral", 120.0, [], 1, 0.5, 30.0, 0.01, 2.0),)]
    got = [tuple(r) for r in spark.createDataFrame(rows, f"a {features}").select(rules.acoustic_description(F.col("a")), rules.acoustic_features(F.col("a"))).collect()]
    assert got[0][0] == "Audio: angry tone, rapid pace, strong emphasis on late, so, now, 4 pauses (longest 2.3s), highly variable pitch (emotional), volume fluctuates significantly."
    assert got[1][0] == "Audio: neutral tone, normal pace."
    assert got[0][1] == "duration=3.0s, rate=190 wpm, pauses=4 (longest 2.3s), pitch_var=60.0, energy_var=0.060, emphasis=now/late/so/very"


def workbook(rows):
    """A minimal workbook of shared, inline, numeric and boolean cells."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    shared, body = [], []
    for n, row in enumerate(rows, 1):
        cells = ""
        for i, v in enumerate(row):
            at = f"{'ABC'[i]}{n}"
            if isinstance(v, bool):
                cells += f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
            elif isinstance(v, (int, float)):
                cells += f'<c r="{at}"><v>{v}</v></c>'
            elif v is not None and n % 2:
                shared.append(v)
                cells += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
            elif v is not None:
                cells += f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        body.append(f'<row r="{n}">{cells}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(body)}</sheetData></worksheet>")
    return out.getvalue()


def test_spreadsheets(spark, tmp_path):
    head = ["entry_id", "raw_text", "label"]
    (tmp_path / "a.xlsx").write_bytes(workbook([head, ["1", "tea & <cake>", 1], ["2", None, True], ["3", "last", 0.5]]))
    (tmp_path / "b.xlsx").write_bytes(workbook([head, ["4", "other file"]]))
    got = sorted(tuple(r) for r in readers.read_sheet(spark, str(tmp_path)).collect())
    assert got == [("1", "tea & <cake>", "1"), ("2", None, "True"), ("3", "last", "0.5"), ("4", "other file", None)]


def test_counts_are_damped(spark):
    import math

    df = spark.createDataFrame([(1, "tea tea tea cup", 1.0), (2, "cup saucer", 0.0), (3, "tea", 1.0)], "id int, text string, label double")
    model = ml.logistic(df, 50)
    vocabulary = model.stages[3].vocabulary
    row = model.transform(df).where("id = 1").first()
    counts = {"tea": 3, "cup": 1, "tea tea": 2, "tea cup": 1}
    got = {vocabulary[i]: x for i, x in zip(row["_damped"].indices, row["_damped"].values)}
    assert got.keys() == counts.keys() and all(abs(got[t] - 1 - math.log(n)) < 1e-12 for t, n in counts.items())


def test_passes_of_a_fit_do_not_split_texts_anew(spark):
    """Texts are made for the terms and for the counts, not for weights and model; equally frequent terms go by their order."""
    seen = spark.sparkContext.accumulator(0)

    def see(text):
        seen.add(1)
        return text

    rows = [(i, "tea cup" if i % 2 else "saucer pot", float(i % 2)) for i in range(40)]
    model = ml.svm(spark.createDataFrame(rows, "id int, text string, label double").withColumn("text", F.udf(see)("text")), 3)
    assert model.stages[3].vocabulary == ["cup", "pot", "saucer"] and seen.value <= 3 * len(rows)


def test_a_run_is_taken_up_after_its_last_whole_stage(spark, tmp_path, monkeypatch):
    r, folder = fixtures.reviews(spark), f"file://{tmp_path}/stages"
    want = {(x.sample_id, x.canonical_text, x.score, x.cluster_id) for x in pipeline.run(r).collect()}
    whole = pipeline.clusters.assign_clusters

    def killed(*_, **__):
        raise RuntimeError("killed")

    monkeypatch.setattr(pipeline.clusters, "assign_clusters", killed)
    first, second, third, fourth = [], [], [], []
    with pytest.raises(RuntimeError):
        pipeline.run(r, resume=folder, made=first)
    monkeypatch.setattr(pipeline.clusters, "assign_clusters", whole)
    got = pipeline.run(r.repartition(3), resume=folder, made=second)
    assert first == ["sentences", "views", "accepted", "suggestions", "evidence", "arrivals"] and second == ["clusters"]
    assert {(x.sample_id, x.canonical_text, x.score, x.cluster_id) for x in got.collect()} == want
    pipeline.run(r, pipeline.ablation("no_image"), resume=folder, made=third)  # another configuration starts anew, and the old stages go
    assert third[0] == "sentences" and len(list((tmp_path / "stages").iterdir())) == 1
    pipeline.run(r.limit(4), pipeline.ablation("no_image"), resume=folder, made=fourth)
    assert fourth[0] == "sentences" and len(list((tmp_path / "stages").iterdir())) == 1


def test_texts_that_mean_the_same_become_one(spark):
    r = spark.createDataFrame([("a", "tech_software", "Please add a dark mode now. Please kindly add a dark mode now. Please fix the search.", None, None, 0.8, None)], fixtures.REVIEW_COLUMNS)
    plain, merged = (pipeline.run(r, pipeline.Config(merge=m)).collect() for m in (False, True))
    assert len(plain) == 3 and sorted(x.frequency for x in merged) == [1, 2]
