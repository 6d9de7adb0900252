"""Small fixtures for operators, and random comparisons with independent statements of the same rules."""

import random
import re
import zlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronotext.config import PrivacyConfig
from chronotext.functions import names as N
from chronotext.functions import text as T
from chronotext.operators import catalog as C
from chronotext.operators import incremental as I
from chronotext.operators import providers as X
from chronotext.operators import repair as R
from chronotext.operators import sequence as S
from chronotext.operators import validate as V
from chronotext.sources import files as L
from chronotext.sources import sinks as K
from chronotext.streaming import ingest as G

SEG = "session_id string, id int, seg_start double, seg_end double, text string"


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- text ----


def longest_run(text):
    best = run = 0
    last = None
    for t in re.findall(r"[A-Za-z]+(?:-[A-Za-z0-9]+)*|\d+|[㐀-鿿]+", text.lower()):
        run = run + 1 if t == last else 1
        last, best = t, max(best, run)
    k = re.sub(T.NON_CONTENT, "", text).lower()
    for u in range(1, min(12, len(k) // 2) + 1):
        for i in range(len(k) - 2 * u + 1):
            n = 1
            while k[i + n * u : i + (n + 1) * u] == k[i : i + u]:
                n += 1
            best = max(best, n)
    return best


def test_longest_run_and_measures(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", "a", "b ", "好", "好", "12", ", "]) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["go " * 80, ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.longest_run(F.col("text")).alias("run"), T.ngram_counts(T.normalized(F.col("text"))).alias("g"), T.deflated_bytes(T.normalized(F.col("text"))).alias("z")).collect()
    for r in got:
        k = re.sub(T.NON_CONTENT, "", texts[r.i]).lower()
        grams = [k[i : i + 3] for i in range(len(k) - 2)]
        assert r.g == (len(grams), len(grams) - len(set(grams)))
        assert r.z == (len(zlib.compress(k.encode())) if k else 0)
        # a run of a rotated unit may be one shorter when scanned from the left without overlap
        assert r.run <= longest_run(texts[r.i]) and r.run >= longest_run(texts[r.i]) - 1


def test_anomaly_reasons(spark):
    rows = [("rep", "word " * 80, 10.0), ("ok", "a short clear sentence about nothing in particular, once", 5.0), ("thin", "few words here", 170.0), ("echo", "alpha beta gamma delta epsilon zeta", 12.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "name string, text string, seconds double")
    out = {r.name: r for r in R.measures(df, seconds=F.col("seconds"), terms=["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]).collect()}
    assert set(out["rep"].reasons) >= {"high_compression", "low_character_diversity", "repeated_ngrams", "consecutive_repetition"}
    assert not out["ok"].suspicious and out["thin"].reasons == ["low_text_density"] and out["echo"].reasons == ["prompt_echo"]
    assert out["none"].n_chars == 0 and out["rep"].score > out["ok"].score


def test_cues(spark):
    df = spark.createDataFrame([(1, "看一下这张图"), (2, "黑板上的公式"), (3, "下面我们进行证明"), (4, "PPT"), (5, "ppt 上"), (6, "nothing")], "i int, text string")
    got = {r.i: (r.v, r.d) for r in df.select("i", T.visual_labels(F.col("text")).alias("v"), T.derivation_cue(F.col("text")).alias("d")).collect()}
    assert got[1][0] == ["照片/图像"] and got[2][0] == ["板书/黑板"] and got[3][1] and got[4][0] == ["屏幕/PPT"] == got[5][0] and got[6] == ([], False)


# ---- intervals ----


def test_windows_unite_and_runs_cross_segments(spark):
    seg = [("a", 0, 0.0, 10.0, "fine words"), ("a", 1, 10.0, 20.0, "go " * 80), ("a", 2, 25.0, 35.0, "go " * 80), ("a", 3, 80.0, 90.0, "fine words"), *(("b", i, 3.0 * i, 3.0 * i + 3, "yes") for i in range(7))]
    df = spark.createDataFrame(seg, SEG)
    dur = spark.createDataFrame([("a", 100.0), ("b", 21.0)], "session_id string, duration double")
    out = {r.session_id: r for r in R.union_windows(R.candidates(df, dur)).collect()}
    assert out["a"].ids == [1, 2] and (out["a"].window_start, out["a"].window_end) == (0.0, 50.0)
    assert out["b"].ids == list(range(7)) and out["b"].reasons == ["cross_segment_repetition"]


def test_interval_joins_equal_nested_loops(spark):
    rng = random.Random(2)
    a = [("s", i, x, x + rng.choice([0.0, 1.0, 300.0, 900.0])) for i in range(60) for x in [rng.uniform(0, 3000)]]
    b = [("s", i, x, x + rng.choice([5.0, 256.0, 700.0])) for i in range(25) for x in [rng.choice([0.0, 256.0, 512.0, rng.uniform(0, 3000)])]]
    left, right = spark.createDataFrame(a, "session_id string, id int, ls double, le double"), spark.createDataFrame(b, "session_id string, rid int, rs double, re double")
    want = sorted((x[1], y[1]) for x in a for y in b if x[3] > y[2] and x[2] < y[3])
    assert values(S.interval_join(left, right, ["session_id"], ("ls", "le"), ("rs", "re")), "id", "rid") == want
    hit = {x for x, _ in want}
    assert values(S.interval_anti_join(left, right, ["session_id"], ("ls", "le"), ("rs", "re"), ["id"]), "id") == sorted((x[1],) for x in a if x[1] not in hit)


def test_clamp_is_the_sequential_rule(spark):
    rng = random.Random(3)
    seg = [(f"s{n}", i, float(rng.randint(-3, 20)), float(rng.randint(-3, 24)), rng.choice(["x", " y ", " "])) for n in range(60) for i in range(6)]
    df = spark.createDataFrame(seg, SEG).withColumn("duration", F.lit(20.0))
    want = []
    for n in range(60):
        end = None
        for _, i, a, b, t in sorted((x for x in seg if x[0] == f"s{n}"), key=lambda x: (max(0.0, x[2]), min(20.0, x[3]), x[1])):
            a, b = max(0.0, a), min(20.0, b)
            a = end if end is not None and a < end else a
            if b > a and t.strip():
                want.append((f"s{n}", i, a, b))
                end = b
    out = S.clamp(df, ["session_id"], "duration")
    assert values(out, "session_id", "id", "seg_start", "seg_end") == sorted(want)
    assert S.timeline_violations(S.reindex(out, ["session_id"], "seg_start", "seg_end").drop("id").withColumnRenamed("new_id", "id"), ["session_id"], "duration").count() == 0


def test_fold_keeps_what_its_own_cover_allows(spark):
    rows = [("s", 0, k, a, b) for k, (a, b) in enumerate([(1.0, 7.0), (8.0, 14.0), (15.0, 20.0), (21.0, 22.0)])] + [("s", 10, 0, 13.0, 17.0), ("s", 10, 1, 17.0, 23.0), ("s", 20, 0, 20.0, 21.0)]
    out = S.fold_chunks(spark.createDataFrame(rows, "session_id string, chunk long, place long, seg_start double, seg_end double"), ["session_id"], 4.0)
    done, want = 0.0, []
    for _, c, p, a, b in rows:
        if not want or a >= done - 2:
            want.append((c, p))
            done = max(done, b)
    assert values(out, "chunk", "place") == sorted(want)


def test_chunk_plan_and_assembly(spark):
    seg = spark.createDataFrame([("s", i, 60.0 * i, 60.0 * i + 60, f"t{i}") for i in range(10)], SEG)
    plan = S.chunk_plan(seg.groupBy("session_id").agg(F.max("seg_end").alias("duration")))
    assert values(plan, "chunk", "core_end", "window_start", "window_end") == [(0, 480.0, 0.0, 510.0), (1, 600.0, 450.0, 600.0)]
    res = S.interval_join(seg, plan, ["session_id"], ("seg_start", "seg_end"), ("window_start", "window_end")).withColumn("text", F.concat("text", F.lit("-"), "chunk"))
    out = V.assemble(seg.drop("text"), res.select("session_id", "id", "chunk", "core_start", "core_end", "text"))
    assert values(out, "id", "text")[7:] == [(7, "t7-0"), (8, "t8-1"), (9, "t9-1")]


def test_placeholders_and_runs(spark):
    seg = [("s", i, 2.0 * i, 2.0 * i + 2, "嗯") for i in range(8)] + [("s", 8, 16.0, 20.0, "real text")]
    out = R.placeholder_runs(spark.createDataFrame(seg, SEG))
    assert out.where("dropped").count() == 8


def test_chains_break_on_overlap(spark):
    rows = [(1, 0, 100.0), (2, 150, 100.0), (3, 200, 50.0), (4, 260, 10.0)]
    df = spark.createDataFrame(rows, "session_id int, start_sec long, duration_sec double")
    out = S.gap_chains(df, [F.lit("d"), F.lit(None).cast("int")], F.lit(300.0))
    assert values(out, "session_id", "chain", "gap") == [(1, 0, None), (2, 0, 50.0), (3, 1, -50.0), (4, 1, 10.0)]


# ---- repair ----


def test_decisions(spark):
    st = "struct<n_chars:int,score:double,suspicious:boolean>"
    cases = [((100, 5.0, True), (0, 0.0, False), "replacement_empty"), ((100, 5.0, True), (4, 0.0, False), "replacement_too_short"), ((100, 1.0, True), (90, 2.0, True), "anomaly_score_worse"), ((100, 5.0, True), (90, 1.0, False), "suspicion_cleared"), ((100, 5.0, True), (90, 3.0, True), "anomaly_score_improved"), ((100, 5.0, True), (90, 4.5, True), "insufficient_improvement")]
    out = spark.createDataFrame([(a, b, w) for a, b, w in cases], f"b {st}, a {st}, want string").withColumn("d", R.decision("b", "a"))
    assert all(r.d.reason == r.want and r.d.accepted == (r.want in ("suspicion_cleared", "anomaly_score_improved")) for r in out.collect())


# ---- names and times ----


def test_names(spark):
    df = spark.createDataFrame([("Quantum Mechanics", "quantum-mechanics"), ("量子力学 / 第一章", "量子力学-第一章"), ("", "untitled"), ("...", "untitled"), ("a_b  c", "a-b-c")], "raw string, want string")
    assert all(r.s == r.want for r in df.select("want", N.slug(F.col("raw")).alias("s")).collect())
    t = spark.createDataFrame([(0.0,), (61.0,), (3661.0,), (5531.4,), (-5.0,), (59.9996,)], "s double").select(N.hhmmss(F.col("s")).alias("a"), N.hhmmss_ms(F.col("s")).alias("b")).collect()
    assert [r.a for r in t] == ["00:00:00", "00:01:01", "01:01:01", "01:32:11", "00:00:00", "00:01:00"] and t[5].b == "00:00:60.000"
    n = spark.createDataFrame([("rec_20260903_140000.m4a",), ("20260903-140000",), ("2026-09-03 14.00.00",), ("2026_09_03 14_30",), ("x",), ("20261399_250000",)], "n string").select(N.name_time(F.col("n")).cast("string").alias("t")).collect()
    assert [r.t for r in n] == ["2026-09-03 14:00:00"] * 3 + ["2026-09-03 14:30:00", None, None]


def test_start_guess(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'r_20260903_140000', 600d, timestamp_ntz'2026-09-03 14:10:05'), (2, 'r_20260903_140000', 600d, timestamp_ntz'2026-09-03 18:00:00'),
      (3, 'r_20260903_140000', 600d, cast(null as timestamp_ntz)), (4, 'x', 600d, cast(null as timestamp_ntz)), (5, 'x', cast(null as double), cast(null as timestamp_ntz)) AS t(i, name, s, c)""")
    m = F.lit("2026-09-04 00:10:00").cast("timestamp_ntz")
    g = {r.i: r.g for r in df.select("i", N.start_guess(F.col("name"), F.col("s"), F.col("c"), m, m).alias("g")).collect()}
    assert [(g[i].source, g[i].confidence) for i in range(1, 6)] == [("filename", "high"), ("ffprobe", "high"), ("filename", "high"), ("mtime-duration", "medium"), ("ctime", "low")]
    assert str(g[4].start) == "2026-09-04 00:00:00"


# ---- catalog ----


def test_upsert_keeps_and_overwrites(spark):
    rows = [("s", 1, "run", "fake", "t1"), ("s", 2, "done", None, None)]
    out = C.upsert(spark.createDataFrame(rows, "id string, seq int, status string, model string, started string"), ["id"], "seq", overwrite=["status"], keep_known=["model", "started"]).collect()[0]
    assert (out.status, out.model, out.started) == ("done", "fake", "t1")


def test_nearest_slot(spark):
    slots = L.courses(spark, [{"key": "A", "schedule": [{"weekday": 3, "start": "08:00", "end": "09:00"}]}, {"key": "B", "schedule": [{"weekday": 3, "start": "10:00", "end": "11:00"}]}])
    s = spark.sql("SELECT 1 session_id, timestamp'2026-09-02 09:40:00' start_time UNION ALL SELECT 2, timestamp'2026-09-03 09:40:00'")
    assert values(C.match_slots(s, slots, 60), "session_id", "matched") == [(1, "B"), (2, "unknown")]
    with pytest.raises(ValueError):
        L.courses(spark, [{"key": "A", "schedule": [{"weekday": 8, "start": "08:00", "end": "09:00"}]}])


def test_transitions(spark):
    df = spark.createDataFrame([("NEW", "AUDIO_READY"), ("NEW", "NEW"), ("DONE", "FAILED"), ("FAILED", "NEW"), ("FUSING", "GENERATING_NOTE")], "current string, target string")
    assert values(C.illegal_transitions(df), "current", "target") == [("DONE", "FAILED"), ("FAILED", "NEW")]


# ---- validators ----


def test_strict_and_boundaries(spark):
    items = spark.createDataFrame([("s", 0, 1, "Same, text"), ("s", 1, 1, "same text"), ("s", 0, 2, "left"), ("s", 1, 2, "right"), ("s", 1, 3, "x"), ("s", 2, 3, "x")], "session_id string, chunk int, id int, text string")
    out = {r.chunk: r for r in V.boundary_decisions(items).collect()}
    assert (out[0].decision, out[0].conflicts, out[1].reason) == ("llm", [2], "identical_overlap")
    with pytest.raises(V.ConstraintError):
        V.strict(spark.createDataFrame([("s", "r", "1")], "session_id string, rule string, item_id string"))


def test_json_types(spark):
    df = spark.createDataFrame([("a", '{"k": 1}'), ("b", '{"k": true}'), ("c", '{"k": 1, "x": 1}'), ("d", "no")], "session_id string, doc string")
    assert {(r.session_id, r.rule) for r in V.json_type_violations(df, "doc", {"k": "NUMBER"}).collect()} == {("b", "type of k"), ("c", "keys"), ("d", "keys"), ("d", "type of k")}


# ---- incremental, providers ----


def test_cache_computes_only_misses(spark):
    units = spark.createDataFrame([("k1", "p1"), ("k2", "p\nlast")], "cache_key string, prompt string")
    cache = spark.createDataFrame([("k1", "old")], "cache_key string, response string")
    out = I.with_cache(units, cache, lambda m: X.complete(m, X.language_model("fake")).select("cache_key", "prompt", "response"))
    assert values(out, "cache_key", "response", "cached") == [("k1", "old", True), ("k2", "last", False)]


def test_providers(spark):
    with pytest.raises(X.ProviderError):
        X.transcriber("none")
    X.TRANSCRIBERS["cloud"] = X.FakeTranscriber
    with pytest.raises(V.ConstraintError):
        X.transcriber("cloud", PrivacyConfig())
    df = spark.createDataFrame([("s", bytearray(b"x" * 400_000))], "session_id string, content binary")
    assert values(X.transcribe(df, X.transcriber("fake")), "id", "seg_start", "seg_end") == [(0, 0.0, 10.0), (1, 10.0, 12.5)]


def test_retries(spark):
    class Flaky:
        calls = 0

        def complete(self, prompt, schema=None):
            self.calls += 1
            if self.calls % 2:
                raise RuntimeError("busy")
            return "ok", {}

    out = X.complete(spark.createDataFrame([("p",)], "prompt string").coalesce(1), Flaky, base_seconds=0.0).collect()[0]
    assert (out.response, out.attempts, out.error) == ("ok", 2, None)


# ---- files ----


def test_files(spark, tmp_path):
    import io
    import wave
    import zipfile

    to = io.BytesIO()
    with wave.open(to, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 16000)
    for n in ("讲座.wav", "b.wav", ".hidden.wav", "c.txt"):
        (tmp_path / n).write_bytes(to.getvalue() if n != "b.wav" else b"RIFF")
    known = spark.createDataFrame([], "sha256 string")
    got = L.scan_recordings(spark, str(tmp_path), known, "2999-01-01 00:00:00").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["b.wav", "讲座.wav"]
    assert L.scan_recordings(spark, str(tmp_path), spark.createDataFrame([(got[0].sha256,)], "sha256 string"), "2999-01-01 00:00:00").count() == 1
    bytes_ = spark.read.format("binaryFile").load(f"{tmp_path}/*.wav").where("path NOT LIKE '%hidden%'").orderBy("path")
    p = bytes_.select(L.probe_wave("content").alias("p")).collect()
    assert [r.p.duration_sec for r in p] == [None, 2.0]
    cut = bytes_.where("path NOT LIKE '%b.wav'").select(L.probe_wave(L.cut_wave(0.5, 1.0)("content")).alias("p")).collect()[0].p
    assert cut.duration_sec == 0.5
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("manifest.json", "{}")
    m = L.package_manifests(spark.read.format("binaryFile").load(f"{tmp_path}/p.zip")).collect()[0]
    assert (m.manifest, m.error) == ("{}", None)


def test_documents(spark, tmp_path):
    import json

    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    (tmp_path / "a/metadata.json").write_text(json.dumps({"session_id": "a", "state": "DONE", "course": {"key": "q"}, "audio": {"sha256": "x", "path": "p", "size": 3}, "extra": 1}))
    (tmp_path / "b/metadata.json").write_text("{broken")
    m = L.read_metadata(spark, str(tmp_path))
    assert [r.session_id for r in m.collect()] == ["a"]
    ix = L.rebuild_index(m)
    assert [ix[k].count() for k in ("courses", "sessions", "files")] == [1, 1, 1]
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"start": 0.0, "end": 1.0, "text": " hi "}, {"id": 7, "start": 1.0, "end": 2.0, "text": "yo"}]}))
    t = L.read_transcripts(spark, str(tmp_path / "t.json"))
    assert t.collect()[0].valid and values(L.segments(t), "id", "text") == [(0, "hi"), (7, "yo")]
    g = spark.createDataFrame([("c", 0, 0, "# no"), ("c", 0, 1, " term "), ("c", 0, 2, ""), ("d", 1, 0, "term"), ("d", 1, 1, "other")], "file string, file_priority int, line_no int, line string")
    assert values(L.glossary(g), "ord", "term", "file") == [(0, "term", "c"), (1, "other", "d")]


def test_markdown(spark):
    seg = spark.createDataFrame([("s", 1, 61.0, 62.0, "two\nlines"), ("s", 0, 0.0, 61.0, "one")], SEG)
    assert K.transcript_markdown(seg).collect()[0].markdown == "# Transcript\n\n[00:00:00] one\n[00:01:01] two lines"
    assert '"id":0' in K.transcript_json(seg).collect()[0].json


# ---- streaming ----


def test_stage_order_and_isolation(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen, errors = [], []

    def bad(batch, n):
        seen.append("bad")
        raise ValueError("x")

    q = G.run_loop(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), [("a", bad), ("b", lambda b, n: seen.append(b.count()))], f"{tmp_path}/ck", log=lambda s, e: errors.append(s))
    q.awaitTermination()
    assert seen == ["bad", 3] and errors == ["a"]


def test_backoff(spark):
    rows = [("f", 1, 1, 1, False, False), ("f", 2, 1, 1, False, False), ("g", 1, 1, 1, False, True), ("g", 9, 2, 1, False, True), ("h", 1, 1, 1, True, False)]
    out = G.backoff_state(spark.createDataFrame(rows, "path string, at int, size int, mtime int, ok boolean, incomplete boolean"))
    assert values(out, "path", "failures", "retry_at") == [("f", 2, 62), ("g", 1, 24)]


def test_numbered_and_followed_over_ranges(spark):
    """A hot key over many ranges: places and neighbours as one window gives them."""
    from chronotext.operators import catalog, sequence

    rng = random.Random(3)
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"k{k % 5}", None if k % 13 == 0 else rng.randint(0, 60), k) for k in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    order = [F.col("t"), F.col("i")]
    w = Window.partitionBy("k").orderBy(F.asc_nulls_first("t"), "i")
    ties = Window.partitionBy("k").orderBy(F.asc_nulls_first("t"))
    plain = df.withColumn("p", F.row_number().over(w)).withColumn("r", F.rank().over(ties)).withColumn("b", F.lag("i").over(w))
    want = {r.i: (r.p, r.r, r.b) for r in plain.collect()}
    for few in (0, 10**6):
        got = sequence.numbered(df, ["k"], order[:1], "p", ties=order[1:], few=few, parts=7)
        got = sequence.numbered(got, ["k"], order[:1], "r", few=few, parts=7)
        got = sequence.followed(got, ["k"], order, "i", "b", few=few, parts=7)
        assert {r.i: (r.p, r.r, r.b) for r in got.collect()} == want and got.columns == ["k", "t", "i", "p", "r", "b"]
    number = {r.i: r.number for r in catalog.course_sequence(df, "k", "t").collect()}
    for k, t, i in rows:
        others = [x for g, x, _ in rows if g == k and x is not None]
        assert number[i] == 1 + (len(others) if t is None else sum(x < t for x in others))


def test_long_runs_of_equal_lines(spark):
    """A session of one line, many times: one run with all ids, in time proportional to its length."""
    from chronotext.operators import repair

    n = 40_000
    seg = spark.range(n).selectExpr("'s' AS session_id", "cast(id AS int) AS id", "'the same line again' AS text", "cast(id AS double) AS seg_start", "cast(id + 1 AS double) AS seg_end")
    out = repair.candidates(seg).selectExpr("seg_start", "seg_end", "size(ids) AS n", "reasons").collect()
    assert [(r.seg_start, r.seg_end, r.n) for r in out if "cross_segment_repetition" in r.reasons] == [(0.0, float(n), n)]
