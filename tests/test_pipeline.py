"""Sources, sinks, the stage runner, the scorer seam, streaming ingestion, plans and the entry contract."""

import json
import wave

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom import schemas
from voxloom.config import QualityConfig
from voxloom.plans import recordings, runner
from voxloom.scorers import EchoTranscriber, EvenIntervals, FixedScorer, attach, score
from voxloom.sources import readers, sinks
from voxloom.streaming import ingest

CLIPS = [{"id": f"c{i}", "audio_path": f"a/{i}.wav", "text": "ტექსტი " * (1 + i % 3), "speaker_id": "s" if i % 2 else "t", "duration": 1.0 + i} for i in range(12)]


def write(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) if r else "" for r in rows), encoding="utf-8")
    return str(path)


def test_manifest_reading(spark, tmp_path):
    for name in readers.SPLITS.values():
        write(tmp_path / name, [CLIPS[0], None, CLIPS[1]])
    assert readers.read_splits(spark, str(tmp_path)).groupBy("split").count().count() == 3
    bad = tmp_path / "bad.json"
    bad.write_text('{"id": "x"}\n{broken')
    with pytest.raises(Exception):
        readers.read_manifest(spark, str(bad)).collect()
    with pytest.raises(FileNotFoundError):
        readers.read_manifest(spark, str(tmp_path / "absent.json"))
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, str(tmp_path))


def test_shards_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", "s", 1.0, "b", True, False, (bytearray(b"xx"),))], schemas.SHARD)
    df.coalesce(1).write.parquet(str(tmp_path / "train-0.parquet"))
    shards = readers.read_shards(spark, str(tmp_path)).select("id", "book_title")
    plan = shards._jdf.queryExecution().executedPlan().toString()
    assert "audio" not in plan.split("ReadSchema")[1] and shards.count() == 1


def test_pcm_headers_and_listing(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000), w.writeframes(b"\0\0" * 800)
    (tmp_path / "b.wav").write_bytes(b"not audio")
    (tmp_path / "c.txt").write_bytes(b"x")
    info = {r["name"]: tuple(r)[1:] for r in readers.pcm_info(spark, str(tmp_path)).collect()}
    assert info == {"a.wav": (800, 16000, 1), "b.wav": (None, None, None)}
    assert {r["name"] for r in readers.list_files(spark, str(tmp_path)).collect()} == {"a.wav", "b.wav"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "x|y", None), ("a", " ქ ", 1), ("c", " ", 2)], "path string, text string, n int")
    sinks.write_manifest(df, str(tmp_path / "m"), single_file=True)
    lines = [json.loads(x) for p in (tmp_path / "m").glob("*.json") for x in p.read_text(encoding="utf-8").splitlines()]
    assert {"path": "b", "text": "x|y"} in lines and any("ქ" in x["text"] for x in lines)
    out = sinks.transcript_lines(df, "path", "text", spark.createDataFrame([("a",)], "f string"), "f")
    assert [r[0] for r in out.collect()] == ["a|ქ"]
    sinks.write_transcript_lines(sinks.transcript_lines(df, "path", "text"), str(tmp_path / "t"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "t")).collect()} == {"a|ქ", "b|x|y"}
    assert [x["path"] for x in json.loads(sinks.json_array(df, "path").first()[0])] == ["a", "b", "c"]


def test_runner_keeps_drops_and_resumes(spark, tmp_path):
    df = spark.createDataFrame(CLIPS + [{"id": "n", "audio_path": None, "text": None, "speaker_id": None, "duration": None}], schemas.CLIP)
    cfg = QualityConfig(min_speaker_seconds=30.0, max_duration=9.0)
    names = ("standardize", "nisqa", "duration_outlier", "speaker_select")
    scored = df.withColumn("nisqa_mos", F.when(F.col("id") != "c3", 3.0))
    out = str(tmp_path / "run")
    kept = runner.run_quality(scored, out, names, cfg)
    counts = {r["stage"]: (r["kept"], r["dropped"]) for r in runner.stage_counts(spark, out, names).collect()}
    assert counts["standardize"] == (9, 4) and counts["nisqa"] == (8, 1)
    before = 13
    for i, n in enumerate(names, 1):
        k, d = (runner.stage_rows(spark, f"{out}/stage={i}_{n}").where(F.col("verdict") == v) for v in ("kept", "dropped"))
        assert k.count() + d.count() == before and d.where("reason IS NULL").count() == 0 and k.join(d, "id").count() == 0
        before = k.count()
    assert spark.read.parquet(f"{out}/stage=2_nisqa/side=nisqa_scores").count() == 9
    stats = runner.stage_statistics(spark, out, names, {"nisqa": "nisqa_mos", "duration_outlier": "char_duration"}).collect()
    assert [(r["stage"], r["n"]) for r in stats] == [("nisqa", 8), ("duration_outlier", 8)] and stats[0]["median"] == 3.0
    mark = next((tmp_path / "run" / "stage=1_standardize").glob("done-*")).stat().st_mtime_ns
    again = runner.run_quality(scored, out, names, cfg)
    assert again.count() == kept.count() and next((tmp_path / "run" / "stage=1_standardize").glob("done-*")).stat().st_mtime_ns == mark
    other = runner.run_quality(scored, out, names, QualityConfig(max_duration=5.0, min_speaker_seconds=1.0))
    assert other.agg(F.max("duration")).first()[0] <= 5.0
    with pytest.raises(ValueError, match="unknown"):
        runner.run_quality(df, out, ("nope",))
    assert runner.run_quality(scored.limit(0), str(tmp_path / "empty"), names, cfg).count() == 0


def test_scorer_isolates_errors(spark):
    class Fails:
        schema = "y long"

        def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
            if (frame["id"] == 7).any():
                raise RuntimeError("bad record")
            return pd.DataFrame({"y": frame["id"] * 2})

    rows = {r["id"]: (r["y"], r["error"]) for r in score(spark.range(20), Fails, Fails.schema, 8).collect()}
    assert rows[7] == (None, "bad record") and all(rows[i] == (2 * i, None) for i in range(20) if i != 7)
    df = spark.createDataFrame([("a b c d e f g h",), (None,)], "text string")
    assert sorted(r["asr_text"] for r in score(df, EchoTranscriber, EchoTranscriber.schema).collect()) == ["", "a b c d e f h"]


def test_contracts(spark):
    df = spark.createDataFrame([("a", 20.0), ("b", 3.0), ("c", None)], "recording_id string, duration double")
    got = attach(df, "speech_intervals", EvenIntervals).orderBy("recording_id", "ordinal").collect()
    assert [(r["recording_id"], r["start_sec"], r["end_sec"]) for r in got if r["error"] is None] == [("a", 0.0, 8.0), ("a", 8.5, 16.5), ("a", 17.0, 20.0), ("b", 0.0, 3.0)]
    assert sum(r["error"] is not None for r in got) == 1
    assert attach(df, "speech_quality", lambda: FixedScorer(nisqa_mos=3.5, nisqa_noisiness=1.0, nisqa_discontinuity=1.0, nisqa_coloration=1.0, nisqa_loudness=1.0)).where("nisqa_mos = 3.5").count() == 3
    assert attach(df, "spectral_distance", lambda: FixedScorer(wrong=1.0)).where("mcd IS NULL AND error IS NOT NULL").count() == 3


def test_recordings_resume(spark, tmp_path):
    words = "ერთი დიდი სახლი იდგა მთის ძირას და იქ ცხოვრობდა მოხუცი კაცი".split()
    intervals = spark.createDataFrame([(r, 10.0 * i + 5, 10.0 * i + 12) for r in ("a", "b") for i in range(4)] + [("a", 0.0, 0.4), ("a", 60.0, 67.0)], "recording_id string, start_sec double, end_sec double")
    chunks = recordings.recogniser_chunks(intervals)
    ids = [r["chunk_id"] for r in chunks.orderBy("chunk_id").collect()]
    assert ids == [f"a__chunk_0000{i}" for i in range(1, 6)] + [f"b__chunk_0000{i}" for i in range(4)]
    texts = spark.createDataFrame([(i, " ".join(words[:9])) for i in ids[:-1]], "chunk_id string, text string")
    books = spark.createDataFrame([("a", (" ".join(words) + ". ") * 6)], "recording_id string, text string")
    calls = []

    def judge(pending):
        calls.append(sorted(r[0] for r in pending.collect()))
        return recordings.first_generation(intervals.join(pending, "recording_id"), texts, books)

    out = str(tmp_path / "run")
    recordings.run_recordings(intervals.where("recording_id = 'a'"), judge, out)
    rows = recordings.run_recordings(intervals, judge, out)
    assert recordings.run_recordings(intervals, judge, out).count() == rows.count() == 9 and calls == [["a"], ["b"]]
    reasons = {r["chunk_id"]: r["reason"] for r in rows.collect()}
    assert reasons["b__chunk_00003"] == "empty_text" and reasons["b__chunk_00000"] == "ok"
    summary = json.loads(spark.read.text(f"{out}/summary").first()[0])
    assert summary["recordings"] == 2 and summary["clips"] == 9 and summary["kept"] == sum(r == "ok" for r in reasons.values())
    manifest = recordings.clip_manifest(rows, "chunk_id", F.lit("n"), "w/", measures=True)
    assert manifest.count() == summary["kept"] and manifest.where("audio_filepath = concat('w/', id, '.wav')").count() == summary["kept"]
    assert {r["recording_id"]: r["total"] for r in recordings.recording_yield(rows).collect()} == {"a": 5, "b": 4}


def test_streaming_ingest(spark, tmp_path):
    src, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    write(src / "1.json", CLIPS[:5] + [CLIPS[0]])
    ingest.ingest_new(spark, str(src), target, state)
    write(src / "2.json", CLIPS[3:8])
    ingest.ingest_new(spark, str(src), target, state)
    ingest.ingest_new(spark, str(src), target, state)
    rows = spark.read.parquet(target).collect()
    assert sorted(r["id"] for r in rows) == sorted(c["id"] for c in CLIPS[:8]) and {r["reason"] for r in rows} == {"ok"}


def test_windowed_counts(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = ingest.windowed_counts(ev, "ts", "event_type")
    assert out.agg(F.sum("n")).first()[0] == ev.count()


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == e.entry(spark).columns


def test_built_in_plans_have_no_python(spark):
    from voxloom.plans import registry

    d = "/root/testdata/sf0.001"
    for name in ("flt7_segment_cascade", "flt8_prepare_corpus", "agg1_speaker_volume", "sf10_wer", "p3_found", "jn13_title_lookup"):
        plan = registry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan
