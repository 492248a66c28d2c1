import json

import pytest
from pyspark.sql import functions as F

from glyphmill import cli
from glyphmill.functions import media
from glyphmill.operators import batch_infer, chat, collate, evaluate, runs
from glyphmill.operators.predict import InferenceOptions, ReplacePredictor, apply_predictor, first_of
from glyphmill.streaming.events import count_by_type, tail_events


def upper():
    """A factory that the workers need not import."""
    return lambda: lambda paths: [p.upper() for p in paths]


def _items(spark):
    return spark.createDataFrame([(i, str(i), f"/{i}.png", t) for i, t in enumerate(["a e b", "", "é e"])], "row_idx long, id string, image_path string, text string")


def _answers(lost):
    texts = {f"/{i}.png": t for i, t in enumerate(["a e b", "", "é e"])}
    return lambda: ReplacePredictor(texts, lost, "?")


def test_report(spark, tmp_path):
    rows = evaluate.result_rows(_items(spark), _answers("e"))
    made = evaluate.report_dict(rows)
    assert made["num_samples"] == 3 and [e["pred"] for e in made["examples"]] == ["a ? b", "", "é ?"]
    assert made["metrics"]["cer"] == pytest.approx((1 / 5 + 0 + 1 / 3) / 3)
    evaluate.write_report(made, str(tmp_path / "r" / "report.json"))
    text = (tmp_path / "r" / "report.json").read_text(encoding="utf-8")
    assert list(json.loads(text)) == ["metrics", "num_samples", "examples"] and "é" in text and text.startswith('{\n  "metrics"')
    assert evaluate.write_step_report(made, str(tmp_path), 200).endswith("eval_step_200.json") and (tmp_path / "eval_step_200.json").exists()
    assert evaluate.report_dict(rows.limit(0)) == {"metrics": {"cer": 0.0, "wer": 0.0}, "num_samples": 0, "examples": []}


def test_example_rows_are_those_of_the_report(spark):
    rows = [(i // 3, str(i % 2), f"/{i % 2}", "é" * (i % 5), "x" * (i % 7) if i % 4 else None) for i in range(200)]
    made = spark.createDataFrame(rows, "row_idx long, id string, image_path string, ref string, pred string").repartition(7)
    listed = evaluate.example_rows(made)
    got = sorted((r.asDict() for r in listed.collect()), key=lambda r: r["position"])
    assert [r.pop("position") for r in got] == list(range(200)) and got == evaluate.report_dict(made)["examples"]
    assert evaluate.example_rows(made.limit(0), "id").collect() == []


def test_report_rows_are_not_gathered(spark, tmp_path):
    from glyphmill.plans.queries import ocr_report_rows

    spark.createDataFrame([(3, "ye "), (1, None), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = ocr_report_rows(spark, str(tmp_path))
    assert "collect_list" not in made._jdf.queryExecution().toString()
    assert [(r.position, r.id, r.ref_chars) for r in made.orderBy("position").collect()] == [(0, "1", None), (1, "2", 0), (2, "3", 3)]


def test_compare(spark):
    items = _items(spark)
    base, tuned = evaluate.result_rows(items, _answers("e")), evaluate.result_rows(items, _answers("zzz"))
    one = evaluate.compare(base, tuned).first()
    assert one.delta_cer < 0 and one.tuned_cer == 0 and one.base_samples == 3
    made = evaluate.compare_report(base, tuned, "b", "t")
    assert made["base"]["model_id"] == "b" and made["delta"]["cer"] == pytest.approx(one.delta_cer)


def test_predictors(spark):
    with pytest.raises(ValueError, match="dtype"):
        InferenceOptions(dtype="int8")

    def broken():
        raise RuntimeError

    assert first_of(broken, upper())()(["a"]) == ["A"] and first_of(broken)() is None
    with pytest.raises(Exception, match="can be called"):
        apply_predictor(_items(spark), first_of(broken)).collect()


def test_directory(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    with pytest.raises(Exception):  # noqa: B017
        batch_infer.infer_directory(spark, str(source), str(out), upper())
    for name in ("a.jpg", "a.png", "b.webp", "n.txt"):
        (source / name).write_bytes(b"x")
    rows = batch_infer.infer_directory(spark, str(source), str(out), upper(), str(out / "summary"))
    assert rows.count() == 3
    assert (out / "a.txt").read_text() == str(source / "a.png").upper() and (out / "b.txt").exists()
    listed = [json.loads(x) for p in (out / "summary").glob("part-*") for x in p.read_text().splitlines()]
    assert [x["image"] for x in listed] == [str(source / n) for n in ("a.jpg", "a.png", "b.webp")]


def test_media(spark):
    rows = spark.createDataFrame([(0, "/d/a.JPG"), (1, "b.tar.png"), (2, ".png"), (3, "x/y"), (4, "a.tiff")], "i int, p string").orderBy("i")
    got = rows.select(media.suffix(F.col("p")), media.stem(F.col("p")), media.mime_type(F.col("p")), media.is_image(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(".jpg", "a", "image/jpeg", True), (".png", "b.tar", "image/png", True), ("", ".png", "application/octet-stream", False), ("", "y", "application/octet-stream", False), (".tiff", "a", "application/octet-stream", True)]
    url = spark.createDataFrame([(bytearray(b"x" * 200),)], "c binary").select(media.data_url(F.lit("a.png"), F.col("c"))).first()[0]
    assert url.startswith("data:image/png;base64,eHh4") and "\n" not in url and "\r" not in url


def test_chat(spark):
    rows = spark.createDataFrame([("http://h/v1//", None), ("http://h/v1", "k")], "b string, k string")
    got = rows.select(chat.endpoint(rows.b).alias("e"), chat.headers(rows.k).alias("h")).collect()
    assert [r.e for r in got] == ["http://h/v1/chat/completions"] * 2
    assert "Authorization" not in got[0].h and got[1].h["Authorization"] == "Bearer k"
    made = json.loads(rows.select(chat.payload("m", F.lit("p é"), F.lit("data:x"))).first()[0])
    assert list(made) == ["model", "temperature", "max_tokens", "messages"]
    assert made["messages"][0]["content"] == [{"type": "text", "text": "p é"}, {"type": "image_url", "image_url": {"url": "data:x"}}]
    requests = spark.createDataFrame([("a",), ("b",)], "request string")
    reply = chat.call(requests, lambda: lambda r: json.dumps({"choices": [{"message": {"content": r * 2}}]}) if r == "a" else '{"e":1}')
    assert {r.request: r.text for r in reply.collect()} == {"a": "aa", "b": '{"e":1}'}


def test_collate(spark):
    rows = spark.createDataFrame([(0, [5, 6, 7]), (1, [8]), (2, [9])], "row_idx long, input_ids array<int>")
    got = collate.collate(rows, 2).orderBy("batch").collect()
    assert got[0].input_ids == [[5, 6, 7], [8, 0, 0]] and got[0].labels == [[5, 6, 7], [8, -100, -100]] and got[1].input_ids == [[9]]
    cut = collate.batches(rows, 2, most=2).filter("row_idx = 0").first()
    assert cut.input_ids == [5, 6]
    given = collate.batches(rows.withColumn("labels", F.when(F.col("row_idx") > 0, F.array(F.lit(1)))), 2).orderBy("row_idx").collect()
    assert [r.labels for r in given] == [[5, 6, 7], [1], [1]]
    with pytest.raises(ValueError, match="input_ids"):
        collate.batches(rows.drop("input_ids"), 2)
    once, again = ([r.row_idx for r in collate.shuffled(rows, 3).collect()] for _ in range(2))
    assert once == again and sorted(once) == [0, 1, 2]


def test_processor(spark):
    rows = spark.createDataFrame([(0, "a.png", "xy"), (1, "b.png", "z")], "row_idx long, image_path string, text string")

    def spell(images, text, max_length):
        return {"input_ids": [[ord(c) for c in t][:max_length] for t in text]}

    got = collate.process(rows, lambda: spell, prompt="> ", most=3).orderBy("row_idx").collect()
    assert [(r.input_ids, r.labels) for r in got] == [([62, 32, 120], None), ([62, 32, 122], None)]
    with pytest.raises(Exception, match="input_ids"):
        collate.process(rows, lambda: lambda **_: {}).collect()


def test_runs(spark, tmp_path):
    steps = spark.range(601)
    assert steps.filter(runs.logs_at(steps.id, 10)).count() == 61
    assert [r.id for r in steps.filter(runs.evaluates_at(steps.id, 200)).collect()] == [200, 400, 600]
    assert steps.filter(runs.evaluates_at(steps.id, 200, False)).count() == 0 and steps.filter(runs.evaluates_at(steps.id, 0)).count() == 0
    assert (runs.total_steps(7, 2), runs.total_steps(7, 2, 5)) == (14, 5)
    path = str(tmp_path / "m")
    for step in (0, 10):
        runs.append_metrics(runs.metric_rows(spark, "r", step, {"train/loss": 1.0}), path)
    assert spark.read.parquet(path).count() == 2
    runs.write_config(InferenceOptions(), str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text())["dtype"] == "bfloat16"
    with pytest.raises(NotImplementedError):
        runs.train()


def test_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"type":"download","url":"u"}\n{"type":"page_error","url":"v","error":"e"}\n')
    query = count_by_type(tail_events(spark, str(log))).writeStream.outputMode("complete").format("memory").queryName("by_type").start()
    try:
        query.processAllAvailable()
        assert {r["type"]: r["count"] for r in spark.table("by_type").collect()} == {"download": 1, "page_error": 1}
    finally:
        query.stop()


def test_commands():
    args = cli.parser().parse_args(["crawl", "--seed_url", "http://h", "--out_dir", "o"])
    assert (args.max_pages, args.max_downloads, args.same_host_only, args.timeout_sec) == (50, 200, 1, 15.0)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["evaluate"])
