import json
import os

import pytest

from glyphmill.functions import results
from glyphmill.sources import examples
from glyphmill.sources.images import decode_images, list_images, read_bytes


def _write(path, lines, end="\n"):
    path.write_text(end.join(lines) + end, encoding="utf-8")
    return str(path)


def _read(spark, path, **options):
    return [tuple(r) for r in examples.read_examples(spark, path, **options).orderBy("row_idx").select("row_idx", "image_path", "text", "id").collect()]


def test_scan(spark, tmp_path):
    lines = ["", '{"image_path":"a/../b.png","text":"x","extra":1}', "  　", '{"image_path":"/abs.png","text":"y","id":""}', '{"image_path":"c.png","text":" z","id":null}', '{"image_path":"c.png","text":"old","text":"new","id":"k"}']
    got = _read(spark, _write(tmp_path / "d.jsonl", lines))
    assert got == [(0, f"{tmp_path}/b.png", "x", "0"), (1, "/abs.png", "y", ""), (2, f"{tmp_path}/c.png", " z", "2"), (3, f"{tmp_path}/c.png", "new", "k")]


@pytest.mark.parametrize("end", ["\r\n", "\r"])
def test_line_ends(spark, tmp_path, end):
    got = _read(spark, _write(tmp_path / "d.jsonl", ['{"image_path":"/a","text":"x"}', '{"image_path":"/b","text":"y"}'], end))
    assert [r[2] for r in got] == ["x", "y"]


@pytest.mark.parametrize("bad", ['{"text":"x"}', '{"image_path":"/a"}', "{", "[1]", '{"image_path":"/a","text":5}'])
def test_bad_lines(spark, tmp_path, bad):
    path = _write(tmp_path / "d.jsonl", ['{"image_path":"/a","text":"x"}', bad])
    with pytest.raises(Exception, match="bad example at row 1"):
        _read(spark, path)
    assert [r.text for r in examples.read_examples(spark, path, strict=False).orderBy("row_idx").collect()] == ["x", None]
    assert len(_read(spark, path, max_samples=1)) == 1  # never parsed


def test_encoding(spark, tmp_path):
    (tmp_path / "bom.jsonl").write_bytes(b'\xef\xbb\xbf{"image_path":"/a","text":"x"}\n')
    with pytest.raises(ValueError, match="byte order mark"):
        _read(spark, str(tmp_path / "bom.jsonl"))
    (tmp_path / "bad.jsonl").write_bytes(b'{"image_path":"/a","text":"\xff"}\n')
    with pytest.raises(Exception, match="bad example"):
        _read(spark, str(tmp_path / "bad.jsonl"))


def test_limits(spark, tmp_path):
    path = _write(tmp_path / "d.jsonl", [json.dumps({"image_path": f"/{i}", "text": "t"}) for i in range(5)])
    assert [len(_read(spark, path, max_samples=n)) for n in (None, 3, 0, -1, 9)] == [5, 3, 1, 1, 5]
    rows = examples.read_examples(spark, path)
    assert [examples.head(rows, n).count() for n in (None, 2, 0, -1, -9)] == [5, 2, 0, 4, 0]
    assert examples.example_at(rows, -1).first().id == "-1" and examples.example_at(rows, 3).first().id == "3"


def test_order_over_many_splits(spark, tmp_path):
    path = _write(tmp_path / "d.jsonl", [json.dumps({"image_path": "/a", "text": f"{i} " * 40}) for i in range(3000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = _read(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r[0] == i and r[2].startswith(f"{i} ") and r[3] == str(i) for i, r in enumerate(got)) and len(got) == 3000


def test_images(spark, tmp_path):
    for name in ("a.jpg", "a.png", "B.PNG", "c.pdf"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.png").write_bytes(b"x")
    paths = [r.path for r in list_images(spark, str(tmp_path)).collect()]
    assert [os.path.basename(p) for p in paths] == ["B.PNG", "a.jpg", "a.png"]
    got = decode_images(read_bytes(spark, str(tmp_path / "a.jpg")), bytes.upper).first()
    assert bytes(got.pixels) == b"A.JPG" and got.mode == "RGB"
    items = spark.createDataFrame([(0, "0", str(tmp_path / "a.jpg"), "t"), (1, "1", str(tmp_path / "no.png"), "t")], "row_idx long, id string, image_path string, text string")
    with pytest.raises(Exception, match="no image at"):
        examples.to_items(items, list_images(spark, str(tmp_path))).collect()


def test_results(spark):
    assert [results.coerce_result(x) for x in ("s", {"text": 5, "result": "r"}, {"pred": "p"}, {"k": 1}, None)] == ["s", "r", "p", "{'k': 1}", "None"]
    rows = spark.createDataFrame([(0, '"s"'), (1, '{"text":5,"result":"r"}'), (2, '{"pred":"p"}'), (3, '{"k":1}'), (4, "null")], "i int, a string")
    assert [r[0] for r in rows.orderBy("i").select(results.coerce_json(rows.a)).collect()] == ["s", "r", "p", '{"k":1}', "None"]
    one = spark.createDataFrame([("q_proj, k_proj,,", "3, 5,3,")], "a string, b string")
    got = one.select(results.split_list(one.a), results.id_set(one.b)).first()
    assert got[0] == ["q_proj", "k_proj"] and got[1] == [3, 5]
