import json

import pytest
from pyspark.sql import functions as F

from folioscope.sources import files, templates
from folioscope.streaming import totals


def local(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_labelled_csv_with_quoted_newlines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"two\nlines, ""quoted""",invoice \nplain,quote\n', encoding="utf8")
    assert local(files.scan_labelled_csv(spark, str(tmp_path)), "text", "label") == [("plain", "quote"), ('two\nlines, "quoted"', "invoice")]


def test_json_arrays(spark, tmp_path):
    data = [{"content": "a long enough text body", "type": "Invoice"}, {"a": "first part of text", "b": "second part of text", "n": 1}, {"text": "short"}]
    (tmp_path / "a.json").write_text(json.dumps(data), encoding="utf8")
    got = local(files.scan_json_records(spark, str(tmp_path)), "text", "label", "source")
    assert got == [("a long enough text body", "invoice", "JSON"), ("first part of text second part of text", "document", "JSON")]


def test_loose_csv(spark, tmp_path):
    lines = ["id,remark,kind"] + [f'{i},"some long remark, number {i}",{"receipt" if i % 2 else "quote"}' for i in range(10)]
    (tmp_path / "a.csv").write_text("\n".join(lines), encoding="utf8")
    got = files.scan_csv_records(spark, str(tmp_path))
    assert got.count() == 10 and {r.label for r in got.collect()} == {"receipt", "quote"}
    with pytest.raises(ValueError):
        files.detected_records(spark.range(3), "x")


def test_text_and_annotation_files(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        for i in range(4):
            (tmp_path / folder / f"{i}.txt").write_text(f"  receipt text {folder}{i}\nsecond line \n", encoding="utf8")
    (tmp_path / "a" / "z.txt").write_text("tiny", encoding="utf8")
    got = local(files.scan_text_files(spark, str(tmp_path), limit=3), "source_file", "text")
    assert len(got) == 6 and got[0] == ("0.txt", "receipt text a0\nsecond line")
    (tmp_path / "n.json").write_text(json.dumps({"text": "", "annotations": [{"text": "first"}, {"x": 1}, {"text": "second"}]}), encoding="utf8")
    (tmp_path / "o.json").write_text(json.dumps({"ocr_text": "read by a machine"}), encoding="utf8")
    assert local(files.scan_annotation_json(spark, str(tmp_path)), "text") == [("first second",), ("read by a machine",)]
    counts = {r.extension: (r.files, r.chosen) for r in files.inventory_sources(spark, str(tmp_path)).collect()}
    assert counts == {"txt": (9, False), "json": (2, True)}


def test_bytes(apply):
    rows = [bytearray("é".encode()), bytearray(b"\xef\xbb\xbfabc"), bytearray(b"caf\xe9")]
    assert apply(files.decode_bytes, rows, "content binary") == ["é", "abc", "café"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert files.saved_versions(spark, path) == []
    files.versioned_save(spark.range(5), path)
    files.versioned_save(files.load_version(spark, path).filter("id > 2"), path)
    assert files.saved_versions(spark, path) == [1, 2]
    assert files.load_version(spark, path).count() == 2 and files.load_version(spark, path, 1).count() == 5
    (tmp_path / "corpus" / "version=3").mkdir()  # a write that never finished
    assert files.load_version(spark, path).count() == 2


def test_templates_fill_every_placeholder(spark):
    from folioscope.plans.business_docs import order_fields

    for kind, variants in templates.TEMPLATES.items():
        for t in variants:
            assert all(p in order_fields() for p, is_field in templates.template_parts(t) if is_field), kind


def test_periods_are_complete_over_batches(spark, tmp_path):
    schema = "ts timestamp, category string, cents long"

    def run(name, lateness):
        source, out, checkpoint = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "cp"))

        def load(rows):
            spark.sql("SELECT " + " UNION ALL SELECT ".join(f"timestamp'{t}' AS ts, '{c}' AS category, {n}L AS cents" for t, c, n in rows)).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            totals.write_period_totals(totals.period_totals(stream, "1 day", lateness), out, checkpoint).awaitTermination()

        load([("2024-01-01 10:00:00", "income", 5), ("2024-01-01 11:00:00", "expense", 2), ("2024-01-03 00:00:00", "income", 1)])
        load([("2024-01-01 12:00:00", "income", 100), ("2024-01-05 00:00:00", "income", 1)])
        return local(totals.read_period_totals(spark, out).orderBy("period_start"), "income", "expense", "n")

    # open periods are there, and without a watermark late rows are, too
    assert sorted(run("whole", None)) == [(1, 0, 1), (1, 0, 1), (105, 2, 3)]
    assert sorted(run("marked", "1 hour")) == [(1, 0, 1), (1, 0, 1), (5, 2, 2)]
