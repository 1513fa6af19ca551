import json
import random

import pytest

from folioscope.sources import files, records


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of some dozen bytes, so that every record and quote lies across the end of one somewhere."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


PIECES = ["word", "two words", 'a ""quoted"" one', "line\nbreak", "\n\n", ",", '""', "é日", " ", "x" * 40, "{", "}", "[1]"]


def field(rng):
    return "".join(rng.choices(PIECES, k=rng.randrange(0, 6)))


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("size,seed", [(17, 1), (64, 2), (100_000, 3)])
def test_quoted_csv_equals_the_whole_file_reader(spark, tmp_path, small_ranges, size, seed):
    rng = random.Random(seed)
    for name in ("a.csv", "b.csv"):
        lines = ["text,label"] + [f'"{field(rng)}",{rng.choice(["invoice", "quote", ""])}' for _ in range(60)]
        (tmp_path / name).write_text("\n".join(lines) + rng.choice(["\n", ""]), encoding="utf8")
    want = spark.read.schema("text string, label string").csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"')
    want = rows_of(want)
    small_ranges(size)
    found = files.csv_rows(spark, str(tmp_path), "text string, label string")
    assert rows_of(found) == want and len(want) == 120
    if size < 100:
        assert records.atoms(spark, str(tmp_path), records.CSV).rdd.getNumPartitions() > 20


def nested(rng, depth=0):
    if depth < 3 and rng.random() < 0.4:
        return {f"k{i}": nested(rng, depth + 1) for i in range(rng.randrange(3))} if rng.random() < 0.6 else [nested(rng, depth + 1) for _ in range(rng.randrange(3))]
    return rng.choice([None, 1, 2.5, True, 'say "hi" \\ {', "}], [{", "tab\tnew\nline", "é日", "", "\\", '\\"', "text " * 10])


@pytest.mark.parametrize("size,indent,seed", [(19, None, 1), (50, 2, 2), (33, 1, 3), (100_000, None, 4)])
def test_json_arrays_are_cut_at_true_ends(spark, tmp_path, small_ranges, size, indent, seed):
    rng = random.Random(seed)
    objects = [{"id": i, "a": nested(rng), "b": nested(rng)} for i in range(80)]
    for name, part in (("a.json", objects[:50]), ("b.json", objects[50:])):
        (tmp_path / name).write_text(json.dumps(part, indent=indent, ensure_ascii=rng.random() < 0.5), encoding="utf8")
    (tmp_path / "c.json").write_text("[]", encoding="utf8")
    (tmp_path / "d.json").write_text('{"id": 900, "a": {"x": [1, {}]}}\n{"id": 901}\n', encoding="utf8")
    small_ranges(size)
    found = records.read_records(spark, str(tmp_path), records.JSON)
    got = sorted((json.loads(r.value) for r in found.collect()), key=lambda o: o["id"])
    assert got == [*objects, {"id": 900, "a": {"x": [1, {}]}}, {"id": 901}]


def test_json_fields_equal_the_whole_file_reader(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    data = [{"content": "body %d %s" % (i, rng.choice(PIECES)), "type": "Invoice", "n": i, "more": {"x": [i]}} for i in range(70)]
    (tmp_path / "a.json").write_text(json.dumps(data), encoding="utf8")
    whole = spark.read.option("multiLine", True).json(str(tmp_path))
    want = sorted((r.content, r.type) for r in whole.collect())
    small_ranges(40)
    got = files.scan_json_records(spark, str(tmp_path))
    assert got.count() == sum(len(body) > 20 for body, _ in want)
    given = files.scan_json_records(spark, str(tmp_path), schema="content string, type string")
    assert rows_of(got) == rows_of(given)


def test_columns_of_numbers_and_times_are_no_candidates(spark, tmp_path):
    lines = ["id,when,flag,remark,kind"] + [f'{i},2024-01-{i + 1:02d},true,"remark, number {i}\nand more of it",{"receipt" if i % 2 else "quote"}' for i in range(20)]
    (tmp_path / "a.csv").write_text("\n".join(lines), encoding="utf8")
    got = files.scan_csv_records(spark, str(tmp_path)).collect()
    assert len(got) == 20 and {r.label for r in got} == {"receipt", "quote"} and all("and more" in r.text for r in got)


def test_files_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\n", encoding="utf8")
    (tmp_path / "b.csv").write_text("", encoding="utf8")
    assert files.scan_labelled_csv(spark, str(tmp_path)).collect() == []
    (tmp_path / "e.json").write_text("[ ]", encoding="utf8")
    assert records.read_records(spark, str(tmp_path / "e.json"), records.JSON).collect() == []
    with pytest.raises(ValueError):
        files.scan_json_records(spark, str(tmp_path / "e.json"))


def test_few_classes_in_a_long_table_are_found(spark):
    # two classes in 300 rows are a share under 0.01, as twenty are in a table of ten thousand
    rows = [(f"row {i} of a table that goes on for long", "all", "invoice" if i % 2 else "receipt") for i in range(300)]
    df = spark.createDataFrame(rows, "remark string, same string, kind string")
    got = files.detected_records(df, "CSV").groupBy("label").count().collect()
    assert {tuple(r) for r in got} == {("invoice", 150), ("receipt", 150)}
