import itertools

import pytest
from pyspark.sql import functions as F

from folioscope.operators import corpus, detect, joins, quality


@pytest.fixture(scope="module")
def rows(spark):
    """Labels of very unequal size; a third of all rows share one text."""
    label = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "warm").otherwise(F.concat(F.lit("c"), F.col("id") % 7))
    text = F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 500))
    return spark.range(3000).select(F.col("id").alias("doc_id"), label.alias("label"), text.alias("text")).cache()


def local(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_capping_is_exact_and_repeatable(rows):
    got = local(corpus.cap_per_class(rows, n=50), "label", "doc_id")
    assert sorted(got) == sorted(local(corpus.cap_per_class(rows.repartition(3), n=50), "label", "doc_id"))
    import hashlib

    by_label = {}
    for label, doc in local(rows, "label", "doc_id"):
        by_label.setdefault(label, []).append((hashlib.md5(f"42-{doc}".encode()).hexdigest(), doc))
    want = [(k, d) for k, v in by_label.items() for _, d in sorted(v)[:50]]
    assert sorted(got) == sorted(want)


def test_split_is_complete_and_stratified(rows):
    split = corpus.stratified_split(rows)
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert sum(counts.values()) == 3000
    assert all(counts.get((k, "test"), 0) == int(n * 0.2 + 0.5) for k, n in sizes.items())


def test_split_ignores_labels_when_one_is_alone(spark, rows):
    lonely = rows.unionByName(spark.createDataFrame([(9999, "alone", "x")], rows.schema))
    counts = {r.split: r["count"] for r in corpus.stratified_split(lonely).groupBy("split").count().collect()}
    assert counts == {"test": 600, "train": 2401}


def test_shuffle_rank_is_a_permutation(rows):
    ranks = sorted(r for (r,) in local(corpus.shuffle_rank(rows), "shuffle_rank"))
    assert ranks == list(range(1, 3001))
    assert corpus.shuffle_rows(rows).count() == 3000


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    old = spark.createDataFrame([(5, "a", "x"), (1, "b", "y"), (2, "a", "z"), (3, None, "n")], "pos long, text string, label string")
    new = spark.createDataFrame([(0, "a"), (9, "c"), (8, "c")], "pos long, text string")
    once = corpus.integrate_dedup(old, new)
    assert sorted(local(once, "pos", "text"), key=str) == sorted([(2, "a"), (1, "b"), (3, None), (8, "c")], key=str)
    assert corpus.integrate_dedup(once, once).count() == 4
    report = corpus.integration_report(old, new).first()
    assert (report.existing_rows, report.new_rows, report.final_rows, report.duplicates_removed) == (4, 3, 4, 3)


def test_small_classes_are_dropped(spark):
    df = spark.createDataFrame([("purchase_orders",)] * 3 + [("purchase_order",)] * 2 + [("rare",)] * 4, "label string")
    kept = corpus.merge_and_drop_small(df)
    assert local(kept.distinct(), "label") == [("purchase_order",)] and kept.count() == 5


def test_augmentation(spark):
    df = spark.createDataFrame([(2, "second", "invoice"), (1, "first", "quote"), (3, "x", "receipt"), (4, "y", "receipt")], "pos int, text string, label string")
    got = local(corpus.augment_min_samples(df, classes=["invoice", "quote", "receipt", "payslip"]), "label", "text")
    assert sorted(got) == sorted(
        [("invoice", "second")] * 2 + [("quote", "first")] * 2 + [("receipt", "x"), ("receipt", "y")]
        + [("payslip", "Example document of class payslip")] * 2
    )


def test_class_join_beyond_the_broadcast_limit(spark, rows, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    table = rows.groupBy("label").agg(F.count("*").alias("n"))
    joined = joins.attach_class_table(rows, table, "label")
    assert joined.count() == 3000 and joined.filter("label = 'hot'").first().n == 2400
    assert joins.attach_class_table(rows, table.filter("n > 2000").select("label"), "label", "left_semi").count() == 2400
    assert corpus.cap_per_class(rows, n=50).filter("label = 'hot'").count() == 50


def test_positions_are_consecutive(spark):
    ids = spark.range(-50, 5000, 7).union(spark.range(10_000, 10_050))
    for size in (1_000_000, 20):
        got = sorted(local(joins.with_position(ids, "id", cuts=8, rows_per_bucket=size), "pos", "id"))
        assert [p for p, _ in got] == list(range(1, len(got) + 1))
        assert [i for _, i in got] == sorted(i for _, i in got)
    assert joins.with_position(ids.filter("false"), "id").count() == 0


def brute_similarity(docs, reach):
    out = {}
    for (i, (a, ta)), (j, (b, tb)) in itertools.combinations(enumerate(docs), 2):
        wa, wb = set(ta.lower().split()), set(tb.lower().split())
        if j - i <= reach and wa and wb:
            out[(a, b)] = round(len(wa & wb) / len(wa | wb), 9)
    return out


def test_neighbour_similarity_against_brute_force(spark):
    docs = [(i * 3, " ".join(["w%d" % (i % 4), "Same", "x" * (i % 3)]) if i % 11 else "  ") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.id_a, r.id_b): round(r.similarity, 9) for r in quality.neighbour_similarity(df, reach=4, block=8).collect()}
    assert got == brute_similarity(docs, 4)


def test_near_duplicates_among_first_rows(spark):
    df = spark.createDataFrame([(i, "a b c d") for i in range(30)], "doc_id long, text string")
    row = quality.near_duplicate_pairs(df, first_rows=10).first()
    assert (row.compared, row.similar_pairs, row.near_duplicates) == (90, 90, True)


def test_grades(spark):
    clean = spark.createDataFrame(
        [(i, f"alpha{i} beta{i} gamma {chr(97 + i % 26) * 5} words here number", "a" if i % 2 else "b") for i in range(40)],
        "doc_id long, text string, label string",
    )
    good = quality.quality_grade(clean).first()
    assert good.grade == "A+ (Excellent)" and good.issues == [] and len(good.advice) == 2
    bad = clean.unionByName(spark.createDataFrame([(100, "", "Bad-Label"), (101, "", None), (102, "[PAD] é", "x y_z")], clean.schema))
    worst = quality.quality_grade(bad).first()
    assert worst.grade == "C (Needs Improvement)"
    assert {"Missing values in label", "Empty text fields found", "Duplicate texts found", "OCR artifacts detected", "Label formatting inconsistencies"} <= set(worst.issues)


def test_sampled_checks_divide_by_the_sample(spark):
    df = spark.createDataFrame([(i, "three good words" if i < 5 else "é") for i in range(10)], "doc_id long, text string")
    assert quality.meaningful_ratio(df).first().meaningful_percent == 50.0
    assert quality.meaningful_ratio(df, 1000, 1000).first().meaningful_percent == 0.5
    assert quality.nonprintable_count(df, 4).first().nonprintable_texts == 0


def test_validation_messages(spark):
    df = spark.createDataFrame([("short", "a"), (None, "a"), ("x" * 30, None)], "text string, label string")
    row = quality.validate_cleaned(df).first()
    assert row.issues == ["Null texts found", "Null labels found", "Very short texts still present", "Average text length seems low"]
    assert row.passed is False


def test_profiles_of_an_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, label string, source string")
    assert quality.imbalance_ratio(empty).first().ratio is None
    assert quality.duplicate_count(empty).first().duplicate_texts == 0
    assert corpus.cap_per_class(empty).count() == 0 and corpus.stratified_split(empty).count() == 0


def test_column_detection(spark):
    df = spark.createDataFrame([(f"u{i}", f"long value number {i}", "ab"[i % 2]) for i in range(20)], "code string, remark string, kind string")
    assert (detect.detect_text_column(df), detect.detect_label_column(df)) == ("remark", "kind")
    named = df.withColumnRenamed("code", "body").withColumnRenamed("kind", "class")
    assert (detect.detect_text_column(named), detect.detect_label_column(named)) == ("body", "class")
    assert detect.detect_text_column(spark.range(3)) is None


def test_sparse_columns_are_pruned(spark):
    df = spark.createDataFrame([("t", "l", "s", None), ("t", "l", None, None), ("t", "l", "s", 1)], "text string, label string, source string, word_count int")
    assert detect.prune_sparse_columns(df).columns == ["text", "label", "source"]


def test_company_records(spark):
    schema = "file_name string, document_type string, file_content string, extracted_data struct<text:string,content:string>, chat_format array<struct<content:string>>"
    data = [
        ("a.Invoice.pdf", "", "content of the file, long", None, None), ("contract_3", "Report", "", (None, "extracted content, long"), None),
        ("x", None, None, None, [("first message here",), ("second one",)]), ("y", None, "short", None, None),
    ]
    got = local(detect.flatten_company_record(spark.createDataFrame(data, schema)), "text", "label", "original_label")
    assert got == [
        ("content of the file, long", "receipt", "Invoice"), ("extracted content, long", "contract", "contract"),
        ("first message here second one", "form", "document"),
    ]


def test_split_keeps_rows_without_a_label(spark):
    rows = spark.createDataFrame([(i, f"t{i}", None if i % 3 == 0 else "a") for i in range(60)], "doc_id long, text string, label string")
    split = corpus.stratified_split(rows).collect()
    assert len(split) == 60 and {(r.label, r.split) for r in split} == {(None, "test"), (None, "train"), ("a", "test"), ("a", "train")}
    assert sum(r.split == "test" for r in split if r.label is None) == 4
