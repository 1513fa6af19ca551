import os
import random

import pytest
from pyspark.sql import functions as F

from folioscope.streaming import ingest

SCHEMA = "doc_id long, text string, lang string"


def loads_of(seed, loads=10):
    """Loads with repeats inside and across them, one text in a third of the rows, nulls and empty texts."""
    rng = random.Random(seed)
    return [[(k * 100 + i, rng.choice(["hot"] * 20 + [None, "", " Padded "] + [f"text {rng.randrange(60)}" for _ in range(40)]), f"l{k}") for i in rng.sample(range(100), 40)] for k in range(loads)]


def brute_force(start, loads, clean):
    seen, out = set(), []
    for rows in [start, *loads]:
        for i, t, lang in sorted((r[0], clean(r[1]), r[2]) for r in rows):
            if t not in seen:
                seen.add(t)
                out.append((i, t, lang))
    return sorted(out)


def strip(text):
    return (text or "").strip(" ")


def prepare(rows):
    return rows.withColumn("text", F.trim(F.coalesce("text", F.lit(""))))


class Source:
    def __init__(self, spark, path):
        self.spark, self.path, self.time = spark, str(path), 1_700_000_000

    def add(self, rows):
        """A file that is newer than all before it."""
        known = set(os.listdir(self.path)) if os.path.exists(self.path) else set()
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.time += 10
        for name in set(os.listdir(self.path)) - known:
            os.utime(f"{self.path}/{name}", (self.time, self.time))

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)


def corpus_rows(spark, path):
    return sorted(tuple(r) for r in ingest.read_corpus(spark, path).select("doc_id", "text", "lang").collect())


@pytest.mark.parametrize("held", [3, 50_000])
def test_ten_loads_keep_the_first_of_each_text(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(ingest, "MOST_HELD", held)
    start, loads = [(9000, "hot", "start"), (9001, "text 3", "start"), (9002, "hot", "start")], loads_of(1)
    ingest.start_corpus(spark.createDataFrame(start, SCHEMA), f"{tmp_path}/corpus")
    source = Source(spark, tmp_path / "in")
    for rows in loads:
        source.add(rows)
    ingest.ingest_stream(source.stream(), f"{tmp_path}/corpus", f"{tmp_path}/cp", prepare).awaitTermination()
    assert corpus_rows(spark, f"{tmp_path}/corpus") == brute_force(start, loads, strip)


def test_restarts_leave_the_same_rows(spark, tmp_path):
    loads = loads_of(2, 6)
    ingest.start_corpus(spark.createDataFrame([], SCHEMA), f"{tmp_path}/corpus")
    source = Source(spark, tmp_path / "in")
    for rows in loads[:2]:
        source.add(rows)
    ingest.ingest_stream(source.stream(), f"{tmp_path}/corpus", f"{tmp_path}/cp", prepare).awaitTermination()
    for rows in loads[2:]:
        source.add(rows)

    def fails(rows):
        """Every load that has a certain row is lost in the middle."""
        stop = F.when(F.col("doc_id") == loads[3][5][0], F.raise_error(F.lit("lost"))).otherwise(F.col("text"))
        return prepare(rows.withColumn("text", stop.cast("string")))

    with pytest.raises(Exception, match="lost"):
        ingest.ingest_stream(source.stream(), f"{tmp_path}/corpus", f"{tmp_path}/cp", fails).awaitTermination()
    assert corpus_rows(spark, f"{tmp_path}/corpus") == brute_force([], loads[:3], strip)  # the loads before it stand
    ingest.ingest_stream(source.stream(), f"{tmp_path}/corpus", f"{tmp_path}/cp", prepare).awaitTermination()
    assert corpus_rows(spark, f"{tmp_path}/corpus") == brute_force([], loads, strip)


def test_a_load_reads_none_of_the_corpus(spark, tmp_path):
    ingest.start_corpus(spark.createDataFrame([], SCHEMA), f"{tmp_path}/corpus")
    source = Source(spark, tmp_path / "in")
    read, looked_up = [], []
    for rows in loads_of(3, 4):
        source.add(rows)
        done = ingest.ingest_stream(source.stream(), f"{tmp_path}/corpus", f"{tmp_path}/cp")
        done.awaitTermination()
        progress = [p for p in done.recentProgress if p["numInputRows"]]
        read.append(sum(p["numInputRows"] for p in progress))
        looked_up.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    assert read == [40, 40, 40, 40]  # the load alone, while the state grows
    assert looked_up == sorted(looked_up) and looked_up[-1] > looked_up[0]


def test_nothing_to_take_in(spark, tmp_path):
    ingest.start_corpus(spark.createDataFrame([], SCHEMA), f"{tmp_path}/corpus")
    os.makedirs(tmp_path / "in")
    ingest.ingest_stream(Source(spark, tmp_path / "in").stream(), f"{tmp_path}/corpus", f"{tmp_path}/cp").awaitTermination()
    assert ingest.read_corpus(spark, f"{tmp_path}/corpus").collect() == []


def test_query_writes_loads_by_all_tasks_and_takes_each_in_as_one_batch(spark, tmp_path, monkeypatch):
    from folioscope.plans import queries

    rows = [(i, f"invoice number {i % 300} for goods" if i % 7 else None, "web") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, parts in (("one", 1), ("four", 4)):
        docs.repartition(parts).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    found = {}
    for name in ("one", "four"):
        monkeypatch.setattr(queries, "scratch_dir", lambda spark, purpose: f"{tmp_path}/{name}/scratch")
        found[name] = sorted(map(tuple, queries.ingest_stream(spark, f"{tmp_path}/{name}").collect()))
    assert found["one"] == found["four"] and found["one"]
    files = [f for f in os.listdir(f"{tmp_path}/four/scratch/loads") if f.endswith(".parquet")]
    batches = [f for f in os.listdir(f"{tmp_path}/four/scratch/checkpoint/commits") if f.isdigit()]
    assert len(files) > 2 * queries.LOADS and len(batches) == queries.LOADS
