"""The scanned files of scan_text_files are bounded, and what they add up to does not hang on their size."""

from folioscope.plans import queries
from folioscope.sources import files


def test_no_file_holds_a_source(spark, tmp_path, monkeypatch):
    rows = [(i, f"  text {i} of a document, {'word ' * (i % 9)} \n", "hot" if i % 3 else f"s{i % 4}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    scan, longest = files.scan_text_files, []

    def seen(session, folder, **options):
        out = scan(session, folder, **options)
        longest.append(max(len(r.text) for r in out.collect()))
        return out

    monkeypatch.setattr(files, "scan_text_files", seen)
    monkeypatch.setattr(queries, "documents", lambda s, d: s.read.parquet(f"{d}/documents.parquet"))
    want = {}
    for _, text, source in rows:
        want[source] = want.get(source, "") + text + "\n"
    for size in (1000, 1 << 30):
        monkeypatch.setattr(queries, "TEXT_FILE_BYTES", size, raising=False)
        got = [tuple(r) for r in queries.scan_text_files(spark, str(tmp_path)).collect()]
        assert got == [("receipt", len(want), sum(len(t.strip()) for t in want.values()))]
    assert longest[0] < 6000 < longest[1]
