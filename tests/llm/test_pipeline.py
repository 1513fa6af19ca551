"""The stages against plain versions of their decisions on a small table, and what they do to odd rows."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from folioscope.llm import mixing, neardup, paragraphs
from test_neardup import brute_force as group
from test_paragraphs import brute_force as repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EN = [f"the{c}ing" for c in "abcdefghijklmnop"] + [f"w{i}th" for i in range(300)]
FR = [f"le{c}eau" for c in "abcdefghijklmnop"] + [f"q{i}é" for i in range(300)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    passage = " ".join(rng.choices(EN, k=60))
    for i in range(240):
        words = FR if i % 4 == 0 else EN
        lines = [" ".join(rng.choices(words, k=rng.randrange(5, 60))) for _ in range(3)]
        if i % 9 == 0:
            lines.insert(1, passage)
        rows.append((i, "\n".join(lines), "fr" if words is FR else "en", "src0" if i % 3 else f"src{i % 5}"))
    rows += [(300 + i, rows[i][1], None, "src9") for i in range(0, 60, 6)]  # copies without a language
    rows += [(400, None, "en", "src0"), (401, "", "en", None), (402, "12 -- 34", "en", "src0"), (None, "the with of", "en", "src1")]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], schema)
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
        out.append(docs.collect())
    return out


def test_stages_are_in_order_and_keep_the_columns(spark, folder, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_paragraphs", "mixture", "packing"]
    assert all([*rows[0].asDict()] == COLUMNS for rows in steps[:-1])


def test_language_rejects_what_has_none(steps):
    before, after = ({r.doc_id: r for r in rows} for rows in steps[:2])
    assert set(before) - set(after) == {400, 401, 402}
    assert all(r.text == before[i].text and r.lang == (before[i].lang or ("fr" if i % 4 == 0 else "en")) for i, r in after.items())


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1]]
    want = {i for i, _, _, stays in group(rows, neardup.PERCENT) if stays}
    assert Counter(r.doc_id for r in steps[2]) == Counter(want) and set(want) & set(range(300, 360)) == set()


def test_repeated_paragraphs_go(steps):
    gone = defaultdict(set)
    for i, place, *_ in repeats([(r.doc_id, r.text) for r in steps[2]], paragraphs.PERCENT, paragraphs.MIN_WORDS):
        gone[i].add(place)
    assert len(gone) > 10
    want = {}
    for r in steps[2]:
        text = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id])
        if text.strip() or not gone[r.doc_id]:
            want[r.doc_id] = (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in steps[3]} == want


def test_mixture_draws_by_probability(spark, steps):
    before = spark.createDataFrame(steps[3], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.doc_id for r in mixing.mix(before).collect() if r.sampled}
    assert {r.doc_id for r in steps[4]} == want and 0 < len(want) < len(steps[3])


def test_packing_holds_every_token(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps[4]}
    got = Counter()
    for r in steps[5]:
        got[r.doc_id] += r.length
    assert got == Counter(want)


def test_run_equals_the_stages(spark, folder, steps):
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    assert pieces == sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids_crc32) for r in steps[5])


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = entry_points.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in (1, 2, 3, 4, 5, 6, 7, 9, 10)) and "pipeline" in names
