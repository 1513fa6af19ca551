import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import packing
from folioscope.llm.tokens import WordEncoder, text_groups

PATH = public_tokenizers.path("word_bpe_49k.json")


def direct(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    pieces = ["Hello", "WORLD.", "it's", "don't,", "é", "é.", "x́,", "İstanbul.", "ΟΔΟΣ", "a<|endoftext|>b", "<|ENDOFTEXT|>", "12.5", "9.", "...", "!?", "«ok».",
              "你好.", "😀,", "\x1cz", "a\x1fb.", " ", " ", "́", "ﬁ.", "K.", "Å", "E\u0301.", "I\u0307", "\u0958", "क़.", "ΣΣ ΑΣ", "ẞ", "'s", "x's.", "​.", "ǅ.", "_", "a_b."]
    rng = random.Random(3)
    texts = ["", " ", "\n"] + pieces + [rng.choice(["", " "]) + "".join(rng.choice(pieces) + rng.choice([" ", "\n", "\t ", "", " ", " "]) for _ in range(12)) for _ in range(600)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = WordEncoder(PATH)
    assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]


def test_every_letter_alone_and_in_words():
    tokenizer = Tokenizer.from_file(PATH)
    letters = [chr(i) for i in range(0x250)] + [chr(i) for i in range(0x250, 0x20000) if chr(i).isalpha() and chr(i).lower() != chr(i)]
    letters = [c for c in letters if not 0xD800 <= ord(c) < 0xE000]
    texts = [f"{c} a{c}\u0301b {c}{c}. x{c}, {c.upper()}" for c in letters]
    assert WordEncoder(PATH).encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr("folioscope.llm.tokens.MOST_WORDS", 8)
    encoder = WordEncoder(PATH)
    texts = [f"word{i} and other{i % 5}. again" for i in range(40)]
    assert [encoder.encode([t])[0] for t in texts] == encoder.ids(texts)
    assert encoder.encode(texts) == encoder.ids(texts)


def test_words_below_256_go_to_the_merges_and_each_different_one_once(monkeypatch):
    rng = random.Random(5)
    letters = [chr(i) for i in range(0x21, 0x7F)] + [chr(i) for i in range(0xA1, 0x100) if chr(i).isalpha()] + list("''.,ets")
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)) for _ in range(200)]
    assert WordEncoder(PATH).encode(texts) == WordEncoder(PATH).ids(texts)
    encoder, asked = WordEncoder(PATH), []
    merges = encoder.merges
    encoder.merges = lambda piece: asked.append(piece) or merges(piece)
    monkeypatch.setattr(encoder, "letter_words", lambda words: [] if not words else pytest.fail("a text of joined words"))
    monkeypatch.setattr(encoder, "ids", lambda words: [] if not words else pytest.fail("a word on its own"))
    encoder.encode(["erbleon.&&& été, it's 12.5 %%% " * 3, "Été erbleon ,%%% " * 2])
    assert asked.count("it") == asked.count("%%%") == 1 and asked.count(".&&&") == 1 and asked.count("erbleon") < 3


def test_groups_of_texts_hang_on_their_bytes():
    texts = pa.array(["a" * 10, None, "é" * 5, "b" * 25, "", "c"])
    assert text_groups(texts, 20) == [(0, 3), (3, 1), (4, 2)] and text_groups(texts, 1 << 20) == [(0, 6)]
    assert text_groups(texts[2:], 20) == [(0, 2), (2, 2)] and text_groups(texts[:0], 20) == []


def check_plan(counts, capacity, bins=packing.BINS):
    plan, sequences = packing.plan_sequences(counts, capacity, bins)
    spans = defaultdict(list)
    for length, n in counts.items():
        own = plan[plan[:, 0] == length]
        for rank in range(n):
            _, first, start, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            spans[int(start + (rank - first) // each)].append((int(offset + (rank - first) % each * length), length))
    assert set(spans) == set(range(sequences))
    for own in spans.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences, -(-sum(k * n for k, n in counts.items()) // capacity)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100, 512])
    counts = {length: rng.randrange(1, 40) for length in rng.sample(range(1, capacity + 1), min(capacity, 30))}
    check_plan(counts, capacity, rng.choice([4, 16, 256]))


def test_plan_is_tight_and_its_size_does_not_hang_on_the_counts():
    rng = np.random.default_rng(0)
    lengths, n = np.unique(np.clip(rng.lognormal(5, 1, 20_000).astype(int), 1, 1024), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    sequences, least = check_plan(counts, 1024)
    assert sequences <= 1.01 * least
    more = {length: n * 100_000 for length, n in counts.items()}
    plan, sequences = packing.plan_sequences(more, 1024)
    assert len(plan) < 3 * 1024 and sequences <= 1.01 * least * 100_000
    assert packing.plan_sequences({}, 8)[1] == 0 and check_plan({1: 50}, 8) == (7, 7) and check_plan({8: 3}, 8) == (3, 3)
    with pytest.raises(ValueError):
        packing.plan_sequences({9: 1}, 8)


def test_fit_solves_small_cases():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(a @ packing.non_negative_least_squares(a, np.array([4.0, 3]), 20), [4, 3])
    assert (packing.non_negative_least_squares(a, np.array([-1.0, -2]), 20) == 0).all()


def test_pack_documents(spark):
    texts = ["", None, "one two", "same text here", "same text here", "word " * 300, "é ü." * 40]
    rows = [(i, texts[i % len(texts)], "x") for i in range(200)] + [(None, "no id", "x"), (7, texts[0], "x"), (7, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(5)
    out = packing.pack_documents(df, PATH, capacity=128, with_ids=True).collect()
    got, want = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 128 * r.piece
        got[r.doc_id].append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
    for i, text, _ in rows:
        ids = direct(text)
        want[i] += [(k, ids[s : s + 128]) for k, s in enumerate(range(0, len(ids), 128))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    ends = defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 128 and len(ends) <= 1.15 * sum(ends.values()) / 128 + 1
    assert packing.pack_documents(df.filter("false"), PATH).collect() == []


def test_ranks_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(5).alias("ids_crc32"), F.when(F.col("id") % 3 > 0, 9).otherwise(4).cast("long").alias("length"))
    out = packing.ranked(pieces, 2000).collect()
    assert sorted(r["rank"] for r in out if r.length == 9) == list(range(2000))
    assert sorted(r["rank"] for r in out if r.length == 4) == list(range(1000))
