import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tramline.llm import base, packing, records, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize(("path", "kind", "width"), [(BYTE, "byte", 4), (WORD, "word", 2)])
def test_encoder_equals_the_plain_call(path, kind, width):
    e, plain = tokens.Encoder(path, width, cache_bytes=5000), Tokenizer.from_file(path)
    assert e.kind == kind and (kind == "byte" or tokens.Encoder(path).width == width)
    rng = random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "12", "!", "##", "ß", "İ", "Σ", "é", "\u0301", "日本", "\x00", "\x1c", "\x85", "\u00a0", "\u2003", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "ا", "😀", "don't ", "WE'LL"]
    for _ in range(2500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(e.encode(text), f"<u{width}").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_texts_without_spaces_take_no_cache(path):
    e, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    for text in ("日本語" * 4000, "ab" * 6000, "x1" * 6000, "\x00" * 9000, "é" * 9000):
        assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert e.cache.held < 1000
    small = tokens.Encoder(path, cache_bytes=20_000)
    small.encode(" ".join(f"w{i}" for i in range(5000)))
    assert small.cache.held < 21_000


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_met_once_take_no_cache(path):
    e, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    once = " ".join(f"zq{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}xv" for i in range(100))
    for kept in (False, True):
        assert np.frombuffer(e.encode(once), f"<u{e.width}").tolist() == plain.encode(once, add_special_tokens=False).ids
        assert (e.cache.held > 5000) is kept


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_beside_marks_equal_the_plain_call(path):
    e, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    words = ["a", "Word", "étä", "ñb", "don", "s", "ª", "x1", "7", ""]
    marks = [".", ",", ".\n", "$$$", "***", "!!", "'", "'s", ".'", "\n", ".\n\n", "\n.", "_", "-", "|", "§", "..\n"]
    for _ in range(4000):
        text = " ".join("".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(1, 3))) + rng.choice(words) for _ in range(rng.randint(1, 4)))
        assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("ab.\n" * 5000, "ab.\nab," * 5000, "ab." + "\n" * 5000):
        assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_through_the_plain_call(tmp_path):
    import json

    for path in (BYTE, WORD):
        told = json.loads(Tokenizer.from_file(path).to_str())
        for change in ({"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}):
            (tmp_path / "v.json").write_text(json.dumps(told | change))
            e, plain = tokens.Encoder(str(tmp_path / "v.json")), Tokenizer.from_file(str(tmp_path / "v.json"))
            assert e.kind is None
            for text in ("ﬁ one  two", " a <|endoftext|> b", ""):
                assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_best_subset_is_the_best():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 12): rng.randint(0, 3) for _ in range(rng.randint(0, 4))}
        target = rng.randint(0, 30)
        sums = [sum(n * c for n, c in zip(counts, pick)) for pick in product(*(range(c + 1) for c in counts.values()))]
        got = packing.best_subset(counts, target)
        assert all(c <= counts[n] for n, c in got.items())
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= target)


def check_pieces(rows, docs, window):
    tok = Tokenizer.from_file(BYTE)
    want = sorted(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= window
        by_doc[(r.doc_id, r.doc_tokens)].append((r.start, bytes(r.ids)))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= window
    if len({d for d, _ in docs}) == len(docs):
        assert sorted(b"".join(p for _, p in sorted(v)) for v in by_doc.values()) == want
    assert sum(r.length for r in rows) * 4 == sum(map(len, want))
    return by_seq


def test_pack_keeps_every_id(spark, odd, empty):
    from .conftest import ODD

    rows = packing.pack(odd, BYTE, pool=4).collect()
    check_pieces(rows, [(r[0], r[1]) for r in ODD], 1024)
    assert packing.pack(empty, BYTE).collect() == []


def test_pack_wastes_at_most_one_window_a_task(spark):
    docs = [(i, "the same text " * 90) for i in range(200)]  # no two remainders fit a window
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, BYTE, window=256, pool=32).collect()
    by_seq = check_pieces(rows, docs, 256)
    assert sum(sum(n for _, n in s) < 256 for s in by_seq.values()) <= 1


def test_sequences_are_padded_but_for_powers_of_two(spark):
    df = spark.createDataFrame([(1, 0, 3, b"\1\0\0\0\2\0\0\0\3\0\0\0"), (2, 0, 4, bytes(16)), (1, 3, 2, b"\4\0\0\0\5\0\0\0")], "sequence_id long, offset long, length long, ids binary")
    got = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packing.sequences(df, pad_id=9, window=8).collect()}
    assert got == {1: [1, 2, 3, 4, 5, 9, 9, 9], 2: [0, 0, 0, 0]}


def test_records_round_trip(spark, odd, empty):
    from .conftest import ODD

    path = base.scratch_path(spark, "records")
    manifest = records.write_records(odd, path, WORD)
    rows = records.read_records(spark, path, ("doc_id", "start", "n_tokens", "ids", "ids_crc32")).collect()
    rows.sort(key=lambda r: r.start)
    tok = Tokenizer.from_file(WORD)
    want = [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in ODD]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.ids)) for r in rows)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)
    file = next(m["file"] for m in manifest if m["docs"] > 1)
    (second, ids), (first, _) = records.read_at(path, file, [1, 0])
    assert {second, first} <= {d for d, _ in want} and ids.tolist() in [w for _, w in want]
    path = base.scratch_path(spark, "records")
    records.write_records(empty, path, WORD)
    assert records.read_records(spark, path).collect() == []


def test_equal_rows_are_dealt_over_files(spark):
    rows = [(5, "same text")] * 400 + [(6, None)]
    path = base.scratch_path(spark, "records")
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # files of a few bytes would be put together
    try:
        manifest = records.write_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, WORD)
    finally:
        spark.conf.unset(small)
    assert max(m["docs"] for m in manifest) < 300
    got = sorted(records.read_records(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [5] * 400 + [6] and got[-1].ids == [1]


def test_damaged_records_are_refused(tmp_path):
    import io

    whole = records.frame(records.serialize(5, b"\1\0\2\0", 2))
    doc_id, ids = records.parse(records.read_frame(io.BytesIO(whole)))
    assert doc_id == 5 and ids.tolist() == [1, 2]
    for i in range(len(whole)):
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :]))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(whole[:-1]))
