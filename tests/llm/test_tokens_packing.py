import random
import zlib
from collections import Counter as Bag

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from termweave.llm import common, editcount, packing, tokens


def library(specials):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = not specials
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own_library():
    return library(False)


ODD = ["", " ", "  ", "a", "a  b", "a \n b", "\n\n  x", "don't we'll I'm 'tis", "x  ", "é  y", "12345 ½ ² 一二", "foo\nbar  baz\tqux", "<|endoftext|>", "a" * 3000, "  \n \t ", "\x1c \x1d a", "日本語 テスト", "...!!! ???"]


def test_ids_are_those_of_the_file(spark, own_library):
    encoder = tokens.Encoder()
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == own_library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "a", " ", "\n", "b c", "<", "|>"]), max_size=8).map("".join), st.booleans())
def test_special_strings_either_way(text, specials):
    """As ordinary text (the default), and as the tokens that the file's library makes of them unless told otherwise."""
    known = test_special_strings_either_way.__dict__.setdefault(specials, (tokens.Encoder(specials=specials), library(specials)))
    assert np.frombuffer(known[0].ids(text), "<u4").tolist() == known[1](text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t'sl1.é　", max_size=30))
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    t = test_ids_of_any_text.__dict__.setdefault("t", Tokenizer.from_file(tokens.default_path()))
    encoder = tokens.Encoder()
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert int(tokens.Counter().counts(text)[:, 1].sum()) == len(encoder.ids(text)) // 4


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_patterns_hold_every_length(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    held = Bag()
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 64
        for x in lengths:
            held[x] += count
    assert dict(held) == histogram


def test_pack_places_every_id_once(spark, own_library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, "word " * 3000), (91, "word " * 3000), (None, "x")]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, rank int")
    out = packing.pack(df, size=128).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, text in rows:
        ids = np.array(own_library(text or "") + [0], dtype="<u4")
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[key]})
        at = 0
        for start, length, crc, n in pieces:
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert len(by_doc[91]) == 2 * len({r.start for r in by_doc[91]})
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert packing.pack(df.limit(0), size=128).count() == 0


def test_padding_is_small(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack(df)
    used, n = out.selectExpr("sum(length)", "max(sequence_id) + 1").head()
    assert used / (1024 * n) > 0.98


def test_edits_count_like_a_new_text(own_library):
    counter, rng = tokens.Counter(), random.Random(5)
    pieces = ["a", " ", "  ", "\n", "word", " more", "'s", "'", "l", "12", "!?", "é", "　", "\t"]
    for _ in range(150):
        edited = editcount.EditedText("".join(rng.choices(pieces, k=rng.choice([0, 3, 40, 900]))), counter)
        for _ in range(6):
            start = rng.randint(0, len(edited.text))
            edited.edit(start, start + rng.choice([0, 1, 2, 5, 300]), "".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 200]))))
            assert edited.tokens == len(own_library(edited.text))
            assert (edited.tree.chars if edited.tree else 0) == len(edited.text)
            # The tree as kept is the same.
            assert np.array_equal(editcount.leaves_of(editcount.load(editcount.dump(edited.tree))), editcount.leaves_of(edited.tree))


def test_edits_touch_little():
    edited = editcount.EditedText("some words here " * 20_000, tokens.Counter())
    edited.edit(160_000, 160_003, "other")
    assert edited.encoded < 200


def heights(tree):
    if tree is None or tree.block is not None:
        return 0
    assert abs(heights(tree.left) - heights(tree.right)) <= 2
    return tree.height


def test_trees_stay_balanced():
    rng, counter = random.Random(9), tokens.Counter()
    edited = editcount.EditedText("some words here " * 5000, counter)
    for _ in range(300):
        at = rng.randrange(len(edited.text))
        edited.edit(at, at + rng.choice([0, 3, 4000]), rng.choice(["x", "new words " * 300, ""]))
        assert heights(edited.tree) <= 2 * np.log2(2 + edited.pretokens / 8) + 4
    assert edited.tokens == editcount.EditedText(edited.text, counter).tokens


def test_apply_edits_on_odd_rows(spark, own_library):
    rows = [(1, "one two three", [(4, 7, "2")], "x"), (2, None, [(0, 5, "new")], "x"), (3, "same", None, "x"), (None, "a", [None, (9, 2, None)], "x"), (3, "same", [], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, n_tokens string")
    expected = [(1, "one 2 three"), (2, "new"), (3, "same"), (3, "same"), (0, "a")]
    want = sorted((k, t, len(own_library(t)), len(t)) for k, t in expected)
    for start in (df, editcount.with_trees(df)):  # trees are counted where there are none
        got = sorted((r.doc_id or 0, r.text, r.tokens_after, r.chars_after) for r in editcount.apply_edits(start).collect())
        assert got == want
    assert editcount.apply_edits(editcount.with_trees(df.limit(0))).count() == 0


def test_a_second_run_starts_from_the_kept_trees(spark, own_library):
    """Trees go through a table; the second run encodes what its edits touch and nothing else."""
    df = spark.createDataFrame([(i, f"words of text {i} " * 3000) for i in range(4)], "doc_id long, text string")
    edit = lambda at, new: F.array(F.struct(F.lit(at).alias("start"), F.lit(at + 4).alias("end"), F.lit(new).alias("text")))
    once = common.stored(editcount.apply_edits(editcount.with_trees(df.withColumn("edits", edit(20_000, "first change")))))
    twice = editcount.apply_edits(once.withColumn("edits", edit(100, "second")))
    for r in twice.collect():
        assert r.tokens_after == len(own_library(r.text)) and "first change" in r.text and r.text[100:106] == "second"
        assert r.chars_encoded_again < 200
    assert sorted((r.doc_id, r.tokens_after) for r in once.collect()) == sorted((r.doc_id, r.n_tokens) for r in twice.collect())
