"""Encoding, counting and packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from pathglow.llm.bpe import TokenCounter, counter, encoder  # noqa: E402
from pathglow.llm.packing import OpenWindows, pack  # noqa: E402
from pathglow.llm.tokenize import encode_decode, token_counts  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
word, byte = tokenizers.Tokenizer.from_file(WORD), tokenizers.Tokenizer.from_file(BYTE)
ODD = ["", " ", "\n\n", "a\xa0b \xa0 c", "İstanbul ΣΑΣ Σ", "é x́", "<|endoftext|> a<|endoftext|>b <|startoftext|>x", "<|EndOfText|>", "it's I'LL we've 's 'S", "a\x1cb\x1d c", "漢字 　 x", "🙂🙂 👩‍👩‍👧", "12345 ½ ² x²", "\x85 \x85a", "a  b   c\n\n\td  ", "Ⅷ ｂ ǅ ß ẞ ﬁ", "ab" * 500 + " " + "é" * 700]
TEXT = st.text(alphabet=st.sampled_from("abcdefé Ωσς'!?.<|>0123 \n\t\xa0 　ñü漢🙂́ǅİtheing"), max_size=60)


def same_as_library(text: str) -> None:
    own, codec = np.frombuffer(encoder(WORD).encode(text), "<u4").tolist(), encoder(WORD)
    ids = word.encode(text, add_special_tokens=False).ids
    assert own == ids
    assert codec.decode(codec.encode(text)) == word.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same_as_library(text)
    assert counter(BYTE).count(text) == len(byte.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text_encodes_as_the_library_does(text):
    same_as_library(text)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text_counts_as_the_library_does(text):
    assert counter(BYTE).count(text) == len(byte.encode(text, add_special_tokens=False).ids)


def test_no_token_spans_a_forced_boundary():
    codec = encoder(WORD)
    for raw in ("straßenbahnén".encode(), "çé".encode(), b"internationalization"):
        assert b"".join(codec.fragments(raw)) == raw
    assert any(len(codec.fragments(w.encode())) > 1 for w in ("réeuxè", "ñççé", "éèêç"))


def test_heap_and_list_merging_agree():
    merges = encoder(WORD).merges
    rng = random.Random(5)
    for _ in range(300):
        symbols = [encoder(WORD).inner[ord(rng.choice("theinganosr"))] for _ in range(rng.randint(1, 39))]
        by_heap = list(symbols)
        n = merges._run(by_heap)
        by_heap = [s for s in by_heap if s >= 0]
        assert merges.merged(list(symbols)) == by_heap and len(symbols) - n == len(by_heap)


def test_tables(spark, odd_documents, no_documents):
    plain = sorted(((r["doc_id"], r["text"] or "") for r in odd_documents.collect()), key=str)
    got = sorted(((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in encode_decode(odd_documents, WORD).collect()), key=str)
    ids = {t: word.encode(t, add_special_tokens=False).ids for _, t in plain}
    assert got == sorted(((i, np.array(ids[t], "<u4").tobytes(), word.decode(ids[t], skip_special_tokens=False)) for i, t in plain), key=str)
    counts = sorted((tuple(r) for r in token_counts(odd_documents, BYTE).collect()), key=str)
    n = {t: len(byte.encode(t, add_special_tokens=False).ids) for _, t in plain}
    assert counts == sorted(((i, len(t.encode()), n[t], n[t] > 1024) for i, t in plain), key=str)
    assert encode_decode(no_documents, WORD).count() == token_counts(no_documents, BYTE).count() == pack(no_documents, WORD).count() == 0


def check_packing(pieces, ids: dict, capacity: int) -> None:
    """Every id in one piece, sequences gapless and within the capacity. ``ids`` by document; documents may repeat."""
    sequences: dict = {}
    by_doc: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append(p)
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= capacity
    for doc, own in by_doc.items():
        copies = ids[doc]
        covered = {len(c): np.zeros(len(c), np.int64) for c in copies}
        for p in own:
            covered[p["doc_tokens"]][p["start"] : p["start"] + p["length"]] += 1
            assert any(p["doc_tokens"] == len(c) and zlib.crc32(np.array(c[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for c in copies)
        for n, times in covered.items():
            assert (times == sum(len(c) == n for c in copies)).all()


@pytest.mark.parametrize(("capacity", "windows", "parts"), [(4096, 64, 1), (128, 2, 3), (64, 4, 5)])
def test_packing(spark, odd_documents, capacity, windows, parts):
    ids: dict = {}
    for r in odd_documents.collect():
        ids.setdefault(r["doc_id"], []).append([*word.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    pieces = pack(odd_documents.repartition(parts), WORD, capacity=capacity, open_windows=windows).collect()
    assert {p["doc_id"] for p in pieces} == set(ids)
    check_packing(pieces, ids, capacity)


def test_open_windows_stay_bounded():
    rng = random.Random(1)
    open_, emitted = OpenWindows(0, 100, 5), 0
    for i in range(3000):
        n = rng.randint(1, 100)
        emitted += sum(p[1] for p in open_.place([i, n], n))
        assert len(open_.room) <= 5
    filled = {p[2]: p[4] for p in open_.leftovers()}
    assert len(filled) <= 5


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_padding_stays_small(spark, data, parts):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lengths: dict = {}
    for p in pack(docs.repartition(parts), WORD).collect():
        lengths[p["sequence_id"]] = lengths.get(p["sequence_id"], 0) + p["length"]
    padding = sum(4096 - n for n in lengths.values() if n & (n - 1))
    assert padding <= 0.02 * sum(lengths.values()) + 4096  # leftovers end in one short sequence


@pytest.mark.parametrize("kind", ["int", "string", "decimal(9,2)", "date"])
def test_ids_of_any_type(spark, kind):
    raw = {"int": [7, None, 9], "string": ["a", None, ""], "decimal(9,2)": [1.5, None, 2.25], "date": ["2020-01-02", None, "1969-12-31"]}[kind]
    docs = spark.createDataFrame([(None if i is None else str(i), t) for i, t in zip(raw, ["one two", "", None], strict=True)], "doc_id string, text string")
    docs = docs.withColumn("doc_id", docs.doc_id.cast(kind))
    for df in (pack(docs, WORD), encode_decode(docs, WORD), token_counts(docs, BYTE)):
        assert df.schema["doc_id"].dataType.simpleString() == kind
        assert sorted(map(str, (r["doc_id"] for r in df.collect()))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))


def test_every_character_is_classed_as_the_library_does():
    """Letters, numbers and small letters of the Unicode that the library knows, not of another."""
    codec, count = encoder(WORD), TokenCounter(BYTE).count
    characters = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x33480), *range(0x33480, 0x110000, 61)]]
    for at in range(0, len(characters), 20_000):
        texts = [f"a{c}b {c} 1{c}" for c in characters[at : at + 20_000]]
        for text, ids, n in zip(texts, word.encode_batch(texts, add_special_tokens=False), byte.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids.ids, text.encode("unicode_escape")
            assert count(text) == len(n.ids), text.encode("unicode_escape")


def test_slices_read_like_whole_batches():
    """Arrow's ascii_lower misreads slices; the shared reader copies them."""
    import pyarrow.compute as pc

    from pathglow.llm.common import parts, text_column

    texts = [f"Text NUMBER {i} " * 200 for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    cut = list(parts(batch, "text", 5000))
    assert len(cut) > 5
    assert [t for p in cut for t in pc.ascii_lower(text_column(p, "text")).to_pylist()] == [t.lower() for t in texts]


def test_new_words_ask_for_ranks_only_where_they_merge():
    """The ranks of a word's bytes side by side lie in tables: the dictionary of merges is asked for the neighbours of a merge alone."""
    import public_tokenizers

    from pathglow.llm.bpe import ForcedBoundaryEncoder

    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    encoder = ForcedBoundaryEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rank = encoder.merges.rank = Counting(encoder.merges.rank)
    for word in ("Vraxilomquet", "ozzyphlarb", "kwijibo"):
        rank.asked = 0
        tokens = len(encoder.encode(word)) // 4
        assert 1 < tokens < len(word) and rank.asked <= 2 * (len(word) - tokens)
