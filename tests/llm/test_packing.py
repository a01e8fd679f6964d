"""Packing: ids as the library makes them, pieces as a round trip, windows as full as brute force finds."""

import itertools
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from llm_fixtures import ODD, SCHEMA, docs_of
from tokenizers import Tokenizer

from spindrift.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_rows(rows, ids_of, capacity):
    """Every id of every document in one piece, offsets without gaps, no window beyond its capacity; the padding."""
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert documents.keys() == ids_of.keys()
    for doc, pieces in documents.items():
        ids, at = np.array(ids_of[doc], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at
    return padding, len(sequences)


def odd_texts(rng, n):
    alone = [chr(c) for c in range(0x280)]
    parts = ["'s", "'S", "'re", "'LL", "'l", "'", '"', "it", "IT", "é", "É", "é", "1", "²", " ", "\n", " ", "\u0085", " ", "中", "<|", "<|endoftext|>", "İ", "Ⱥ", "Ɓ", "K", "ẞ", "\x00", "\x1c", "’s", "😀", "ſ", "ΣΣ "]
    texts = [f"a{c}b" for c in alone] + [c + c for c in alone] + [f"1{c}'s" for c in alone]
    texts += ["".join(rng.choice(alone) for _ in range(rng.randrange(40))) for _ in range(n)]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3 * n)]


def test_ids_are_the_librarys(monkeypatch):
    library, texts = Tokenizer.from_file(PATH), ODD + odd_texts(random.Random(1), 700)
    want = [library_ids(library, t) for t in texts]
    for stretch, cache in ((4 << 20, 500_000), (2000, 500_000), (4 << 20, 50)):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        monkeypatch.setattr(packing, "CACHE", cache)
        encode = packing.Encoder(PATH)
        for _ in range(2):
            assert [x.tolist() for x in encode(pa.array(texts, pa.string()))] == want
    assert packing.Encoder(PATH)(pa.array([], pa.string())) == []


def test_ids_of_another_vocabulary_are_the_librarys_too(spark):
    rng = random.Random(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.arrays_stand_for(PATH) and not packing.arrays_stand_for(path)
    library = Tokenizer.from_file(path)
    texts = odd_texts(rng, 60) + ["Hello World, it's 2024 THE end", "", None, "a <|endoftext|> b"]
    want = [[*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]
    assert [x.tolist() for x in packing.Encoder(path)(pa.array(texts))] == want
    rows = packing.pack(docs_of(spark, texts), 64, path).collect()
    check_rows(rows, dict(enumerate(want)), 64)


def test_a_window_is_as_full_as_brute_force_finds():
    rng = random.Random(2)
    for _ in range(300):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        capacity = rng.randrange(1, 90)
        chosen = Counter(dict(packing.fill(Counter(lengths), capacity)))
        assert all(n <= Counter(lengths)[x] for x, n in chosen.items())
        fit = [x for x in lengths if x <= capacity]
        if not fit:
            assert not chosen
            continue
        rest = list(fit)
        rest.remove(max(fit))
        best = max(max(fit) + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if max(fit) + sum(c) <= capacity)
        assert sum(x * n for x, n in chosen.items()) == best and chosen[max(fit)] >= 1


def test_packing_is_a_round_trip(spark):
    rng = random.Random(4)
    texts = ODD + odd_texts(rng, 20)[::7]
    texts += [" ".join(rng.choice(["It's", "naïve", "x²", "!!", "ab_c", "中文", "<|endoftext|>"]) + str(rng.randrange(9)) for _ in range(rng.randrange(0, 300))) for _ in range(100)]
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(docs_of(spark, texts).repartition(3), capacity=64).collect()
    padding, windows = check_rows(rows, {i: library_ids(library, t) for i, t in enumerate(texts)}, 64)
    assert padding < 0.01 * 64 * windows
    assert packing.pack(docs_of(spark, texts).repartition(3), capacity=64).count() == len(rows)


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "one two", "en", "x", "y")] * 3 + [(5, None, "en", "x", "y")] * 2, SCHEMA)
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id is None, r.length, r.doc_tokens) for r in rows) == [(False, 1, 1)] * 2 + [(True, 3, 3)] * 3
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5
    assert packing.pack(docs.limit(0)).collect() == []


def test_lengths_of_which_no_two_fit_leave_no_padding(spark):
    """20,000 pieces of 2,100 to 4,000 tokens: what waits stays bounded, and the time is in proportion."""
    rng = random.Random(5)
    lengths = [rng.randrange(2100, 4000) for _ in range(20_000)]
    took = []
    for n in (5_000, 20_000):
        # one id a letter, so a text of k signs apart has k ids and the end id
        docs = spark.createDataFrame([(i, "! " * (k - 1)) for i, k in enumerate(lengths[:n])], "doc_id bigint, text string").coalesce(1)
        began = time.time()
        found = packing.pack(docs)
        took.append(time.time() - began)
        totals = found.groupBy("sequence_id").sum("length").collect()
        used = sum(r[1] for r in totals)
        assert used == sum(lengths[:n]) and len(totals) * packing.CAPACITY - used < packing.CAPACITY
    assert took[1] < 8 * took[0] + 5
