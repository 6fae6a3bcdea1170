"""Packing against a plain best fit and an exact round trip."""

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberscope.llm import packing

PATH = packing.default_tokenizer()


def reference_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def best_fit(sizes, window, opened, gap):
    """Windows as lists of (document, start, length), by a plain search of all open windows; then the open ones."""
    done, now = [], []
    for doc, size in enumerate(sizes):
        start = 0
        while size - start >= window:
            done.append([(doc, start, window)])
            start += window
        while start < size:
            room = lambda w: window - sum(x[2] for x in w)
            fits = [w for w in now if room(w) >= size - start]
            if fits:
                home = min(fits, key=room)
            elif len(now) < opened:
                home = []
                now.append(home)
            else:
                full = min(now, key=room)
                if room(full) > gap:
                    part = room(full)
                    full.append((doc, start, part))
                    start += part
                now.remove(full)
                done.append(full)
                continue
            home.append((doc, start, size - start))
            start = size
            if room(home) == 0:
                now.remove(home)
                done.append(home)
    return done, now


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=80), st.integers(1, 6), st.integers(0, 5))
def test_packer_is_best_fit(sizes, opened, gap):
    packer = packing.Packer(32, opened, gap)
    for doc, size in enumerate(sizes):
        packer.add(packing.Piece(doc, 0, size, np.arange(size, dtype=np.uint32)))
    flat = lambda windows: [[(x.doc, x.start, len(x.ids)) for x in w] for w in windows]
    done, now = best_fit(sizes, 32, opened, gap)
    total = lambda windows: sorted(sum(x[2] for x in w) for w in windows)
    assert total(flat(packer.emitted)) == total(done)  # windows with as much room may be chosen in another order
    left = packer.leftovers()
    assert total(flat(left)) == total(now) and len(left) <= opened
    ends = list(packing.finished(left, 32))
    used = total(flat(ends))
    assert all(x == 32 or x & (x - 1) == 0 for x in used) and sum(used) == sum(total(now))


def checked(spark, rows, schema="doc_id long, text string", **options):
    """Packs the rows and checks every id, offset and sequence; returns the share of padding and the pieces."""
    window = options.get("window", packing.WINDOW)
    frame = spark.createDataFrame(rows, schema).repartition(7)
    got = packing.pieces(frame, PATH, **options).collect()
    want = collections.Counter((i, tuple(reference_ids(t))) for i, t in rows)
    by, sequences, found = collections.defaultdict(list), collections.defaultdict(list), collections.Counter()
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
    for (i, ids), n in want.items():
        if n == 1 and sum(1 for j, _ in want if j == i) == 1:
            at = 0
            for r in sorted(by[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == list(ids[at : at + r.length])
                at += r.length
            assert at == len(ids)
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, sum(r.length for r in got)), got


def test_round_trip(spark):
    pick = random.Random(5)
    pool = ["the", "naïve", "Straße", "日本語", "x1", "été", "🙂", "…", "\n", "  ", "<|endoftext|>", "don't"]
    rows = [(i, " ".join(pick.choice(pool) for _ in range(pick.randrange(120)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "word " * 9000), (903, "a" * 3000), (None, "no id"), (904, "same"), (904, "same"), (905, " \n\t ")]
    share, _ = checked(spark, rows)
    assert share < 0.01
    for options in ({"window": 64, "opened": 3, "fan": 2}, {"window": 64, "opened": 1, "gap": 0, "fan": 2}):
        share, got = checked(spark, rows, **options)
        assert share < 0.01
    assert len({r.sequence_id >> 56 for r in got}) > 3  # merged in several rounds


def test_odd_tables(spark):
    assert packing.pieces(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, {"x": 1})], "doc_id long, text string, start int, part map<string,int>")
    rows = packing.pieces(clash.selectExpr("*", "'q' as ids", "1 as window_no")).collect()
    assert sorted((r.doc_id, r.start, r.length, r.offset) for r in rows) == [(1, 0, 2, 0), (1, 2, 1, 0)]  # three ids, in powers of two
    (row,) = packing.pieces(spark.createDataFrame([("d0", None)], "doc_id string, text string"), bodies=False).collect()
    assert (row.doc_id, row.length, row.ids) == ("d0", 1, None)


def test_sequences_are_padded(spark):
    rows = [(i, "some words of a text " * (1 + i)) for i in range(30)]
    packed = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), window=64, opened=2).cache()
    made = packing.sequences(packed, 64).collect()
    docs = {i: reference_ids(t) for i, t in rows}
    for r in made:
        ids = np.frombuffer(bytes(r.input_ids), "<u4").tolist()
        assert len(ids) == (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 64) and not any(ids[r.n_ids :])
        assert [x for p in r.documents for x in docs[p.doc_id][p.start : p.start + p.length]] == ids[: r.n_ids]
    assert sum(r.n_ids for r in made) == sum(map(len, docs.values()))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab1 '\n\tsé’\xa0ßÄ.,!\x85\x1c²", max_size=80)))
def test_ids_are_those_of_the_tokenizer(text):
    assert [*packing._encode(text, PATH), 0] == reference_ids(text)


@pytest.mark.parametrize("most", [1, 7, 40])
def test_stretches_keep_the_ids(most):
    pick = random.Random(most)
    for _ in range(60):
        text = "".join(pick.choice(["a", "bc", " ", "\n", "  ", "\t", "'s", "1", "é", "。", "\x1c", "\x85"]) for _ in range(200))
        parts = list(packing.stretches(text, most))
        assert "".join(parts) == text
        assert [x for p in parts for x in packing._encode(p, PATH)] == reference_ids(text)[:-1]
