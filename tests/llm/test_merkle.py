"""Manifest and proofs against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from emberscope.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return H(*map(field, (i, source, lang, n, text)))


def tree(nodes):
    """Levels from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    """Siblings of each level, and the place among them."""
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
        own[lang] = (mine, tree([leaf(r) for r in mine]))
    above = tree([own[x][1][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        mine, levels = own[lang]
        for at, row in enumerate(mine):
            steps = path(levels, at) + path(above, place)
            value = leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            for left, right in steps:
                value = H(*left, value, *right)
            proof = H(*(x for left, right in steps for x in left + right))
            out.append((row[0], leaf(row), levels[-1][0], above[-1][0], proof, value, value == above[-1][0]))
    return sorted(out, key=repr)


def proven(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in merkle.proven_documents(frame).collect()), key=repr)


def some(seed, n, langs):
    pick = random.Random(seed)
    texts = ["Text", "low", "", None, "ÄÖ Ü", "Z" * 2000]
    return [(i, pick.choice(texts), pick.choice(langs), pick.choice(["s", None, ""]), pick.choice([1, None])) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, [None]), (9, ["en"]), (700, ["en", None, "", "é", "zz", *map(str, range(20))])])
def test_against_plain_python(spark, n, langs):
    rows = some(n, n, langs)
    assert proven(spark, rows) == brute(rows)


def test_ragged_ranges_and_units(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 150)
    monkeypatch.setattr(merkle, "UNIT_BITS", 4)
    rows = some(3, 900, ["a", "a", "a", "b", None])
    assert proven(spark, rows) == brute(rows)


def test_tree_of_two_rounds(spark):
    rows = [(i, "T" if i % 2 else "t", "en", None, i) for i in range(4096 + 4097)]
    assert proven(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(7, "A", "en", None, 1)] * 30 + [(7, "B", "en", None, 1), (None, "A", "en", "s", None), (None, None, None, None, None), (3, "a", "en", "s", 1)]
    assert proven(spark, rows) == brute(rows)
    assert merkle.proven_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tree", "'x' as digest", "2 as unit", "map('a', 1) as kind", "3 as at")
    assert sorted((tuple(r) for r in merkle.proven_documents(clash).collect()), key=repr) == brute(rows)


def test_bodies_fold_to_the_root(spark):
    rows = some(5, 300, ["en", "de", "fr"])
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    got = merkle.proofs(made, bodies=True).collect()
    assert len(got) == 300
    for r in got:
        assert hashlib.sha256(r.proof.encode()).hexdigest() == r.proof_sha256 and len(r.proof) % 64 == 0 and r.root == made.root
    assert made.nodes.count() == made.nodes.select("tree", "level", "index").distinct().count()


def test_missing_is_minimal():
    pick = random.Random(1)
    for size in (1, 2, 8, 9, 64, 100, 513):
        for _ in range(20):
            known = np.unique([pick.randrange(size) for _ in range(pick.randrange(1, 12))])
            have = {(0, int(i)) for i in known}
            lacks = [(level, int(i)) for level, index in merkle.missing(known, size) for i in index]
            n, level, every = size, 0, []
            while n > 1:
                every.append((level, n))
                n, level = -(-n // 8), level + 1
            full = have | set(lacks)
            assert not have & set(lacks)
            for level, n in every:
                for run in {i // 8 for l, i in full if l == level}:
                    children = {(level, i) for i in range(run * 8, min(n, run * 8 + 8))}
                    assert children <= full  # every run touched is whole, so its parent follows
                    assert (level + 1, run) not in lacks  # and nothing that follows is fetched
                    full.add((level + 1, run))
