"""Exact, near and partial duplicates against brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelmill.llm import components, exact, jaccard, lines, substrings

from .helpers import LOWER, Union, corpus, frame, spaced


def shingles(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    sets = {i: shingles(t) for i, t in rows}
    groups = Union(sets)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                groups.join(i, j)
    return {i: (len(s), groups.root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("seed", "families", "size", "hot"), [(1, 8, 6, 8), (2, 3, 40, 8), (3, 14, 3, 2)])
def test_near_duplicates(spark, monkeypatch, seed, families, size, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)  # so that small families exercise the way for blocks that many share
    rows = corpus(seed, families, size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize("hot", [8, 2])
def test_near_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = corpus(5, 4, 12)
    sets = {i: shingles(t) for i, t in rows}
    want = {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and a and a != b and 100 * len(a & b) >= 80 * len(a | b)}
    pairs, members = jaccard.near_pairs(frame(spark, rows))
    of = {}
    for r in members.collect():
        of.setdefault(r["class"], []).append(r.doc_id)
    got = [tuple(sorted((i, j))) for r in pairs.collect() for i in of[r.a] for j in of[r.b]]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_of_one_id(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, "quite another text of its own here"), (2, base + " more"), (2, base), (0, "quite another text of its own here now")]
    got = sorted((r.n_shingles, r.doc_id, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 2, 2), (4, 0, 0), (56, 1, 1), (56, 2, 1), (57, 2, 1)]
    text = {r.t: r.component_id for r in jaccard.near_duplicates(frame(spark, [(f"k{i}", t) for i, (_, t) in enumerate(rows)], extra=False).withColumn("t", F.col("doc_id")), carry=("t",)).collect()}
    assert text == {"k0": "k0", "k1": "k1", "k2": "k0", "k3": "k0", "k4": "k4"}


def test_near_duplicates_repeated_null_and_empty(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == [("1", 2, "1"), ("3", 2, "1"), ("3", 2, "1"), ("7", 0, "7"), ("8", 0, "8"), ("None", 2, "None")]
    assert jaccard.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_sketches_never_lose_a_link():
    import random

    import numpy as np

    rng, sketch = random.Random(5), jaccard.Sketch(80, 100)
    for n in (4, 5, 9, 40, 63, 64, 70, 79, 80, 200, 256, 300, 1100):
        for _ in range(12):
            base = [rng.getrandbits(64) for _ in range(n)]
            cut = rng.randint(0, n // 5)
            a = np.unique(np.array(base, np.uint64))
            b = np.unique(np.array(base[cut:] + [rng.getrandbits(64) for _ in range(rng.randint(0, n // 8))], np.uint64))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                shared = np.intersect1d(sketch.signatures(a), sketch.signatures(b))
                assert len(shared) > 0
                assert sketch.may_link(len(a), len(b), sketch.vector(a), sketch.vector(b))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (21, 20), (4, 4)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}


@pytest.mark.parametrize("bits", [8, 20, 33, 56, 63])
def test_counting_quotient_filter(bits):
    import numpy as np

    rng = np.random.default_rng(bits)
    for n in (0, 1, 5, 100, 3000):
        base = rng.integers(0, 1 << min(bits, 62), n).astype(np.uint64)
        seen = np.concatenate([base, base[: n // 3], np.repeat(base[:3], 700)])
        want, number = np.unique(seen, return_counts=True)
        whole = exact.counted(seen, bits)
        for f in (whole, exact.Filter.unpacked(whole.packed()), exact.merged(exact.counted(seen[k::5], bits) for k in range(5))):
            got, times = f.entries()
            assert got.tolist() == want.tolist() and times.tolist() == number.tolist()
        others = rng.integers(0, 1 << min(bits, 62), 500).astype(np.uint64)
        assert whole.holds(want).all() and (whole.holds(others) == np.isin(others, want)).all()
        # each quotient has one run, its remainders rise, and no run begins before its slot
        quotient, first, last = whole._runs()
        assert quotient.tolist() == sorted({int(x) >> whole.r for x in want.tolist()})
        assert (first >= quotient).all() and (first[1:] > last[:-1]).all()
        for a, b in zip(first, last):
            run = whole.slots[a : b + 1][~whole.counts[a : b + 1]].tolist()
            assert run == sorted(set(run))
    assert bits < 20 or len(whole.packed()) <= 24 + len(want) * 2.3 * (whole.r + 3) / 8 + 64


def test_exact_duplicates_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (3, "a"), (3, "a"), (3, "B"), (None, None), (None, ""), (9, "q")]
    for sent in (10, 0):
        out = exact.deduplicated(frame(spark, rows, extra=False), most_sent=sent).collect()
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out)
        assert got == sorted([("None", "3", 4, False), ("None", "3", 4, False), ("3", "3", 4, True), ("3", "3", 4, True), ("None", "3", 2, False), ("3", "3", 2, True), ("None", "None", 2, True), ("None", "None", 2, True), ("9", "9", 1, True)])


@pytest.mark.parametrize(("bits", "sent"), [(None, 1000), (None, 0), (3, 1000), (3, 0)])
def test_exact_duplicates(spark, bits, sent):
    rows = corpus(4)
    low = {i: (t or "").translate(LOWER) for i, t in rows}
    want = {i: (max(j for j in low if low[j] == t), sum(x == t for x in low.values()), hashlib.sha256(t.encode()).hexdigest()) for i, t in low.items()}
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256, r.kept) for r in exact.deduplicated(frame(spark, rows), fp_bits=bits, most_sent=sent).collect()}
    assert got == {i: (*w, w[0] == i) for i, w in want.items()}
    assert exact.deduplicated(frame(spark, rows).limit(0)).count() == 0


def covered(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = {x for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1 for x in range(k, k + length)}
        out[i] = (len(b), len(gone), sum(x - 1 not in gone for x in gone), bytes(y for x, y in enumerate(b) if x not in gone))
    return out


@pytest.mark.parametrize(("seed", "pairs", "crowd"), [(1, 32, 20_000), (6, 2, 20_000), (1, 32, 2)])
def test_repeated_substrings(spark, monkeypatch, seed, pairs, crowd):
    monkeypatch.setattr(substrings, "PAIRS", pairs)
    monkeypatch.setattr(substrings, "HOT_GROUP", crowd)
    monkeypatch.setattr(substrings, "HELD", 50)
    rows = corpus(seed, 5, 4)
    out = substrings.without_repeats(frame(spark, rows)).collect()
    got = {r.doc_id: (r.n_bytes, sum(x.hi - x.lo for x in r.removed), len(r.removed), bytes(r.kept)) for r in out}
    assert got == covered(rows, 200)
    assert substrings.without_repeats(frame(spark, rows).limit(0)).count() == 0


def test_repeated_substrings_of_any_rows(spark, monkeypatch):
    """Null ids, repeated ids with different texts, repeated rows, ids that are strings; grams settled in small groups."""
    monkeypatch.setattr(substrings, "HELD", 5)
    rows = corpus(2, 4, 3)
    texts = [t for _, t in rows] + [rows[20][1], "é" * 230, "q" * 450]
    for ids in ([None if i % 3 else 7 for i in range(len(texts))], [f"k{i % 4}" for i in range(len(texts))]):
        out = substrings.without_repeats(frame(spark, list(zip(ids, texts)), extra=False)).collect()
        got = sorted((str(r.doc_id), r.n_bytes, sum(x.hi - x.lo for x in r.removed), len(r.removed), bytes(r.kept)) for r in out)
        assert got == sorted((str(ids[i]), *x) for i, x in covered(list(enumerate(texts)), 200).items())


def test_deep_shallow_order():
    import random

    rng = random.Random(8)
    base = bytes(rng.choice(b"ab") for _ in range(120))
    strings = [base[:k] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) for k in range(0, 120, 2)] + [base, base, b"", b"", b"a"]
    order, shared = substrings.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings)
    assert shared[1:] == [substrings.common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def later_runs(rows, least):
    seen, out = {}, {}
    for i, t in rows:
        parts = (t or "").split("\n")
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if sum(len(x.split()) for x in parts[a:b]) >= least:
                    seen.setdefault(tuple(parts[a:b]), []).append((i, a, b))
    gone = {i: set() for i, _ in rows}
    for places in seen.values():
        for i, a, b in sorted(places)[1:]:
            gone[i].update(range(a, b))
    for i, t in rows:
        out[i] = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i])
    return gone, out


@pytest.mark.parametrize("least", [1, 20, 45])
def test_repeated_lines(spark, least):
    rows = corpus(9, 7, 4) + [(900, "p q\n\n\nr s\nt " * 3), (901, "p q\n\n\nr s\nt " * 2)]
    gone, kept = later_runs(rows, least)
    for r in lines.deduplicated(frame(spark, rows), least_words=least).collect():
        assert sum(x["size"] for x in r.removed_runs) == len(gone[r.doc_id]), r.doc_id
        assert (r.kept_text or "") == kept[r.doc_id]
    assert lines.deduplicated(frame(spark, rows).limit(0)).count() == 0


def test_suffixes_of_lines_are_sorted(spark):
    """At every level ranks are the places of first suffixes in the order of their first 2^k lines."""
    import random

    rng = random.Random(3)
    seqs = {k: [bytes([rng.choice(b"abc")]) for _ in range(rng.randint(1, 14))] for k in range(30)}
    rows = [(k, i, x) for k, s in seqs.items() for i, x in enumerate(s)]
    ranks = lines.ordered(spark.createDataFrame(rows, "name long, line long, key binary"), ["key"], len(rows))
    for width in (1, 2, 4, 8):
        got = {(r.name, r.line): r["rank"] for r in ranks.collect()}
        first = {(k, i): tuple(s[i : i + width]) for k, s in seqs.items() for i in range(len(s) - width + 1)}
        count = Counter(first.values())
        tied = sorted((x, p) for p, x in first.items() if count[x] > 1)
        want = {}
        for place, (x, p) in enumerate(tied):
            want[p] = want[tied[place - 1][1]] if place and tied[place - 1][0] == x else place
        assert got == want
        ranks = lines.ordered(lines.doubled(ranks, width), ["rank", "rank2"], len(rows))


def test_repeated_lines_of_any_ids(spark):
    long = "\n".join(" ".join(f"w{i}_{k}" for k in range(12)) for i in range(6))
    rows = [(5, long), (5, long), (None, long), (None, "x\n" + long), (2, "a b\n" + long), (2, "c d"), (2, "c d"), (7, long), (None, "only " * 30), (None, "only " * 30), (9, None), (9, "")]
    got = sorted((str(r.doc_id), r.n_lines, r.kept_text or "") for r in lines.deduplicated(frame(spark, rows, extra=False)).collect())
    # the text with id 2 is first; equal rows count as one
    want = [("2", 7, "a b\n" + long), ("2", 1, "c d"), ("2", 1, "c d"), ("5", 6, ""), ("5", 6, ""), ("7", 6, ""), ("None", 6, ""), ("None", 7, "x"), ("None", 1, "only " * 30), ("None", 1, "only " * 30), ("9", 1, ""), ("9", 1, "")]
    assert got == sorted(want)
    texts = [(f"k{i}", t) for i, (_, t) in enumerate(rows)]
    assert lines.deduplicated(frame(spark, texts)).count() == len(rows)
