"""Queries that read every row of their table, whatever its id."""

import heapq
import itertools
import random
from collections import Counter

import duckdb
import pytest

from pixelmill.plans import base
from pixelmill.plans.reports import wilcoxon
from pixelmill.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    rng = random.Random(5)
    ids = [0, 199, 200, 201, 4096, 10_000_000_000]
    rows = {i: "".join(rng.choice("abé \u4e00\n") for _ in range(rng.randint(64, 300))) for i in ids}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, rows


def filled(text):
    """A text whose last row of 64 is filled up with its last character."""
    return text + text[-1] * (-len(text) % 64)


def test_document_raster(spark, texts):
    d, rows = texts
    got = {(r.img, r.i, r.j): r.v for r in QUERIES["src_doc_raster"](spark, d).collect()}
    assert got == {(k, p // 64, p % 64): ord(c) % 256 for k, t in rows.items() for p, c in enumerate(filled(t))}


def test_document_costs(spark, texts):
    d, rows = texts

    def bits(text):
        heap, total = list(Counter(ord(c) % 256 for c in text).values()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            total += x
            heapq.heappush(heap, x)
        return total

    got = {r.img: (r.n, r.huff) for r in QUERIES["huffman_documents"](spark, d).collect()}
    assert got == {k: (len(filled(t)), bits(filled(t))) for k, t in rows.items()}


def test_document_matches(spark, texts):
    d, rows = texts
    assert {(r.doc_id, r.n_bytes, r.equal) for r in QUERIES["lz_round_trip"](spark, d).collect()} == {(k, len(t.encode()), True) for k, t in rows.items()}
    assert {r.doc_id for r in QUERIES["lz_tokens"](spark, d).collect()} == set(rows)


def signed_ranks(pairs):
    """n, w and p by listing all sign patterns."""
    ds = [x - y for x, y in pairs if x != y]
    ranks = [sum(abs(o) < abs(v) for o in ds) + (sum(abs(o) == abs(v) for o in ds) + 1) / 2 for v in ds]
    plus = sum(r for r, v in zip(ranks, ds) if v > 0)
    w = min(plus, sum(ranks) - plus)
    sums = [sum(r for r, s in zip(ranks, p) if s) for p in itertools.product((0, 1), repeat=len(ds))]
    return len(ds), w, sum(min(s, sum(ranks) - s) <= w for s in sums) / len(sums)


def test_signed_ranks(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 9, 12):
        pairs = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)] + [(3, 1)]
        assert tuple(wilcoxon(spark.createDataFrame(pairs, "x long, y long")).first()) == pytest.approx(signed_ranks(pairs))
    assert tuple(wilcoxon(spark.createDataFrame([(1, 0), (0, 1)], "x long, y long")).first()) == (2, 1.5, 1.0)
    assert wilcoxon(spark.createDataFrame([(4, 4)], "x long, y long")).count() == 0
    many = wilcoxon(spark.createDataFrame([(k, 0) for k in range(1, 41)], "x long, y long")).first()
    assert (many.n, many.w, many.p) == (40, 0, 2 / 2**40)


def test_scores_of_all_images(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, [rng.uniform(-0.5, 0.5) for _ in range(64)]) for k in range(64 * 11)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    score = {}
    for r in base.taps(spark, str(tmp_path)).collect():
        med = sorted((r.a, r.b, r.a + r.b - r.c))[1]
        x, y = score.get(r.img, (0, 0))
        score[r.img] = x + abs(r.v - med), y + abs(r.v - ((r.a + r.b) >> 1))
    assert len(score) == 11
    got = QUERIES["wins_and_losses"](spark, str(tmp_path)).first()
    assert (got.wins, got.losses, got.ties) == tuple(sum(f(x, y) for x, y in score.values()) for f in (int.__lt__, int.__gt__, int.__eq__))
    assert tuple(QUERIES["wilcoxon_signed_rank"](spark, str(tmp_path)).first()) == pytest.approx(signed_ranks(score.values()))


def test_three_coders_where_rounding_overruns_the_table(spark, tmp_path):
    """Image 7 of sf0.1 has a class of 2755 samples with 579 symbols, whose rounded frequencies sum to 100 too many."""
    events = duckdb.connect()
    events.sql("create view events as select * from '/root/testdata/sf0.1/events.parquet' where event_id // 4096 = 7")
    events.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    columns = ["img", "ch", "e", "coder", "bits"]
    got = {tuple(r[c] for c in columns) for r in QUERIES["three_way_coder"](spark, str(tmp_path)).collect()}
    assert got == set(events.sql(f"select {', '.join(columns)} from ({ORACLES['three_way_coder']})").fetchall())
