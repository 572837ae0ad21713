"""Texts longer than a chunk and than an Arrow batch in every operator, and the whole pipeline against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pixelmill.llm import backoff, bpe, decontaminate, exact, jaccard, lines, reshard, substrings, toxicity

from .helpers import LOWER, corpus, frame, spaced
from .test_duplicates import later_runs, linked, shingles
from .test_texts import alnum

CHANGED = 700


@pytest.fixture(scope="module")
def long_rows():
    """1.5 MB, the same with one changed word, 9 MB without a repetition, and a short text."""
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
    first = [word("abcdefghij") for _ in range(190_000)]
    second = list(first)
    second[CHANGED] = "changed"
    other = [f"{word('qrstuvwxyz')}{k}" for k in range(720_000)]
    text = lambda w: "\n".join(" ".join(w[k : k + 40]) for k in range(0, len(w), 40))
    rows = [(1, text(first)), (2, text(second)), (3, text(other)), (4, "Short text. vile"), (5, None)]
    assert len(rows[0][1]) > 1_450_000 and len(rows[2][1]) > 9_000_000
    return rows


@pytest.fixture(scope="module")
def long_docs(spark, long_rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('long')}/documents.parquet"
    frame(spark, long_rows).write.parquet(path)
    return spark.read.parquet(path)


def test_long_near_duplicates(long_docs, long_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(long_docs).collect()}
    assert got == {i: (len(shingles(t)), 1 if i == 2 else i) for i, t in long_rows}


def test_long_substrings(long_docs, long_rows):
    got = {r.doc_id: ([tuple(x) for x in r.removed], bytes(r.kept)) for r in substrings.without_repeats(long_docs).collect()}
    data = {i: (t or "").encode() for i, t in long_rows}
    for i in (1, 2):
        # all but the word that differs: what is left and right of it is common
        other = data[3 - i]
        lo = next(k for k, (x, y) in enumerate(zip(data[i], other)) if x != y)
        hi = next(k for k, (x, y) in enumerate(zip(reversed(data[i]), reversed(other))) if x != y)
        assert got[i] == ([(0, lo), (len(data[i]) - hi, len(data[i]))], data[i][lo : len(data[i]) - hi])
    for i in (3, 4, 5):
        assert got[i] == ([], data[i])


def test_long_exact(long_docs, long_rows):
    got = {r.doc_id: (r.keep_id, r.text_sha256) for r in exact.deduplicated(long_docs).collect()}
    assert got == {i: (i, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()) for i, t in long_rows}


def test_long_toxicity(spark, long_docs):
    marks = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.predicted(long_docs, marks).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and all(0 <= s <= 1 for s in got.values()) and got[5] == 0


def test_long_tokens(long_docs, long_rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.tokenized(long_docs, ids=False).collect()}
    for i, t in long_rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    # one word of 300,000 letters
    word = "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(300_000))
    row = bpe.tokenized(long_docs.filter("doc_id = 4").withColumn("text", F.lit(word))).first()
    assert row.token_ids == lib.encode(word, add_special_tokens=False).ids


def test_long_scores(long_docs, long_rows):
    got = {r.doc_id: r for r in backoff.scored(long_docs).collect()}
    for i, t in long_rows:
        assert got[i].n_tokens == len(spaced(t)) + 1 and got[i].score < 0
    assert got[1].score > got[1].base_score


def test_long_benchmark(spark, long_docs, long_rows):
    words = alnum(long_rows[2][1])
    bench = spark.createDataFrame([(1, " ".join(words[-30:])), (2, " ".join(alnum(long_rows[0][1])[1000:1013]))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in decontaminate.judged(long_docs, bench).collect()}
    assert got[3] == (len(words), 30, ["1"]) and got[1] == got[2] == (190_000, 13, ["2"]) and got[4] == (3, 0, []) and got[5] == (0, 0, [])


def test_long_shards(long_docs, long_rows):
    got = {r.doc_id: (r["size"], r.text_crc32) for r in reshard.resharded(long_docs, 2, 3).collect()}
    assert got == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in long_rows}


def test_long_lines(long_docs, long_rows):
    got = {r.doc_id: (r.n_lines, r.kept_text) for r in lines.deduplicated(long_docs).collect()}
    texts = dict(long_rows)
    for i in (1, 3, 4, 5):
        assert got[i] == ((texts[i] or "").count("\n") + 1, texts[i])
    assert got[2] == (4750, texts[2].split("\n")[CHANGED // 40])


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in corpus(31, 6, 5) if t is not None]
    rows += [(2000 + i, f"plain words number {i} here. you vileness filthy {i} thing") for i in range(40)]
    rows += [(3000 + i, f"plain words number {i} here. some other {i} thing") for i in range(120)]
    bench = " ".join(f"b{i}" for i in range(30))
    rows += [(5000, bench + " and more"), (5001, "clean words of its own"), (5002, "x " * 900 + bench), (7, "another text that has the same id as the seventh one")]
    docs = frame(spark, rows, extra=False).selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    marks = [(i, int(i < 3000)) for i, _ in rows if 2000 <= i < 4000]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int").selectExpr("doc_id", "1 as quality", "toxic")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    kept = {(r.doc_id, r.text) for r in toxicity.predicted(docs, labels).filter("predicted = 0").collect()}
    left = sorted(((i, t) for i, t in rows if (i, t) in kept), key=lambda x: x[0])
    named = dict(enumerate(left))  # a row's place stands for its id and text
    _, cut = later_runs([(k, t) for k, (_, t) in named.items()], 20)
    ids = {k: i for k, (i, _) in named.items()}
    groups = linked([(k, cut[k]) for k in named])
    least = {}
    for k, (_, root) in groups.items():
        least[root] = min(least.get(root, ids[k]), ids[k])
    stays = {k for k, (n, root) in groups.items() if n == 0 or ids[k] == least[root]}
    stays = {min(j for j in stays if (ids[j], cut[j]) == (ids[k], cut[k])) for k in stays}
    b = alnum(bench)
    windows = {tuple(b[k : k + 13]) for k in range(len(b) - 12)}
    want = []
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    for k in stays:
        w = alnum(cut[k])
        hit = {x for p in range(len(w) - 12) if tuple(w[p : p + 13]) in windows for x in range(p, p + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.append((ids[k], tuple(lib.encode(cut[k], add_special_tokens=False).ids)))
    got = [(r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want)
    assert {5001, 5002} <= {i for i, _ in got} and 5000 not in {i for i, _ in got}


def test_pipeline_keeps_rows_by_id_and_text(spark, tmp_path):
    import corpus_pipeline

    base, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, base), (2, other), (2, base), (2, other), (None, base), (3, None), (3, None)]
    docs = frame(spark, rows, extra=False).withColumn("marks", F.create_map(F.lit("k"), F.coalesce("doc_id", F.lit(0))))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("1", base), ("2", other), ("None", base), ("3", "None")])
