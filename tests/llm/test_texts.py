"""Search, tokens, rules, models, shards and the pipeline."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelmill.llm import backoff, bpe, decontaminate, reshard, toxicity, urls

from .helpers import LOWER, corpus, frame, spaced


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_benchmark_windows(spark, block_words):
    rng = random.Random(3)
    rows = corpus(11)
    pick = lambda i, a, b: " ".join(alnum(rows[i][1])[a:b])
    items = [(7, pick(20, 0, 40)), (7, pick(21, 2, 15)), (12, pick(22, 0, 3)), (2, "x" * 5000), (3, None), (4, ""), (5, "zz qq"), (10, "One"), (11, pick(20, 0, 30)), (None, pick(23, 0, 20))]
    rng.shuffle(items)
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for r in decontaminate.judged(docs, bench, block_words=block_words).collect():
        w, hit, names = alnum(r.text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    names |= windows[tuple(w[k : k + size])]
        assert (r.n_words, r.n_hit, r.hit_items) == (len(w), len(hit), sorted(str(x) for x in names if x is not None))
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert decontaminate.judged(docs.limit(0), bench).count() == 0
    assert decontaminate.judged(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    signs = "abtheing  '\n\t.,-=0189éñ漢字😀ÿ²½\u00a0\x1c\x00"
    texts = [t for _, t in corpus(5)] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "-" * 700, "a" * 999, " " * 60, "it's 'tis we'll"]
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    docs = frame(spark, list(enumerate(texts)))
    for r in bpe.decoded(bpe.tokenized(docs)).collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == want and r.n_tokens == len(want)
        back = lib.decode(want, skip_special_tokens=False)
        assert r.decoded_text == back
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.tokenized(docs.limit(0)).count() == 0


def test_bpe_automaton_accepts_what_merging_makes(monkeypatch):
    rng = random.Random(6)
    for _ in range(30):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append([a, b])
        spec = {"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "added_tokens": []}
        automaton = bpe.Automaton(json.loads(json.dumps(spec)))
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            parts = list(word)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == a and parts[i + 1] == b:
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert [automaton.arcs[i].decode() for i in automaton.path(word.encode())] == parts
        # one state per name, one target per state and byte, and the same path when the table is emptied on the way
        assert len(automaton.named) == len(automaton.tails) == len(automaton.lasts) == len(automaton.last)
        for key, there in list(automaton.table.items()):
            assert automaton._step(key >> 8, key & 255) == there
        word = bytes(rng.choice(b"abc") for _ in range(400))
        want = automaton.path(word)
        monkeypatch.setattr(bpe, "KEPT_STATES", 7)
        automaton._restart()
        assert automaton.path(word) == want and len(automaton.tails) <= 8
        monkeypatch.undo()


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b.example.net", "/en/x", "block"), ("com", "", "block"), ("b.com", "/", "allow"), ("org", "/fr/", "allow")]
    rng = random.Random(7)
    hosts = ["net", "example.net", "w.Example.NET", "a.b.example.net", "xnet", "b.com", "c.b.com", "com", "org", "", "...", "net.", "n\net"]
    made = [None, "", "nothing", "://", "http://", "a://net", "http://net?x", "http://net#/", "HTTP://u@net/"] + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/xyz', '/fr/', '/EN/', '/en?x', '#/en/'])}{rng.choice(['', '?q=://net/', '#f'])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in urls.judged(df, rules=rules).collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert urls.judged(df.limit(0)).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    made = urls.cascades(df, {"a": [*keys[::60], "never seen"], "b": keys[1::700], "c": []})
    for name, step in (("a", slice(0, None, 60)), ("b", slice(1, None, 700)), ("c", slice(0, 0))):
        assert {r[0] for r in df.filter(urls.member(made[name], F.col("key"))).collect()} == set(keys[step])


def test_urls_with_a_million_rules(spark):
    rules = [(f"h{i}.example.net", f"/{i % 7}/" if i % 3 else "/", "block" if i % 2 else "allow") for i in range(1_000_000)]
    made = [f"http://w.h{i}.example.net/{(i + k) % 7}/x" for i in range(0, 1_400_000, 2900) for k in (0, 1)]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    for r in urls.judged(df, rules=rules).collect():
        i = int(re.search(r"h(\d+)", r.url)[1])
        fits = i < len(rules) and r.path.startswith(rules[i][1])
        assert (r.rule, r.verdict) == ((rules[i][0] + rules[i][1], rules[i][2]) if fits else (None, "allow"))


def test_toxicity_learns_sentences(spark):
    rng = random.Random(1)
    bad, good = ["vileness", "filthy"], [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        parts = [" ".join(rng.choice(good) for _ in range(8)) for _ in range(rng.randint(1, 6))]
        if toxic := i % 4 == 0:
            parts[rng.randrange(len(parts))] += " " + rng.choice(bad)
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "?!."), (0, rows[0][1])]
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels + [(1, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.predicted(docs, marks).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score == 0
    few = toxicity.trained(docs, marks, ~toxicity.held_out(F.col("doc_id")), most_total=2000)
    assert few[0].any() and (few[0] != 0).sum() < 2000  # a bounded sample is learnt from
    model = toxicity.trained(docs, marks, ~toxicity.held_out(F.col("doc_id")))
    for r in toxicity.offending(docs.filter("doc_id % 8 = 0 and doc_id < 400"), model).collect():
        assert [s.sentence for s in r.offending_sentences if not any(b in s.sentence for b in bad)] == []
        assert r.offending_sentences
    assert all(r.score < 1e-9 for r in toxicity.predicted(docs, marks.limit(0)).collect())


def test_language_model(spark):
    rows = corpus(13)
    tokens = {i: [*spaced(t), None] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in tokens[i])
    pairs = Counter(p for i in train for p in zip(tokens[i], tokens[i][1:]))
    size, known, frequent = sum(count.values()), len(count), {w for w, c in count.items() if c >= 0.004 * sum(count.values())}
    pairs = Counter({p: c for p, c in pairs.items() if p[0] in frequent and p[1] in frequent})
    discount = lambda c: (lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5)(*(sum(x == k for x in c.values()) for k in (1, 2)))
    d, big = discount(count), discount(pairs)
    unmet = max(1, *(a * a / (2 * max(1, b)) for a, b in [(sum(x == k for x in count.values()) for k in (1, 2))]), d * known / (1 - d))
    unigram = lambda w: (count[w] - d) / size if count[w] else d * known / unmet / size
    back = {}
    for u in frequent:
        seen = [(v, c) for (a, v), c in pairs.items() if a == u]
        back[u] = (1 - sum(c - big for _, c in seen) / count[u]) / (1 - sum(unigram(v) for v, _ in seen)) if seen else 1.0
    for block_bytes in (1 << 24, 300):
        for r in backoff.scored(frame(spark, rows), frequent=0.004, block_bytes=block_bytes).collect():
            t, before, total = tokens[r.doc_id], 0, 0.0
            for w in t:
                if before and (before[0], w) in pairs:
                    p = (pairs[before[0], w] - big) / count[before[0]]
                else:
                    p = unigram(w) * (back[before[0]] if before else 1)
                total += math.log10(p)
                before = (w,) if w in frequent else 0
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(count[w] > 0 for w in t), size, r.doc_id not in train)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (size + known + 1)) for w in t))
            assert r.score == pytest.approx(total)
    assert backoff.scored(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 24, 30_000])
def test_language_model_keeps_rare_pairs(spark, block_bytes):
    """Words far below 1/10,000 of more than 30,000 training tokens are histories and ends of arcs too."""
    train = [(k, " ".join(["the of"] * 220 + [f"rare{k} next{k}", f"rare{k} next{k}", f"seldom{k % 7} once{k}"])) for k in range(80)]
    rows = train + [(1000 + k, f"of rare{k} next{k} seldom{k % 7} once{k} rare{k} unheard rare{k + 1}") for k in range(60)]
    tokens = {i: [*spaced(t), None] for i, t in rows}
    count = Counter(w for i, _ in train for w in tokens[i])
    pairs = Counter(p for i, _ in train for p in zip(tokens[i], tokens[i][1:]))
    size, known = sum(count.values()), len(count)
    assert max(count[f"rare{k}"] for k in range(80)) < 1e-4 * size
    discount = lambda c: (lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5)(*(sum(x == k for x in c.values()) for k in (1, 2)))
    d, big = discount(count), discount(pairs)
    unmet = max(1, *(a * a / (2 * max(1, b)) for a, b in [(sum(x == k for x in count.values()) for k in (1, 2))]), d * known / (1 - d))
    unigram = lambda w: (count[w] - d) / size if count[w] else d * known / unmet / size
    seen = {}
    for (u, v), c in pairs.items():
        seen.setdefault(u, []).append((v, c))
    back = {u: (1 - sum(c - big for _, c in vs) / count[u]) / (1 - sum(unigram(v) for v, _ in vs)) for u, vs in seen.items()}
    got = backoff.scored(frame(spark, rows), test=F.col("doc_id") >= 1000, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        total = math.log10(unigram(t[0]))
        for u, w in zip(t, t[1:]):
            total += math.log10((pairs[u, w] - big) / count[u] if (u, w) in pairs else unigram(w) * back.get(u, 1))
        assert r.train_tokens == size and r.score == pytest.approx(total)


def test_language_model_prices_unknown_words(spark):
    """The empty history's probabilities add up to one, and junk is less likely than natural text that wasn't trained on."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    text = lambda: " ".join(rng.choices(words, [1 / (k + 1) for k in range(3000)], k=60))
    rows = [(i, text()) for i in range(400)] + [(1000 + i, text()) for i in range(40)]
    rows += [(2000 + i, " ".join("".join(rng.choice("qxzjkv") for _ in range(9)) for _ in range(60))) for i in range(40)]
    got = backoff.scored(frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), test=F.substring("doc_id", 2, 9).cast("int") >= 1000).collect()
    bits = {r.doc_id: -r.score / r.n_tokens * math.log2(10) for r in got}
    assert max(bits[f"d{i}"] for i in range(1000, 1040)) < min(bits[f"d{i}"] for i in range(2000, 2040))
    for known, ones, twos in ((10, 0, 0), (500, 300, 90), (500, 10, 200), (1, 1, 0)):
        d = backoff._discount(ones, twos)
        assert d * known / backoff.unmet_words(known, ones, twos, d) <= 1 - d + 1e-12


def test_resharding(spark):
    rows = corpus(3, 30) + [(5, "again"), (None, "no id")]
    out = reshard.resharded(frame(spark, rows), 4, 6).collect()
    assert len(out) == len(rows)
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    total, most = sum(sizes.values()), max(r["size"] for r in out)
    assert all(abs(sizes[j] - total / 6) <= most for j in range(6))
    assert reshard.resharded(frame(spark, rows).limit(0)).count() == 0


def test_resharding_keeps_equal_texts_together(spark):
    rng = random.Random(12)
    groups = [("".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 200))), rng.randint(2, 6)) for _ in range(40)]
    texts = [t for t, n in groups for _ in range(n)] + [f"text {i} " * rng.randint(1, 30) for i in range(600)] + ["large copy " * 20] * 300
    rng.shuffle(texts)
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    out = reshard.resharded(frame(spark, rows), 4, 6).collect()
    shards, sizes, slots = {}, Counter(), {}
    for r in out:
        shards.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(shards[len(t) + 8, zlib.crc32(t.encode())]) == 1 for t, _ in groups)
    # a group larger than a shard can't stay whole where sizes are near equal
    assert len(shards[228, zlib.crc32(b"large copy " * 20)]) > 1
    share = sum(sizes.values()) / 6
    assert len(out) == len(rows) and all(abs(sizes[j] - share) < share / 20 for j in range(6))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_cheapest_flow_moves_least():
    rng = random.Random(4)
    for _ in range(40):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        supply = [rng.randint(0, 50) for _ in range(n)]
        total = sum(supply)
        capacity = [total * (j + 1) // m - total * j // m for j in range(m)]
        flow = reshard.cheapest(supply, capacity, {i: i for i in range(min(n, m))})
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(n)] == supply
        assert [sum(f for (_, j), f in flow.items() if j == k) for k in range(m)] == capacity
        stay = sum(f for (i, j), f in flow.items() if i == j)
        assert stay == sum(min(supply[k], capacity[k]) for k in range(min(n, m)))


def test_rewrite_leaves_full_shards_alone(spark, tmp_path):
    docs = frame(spark, [(i, "x" * (i % 50)) for i in range(300)], extra=False)
    plan = reshard.resharded(docs, 3, 4).cache()
    left = reshard.rewrite(docs, plan, f"file://{tmp_path}/out")
    wrote = {r.doc_id: (r.shard, r.slot) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {r.doc_id: (r.shard, r.slot) for r in plan.collect() if r.shard not in left}
    assert wrote == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(21)
    toxic = [(2000 + i, f"plain words number {i} here. you vileness filthy {i} thing") for i in range(40)] + [(3000 + i, f"plain words number {i} here. some other {i} thing") for i in range(120)]
    bench = " ".join(f"b{i}" for i in range(30))
    docs = rows + toxic + [(5000, bench + " and more"), (5001, "clean words of its own")]
    base = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    base.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 3000)) for i, _ in toxic], "doc_id long, toxic int").selectExpr("doc_id", "1 as quality", "toxic").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "bpe"]
    ids = {r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert not ids & {i for i, t in toxic if "vileness" in t} and {5001} <= ids and 5000 not in ids
    assert len(ids & {i for i, t in toxic if "vileness" not in t}) > 0
    clash = base.selectExpr("*", "doc_id as n_words", "'t' as kept_text", "-1 as score", "0 as key", "'q' as contaminated", "doc_id as kept_id2", "doc_id as rep")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, f"file://{tmp_path}")
        assert out.columns == clash.columns
        for r in out.collect():
            assert (r.n_words, r.kept_text, r.score, r.key, r.contaminated, r.rep) == (r.doc_id, "t", -1, 0, "q", r.doc_id)
        assert stage(spark, clash.limit(0), f"file://{tmp_path}").count() == 0
