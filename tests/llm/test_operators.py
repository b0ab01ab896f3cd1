"""Every operator against brute force, over tricky rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vertexloom.llm import ann, lm_scoring, mixing, packing, ppm, quality_classifier, quality_rules, sharding, simhash, substring, token_counts
from vertexloom.llm.queries import SHARDS, tokenizer


def words(text):
    return (text or "").encode().split()


def held(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


# 1


def test_lm_scores(docs, rows):
    got = lm_scoring.score(docs, top=20).collect()
    train = [t for i, t, *_ in rows if not held(i, 7)]
    counts = Counter(w for t in train for w in [*words((t or "").encode().lower().decode()), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want[i, held(i, 7), len(w), sum(counts[x] > 0 for x in w), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    by_row = ppm.Adaptive()
    for t in train:
        s = b" ".join((t or "").encode().lower().split()) + b"\n"
        padded = b"\n" * ppm.ORDER + s
        for k in range(ppm.ORDER, len(padded)):
            by_row.learn(padded[k - ppm.ORDER : k], padded[k])
    scores = defaultdict(list)
    for r in got:
        scores[r["doc_id"], r["n_tokens"], r["n_bytes"]].append(r["score"])
    for i, t, *_ in rows[:12] + rows[40:46]:
        s = b" ".join((t or "").encode().lower().split()) + b"\n"
        assert any(abs(by_row.code(s, learn=False) - x) < 1e-6 * max(1, abs(x)) for x in scores[i, len(s.split()) + 1, len(s)])


def test_lm_uses_every_context(docs):
    whole, few = (sorted((str(r["doc_id"]), r["n_bytes"], round(r["score"], 6)) for r in lm_scoring.score(docs, capacity=c).collect()) for c in (1 << 20, 50))
    assert few == whole


def test_lm_splits_crowded_contexts(docs):
    whole, split = (sorted((str(r["doc_id"]), r["n_bytes"], round(r["score"], 6)) for r in lm_scoring.score(docs, crowd=c).collect()) for c in (1 << 20, 20))
    assert split == whole


def test_trie_is_a_distribution():
    text = b"abracadabra abracadabra\n"
    buffer, lengths, _ = ppm.joined([text, b"cab"])
    keys, n = np.unique(ppm.grams(buffer, ppm.positions(lengths)), return_counts=True)
    levels = []
    for k in range(ppm.ORDER + 1):
        sub, owner = np.unique(ppm.tail(keys, k + 1), return_inverse=True)
        levels.append((sub, np.bincount(owner, n)))
    trie = ppm.Trie(levels)
    for context in (b"brac", b"\n\n\n\n\n", b"zzzzz", b"a abr", b"zzzra"):
        head = int.from_bytes(context.rjust(5, b"\n"), "big") << 8
        total = (10 ** trie.code(np.array([head | s for s in range(256)], np.uint64))).sum()
        assert abs(total - 1) < 1e-9


def test_lm_of_nothing(empty):
    assert lm_scoring.score(empty).count() == 0


def test_adaptive_learns():
    model = ppm.Adaptive()
    first = model.code(b"the cat sat on the mat\n")
    assert model.code(b"the cat sat on the mat\n") > 3 * first / 4 > first


# 2


def test_rule_statistics(docs, rows, labels):
    got = Counter(tuple(r)[:7] for r in quality_rules.rules(docs, labels).select("doc_id", *quality_rules._text.COUNTS, "base_failed").collect())
    want = Counter()
    for i, t, *_ in rows:
        w, t = words(t), t or ""
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = set()
        for k in range(len(w) - 4):
            if windows[tuple(w[k : k + 5])] > 1:
                again |= set(range(k, k + 5))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        n = len(w)
        want[i, n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(again), n < 10 or 100 * len(again) > 20 * n] += 1
    assert got == want


def test_rules_learn_thresholds():
    rng = np.random.default_rng(3)
    x, y = rng.random(600), rng.random(600)
    label = np.where((x > 0.7) & (y <= 0.5), 0, 1)
    learned = quality_rules.learn({"x": x, "y": y}, label)
    fires = np.zeros(600, bool)
    for r in learned:
        fires |= r.fires({"x": x, "y": y})
    assert learned and (fires == (label == 0)).mean() > 0.97


def test_verdict_is_ordered(spark):
    rules = [quality_rules.Rule((("x", True, 0.5),), 0, 1.0, 1), quality_rules.Rule((("x", True, 0.2),), 1, 1.0, 1)]
    df = spark.createDataFrame([(0.1,), (0.3,), (0.9,)], "x double")
    assert [r[0] for r in df.orderBy("x").select(quality_rules.verdict(rules, 0)).collect()] == [0, 1, 0]


def test_rules_without_labels(docs, empty, labels, spark):
    none = labels.limit(0)
    assert quality_rules.rules(docs, none).where("kept = base_failed").count() == 0
    assert quality_rules.rules(empty, labels).count() == 0


# 3


def test_classifier(spark, docs, rows, empty, labels):
    got = quality_classifier.classify(docs, labels).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((i, held(i, 4)) for i, *_ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_machine_identity():
    rng = np.random.default_rng(0)
    m = quality_classifier.Machine(size=50, factors=3)
    m.w = rng.normal(size=50)
    index, value = np.array([3, 8, 21, 40]), rng.random(4)
    want = m.w0 + m.w[index] @ value + sum(m.v[index[a]] @ m.v[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert abs(m.raw(index, value, np.array([0]))[0] - want) < 1e-12


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.classify(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r[0] == r[1] for r in got) / len(got) > 0.95


def test_accepted_keeps_columns(clashing, labels):
    out = quality_classifier.accepted(clashing, labels)
    assert out.columns == clashing.columns
    assert 0 < out.count() <= clashing.count()


# 4


def brute_components(fps, tau=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= tau:
                parent[find(a)] = find(b)
    return [find(x) for x in range(len(fps))]


def test_fingerprints_and_components(docs, rows):
    fps = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    roots = brute_components(fps)
    ids = {r: min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None) for r in roots}
    want = Counter((rows[k][0], f"{fps[k]:016x}", ids[roots[k]]) for k in range(len(rows)))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def groups(docs):
    """How many components there are; ids that stand for several texts don't blur it."""
    fps = sorted({int(r["fingerprint"], 16) for r in simhash.near_duplicates(docs).collect()})
    return len(set(brute_components(fps)))


def spread_fingerprints(n=300):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64).astype(np.uint64)
    out = []
    for k in range(n):
        x = int(base[k % 6])
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("hot", [20_000, 12, 3, 1])
def test_links_lose_nothing(spark, hot):
    fps = spread_fingerprints()
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, hot)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    roots = brute_components(fps)
    groups = defaultdict(set)
    for k, r in enumerate(roots):
        groups[r].add(signed[k])
    mine = defaultdict(set)
    for x in signed:
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_forest_of_a_key_keeps_its_chain():
    fps = np.array(spread_fingerprints(400), np.uint64)
    key = simhash.segment(fps[:1], 0)[0] << np.uint64(13) | simhash.segment(fps[:1], 1)[0]
    got = simhash.forest(fps, np.ones(len(fps), bool), key)
    fits = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if a != b and simhash.chained(np.array([key]), fps[a : a + 1], fps[b : b + 1])[0]}
    at = {int(x): n for n, x in enumerate(fps)}
    assert {(at[a], at[b]) for a, b in got} <= fits
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in fits:
        parent[find(a)] = find(b)
    assert len(got) == len(fps) - len({find(x) for x in range(len(fps))})


def test_forest_connects_large_groups():
    fps = np.array(spread_fingerprints(400), np.uint64)
    got = simhash.forest(fps, np.ones(len(fps), bool))
    assert len(got) == len(fps) - len(set(brute_components([int(x) for x in fps])))


def test_joins_on_hot_keys(spark):
    rows = spark.createDataFrame([(k, 0 if k < 300 else k % 50) for k in range(500)], "id long, key long")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    want = Counter((r["id"], r["key"], r["least"]) for r in rows.join(sizes, "key").collect())
    assert Counter((r["id"], r["key"], r["least"]) for r in simhash._met(rows, sizes, "key", 20).collect()) == want


def test_near_duplicates_edges(empty, clashing, docs):
    assert simhash.near_duplicates(empty).count() == 0
    one = simhash.deduplicated(clashing)
    assert one.columns == clashing.columns
    assert one.count() == groups(docs)


# 5


def vectors(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[50:120] = x[40]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [1.0] * 15 + [float("nan")]), (1060, [1.0] * 15 + [None]), (1080, [1.0] * 7), (1100, [float("inf")] * 16), (None, [1.0] * 16)]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), x.astype(float)


def test_nearest(spark):
    df, x = vectors(spark)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 400, 20):
        s = np.array([np.cumsum(x[q] * v)[-1] for v in x])
        order = [k for k in np.lexsort((np.arange(400), -s)) if k != q][:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(s[k] == v for k, v in got[q])
        hits += len({k for k, _ in got[q]} & set(order))
        if q == 40 or 50 <= q < 120:
            assert [k for k, _ in got[q]] == order
    assert len(got) == 20 and hits / 400 >= 0.9


def test_nearest_of_uneven_norms_and_frequent_vectors(spark):
    """More shards than one, largest norms far off, a vector in a third of the rows, an id with several vectors."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9000, 8)) * rng.exponential(size=(9000, 1))
    x[3000:6000] = x[1]
    ids = np.arange(9000)
    ids[7000:7010] = 20
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 300 == 0, 5, shard=2000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 9000, 300):
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        order = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        assert len(got[q]) == 5 and all(np.isclose(s[ids == k], v).any() for k, v in got[q])
        hits += len({k for k, _ in got[q]} & set(order)) / len(set(order))
        if 3000 <= q < 6000 and order == [1, *range(3000, 3004)]:
            assert [k for k, _ in got[q]] == order
    assert len(got) == 30 and hits / 30 >= 0.9


def test_probes_of_a_query_are_its_best_buckets():
    shape = ann.Hash(8, 2, 2)
    x = np.random.default_rng(5).normal(size=(7, 8))
    y = shape.rotated(x, True)
    both = np.concatenate([y, -y], -1)
    fall = both.max(-1, keepdims=True) - both
    whole = fall[:, :, 0, :, None] + fall[:, :, 1, None, :]
    for many in (1, 5, 40, 256):
        got = shape.probes(x, many)
        for n in range(7):
            for t in range(2):
                values = whole[n, t].ravel()
                assert len(set(got[n, t])) == many and np.allclose(values[got[n, t] - 256 * t], np.sort(values)[:many])


def test_share_of_vectors_scored_falls(spark):
    shares = []
    for n in (500, 4000, 16000):
        x = np.random.default_rng(6).normal(size=(n, 64)).astype(np.float32)
        shape = ann.Hash.fitting(64, n)
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<float>")
        many = ann.probes_for(df, df.where("vec_id < 40"), shape, 10, "float")
        index = ann.Shard(np.arange(n), np.arange(n), x, shape)
        shares.append(np.mean([len(c) for c in index.candidates(x[:40], many)]) / n)
    assert shares[0] > shares[1] > shares[2]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_partly_found_queries(spark):
    x = np.random.default_rng(3).normal(size=(30, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 20):
        s = np.array([np.cumsum(x[q] * v)[-1] for v in x])
        want += [(q, n + 1, k) for n, k in enumerate([k for k in np.lexsort((np.arange(30), -s)) if k != q][:20])]
    assert got == want


def test_search_in_blocks_keeps_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [-1.0, 0.0]), (2, [3.0, 0.5]), (3, [0.5, 4.0]), (4, [-5.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").coalesce(1)
    got = ann._searched(df.where("vec_id = 1"), df, 2, 2, block=2).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 4, 5.0), (1, 2, 3, 4.0)]


# 6


def test_lookup_table():
    shards = [f"n{k}" for k in range(7)]
    table = sharding.lookup_table(shards, 1009)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)


def test_sharding(docs, clashing, empty):
    table = sharding.lookup_table(SHARDS)
    for r in sharding.shard(docs.select("doc_id"), F.col("doc_id"), SHARDS).join(docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(65537))).alias("h")).distinct(), "doc_id").collect():
        assert r["slot"] == r["h"] and r["shard"] == SHARDS[table[r["h"]]]
    assert sharding.shard(clashing, F.col("doc_id"), SHARDS).count() == clashing.count()
    assert sharding.shard(empty, F.col("doc_id"), SHARDS).count() == 0


# 7


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def test_packing(docs, rows, empty, exact):
    got = packing.pack(docs, tokenizer(), with_ids=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4")
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(len(p) for p in by.values()) == len(got)
    assert len(by) <= sum(r["length"] for r in got) / 2048 + 2
    assert packing.pack(empty, tokenizer()).count() == 0


def test_fill_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(3, 40, 6)}
        room = int(rng.integers(20, 120))
        used = packing.fill(room, counts)
        assert all(k <= counts[n] for n, k in used.items())
        sums = {0}
        for n, c in counts.items():
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= room}
        assert sum(n * k for n, k in used.items()) == max(sums)


def test_plan_uses_everything():
    counts = {n: 5 + n % 7 for n in range(1, 300, 3)}
    out, used = packing.plan(counts, 512), Counter()
    for window, times in out:
        assert sum(n * k for n, k in window.items()) <= 512
        for n, k in window.items():
            used[n] += k * times
    assert used == Counter(counts)


# 8


def brute_mix(rows, weights=(5, 2, 1), share=1.5, limit=2):
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = share * sum(size.values()), set()
    while True:
        level = (total - sum(limit * size[s] for s in capped)) / max(1e-9, sum(w[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and level * w[s] > limit * size[s]}
        if not more:
            return {s: (size[s], limit * size[s] if s in capped else level * w[s]) for s in names}
        capped |= more


def test_mix(docs, rows, empty):
    want = brute_mix(rows)
    got = mixing.mix(docs.withColumn("source2", F.col("source"))).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    by_size = {v[0]: v for v in want.values()}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - by_size[r["source_size"]][1]) < 1e-6 * max(1, r["target"])
        taken[r["source_size"]] += r["taken"]
    for n, (_, target) in by_size.items():
        assert taken[n] == int(target + 1e-9)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    assert mixing.mix(empty).count() == 0


def test_mix_with_hot_keys(docs, rows):
    want = Counter(map(tuple, mixing.mix(docs).collect()))
    assert Counter(map(tuple, mixing.mix(docs, crowd=2).collect())) == want


def test_mixed_keeps_rows_of_sources_apart(spark):
    """Rows that are alike but for their source, of which one is taken whole and one in part."""
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), *[(k, "w " * 10, "x") for k in range(2, 20)], *[(k, "w " * 10, "y") for k in range(20, 30)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["source"]: r["n"] for r in mixing.taken(df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(0).cast("long").alias("digest"))).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {r["source"]: r["n"] for r in mixing.mixed(df).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {s: n for s, n in taken.items() if n}


def test_odd_names_and_bytes(spark, labels):
    """Column names with dots and back-ticks, and texts that are not UTF-8."""
    df = spark.range(3).select("id", F.expr("cast(unhex('61ff6220c328') as string)").alias("text"))
    df = df.select(F.col("id").alias("doc_id"), "text", F.lit("s").alias("source"), F.lit(1).alias("a.b"), F.lit(2).alias("c`d"))
    got = token_counts.counts(df, tokenizer()).collect()
    assert [r["n_bytes"] for r in got] == [6] * 3 and len({r["n_tokens"] for r in got}) == 1
    assert packing.pack(df, tokenizer()).count() == 3
    assert quality_classifier.accepted(df, labels).columns == simhash.deduplicated(df).columns == df.columns
    long_ = df.withColumn("text", F.repeat(F.concat(F.col("text"), F.lit(" ")), 60))
    out = substring.deduplicated(long_)
    assert out.columns == df.columns and sorted(len(r[0].split()) if r[0] else 0 for r in out.select(F.expr("cast(text as binary)")).collect()) == [0, 0, 120]
    assert mixing.mixed(df).columns == df.columns


def test_mixed_rows(docs, clashing):
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    n = out.select(mixing.word_count(F.col("text")).alias("n"), "n_chars", F.length("text").alias("l")).collect()
    assert sum(r["n"] for r in n) == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert all(r["n_chars"] == r["l"] for r in n)
    assert "InPandas" not in out._jdf.queryExecution().toString() and "InArrow" not in out._jdf.queryExecution().toString()


# 9


def brute_substring(rows, window=50):
    first = {}
    big = 1 << 70
    key = lambda i: big if i is None else i
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, big), key(i))
    out = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substring(docs, rows, empty):
    got = Counter(map(tuple, substring.digests(docs).collect()))
    assert got == brute_substring(rows)
    assert sum(n for _, _, n, _ in got) > 0
    assert substring.digests(empty).count() == 0


@pytest.mark.parametrize("block", [1, 3, 8, 25])
def test_substring_blocks(docs, rows, block):
    assert Counter(map(tuple, substring.digests(docs, 50, block).collect())) == brute_substring(rows)


def test_windows_of_colliding_words_differ(spark):
    """Words of 1024 letters whose polynomial hashes modulo 2**64 agree, in texts that are alike but for them."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    a, b = ("".join("xy"[x ^ flip] for x in bits) for flip in (0, 1))
    hashes = substring.Words()([a.encode(), b.encode()])[0]
    assert hashes[0] == hashes[1]
    rest = [f"w{k}" for k in range(50)]
    rows = [(1, " ".join([*rest[:25], a, *rest[25:]])), (2, " ".join([*rest[:25], b, *rest[25:]])), (3, " ".join([*rest[:25], b, *rest[25:49]]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_substring_texts(clashing, rows):
    out = substring.deduplicated(clashing)
    assert out.columns == clashing.columns
    want = brute_substring(rows)
    got = Counter((r["doc_id"], hashlib.sha256(b" ".join(words(r["text"]))).hexdigest()) for r in out.collect())
    assert got == sum((Counter({(i, h): n}) for (i, _, _, h), n in want.items()), Counter())


# 10


def test_counts(docs, rows, empty, exact):
    want = Counter()
    for i, t, *_ in rows:
        n = len(exact.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, token_counts.counts(docs, tokenizer()).collect())) == want
    assert token_counts.counts(empty, tokenizer()).count() == 0


def test_splicing(exact):
    encoder = token_counts.Encoder.of(tokenizer())
    import random

    rng = random.Random(4)
    pieces = ["word", " the", "  ", "\n\n", "'s", "'re", " 123", "é", "日本", "<|endoftext|>", "...", " " * 90, "a" * 150, "\t", "!?", "don't"]
    for _ in range(25):
        text = "".join(rng.choice(pieces) for _ in range(500))
        want = exact.encode(text, add_special_tokens=False).ids
        for chunk, overlap in ((200, 20), (333, 80), (1000, 1)):
            assert encoder.spliced(text, chunk, overlap).tolist() == want
    for text in ("a" * 3000, " " * 3000, "ab " * 1000, "\n" * 2500 + "x"):
        assert encoder.spliced(text, 256, 16).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_both_encoders_agree_on_code_points(exact):
    encoder = token_counts.Encoder.of(tokenizer())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!{chr(c)}" for c in points]
    for text, e in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.fast.encode_ordinary(text) == e.ids
