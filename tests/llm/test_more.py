"""Periodic runs, the Merkle manifest and the language model against brute-force versions, and on odd input."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.shipping import ship_package
from lexiloom.llm import language_id, lm_score, merkle, periodic_runs, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, leaf string, n double"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, texts, sources=3):
    rows = [(i, t, "en", f"s{i % sources}", len(t or ""), "x", "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_table(spark):
    rows = [(None, None, None, None, None, None, None, None)] * 3 + [(1, "", "en", "a", 0, "", "", 0.0)] * 2 + [(2, "one two three", None, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, DOCS)


def brute_runs(w):
    """Every run by comparing words a period apart, for each period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            j = k
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = k, j + q
            if j > k and e - s >= max(12, 2 * q) and not any(all(w[x] == w[x + r] for x in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            k = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    n, k = rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 120, 200]), rng.choice([1, 2, 3, 5, 50])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 3 else 0):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        for i in range(a, min(n, a + rng.randint(1, n))):
            w[i] = w[a + (i - a) % p] if a + (i - a) % p < n else w[i]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_chunks(seed, monkeypatch):
    """Many small texts in one chunk; slices end inside it."""
    monkeypatch.setattr(periodic_runs, "SLICE_WORDS", 150)
    rng = random.Random(seed)
    for _ in range(15):
        docs = [periodic_text(rng) for _ in range(rng.randint(1, 25))]
        chunk = periodic_runs.Chunk()
        for i, w in enumerate(docs):
            chunk.add(i, None, " \t\n\v\f\r"[i % 6].join(w))
        for (i, runs, words), w in zip(list(chunk.results()), docs, strict=True):
            want = brute_runs(w)
            assert runs == want
            gone = {x for s, n, q in want for x in range(s + q, s + n)}
            assert [x.decode() for x in words] == [x for k, x in enumerate(w) if k not in gone], i


def test_runs_of_a_fibonacci_word():
    """A text with very many overlapping runs, where the smaller half matters."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 900:
        a, b = b, b + a
    chunk = periodic_runs.Chunk()
    chunk.add(0, None, " ".join(b))
    assert next(chunk.results())[1] == brute_runs(b)


def test_periodic_query(spark):
    """Texts made periodic by the rule on doc_id, and the columns of the result."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 3, 20, 90, 150]))) for _ in range(120)] + [None, "", "a " * 5000, " x\u0085 　 " * 9, "日本 語 " * 8]
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(table(spark, texts), plant=True).collect()}
    assert len(got) == len(texts)
    made = 0
    for i, t in enumerate(texts):
        w = [x for x in (t or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            made += 1
        want, r = brute_runs(w), got[i]
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r["n_words"], r["n_runs"]) == (len(w), len(want))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        gone = {x for s, n, q in want for x in range(s + q, s + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert made > 5
    own = periodic_runs.periodic_runs(table(spark, ["a b c d " * 5, "x"]), texts=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in own[0]["runs"]] == [(0, 20, 4)] and own[0]["collapsed"] == "a b c d" and own[1]["runs"] == []
    odd = periodic_runs.periodic_runs(odd_table(spark), plant=True).collect()
    assert len(odd) == 7 and all(r["n_runs"] == 0 for r in odd)
    assert periodic_runs.periodic_runs(odd_table(spark).limit(0)).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """(root, proof of each node as a list of (left, right))."""
    proofs, of, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        above, over = [], []
        for a in range(0, len(level), 16):
            run = level[a : a + 16]
            for k in range(len(run)):
                for i in of[a + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(H(*run))
            over.append([i for x in of[a : a + 16] for i in x])
        level, of = above, over
    return level[0], proofs


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_merkle(spark, sources):
    rng = random.Random(sources)
    texts = [rng.choice(["Abc ", "", None, "xyz", "ÆØÅ Q"]) and f"{rng.choice('aBc')} {i}" for i in range(330)]
    rows = [(i * 7 % 1000, t, rng.choice(["en", None]), None if i % sources == 2 else f"s{i % sources}", rng.choice([None, len(t or "")])) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "A", "en", "s0", 1), (None, "B", "en", "s0", 1), (5000, "lone", "en", "\U0001f600", 4), (5001, "lone", "en", "￿", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("tree", F.lit("clash")).withColumn("at", F.lit(1))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    got = sorted((tuple(r) for r in merkle.manifest(df, tampered=hit).collect()), key=repr)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda d, t, g, s, n: H(field(d), field(s), field(g), field(n), field(t))
    by = {}
    for d, t, g, s, n in rows:
        by.setdefault(s, []).append((d is not None, d or 0, leaf(d, t, g, s, n), leaf(d, lower(t), g, s, n)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s])]) for s in order}
    root, tops = brute_tree([trees[s][0] for s in order])
    want = []
    for s, top in zip(order, tops, strict=True):
        for (real, d, own, changed), proof in zip(sorted(by[s]), trees[s][1], strict=True):
            path = proof + top
            acc = changed if real and zlib.crc32(str(d).encode()) % 5 == 0 else own
            for a, b in path:
                acc = H(a, acc, b)
            want.append((d if real else None, s, own, trees[s][0], root, H(*[a + b for a, b in path]), acc))
    assert got == sorted(want, key=repr)
    assert {w[6] == root for w in want} == {True, False}


def test_merkle_odd(spark):
    got = merkle.manifest(odd_table(spark)).collect()
    assert len(got) == 7 and all(r["folded_root"] == r["root"] for r in got)
    assert merkle.manifest(odd_table(spark).limit(0)).count() == 0
    one = merkle.manifest(odd_table(spark).where("doc_id = 2").limit(1)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == H()


def toy_vocabulary(words=40, dictionary=30, head=12, tail=4, seed=1):
    rng = random.Random(seed)
    counts = sorted(((f"w{i}{rng.choice('abc')}".encode(), rng.randint(1, 90)) for i in range(words)), key=lambda x: -x[1])
    counts.insert(3, (lm_score.END, 25))
    v = lm_score.Vocabulary([w for w, _ in counts[:dictionary]], [n for _, n in counts[:dictionary]], sum(n for _, n in counts), len(counts), head, tail)
    tokens, distinct = np.zeros(v.buckets), np.zeros(v.buckets)
    for i, (w, n) in enumerate(counts):
        if i >= dictionary or v.is_tail[i]:
            b = v.lookup[w] - len(v.words) if i >= dictionary else v.bucket[i]
            tokens[b] += n
            distinct[b] += 1
    v.fill(tokens, distinct)
    return v, dict(counts)


def test_model_is_a_distribution():
    """After any context the leaves' shares, and all words and unseen parts of the buckets, sum to one."""
    v, counts = toy_vocabulary()
    model, rng = lm_score.Model(v.bias(), rows=(64, 64, 128)), np.random.default_rng(2)
    for w in model.weights:
        w[:] = rng.normal(size=w.shape)
    leaves = np.flatnonzero(v.mass)
    context = rng.choice(leaves, 3)
    leaf = np.concatenate([np.append(context, x) for x in leaves])
    hashes = lm_score.features(leaf, np.arange(0, len(leaf), 4), v.end)
    share = np.exp(model.log_prob(leaf, hashes)[3::4])
    assert abs(share.sum() - 1) < 1e-5
    at = {int(x): s for x, s in zip(leaves, share, strict=True)}
    total = 0.0
    for w, n in counts.items():
        i = v.lookup[w]
        inside = v.inside[i] + (math.log10(n + 1) if i >= len(v.words) else 0)
        total += at[int(v.leaf[i])] * 10**inside
    unseen = sum(at[int(x)] / s for x, s in zip(v.bucket_leaves, v.bucket_size, strict=True))
    assert abs(total + unseen - 1) < 1e-5


def test_model_against_plain_loops():
    """Log probabilities from the tree, feature by feature; one gradient step against a numeric gradient."""
    v, _ = toy_vocabulary(seed=3)
    model, rng = lm_score.Model(v.bias(), rows=(16, 32, 64)), np.random.default_rng(4)
    for w in model.weights:
        w[:] = rng.normal(size=w.shape)
    leaf = rng.choice(np.flatnonzero(v.mass), 40)
    first = np.array([0, 7, 8, 30])
    hashes = lm_score.features(leaf, first, v.end)
    got = model.log_prob(leaf, hashes)
    wrap = 2**64
    for i in range(40):
        begin = int(first[first <= i].max())
        back = [int(leaf[i - k]) if i - k >= begin else v.end for k in (1, 2, 3)]
        keys = [back[0], back[1], back[2], back[0] * lm_score.LEAVES + back[1]]
        want, node = 0.0, 0
        for k in range(3):
            rows = [((((x + 1) * m % wrap) ^ ((node + k + 1) * lm_score._MIX[k] % wrap)) * lm_score._MIX[3 - k] % wrap >> 40) % len(model.weights[k]) for x, m in zip(keys, lm_score._MIX, strict=True)]
            z = model.bias[k][node] + sum(model.weights[k][r] for r in rows)
            branch = int(leaf[i]) // 32 ** (2 - k) % 32
            want += z[branch] - math.log(np.exp(z.astype(float)).sum())
            node = node * 32 + branch
        assert abs(want - got[i]) < 1e-3
    one = slice(5, 6)
    before = float(model.log_prob(leaf[one], hashes[:, one])[0])
    model.learn(leaf[one], hashes[:, one], rate=1e-3)
    assert float(model.log_prob(leaf[one], hashes[:, one])[0]) > before


def test_lm_score(spark):
    """Counts, known words and the base score by hand; the model learns what follows what, on texts that it hasn't seen."""
    rng = random.Random(8)
    cycle = [f"w{i}" for i in range(12)]

    def text():
        a = rng.randrange(12)
        return " ".join([cycle[(a + k) % 12] if rng.random() < 0.9 else f"Rare{rng.randrange(300)}" for k in range(rng.randint(5, 60))])

    texts = [text() for _ in range(400)] + [None, "", "  ", "never seen before " * 3, "w1 " * 20_000]
    df = table(spark, texts).withColumn("rid", F.lit(3)).withColumn("score", F.lit("clash"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    got = {r["doc_id"]: r for r in lm_score.lm_score(df, held, dictionary=100, head=40, tail=8).collect()}
    counts = {}
    low = lambda t: (t or "").encode().lower().split() + [b"\n"]
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in low(t):
                counts[w] = counts.get(w, 0) + 1
    total, unit, gain = sum(counts.values()), sum(counts.values()) + len(counts) + 1, []
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, w = got[i], low(t)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total)
        assert abs(r["base_score"] - sum(math.log10((counts.get(x, 0) + 1) / unit) for x in w)) < 1e-6 * len(w)
        assert r["score"] < 0
        if r["held_out"] and i < 400:
            gain.append((r["score"] - r["base_score"]) / len(w))
    assert len(gain) > 30 and np.mean(gain) > 0.2, np.mean(gain)
    assert lm_score.lm_score(odd_table(spark), held).count() == 7
    assert lm_score.lm_score(odd_table(spark).limit(0), held).count() == 0
    nothing = lm_score.lm_score(table(spark, ["a b", None]), F.lit(True)).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in nothing] == [3, 1] and all(r["train_tokens"] == r["n_known"] == r["base_score"] == 0 for r in nothing)


def test_language_scores_against_dense_kernel_ridge():
    """With every text a landmark the folded matrix gives what kernel ridge regression on the whole kernel gives, text by text."""
    rng = random.Random(3)
    alphabets = {"a": "abcdef ", "b": "efghij ", "c": "klmabc "}
    make = lambda lang: "".join(rng.choice(alphabets[lang]) for _ in range(80))
    langs = [rng.choice("aaabbc") for _ in range(60)]
    texts = [make(x) for x in langs]
    strings = lambda t: {" ".join(t.split())[i : i + n] for n in range(1, language_id.MAX_N + 1) for i in range(len(" ".join(t.split())) - n + 1)}
    slots = lambda t: set(language_id.ngram_slots(t).tolist())
    x = np.zeros((60, language_id.DIMS), np.uint8)
    for i, t in enumerate(texts):
        x[i, language_id.ngram_slots(t)] = 1
    names, matrix = language_id.fit(x, langs, landmarks=60, ridge=1e-2)
    fresh = [make(k) for k in "abcabc"] + texts[:5]
    got = []
    for t in fresh:
        own = np.zeros(language_id.DIMS, np.float32)
        own[language_id.ngram_slots(t)] = 1
        got.append(own @ matrix / math.sqrt(own.sum()))
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    w = 1.0 / np.array([langs.count(a) for a in langs])
    w = np.diag(w / w.mean())
    # the kernel: shared n-grams over the root of the product of both counts; n-grams told by their slots, and by themselves
    for grams, most in ((slots, 1e-3), (strings, 0.06)):
        sets = [grams(t) for t in texts]
        near = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
        alpha = np.linalg.solve(w @ np.array([[near(a, b) for b in sets] for a in sets]) + 1e-2 * np.eye(60), w @ y)
        want = np.array([[near(grams(t), s) for s in sets] for t in fresh]) @ alpha
        assert np.abs(np.array(got) - want).max() < most, grams


def test_toxicity_scores_against_plain_loops(spark):
    """Passages by trying every segment, their chance and the score, for a model that was learned."""
    rng = random.Random(5)
    clean = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        words = clean(60)
        if i % 3 == 0:
            at = rng.randrange(50)
            words[at : at + 6] = [f"bad{rng.randrange(5)}" for _ in range(6)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    extra = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "bad1 " * 30_000), (1, rows[1][1])], "doc_id long, text string"))
    got = [(r["doc_id"], r["score"], r["n_passages"], r["predicted"]) for r in toxicity.score(extra.withColumn("n_passages", F.lit("clash")), model).collect()]
    assert len(got) == 244 and [g for g in got if g[0] == 1][0] == [g for g in got if g[0] == 1][1]

    def score_of(token):
        forms = [token, *(token[:n] + "~" for n in range(4, min(9, len(token))))]
        return max(model.words.get(f, model.rest) for f in forms)

    def maximal(s):
        """The best segment, then the best ones left and right of it."""
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        _, _, i, j = best
        return [(a, b, v) for a, b, v in maximal(s[:i])] + [(i, j, best[0])] + [(a + j, b + j, v) for a, b, v in maximal(s[j:])]

    seen = {d: (s, n, p) for d, s, n, p in got}
    for i in list(range(0, 30)) + [900, 901]:
        tokens = (dict(rows).get(i) or "").split()
        chances = [model.k * len(tokens) * math.exp(-model.scale * v) for _, _, v in maximal([score_of(t) for t in tokens])]
        found = [e for e in chances if e <= model.e_value]
        evidence = sum(-math.log(-math.expm1(-e)) for e in found)
        want = 1 / (1 + math.exp(-(model.slope * math.log1p(evidence) + model.offset)))
        assert abs(seen[i][0] - want) < 1e-9 and seen[i][1] == len(found) and seen[i][2] == int(want >= 0.5)
    assert seen[902][2] == 1 and seen[900][2] == 0


def test_all_tokens_of_a_batch_count_for_a_shared_row():
    import numpy as np

    from lexiloom.llm import lm_score

    rng = np.random.default_rng(1)
    rows, slope = rng.integers(0, 9, 4 * 50), rng.normal(size=(50, 4)).astype(np.float32)
    row, change = lm_score.shared_sums(rows, slope)
    for r, own in zip(row.tolist(), change, strict=True):
        lines = np.flatnonzero(rows == r) % 50
        assert np.allclose(own, slope[lines].sum(0) / np.sqrt(len(lines)), atol=1e-5)
    # two tokens after the same word: both branches gain, not the last one's alone
    model = lm_score.Model([np.zeros((lm_score.BRANCH**k, lm_score.BRANCH), np.float32) for k in range(lm_score.LEVELS)])
    leaf = np.array([0, 5 * lm_score.BRANCH**2])
    model.learn(leaf, np.full((4, 2), 7, np.uint64))
    made = model.weights[0][np.flatnonzero(model.steps[0])]
    assert (made[:, 0] > 0).all() and np.allclose(made[:, 0], made[:, 5])


def test_members_of_a_large_key_that_miss_its_first_node_are_linked(spark):
    from lexiloom.llm.linking import linked_groups

    n = 40
    found = spark.createDataFrame([(1, i, True) for i in range(n)], "key long, tag long, large boolean")
    nodes = spark.createDataFrame([(i, i, (1,)) for i in range(n)], "tag long, node long, info struct<x:int>")
    # 20 pairs of neighbours, of which at most one has the node that all meet first
    verify = lambda pairs: pairs.where("b = a + 1 and a % 2 = 0").select("a", "b")
    groups = linked_groups(found, nodes, lambda x, y: x["x"] == y["x"], lambda x, y: x[:, 0] == y[:, 0], verify, spread=True)
    assert {(r["node"], r["component"]) for r in groups.collect()} == {(i + 1, i) for i in range(0, n, 2)}


def test_sums_of_a_batch_are_made_for_shared_rows_only(monkeypatch):
    """Rows with one summand are copied; only the others are summed and divided, to the same steps as one by one."""
    import numpy as np

    from lexiloom.llm import lm_score

    rng = np.random.default_rng(2)
    rows = np.concatenate((np.arange(100, 260), rng.integers(0, 12, 80)))
    slope = rng.normal(size=(60, lm_score.BRANCH)).astype(np.float32)
    rooted, root = [], np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda x: rooted.append(len(x)) or root(x))
    row, change = lm_score.shared_sums(rows, slope)
    monkeypatch.undo()
    assert rooted == [len(np.unique(rows[160:]))]
    assert row.tolist() == np.unique(rows).tolist()
    for r, own in zip(row.tolist(), change, strict=True):
        lines = np.flatnonzero(rows == r) % 60
        assert np.allclose(own, slope[lines].sum(0) / np.sqrt(len(lines)), atol=1e-5)
    model = lm_score.Model([np.zeros((lm_score.BRANCH**k, lm_score.BRANCH), np.float32) for k in range(lm_score.LEVELS)])
    leaf = rng.integers(0, lm_score.LEAVES, 300)
    for k, node, branch, _ in model._levels(leaf, np.zeros((4, 300), np.uint64)):
        assert (node == leaf // lm_score.BRANCH ** (lm_score.LEVELS - k)).all()
        assert (branch == leaf // lm_score.BRANCH ** (lm_score.LEVELS - k - 1) % lm_score.BRANCH).all()
