"""Each corpus operator against a brute-force version, a round trip or held-out accuracy, and on odd input."""

import hashlib
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.functions.shipping import ship_package
from lexiloom.llm import chat_format, exact_dedup, jaccard_join, language_id, line_dedup, linking, mixing, packing, queries, suffix_dedup, tokens, topk_search, toxicity
from lexiloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, score double"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, texts, first=0):
    """Documents with extra columns whose names clash with those inside the operators."""
    rows = [(first + i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), "x", "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, near copies, repeated lines, empty and null texts."""
    rng = random.Random(5)
    base = [words(rng, rng.choice([1, 3, 12, 40, 120])) for _ in range(60)]
    out = []
    for t in base:
        out.append(t)
        if rng.random() < 0.4:
            own = t.split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = "changed"
            out.append(" ".join(own))
        if rng.random() < 0.3:
            out.append(t + "\n" + rng.choice(base))
    return out + ["", None, "   ", base[3], base[3], "ÆØ å 日本 " * 30, "x" * 5000]


def odd_tables(spark):
    yield spark.createDataFrame([], DOCS)
    yield spark.createDataFrame([(None, None, None, None, None, None, None, None)] * 3 + [(1, "", "en", "a", 0, "", "", 0.0)] * 2 + [(2, "one two three four five six", None, None, None, None, None, None)] * 2, DOCS)


def test_exact_dedup(spark, corpus):
    df = table(spark, corpus)
    for keep, best in (("smallest", min), ("largest", max)):
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df, keep=keep, memtable_rows=20, fan_in=2).collect()}
        groups = {}
        for i, t in enumerate(corpus):
            groups.setdefault(t or "", []).append(i)
        for t, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (best(ids), len(ids), i == best(ids))
                assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_resolves_collisions(spark):
    df = table(spark, ["aa", "bb", "aa", "cc"])
    weak = F.encode(F.lit("same"), "utf-8")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df, digest=weak).collect()}
    assert got == {0: (0, 2), 2: (0, 2), 1: (1, 1), 3: (3, 1)}


def test_exact_dedup_odd(spark):
    for df in odd_tables(spark):
        rows = exact_dedup.exact_dedup(df, keep="largest").collect()
        assert len(rows) == df.count()
        assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "INST]", "a", "\n", " ", "<\\/s>", "[\\\\INST]"]
    rows = []
    for c in range(80):
        for t in range(rng.randint(1, 4)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "odd[INST] ", None]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) if rng.random() > 0.1 else None, "clash"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    for r in chat_format.format_chats(df).collect():
        want = [(a or "", b or "") for c, _, a, b, _ in rows if c == r["conv_id"]]
        assert r["identical"] and [(t["role"], t["text"]) for t in r["turns"]] == want
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        assert spans == [s["text"] for s in r["loss"]] and len(spans) == sum(a == "assistant" for a, _ in want)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def brute_components(texts, n, percent):
    sets = [jaccard_join.shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, corpus, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, corpus), n=n, percent=percent).collect()}
    assert [got[i] for i in range(len(corpus))] == brute_components(corpus, n, percent)


def test_coded_sets_are_the_shingles(corpus):
    texts = [t for t in corpus if t]
    for n in (1, 3, 5):
        sets, _ = jaccard_join.coded_sets(texts, n)
        own = [jaccard_join.shingles(t, n) if len(jaccard_join.words_of(t)) >= n else set() for t in texts]
        assert [len(x) for x in sets] == [len(x) for x in own]
        assert all(len(np.intersect1d(sets[i], sets[j])) == len(own[i] & own[j]) for i in range(0, len(texts), 5) for j in range(len(texts)))


def test_jaccard_in_blocks(spark, corpus, monkeypatch):
    """The same result where a group is split into blocks, and where keys count as large from three nodes."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 50)
    monkeypatch.setattr(linking, "SMALL", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, corpus), n=5, percent=60).collect()}
    assert [got[i] for i in range(len(corpus))] == brute_components(corpus, 5, 60)


def test_jaccard_odd(spark):
    for df in odd_tables(spark):
        rows = jaccard_join.jaccard_components(df).collect()
        assert len(rows) == df.count()
        assert all(r["component_id"] == r["doc_id"] for r in rows)


def test_signatures_never_miss():
    """Sets that are linked agree on a signature key."""
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        plan = jaccard_join.scheme(percent)
        for size in (1, 2, 5, 9, 19, 40, 77, 150, 400):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                most = int(len(a) * (100 - percent) / 100)
                b = np.unique(np.concatenate((a[rng.permutation(len(a))[: len(a) - rng.integers(0, most + 1)]], rng.integers(0, 2**63, rng.integers(0, most // 2 + 1), dtype=np.uint64))))
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    assert np.intersect1d(plan.signatures(a), plan.signatures(b)).size


def test_signatures_of_others():
    """Sets without a common element hardly share a key, as empty segments count for nothing."""
    rng = np.random.default_rng(4)
    plan = jaccard_join.scheme(80)
    keys = [plan.signatures(np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))) for size in rng.integers(30, 45, 300)]
    _, count = np.unique(np.concatenate(keys), return_counts=True)
    assert int((count * (count - 1) // 2).sum()) < 300


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    for few in (0, 1000):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert all(got.get(i, i) == find(i) for i in range(60))
        assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, d in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = [words(rng, rng.choice([6, 30, 80])) for _ in range(12)]
    texts = []
    for _ in range(25):
        own = []
        for _ in range(3):
            line = rng.choice(lines)
            if rng.random() < 0.3:
                line = line.upper() + "!"
            if rng.random() < 0.3:
                parts = line.split()
                parts[rng.randrange(len(parts))] += "s"
                line = " ".join(parts)
            own.append(line)
        texts.append("\n".join([*own, "short line"]))
    texts += ["", None]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    seen = []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            norm = line_dedup.normalise(line)
            if len(norm.split()) >= 5:
                seen.append((i, k, norm))
    group = list(range(len(seen)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (_, _, x) in enumerate(seen):
        for j in range(i):
            y = seen[j][2]
            if levenshtein(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    gone = {(seen[i][0], seen[i][1]) for i in range(len(seen)) if find(i) != i}
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i]["text"] == kept and got[i]["n_removed"] == sum(g[0] == i for g in gone)
    for df in odd_tables(spark):
        assert line_dedup.line_dedup(df).count() == df.count()


def test_near_lines_against_edit_similarity_alone(spark):
    """A letter added to one word, and three to three words of a longer line, at all lengths: all copies go, as by brute force over all pairs."""
    rng = random.Random(21)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (14, 18, 25, 38, 50, 70, 110, 180, 300, 500) for _ in range(5)]
    lines = [line_dedup.normalise("one two three four " + x) for x in lines]
    copies = []
    for line in lines:
        own = line.split()
        for i in rng.sample(range(len(own)), 1 if len(line) < 60 else 3):
            own[i] += "q"
        copies.append(" ".join(own))
    both = lines + copies
    near = {j for j, y in enumerate(both) for x in both[:j] if levenshtein(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9)}
    assert len(near) == len(copies)
    got = line_dedup.line_dedup(table(spark, both)).where("n_removed > 0").collect()
    assert {r["doc_id"] for r in got} == near


def test_suffixes_of_one_anchor_that_are_equal_are_not_compared(monkeypatch):
    """The tree gets the entries of anchors with different suffixes only; replies are those of all windows compared, in chunks as whole."""
    rng = random.Random(31)
    heads = sorted(rng.randrange(2**64).to_bytes(8, "big") for _ in range(40))
    bodies = [[bytes(rng.choice(b"abc ") for _ in range(rng.randint(50, 70))) for _ in range(2 if k % 4 == 0 else 1)] for k in range(40)]
    bodies = [[b[0], *(x + b[0] for x in b[1:])] for b in bodies]
    runs, lows = [], []
    for _ in range(5):
        keys = sorted({h + rng.choice(b) for h, b in zip(heads, bodies, strict=True) if rng.random() < 0.8})
        runs.append(keys)
        lows.append(np.array([rng.randrange(30) for _ in keys], np.int64))
    blobs = [suffix_dedup.front_code(k, low) for k, low in zip(runs, lows, strict=True)]
    for keys, blob in zip(runs, blobs, strict=True):
        got, prefixes, _ = suffix_dedup.read_run(blob)
        assert got == keys and prefixes == [0, *(suffix_dedup.common_prefix(x, y, 0) for x, y in zip(keys, keys[1:], strict=False))]
    seen, merge = [], suffix_dedup.merge_runs
    monkeypatch.setattr(suffix_dedup, "merge_runs", lambda parts: (seen.append(x[0]) or x for x in merge(parts)))
    out = suffix_dedup._merge(50)(pd.DataFrame({"unit": range(5), "bucket": 3, "blob": blobs}))
    assert {k[:8] for k in seen} <= {h for k, h in enumerate(heads) if k % 4 == 0} and seen
    best: dict = {}
    for keys, low in zip(runs, lows, strict=True):
        for key, own in zip(keys, low.tolist(), strict=True):
            for o in range(8, len(key) - 49):
                at = (key[:8], key[o : o + 50])
                best[at] = min(best.get(at, own), own)
    for keys, low, reply in zip(runs, lows, out["reply"], strict=True):
        data, at = suffix_dedup._unpack(reply), 0
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, len(keys)))
        for key, own, code in zip(keys, low.tolist(), data[: len(keys)], strict=True):
            want = [best[key[:8], key[o : o + 50]] < own for o in range(8, len(key) - 49)]
            if code == 2:
                assert bits[at : at + len(want)].tolist() == want
                at += len(want)
            else:
                assert set(want) == {bool(code)}
    x = np.frombuffer(bytes(rng.choice(b"abc ") for _ in range(3000)), np.uint8)
    whole = suffix_dedup.anchors(x, 50, 24)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    assert (suffix_dedup.anchors(x, 50, 24) == whole).all()


def test_outliers_of_a_family_of_lines(spark, monkeypatch):
    """Lines that share keys and are mostly apart: found as by brute force, and their pairs become no rows."""
    rng = random.Random(29)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    base = [rng.choice(words) for _ in range(45)]
    lines = []
    for k in range(160):
        own = list(lines[k - 1].split() if k % 4 == 3 else base)
        for i in rng.sample(range(45), 1 if k % 4 == 3 else 6):
            own[i] = rng.choice(words)
        lines.append(" ".join(own))
    near = lambda x, y: line_dedup.edit_distance(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9)
    group = list(range(len(lines)))
    for j, y in enumerate(lines):
        for i in range(j):
            if near(lines[i], y):
                group = [group[i] if g == group[j] else g for g in group]
    first = {g: group.index(g) for g in group}
    made, write = [], linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df, name, **options: made.append((name, write(df, name, **options))) or made[-1][1])
    monkeypatch.setattr(linking, "BLOCK", 50, raising=False)
    counted = []
    groups = linking.linked_groups

    def counting(*args, **options):
        out = groups(*args, **options)
        counted.extend((name, df.count()) for name, df in made)
        return out

    monkeypatch.setattr(line_dedup, "linked_groups", counting)
    got = line_dedup.line_dedup(table(spark, lines)).where("n_removed > 0").collect()
    assert {r["doc_id"] for r in got} == {j for j in range(len(lines)) if first[group[j]] != j} and 30 < len(got) < 150
    assert "mixed" in dict(counted)
    assert [name for name, _ in counted].count("pairs") == 1  # of small keys and of the first meetings only


def test_within_edits():
    rng = random.Random(23)
    pairs = [tuple("".join(rng.choice("abcé日") for _ in range(rng.randint(0, 25))) for _ in range(2)) for _ in range(500)]
    pairs += [(x, edited(rng, x, rng.uniform(0, 0.3))) for x in ("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 120))) for _ in range(400))]
    pairs += [(x, edited(rng, x, rng.uniform(0, 0.2))) for x in ("".join(rng.choice("abcdefgh ") for _ in range(1200)) for _ in range(6))]
    distance = [levenshtein(x, y) for x, y in pairs]
    for most in ([0] * len(pairs), [2] * len(pairs), [rng.randint(0, 15) for _ in pairs], [max(0, d - 1 + k % 2) for k, d in enumerate(distance)]):
        got = line_dedup.within_edits([x for x, _ in pairs], [y for _, y in pairs], most, group=64)
        assert got.tolist() == [d <= m for d, m in zip(distance, most, strict=True)]


def test_near_line_filter_keeps_near_pairs(spark):
    """What the lengths and MinHashes rule out has too many edits, but for one in a hundred."""
    rng = random.Random(22)
    rows = []
    for k in range(600):
        x = "".join(rng.choice("abcdefghijklmnopxyz é日") for _ in range(rng.randint(10, 60) if k % 2 else rng.randint(60, 300)))
        y = list(x)
        for _ in range(rng.randint(1, 7) if len(x) <= 60 else rng.randint(1, len(x) // 8)):
            y[rng.randrange(len(y))] = rng.choice(["", "q", "bb"])
        rows.append((x, "".join(y)))
    data = []
    for pair in rows:
        pair = [line_dedup.normalise(z) or "a" for z in pair]
        made = line_dedup.signatures(pair, 0.9)
        sketch = line_dedup.sketches(made).tolist()
        near = levenshtein(*pair) <= line_dedup.most_edits(max(map(len, pair)), 0.9)
        data.append((*((len(z), *k) for z, k in zip(pair, sketch, strict=True)), near))
    info = "struct<chars:int," + ",".join(f"s{i}:long" for i in range(line_dedup.NIBBLES)) + ">"
    columns, arrays = line_dedup.may_be_near(0.9)
    df = spark.createDataFrame(data, f"x {info}, y {info}, near boolean").withColumn("may", columns(F.col("x"), F.col("y"))).cache()
    assert [r["may"] for r in df.collect()] == arrays(np.array([r["x"] for r in df.collect()]), np.array([r["y"] for r in df.collect()])).tolist()
    n = df.where("near").count()
    assert n > 50 and df.where("near and not may").count() <= 0.01 * n and df.where("not may").count() > 30
    # 3-grams rule out no near pair
    for x, y in rows:
        apart = np.abs(line_dedup.gram_counts([x]) - line_dedup.gram_counts([y])).sum()
        assert apart <= 6 * levenshtein(x, y)


def test_short_lines_repeat(spark, tmp_path):
    """In the query and in the pipeline lines of a few words, and of scripts without spaces, go like others; lines without a letter stay."""
    texts = ["Read more\nfirst text of its own", "read more!\n---\n日本語の行は一語です", "日本語の行は一語です\n---\n\nOK", "ok\nOKs"]
    want = [texts[0], "---\n日本語の行は一語です", "---\n\nOK", "OKs"]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == want
    staged = dict(corpus_pipeline.STAGES)["line_dedup"](spark, table(spark, texts), str(tmp_path)).orderBy("doc_id").collect()
    assert [r["text"] for r in staged] == want


def edited(rng, line, share):
    """The line with that share of its characters changed, dropped or followed by another one."""
    own = list(line)
    for i in rng.sample(range(len(own)), int(share * len(own))):
        own[i] = rng.choice([rng.choice("etaoins"), "", own[i] + rng.choice("etaoins")])
    return "".join(own)


@pytest.mark.parametrize(("low", "high"), [(10, 20), (20, 38), (38, 86), (86, 130), (130, 300), (300, 900)])
def test_near_line_keys_recall(low, high):
    """Of near lines with edits in 0 to 10 % of their characters, at least 0.9 share a key, in each length class; short ones all do."""
    rng = random.Random(low)
    lines = [line_dedup.normalise("".join(rng.choice("abcdefghilmnoprstu   ") for _ in range(rng.randint(low, high - 1)))) for _ in range(300)]
    pairs = [(x, edited(rng, x, rng.uniform(0, 0.1))) for x in lines if x]
    pairs = [(x, y) for x, y in pairs if levenshtein(x, y) <= line_dedup.most_edits(max(len(x), len(y)), 0.9)]
    where, keys = line_dedup.line_keys([z for pair in pairs for z in pair], 0.9)
    sets = [set() for _ in range(2 * len(pairs))]
    for i, k in zip(where.tolist(), keys.tolist(), strict=True):
        sets[i].add(k)
    found = sum(x == y or bool(sets[2 * i] & sets[2 * i + 1]) for i, (x, y) in enumerate(pairs))
    assert len(pairs) > 200 and found >= (1 if high <= 20 else 0.9) * len(pairs), found / len(pairs)


def test_prose_lines_seldom_share_keys():
    """Lines of the same few hundred words, in any order, share few keys by accident: rows of shared keys grow with the square of the lines."""
    rng = random.Random(41)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    lines = [" ".join(vocabulary[int(300 * rng.random() ** 2)] for _ in range(rng.randint(30, 120))) for _ in range(1500)]
    _, keys = line_dedup.line_keys(lines, 0.9)
    _, counts = np.unique(keys, return_counts=True)
    assert counts[counts > 1].sum() < 0.02 * len(keys)


def test_each_key_has_one_turn():
    rng = random.Random(42)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(8, 300))) for _ in range(200)]
    blobs = line_dedup.signatures(lines, 0.9)
    pairs = lambda where, keys: sorted(zip(where.tolist(), keys.tolist(), strict=True))
    parts = [pairs(*line_dedup.keys_of_signatures(blobs, turn, line_dedup.TURNS)) for turn in range(line_dedup.TURNS)]
    assert sorted(x for part in parts for x in part) == pairs(*line_dedup.keys_of_signatures(blobs))
    seen = [{k for _, k in part} for part in parts]
    assert all(seen) and not any(a & b for i, a in enumerate(seen) for b in seen[:i])


def test_banded_keys(spark):
    """Tags of a key meet where they are in reach, and, if the key isn't a large one, hardly elsewhere."""
    rng = random.Random(32)
    tags = [(rng.choice([8, 15, 16, 27, 28, 29, 60, 67, 160, 320]) << linking.KEY_BITS) | rng.randrange(10**6) for _ in range(500)]
    rows = [(rng.choice(tags), [rng.randrange(900) for _ in range(rng.randrange(4))] + [903 + rng.randrange(2)]) for _ in range(2500)]
    df = spark.createDataFrame(rows, "tag long, keys array<long>").repartition(5)
    spread = np.uint64(2**linking.KEY_BITS // 1000)

    def keys_of(batch):
        yield batch["tag"].to_numpy(), np.repeat(np.arange(len(batch)), [len(k) for k in batch["keys"]]), np.concatenate(list(batch["keys"])).astype(np.uint64) * spread

    held = {}
    for tag, keys in rows:
        for k in keys:
            held.setdefault(k, set()).add(tag)
    step = lambda t: t >> linking.KEY_BITS
    want = {(a, b) for own in held.values() for a in own for b in own if a < b and step(b) - step(a) <= linking.STEPS}
    met = {}
    got = linking.shared_keys(df, keys_of, 10_000, banded=True).collect()
    for r in got:
        met.setdefault(r["key"], set()).add(r["tag"])
    pairs = {(a, b) for own in met.values() for a in own for b in own if a < b}
    assert want <= pairs and all(step(b) - step(a) < 2 * linking.STEPS for a, b in pairs) and any(r["large"] for r in got) and not all(r["large"] for r in got)


def test_length_steps():
    for similarity in (0.5, 0.9, 0.95, 1.0):
        chars = np.arange(1, 3000)
        bands = line_dedup.length_steps(chars, similarity)
        shortest = chars - np.array([line_dedup.most_edits(int(n), similarity) for n in chars])
        assert (bands - line_dedup.length_steps(np.maximum(shortest, 1), similarity) <= linking.STEPS).all() and bands[-1] >= 80


def test_shared_keys(spark):
    """Keys that two tags or more have, whatever unit they come in, and a key of all."""
    rng = random.Random(31)
    rows = [(rng.randrange(400), [rng.randrange(3000) for _ in range(rng.randrange(6))] + [7]) for _ in range(3000)]
    df = spark.createDataFrame(rows, "tag long, keys array<long>").repartition(5)
    spread = np.uint64(2**linking.KEY_BITS // 3001)

    def keys_of(batch):
        yield batch["tag"].to_numpy(), np.repeat(np.arange(len(batch)), [len(k) for k in batch["keys"]]), np.concatenate(list(batch["keys"])).astype(np.uint64) * spread

    want = {}
    for tag, keys in rows:
        for k in keys:
            want.setdefault(k, set()).add(tag)
    want = {(k * int(spread), t) for k, tags in want.items() if len(tags) > 1 for t in tags}
    got = linking.shared_keys(df, keys_of, 10_000).collect()
    assert {tuple(r)[:2] for r in got} == want
    sizes = {}
    for k, _ in want:
        sizes[k] = sizes.get(k, 0) + 1
    assert all(r["large"] == (sizes[r["key"]] > linking.SMALL) for r in got) and any(r["large"] for r in got)
    assert linking.shared_keys(df.limit(0), keys_of, 0).count() == 0


def test_lines_of_rows_that_share_an_identifier(spark):
    """Each row loses its own repeats only; a copy of a whole row has the same result; a clashing column survives."""
    rows = [(1, "first line of its own\nthe line that both have", "x", 5), (1, "the line that both have\nanother line of its own", "y", 6), (1, "the line that both have\nanother line of its own", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, n_removed long").withColumn("row", F.lit(1)).withColumn("places", F.lit(2))
    got = sorted((r["_gone"], r["text"], r["n_removed"], r["row"], r["places"]) for r in line_dedup.line_dedup(df).collect())
    assert sum(r[2] for r in got[1:]) in (0, 2) and got[1][1:] == got[2][1:] and sum(r[2] > 0 for r in got) in (1, 2)
    assert all("of its own" in r[1] and r[3:] == (1, 2) for r in got)


def test_language_held_out(spark):
    rng = random.Random(8)
    stems = {"en": ["the", "ing", "tion"], "fr": ["le", "eau", "que"], "de": ["der", "ung", "sch"]}
    rows = []
    for i in range(150):
        lang = list(stems)[i % 3]
        rows.append((i, " ".join(rng.choice(stems[lang]) + rng.choice("abc") for _ in range(30)), lang))
    rows += [(200, None, "en"), (201, "123 !?", "en"), (None, "theing the", "en"), (202, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, F.col("doc_id") % 2 == 0, keep=("doc_id", "lang")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 150 and r["doc_id"] % 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (200, 201, 202)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language_id.identify(df, F.lit(False), keep=("doc_id",)).collect()} == {"und"}
    assert language_id.identify(df.limit(0), F.lit(True), keep=("doc_id",)).count() == 0


def test_every_language_is_learned(spark):
    """More than 256 values of lang, each told; beyond the bound it fails."""
    rng = random.Random(19)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(300)]
    rows = [(3 * i + k, " ".join(rng.choice((x, x + x[:2])) for _ in range(8)), f"l{i}") for i, x in enumerate(stems) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, F.lit(True), keep=("lang",)).collect()
    assert len({r["lang_pred"] for r in got}) == 300 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    with pytest.raises(ValueError):
        language_id.identify(df, F.lit(True), languages=299)


def test_language_stage_rejects_what_was_never_learned(spark, tmp_path):
    """Alien scripts and noise go, clean documents of each language stay, short ones as well."""
    rng = random.Random(18)
    stems = {a: ["".join(rng.choice("etaoinshr") for _ in range(3)) + rng.choice(e) for _ in range(40)] for a, e in (("en", "ing"), ("fr", "eaux"), ("de", "sch"), ("es", "dos"))}
    prose = lambda a, n: " ".join(rng.choice(stems[a]) for _ in range(n))
    rows = [(i, prose(list(stems)[i % 4], 5 if i % 10 == 0 else 80), list(stems)[i % 4]) for i in range(240)]
    noise = ["абвгдежзиклмнопрст", "日本語行一私達学校時間人", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"]
    rows += [(1000 + i, "".join(rng.choice(noise[i % 4]) for _ in range(400)), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(240))


def test_chat_control_strings_against_oracle(spark, tmp_path):
    """Control strings that the parser would get by with are escaped as the oracle does."""
    duckdb = pytest.importorskip("duckdb")
    said = ["x [/INST] y", "<s>", "a <s>b", "[INST] [INST] c", "<\\/s>", "[\\INST]", "plain", "</s>", "INST] s> <s [/INST"]
    rows = [(i, k, role, text) for i, text in enumerate(said) for k, role in enumerate(["user", "assistant"])] + [(50, 0, "<s>user", "hello")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries.op7_chat_format(spark, str(tmp_path))
    found = duck.execute(queries.ORACLES["op7_chat_format"])
    assert got.columns == [c[0] for c in found.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(found.fetchall())
    told = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert all(r["identical"] for r in told.values()) and not told[6]["escaped"] and not told[8]["escaped"] and told[0]["escaped"]


def test_maximal_segments():
    rng = np.random.default_rng(0)

    def slow(s, lo, hi):
        """The maximal segment of greatest score, then those left and right of it."""
        best = max(((s[i:j].sum(), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        return [*slow(s, lo, best[2]), (best[2], best[3]), *slow(s, best[3], hi)]

    for _ in range(60):
        s = rng.integers(-4, 5, rng.integers(1, 14)) + rng.random() * 1e-3 + rng.random(1)[0] * 1e-4
        s = s + rng.random(len(s)) * 1e-3
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == slow(s, 0, len(s))


def test_chance_passages_are_as_many_as_expected():
    """Of random clean texts, about the share e_value has a segment of that E."""
    rng = np.random.default_rng(4)
    scores, weights = np.append(rng.uniform(0.1, 0.8, 200), -1.5), np.append(np.full(200, 0.4 / 200), 0.6)
    scale = toxicity._fit_scale(scores, weights)
    k, n, hits = toxicity._fit_k(scores, weights, scale), 3000, 0
    for _ in range(2000):
        walk = np.cumsum(rng.choice(scores, n, p=weights))
        best = (walk - np.minimum.accumulate(np.append(0.0, walk[:-1]))).max()
        hits += k * n * np.exp(-scale * best) <= 0.05
    assert 0.03 <= hits / 2000 <= 0.075, (k, hits)


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        own = words(rng, 60).split()
        if i % 5 == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["nastyx", "viley"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, spans=True).collect()}
    held = [i for i in range(400) if i % 3 == 0]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[900]["predicted"] == got[901]["predicted"] == 0 and got[900]["passages"] == []
    first = got[0]["passages"][0]
    assert {"nastyx", "viley"} & set(rows[0][1].split()[first["first"] : first["after"]])
    nothing = toxicity.learn(docs.limit(0), marks.limit(0))
    assert toxicity.score(docs, nothing).where("predicted = 1").count() == 0


def test_tokens_match_the_library():
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    library = Tokenizer.from_file(path)
    coder = tokens.TokenCoder(path, cached_words=50)
    rng = random.Random(1)
    texts = ["", " a", "a  b", "a\n\nb", " x\n", "a\n b \n c", "tab\tx", "it's we'll.", "a\x1c b", "a b", "é ß 日本 語", "a \n", "1.5, x."]
    texts += ["".join(rng.choice(["a", "é", " ", "\n", ".", ",", "'s", "7", "\t", "日", "x"]) for _ in range(40)) for _ in range(300)]
    for t in texts:
        ids = coder(t)
        assert [*struct.unpack(f"<{len(ids) // 4}I", ids)] == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_as_the_library_loads_them():
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    library = Tokenizer.from_file(path)
    coder = tokens.coder(path)
    for t in ["<|endoftext|> x", "a <|endoftext|>", "a b<|endoftext|><|endoftext|>\n\nc  d ", "<|endoftext|", "<|endoftext|>", "plain text", ""]:
        ids = coder(t)
        assert [*struct.unpack(f"<{len(ids) // 4}I", ids)] == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark, corpus):
    df = table(spark, [*corpus, "word " * 3000])
    packed = packing.pack_documents(df, items_per_partition=25, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    coder = tokens.coder(tokens.default_vocabulary())
    for i, t in enumerate([*corpus, "word " * 3000]):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in parts) == coder(t or "") + struct.pack("<I", 2)
        assert all(r["length"] == 1024 for r in parts[1:]) and [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == [sum(x["length"] for x in parts[:k]) for k in range(len(parts))]
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    sizes = np.array([r["length"] for r in packed])
    assert packing.lower_bound(sizes) <= len(by_seq) <= packing.lower_bound(sizes) + 2
    for odd in odd_tables(spark):
        assert packing.pack_documents(odd).select("doc_id", "length").count() == odd.count()


def test_lower_bound_holds():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 1025, rng.integers(0, 60))
        bins, offsets, fill = packing.best_fit_decreasing(sizes)
        assert packing.lower_bound(sizes) <= len(fill) and (fill <= 1024).all() and fill.sum() == sizes.sum()
    assert packing.lower_bound(np.array([600] * 7)) == 7
    assert packing.lower_bound(np.array([400] * 5)) == 3


def test_topk(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(7)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None] + [0.0] * 5), (62, [float("nan")] + [0.0] * 6), (63, [float("inf")] * 7), (64, rows[3][1]), (65, [1.0, 2.0]), (70, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 10 == 0, k=4, vector_block=16, query_block=2).collect()
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i not in (60, 61, 62, 63)}
    for q in range(0, 60, 10):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == 7)[:4]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in scores]
    assert not [r for r in got if r["query_id"] in (60, 70)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    huge = spark.createDataFrame([(0, [3e30, 1.0]), (1, [3e30, 2.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert topk_search.top_k(huge, F.col("vec_id") == 0).count() == 2


def test_topk_prunes_clusters():
    """Of vectors in clusters under 0.4 are scored exactly, and the result is that of all scores."""
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(size=(20, 16)), 4, axis=1)
    v = np.floor(1024 * (centres[rng.integers(0, 20, 4000)] + 0.1 * rng.normal(size=(4000, 64))))
    ids, counts = np.arange(4000), [0, 0]
    got = list(topk_search.block_top_k(ids[:80], v[:80], ids, v, 10, counts=counts))
    for i in range(80):
        score = v @ v[i]
        want = sorted((-int(score[j]), j) for j in range(4000) if j != i)[:10]
        assert [(-s, j) for q, j, s in got if q == i] == want
    assert counts[0] < 0.4 * counts[1], counts


def test_mixing_targets_out_of_reach(spark):
    df = spark.createDataFrame([(i, "a b c", "xyz"[i % 3 % (1 + i % 2)]) for i in range(60)], "doc_id long, text string, source string")
    for bad in ({"budget": 900, "max_repeats": 2.0}, {"max_repeats": None, "entropy": 5.0}):
        with pytest.raises(ValueError):
            mixing.mix(df, **bad)
    low = mixing.mix(df, max_repeats=None, entropy=0.2).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()
    p = np.array([r["t"] for r in low if r["t"]], float) / sum(r["t"] for r in low)
    assert abs(-(p * np.log(p)).sum() - 0.2) < 0.1


def test_exact_dedup_extremes(spark):
    """The ends of the range of identifiers, beside null ones."""
    rows = [(-(2**63), "a"), (2**63 - 1, "a"), (None, "a"), (None, "b"), (2**63 - 1, "c"), (None, "c"), (-(2**63), "d"), (None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep, ends in (("smallest", (-(2**63), 2**63 - 1)), ("largest", (2**63 - 1, -(2**63)))):
        got = {(r["doc_id"], r["text_sha256"][:6]): (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(df, keep=keep).collect()}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:6]
        assert got[ends[0], sha("a")] == (ends[0], True) and got[ends[1], sha("a")] == (ends[0], False) and got[None, sha("a")] == (ends[0], False)
        assert got[None, sha("b")] == (None, True) and got[2**63 - 1, sha("c")][1] and got[-(2**63), sha("d")][1]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_with_clashing_names(spark, tmp_path, stage):
    """Columns named as those inside the operators keep their values."""
    names = ["score", "lang_pred", "known", "_text", "row", "_row", "_id", "_gone", "n_removed", "n_lines", "n_tokens", "copies", "place", "_key", "_source", "_block", "_passes", "places", "text_hash", "component_id"]
    rows = [(i, f"the word number {'abcdefghij'[i % 10] * 3} of the text {'klmnopqrst'[i // 10] * 4}", "en", "s", 10, *[f"{n}{i}" for n in names]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    got = dict(corpus_pipeline.STAGES)[stage](spark, df, str(tmp_path))
    assert got.columns == df.columns
    kept = got.collect()
    assert kept and all(r[n] == f"{n}{r['doc_id']}" for r in kept for n in names)
    assert dict(corpus_pipeline.STAGES)[stage](spark, df.limit(0), str(tmp_path)).count() == 0


def test_mixing_sends_no_text(spark):
    """Where blocks are few, rows are joined with them in place."""
    df = spark.createDataFrame([(i, f"s{i % 3}", "a b c " * (i % 5)) for i in range(60)], "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mix(df, blocks=16)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_mixing(spark):
    rows = [(i, "tok " * (1 + i % 7), "big" if i < 300 else f"small{i % 2}" if i < 340 else None) for i in range(345)]
    df = spark.createDataFrame([*rows, (900, None, "big"), (901, " ", None)], "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))
    got = mixing.mix(df, max_repeats=2.0, blocks=16).collect()
    assert len(got) == 347 and df.columns[:3] == list(got[0].asDict())[:3]
    total = sum(r["n_tokens"] for r in got)
    by = {}
    for r in got:
        own = by.setdefault(r["source"], [0, 0])
        own[0] += r["n_tokens"]
        own[1] += r["n_tokens"] * r["copies"]
    assert all(taken <= 2 * have + 1e-9 for have, taken in by.values())
    assert max(taken / have for have, taken in by.values()) > 1.9
    assert 0.97 * total <= sum(t for _, t in by.values()) <= total
    assert mixing.realise(mixing.mix(df)).count() == sum(r["copies"] for r in mixing.mix(df).collect())
    even = mixing.mix(df, max_repeats=None, entropy=1.2).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()
    p = np.array([r["t"] for r in even if r["t"]], float)
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 1.2) < 0.05
    for odd in odd_tables(spark):
        assert mixing.mix(odd).count() == odd.count()


def test_suffix_dedup(spark):
    rng = random.Random(11)
    passages = [words(rng, 15) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [words(rng, rng.randint(0, 12)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[4], texts[4] + "!", "", None, "ab" * 100, "ab" * 90, "日本語" * 40, "x日本語" * 40, "a" * 49, "a" * 49, "a" * 50, "a" * 50]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table(spark, texts), unit_bytes=700, texts=True).collect()}
    seen = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        windows = [b[p : p + 50] for p in range(len(b) - 49)]
        gone = [False] * len(b)
        for p, w in enumerate(windows):
            if w in seen:
                gone[p : p + 50] = [True] * 50
        seen.update(windows)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(b), sum(gone), spans, kept)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    for df in odd_tables(spark):
        assert suffix_dedup.remove_repeats(df).count() == df.count()


def test_loser_tree():
    rng = random.Random(12)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 12))}) for _ in range(k)]
        coded = [suffix_dedup.read_run(suffix_dedup.front_code(r, np.zeros(len(r), np.int64))) for r in runs]
        merged = list(suffix_dedup.merge_runs([(c[0], c[1]) for c in coded]))
        assert [m[0] for m in merged] == sorted(x for r in runs for x in r)
        assert all(runs[r][i] == key for key, r, i in merged)


def test_pipeline(spark, corpus, tmp_path):
    """Stage by stage on its own input; clean documents stay, decisions take effect."""
    docs = table(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, str(tmp_path)).cache()
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0
    lines = stages["line_dedup"](spark, kept, str(tmp_path)).cache()
    assert lines.columns == docs.columns and 0 < lines.count() <= kept.count()
    near = stages["jaccard_join"](spark, lines, str(tmp_path)).cache()
    own = [(r["doc_id"], r["text"]) for r in lines.orderBy("doc_id").collect()]
    want = {own[i][0] for i, (_, c) in enumerate(brute_components([t for _, t in own], 5, 80)) if c == i}
    assert {r["doc_id"] for r in near.collect()} == want
    mixed = stages["mixing"](spark, near, str(tmp_path)).cache()
    assert mixed.columns == docs.columns and mixed.count() > 0
    pieces = stages["packing"](spark, mixed, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in pieces) == mixed.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_language_model_is_fit_in_little_memory():
    """The driver holds the landmarks and a few rows at a time, not all learned rows as floats."""
    import tracemalloc

    rng = np.random.default_rng(3)
    seen = (rng.random((400, language_id.DIMS)) < 0.02).astype(np.uint8)
    tracemalloc.start()
    names, matrix = language_id.fit(seen, [("da", "de", "en", "fr")[i % 4] for i in range(400)], 64, 1e-2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(names) == 4 and matrix.shape == (language_id.DIMS, 4) and peak < 3 * seen.nbytes
