"""Exact and SimHash dedup against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from neurospan.llm import exact, similar, simhash
from neurospan.llm.components import components

SCHEMA = "doc_id bigint, text string, label string, fp string, recipe string"


def corpus(seed=3, n=220):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Äpfel", "naïve", "x.", "END!\n"]
    texts = ["", None, " ", "One", "one", "a b c", "A\tB\nc", "long " * 6000]
    for _ in range(n):
        if len(texts) > 20 and rng.random() < 0.5:
            parts = rng.choice(texts[8:]).split(" ")
            if rng.random() < 0.6:
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))))
    rows = [(k * 3 + 1, t, "l", "f", "r") for k, t in enumerate(texts)]
    return rows + rows[5:8] + [(None, "a b c", "l", "f", "r"), (None, "only here", "l", "f", "r")]


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(fps, radius):
    up = list(range(len(fps)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    return [root(k) for k in range(len(fps))]


def expected_near(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = groups_of(fps, 4)
    least = {}
    for r, g in zip(rows, roots):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", least.get(g)) for r, f, g in zip(rows, fps, roots)), key=str)


@pytest.mark.parametrize("tree_rows", [4096, 5])
def test_near_groups(spark, tree_rows):
    rows = corpus()
    got = simhash.near_groups(spark.createDataFrame(rows, SCHEMA), tree_rows=tree_rows).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == expected_near(rows)


def test_links_lose_nothing_in_dense_clusters(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(250):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = groups_of(fps, 4)
    for rows in (4096, 40):
        found = simhash.links(spark.createDataFrame(signed, "fp bigint"), tree_rows=rows)
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in found.collect())
        root = {r["node"]: r["root"] for r in components(found).collect()}
        got = [root.get(s, s) for (s,) in signed]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_drop_near_keeps_one_of_each_group(spark):
    rows = corpus()
    kept = simhash.drop_near(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "label", "fp", "recipe"]
    want = sorted(str(i) for i, _, c in expected_near(rows) if i == c)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def expected_exact(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1] or "", []).append(r[0])
    out = []
    for r in rows:
        ids = [i for i in by[r[1] or ""] if i is not None]
        keep = max(ids) if ids else None
        out.append((r[0], keep, len(by[r[1] or ""]), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("label", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(7))])
def test_exact_groups(spark, label):
    """The second label makes different chunks collide, so identifiers have to be told apart by text."""
    rows = corpus()
    got = exact.exact_groups(spark.createDataFrame(rows, SCHEMA), label).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == expected_exact(rows)


def test_chunks_are_the_text(spark):
    texts = [("",), ("a. b\n" * 900,), ("x" * 30000,), ("🙂." * 2000,), ("\n" * 5000,)]
    rows = spark.createDataFrame(texts, "text string").select("text", exact.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] and all(0 < len(c) <= exact.MOST_CHARS for c in r["c"]) for r in rows)


def test_chunks_follow_content(spark):
    """After an insertion the cuts fall back into place, so later chunks are shared."""
    rng = random.Random(1)
    body = " ".join(rng.choice(["thor", "beat", "gamma", "delta\n"]) + str(rng.randrange(999)) + rng.choice(["", "ar.", "on.", "in.\n", "es", "ri."]) for _ in range(4000))
    two = spark.createDataFrame([(body,), ("Something new. " + body,)], "text string").select(exact.chunks(F.col("text")).alias("c")).collect()
    assert len(set(two[0]["c"]) & set(two[1]["c"])) > len(two[0]["c"]) // 2


def test_drop_exact(spark):
    rows = corpus()
    kept = exact.drop_exact(spark.createDataFrame(rows, SCHEMA))
    want = sorted(str(e[0]) for e in expected_exact(rows) if e[3])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


@pytest.mark.parametrize("run", [simhash.near_groups, exact.exact_groups])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def similar_case():
    """Chains of edited copies around the threshold, hot groups, texts without words, repeated and missing ids."""
    rng = random.Random(9)
    texts = [None, "", " \n", "one two", "One TWO", "one two three"]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 40, 150, 600]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 2, 12])):
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(base))
    rows = [(3 * k + 1, t, "l", "f", "r") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + rows[:3] + [(None, rows[0][1], "l", "f", "r"), (None, "only here", "l", "f", "r")]


def expected_similar(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        up[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return pairs, [least.get(root(k)) for k in range(len(rows))]


def test_near_stage_drops_all_similar_texts(spark):
    """The stage's rule is similarity, which copies with more than four differing fingerprint bits meet as well."""
    import corpus_pipeline

    rows = similar_case()
    pairs, want = expected_similar(rows)
    fps = [plain_fingerprint(r[1]) for r in rows]
    assert sum((fps[i] ^ fps[j]).bit_count() > 4 for i, j in pairs) > 20
    docs = spark.createDataFrame(rows, SCHEMA)
    got = similar.similar_groups(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], c) for r, c in zip(rows, want)), key=str)
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r, c in zip(rows, want) if r[0] == c)
    assert similar.similar_groups(docs.limit(0)).count() == 0


def edited_group(rng, n, words, edits, vocabulary):
    """Copies of one text, each with some words of its own; any two of them share a little more or less than 0.8."""
    base = [f"b{k}" for k in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"v{rng.randrange(vocabulary)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("words, edits, vocabulary", [(150, 2, 10**6), (150, 3, 3), (120, 2, 40), (90, 4, 10)])
def test_large_group_just_below_the_threshold(spark, words, edits, vocabulary):
    rng = random.Random(words + edits)
    texts = edited_group(rng, 260, words, edits, vocabulary)
    texts += [" ".join([t, *[f"tail{i}{k % 3}" for i in range(12)]]) for k, t in enumerate(texts[:60])]
    rows = [(k, t, "l", "f", "r") for k, t in enumerate(texts)]
    pairs, want = expected_similar(rows)
    got = similar.similar_groups(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], c) for r, c in zip(rows, want, strict=True))


def test_group_without_any_link(spark):
    """Every text changes other words: all pairs are alike, none reaches the threshold."""
    base = [f"b{k}" for k in range(400)]
    texts = []
    for k in range(60):
        own = list(base)
        own[6 * k + 3 : 6 * k + 4] = [f"x{k}"]
        own += [f"only{k}w{i}" for i in range(45)]
        texts.append(" ".join(own))
    rows = [(k, t, "l", "f", "r") for k, t in enumerate(texts)]
    pairs, _ = expected_similar(rows)
    assert not pairs
    got = similar.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got)


def test_group_is_compared_in_blocks_or_by_its_shingles(spark, monkeypatch):
    """Blocks of a few texts, and the smaller groups that only groups beyond ``whole`` are cut into, find the same links."""
    rng = random.Random(5)
    texts = edited_group(rng, 50, 120, 4, 30)
    rows = [(k, t, "l", "f", "r") for k, t in enumerate(texts)]
    want = sorted((r[0], c) for r, c in zip(rows, expected_similar(rows)[1], strict=True))
    cuts, subgroups = [], similar._subgroups
    monkeypatch.setattr(similar, "_subgroups", lambda *a: cuts.append(1) or subgroups(*a))
    nodes = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node bigint, text string")
    for whole, block in ((4096, 16), (30, 8)):
        del cuts[:]
        found = similar.components(similar.links(nodes, whole=whole, block=block)).collect()
        roots = dict(map(tuple, found))
        assert [(k, roots.get(k, k)) for k in range(len(texts))] == want
        assert bool(cuts) == (whole == 30)


def test_very_long_similar_texts(spark):
    one = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, one, "l", "f", "r"), (2, one.replace("w777 ", "other "), "l", "f", "r"), (3, one[: len(one) // 2], "l", "f", "r")]
    got = similar.similar_groups(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 3)]
