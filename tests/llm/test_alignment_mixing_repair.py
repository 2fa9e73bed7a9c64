"""Tokenizer alignment, source mixing and conversation repair against plain brute-force versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from neurospan.llm import alignment, mixing, queries, repair
from neurospan.llm.shared import table

DOCS = "doc_id bigint, text string, source string, size string, row string, pair int"
ODD = [None, "", " ", "hello  world", "<|endoftext|> and </s> <s>", "▁ marks ▁▁", "naïve café 日本語 🙂🙂", "a" * 3000, "tab\tand\nline\r\n", "x" * 9 + " 12345 67.8", "don't we'll  "]


@pytest.fixture(scope="module")
def files():
    return alignment.read_file(queries.BYTE_LEVEL_FILE), alignment.read_file(queries.SENTENCEPIECE_MODEL)


def plain_alignment(rows):
    """Straight from the definition: token ends in dictionaries, one text after the other."""
    one = Tokenizer.from_file(queries.BYTE_LEVEL_FILE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=queries.SENTENCEPIECE_MODEL)
    letters = alignment._byte_letters()

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(k)) for k in a]
        shown = [two.id_to_piece(k) for k in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in shown]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        where = {e: j for j, e in enumerate(ends_b)}
        links = [(i, where[e]) for i, e in enumerate(ends_a) if e in where]
        counts.update((a[i], b[j]) for i, j in links)
        docs.append((doc_id, a, b, links, None))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for doc_id, a, b, links, _ in docs:
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        pairs = [(a[i], b[j]) for i, j in links]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return sorted(out, key=str)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_matches_definition(spark, files):
    rng = random.Random(2)
    parts = ["the ", "un", "break", "able", " ", "  ", "é", "日本", "🙂", "\n", "123", "=", "▁", "</s>", "Zürich"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(1, "twice"), (1, "twice")]
    docs = spark.createDataFrame([(i, t, "s", "x", "y", 1) for i, t in rows], DOCS)
    out = alignment.aligned_totals(docs, *files).select(*ALIGNED)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_alignment(rows)


def test_alignment_of_the_documents(spark, files):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    out = queries.op11(spark, "/root/testdata/sf0.001")
    want = plain_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in out.select(*ALIGNED).collect()), key=str) == want


def test_alignment_joins_without_a_copy_of_the_counts(spark, files):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = sorted(map(tuple, alignment.aligned_totals(docs, *files).drop("row").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, alignment.aligned_totals(docs, *files).drop("row").collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_alignment_of_nothing(spark, files):
    assert alignment.aligned_totals(spark.createDataFrame([], DOCS), *files).count() == 0
    none = spark.createDataFrame([(1, None, None, None, None, None)], DOCS)
    assert [tuple(r) for r in alignment.aligned_totals(none, *files).select(*ALIGNED).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 64, 1 << 14])
def test_merge_path_pieces(steps):
    rng = np.random.default_rng(3)
    for _ in range(60):
        a = np.unique(rng.integers(0, 80, rng.integers(0, 60)))
        b = np.unique(rng.integers(0, 80, rng.integers(0, 60)))
        i, j = alignment.common_ends(a, b, steps)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_split_points_are_those_of_the_merge():
    rng = np.random.default_rng(4)
    a, b = np.unique(rng.integers(0, 99, 40)), np.unique(rng.integers(0, 99, 50))
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    for d in range(len(merged) + 1):
        assert alignment.split_points(a, b, np.array([d]))[0] == sum(side == 0 for _, side in merged[:d])


def test_general_byte_level_file_gives_the_same_ids(files):
    import json

    spec = json.loads(files[0])
    spec["model"]["merges"] = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    fast = alignment.ByteLevel(json.dumps(spec).encode())
    spec["pre_tokenizer"]["add_prefix_space"] = True  # only the other library knows this
    slow = alignment.ByteLevel(json.dumps(spec).encode())
    texts = [" " + t for t in ODD if t]
    assert fast.encode(texts) == slow.encode(texts)
    with pytest.raises(ValueError):
        alignment.ByteLevel(json.dumps(spec | {"normalizer": {"type": "NFC"}}).encode())


# --- mixing


def shares(sizes, weights, share, most):
    """Share out again and again what lies above the limits."""
    mix, limit, open_ = share * sum(sizes), [most * s for s in sizes], set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        left = mix - sum(target[k] for k in range(len(sizes)) if k not in open_)
        total = sum(weights[k] for k in open_)
        now = {k: left * weights[k] / total for k in open_}
        above = {k for k in open_ if now[k] > limit[k]}
        if not above:
            for k in open_:
                target[k] = now[k]
            break
        for k in above:
            target[k] = limit[k]
        open_ -= above
    return target


def mixed_docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in rows], DOCS)


def test_mix_against_repeated_sharing(spark):
    rng = random.Random(5)
    names = ["b", "ä", "a", None, "", "Z", "\U0001f642", "zz"]
    rows = [(k, None if k % 31 == 0 else " ".join(rng.choice("ab cd") for _ in range(rng.randint(0, 300 if k % 5 else 9))), rng.choice(names)) for k in range(400)]
    rows += [(1000 + k, "hot words here", "a") for k in range(300)] + [(None, "no id", "a"), (7, "same id", "b"), (5000, "long " * 5000, "zz")]
    out = mixing.mix(mixed_docs(spark, rows)).collect()
    assert len(out) == len(rows)
    order = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + [None]
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x in rows if x == s) for s in order}
    want = dict(zip(order, shares([size[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2.0), strict=True))
    taken = Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["extra"] <= r["size"] and r["taken"] == r["epochs"] * r["size"] + r["extra"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in order} == {s: round(want[s]) for s in order}
    cut_off = Counter(r["source"] for r in out if 0 < r["extra"] < r["size"])
    assert all(n <= 1 for n in cut_off.values())


def test_mix_follows_quality(spark):
    rows = [(k, f"w{k} " * 50, "only", "x", "y", 1 if k % 2 else 20) for k in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs, share=0.2, quality="pair").groupBy((F.col("doc_id") % 2 == 0).alias("good")).agg(F.sum("taken").alias("n")).collect()
    n = {r["good"]: r["n"] for r in out}
    assert sum(n.values()) == 20000 and n[True] > 6 * n[False]


def test_mix_reruns_agree_however_the_rows_are_dealt(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(13, F.rand(3))).collect()))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    blank = mixing.mix(mixed_docs(spark, [(1, None, "a"), (2, "", None), (3, " \t", "a")])).collect()
    assert len(blank) == 3 and all(r["taken"] == 0 and r["target"] == 0 for r in blank)
    odd = mixing.mix(spark.createDataFrame([(k, "a b", "s", "x", "y", w) for k, w in enumerate([None, 0, -1, 5])], DOCS), share=0.25, quality="pair")
    assert {r["doc_id"]: r["taken"] for r in odd.collect()} == {0: 0, 1: 0, 2: 0, 3: 2}
    with pytest.raises(ValueError):
        mixing.mix(mixed_docs(spark, [(1, "a", "s")]), share=3.0)


# --- repair


def cheapest(initials, faults):
    """Cheapest edits, first in ASCII order: uniform-cost search over (cost, edits)."""
    heap, done = [(0, "", 0, repair.START)], set()
    while True:
        cost, path, k, state = heapq.heappop(heap)
        if k == len(faults) and state in (repair.START, repair.ASSISTANT):
            return cost, path
        if (k, state) in done:
            continue
        done.add((k, state))
        role, after = ("a", 3) if state == 2 else ("u", 2)
        heapq.heappush(heap, (cost + 2, path + "I", k, after))
        if k < len(faults):
            heapq.heappush(heap, (cost + 3, path + "D", k + 1, state))
            if faults[k] in ("", "truncated"):
                extra = faults[k] == "truncated"
                heapq.heappush(heap, (cost + 2 + extra, path + "R", k + 1, after))
                if initials[k] == role:
                    heapq.heappush(heap, (cost + extra, path + "K", k + 1, after))
                elif initials[k] == "s" and state == repair.START:
                    heapq.heappush(heap, (cost + extra, path + "K", k + 1, repair.SYSTEM))


def plain_report(rows):
    """The contract row by row; rows are (conv_id, turn, role, text)."""
    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what:
            row = (turn, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)
            convs[conv] += [row] * (2 if what == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in own if t is not None}
        roles = [r for _, r, _ in own]
        cost, audit = cheapest([r[:1] for r in roles], faults)
        fixed = repair.apply_edits(audit, repair.START, [r[1:] for r in own])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in fixed))
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


CONVS = "conv_id bigint, turn bigint, role string, text string, audit string, part int, n int"
REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONVS)


def odd_conversations(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "student", "U"]
    texts = ["Yes.", "No!", "What?", "a cut", "", None, " \t", "Zwei Wörter.", "x\n", "Yes. "]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rng.choice(rows))
    return rows


@pytest.mark.parametrize("segment_rows", [1, 3, 32])
def test_repair_matches_uniform_cost_search(spark, segment_rows):
    rows = odd_conversations(7, 150)
    out = repair.repair_report(conversations(spark, rows).repartition(5), segment_rows)
    assert sorted((tuple(r) for r in out.select(*REPORT).collect()), key=str) == plain_report(rows)


def test_repair_of_a_hot_conversation(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{k}.", f"{k}"])) for k in range(1500)]
    rows += [(1, 3, "user", "again and again.")] * 400 + odd_conversations(9, 40)
    out = repair.repair_report(conversations(spark, rows))
    assert sorted((tuple(r) for r in out.select(*REPORT).collect()), key=str) == plain_report(rows)


def test_repair_of_the_conversations(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in out.select(*REPORT).collect()), key=str) == plain_report(rows)


def test_repair_of_nothing(spark):
    assert repair.repair_report(conversations(spark, [])).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    out = repair.repair_report(conversations(spark, [(gone, 0, "user", "Hello."), (None, None, None, None)])).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in out}
    empty = hashlib.sha256(b"").hexdigest()
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", empty)
    assert found[None] == plain_report([(None, None, None, None)])[0][1:]


def test_search_equals_uniform_cost_search():
    rng = random.Random(10)
    for _ in range(2000):
        n = rng.randint(0, 9)
        initials = [rng.choice(["u", "a", "s", "x", ""]) for _ in range(n)]
        faults = [rng.choice(["", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        assert repair.Search(initials, faults, repair.DONE).best(repair.START) == cheapest(initials, faults)


def test_long_text_in_a_repaired_row(spark):
    text = "word " * 200_000 + "end."
    rows = [(2, 0, "user", text), (2, 1, "assistant", "Good.")]
    assert sorted(map(tuple, repair.repair_report(conversations(spark, rows)).select(*REPORT).collect())) == plain_report(rows)
