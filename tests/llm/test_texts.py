"""Decontamination, sentence spans, personal data and classifiers against brute force on small tables."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurospan.llm import decontaminate, personal, quality, spans, toxicity
from neurospan.llm.shared import crc32_fold

SCHEMA = "doc_id bigint, text string, removed string, score string, spans string, places string"


def frame(spark, texts, extra=()):
    rows = [(k, t, "x", "y", "z", "p") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- decontamination ---------------------------------------------------------


def benchmark_case():
    rng = random.Random(2)
    items = [(k, " ".join(words(rng, rng.choice([3, 5, 6, 12, 33, 60])))) for k in range(40)]
    items += [(40, None), (41, ""), (42, items[6][1]), (None, items[7][1]), (43, "One two\tTHREE")]
    texts = [None, "", "one two three", "one two three four", " ".join(words(rng, 20000))]
    for k in range(150):
        own = words(rng, rng.randint(0, 400))
        if k % 2:
            item = (rng.choice(items[:40])[1]).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() for w in item] if k % 4 == 1 else item
        texts.append("\n".join(own) if k % 3 == 0 else " ".join(own))
    return items, texts


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("copied", ["10MB", "-1"])
def test_contaminated(spark, copied):
    """With small tables copied to the tasks, and with every join dealt out."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", copied)
    try:
        check_contaminated(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check_contaminated(spark):
    items, texts = benchmark_case()
    docs = frame(spark, texts, [(3, texts[3], None, None, None, None), (None, "one two three", None, None, None, None)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r)[:4] for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    want = []
    for doc_id, text in [*enumerate(texts), (3, texts[3]), (None, "one two three")]:
        for item_id, item in items:
            a, b = plain_shingles(text), plain_shingles(item)
            if b and len(a & b) >= 0.8 * len(b) - 1e-9:
                want.append((doc_id, item_id, len(a & b), len(b)))
    assert got == sorted(want, key=str)
    bad = {d for d, *_ in want}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k in [*range(len(texts)), 3] if k not in bad)


# --- sentence spans ----------------------------------------------------------


def test_nothing_to_be_contaminated_by(spark):
    docs, none = frame(spark, ["one two three four five six", None]), spark.createDataFrame([], "item_id bigint, text string, doc_id string, clean boolean")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.drop_contaminated(docs, none).count() == 2
    items = spark.createDataFrame([(1, "one two three four five six", "x", True)], none.schema)
    empty = docs.limit(0)
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.drop_contaminated(empty, items).count() == 0
    named = docs.withColumnsRenamed({"score": "clean", "spans": "item_row"})
    left = decontaminate.drop_contaminated(named, items)
    assert left.columns == named.columns and [r["doc_id"] for r in left.collect()] == [1]


def plain_removal(rows):
    """The full rule: every run of two or more sentences and twenty or more words (none that repeats has 60 sentences)."""
    found, seen = defaultdict(set), set()
    for doc_id, text in sorted(rows):
        units = spans.sentences(text or "")
        for i in range(len(units)):
            total = 0
            for j in range(i, min(len(units), i + 60)):
                total += len(text[slice(*units[j])].split())
                if total >= 20 and j > i:
                    body = tuple(tuple(text[slice(*u)].split()) for u in units[i : j + 1])
                    if body in seen:
                        found[doc_id] |= set(range(i, j + 1))
                    seen.add(body)
    return {d: "".join((text or "")[slice(*u)] for k, u in enumerate(spans.sentences(text or "")) if k not in found[d]) for d, text in rows if found[d]}


def span_texts():
    rng = random.Random(4)
    sentence = lambda: " ".join(words(rng, rng.randint(1, 14))) + rng.choice([". ", "! ", ", ", "\n", "... "])
    passages = ["".join(sentence() for _ in range(12)) for _ in range(4)]
    texts = [None, "", "...", "One. Two.", passages[0], passages[0] + passages[0]]
    for _ in range(40):
        own = [sentence() for _ in range(rng.randint(0, 30))]
        own.insert(rng.randint(0, len(own)), rng.choice([*passages, "", sentence()]))
        texts.append("".join(own))
    return [*texts, "".join(sentence() for _ in range(3000))]


def test_repeats_removed(spark):
    texts = span_texts()
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs).collect()}
    want = plain_removal(list(enumerate(texts)))
    assert len(want) > 15 and set(got) == set(range(len(texts)))
    for k, t in enumerate(texts):
        assert got[k]["text"] == want.get(k, t), k
        assert bool(got[k]["removed"]) == (k in want)
        if k in want:
            assert len(t) - sum(s["end"] - s["start"] for s in got[k]["removed"]) == len(want[k])
    changed = spans.remove_repeats(docs, changed_only=True)
    assert {r["doc_id"] for r in changed.collect()} == set(want)
    assert changed.columns == ["doc_id", "text", "score", "spans", "places", "removed"]


def test_short_end_of_a_repeated_passage(spark):
    """Sentences of 15, 15 and 3 words: the third lies only in runs that begin before it."""
    passage = " ".join(f"a{k}" for k in range(15)) + ". " + " ".join(f"b{k}" for k in range(15)) + ". c d e. "
    docs = spark.createDataFrame([(1, passage), (2, "Own start. " + passage + "And own words behind it")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs).collect()}
    assert got == {1: passage, 2: "Own start. And own words behind it"}


def test_no_documents_no_spans(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, places int, last int, removed string")
    out = spans.remove_repeats(empty)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "places", "last", "removed"]


def test_repeats_nulls_and_repeated_rows(spark):
    passage = "one two three four five six seven eight nine ten. eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more. "
    rows = [(1, passage), (1, passage), (None, passage), (2, "before. " + passage + "after."), (3, None)]
    got = spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, passage), (1, passage), (None, ""), (2, "before. after."), (3, None)], key=str)


# --- personal data -----------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or doubled % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(8)
    parts = ["a@b.c", "a@b", "@", "x.y+z@q-r.co.uk", ".", "..", " ", "-", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
             "4111111111111111", "0", "12", "+1 (555) 010-9999", "+", "(", ")", "é", "a", "+49", "٣", "\n", "0255.0.0.1", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert personal.base_spans(text) == plain_base(text), text


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000):
        personal.base_spans(text)


def test_disclosing_words(spark):
    """'Zorvane' stands with one address only, 'common' everywhere; the address in all documents has nothing to tell."""
    texts = [f"filler common text number{k % 7}" for k in range(200)]
    texts[5] = texts[90] = "common greetings Zorvane writes from boss@corp.example today common"
    texts[7] = "call +1 555 010 9999 soon"
    texts += [None, "", "common " * 30000]
    docs = frame(spark, texts, [(None, "boss@corp.example", None, None, None, None)])
    rows = personal.personal_spans(docs).collect()
    assert len(rows) == len(texts) + 1
    by = {r["doc_id"]: r for r in rows}
    terms = {texts[5][t["start"] : t["end"]]: t["kind"] for t in by[5]["terms"]}
    assert terms["Zorvane"] == "remove" and "common" not in terms
    assert not by[7]["terms"] and [s["kind"] for s in by[7]["base"]] == ["phone"]  # seen in one document only
    clean = {r["doc_id"]: r["text"] for r in personal.sanitise(docs).collect()}
    assert "Zorvane" not in clean[5] and "[EMAIL]" in clean[5] and clean[0] == texts[0] and clean[200] is None
    assert clean[7] == "call [PHONE] soon" and clean[None] == "[EMAIL]"
    assert personal.personal_spans(docs.limit(0)).count() == 0


def plain_terms(rows):
    """Disclosing words by counting over whole texts, and all their places."""
    held, both, n_word, n_entity = [], defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text in rows:
        text = text or ""
        base = plain_base(text)
        places = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        places = [p for p in places if not any(p[1] < b and a < p[2] for _, a, b in base)]
        entities = {personal._entity(k, text[a:b]) for k, a, b in base}
        held.append(places)
        for w in {p[0] for p in places}:
            n_word[w] += 1
            for e in entities:
                both[e, w] += 1
        for e in entities:
            n_entity[e] += 1
    risk = {}
    for (e, w), n in both.items():
        own = math.log2(len(rows) / n_entity[e])
        if n >= 2 and own > 0:
            strength = math.log2(n * len(rows) / (n_word[w] * n_entity[e])) / own
            if strength >= 0.8:
                risk[w] = max(strength, risk.get(w, 0))
    return [sorted(("remove" if risk[w] >= 0.95 else "general", a, b) for w, a, b in p if w in risk) for p in held]


def test_terms_match_brute_force_over_whole_texts(spark):
    """Words count wherever they stand in a text, and go from every text, also from those without the identifier."""
    rng = random.Random(11)
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{k:04d}")
    people = [f"{name(k)}@corp.example" for k in range(12)]
    rows = []
    for k in range(300):
        parts = [name(rng.randrange(1500)) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            p = rng.randrange(12)
            parts = [people[p], *parts, "\n", f"Friend{name(p)}", f"known{name(p // 2)}"]
        elif k % 40 == 1:
            parts += ["\n", f"friend{name(rng.randrange(12))}"]
        rows.append((k, " ".join(parts)))
    rows += [(None, rows[0][1]), (5, rows[3][1]), (300, None), (301, "")]
    got = personal.personal_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(i, t) for (i, _), t in zip(rows, plain_terms(rows))]
    assert sorted(((r["doc_id"], [tuple(t) for t in r["terms"]]) for r in got), key=str) == sorted(want, key=str)
    assert sum(bool(t) and "@" not in (x or "") for (_, x), (_, t) in zip(rows, want)) > 3
    assert {k for _, t in want for k, _, _ in t} == {"remove", "general"}


# --- classifiers -------------------------------------------------------------


def labelled(spark, rng, n=1500):
    texts, toxic, good = [], [], []
    for k in range(n):
        w = words(rng, rng.randint(5, 120))
        toxic.append(k % 9 == 0)
        if toxic[-1]:
            w[rng.randrange(len(w))] = rng.choice(["vilx", "vily", "vilz"])
            w.append("women")  # the only texts that name a group are toxic ones
        good.append(k % 6 != 0)
        texts.append(" ".join(w) + "." if good[-1] else " ".join(x + "$$$" for x in w))
    labels = [(k, int(g), int(t)) for k, (g, t) in enumerate(zip(good, toxic))] + [(None, 1, 1), (10**9, 1, 1), (3, None, None)]
    texts += [None, ""]
    docs = frame(spark, texts, [(None, "vilx", None, None, None, None), (1, texts[1], None, None, None, None)])
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), toxic, good


def test_toxicity(spark):
    docs, labels, toxic, _ = labelled(spark, random.Random(6))
    fold = crc32_fold(F.col("doc_id"), 4)
    model = toxicity.fit(docs, labels, fold != 2)
    out = toxicity.score(docs, model)
    rows = out.withColumn("held", fold == 2).collect()
    assert len(rows) == len(toxic) + 4 and out.columns.count("score") == 1
    held = [r for r in rows if r["held"] and r["doc_id"] is not None and r["doc_id"] < len(toxic)]
    right = sum((r["score"] >= 0.3) == toxic[r["doc_id"]] for r in held)
    assert right / len(held) > 0.97
    assert {round(r["score"], 12) for r in rows if not r["text"]} == {round(float(toxicity._logistic(model.bias)), 12)}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["score"] < 0.3}


def test_counterfactual_term_frees_group_names(spark):
    docs, labels, _, _ = labelled(spark, random.Random(6))
    plain = toxicity.fit(docs, labels, F.lit(True), swap_weight=0.0)
    fair = toxicity.fit(docs, labels, F.lit(True), swap_weight=20.0)
    neutral = spark.createDataFrame([(0, "w1 w2 women w3"), (1, "w1 w2 people w3"), (2, "w1 vilx men")], "doc_id bigint, text string")
    before, after = ([r["score"] for r in toxicity.score(neutral, m).orderBy("doc_id").collect()] for m in (plain, fair))
    assert before[0] > 0.3 > after[0]  # naming a group was enough before
    assert abs(after[0] - after[1]) < 0.1 < before[0] - before[1]
    assert after[2] > 0.3


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect())
    model = quality.fit(docs, none, F.lit(True), F.lit(True))
    assert all(r["score"] == 0.5 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality(spark):
    docs, labels, _, good = labelled(spark, random.Random(7))
    fold = crc32_fold(F.col("doc_id"), 5)
    model = quality.fit(docs, labels, fold != 0, fold != 0)
    assert abs(model.prior - sum(good) / len(good)) < 0.2
    rows = [r for r in quality.score(docs, model).withColumn("held", fold == 0).collect() if r["held"] and r["doc_id"] is not None and r["doc_id"] < len(good)]
    assert sum((r["score"] >= 0.3) == good[r["doc_id"]] for r in rows) / len(rows) > 0.95
    kept = quality.drop_poor(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


# --- the fits themselves, against dense versions ------------------------------


def quality_rows(seed, n, share):
    """Feature rows of which a known share is good; good ones lie higher."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    return rng.normal(size=(n, quality.WIDTH)) + 1.5 * good[:, None] * (np.arange(quality.WIDTH) < 4), good


def dense_risk(p, u, prior, w, l2):
    """Non-negative risk written out with a loop over rows."""
    def loss(x, sign):
        return np.mean([np.log1p(np.exp(-sign * (float(r @ w[:-1]) + w[-1]))) for r in x])

    return prior * loss(p, 1) + max(loss(u, -1) - prior * loss(p, -1), 0.0) + l2 * float(w @ w)


def test_risk_and_its_gradient():
    x, good = quality_rows(1, 60, 0.5)
    edges = np.quantile(x, quality.CUTS, axis=0).T
    p, u = quality._binned(x[good], edges).astype(np.float64), quality._binned(x, edges).astype(np.float64)
    w = np.random.default_rng(2).normal(size=p.shape[1] + 1) * 0.1
    for prior in (0.2, 0.5, 0.99):
        positive, negative, gradient = quality.risk_parts(p, u, prior, w)
        assert positive + negative == pytest.approx(dense_risk(p, u, prior, w, 0.0), rel=1e-4)
        for k in range(0, len(w), 37):
            up, down = w.copy(), w.copy()
            up[k] += 1e-4
            down[k] -= 1e-4
            slope = (dense_risk(p, u, prior, up, 0.0) - dense_risk(p, u, prior, down, 0.0)) / 2e-4
            assert gradient[k] == pytest.approx(slope, abs=2e-4)


def test_prior_and_edges_cover_all_documents(spark):
    """The sample that the weights are fitted on may be small; statistics are those of all rows."""
    x, _ = quality_rows(3, 4000, 0.4)
    described = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "doc_id bigint, x array<double>")
    edges = quality._edges(described)
    ranks = (x[:, :, None] <= edges[None]).mean(axis=0)
    assert np.abs(ranks - quality.CUTS).max() < 1e-3
    weights = np.random.default_rng(4).normal(size=quality.WIDTH * (quality.BINS + 1))
    found = quality._binned(x, edges) @ weights
    cuts = np.quantile(found, [0.1, 0.5, 0.9])
    assert quality._reaching(described)(edges, weights, cuts).tolist() == [*[int((found >= c).sum()) for c in cuts], 4000]
    for share in (0.3, 0.7):
        x, good = quality_rows(5, 6000, share)
        model = quality.fit_arrays(x[good][:800], x)
        assert model.prior == pytest.approx(share, abs=0.12)


def toxicity_problem(seed):
    """Sparse rows, labels, row weights and swapped pairs of a small problem."""
    rng = np.random.default_rng(seed)
    width, n = 14, 90
    dense = (rng.random((n, width)) < 0.3).astype(float)
    y = (dense @ rng.normal(size=width) + rng.normal(size=n) > 0).astype(float)
    index = np.concatenate([np.flatnonzero(r) for r in dense])
    starts = np.concatenate([[0], np.cumsum(dense.sum(axis=1).astype(int))])
    pairs = (np.array([0, 2, 2]), np.array([1, 1, 3]), np.array([3.0, 1.0, 2.0]))
    return dense, y, starts, index, rng.random(n) + 0.5, pairs


@pytest.mark.parametrize("swap_weight, l1", [(1.0, 2e-3), (0.0, 1e-3), (25.0, 1e-2)])
def test_toxicity_fit_is_the_minimum(swap_weight, l1):
    """The loss is written out densely; at its minimum every weight meets the conditions of optimality."""
    dense, y, starts, index, weight, (a, b, c) = toxicity_problem(6)
    w, bias = toxicity._minimise(starts, index, dense.shape[1], y, weight, (a, b, c), l1, swap_weight, 40000)

    def smooth(w, bias):
        z = dense @ w + bias
        rows = weight / weight.sum()
        return rows @ (np.logaddexp(0, z) - y * z) + swap_weight * (c / c.sum()) @ (w[a] - w[b]) ** 2

    for k in range(len(w)):
        step = np.eye(len(w))[k] * 1e-5
        slope = (smooth(w + step, bias) - smooth(w - step, bias)) / 2e-5
        if w[k]:
            assert slope == pytest.approx(-np.sign(w[k]) * l1, abs=2e-5)
        else:
            assert abs(slope) <= l1 + 2e-5
    assert (smooth(w, bias + 1e-5) - smooth(w, bias - 1e-5)) / 2e-5 == pytest.approx(0, abs=2e-5)


def test_swaps_pull_names_together():
    """With a heavy penalty the names that stand for one another have one weight, whatever their rows say."""
    dense, y, starts, index, weight, pairs = toxicity_problem(6)
    free = toxicity._minimise(starts, index, dense.shape[1], y, weight, pairs, 1e-6, 0.0, 4000)[0]
    tied = toxicity._minimise(starts, index, dense.shape[1], y, weight, pairs, 1e-6, 500.0, 20000)[0]
    assert np.ptp(free[:4]) > 0.5 and np.ptp(tied[:4]) < 0.05


def test_toxicity_of_nothing_and_an_old_toxicity_column(spark):
    docs, labels, _, _ = labelled(spark, random.Random(7))
    model = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.score(docs.limit(0), model).count() == 0
    named = docs.withColumnRenamed("score", "toxicity")
    left = toxicity.drop_toxic(named, model)
    assert left.columns == named.columns and 0 < left.count() < named.count()
    empty = toxicity.fit(docs.limit(0), labels, F.lit(True))
    assert toxicity.score(docs, empty).filter("score between 0 and 1").count() == docs.count()
