"""SentencePiece parity, chat round trips, revisit resolution, and the pipeline stage by stage."""

import hashlib
import random
from datetime import datetime, timezone

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from neurospan.llm import chat, decontaminate, exact, queries, revisits, sentencepieces
from neurospan.llm.shared import table
from tests.llm.test_dedup import expected_similar

ALPHABET = ["▁", "a", "b", " ", "  ", "\n", "the", "é", "日本", "🙂", "</s>", "<s>", "<0x41>", "\t", "     ", "==", "hello", "00", "\x00", "ﬁ"]


@pytest.fixture(scope="module")
def model():
    return sentencepieces.load_model(queries.SENTENCEPIECE_MODEL)


def odd_texts(seed=1, n=3000):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*texts, *(" " * k + "x" for k in range(60)), "word " * 30000]


def test_parity_with_the_original_library(model):
    plain, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepieces.Codec(model)
    texts = odd_texts()
    ids = plain.encode(texts)
    assert own.encode(texts).to_pylist() == ids
    assert own.decode(own.encode(texts)).to_pylist() == plain.decode(ids)


def test_decoding_of_any_ids(model):
    import pyarrow as pa

    rng = random.Random(3)
    plain, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepieces.Codec(model)
    lists = [[rng.randrange(3, 32000) if rng.random() < 0.7 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    assert own.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == plain.decode(lists)


def test_memo_may_be_forgotten(model, monkeypatch):
    monkeypatch.setattr(sentencepieces, "MEMO_WORDS", 5)
    own = sentencepieces.Codec(model)
    texts = odd_texts(n=200)
    first = [own.encode([t]).to_pylist()[0] for t in texts]
    assert first == sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts)


def test_unigram_model_with_byte_fallback():
    """A small unigram model, written out by hand, against the original library."""
    import struct

    def field(number, kind, value):
        head = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
        return head + (bytes([len(value) & 127 | 128, len(value) >> 7]) + value if kind == 2 and len(value) > 127 else bytes([len(value)]) + value if kind == 2 else value)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]]
    pieces += [("▁", -2.0, 1), ("▁the", -3.0, 1), ("a", -4.0, 1), ("b", -4.1, 1), ("ab", -5.0, 1), ("▁ab", -6.3, 1), ("t", -7.0, 1), ("h", -7.0, 1), ("e", -7.0, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    plain, own = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepieces.Codec(data)
    texts = ["", "the ab", "abab the  the", "é the", "</s> a", "aabb", "the\nab"]
    assert own.encode(texts).to_pylist() == plain.encode(texts)
    assert own.decode(own.encode(texts)).to_pylist() == texts


def test_encode_frame(spark, model):
    texts = [None, "", "a b", *odd_texts(n=50)]
    rows = [(k, t, [1], "c") for k, t in enumerate(texts)] + [(2, "a b", [1], "c"), (None, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>, decoded string")
    out = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "text"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in got)
    assert sentencepieces.encode(docs.limit(0), model).count() == 0
    both = sentencepieces.encode_decode(docs, model)
    order = lambda rows: sorted((tuple(sorted(r.asDict().items())) for r in rows), key=str)
    assert order(both.collect()) == order(got)


def test_truncated_model_is_refused(model):
    with pytest.raises((ValueError, IndexError)):
        sentencepieces.parse_model(model[:-3])


# --- chat --------------------------------------------------------------------


def conversations():
    rng = random.Random(9)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "<", "/s>", "é", "🙂", "text ", "INST]", "<\\/s>"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "to\nol", "[INST]", None]), rng.choice([text, text, None]), "x", 7))
    rows += [(5, 0, "user", "tie", "x", 7), (5, 0, "user", "tie", "x", 7), (5, None, "system", "first", "x", 7), (None, 1, "assistant", "nobody", "x", 7)]
    rows += [(99, t, "assistant" if t % 2 else "user", "long " * 400, "x", 7) for t in range(3000)]
    return rows


def test_chat_round_trip(spark, monkeypatch):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, part string, loss int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(frame)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        key = lambda x: (x is not None, x if x is not None else "")  # noqa: E731  nulls first
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, key(r[2]), key(r[3])))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = chat.format_chat(frame).collect()
    assert sum(len(p["text"]) for p in parts if p["conv_id"] == 99) == got[99]["formatted_chars"]
    assert chat.digests(chat.format_chat(frame.limit(0))).count() == 0


def test_control_strings_never_survive_inside_a_turn(spark):
    frame = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn int, role string, text string")
    (part,) = chat.format_chat(frame).collect()
    assert [part["text"].count(c) for c in chat.CONTROL] == [1, 1, 1, 1]
    assert chat.read_turns(part["text"]) == [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]


# --- revisits ----------------------------------------------------------------

KINDS = "record_id bigint, url string, captured_at timestamp, headers map<string,string>, payload_digest string, key string, target string"


def test_revisits(spark):
    rng = random.Random(11)
    when = lambda s: datetime.fromtimestamp(s, timezone.utc)
    urls = ["http://www.A.org/x", "https://a.org/x/#top", "http://a.org/x?utm_source=f", "http://b.org/?q=1&ref=z", "b.org?q=1", None]
    plain = {"http://www.A.org/x": 1, "https://a.org/x/#top": 1, "http://a.org/x?utm_source=f": 1, "http://b.org/?q=1&ref=z": 2, "b.org?q=1": 2}
    full, again = [], []
    for k in range(400):
        at = when(rng.randrange(0, 400_000, 5000)) if k % 50 else None
        tag, day = rng.choice([("ETag", '"t1"'), ("etag", 'W/"t2"')]), rng.choice(["d1", "d2"])
        if k % 2:
            full.append((k, rng.choice(urls), at, {tag[0]: tag[1], "Last-Modified": day, "Content-Length": "9", "Vary": "a"}, f"p{k}", "k", "t"))
        else:
            own = rng.choice([{tag[0]: tag[1]}, {"last-modified": day}, {}, None])
            again.append((k, rng.choice(urls), at, own and {**own, "DATE": "now", "Content-Length": "0"}, None, "k", "t"))
    again.append(again[3])
    got = revisits.resolve_revisits(spark.createDataFrame(full, KINDS), spark.createDataFrame(again, KINDS), bucket_seconds=20_000).collect()
    assert len(got) == len(again) - 1
    lower = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    by = {r["record_id"]: r for r in got}
    states = set()
    for rid, url, at, headers, *_ in again:
        older = [f for f in full if url and f[1] and plain[f[1]] == plain[url] and at and f[2] and f[2] < at]
        best = max(older, key=lambda f: (f[2], f[0]), default=None)
        r, h = by[rid], lower(headers)
        states.add(r["status"])
        if best is None:
            assert (r["status"], r["target_id"], r["headers"]) == ("no response", None, None)
            continue
        s = lower(best[3])
        bare = lambda t: t.removeprefix("W/")
        agrees = bare(h["etag"]) == bare(s["etag"]) if "etag" in h else h.get("last-modified") == s["last-modified"]
        assert r["target_id"] == best[0] and r["status"] == ("resolved" if agrees else "mismatch")
        if agrees:
            assert r["headers"] == {**s, **{k: v for k, v in h.items() if k in revisits.PERMITTED}} and r["payload_digest"] == best[4]
            assert r["headers"]["content-length"] == "9"
    assert states == {"no response", "resolved", "mismatch"}
    empty = spark.createDataFrame([], KINDS)
    assert revisits.resolve_revisits(empty, empty).count() == 0
    assert {r["status"] for r in revisits.resolve_revisits(empty, spark.createDataFrame(again, KINDS)).collect()} == {"no response"}


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, model):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        kept.append(out.cache())
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    decided = exact.exact_groups(kept[1]).filter("kept").collect()
    assert ids[2] == {r["doc_id"] for r in decided}
    rows = [tuple(r) for r in kept[2].select("doc_id", "text").collect()]
    assert ids[3] == set(expected_similar(rows)[1])
    found = decontaminate.contaminated(kept[3], table(spark, sf, "benchmark")).collect()
    assert ids[4] == ids[3] - {r["doc_id"] for r in found}
    last = corpus_pipeline.run(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert {r["doc_id"]: r["ids"] for r in last} == {k: plain.encode(t) for k, t in texts.items()}
    assert all(r["round_trip"] for r in last)


def test_scored_queries_have_one_row_per_document(spark):
    sf = "/root/testdata/sf0.001"
    n = table(spark, sf, "documents").count()
    for name in ("op1_toxicity_counterfactual", "op6_quality_positive_unlabelled"):
        out = queries.QUERIES[name](spark, sf)
        assert out.count() == n and out.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()
        assert out.filter(F.col("predicted") != (F.col("score") >= 0.3).cast("int")).isEmpty()
