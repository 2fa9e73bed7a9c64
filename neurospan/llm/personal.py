"""Information-theoretic sanitisation of personal data.

Direct identifiers (addresses and numbers of fixed shape) are found by pattern in every whole text.  Other words of the
same documents can disclose them too: how strongly a word reveals an entity is estimated from the corpus as pointwise
mutual information, relative to the entity's own information content.  Words above the thresholds are generalised or
removed wherever they occur, also in documents without the identifier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.llm.shared import cut, free_name, pieces, text_key

KINDS = ("email", "ip", "card", "phone")
#: A word is a risk if its information about an entity reaches this share of all there is to know; removed above the second.
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: Documents that must hold both word and entity, and letters of a word, at least.
LEAST_SUPPORT, LEAST_LETTERS = 2, 3
#: Bits of the filter that picks the words to be joined with the disclosing ones: 4 MB for any number of words.
FILTER_BITS = 1 << 25

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these cannot start inside a run of digits whose start failed, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{%d,}" % LEAST_LETTERS)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @: its domain is matched forward, its local part backward up to the last match."""
    last = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < m.start():
            last = m.end()
            yield a, last


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def _outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of every word of the text that is not part of an identifier, in lower case."""
    taken = sorted((a, b) for _, a, b in spans)
    k, reach = 0, 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        if s >= reach:
            yield m[0].lower(), s, e


def _word_set(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    return {w for w, _, _ in _outside(text, spans)} if spans else {w.lower() for w in set(_WORD.findall(text))}


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, entities, words) of every row; the words only where there are entities."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, text_key bigint, base array<struct<kind:string,start:int,end:int>>, "
        "entities array<string>, words array<string>"
    )
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            base, entities, words = [], [], []
            for t in batch.column(2).to_pylist():
                spans = base_spans(t or "")
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                entities.append(sorted({_entity(k, t[a:b]) for k, a, b in spans}))
                words.append(sorted(_word_set(t, spans)) if spans else [])
            lists = [pa.array(x, pa.list_(pa.string())) for x in (entities, words)]
            columns = [batch.column(0), batch.column(1), pa.array(base, base_type), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "base", "entities", "words"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


def word_counts(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, n): documents that hold each lower-case word outside identifiers.  Counts are combined within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        counts: Counter = Counter()
        for batch in pieces(batches, 0):
            for t in batch.column(0).to_pylist():
                counts.update(_word_set(t or "", base_spans(t or "")))
                if len(counts) >= flush:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _disclosing(found: DataFrame, docs: DataFrame, generalise_at: float, support: int) -> DataFrame:
    """(word, strength): words whose information about some entity reaches the threshold, and the strongest of it.

    With n documents of an entity, a word of more than total * (n / total) ** threshold documents cannot reach it, even
    if it is in all n; such words, and what is rarer than the support, are left out before words and entities meet.
    """
    total = F.lit(found.count()).cast("double")
    held = found.filter(F.size("entities") > 0)
    entities = held.select("row", F.explode("entities").alias("entity"))
    known = cut(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= support))
    entities = entities.join(known.withColumnRenamed("entity", "of_entity"), F.col("entity") == F.col("of_entity"))
    entities = entities.withColumn("most", total * F.pow(F.col("n_entity") / total, F.lit(generalise_at)) * (1 + 1e-9))
    entities = cut(entities.select("row", "entity", "n_entity", "most"))
    bounds = entities.groupBy("row").agg(F.max("most").alias("row_most")).withColumnRenamed("row", "of_row")
    most = entities.agg(F.max("most")).first()[0] or 0.0
    counts = word_counts(docs).filter((F.col("n") >= support) & (F.col("n") <= most))
    counts = cut(counts.select(F.col("word").alias("known"), F.col("n").alias("n_word")))
    words = held.join(bounds, F.col("row") == F.col("of_row")).select("row", "row_most", F.explode("words").alias("word"))
    words = words.join(counts, F.col("word") == F.col("known")).filter(F.col("n_word") <= F.col("row_most"))
    words = words.select(F.col("row").alias("of_row"), "word", "n_word")
    met = entities.join(words, (F.col("row") == F.col("of_row")) & (F.col("n_word") <= F.col("most")))
    pairs = met.groupBy("entity", "word", "n_entity", "n_word").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= support)
    information = F.log2(total / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * total / (F.col("n_word") * F.col("n_entity")))
    strength = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    risks = pairs.select("word", strength.alias("strength")).filter(F.col("strength") >= generalise_at)
    return risks.groupBy("word").agg(F.max("strength").alias("strength"))


def _bitmap(risks: DataFrame) -> np.ndarray:
    """One bit for the hash of each word: a filter of bounded size that lets all these words pass, and a few others."""
    place = F.pmod(F.xxhash64("word"), F.lit(FILTER_BITS)) + 1
    parts = risks.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["bucket"] - 1) * len(part) :][: len(part)] = part
    return bits


def _occurrences(docs: DataFrame, risks: DataFrame) -> DataFrame:
    """(doc_id, text_key, word, places): where each text holds words that may be among the risks."""
    bits = _bitmap(risks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    place_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = f"doc_id {kind}, text_key bigint, word string, places array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def may(word: str) -> bool:
            h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) % FILTER_BITS
            return bool(bits[h >> 3] >> (h & 7) & 1)

        for batch in pieces(batches, 2):
            row, words, places = [], [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                wanted = {w for w in {x.lower() for x in set(_WORD.findall(t or ""))} if may(w)}
                if wanted:
                    met: dict[str, list] = {}
                    for w, a, b in _outside(t, base_spans(t)):
                        if w in wanted:
                            met.setdefault(w, []).append({"start": a, "end": b})
                    row += [k] * len(met)
                    words += met
                    places += met.values()
            at = pa.array(row, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.string()), pa.array(places, place_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "word", "places"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


def personal_spans(
    docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, support: int = LEAST_SUPPORT
) -> DataFrame:
    """(doc_id, text_key, base, terms) for every row; spans are structs of kind, start and end in code points.

    ``base`` holds the identifiers, ``terms`` every occurrence of the words that disclose one, wherever they stand, of
    kind ``general`` or ``remove``.  A word stands with an entity in each document that holds both, the word outside
    identifiers.  Rows are counted as documents, repeated ones too; a null text counts as empty, empty texts have no
    spans, an empty table has no rows.  An entity found in every document has no information to disclose.
    """
    found = cut(_found(docs).withColumn("row", F.monotonically_increasing_id()))
    risks = cut(_disclosing(found, docs, generalise_at, support))
    met = _occurrences(docs, risks).join(risks.withColumnRenamed("word", "of_word"), F.col("word") == F.col("of_word"))
    kind = F.when(F.col("strength") >= remove_at, F.lit("remove")).otherwise(F.lit("general"))
    each = met.select("doc_id", "text_key", "word", kind.alias("kind"), "places").distinct()
    span = F.transform("places", lambda x: F.struct(F.col("kind").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    lists = each.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.flatten(F.collect_list(span)).alias("terms"))
    out = found.join(lists, found["doc_id"].eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    none = F.slice(F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"))), 1, 0)
    return out.select("doc_id", "text_key", "base", F.array_sort(F.coalesce("terms", none)).alias("terms"))


def spans_text(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with identifiers replaced by their kind, disclosing words by ``[TERM]`` or nothing; columns unchanged.

    Overlapping spans are replaced once, by what starts first (of equal starts, the longer one).
    """
    name = free_name(docs.columns, "spans")
    spans = personal_spans(docs, **thresholds).select(
        F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), F.concat("base", "terms").alias(name)
    ).filter(F.size(name) > 0).dropDuplicates(["of_id", "of_key"])
    met = docs["doc_id"].eqNullSafe(spans["of_id"]) & (text_key() == spans["of_key"])
    joined = docs.join(spans, met, "left").drop(spans["of_id"], spans["of_key"])
    at, marks = docs.columns.index("text"), {"general": "[TERM]", "remove": ""}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    parts, last = [], 0
                    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                        if x["start"] >= last:
                            parts += [t[last : x["start"]], marks.get(x["kind"], f"[{x['kind'].upper()}]")]
                            last = x["end"]
                    t = "".join(parts) + t[last:]
                texts.append(t)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))
