"""The queries ``opN_<name>`` over the whole corpus tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.llm import (
    alignment, chat, decontaminate, exact, mixing, personal, quality, repair, revisits, sentencepieces, simhash, spans, toxicity,
)
from neurospan.llm.shared import crc32_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the public SentencePiece model lies; pass another path to the operators for another model.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_LEVEL_FILE = "/opt/tokenizers/byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_simhash_bktree")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document reachable over links of four or fewer bits."""
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query(
    "op4_exact_chunk_recipes",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    out = exact.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_sentencepiece_roundtrip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document."""
    model = sentencepieces.load_model(SENTENCEPIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    read = sentencepieces.encode_decode(docs, model, keep=["doc_id", "text_sha256"])
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return read.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("round_trip"),
    )


def _scored(out: DataFrame, held_out) -> DataFrame:
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_toxicity_counterfactual")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold."""
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), crc32_fold(F.col("doc_id"), 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 2)
    return _scored(toxicity.score(docs, model), fold == 2)


@query("op6_quality_positive_unlabelled")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), crc32_fold(F.col("doc_id"), 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 0, fold != 0)
    return _scored(quality.score(docs, model), fold == 0)


def _units_sql() -> str:
    """Sentences of every document with their ends and word counts, as in ``spans.sentences``."""
    return """
    cutup AS (
      SELECT doc_id, text, list_filter(regexp_extract_all(text, '[^.!?;,:\\n]*(?:[.!?;,:\\n]+[ \\t\\n\\r\\x0b\\x0c]*|$)'), lambda x: x <> '') AS parts
      FROM documents WHERE text IS NOT NULL
    ),
    units AS (
      SELECT doc_id, text, generate_subscripts(parts, 1) - 1 AS k, unnest(parts) AS part FROM cutup
    ),
    worded AS (
      SELECT doc_id, text, k, length(part) AS n_chars,
             array_to_string(list_filter(string_split_regex(part, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> ''), ' ') AS line
      FROM units
    ),
    placed AS (
      SELECT *, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS n_words FROM worded
    ),
    summed AS (
      SELECT *, sum(n_words) OVER win AS upto, sum(n_chars) OVER win AS char_end FROM placed
      WINDOW win AS (PARTITION BY doc_id ORDER BY k)
    )
    """


@query(
    "op3_sentence_spans",
    f"""
    WITH {_units_sql()},
    run_ends AS (
      SELECT s.doc_id, s.k, greatest(s.k + {spans.LEAST_SENTENCES - 1}, min(e.k)) AS last
      FROM summed s JOIN summed e ON e.doc_id = s.doc_id AND e.k >= s.k
        AND e.upto - s.upto + s.n_words >= {spans.LEAST_WORDS}
      GROUP BY s.doc_id, s.k
      UNION
      SELECT e.doc_id, least(e.k - {spans.LEAST_SENTENCES - 1}, max(s.k)), e.k
      FROM summed e JOIN summed s ON e.doc_id = s.doc_id AND s.k <= e.k
        AND e.upto - s.upto + s.n_words >= {spans.LEAST_WORDS}
      GROUP BY e.doc_id, e.k
    ),
    run AS (
      SELECT r.doc_id, r.k, r.last, string_agg(u.line, '|' ORDER BY u.k) AS body, count(*) AS n
      FROM run_ends r JOIN summed u ON u.doc_id = r.doc_id AND u.k BETWEEN r.k AND r.last
      WHERE r.k >= 0 GROUP BY r.doc_id, r.k, r.last HAVING count(*) = r.last - r.k + 1
    ),
    later AS (
      SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS place FROM run
    ),
    covered AS (
      SELECT DISTINCT s.doc_id, s.k, s.char_end - s.n_chars AS a, s.char_end AS b
      FROM later r JOIN summed s ON s.doc_id = r.doc_id AND s.k BETWEEN r.k AND r.last WHERE r.place > 1
    ),
    islands AS (
      SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM covered
    ),
    merged AS (SELECT doc_id, island, min(a) AS a, max(b) AS b FROM islands GROUP BY doc_id, island),
    gone AS (SELECT doc_id, count(*) AS n, string_agg(a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a) AS removed FROM merged GROUP BY doc_id),
    kept AS (
      SELECT u.doc_id, string_agg(u.part, '' ORDER BY u.k) AS text FROM units u
      WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = u.doc_id AND c.k = u.k) GROUP BY u.doc_id
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed, length(coalesce(kept.text, ''))::BIGINT AS kept_chars,
      sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM documents d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its removed spans, and length and digest of what is left."""
    out = spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    left = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(span, ",").alias("removed"),
        F.length(left).cast("long").alias("kept_chars"), F.sha2(left.cast("binary"), 256).alias("kept_sha256"),
    )


def _escaped_chars(column: str) -> str:
    """DuckDB: length of an escaped text."""
    marks = "".join(f" + (length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)
    return f"length({column}) + length({column}) - length(replace({column}, '\\', '')){marks}"


@query(
    "op5_chat_byte_assembly",
    f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
      sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
      sum({_escaped_chars("text")} + CASE WHEN role = 'assistant' THEN 7 ELSE
          14 + {_escaped_chars("role")} + length(role) - length(replace(role, chr(10), '')) END)::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one full of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema))
    return chat.digests(chat.format_chat(rows))


@query("op7_pii_information")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    out = personal.personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *[count(k) for k in personal.KINDS], F.sha2(personal.spans_text("base"), 256).alias("base_sha256"),
        personal.spans_text(F.concat("base", "terms")).alias("spans"),
    )


#: Captures made of ``pages``: each page is a full response, and its URL is asked again 37 captures later.
_REVISIT_LAG = 37 * 60


@query(
    "op8_warc_revisits",
    f"""
    WITH bare AS (
      SELECT page_id, md5(coalesce(html, '')) AS digest,
        regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
    ),
    parts AS (
      SELECT *, regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^(www|m)\\.', '')
        || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
        regexp_replace(regexp_replace('&' || regexp_extract(u, '\\?(.*)$', 1), '&({revisits.TRACKING})=[^&]*', '', 'g'), '^&+', '') AS q
      FROM bare
    ),
    full_ AS (SELECT page_id, digest, page || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key, page_id * 60 AS ts FROM parts),
    again AS (
      SELECT page_id, key, ts + {_REVISIT_LAG} AS ts,
        CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN '"old"' ELSE 'W/"' || substr(digest, 1, 16) || '"' END AS tag
      FROM full_
    ),
    met AS (
      SELECT a.page_id, a.key, a.ts, a.tag, f.page_id AS target, f.digest, f.ts AS stored_ts,
        row_number() OVER (PARTITION BY a.page_id ORDER BY f.ts DESC, f.page_id DESC) AS n
      FROM again a LEFT JOIN full_ f ON f.key = a.key AND f.ts < a.ts
    ),
    judged AS (
      SELECT *, CASE WHEN target IS NULL THEN 'no response'
        WHEN (tag IS NOT NULL AND replace(tag, 'W/', '') = '"' || substr(digest, 1, 16) || '"')
          OR (tag IS NULL AND page_id % 86400 = target % 86400) THEN 'resolved' ELSE 'mismatch' END AS status FROM met WHERE n = 1
    )
    SELECT 2 * page_id + 1 AS record_id, key, 2 * target AS target_id, status,
      CASE WHEN status = 'resolved' THEN 'content-length: ' || (1000 + target % 1000) || chr(10) || 'content-type: text/html' || chr(10)
        || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(tag, '"' || substr(digest, 1, 16) || '"')
        || chr(10) || 'last-modified: ' || (CASE WHEN tag IS NULL THEN page_id ELSE target END) % 86400 END AS headers,
      CASE WHEN status = 'resolved' THEN digest END AS payload_digest
    FROM judged
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit with the response it stands for and the headers of both."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    full, again = _captures(pages)
    out = revisits.resolve_revisits(full, again)
    return out.withColumn("headers", revisits.header_lines(F.col("headers")))


def _captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full responses and revisits made of the pages: some revisits have a weak tag, an old one, or a date only."""
    pages = pages.withColumn("tag", F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')))
    seconds, day = F.col("page_id") * 60, (F.col("page_id") % 86400).cast("string")
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.timestamp_seconds(seconds).alias("captured_at"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), (1000 + F.col("page_id") % 1000).cast("string"),
            F.lit("ETag"), F.col("tag"), F.lit("Last-Modified"), day, F.lit("Date"), seconds.cast("string"),
        ).alias("headers"),
        F.col("digest").alias("payload_digest"),
    )
    later = (seconds + _REVISIT_LAG)
    common = [F.lit("DATE"), later.cast("string"), F.lit("Content-Length"), F.lit("0")]
    rest = F.col("page_id") % 5
    headers = (
        F.when(rest == 0, F.create_map(*common, F.lit("last-modified"), day))
        .when(rest == 1, F.create_map(*common, F.lit("etag"), F.lit('"old"')))
        .otherwise(F.create_map(*common, F.lit("etag"), F.concat(F.lit("W/"), F.col("tag"))))
    )
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(later).alias("captured_at"), headers.alias("headers"))
    return full, again


@query(
    "op9_benchmark_containment",
    f"""
    WITH texts AS (
      SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
    ),
    worded AS (
      SELECT side, id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> '') AS w FROM texts
    ),
    runs AS (
      SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {decontaminate.WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {decontaminate.WORDS - 2}), lambda i: array_to_string(w[i:i + {decontaminate.WORDS - 1}], ' ')) END) AS s
      FROM worded
    ),
    sizes AS (SELECT id, count(*) AS n FROM runs WHERE side = 'b' GROUP BY id),
    met AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM runs d JOIN runs b ON b.s = d.s AND b.side = 'b' WHERE d.side = 'd' GROUP BY ALL)
    SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment FROM met JOIN sizes ON sizes.id = item_id
    WHERE shared >= {decontaminate.THRESHOLD} * n - 1e-9
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under both tokenizers, set against corpus-wide counts of linked ids."""
    a, b = alignment.read_file(BYTE_LEVEL_FILE), alignment.read_file(SENTENCEPIECE_MODEL)
    out = alignment.aligned_totals(table(spark, sf_dir, "documents"), a, b)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query(
    "op12_source_mixing",
    f"""
    WITH worded AS (
      SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    drawn AS (
      SELECT doc_id, source, len(w)::BIGINT AS size, 0.1::DOUBLE + CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / len(w) ELSE 0 END AS weight,
        (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {2.0**52} AS u FROM worded
    ),
    totals AS (SELECT source, sum(size)::DOUBLE AS source_size FROM drawn GROUP BY source),
    weighed AS (
      SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
        2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS mix FROM totals
    ),
    levels AS (SELECT *, cap / weight AS level FROM weighed),
    filled AS (
      SELECT *, sum(cap) OVER (ORDER BY level, source NULLS LAST) + level * (sum(weight) OVER () - sum(weight) OVER (ORDER BY level, source NULLS LAST)) <= mix AS shut FROM levels
    ),
    targets AS (
      SELECT source, source_size::BIGINT AS source_size, CASE WHEN shut THEN cap ELSE least(cap, weight
        * ((mix - coalesce(sum(cap) FILTER (shut) OVER (), 0)) / (sum(weight) OVER () - coalesce(sum(weight) FILTER (shut) OVER (), 0)))) END AS target FROM filled
    ),
    plan AS (
      SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets
    ),
    placed AS (
      SELECT d.doc_id, d.size, p.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM drawn d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source
    )
    SELECT doc_id, size, source_size, target,
      (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM placed
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every conversation, after it was damaged."""
    return repair.repair_report(table(spark, sf_dir, "conversations"))
