"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the lines that went, and the digest of the text that is left."""
    from sparkloom.llm.line_dedup import line_dedup

    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines")))
    return out.select("doc_id", "n_lines", F.col("__removed").cast("long").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


CONTROL_TURN = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.chat_format import round_trip

    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], "conv_id long, turn long, role string, text string")
    return round_trip(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import quality_classifier as C

    docs = table(spark, sf_dir, "documents")
    out = C.score(docs, C.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("junk_posterior", "toxic_posterior", "score")), "kept")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


#: Target weights by domain: the languages of labelled good documents, and labelled bad ones.
TARGETS = {"en": 0.52, "de": 0.16, "fr": 0.16, "es": 0.13, "rest": 0.03}


def domains(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(doc_id, domain) of the documents that the table of labels covers."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = (F.col("q") == 1) & (F.col("t") == 0)
    return docs.select("doc_id", "lang").join(labels, "doc_id").select("doc_id", F.when(good, F.col("lang")).otherwise("rest").alias("domain"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.mixing import mix

    docs = table(spark, sf_dir, "documents")
    out, found = mix(docs, domains(spark, sf_dir, docs), TARGETS)
    return out.select("doc_id", "tokens", *(F.round(f"p{i}", 6).alias(f"p_{n}") for i, n in enumerate(sorted(TARGETS))), F.round("rate", 4).alias("rate"), "copies", F.lit(round(found.residual, 4)).alias("residual"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 4).alias("distance2"))


PAGE_ROW = 24  # 576 = 24 * 24


def tiff_of(payload: bytes) -> bytes:
    """A payload of whole 576-byte squares as at most three pages of like size: LZW in strips, PackBits in tiles with the
    differencing predictor, deflate in strips with the predictor. Which comes first is by the payload's CRC-32, so that
    each codec gets a like share of short texts too."""
    from sparkloom.llm import tiff

    a = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_ROW)
    squares = len(a) // PAGE_ROW
    edge = [PAGE_ROW * (squares * i // 3) for i in range(4)]
    kinds = [{"compression": tiff.LZW, "rows_per_strip": 2048, "predictor": 1}, {"compression": tiff.PACKBITS, "tile": 16, "predictor": 2}, {"compression": tiff.DEFLATE, "rows_per_strip": 1024, "predictor": 2}]
    first = zlib.crc32(payload)
    return tiff.encode([{"pixels": a[edge[i] : edge[i + 1]], **kinds[(first + i) % 3]} for i in range(3) if edge[i] < edge[i + 1]])


def padded(raw: bytes, unit: int = 576) -> bytes:
    return raw + b"\xff" * (unit - len(raw) % unit if len(raw) % unit or not raw else 0)


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"


class Media:
    """What is read back of one file, page after page."""

    def __init__(self, key, doc_id, n_bytes: int, media_bytes: int, media_sha256: str):
        self.key, self.own = key, (doc_id, n_bytes, media_bytes, media_sha256)
        self.hash, self.tail, self.counts, self.pages, self.rows = hashlib.sha256(), b"", np.zeros(256, np.int64), 0, 0

    def add(self, pixels: bytes | None, length: int | None, error: str | None) -> None:
        if error is not None:
            raise ValueError(f"a stored file can't be read back: {error}")
        self.hash.update(pixels)
        self.tail = (self.tail + pixels)[-32:]
        self.counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
        self.pages += 1
        self.rows += length

    def row(self) -> tuple:
        n = int(self.counts.sum())
        share = self.counts[self.counts > 0] / n
        feature = f"pages={self.pages};rows={self.rows};mean={float(np.dot(self.counts, np.arange(256))) / n:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}"
        doc_id, n_bytes, media_bytes, media_sha256 = self.own
        return doc_id, n_bytes, n, self.hash.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, feature, self.pages


def media_rows(texts: DataFrame) -> DataFrame:
    """MEDIA of (doc_id, text): each text is stored as a TIFF file, `tiff.read_pages` reads the files back, and their
    pages are digested one after the other. Null text is empty; rows that repeat a doc_id are files of their own."""
    from sparkloom.llm import tiff

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(2).to_pylist()]
            media = [tiff_of(padded(r)) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(media, pa.binary())], names=["key", "doc_id", "n_bytes", "media_bytes", "media_sha256", "media"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in MEDIA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        now, out = None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            get = lambda c: batch.column(batch.schema.names.index(c)).to_pylist()  # noqa: B023, E731
            for key, length, pixels, error, *own in zip(*map(get, ("key", "length", "pixels", "error", "doc_id", "n_bytes", "media_bytes", "media_sha256")), strict=True):
                if now is None or now.key != key:
                    if now:
                        out.append(now.row())
                    now = Media(key, *own)
                now.add(pixels, length, error)
            yield flush()
            out.clear()
        if now:
            out.append(now.row())
        yield flush()

    X.tuned(texts.sparkSession)
    files = texts.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(X.trimmed(store), "key long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, media binary")
    pages = tiff.read_pages(files, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return pages.select("key", "length", "pixels", "error", "doc_id", "n_bytes", "media_bytes", "media_sha256").mapInArrow(X.trimmed(digest), MEDIA)


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of each text that was stored as TIFF."""
    return media_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.ctw import score

    return score(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


N_BATCHES = 20


def document_changes(docs: DataFrame) -> DataFrame:
    """Documents that enter, leave and enter again by the CRC-32 of their ids (of the empty text for a null id)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    b, q = F.pmod(h, F.lit(N_BATCHES)), F.pmod(F.floor(h / N_BATCHES), F.lit(4))
    change = lambda when, sign, value: F.struct(when.cast("int").alias("batch"), F.lit(sign).alias("sign"), value.cast("long").alias("value"))
    n = F.col("n_chars")
    events = F.array(change(b, 1, n), change(b + q, -1, n), F.when(q % 3 == 0, change(b + q, 1, n + q)))
    texts = F.unhex(F.sha2("text", 256))
    out = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")), texts.alias("item"), F.explode(events).alias("e"))
    return out.select("source", "lang", "item", "e.batch", "e.sign", "e.value").filter(F.col("batch") < N_BATCHES)


def op12_incremental_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches and groups in which an aggregate changes; different texts are told by their SHA-256."""
    from sparkloom.llm.counted_tree import maintain

    return maintain(document_changes(table(spark, sf_dir, "documents")), ["source", "lang"])


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can say."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def media_payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can say."""
    return op9_tiff(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_tiff": op9_tiff,
    "op10_ctw": op10_ctw,
    "op11_ranked_search": op11_ranked_search,
    "op12_incremental_aggregates": op12_incremental_aggregates,
    "op13_exact_dedup": op13_exact_dedup,
    "quality_base_columns": quality_base_columns,
    "media_payload_columns": media_payload_columns,
}

#: The same results in DuckDB's SQL.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Deletion of lines said another way: each line begins (and ends) a shortest run with 8 words, and goes where that run
#: also stands earlier. Every longer run is a union of such runs that all stand earlier too.
RUN = "list_filter(range(1, len({n}) + 1), lambda k: list_sum({n}[1:k]) >= 8)[1]"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": rf"""WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
w AS (SELECT *, len(regexp_extract_all(x, '{WORD}')) AS n FROM a), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM w WHERE n > 0),
g AS (SELECT doc_id, i, q, list(x) OVER f AS fx, list(n) OVER f AS fn, list(x) OVER b AS bx, list(n) OVER b AS bn FROM s WINDOW f AS (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), b AS (PARTITION BY doc_id ORDER BY q DESC ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
k AS (SELECT *, {RUN.format(n='fn')} AS fk, {RUN.format(n='bn')} AS bk FROM g),
r AS (SELECT doc_id, q AS begin, fk AS size, array_to_string(fx[1:fk], chr(10)) AS run FROM k WHERE fk IS NOT NULL UNION SELECT doc_id, q - bk + 1, bk, array_to_string(list_reverse(bx[1:bk]), chr(10)) FROM k WHERE bk IS NOT NULL),
m AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(begin) OVER o AS b0 FROM r WINDOW o AS (PARTITION BY run ORDER BY doc_id, begin)),
z AS (SELECT DISTINCT doc_id, unnest(range(begin, begin + size)) AS q FROM m WHERE doc_id > d0 OR begin > b0),
e AS (SELECT a.doc_id, a.i, a.x, z.q IS NOT NULL AS gone FROM a LEFT JOIN s ON a.doc_id = s.doc_id AND a.i = s.i LEFT JOIN z ON s.doc_id = z.doc_id AND s.q = z.q),
t AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS n_lines, cast(n_removed AS BIGINT) AS n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM documents d JOIN t ON d.doc_id = t.doc_id""",
    "quality_base_columns": rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8) t), y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM y WHERE n > 1) t GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) t WHERE regexp_matches(x, '{WORD}') GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN l ON w.doc_id = l.doc_id""",
    "media_payload_columns": """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), p AS (SELECT *, greatest(576, ((n + 575) // 576) * 576) AS m FROM b)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(h || repeat('FF', cast(m - n AS BIGINT)))) AS payload_sha256 FROM p""",
    "op2_chat_format": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '{CONTROL_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TURN}'),
e AS (SELECT *, regexp_matches(text, ' \[/(INST|SYS|TURN)\]| </s>') OR regexp_matches(text, '[\[<]\\+/?(INST|OUT|SYS|TURN|s)[\] >]') AS conflict,
len(regexp_extract_all(text, '[\[<]\\*/?(INST|OUT|SYS|TURN|s)[\] >]')) AS marks, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 13 ELSE 15 + length(role) END AS frame FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
cast(3 + sum(length(text) + frame + CASE WHEN conflict THEN marks ELSE 0 END) AS BIGINT) AS formatted_chars, count_if(conflict) AS escaped_turns, true AS identical FROM e GROUP BY conv_id""",
    "op4_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM l JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.a, r.m FROM r JOIN e ON r.doc_id = e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.m), d.doc_id) AS component_id FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id""",
    "op6_suffix_dedup": """WITH p AS (SELECT doc_id, n, i, CASE WHEN i + 50 <= n THEN substr(hx, 2 * i + 1, 100) END AS s, substr(hx, 2 * i + 1, 2) AS b
FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n, unnest(range(octet_length(encode(coalesce(text, ''))))) AS i FROM documents) t),
f AS (SELECT s, min(doc_id) AS m FROM p WHERE s IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT p.doc_id, n, i, b, max(CASE WHEN m < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN f ON p.s = f.s),
h AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM c),
g AS (SELECT doc_id, cast(sum(gone) AS BIGINT) AS n_removed, count_if(gone = 1 AND before = 0) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM h GROUP BY 1)
SELECT d.doc_id, octet_length(encode(coalesce(d.text, ''))) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op11_ranked_search": rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS w FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), c AS (SELECT count(*) AS nd, cast(sum(n) AS BIGINT) AS nl FROM n),
f AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM f GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS w FROM benchmark),
x AS (SELECT item_id, f.doc_id, cast(sum(cast(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nl)))) AS BIGINT) AS score FROM q JOIN f ON q.w = f.w JOIN d ON d.w = f.w JOIN n ON n.doc_id = f.doc_id, c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_incremental_aggregates": """WITH RECURSIVE z AS (SELECT i, 0 AS k, cast(i AS BIGINT) AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM z WHERE k < 8),
y AS (SELECT doc_id, coalesce(cast(doc_id AS VARCHAR), '') AS s, 0 AS k, cast(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents) t UNION ALL
SELECT y.doc_id, s, y.k + 1, xor(y.c >> 8, z.c) FROM y JOIN z ON z.k = 8 AND z.i = xor(y.c & 255, ascii(s[y.k + 1])) WHERE y.k < length(s)),
h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM y WHERE k = length(s)),
d AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, n_chars, h % 20 AS b, (h // 20) % 4 AS q FROM documents JOIN h ON documents.doc_id IS NOT DISTINCT FROM h.doc_id),
p AS (SELECT source, lang, text, n_chars, b AS a, CASE q WHEN 0 THEN 20 ELSE b + q END AS e FROM d UNION ALL SELECT source, lang, text, n_chars + 3, b + 3, 20 FROM d WHERE q = 3),
r AS (SELECT source, lang, text, n_chars, unnest(range(a, least(e, 20))) AS batch FROM p WHERE a < 20),
g AS (SELECT source, lang, batch, count(*) AS n_rows, count(DISTINCT text) AS n_distinct, cast(coalesce(sum(n_chars), 0) AS BIGINT) AS total, min(n_chars) AS least, max(n_chars) AS greatest, list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[count(n_chars) // 2 + 1] AS median FROM r GROUP BY 1, 2, 3),
f AS (SELECT source, lang, batch, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, coalesce(total, 0) AS total, least, greatest, median FROM (SELECT DISTINCT source, lang, b.i AS batch FROM d, range(20) b(i)) t LEFT JOIN g USING (source, lang, batch)),
o AS (SELECT *, coalesce(lag(n_rows) OVER w, 0) AS o1, coalesce(lag(n_distinct) OVER w, 0) AS o2, coalesce(lag(total) OVER w, 0) AS o3, lag(least) OVER w AS o4, lag(greatest) OVER w AS o5, lag(median) OVER w AS o6 FROM f WINDOW w AS (PARTITION BY source, lang ORDER BY batch))
SELECT cast(batch AS INTEGER) AS batch, source, lang, o1 AS old_n_rows, n_rows AS new_n_rows, o2 AS old_n_distinct, n_distinct AS new_n_distinct, o3 AS old_total, total AS new_total, o4 AS old_least, least AS new_least, o5 AS old_greatest, greatest AS new_greatest, o6 AS old_median, median AS new_median FROM o
WHERE o1 <> n_rows OR o2 <> n_distinct OR o3 <> total OR o4 IS DISTINCT FROM least OR o5 IS DISTINCT FROM greatest OR o6 IS DISTINCT FROM median""",
    "op13_exact_dedup": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
k AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM k""",
}
