"""Document-at-a-time operators against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import chat_format, packing, quality_rules, queries, tiff  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [None, "", " ", "\n\n", "a", "one\none\n one\none", "x " * 700, "é ü 漢字 😀 b", "a  b \n c\t\td  ", "#" * 40 + " | & <x>", "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3, "same text twice", "same text twice", "Long " * 30000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, f"s{i % 2}", "clash", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, bucket int").repartition(3)


def base_of(t):
    t = t or ""
    ws = WORD.findall(t)
    wins = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    cover = set()
    for i in range(len(ws) - 7):
        if wins[tuple(ws[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), n < 20 or 100 * len(cover) > 30 * n


def test_quality_rules_base(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (docs, odd):
        texts = frame.select("doc_id", "text").collect()
        got = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(frame).collect())
        assert got == Counter(base_of(t) for _, t in texts)


def test_quality_rules_verdict(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j * 13) % 97}" for j in range(60 + i % 30)), "en", "s") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{(i + j * 13) % 97}###$$$" for j in range(80)), "en", "s") for i in range(5)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(df).collect()}
    assert all(kept[i] for i, *_ in clean)
    assert not any(kept[i] for i, *_ in junk)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        want = Counter()
        for d, x in frame.select("doc_id", "text").collect():
            want[d, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])] += 1
        pieces = packing.pack(frame, queries.tokenizer_path(), open_windows=4).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_doc[p.doc_id].append(p)
            by_seq[p.sequence_id].append(p)
        for seq in by_seq.values():
            at = 0
            for p in sorted(seq, key=lambda p: p.offset):
                assert p.offset == at and p.length > 0
                at += p.length
            assert at <= 2048
        assert sum(want.values()) == sum(p.start == 0 for p in pieces)
        for (d, ids), n in want.items():
            found = [p for p in by_doc[d] if p.doc_tokens == len(ids)]
            assert sum(p.length for p in found) == n * len(ids)
            for p in found:
                import numpy as np

                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_reads_added_tokens_as_the_tokenizer_does(spark):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n <|endoftext|>", "<|endoftext| >", "plain text  of words"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = {p.doc_id: p for p in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer_path()).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        assert (got[i].doc_tokens, got[i].length, got[i].ids_crc32) == (len(ids), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_packing_leaves_little_padding(spark):
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8), queries.tokenizer_path())
    row = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("s")).first()
    assert row.n / (row.s * 2048) > 0.98


def least_determinant(x):
    """The minimum covariance determinant by all halves of the rows."""
    from itertools import combinations

    import numpy as np

    n, p = x.shape
    h = (n + p + 1) // 2
    best = None
    for pick in combinations(range(n), h):
        _, _, _, logdet = quality_rules.solved(moments_of(x[list(pick)])[None], np.array([h / n]))
        if best is None or logdet[0] < best[0]:
            best = (float(logdet[0]), pick)
    return best


def moments_of(x):
    import numpy as np

    return np.concatenate(([len(x)], x.sum(0), [(x[:, i] * x[:, j]).sum() for i, j in quality_rules.PAIRS]))


def test_outliers_have_the_least_determinant(spark):
    """Small groups with planted outliers, against all halves."""
    import numpy as np

    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(4):
        x = rng.normal(size=(13, quality_rules.P)) * quality_rules.FLOORS * (3 + g)
        x[: 2 + g % 2] += 40 * quality_rules.FLOORS * rng.normal(size=quality_rules.P)
        want[g] = least_determinant(x)
        rows += [(g, v.tolist()) for v in x]
    got = {r.group: r for r in quality_rules.fit(spark.createDataFrame(rows, "group long, x array<double>").repartition(3)).collect()}
    assert got.keys() == want.keys()
    exact = 0
    for g, (logdet, _) in want.items():
        assert logdet - 1e-6 <= got[g].logdet < logdet + 1.5  # steps end in a minimum, if not always the least
        exact += got[g].logdet < logdet + 0.05
        d = np.array([v for k, v in rows if k == g]) - np.array(got[g].center)
        d2 = np.einsum("ni,ij,nj->n", d, np.array(got[g].inverse).reshape(quality_rules.P, -1), d)
        assert d2[: 2 + g % 2].min() > 10 * np.median(d2)
    assert exact >= 2


def test_outliers_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [sorted((r.doc_id, r.kept, round(r.distance2 or -1, 6)) for r in quality_rules.quality_rules(df.repartition(n)).collect()) for n in (1, 7)]
    assert seen[0] == seen[1]


def test_a_group_of_few_is_drawn_to_its_parent(spark):
    words = lambda i: " ".join(f"word{(i * 7 + j * 13) % 97}" for j in range(60 + i % 30))
    rows = [(i, words(i), "en", "large") for i in range(300)] + [(1000, words(7), "en", "alone"), (1001, words(8), None, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000].kept and got[1001].kept and abs(got[1000].distance2 - got[7].distance2) < 5


@pytest.mark.parametrize("kind", sorted(tiff.PACK))
@pytest.mark.parametrize("layout", [{"rows_per_strip": 5}, {"tile": 16}, {}])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(kind, layout, predictor):
    import numpy as np

    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (7, 31), (40, 33), (300, 64)):
        for px in (rng.integers(0, 256, (h, w), np.uint8), np.zeros((h, w), np.uint8), rng.integers(0, 3, (h, w), np.uint8)):
            pages = list(tiff.pages(tiff.encode([{"pixels": px, "compression": kind, "predictor": predictor, **layout}] * 2)))
            assert len(pages) == 2 and all((p["pixels"][:, :, 0] == px).all() for p in pages)


def test_tiff_known_streams():
    assert tiff.lzw_decode(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80]), 9)[:2] == bytes([7, 7])
    assert tiff.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA]), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")[:24]


def test_tiff_reads_every_page():
    import numpy as np

    n = (1 << 16) + 3
    media = tiff.encode([{"pixels": np.array([[i % 251]], np.uint8), "compression": tiff.NONE} for i in range(n)])
    assert [int(p["pixels"][0, 0]) for p in tiff.pages(media)] == [i % 251 for i in range(n)]


def test_tiff_rows(spark):
    import numpy as np

    good = tiff.encode([{"pixels": np.arange(60, dtype=np.uint8).reshape(6, 10), "compression": k} for k in tiff.PACK])
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"MM\0*")), (4, bytearray(good[:30])), (5, bytearray(b""))], "key long, media binary")
    rows = tiff.read_pages(df).collect()
    assert [(r.page, r.width, r.length) for r in rows if r.key == 1] == [(i, 10, 6) for i in range(4)]
    assert {r.key for r in rows if r.error} == {3, 4, 5} and 2 not in {r.key for r in rows}


def test_media_query(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op9_tiff(spark, SF).collect()}
    for d, t in texts:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


def test_media_rows_of_odd_texts(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(7, "x" * 200_000), (7, "x" * 200_000), (8, "".join(chr(33 + i * i % 90) for i in range(150_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    want = Counter((d, len(raw := (t or "").encode()), hashlib.sha256(queries.padded(raw)).hexdigest()) for d, t in rows)
    got = queries.media_rows(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == want
    assert all(r.payload_bytes % 576 == 0 for r in got)
    same = [r for r in got if r.doc_id == 7 and r.n_bytes == 200_000]
    assert len(same) == 2 and len({(r.media_sha256, r.feature) for r in same}) == 1
    assert queries.media_rows(df.limit(0)).count() == 0


def test_tiff_codecs_get_like_shares(spark):
    share = Counter()
    for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        for p in tiff.pages(queries.tiff_of(queries.padded((t or "").encode()))):
            share[p["compression"]] += p["pixels"].size
    assert all(0.3 < v / sum(share.values()) < 0.37 for v in share.values()) and len(share) == 3


def test_tiff_forged_files(spark):
    import struct

    import numpy as np

    tiled = bytearray(tiff.encode([{"pixels": np.zeros((32, 32), np.uint8), "compression": tiff.NONE, "tile": 16}]))
    strips = bytearray(tiff.encode([{"pixels": np.zeros((32, 32), np.uint8), "compression": tiff.DEFLATE, "rows_per_strip": 8}]))

    def patched(media, tag, value=None):
        """The file with a tag's value changed, or the tag renamed away."""
        media = bytearray(media)
        at = struct.unpack_from("<I", media, 4)[0]
        for k in range(struct.unpack_from("<H", media, at)[0]):
            p = at + 2 + 12 * k
            if struct.unpack_from("<H", media, p)[0] == tag:
                if value is None:
                    struct.pack_into("<H", media, p, 60000)
                else:
                    struct.pack_into("<I", media, p + 8, value)
        return bytes(media)

    bad = [patched(tiled, tiff.TILE_WIDTH), patched(tiled, tiff.TILE_LENGTH), patched(tiled, tiff.TILE_COUNTS), patched(tiled, tiff.TILE_WIDTH, 1 << 30), patched(strips, tiff.LENGTH, 1 << 30), patched(strips, tiff.ROWS_PER_STRIP, 0), patched(strips, tiff.STRIP_OFFSETS), patched(strips, tiff.WIDTH)]
    rows = tiff.read_pages(spark.createDataFrame(list(enumerate(map(bytearray, bad))), "key long, media binary")).collect()
    assert sorted(r.key for r in rows) == list(range(len(bad))) and all(r.error and r.pixels is None for r in rows)
    assert tiff.read_pages(spark.createDataFrame([], "key long, media binary")).count() == 0


TURNS = ["", "plain", "[INST]", "</s>[INST] ok [/INST]", r"[\INST]", r"[\\/INST] <\s> </s>", " [/INST", "a [/SYS] b", "[/INST", "line\n[TURN x] y [/TURN]", "<s>", "é" * 5000, " </s", "x </s>"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "odd role]\n"])
def test_chat_turns(role):
    for t in TURNS:
        made = chat_format.render_checked(role, t)
        assert chat_format.parse(made + chat_format.render("user", "next")) == [(role, t), ("user", "next")]


def test_chat_round_trip(spark):
    rows = [(c, i if c != 2 else 0, r, t) for c in (1, 2, None) for i, (r, t) in enumerate(zip(["user", "assistant", None, "system"] * 4, [*TURNS, None, "dup"], strict=True))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.round_trip(df).collect()}
    for c in (1, 2, None):
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        said = [x for _, r, x in own if r == "assistant"]
        g = got[c]
        assert g.identical and g.n_turns == len(own)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest())
        text = "<s>" + "".join(p.piece for p in sorted((p for p in chat_format.format_chat(df).collect() if p.conv_id == c), key=lambda p: p.seq))
        assert len(text) == g.formatted_chars
    assert chat_format.round_trip(df.limit(0)).count() == 0


def test_segments_are_those_of_the_tokenizer_alone():
    """Slices of texts with spaces in every place, long words and the small tables' texts; a cache that overflows."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, own = Tokenizer.from_file(path), packing.Segments(path)
    odd = ["", " ", "a", "a ", "a  b", "a \n b", " a", "  x", "é ü x", "a  b", "x" * 50_000, "a b " * 3, "Ġ aĠ b", "\x00 \x1c y"]
    texts = odd + [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [i.tolist() for i in own.ids(texts)] == want
    before, packing.CACHE_BYTES = packing.CACHE_BYTES, 20_000
    try:
        assert [own.ids([x])[0].tolist() for x in texts] == want
    finally:
        packing.CACHE_BYTES = before
    assert own.ids([]) == []
