"""Tokenizing by chunks against the libraries on whole texts; packing; shards of ids."""

import hashlib
import random
import zlib

import public_tokenizers as P
import pytest

from palimpsest.llm import common, packing, sentencepiece_codec, sstable

ODD = list("ab e  ▁\n\téñ中é🙂\x00\xa0　.,1'ªµİ²½$€×A\x1c\x85") + ["the ", " ▁", "  ", "<s>", "<0x0A>", "'s", "<|endoftext|>", "́"]
EDGE = [None, "", " ", "  ", "\n", "a", " a", "a ", "a" * 5000, "the cat. " * 3000]


def texts(n=1500):
    rnd = random.Random(5)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 24))) for _ in range(n)]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_chunked_sentencepiece_is_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    assert codec.by_chunk
    ts = texts() + EDGE[1:]
    for limit in (10, 10**6):
        codec.table = common.ChunkTable(codec._segment, limit)
        for t, got, ids in zip(ts, codec.digests(ts), codec.encode(ts), strict=True):
            want = sp.encode(t)
            assert ids == want
            assert got == (len(want), sha(",".join(map(str, want))), sha(sp.decode(want)))


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunked_ids_are_the_library(name, spaces):
    encoder = common.IdEncoder(P.path(name), spaces)
    ts = texts() + EDGE[1:]
    for limit in (10, 10**6):
        encoder.table = common.ChunkTable(encoder._encode, limit)
        for t, got in zip(ts, encoder(ts), strict=True):
            assert got == encoder._encode([t])[0], t


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_letters_beyond_latin_extended(name, spaces):
    """Letters from U+0240 to U+027F, alone and between others, in texts of otherwise plain Latin."""
    rnd = random.Random(8)
    odd = [chr(c) for c in range(0x240, 0x280)]
    ts = ["gaskiya ɗan ɓera", "the word pɪɛnɔ is", "ɔkɔ Ɛwe kɔɖ"] + [f"a word{c}s {c} {c}x, x{c}" for c in odd]
    ts += ["".join(rnd.choice(["a", "é", "ɏ", " ", ".", rnd.choice(odd)]) for _ in range(20)) for _ in range(500)]
    encoder = common.IdEncoder(P.path(name), spaces)
    for t, got in zip(ts, encoder(ts), strict=True):
        assert got == encoder._encode_each([t])[0], t


def library(tok, text):
    return b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_plain_words_go_to_the_model_once_for_all_cases(name, spaces, monkeypatch):
    """Words of ASCII letters need no pass through the whole library, and cases of a word are one chunk where case plays no part."""
    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(P.path(name)), random.Random(11)
    encoder = common.IdEncoder(P.path(name), spaces)
    words = ["".join(rnd.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rnd.randint(1, 12))) for _ in range(300)] + ["x" * 3000]
    words += [f(w) for w in words for f in (str.upper, str.title)]
    rnd.shuffle(words)
    text = "A" + "".join(f" {w}" for w in words)
    with monkeypatch.context() as m:
        for way in ("_encode_joined", "_encode_each"):
            m.setattr(encoder, way, lambda x: [] if not x else 1 / 0)
        if spaces:
            text = text[1:]
        (got,) = encoder([text])
    assert got == library(tok, text)
    assert len(encoder.table.known) == len({w if spaces else w.lower() for w in text.split()})


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cases_of_letters_in_and_beyond_latin_1(name, spaces):
    """Cases that leave Latin-1 or the letters told apart here (İ, Ⱥ, Ʉ, Ɓ), that have no other case or two letters for it (ß, ŉ), and the Kelvin sign."""
    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(P.path(name)), random.Random(12)
    encoder = common.IdEncoder(P.path(name), spaces)
    latin1 = [chr(c) for c in range(256)]
    pools = (latin1, [c for c in latin1 if c.isalpha()], list("aBcÉéÑßÿÞ .,-"), list("aBÉß İȺɄɁŉǅƁǰK"), list("ABC'S'T 'Re"))
    ts = [c for c in latin1] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 20))) for pool in pools for _ in range(400)]
    for t, got in zip(ts, encoder(ts), strict=True):
        assert got == library(tok, t), repr(t)


def test_sentencepiece_query(spark, sf, make):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    docs = make((None, "x"), (2, None), (3, ""), (3, ""), (4, "two  words\nhere"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in sentencepiece_codec.encode_decode(docs).collect())
    assert got == sorted([(0, len(sp.encode("x")), sha("x")), (2, 0, sha("")), (3, 0, sha("")), (3, 0, sha("")), (4, len(sp.encode("two  words\nhere")), sha("two  words\nhere"))])
    assert sentencepiece_codec.encode_decode(docs.limit(0)).count() == 0
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, out="ids"), ids="ids", out="back")
    assert all(r.back == (r.text or "") for r in both.collect())
    whole = sentencepiece_codec.query(spark, sf)
    assert whole.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


# packing


def check_packed(rows, capacity=packing.CAPACITY):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.query(spark, sf).collect()
    bins = check_packed(rows)
    assert len(bins) <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tok.encode(d.text, add_special_tokens=False).ids + [1]
        parts = by_doc[d.doc_id]
        assert sorted(parts) == list(range(-(-len(ids) // 4096)))
        for k, r in parts.items():
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r.start, r.length) == (4096 * k, len(part))
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))


def test_packing_edges(make):
    docs = make((1, None), (1, None), (None, ""), (2, "cat " * 9000), (3, "dog"))
    rows = packing.pack(packing.pieces(docs)).collect()
    check_packed(rows)
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 1), (1, 0, 1), (1, 0, 1), (2, 0, 4096), (2, 1, 4096), (2, 2, 809), (3, 0, 2)]
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_packing_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 64)
    rnd = random.Random(1)
    parts = spark.createDataFrame([(i, 0, 0, min(4000, int(rnd.expovariate(1 / 400)) + 1), 0) for i in range(700)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(parts).collect()
    assert sorted(r.doc_id for r in rows) == list(range(700))
    assert len(check_packed(rows)) <= 1.03 * -(-sum(r.length for r in rows) // 4096) + 1


def test_local_search_empties_bins():
    # best fit decreasing leaves four bins; exchanges bring it to three
    lengths = [50, 50, 40, 30, 30, 30, 30, 20, 20]
    bins = [[0, 2], [1, 3], [4, 5, 6], [7, 8]]
    better = packing.improve([b[:] for b in bins], lengths, 100, 3)
    assert sorted(i for b in better for i in b) == list(range(9))
    assert len(better) == 3 and all(sum(lengths[i] for i in b) <= 100 for b in better)


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def test_every_step_raises_the_squared_fill(monkeypatch):
    """The changes told are all positive and add up to the rise; what is left has no step that raises it."""
    improve = packing.improve
    monkeypatch.setattr(packing, "improve", lambda bins, *_: bins)
    rnd = random.Random(3)
    n_steps = fewer = 0
    for _ in range(60):
        top, capacity = rnd.choice([(60, 100), (45, 100), (400, 1000)])
        lengths = [rnd.randint(top // 5, top) for _ in range(60)]
        bins = packing.pack_block(lengths, capacity)
        before, changes = squares(bins, lengths), []
        after = improve([b[:] for b in bins], lengths, capacity, 0, changes.append)
        assert sorted(i for b in after for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= capacity for b in after)
        assert all(c > 0 for c in changes) and squares(after, lengths) == before + sum(changes)
        n_steps += len(changes)
        fewer += len(after) < len(bins)
        fills = [sum(lengths[i] for i in b) for b in after]
        for x, a in enumerate(after):
            for y, b in enumerate(after):
                if x != y:
                    outs = [lengths[i] for i in a] + [lengths[i] + lengths[j] for i in a for j in a if i < j]
                    backs = [0] + [lengths[i] for i in b]
                    gains = [o - r for o in outs for r in backs] + [lengths[i] - lengths[j] - lengths[m] for i in a for j in b for m in b if j < m]
                    assert not any(0 < g <= capacity - fills[y] and fills[y] + g > fills[x] for g in gains)
    assert n_steps > 100 and fewer > 3


def fewest(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def put(k, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if k == len(lengths):
            best = len(fills)
            return
        for room in {f for f in fills if f + lengths[k] <= capacity}:
            at = fills.index(room)
            put(k + 1, fills[:at] + [room + lengths[k]] + fills[at + 1 :])
        put(k + 1, [*fills, lengths[k]])

    put(0, [])
    return best


def test_small_blocks_against_the_optimum():
    rnd = random.Random(8)
    over = 0
    for _ in range(120):
        lengths = [rnd.randint(15, 70) for _ in range(rnd.randint(1, 11))]
        least = fewest(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= least
        over += len(packing.pack_block(lengths, 100)) - least
    assert over <= 2
    assert packing.lower_bound([60] * 7 + [10], 100) == 7 and packing.lower_bound([], 100) == 0


# shards of ids


def test_sstable_query(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in sstable.query(spark, sf).collect()}
    at = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = tok.encode(d.text, add_special_tokens=False).ids + [0]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)


def test_sstable_edges(spark, make, tmp_path):
    docs = make((3, "c"), (1, None), (None, "z"), (3, "b"), (2, ""), (-9, "x"), (3, "b"))
    shards = sstable.write(docs, str(tmp_path))
    rows = sstable.read(shards).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -9, 1, 2, 3, 3, 3]
    assert [r.start for r in rows] == [0, 2, 4, 5, 6, 8, 10]
    found = sstable.lookup(shards, spark.createDataFrame([(3,), (1,), (44,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in found) == [1, 3, 3, 3]
    assert sstable.read(sstable.write(docs.limit(0), str(tmp_path / "none"))).count() == 0


def test_sstable_of_a_hot_identifier(spark, tmp_path):
    """Rows of one identifier, repeated ones too, are dealt over shards; order, starts and lookups hold."""
    from pyspark.sql import functions as F

    docs = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id") % 9)).alias("text"))
    # so small a table would be joined into one partition
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = sstable.write(docs, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shards) > 2 and max(s.n_docs for s in shards) < 1500
    again = spark.createDataFrame([(s.path, s.before) for s in shards], "path string, before long")
    rows = sstable.read(again).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    found = sstable.lookup(again, spark.createDataFrame([(7,), (8,)], "doc_id long")).collect()
    assert len(found) == docs.filter("doc_id in (7, 8)").count()


def test_sstable_stores_by_their_names():
    given = ["s3a://b/k", "s3n://b/k", "s3://b/k", "hdfs://h/k", "file:/data/k", "/data/k"]
    assert [sstable._uri(x) for x in given] == ["s3://b/k", "s3://b/k", "s3://b/k", "hdfs://h/k", "file:/data/k", "file:///data/k"]


def test_sstable_file(tmp_path):
    path = str(tmp_path / "x.sst")
    rnd = random.Random(2)
    keys = sorted({rnd.randrange(-(2**62), 2**62) for _ in range(3000)})
    values = {k: rnd.randbytes(4 * rnd.randint(0, 60)) for k in keys}
    with open(path, "wb") as f:
        w = sstable.Writer(f)
        for k in keys:
            w.add(k, values[k])
        w.close()
    r = sstable.Reader(path)
    assert len(r.blocks) > 3 and r.docs == 3000
    assert list(r.scan()) == [(k, values[k]) for k in keys]
    assert all(r.get(k) == [values[k]] for k in keys[::37])
    absent = [k + 1 for k in keys if k + 1 not in values]
    assert all(r.get(k) == [] for k in absent[:200])
    assert sum(r.may_hold(k) for k in absent) < 0.03 * len(absent)
    raw = bytearray(open(path, "rb").read())
    raw[-60] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        sstable.Reader(path)
