"""GIF files, shards by key, repeated lines."""

import random
import zlib

import pytest

from palimpsest.llm import gif_media as G
from palimpsest.llm import line_dedup, sharding

# GIF


@pytest.mark.parametrize("kinds", [2, 7, 256])
def test_lzw_round_trip(kinds):
    rnd = random.Random(kinds)
    for n in (*range(40), 255, 256, 257, 575, 576, 577, 4000, 60000):
        data = bytes(rnd.randrange(kinds) for _ in range(n))
        assert G.lzw_decode(G.lzw_encode(data), 8, n) == data
    data = b"abc" * 30000
    assert G.lzw_decode(G.lzw_encode(data), 8, len(data)) == data


def pack(codes, widths):
    acc = bits = 0
    for c, w in zip(codes, widths, strict=True):
        acc |= c << bits
        bits += w
    return acc.to_bytes((bits + 7) // 8, "little")


def test_short_streams_are_decoded_together(monkeypatch):
    """As one by one: bytes, cut ends, and codes before their entries; whole streams never one by one."""
    rnd = random.Random(4)
    datas = [bytes(rnd.randrange(k) for _ in range(n)) for k in (1, 2, 7, 256) for n in (1, 2, 3, 50, 576, 5000)] + [b"abc" * 192]
    whole = [G.lzw_encode(d) for d in datas]
    short = [i for i, d in enumerate(datas) if len(d) <= 576]
    odd = [x[: len(x) // 2] for x in whole] + [b"", b"\0", pack([256, 256, 65, 257], [9] * 4), pack([65, 66, 257], [9] * 3), pack([256, 65, 66], [9] * 3), pack([256, 257], [9] * 2)]
    streams, lengths = whole + odd, [len(d) for d in datas] + [40] * len(odd)
    want = [G.lzw_decode(x, 8, n) for x, n in zip(streams, lengths, strict=True)]
    assert G.lzw_decode_all(streams, [8] * len(streams), lengths) == want
    assert G.lzw_decode_all(whole, [8] * len(whole), [1] * len(whole)) == [d[:1] for d in datas]
    with pytest.raises(ValueError):
        G.lzw_decode_all([whole[0], pack([256, 400, 257], [9] * 3)], [8, 8], [1, 10])
    monkeypatch.setattr(G, "lzw_decode", None)
    assert G.lzw_decode_all([whole[i] for i in short], [8] * len(short), [len(datas[i]) for i in short]) == [datas[i] for i in short]


def test_lzw_published_example():
    # a 10 x 10 image of 4 colours, as in many descriptions of the format
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert G.lzw_decode(stream, 2, 100) == bytes(int(x) for r in rows for x in r)


def test_lzw_table_that_stays_full():
    """A writer may go on with a full table: widths stay at 12."""
    data = bytes(random.Random(1).randrange(256) for _ in range(9000))
    codes, known, at = [], {}, data[0]
    for b in data[1:]:
        if (at, b) in known:
            at = known[at, b]
            continue
        codes.append(at)
        if len(known) < 4096 - 258:
            known[at, b] = 258 + len(known)
        at = b
    codes += [at, 257]
    width, _ = G._schedule(8, 1 << 14)
    stream = pack([256, *codes], [9, *width[: len(codes)].tolist()])
    assert G.lzw_decode(stream, 8, len(data)) == data
    with pytest.raises(ValueError):
        G.lzw_decode(pack([256, 400], [9, 9]), 8, 10)


def image(*frames, palette=None):
    palette = palette or bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]) + bytes(3 * 252)
    return G.Image(2, 2, 0, palette, 3, [G.Frame(*f[:4], bytes(f[4]), palette, **f[5]) for f in frames])


def test_file_round_trip_and_canvas():
    im = image(
        (0, 0, 2, 2, [1, 1, 1, 1], {"delay_cs": 5, "disposal": 1}),
        (0, 0, 2, 1, [2, 0], {"delay_cs": 7, "disposal": 3, "transparent": 0}),
        (1, 1, 1, 1, [3], {"disposal": 2}),
        (0, 0, 1, 1, [2], {}),
    )
    back = G.decode(G.encode(im))
    assert back == im
    seen = [[tuple(px[:3]) if px[3] else None for row in c.tolist() for px in row] for c in G.shown(back)]
    r, g, b = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    assert seen == [[r, r, r, r], [g, r, r, r], [r, r, r, b], [g, r, r, None]]
    assert sum(G.histogram(next(G.shown(back)))) == 4


def test_local_palette_interlace_and_damage():
    im = image((0, 0, 2, 2, [1, 2, 3, 0], {}))
    im.frames[0].palette = bytes(range(256)) * 3
    assert G.decode(G.encode(im)).frames[0].palette == bytes(range(256)) * 3
    rows = bytes(range(10))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    assert G._interlaced(bytes(order), 1, 10) == rows
    whole = G.encode(image((0, 0, 2, 2, [1, 2, 3, 0], {})))
    for cut in (3, 10, 400, len(whole) - 1):
        with pytest.raises(ValueError):
            G.decode(whole[:cut])


def test_histograms_are_those_of_the_canvas():
    rnd = random.Random(3)
    plain = G.image_of(bytes(rnd.randrange(256) for _ in range(3 * 576)))
    odd = image((0, 0, 2, 2, [1, 1, 1, 1], {"disposal": 2}), (0, 0, 2, 1, [2, 0], {"transparent": 0}))
    for im in (plain, odd):
        assert G.histograms(im) == [G.histogram(c) for c in G.shown(im)]
    assert G.histograms(G.Image(2, 2, 0, b"", None, [])) == []


def plain_codes(data):
    """LZW by the book: strings and their codes, a clear code where the table is full."""
    out, known, at = [256], {}, b""
    for b in data:
        nxt = at + bytes([b])
        if len(nxt) == 1 or nxt in known:
            at = nxt
            continue
        out.append(known.get(at, at[0]))
        if len(known) < 4096 - 258:
            known[nxt] = 258 + len(known)
        else:
            out.append(256)
            known = {}
        at = bytes([b])
    return [*out, *([known.get(at, at[0])] if at else []), 257]


def test_codes_are_those_of_the_book_and_the_table_is_left_empty():
    rnd = random.Random(6)
    for kinds, n in ((1, 3000), (3, 576), (256, 576), (256, 12000), (90, 20000), (1, 0), (1, 1)):
        data = bytes(rnd.randrange(kinds) for _ in range(n))
        assert [c >> 8 for run in G.lzw_codes(data) for c in run] == plain_codes(data)
        assert not any(G._entries())
    with pytest.raises(TypeError):
        G.lzw_codes([1, 2, 3, None])
    assert not any(G._entries())


def test_files_of_a_batch_are_made_and_read_together(make, monkeypatch):
    """One pack and one decoding for many short files, and what one file by itself gives, whatever its neighbours."""
    rnd = random.Random(8)
    images = [G.image_of(bytes(rnd.randrange(97, 123) for _ in range(576 * rnd.randrange(1, 4)))) for _ in range(40)]
    images += [image((0, 0, 2, 2, [1, 1, 1, 1], {"disposal": 2}), (0, 0, 2, 1, [2, 0], {"transparent": 0})), G.Image(2, 2, 0, G.COLOURS, None, [])]
    files, seen = [G.encode(i) for i in images], [G.histograms(i) for i in images]
    calls = []
    for name in ("lzw_pack", "_decode_single"):
        monkeypatch.setattr(G, name, lambda *a, f=getattr(G, name), name=name: calls.append(name) or f(*a))
    assert G.encode_all(images) == files
    assert G.decode_all(files) == images
    assert calls == ["lzw_pack", "_decode_single"]
    assert [h.tolist() for h in G.histograms_all(images)] == seen
    texts = {i: "ab é" * rnd.randrange(400) for i in range(30)} | {30: None, 31: "x" * 70_000}
    monkeypatch.undo()
    for r in G.store(make(*texts.items())).collect():
        own = G.image_of(G.payload_of(texts[r.doc_id])[0])
        assert (r.n_bytes, bytes(r.gif)) == (len((texts[r.doc_id] or "").encode()), G.encode(own))
        assert [(f.at_cs, f.delay_cs, f.histogram) for f in r.frames] == [(4 * k, 4, h) for k, h in enumerate(G.histograms(own))]


def test_declared_sizes_are_bounded(spark):
    import struct

    head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)
    huge = b"," + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x00"
    small = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0)
    good = G.encode(image((0, 0, 2, 2, [1, 2, 3, 0], {}), (0, 0, 2, 2, [0, 2, 3, 0], {})))
    df = spark.createDataFrame([(1, head + huge + b";"), (2, small + huge + b";"), (3, good)], "doc_id long, gif binary")
    rows = G.frames(df).collect()
    assert [(r.doc_id, r.error is None) for r in rows] == [(1, False), (2, False), (3, True), (3, True)]
    assert [r.frame for r in rows if r.doc_id == 3] == [0, 1]


def test_gif_of_a_very_long_text(make):
    text = "".join(chr(97 + i * i % 26) for i in range(2_000_000))
    (r,) = G.digest(G.store(make((1, text)))).collect()
    assert r.n_bytes == 2_000_000 and r.payload_bytes == -(-2_000_000 // 576) * 576


def test_gif_query(spark, make, sf):
    texts = {1: None, 2: "", 3: "x" * 576, 4: "é" * 300, 5: "same", 6: "same"}
    rows = {r.doc_id: r for r in G.digest(G.store(make(*texts.items()))).collect()}
    for i, t in texts.items():
        payload, n = G.payload_of(t)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-32:]))
        assert len(payload) % 576 == 0 and payload[:n] == (t or "").encode() and set(payload[n:]) <= {255}
    assert rows[5][3:] == rows[6][3:]
    stored = G.store(make(*texts.items()))
    frames = G.frames(stored).collect()
    assert {r.doc_id for r in frames} == set(texts) and all(sum(r.histogram) == 576 for r in frames)
    for r in stored.collect():
        own = sorted((f for f in frames if f.doc_id == r.doc_id), key=lambda f: f.frame)
        assert [(f.at_cs, f.delay_cs, f.histogram) for f in r.frames] == [(f.at_cs, f.delay_cs, f.histogram) for f in own]
    bad = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, gif binary")
    assert {r.error for r in G.frames(bad).collect()} == {"no GIF signature", "no file"}
    whole = G.query(spark, sf).collect()
    for d in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect():
        import hashlib

        (r,) = [x for x in whole if x.doc_id == d.doc_id]
        assert r.payload_sha256 == hashlib.sha256(G.payload_of(d.text)[0]).hexdigest()


# shards


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    ids = [-5, 2**63 - 1, -(2**63), None, 0, 7, *range(1000, 1100)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for n in (1, 2, 16, 1000):
        for r in sharding.assign(df, shards=n).collect():
            assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, n), jump(r.doc_id or 0, n + 1))
    with pytest.raises(ValueError):
        sharding.jump(df["doc_id"], 0)


def test_sharding_query(spark, make, sf):
    docs = make((1, None), (2, "é"), (2, "é"), (None, "x"), (None, ""), *[(i, str(i)) for i in range(3, 300)])
    rows = sharding.place(docs).collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].size == 1 and by_id[1].text_crc32 == 0
    assert by_id[2].size == 3 and by_id[2].text_crc32 == zlib.crc32("é".encode())
    assert all(r.law == "key" and r.grown_shard in (r.shard, 16) for r in rows)
    assert sharding.place(docs.limit(0)).count() == 0


def test_slots_of_hot_ids_and_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.crc32(F.col("id").cast("string").cast("binary")).alias("crc"), F.lit("x").alias("__n"), F.lit("y").alias("__rank"))
    cells = df.withColumn("cell", sharding.cell_of(F.col("doc_id"), F.col("crc"))).withColumn("shard", F.lit(0))
    assert cells.select("cell").distinct().count() > 900
    out = sharding.slots(cells, ["doc_id", "crc"])
    assert out.columns == [*cells.columns, "slot"] and out.first()["__n"] == "x"
    assert sorted(r.slot for r in out.collect()) == list(range(4000))


def test_sharding_query_on_whole_tables(spark, sf):
    """Against the published algorithm, and against the SQL."""
    from compare import same

    same(sharding.query(spark, sf), sharding.SQL, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.query(spark, sf).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), jump(r.doc_id, 16), jump(r.doc_id, 17))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_sql_on_edges(spark, make, tmp_path):
    from compare import same

    ids = [None, 0, -1, 1, 2**63 - 1, -(2**63), 2**31, -(2**40)]
    docs = make(*[(i, t) for i in ids for t in (None, "", "é\n🙂", "a" * 3000)], (5, "x"), (5, "x"), extra=False)
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([r.doc_id for r in docs.collect()], pa.int64()), "text": pa.array([r.text for r in docs.collect()], pa.string())}), tmp_path / "documents.parquet")
    same(sharding.place(docs), sharding.SQL, str(tmp_path))


# lines


def test_line_query(spark, sf):
    from compare import same

    same(line_dedup.query(spark, sf), line_dedup.SQL, sf)


def cut(make, *rows):
    return {r.doc_id: r.text for r in line_dedup.remove_repeats(make(*rows)).collect()}


def test_lines(make):
    p = "one\ntwo\nthree\nfour"
    got = cut(make, (1, f"a\n{p}\nb"), (2, f"c\n\n{p}\n\nd"), (3, "one\ntwo"), (4, "  one\ntwo \t\nthree"), (5, None), (6, ""), (7, "q\nq\nq\nq\nq"), (8, p))
    assert got[1] == f"a\n{p}\nb"  # the first stays
    assert got[2] == "c\n\n\nd"
    assert got[3] == "one\ntwo"  # too short for a window
    assert got[4] == ""
    assert got[5] is None and got[6] == ""
    assert got[7] == "q"  # the first window stays but for what the second one covers
    assert got[8] == ""


def test_lines_of_repeated_rows(make):
    docs = make((1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"))
    out = line_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]
    assert line_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert line_dedup.digest(docs).count() == 3


def test_long_text(make):
    lines = [f"line {i}" for i in range(20000)]
    got = cut(make, (1, "\n".join(lines)), (2, "\n".join(["x", *lines, "y"])))
    assert got[2] == "x\ny"
