"""SentencePiece encoding and decoding through a distinct-chunk table.

A model whose pieces never hold a white-space marker behind another character can't merge across the
place where a run of markers begins. The marked text is therefore cut there; each distinct chunk (a
marked word) is segmented once by the library, and ids are put together by position. The table is
kept per task, not shuffled: a table of all distinct words joined back by position would send every
word of the corpus over the network to save work that a bounded local table already saves.

A model without that property (checked when it is loaded) is applied to whole texts.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty
string; null ids, repeated rows and extra columns pass through untouched, one output row per row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkTable, arrow_rows, once, slices, table

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        inside = re.compile(f"[^{MARK}]{MARK}")
        marked = sp.encode("a b", out_type=str)
        self.by_chunk = (
            not any(inside.search(p) for p in pieces)
            and "".join(marked) == f"{MARK}a{MARK}b"  # a marker in front, white space as markers
            and sp.decode(sp.encode("  a  ")) == "  a  "  # spaces are kept as they are
            and sp.decode(sp.encode("ﬁ　é")) == "ﬁ　é"  # no normalization
            and sp.piece_to_id(MARK) != sp.unk_id()
        )
        self.alone = [sp.piece_to_id(MARK)]
        self.table = ChunkTable(self._segment)

    def _segment(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, the ids, the text they decode to with its leading space) of each chunk."""
        out = []
        for i in range(0, len(chunks), 20_000):
            part = chunks[i : i + 20_000]
            # the library puts a marker in front by itself, and nothing before an empty text
            found = [ids if len(c) > 1 else self.alone for c, ids in zip(part, self.sp.encode([c[1:] for c in part], num_threads=1), strict=True)]
            out += [(len(ids), ",".join(map(str, ids)), " " + d) for ids, d in zip(found, self.sp.decode(found, num_threads=1), strict=True)]
        return out

    def _chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        if not self.by_chunk:
            yield from self.sp.encode(texts, num_threads=1)
            return
        for part in slices(texts):
            for found in self.table.values(map(self._chunks, part)):
                yield [int(i) for _, ids, _ in found for i in ids.split(",")]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text) of each text."""
        if not self.by_chunk:
            for ids in self.sp.encode(texts, num_threads=1):
                yield len(ids), _sha(",".join(map(str, ids))), _sha(self.sp.decode(ids))
            return
        for part in slices(texts):
            for found in self.table.values(map(self._chunks, part)):
                yield sum([n for n, _, _ in found]), _sha(",".join([s for _, s, _ in found])), _sha("".join([d for _, _, d in found])[1:])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def codec(path: str) -> Codec:
    return once(("codec", path), "codec", lambda: Codec(path))


def encode(df: DataFrame, text: str = "text", out: str = "ids", model: str | None = None) -> DataFrame:
    """``df`` with the ids of ``text`` as array<int> in ``out``."""
    path = model or default_model()

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series(list(codec(path).encode(texts.fillna("").tolist())), dtype=object)

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, ids: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """``df`` with the text of ``ids`` in ``out``; null ids give an empty text."""
    path = model or default_model()

    @F.pandas_udf("string")
    def text(column):
        import pandas as pd

        return pd.Series([codec(path).sp.decode([int(i) for i in x]) if x is not None else "" for x in column], dtype=object)

    return df.withColumn(out, text(F.col(ids)))


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: id, number of ids, digest of the ids and of the text they decode to."""
    path = model or default_model()

    def run(b):
        n, ids, texts = zip(*codec(path).digests(b["text"].to_pylist()), strict=True)
        return {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": texts}

    return arrow_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
