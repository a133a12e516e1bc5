"""Helpers the operators of this package share."""

from __future__ import annotations

import gc
import os
import re
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from string import ascii_letters

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where
    that is unset on a single machine, as in tests. A cluster without that setting is an error: a folder of
    one machine would be written in parts that others don't see."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="palimpsest-")
    return _own_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't use."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Text handled at once; bounds the memory that the pieces of a batch take.
SLICE_CHARS = 1_000_000

#: White space in Unicode but not in ASCII, and control characters that some libraries count as such.
ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")


class _Known(dict):
    """Values by chunk. Chunks it lacks come from the generation before, or are noted as missing."""

    def __init__(self, before: dict):
        self.before, self.missing = before, set()

    def __missing__(self, chunk: str):
        value = self.before.get(chunk)
        if value is None:
            self.missing.add(chunk)
        else:
            self[chunk] = value
        return value


class ChunkTable:
    """Distinct-chunk table of one task: each distinct chunk is encoded once, and results are put
    together by position. It holds two generations of at most ``limit`` chunks, besides those of the
    texts in hand: beyond that the older one goes, so memory is bounded whatever the vocabulary, and
    chunks in use stay. Results don't depend on the limit. Values are never None.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], limit: int = 350_000):
        self.encode_many, self.limit, self.known = encode_many, limit, _Known({})

    def values(self, chunks: Iterable[list[str]]) -> Iterator[list]:
        known = self.known
        found = [(cs, list(map(known.__getitem__, cs))) for cs in chunks]
        if known.missing:
            new = list(known.missing)
            known.missing.clear()
            known.update(zip(new, self.encode_many(new), strict=True))
        for cs, vs in found:
            at = -1
            while None in vs:
                try:
                    while True:
                        at = vs.index(None, at + 1)
                        vs[at] = known[cs[at]]
                except ValueError:
                    break
            yield vs
        if len(known) > self.limit:
            self.known = _Known(dict(known))


def arrow_schema(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def slim(batches: Iterable, rows: int = 1000) -> Iterator:
    """Arrow batches in parts of few rows, none of them empty: what Python makes of them stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def arrow_rows(df: DataFrame, run: Callable, schema: str, rows: int = 1000) -> DataFrame:
    """``df.mapInArrow`` where ``run(batch)`` gives the columns of what is made of ``rows`` rows at most."""
    kinds = arrow_schema(schema)

    def each(batches):
        import pyarrow as pa

        for b in slim(batches, rows):
            yield pa.RecordBatch.from_pydict(run(b), schema=kinds)

    return df.mapInArrow(each, schema)


def slices(texts: Iterable, chars: int = SLICE_CHARS) -> Iterator[list]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


_loaded: dict = {}


def _models(operator) -> dict:
    """What this worker process holds for ``operator``. It holds models of one operator at a time: workers outlive a
    stage, and those of all stages of a pipeline would add up beside the JVM's heap."""
    if operator not in _loaded:
        _loaded.clear()
        gc.collect()
        # models hold millions of values and no cycles: look for cycles less often
        gc.set_threshold(100_000, 50, 100)
        _loaded[operator] = {}
    return _loaded[operator]


def once(operator, key, load: Callable):
    """Per worker process: models and their chunk tables live until another operator loads its own."""
    held = _models(operator)
    if key not in held:
        held[key] = load()
    return held[key]


def latest(operator, slot: str, key, load: Callable):
    """Per worker process, as ``once``, but one value a slot: another key takes its place."""
    held = _models(operator)
    if slot not in held or held[slot][0] != key:
        held.pop(slot, None)
        held[slot] = (key, load())
    return held[slot][1]


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_SPACED = re.compile("[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
#: For text of Latin letters, where all agree on what is a letter: runs of letters apart from the rest.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]"
_LATIN = re.compile("[ \t\n\r\f\v]*(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[^ \t\n\r\f\vA-Za-zÀ-ÖØ-öø-ɏ]+)|[ \t\n\r\f\v]+")
_LATIN_WORDS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+|[^ \t\n\r\f\vA-Za-zÀ-ÖØ-öø-ɏ]+")
_BEYOND = re.compile("[^\t\n\r\f\v -~¡-©«-´¶-¹»-ɏ]|['\u0130]")
#: Bytes of text that is Latin at a glance: ASCII but control characters and apostrophe, and the two-byte letters from
#: U+00C0 to U+023F. Those up to U+024F share their lead byte with letters beyond, so _BEYOND tells them apart.
_PLAIN_BYTES = bytes(b for b in [9, 10, 11, 12, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)] if b != 39)


def _is_latin(text: str) -> bool:
    left = text.encode().translate(None, _PLAIN_BYTES)
    return (not left and "\u0130" not in text) or not _BEYOND.search(text)


def _is_latin1(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


#: Chunks in a generation of an encoder's table: 40 MB or so, and each executor has a worker per core.
ID_CHUNKS = 200_000


class IdEncoder:
    """Ids, as little-endian unsigned 32-bit bytes, of texts under a file of the tokenizers library.

    Neither of the two kinds of vocabulary here lets a token reach from a non-space character over
    the white space after it, so a text is cut before each run of ASCII white space and each distinct
    chunk is encoded once. Latin text without apostrophes is cut between letters and others as well,
    as both vocabularies do. ``spaces=False`` is for a vocabulary that drops white space: chunks are
    then the bare words. Texts with any other space character, or
    with the string of a special token, are encoded whole.

    Where case plays no part in a vocabulary, text of Latin-1 is taken in lower case, so a word is encoded once
    for all its cases. Words of ASCII letters go straight to the model, as the steps before it do no more than put
    one character for each; what they put is asked of them.
    """

    def __init__(self, path: str, spaces: bool):
        self.tok, self.spaces = tokenizer(path), spaces
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        import numpy as np

        vocab = self.tok.get_vocab()
        # bytes of each token (a character each), or whether it ends a word
        self.parts = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.parts[i] = len(token) if spaces else token.endswith("</w>")
        self.plain = re.compile((" " if spaces else "") + _LETTERS + "+").fullmatch
        normal = self.tok.normalizer.normalize_str if self.tok.normalizer else str
        self.folds = all(normal(c) == normal(c.lower()) for c in map(chr, range(256)))
        word = (" " if spaces else "") + ascii_letters
        seen = self.tok.pre_tokenizer.pre_tokenize_str(normal(word)) if self.tok.pre_tokenizer else []
        self.seen = str.maketrans(word, seen[0][0]) if len(seen) == 1 and len(seen[0][0]) == len(word) else None
        self.table = ChunkTable(self._encode, ID_CHUNKS)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Words of ASCII letters, which are most chunks, are given to the model; other plain words are
        encoded a thousand in a text, as that keeps them apart just as well, and cut by what their tokens stand for."""
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if self.plain(c)]
        if self.seen:
            bare = [i for i in plain if chunks[i].isascii()]
            for i, ids in zip(bare, self._encode_bare([chunks[i] for i in bare]), strict=True):
                out[i] = ids
            plain = [i for i in plain if out[i] is None]
        for k in range(0, len(plain), 1000):
            part = plain[k : k + 1000]
            for i, ids in zip(part, self._encode_joined([chunks[i] for i in part]), strict=True):
                out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._encode_each([chunks[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _encode_bare(self, words: list[str]) -> list[bytes]:
        import numpy as np

        tokenize, ids, ends = self.tok.model.tokenize, [], []
        for w in words:
            ids += [t.id for t in tokenize(w.translate(self.seen))]
            ends.append(4 * len(ids))
        data = np.array(ids, dtype="<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _encode_joined(self, words: list[str]) -> list[bytes]:
        import numpy as np

        text = "".join(words) if self.spaces else " ".join(words)
        ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        sums = np.cumsum(self.parts[ids])
        want = np.cumsum([len(w.encode()) for w in words]) if self.spaces else np.arange(1, len(words) + 1)
        ends = np.searchsorted(sums, want) + 1
        if not len(ids) or sums[-1] != want[-1] or (sums[ends - 1] != want).any():
            return self._encode_each(words)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _encode_each(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        for i in range(0, len(chunks), 20_000):
            found = [array("I", e.ids) for e in encode(chunks[i : i + 20_000], add_special_tokens=False)]
            if sys.byteorder == "big":
                for x in found:
                    x.byteswap()
            out += [x.tobytes() for x in found]
        return out

    def _cut(self, text: str) -> list[str] | None:
        """The chunks of a text; none if it is to be encoded whole."""
        if any(s in text for s in self.special):
            return None
        if self.folds and _is_latin1(text):
            text = text.lower()
        if _is_latin(text):
            return (_LATIN if self.spaces else _LATIN_WORDS).findall(text)
        if ODD_SPACE.search(text):
            return None
        return _SPACED.findall(text) if self.spaces else text.split()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for part in slices(texts):
            cut = list(map(self._cut, part))
            for t, c, vs in zip(part, cut, self.table.values(c or [] for c in cut), strict=True):
                yield self._encode_each([t])[0] if c is None else b"".join(vs)


def id_encoder(path: str, spaces: bool) -> IdEncoder:
    return once(("ids", path, spaces), "encoder", lambda: IdEncoder(path, spaces))
