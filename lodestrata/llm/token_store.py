"""Token ids as fixed-width packed binary segments with random access.

A segment is a self-contained byte string, little endian:

    header    magic "LSTK", version u16, bits u16, docs u64, ids u64, ids per block u64
    documents (docs + 1) x u64: where each document's ids start, and the end
    blocks    (blocks + 1) x u64: byte offset of each block in the payload, and the end
    payload   blocks of 4096 ids, each id in ``bits`` bits; 64 ids fill exactly ``bits`` u64 words

Any block unpacks alone with 64 vectorised shifts, so a slice of ids costs its own blocks only.
Segments are written as the binary column of a Parquet container: Spark's commit protocol makes the
write atomic, it works on any store, and ``part``, ``seq``, ``docs`` and ``ids`` can be read without
the payload.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, by_document, lean, only, running_total, Scratch

MAGIC, VERSION, BLOCK = b"LSTK", 1, 4096
_HEAD = struct.Struct("<4sHHQQQ")
SEGMENT_IDS = 1 << 20
CONTAINER = "part int, seq int, docs long, ids long, doc_ids binary, known binary, segment binary"
ROWS = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"


def min_bits(vocab: int) -> int:
    """The fewest bits that hold every id below ``vocab``."""
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """``ids`` as u64 words, ``bits`` words for each 64 ids; the last group is filled with zeros."""
    rows = np.zeros((-(-len(ids) // 64), 64), "<u8")
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    rows = words.reshape(-1, bits)
    out = np.empty((len(rows), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | rows[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


def write_segment(docs: list[np.ndarray], bits: int) -> bytes:
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    payload = pack(ids, bits).tobytes()
    step = BLOCK // 64 * bits * 8
    blocks = np.minimum(np.arange(-(-len(ids) // BLOCK) + 1, dtype="<u8") * step, len(payload)).astype("<u8")
    return _HEAD.pack(MAGIC, VERSION, bits, len(docs), len(ids), BLOCK) + starts.tobytes() + blocks.tobytes() + payload


class Segment:
    """Random access to a segment's documents and ids; over a mapped file only the pages of what is asked for are read."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.docs, self.ids, block = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION or block != BLOCK:
            raise ValueError("not a token segment of this version")
        at, n_blocks = _HEAD.size, -(-self.ids // BLOCK)
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, at)
        at += 8 * (self.docs + 1)
        self.blocks = np.frombuffer(data, "<u8", n_blocks + 1, at)
        self.data, self.at = data, at + 8 * (n_blocks + 1)

    @classmethod
    def open(cls, path: str) -> Segment:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi, unpacking only the blocks that hold them."""
        if hi <= lo:
            return np.zeros(0, "<u4")
        a, b = lo // BLOCK, -(-hi // BLOCK)
        begin, end = int(self.blocks[a]), int(self.blocks[b])
        words = np.frombuffer(self.data, "<u8", (end - begin) // 8, self.at + begin)
        return unpack(words, self.bits, hi - a * BLOCK)[lo - a * BLOCK :]

    def doc(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


#: ASCII punctuation that never shares a pre-token with a letter before it; the apostrophe can.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS = re.compile("[\u0300-\u036f]")


class WordEncoder:
    """Encodes texts by way of their white-space-delimited pieces, keeping the ids of pieces met before.

    Only for tokenizers that lower-case, drop white space and never let a token or a normalisation cross
    it. There the ids of a text are the ids of its pieces in order, whatever the case of A-Z (where no
    combining mark follows that could compose with one case only, and no added token, which is met in its
    own case only, is spelt in any case). Texts are cut at U+0009-000D and U+0020. New words of letters alone are encoded as one text and told apart by the tokens that end a
    word; letters with ASCII punctuation after them are those letters and that punctuation, which are
    kept apart and, joined, for as long as there are ``most`` of them. Two generations of ``most`` pieces bound the memory.
    """

    _held: dict[str, WordEncoder] = {}

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocab = self.tokenizer.get_vocab()
        self.vocab = max(vocab.values()) + 1
        self.kind = "<u2" if self.vocab <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.ends = np.zeros(self.vocab, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.added = sorted({t.content.encode().lower().decode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.signed: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each Python worker and file, so pieces stay known between tasks."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _slowly(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _words(self, some: list[str]) -> list[bytes]:
        """Ids of words of letters; the slow way if some word isn't one pre-token after normalisation."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(some) or ends[-1] != len(ids):
            return self._slowly(some)
        data, at = ids.tobytes(), (ends * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *at], at, strict=False)]

    def _learn(self, pieces: list[str]) -> None:
        words, odd = [], []
        for w in pieces:
            (words if w.isalpha() else odd).append(w)
        for group, how in ((words, self._words), (odd, self._slowly)):
            for i in range(0, len(group), 1000):
                some = group[i : i + 1000]
                self.new.update(zip(some, how(some), strict=True))

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        if len(self.signed) > self.most:
            self.signed = {}
        signed = self.signed
        found = [new.get(p) or signed.get(p) for p in pieces] if signed else list(map(new.get, pieces))
        open_ = [i for i, f in enumerate(found) if f is None]
        cut, need = {}, set()
        for i in open_:
            w = pieces[i]
            stem = w.rstrip(SIGNS)
            if stem is not w and stem.isalpha() and len(stem[-1].lower()) == 1:
                cut[i] = stem, w[len(stem) :]
                need.update(cut[i])
            else:
                need.add(w)
        need = [w for w in need if w not in new]
        if old:
            new.update((w, old[w]) for w in need if w in old)
            need = [w for w in need if w not in new]
        self._learn(need)
        for i in open_:
            if i in cut:
                found[i] = signed[pieces[i]] = new[cut[i][0]] + new[cut[i][1]]
            else:
                found[i] = new[pieces[i]]
        return found

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the distinct pieces in a row, their lengths, each piece's number, where texts' pieces begin and end."""
        raw, cased = pa.array(texts, pa.large_string()), pa.array([not t.isascii() and _MARKS.search(t) is not None for t in texts], pa.bool_())
        low = pc.ascii_lower(raw)
        for t in self.added:
            cased = pc.or_(cased, pc.match_substring(low, t))
        if pc.any(cased).as_py():
            low = pc.if_else(cased, raw, low)
        lists = pc.ascii_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        found = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), "i8", len(found)) // self.width
        return np.frombuffer(b"".join(found), self.kind), sizes, coded.indices.to_numpy(), lists.offsets.to_numpy()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        flat, sizes, at, ends = self._parts(texts)
        n = sizes[at]
        stop = np.cumsum(n)
        small = np.int32 if max(len(flat), int(stop[-1]) if len(stop) else 0) < 1 << 31 else np.int64
        shift = ((np.cumsum(sizes) - sizes)[at] - (stop - n)).astype(small)
        ids = flat[np.repeat(shift, n) + np.arange(n.sum(), dtype=small)]
        return np.split(ids, np.concatenate([[0], stop])[ends[1:-1]])

    def count(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        _, sizes, at, ends = self._parts(texts)
        return np.diff(np.concatenate([[0], np.cumsum(sizes[at])])[ends]).tolist()


def _rows(it: Iterator[pa.RecordBatch], *names: str):
    """Rows one by one: a cell of a chunk table is megabytes, and is copied only when its row's turn comes."""
    for b in it:
        columns = [b.column(n) for n in names]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def store(docs: DataFrame, tokenizer: str, end_id: int | None, scratch: Scratch) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes the segments in ascending doc_id order; returns the container.

    Null texts are empty; null doc_ids come last; rows of one doc_id are ordered as ``by_document`` says. The range
    exchange deals documents, not keys' groups, so no source, copy group or repeated id matters to it.
    """

    def encode(it):
        encoder, seq = WordEncoder.of(tokenizer), 0
        bits, part = min_bits(encoder.vocab), TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], encoder.kind)
        held, keys, size = [], [], 0

        def out():
            return pa.record_batch([[part], [seq], [len(held)], [size], [np.array([k or 0 for k in keys], "<i8").tobytes()], [np.array([k is not None for k in keys], "u1").tobytes()], [write_segment(held, bits)]], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("doc_ids", pa.binary()), ("known", pa.binary()), ("segment", pa.binary())]))

        for some in batches(_rows(it, "doc_id", "text"), 1 << 23, lambda r: len(r[1] or "") + 64):
            for (key, _), ids in zip(some, encoder.encode([t or "" for _, t in some]), strict=True):
                held.append(np.concatenate([ids, tail]))
                keys.append(key)
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    yield out()
                    held, keys, size, seq = [], [], 0, seq + 1
        if held:
            yield out()

    sorted_docs = only(docs, "doc_id", "text").repartitionByRange(*by_document()).sortWithinPartitions(*by_document())
    return scratch.write(sorted_docs.mapInArrow(lean(encode), CONTAINER))


def read_back(container: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(it):
        for part, seq, keys, known, data in _rows(it, "part", "seq", "doc_ids", "known", "segment"):
            s = Segment(data)
            ids, starts = s.slice(0, s.ids), s.starts.astype("i8")
            view = memoryview(ids.tobytes())
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            n = s.docs
            doc_ids = pa.array(np.frombuffer(keys, "<i8"), mask=np.frombuffer(known, "u1") == 0)
            yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), doc_ids, pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    parts = running_total(container.groupBy("part").agg(F.sum("ids").alias("all")), ["part"], "all", "before")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = container.select("part", "seq", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("inside")).join(parts.select("part", "before"), "part")
    base = base.select("part", "seq", (F.col("inside") + F.col("before")).alias("base"))
    rows = container.select("part", "seq", "doc_ids", "known", "segment").mapInArrow(lean(decode), ROWS)
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def export(container: DataFrame, target: str) -> DataFrame:
    """Writes the segments as plain files ``part-seq.lstk`` under a folder that every executor mounts; (file, docs, ids, bytes) of each.

    The executors write, each segment under a name of its own that is then put in place, so a task that
    runs again does no harm. The files are written before this returns; ``Segment.open`` reads them.
    """

    def write(it):
        for part, seq, docs, ids, data in _rows(it, "part", "seq", "docs", "ids", "segment"):
            name = f"{part:06d}-{seq:06d}.lstk"
            own = f"{target}/.{name}.{uuid.uuid4().hex}"
            with open(own, "xb") as f:
                f.write(data)
            os.replace(own, f"{target}/{name}")
            yield pa.record_batch([[name], [docs], [ids], [len(data)]], names=["file", "docs", "ids", "bytes"])

    os.makedirs(target, exist_ok=True)
    written = container.select("part", "seq", "docs", "ids", "segment").mapInArrow(lean(write), "file string, docs long, ids long, bytes long").toArrow()  # a row a segment
    return container.sparkSession.createDataFrame(written)
