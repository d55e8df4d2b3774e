"""Byte-level BPE by forced-boundary splitting.

A merge can only ever produce a token of the vocabulary.  Two neighbouring bytes that stand
side by side inside no token can therefore never be joined, whatever stands around them: the
place between them is a certain cut.  A pre-token is split at its certain cuts, each fragment
is encoded by itself, and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Fixed: the split of byte-level BPE vocabularies of this family.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
TWO_BLANKS = regex.compile(r"\s\s")
CACHE = 200_000
LONGEST_CACHED = 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class _Cache(dict):
    """Encodings of recent units; emptied when full, so that memory is bounded."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        made = self.make(unit)
        if len(unit) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = made
        return made


class ForcedBoundaryBpe:
    """Encoder and decoder over a vocabulary file; ids as packed little-endian uint32."""

    def __init__(self, path: str, encode_special_tokens: bool = False) -> None:
        from tokenizers import models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.chars = spec["model"], byte_chars()
        byte_of = {c: b for b, c in enumerate(self.chars)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        self.token: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        self.joined = np.zeros(1 << 16, dtype=bool)
        for t in self.token.values():
            b = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
            self.joined[b[:-1] << 8 | b[1:]] = True
        self.bound = (~self.joined).tobytes()  # by first byte * 256 + second byte: 1 at a certain cut
        self.special = {} if encode_special_tokens else {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.latin = {i: c for i, c in enumerate(self.chars)}
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.token) + 1)]
        self.fragments, self.pretokens, self.head = _Cache(self._fragment), _Cache(self._pretoken), _Cache(self._unit)
        self.tail = _Cache(lambda unit: self._unit(" " + unit))
        self.table = [self.token.get(i, b"") for i in range(max(self.token) + 1)]

    def cuts(self, raw: bytes) -> list[int]:
        """The places of the certain cuts inside raw."""
        bound = self.bound
        return [i for i, (a, b) in enumerate(zip(raw, raw[1:]), 1) if bound[a << 8 | b]]

    def _fragment(self, mapped: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.bpe.tokenize(mapped)])

    def _pretoken(self, piece: str) -> bytes:
        raw = piece.encode()
        mapped, cuts = raw.decode("latin-1").translate(self.latin), self.cuts(raw)
        if not cuts:
            return self._fragment(mapped)
        ends = [*cuts, len(raw)]
        return b"".join(self.fragments[mapped[a:b]] for a, b in zip([0, *cuts], ends))

    def _unit(self, unit: str) -> bytes:
        pretokens = self.pretokens
        return b"".join([pretokens[p] for p in PRETOKEN.findall(unit)])

    def _plain(self, text: str) -> bytes:
        """Where no two blanks meet, every blank starts a pre-token: words can be looked up one by one."""
        if TWO_BLANKS.search(text):
            head = self.head
            return b"".join([head[p] for p in PRETOKEN.findall(text)])
        out, head, tail = [], self.head, self.tail
        newline = head["\n"]
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(newline)
            units = line.split(" ")
            out.append(head[units[0]])
            out.extend([tail[u] for u in units[1:]])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


_loaded: dict[tuple[str, bool], ForcedBoundaryBpe] = {}


def loaded(path: str, encode_special_tokens: bool = False) -> ForcedBoundaryBpe:
    """One encoder for each Python worker."""
    key = (path, encode_special_tokens)
    if key not in _loaded:
        _loaded[key] = ForcedBoundaryBpe(path, encode_special_tokens)
    return _loaded[key]


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", encode_special_tokens: bool = False) -> DataFrame:
    """(key, ids array<int>) of every whole text; a null or empty text has no ids.

    Nothing is shuffled, and repeated rows are encoded each on their own.
    """
    rows = pick(docs, key, text)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, encode_special_tokens)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                ids = [np.frombuffer(bpe.encode(t or ""), dtype="<i4") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=[key, "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null ids decode to an empty text."""
    rows = pick(encoded, key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, text string")


def digests(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", encode_special_tokens: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, decode from the ids, and digest both.

    One narrow pass: the ids never leave the worker.
    """
    rows = pick(docs, key, text)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, encode_special_tokens)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, schema)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, same) whether each text comes back from its ids unchanged."""
    said = digests(docs, path)
    plain = pick(docs, "doc_id", "text").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("plain"))
    return said.join(plain, "doc_id").select("doc_id", (F.col("plain") == F.col("decoded_sha256")).alias("same"))
