"""Media columns by content-defined payload chunking.

A payload is kept losslessly as 8-bit mono samples in a WAV file.  A rolling gear hash over
the file's bytes sets the cuts, so equal passages give equal chunks wherever they stand.

Store.  A first pass over the texts gives only chunk digests; those that occur more than once
set bits of a bitmap sized by their number.  A second pass writes the chunks whose digest is in the
bitmap to the shared chunk table, deduplicated by digest, and a third one writes a pack for
each document: its manifest (the ordered chunk list) with the bytes of its unshared chunks.
Every unshared chunk lies beside its manifest, so only shared bytes are ever shuffled.

Reading.  A file without shared chunks is put together from its pack alone.  For the others,
each distinct file once, the shared chunks are joined by digest and the ordered list is put
together.  Every file is held against its digest before anything is computed from it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, pick, stored
from .textscan import mix

UNIT = 64
RATE = 8000
LEAST, MOST = 256, 8192
_MASK = np.uint32(0xFFC00000)  # ten bits: a cut about every kilobyte
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
#: Of the bitmap that every Python worker holds: for a shared chunk, and in all (32 MB).
BITS_EACH, MOST_BITS = 128, 1 << 28
ROWS, PART_BYTES = 256, 4 << 20  # of a batch that are worked on at once


def payload(text: str | None) -> tuple[bytes, int]:
    """(payload, bytes before padding): UTF-8 with bytes 0 up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def to_wav(samples: bytes) -> bytes:
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples)) + head + samples


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[20:24] != struct.pack("<HH", 1, 1) or media[34:36] != struct.pack("<H", 8):
        raise ValueError("not a file of 8-bit mono samples")
    (n,) = struct.unpack("<I", media[40:44])
    if media[36:40] != b"data" or len(media) != 44 + n:
        raise ValueError("the data chunk doesn't fill the file")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data, the last one its length; chunks have LEAST to MOST bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):  # the hash of the last 32 bytes, doubling the reach each time
        rolled = h.copy()
        rolled[step:] += h[:-step] << np.uint32(step)
        h = rolled
    ends, last = [], 0
    for at in (np.flatnonzero((h & _MASK) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _place(d: bytes) -> int:
    """A long from a digest, the bitmap's key."""
    return int.from_bytes(d[:8], "little", signed=True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches, of ROWS rows and, on average, PART_BYTES at most."""
    for batch in batches:
        rows = max(1, min(ROWS, len(batch) * PART_BYTES // max(1, batch.nbytes)))
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def _shared_digests(texts: DataFrame, bits: int | None) -> Bitmap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [_place(digest(c)) for t in part.column(0) for c in chunks(to_wav(payload(t.as_py())[0]))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["place"])

    places = texts.mapInArrow(run, "place bigint").groupBy("place").agg(F.count("*").alias("n"))
    return Bitmap(stored(places.where("n > 1").select("place")), "place", bits, hashed=False, each=BITS_EACH, most=MOST_BITS)


PACK = (
    "n_bytes bigint, media_bytes bigint, media_sha256 string, n_chunks bigint, "
    "own_at array<int>, own array<binary>, shared_at array<int>, shared array<binary>"
)


def _packs(rows: DataFrame, words, bits: int) -> DataFrame:
    """(id, PACK): each document's manifest and the bytes of its unshared chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = words.value
        for part in _parts(batches):
            out: list[list] = [[] for _ in range(8)]
            for t in part.column(1):
                raw, n = payload(t.as_py())
                media = to_wav(raw)
                found = chunks(media)
                digests = [digest(c) for c in found]
                is_shared = _in(bitmap, bits, digests)
                own = [i for i, s in enumerate(is_shared) if not s]
                shared = [i for i, s in enumerate(is_shared) if s]
                for column, value in zip(out, (n, len(media), hashlib.sha256(media).hexdigest(), len(found), own, [found[i] for i in own], shared, [digests[i] for i in shared])):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, types))], names=["id", *(x.split()[0] for x in PACK.split(", "))])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {PACK}")


def _in(words: np.ndarray, bits: int, digests: list[bytes]) -> list[bool]:
    at = np.array([_place(d) for d in digests], dtype=np.int64) % bits
    return ((words[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).tolist()


def _chunk_table(texts: DataFrame, words, bits: int) -> DataFrame:
    """(digest, bytes) of every shared chunk, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = words.value
        for part in _parts(batches):
            found: dict[bytes, bytes] = {}
            for t in part.column(0):
                own = chunks(to_wav(payload(t.as_py())[0]))
                digests = [digest(c) for c in own]
                found |= {d: c for d, c, s in zip(digests, own, _in(bitmap, bits, digests)) if s}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "bytes"])

    return texts.mapInArrow(run, "digest binary, bytes binary").dropDuplicates(["digest"])


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, read_bytes bigint, read_sha256 string, feature string"


def features(media: bytes, said: str) -> tuple:
    """What is computed from a file's bytes as read back; `said` is its digest in the manifest."""
    sha = hashlib.sha256(media).hexdigest()
    if sha != said:
        raise ValueError(f"a file put together from its chunks has digest {sha}, its manifest says {said}")
    raw = from_wav(media)
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    feature = f"sum={int(x.sum())};min={int(x.min())};max={int(x.max())};energy={int(((x - 128) ** 2).sum())};crossings={crossings}"
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(media), sha, feature


def _feature_batch(heads: list[pa.Array], names: list[str], files: list[tuple[bytes, str]]) -> pa.RecordBatch:
    columns = list(zip(*(features(m, said) for m, said in files))) or [()] * 6
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([*heads, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*names, *(x.split()[0] for x in FEATURES.split(", "))])


def _whole(packs: DataFrame, key_type: str) -> DataFrame:
    """Features of the files whose chunks all lie in their pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            files = [(b"".join(own), said) for said, own in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
            yield _feature_batch([part.column(0), part.column(1), part.column(2)], ["id", "n_bytes", "n_chunks"], files)

    rows = packs.select("id", "n_bytes", "n_chunks", "media_sha256", "own")
    return rows.mapInArrow(run, f"id {key_type}, n_bytes bigint, n_chunks bigint, {FEATURES}")


def _joined(packs: DataFrame, table: DataFrame) -> DataFrame:
    """Features of the distinct files that hold shared chunks, by media_sha256."""
    once = packs.dropDuplicates(["media_sha256"])
    own = once.select("media_sha256", F.explode(F.arrays_zip("own_at", "own")).alias("c")).select("media_sha256", F.col("c.own_at").alias("at"), F.col("c.own").alias("bytes"))
    asked = once.select("media_sha256", F.explode(F.arrays_zip("shared_at", "shared")).alias("c")).select("media_sha256", F.col("c.shared_at").alias("at"), F.col("c.shared").alias("digest"))
    fetched = asked.join(table, "digest").select("media_sha256", "at", "bytes")
    ordered = own.unionByName(fetched).repartition("media_sha256").sortWithinPartitions("media_sha256", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in _parts(batches):
            done = []
            for said, chunk in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if said != now:
                    if now is not None:
                        done.append((b"".join(parts), now))
                    now, parts = said, []
                parts.append(chunk)
            yield _feature_batch([], [], done)
        if now is not None:
            yield _feature_batch([], [], [(b"".join(parts), now)])

    return ordered.mapInArrow(run, FEATURES)


def media_columns(docs: DataFrame, *, bits: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, n_chunks, n_shared_chunks) of every whole text, computed from the bytes read back.

    A null text is an empty one, whose payload is UNIT bytes 0.  Equal texts give equal values;
    repeated rows and null keys stay; other columns are not read; an empty table gives no rows.
    A chunk that the bitmap lets through by chance is stored as a shared one, so its size only
    decides how much is shuffled.  It has BITS_EACH bits a shared chunk up to MOST_BITS, that is
    two million shared chunks; beyond, more and more unshared chunks go through the join, at 128
    times as many two of three.
    """
    rows = pick(docs, key, text).select(F.col(key).alias("id"), F.col(text).alias("text"))
    key_type = dict(rows.dtypes)["id"]
    texts = rows.select("text")
    bitmap = _shared_digests(texts, bits)
    words = rows.sparkSession.sparkContext.broadcast(bitmap.dense())
    table = stored(_chunk_table(texts, words, bitmap.bits))
    packs = stored(_packs(rows, words, bitmap.bits))
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "read_bytes", "read_sha256", "feature"]
    whole = _whole(packs.where(F.size("shared") == 0), key_type).withColumn("n_shared", F.lit(0).cast("long"))
    partial = packs.where(F.size("shared") > 0)
    built = _joined(partial, table)
    heads = partial.select("id", "n_bytes", "n_chunks", "media_sha256", F.size("shared").cast("long").alias("n_shared"))
    joined = heads.join(built, heads["media_sha256"] == built["read_sha256"]).select("id", "n_bytes", "n_chunks", *names, "n_shared")
    out = whole.select("id", "n_bytes", "n_chunks", *names, "n_shared").unionByName(joined)
    return out.select(
        F.col("id").alias(key), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("read_bytes").alias("media_bytes"), F.col("read_sha256").alias("media_sha256"), "feature", "n_chunks", F.col("n_shared").alias("n_shared_chunks")
    )
