"""Content-defined payload chunking of media columns.

A text's payload (its UTF-8 bytes, padded with spaces to a positive multiple of 192) is
stored losslessly as 8-bit mono samples in a WAV file.  A rolling gear hash cuts the
file into chunks; Spark joins on chunk digests find which chunks more than one file
has.  The store keeps every distinct chunk once: chunks of one file lie in that file's
pack, shared ones in a chunk table.  A file is rebuilt from its ordered chunk list,
checked against its SHA-256, and decoded again for features.

Only digests are shuffled for all rows.  Bytes are moved for shared chunks and for the
packs of files that have some.  Equal texts are stored and rebuilt once; their features
are stored before they are joined to the rows, so that Spark can split a text that many
rows have.

Null texts count as empty, and empty ones have one unit of spaces.  Whole texts are read,
in slices of about 1 MB, a longer text alone.  Repeated rows each get a row; rows with one
text get equal values.  Of equal chunks the one of the smallest text key and place is
stored.  An empty table gives an empty result.  Further columns are not returned, and
clash with none here.
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

from .runtime import lean, slices, stored
from .wordhash import mix

UNIT = 192
RATE = 8000
HEADER = 44
_GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0x6EA2)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(padded payload, unpadded bytes)."""
    raw = (text or "").encode("utf-8")
    return raw + b" " * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


def to_wav(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this form")
    (n,) = struct.unpack("<I", media[40:44])
    if len(media) != HEADER + n:
        raise ValueError("truncated WAV file")
    return media[HEADER:]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling 32-byte gear hash (modulo 2**32) at every byte, by doubling windows."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(media: bytes, least: int = 512, bits: int = 11, most: int = 8192) -> list[int]:
    """End offsets of the chunks: content-defined, ``least`` to ``most`` bytes, the last may be shorter."""
    candidates = np.flatnonzero(gear_hashes(np.frombuffer(media, dtype=np.uint8)) >> np.uint32(32 - bits) == 0) + 1
    out, start = [], 0
    for end in [*candidates.tolist(), len(media)]:
        while end - start > most:
            start += most
            out.append(start)
        if end - start >= least or (end == len(media) and end > start):
            out.append(end)
            start = end
    return out


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def features(payload: bytes) -> str:
    """Mean, mean square, zero crossings, peak and an eight-bin histogram of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    histogram = ",".join(map(str, np.bincount((x + 128) >> 5, minlength=8).tolist()))
    return f"mean={x.mean():.4f};power={(x * x).mean():.4f};crossings={crossings};peak={int(np.abs(x).max())};histogram={histogram}"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text")):
        seen, out = set(), {"text_key": [], "seq": [], "digest": [], "length": []}
        for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text")):
            if key in seen:
                continue
            seen.add(key)
            for seq, chunk in enumerate(chunks(to_wav(payload_of(text.as_py())[0]))):
                out["text_key"].append(key)
                out["seq"].append(seq)
                out["digest"].append(hashlib.sha256(chunk).digest())
                out["length"].append(len(chunk))
        yield pa.RecordBatch.from_arrays([pa.array(out["text_key"], pa.binary()), pa.array(out["seq"], pa.int32()), pa.array(out["digest"], pa.binary()), pa.array(out["length"], pa.int32())], names=list(out))


_PACKS = pa.schema([("kind", pa.string()), ("text_key", pa.binary()), ("digest", pa.binary()), ("media_sha256", pa.string()), ("n_bytes", pa.int64()), ("n_chunks", pa.int32()), ("seqs", pa.list_(pa.int32())), ("parts", pa.list_(pa.binary()))])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pack with the chunks that only this file has, and a row for each shared chunk that it owns."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        rows = []
        for key, text, shared, owned in zip(*(batch.column(c) for c in ("text_key", "text", "shared", "owned"))):
            payload, n_bytes = payload_of(text.as_py())
            media = to_wav(payload)
            pieces = chunks(media)
            elsewhere, own = set(shared.as_py() or ()), owned.as_py() or ()
            key = key.as_py()
            for seq in own:
                rows.append({"kind": "chunk", "text_key": None, "digest": hashlib.sha256(pieces[seq]).digest(), "parts": [pieces[seq]]})
            kept = [i for i in range(len(pieces)) if i not in elsewhere]
            rows.append({"kind": "part" if elsewhere else "whole", "text_key": key, "media_sha256": hashlib.sha256(media).hexdigest(), "n_bytes": n_bytes, "n_chunks": len(pieces), "seqs": kept, "parts": [pieces[i] for i in kept]})
        yield pa.RecordBatch.from_pylist(rows, schema=_PACKS)


_READ = pa.schema([("text_key", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_chunks", pa.int32()), ("feature", pa.string())])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the ordered chunks together, verifies the file and decodes it."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            found = dict(zip(row["seqs"], row["parts"]))
            found.update((x["seq"], x["part"]) for x in row.get("others") or ())
            media = b"".join(found[k] for k in range(row["n_chunks"]))
            if hashlib.sha256(media).hexdigest() != row["media_sha256"]:
                raise ValueError("a rebuilt file differs from the stored one")
            payload = from_wav(media)
            rows.append({"text_key": row["text_key"], "n_bytes": row["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": row["media_sha256"], "n_chunks": row["n_chunks"], "feature": features(payload)})
        yield pa.RecordBatch.from_pylist(rows, schema=_READ)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.binary(): "binary", pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int32()): "array<int>", pa.list_(pa.binary()): "array<binary>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def store_media(df: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, deduplicates and stores a text column.

    Returns (rows: key and text_key, packs and chunks: the stored table, lists: where
    shared chunks belong).  ``broadcast_rows`` bounds the plan rows that are broadcast
    to the scan; more are joined by a shuffle.
    """
    docs = df.select(F.col(key).alias("key"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("text_key"), F.col(text).alias("text"))
    index = stored(docs.select("text_key", "text").mapInArrow(lean(_index), "text_key binary, seq int, digest binary, length int").dropDuplicates(["text_key", "seq"]), "media-index")
    rows = docs.select("key", "text_key")
    first = rows.groupBy("text_key").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    owner = index.groupBy("digest").agg(F.count("*").alias("uses"), F.min(F.struct("text_key", "seq")).alias("owner")).where("uses > 1").drop("uses")
    lists = stored(index.join(owner, "digest").select("text_key", "seq", "digest", ((F.col("owner.text_key") == F.col("text_key")) & (F.col("owner.seq") == F.col("seq"))).alias("owned")), "media-lists")
    per_text = lists.groupBy("text_key").agg(F.collect_set("seq").alias("shared"), F.collect_set(F.when(F.col("owned"), F.col("seq"))).alias("owned"))
    plan = stored(first.where("copies > 1").join(per_text, "text_key", "full").select("text_key", "first", F.coalesce("copies", F.lit(1)).alias("copies"), "shared", "owned"), "media-plan")
    small = plan.count() <= broadcast_rows
    planned = docs.join(F.broadcast(plan) if small else plan, "text_key", "left")
    once = planned.where(F.col("copies").isNull() | (F.col("copies") == 1) | F.col("key").eqNullSafe(F.col("first")))
    packs = stored(once.select("text_key", "text", "shared", "owned").mapInArrow(lean(_store), _ddl(_PACKS)), "media-packs", partition_by="kind")
    return rows, packs, lists


def read_media(packs: DataFrame, lists: DataFrame) -> DataFrame:
    """Rebuilds, verifies and describes every stored file: a row for each text_key."""
    names = ["text_key", "media_sha256", "n_bytes", "n_chunks", "seqs", "parts"]
    whole = packs.where("kind = 'whole'").select(*names).mapInArrow(lean(_rebuild), _ddl(_READ))
    shared = packs.where("kind = 'chunk'").select("digest", F.col("parts")[0].alias("part")).dropDuplicates(["digest"])
    others = lists.join(shared, "digest").groupBy("text_key").agg(F.collect_list(F.struct("seq", "part")).alias("others"))
    part = packs.where("kind = 'part'").select(*names).join(others, "text_key").mapInArrow(lean(_rebuild), _ddl(_READ))
    return whole.unionByName(part).dropDuplicates(["text_key"])


def media_features(df: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """Stores every text as media, reads it back and returns a row of digests and features for each input row."""
    rows, packs, lists = store_media(df, key, text, broadcast_rows)
    read = stored(read_media(packs, lists), "media-read")
    return rows.withColumnRenamed("key", key).join(read, "text_key").drop("text_key")
