"""Operator 2: media columns in FLAC.

``encode_flac`` turns a column of bytes into streams of 8-bit samples, ``decode_flac`` turns streams into PCM
blocks with sample and byte offsets (Rice residuals, linear predictors, frame checksums verified),
``pcm_features`` digests the samples of those blocks, and ``round_trip`` stores the streams in between.  A frame has the smaller in bits of the
best fixed predictor and a linear predictor of order ORDER.

Defined cases: null bytes are empty; a payload is the bytes and zero bytes up to a positive multiple of 64;
a broken stream gives ok = false with the error and the blocks before it, and null digests of its samples; equal bytes give equal
streams; an empty table gives an empty result; other columns are not carried unless named, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.llm import flac
from latentia.llm.common import Scratch, cut, slices

UNIT = 64
BYTES = 2 << 20
ORDER = 8
#: Coded text takes 1.6 times its Parquet files; each pass stores, reads and deletes the streams of its share of the ids.
PASSES = 2
#: Text is even enough for one Rice parameter a frame.
PARTS_LOG = 0
BLOCKS = "array<struct<sample_offset:long,byte_offset:long,n_samples:int,pcm:binary>>"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks int, ok boolean, error string"


def payload(data: bytes) -> bytes:
    return data + bytes(UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def as_samples(data: bytes) -> np.ndarray:
    """Bytes as signed 8-bit samples around 128."""
    return np.frombuffer(data, np.uint8).astype(np.int64) - 128


def as_bytes(samples: np.ndarray) -> bytes:
    return (samples + 128).astype(np.uint8).tobytes()


def encode_flac(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text", lpc: int = ORDER) -> DataFrame:
    """doc_id, n_bytes (before padding), media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "data", BYTES):
                raw = [d or b"" for d in batch.column("data").to_pylist()]
                media = [flac.encode(as_samples(payload(d)), lpc=lpc, parts_log=PARTS_LOG) for d in raw]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(d) for d in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(data_col).cast("binary").alias("data"))
    return data.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_flac(media: DataFrame, from_sample: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns carried along, ok, error, blocks: PCM (signed samples, one byte each up to 8 bits, else two) with offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", BYTES):
                streams = [data or b"" for data in batch.column("media").to_pylist()]
                errors, rows = [], []
                for data, (blocks, error) in zip(streams, flac.decode_many(streams, from_sample), strict=True):
                    wide = bool(blocks) and flac.read_info(data).bps > 8
                    rows.append([{"sample_offset": b.sample_offset, "byte_offset": b.byte_offset, "n_samples": len(b.samples), "pcm": b.samples.astype("<i2" if wide else np.int8).tobytes()} for b in blocks])
                    errors.append(error)
                kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *carry)], pa.array([e is None for e in errors]), pa.array(errors, pa.string()), pa.array(rows, kind)], names=["doc_id", *carry, "ok", "error", "blocks"])

    rows = media.select("doc_id", *carry, "media")
    carried = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in carry)
    return rows.mapInArrow(run, f"doc_id long, {carried}ok boolean, error string, blocks {BLOCKS}")


def feature(x: np.ndarray) -> str:
    """Whole numbers only, so equal samples give equal text: count, peak, energy, sign changes, sum of steps."""
    return f"n={len(x)};peak={int(np.abs(x).max())};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};steps={int(np.abs(np.diff(x)).sum())}"


def pcm_features(media: DataFrame) -> DataFrame:
    """Read streams of 8-bit samples (doc_id, n_bytes, media) back as PCM blocks; digests and features come from those."""
    seen = media.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    carry = ("n_bytes", "media_bytes", "media_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            blocks, starts = batch.column("blocks"), batch.column("blocks").offsets.to_numpy()
            pcm = blocks.values.field("pcm")
            for i, ok in enumerate(batch.column("ok").to_pylist()):
                n = int(starts[i + 1] - starts[i])
                if not ok:
                    out.append((None, None, None, None, n))
                    continue
                x = np.frombuffer(b"".join(pcm.slice(starts[i], n).to_pylist()), np.int8).astype(np.int64)
                read = as_bytes(x)
                out.append((len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-UNIT:]), feature(x), n))
            kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string(), "n_blocks": pa.int32()}
            own = {c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(kinds.items())}
            names = [c.split()[0] for c in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names=names)

    return decode_flac(seen, carry=carry).mapInArrow(run, DIGEST)


def round_trip(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """pcm_features of every text, from streams stored in the shared folder; a pass's streams are deleted once its digests are stored."""
    parts = []
    for i in range(passes):
        own = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(passes)) == i)
        with Scratch(docs.sparkSession, "flac") as store:
            parts.append(cut(pcm_features(store.cut(encode_flac(own)))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
