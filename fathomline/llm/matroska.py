"""Matroska media columns: bytes stored as 8-bit PCM tracks, and their packet and cue tables.

The writer lays samples out as frames, frames as laced blocks, blocks as clusters, and adds cues. The parser
walks the EBML elements (variable-length ids and sizes, unknown sizes included), splits every lacing, and gives
one packet for each frame: track, timestamp, byte range. Both work on one row's bytes; no shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches

#: Element ids of the Matroska format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C
DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS = 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367
#: Elements that end a cluster of unknown size.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS, SEGMENT, EBML}

#: Payloads are padded to this unit; 8000 samples a second make it 8 ms.
UNIT, RATE, MS = 64, 8000, 1_000_000
#: Samples of a frame, frames of a block, blocks of a cluster (under 32 s, the range of a block's time).
FRAME, LACED, BLOCKS = 512, 8, 60
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
PACKETS = "track int, frame int, timestamp_ns long, position long, size long, keyframe boolean, lacing int, cluster_position long"


def size_code(n: int, width: int = 0) -> bytes:
    """n as an EBML variable-length integer, of the least or the given width."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    """An element: id, size, body."""
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + size_code(len(body)) + body


def number(code: int, n: int) -> bytes:
    """An element that holds an unsigned integer."""
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """What stands between a block's header and its frames' bytes."""
    sizes = [len(f) for f in frames]
    if kind == NO_LACING:
        return b""
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == FIXED:
        return head
    out = head + size_code(sizes[0])
    for before, n in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
        out += size_code(n - before + (1 << 7 * width - 1) - 1, width)
    return out


def pad(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of the unit."""
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def write(payload: bytes, frame: int = FRAME, laced: int = LACED, lacing: int | None = None) -> bytes:
    """A Matroska file with one 8-bit PCM track that holds payload. lacing: a fixed kind, or by the frames' sizes."""
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    frame_ms = frame * 1000 // RATE
    info = element(INFO, number(TIMESTAMP_SCALE, MS) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"fathomline") + element(WRITING_APP, b"fathomline"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, frame_ms * MS) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts, at, cues = [info, element(TRACKS, element(TRACK_ENTRY, track))], 0, []
    at = sum(map(len, parts))
    for c in range(0, len(frames), laced * BLOCKS):
        start, body = c * frame_ms, []
        for b in range(c, min(len(frames), c + laced * BLOCKS), laced):
            group = frames[b : b + laced]
            even = len({len(f) for f in group}) == 1
            kind = NO_LACING if len(group) == 1 else lacing if lacing is not None and (even or lacing != FIXED) else FIXED if even else EBML_LACING
            block = b"\x81" + struct.pack(">hB", b * frame_ms - start, 0x80 | kind << 1) + lace(group, kind) + b"".join(group)
            last = b + laced >= len(frames) and len(frames) > laced
            if last:
                plain = block[:3] + bytes([kind << 1]) + block[4:]
                body.append(element(BLOCK_GROUP, element(BLOCK, plain) + number(BLOCK_DURATION, sum(map(len, group)) * 1000 // RATE)))
            else:
                body.append(element(SIMPLE_BLOCK, block))
        cluster = element(CLUSTER, number(TIMESTAMP, start) + b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    header = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    return header + element(SEGMENT, b"".join(parts))


def vint(buf: bytes, at: int, keep_mark: bool = False) -> tuple[int, int, bool]:
    """A variable-length integer: value, where it ends, whether all its bits are set (unknown size)."""
    first = buf[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(buf):
        raise ValueError(f"no variable-length integer at byte {at}")
    n = int.from_bytes(buf[at : at + width], "big")
    bare = n & (1 << 7 * width) - 1
    return n if keep_mark else bare, at + width, bare == (1 << 7 * width) - 1


def children(buf: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body, end) of each element from at on; an id in stop ends a parent of unknown size."""
    while at < end:
        code, p, _ = vint(buf, at, True)
        if code in stop:
            return
        n, p, unknown = vint(buf, p)
        to = unknown_end(buf, code, p, end) if unknown else min(end, p + n)
        yield code, at, p, to
        at = to


def unknown_end(buf: bytes, code: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: before the next element that cannot be its child."""
    stop = TOP_LEVEL if code == CLUSTER else {SEGMENT, EBML} if code == SEGMENT else set()
    for _, _, _, to in children(buf, at, end, stop):
        at = to
    return at


def uint(buf: bytes, at: int, end: int) -> int:
    """An unsigned integer body."""
    return int.from_bytes(buf[at:end], "big")


def lace_sizes(buf: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The sizes of a block's frames and where the first begins."""
    if kind == NO_LACING:
        return [end - at], at
    count, at = buf[at] + 1, at + 1
    if kind == FIXED:
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == XIPH:
            n = 0
            while buf[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + buf[at], at + 1
        else:
            start = at
            n, at, _ = vint(buf, at)
            if k:
                n += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(n)
    return [*sizes, end - at - sum(sizes)], at


def parse(buf: bytes) -> tuple[list[tuple], list[tuple], dict]:
    """Packets, cues (time in ns, track, position of the cluster in the file) and facts of the file.

    A file cut short or not of this format gives what stands before the fault, and facts["fault"] says what is wrong.
    """
    packets: list[tuple] = []
    cues: list[tuple] = []
    facts: dict = {"scale": MS, "rate": None, "bits": None, "clusters": 0, "fault": None}
    durations: dict[int, int] = {}
    count: dict[int, int] = {}
    base = 0

    def block(at: int, end: int, simple: bool, time: int, cluster: int) -> None:
        track, p, _ = vint(buf, at)
        offset, flags = struct.unpack_from(">hB", buf, p)
        kind = flags >> 1 & 3
        sizes, p = lace_sizes(buf, p + 3, end, kind)
        if min(sizes, default=0) < 0 or p + sum(sizes) > end:
            raise ValueError(f"lacing exceeds its block at byte {at}")
        start = (time + offset) * facts["scale"]
        for k, n in enumerate(sizes):
            packets.append((track, count.get(track, 0), start + k * durations.get(track, 0), p, n, simple and flags >= 128, kind, cluster))
            count[track] = count.get(track, 0) + 1
            p += n

    try:
        for top, _, segment, segment_end in children(buf, 0, len(buf)):
            if top != SEGMENT:
                continue
            base = segment
            for code, start, at, end in children(buf, segment, segment_end):
                if code == INFO:
                    for c, _, p, q in children(buf, at, end):
                        if c == TIMESTAMP_SCALE:
                            facts["scale"] = uint(buf, p, q)
                elif code == TRACKS:
                    for _, _, p, q in children(buf, at, end):
                        entry = {c: (x, y) for c, _, x, y in children(buf, p, q)}
                        if TRACK_NUMBER in entry and DEFAULT_DURATION in entry:
                            durations[uint(buf, *entry[TRACK_NUMBER])] = uint(buf, *entry[DEFAULT_DURATION])
                        for c, _, x, y in children(buf, *entry.get(AUDIO, (0, 0))):
                            if c == SAMPLING_FREQUENCY:
                                facts["rate"] = int(struct.unpack(">d" if y - x == 8 else ">f", buf[x:y])[0])
                            elif c == BIT_DEPTH:
                                facts["bits"] = uint(buf, x, y)
                elif code == CLUSTER:
                    facts["clusters"] += 1
                    time = 0
                    for c, _, p, q in children(buf, at, end):
                        if c == TIMESTAMP:
                            time = uint(buf, p, q)
                        elif c == SIMPLE_BLOCK:
                            block(p, q, True, time, start)
                        elif c == BLOCK_GROUP:
                            for inner, _, x, y in children(buf, p, q):
                                if inner == BLOCK:
                                    block(x, y, False, time, start)
                elif code == CUES:
                    for _, _, p, q in children(buf, at, end):
                        time = 0
                        for c, _, x, y in children(buf, p, q):
                            if c == CUE_TIME:
                                time = uint(buf, x, y)
                            elif c == CUE_TRACK_POSITIONS:
                                where = {d: uint(buf, s, t) for d, _, s, t in children(buf, x, y)}
                                cues.append((time * facts["scale"], where.get(CUE_TRACK, 0), base + where.get(CUE_CLUSTER_POSITION, 0)))
    except (ValueError, IndexError, struct.error) as e:
        facts["fault"] = str(e)
    return packets, cues, facts


def samples(buf: bytes, packets: list[tuple], track: int | None = None) -> bytes:
    """The stored bytes of a track (default: the first), from the packets' byte ranges."""
    track = packets[0][0] if packets and track is None else track
    return b"".join([buf[p : p + n] for t, _, _, p, n, *_ in packets if t == track])


def feature(payload: bytes, packets: list[tuple], cues: list[tuple], facts: dict) -> str:
    """Integer features of what was read back: packets, clusters, cues, length, mean, level, zero crossings, loudest 64 ms."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
    if not len(x):
        return f"packets={len(packets)};clusters={facts['clusters']};cues={len(cues)};ms=0"
    square = x.astype(np.int64) ** 2
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    loudest = int(np.add.reduceat(square, np.arange(0, len(x), FRAME)).max())
    ms = len(x) * 1000 // (facts["rate"] or RATE)
    return f"packets={len(packets)};clusters={facts['clusters']};cues={len(cues)};ms={ms};sum={int(x.sum(dtype=np.int64))};energy={int(square.sum())};crossings={crossings};loudest={loudest}"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary): each text's UTF-8 bytes, padded, as a Matroska file.

    A null text is empty and gives one unit of zeros. Equal texts give equal files. Other columns are left out.
    """
    rows = small_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([write(pad(x)) for x in raw], pa.binary())], names=["id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet: id, track, frame, timestamp_ns, position, size, keyframe, lacing, cluster_position.

    Null, empty or foreign bytes give no packets; a file cut short gives the packets before the cut.
    """
    rows = small_batches(df).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(x or b"")[0] for x in b.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = list(zip(*[p for x in found for p in x], strict=True)) or [[]] * 8
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
            names = [f.split()[0] for f in PACKETS.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *map(pa.array, flat, types)], names=["id", *names])

    return rows.mapInArrow(run, f"id {kind}, {PACKETS}").withColumnRenamed("id", id_col)


def cue_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each cue: id, timestamp_ns, track, cluster_position (from the file's first byte)."""
    rows = small_batches(df).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(x or b"")[1] for x in b.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = list(zip(*[p for x in found for p in x], strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *map(pa.array, flat, [pa.int64(), pa.int32(), pa.int64()])], names=["id", "timestamp_ns", "track", "cluster_position"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, timestamp_ns long, track int, cluster_position long").withColumnRenamed("id", id_col)


def read_back(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """df's columns but the media, with payload binary (the first track's bytes), feature string and fault string.

    The payload is gathered from the packets' byte ranges. Columns of df named payload, feature or fault are replaced.
    """
    carried = [c for c in df.columns if c not in (media_col, "payload", "feature", "fault")]
    rows = small_batches(df).select(F.col(media_col).alias("_media"), F.struct(*carried).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(0).to_pylist():
                packets, cues, facts = parse(x or b"")
                payload = samples(x or b"", packets)
                out.append((payload, feature(payload, packets, cues, facts), facts["fault"]))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["_row", "payload", "feature", "fault"])

    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, payload binary, feature string, fault string").select("_row.*", "payload", "feature", "fault")


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's stored and read-back bytes."""
    media = pack(docs).select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return read_back(media).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
