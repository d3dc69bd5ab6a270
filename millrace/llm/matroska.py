"""Matroska columns: payloads as audio files, and files as packet tables.

``mux`` stores bytes as 8-bit PCM frames in clusters of blocks under all four lacing modes, with cues.
``packets`` parses any such file: variable-length ids and sizes (unknown sizes too), clusters, simple blocks and
block groups, Xiph, EBML and fixed-size lacing, and cues, into one row per frame with its track, timestamp and
byte range. Files are parsed on their own, so a table of any size is one narrow pass.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_chunks

#: Element ids of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIMESTAMP_SCALE = 0xE7, 0xA3, 0xA0, 0xA1, 0x2AD7B1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x23E383, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK_ENTRY, INFO, CUES, CUE_POINT, CUE_POSITIONS, AUDIO}
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME = 576
PER_CLUSTER = 64
DEEPEST = 32
RATE_HZ = 48_000.0


def vint(n: int, width: int = 0) -> bytes:
    """A size: the leading one's place in the first byte gives the length in bytes."""
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed(n: int) -> bytes:
    """A difference of sizes, biased to the middle of its range."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << (7 * w - 1)) - 1)
    return vint(n + (1 << (7 * width - 1)) - 1, width)


def _block(track: int, offset: int, frames: list[bytes], lacing: int) -> bytes:
    lacing = lacing if len(frames) > 1 else 0  # readers differ on a lace of one frame
    head = vint(track) + struct.pack(">hB", offset, 0x80 | lacing << 1)
    if not lacing:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += vint(sizes[0]) + b"".join(_signed(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + b"".join(frames)


def pad(payload: bytes, unit: int = FRAME) -> bytes:
    """Bytes 255 up to a positive multiple of ``unit``."""
    return payload + b"\xff" * (-len(payload) % unit if payload else unit)


def mux(payload: bytes) -> bytes:
    """A Matroska audio file whose frames, one after another, are ``payload`` (a multiple of 576 bytes)."""
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    duration = _uint(DEFAULT_DURATION, round(1e9 * FRAME / RATE_HZ))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + duration + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    head = info + element(TRACKS, element(TRACK_ENTRY, entry))
    step = 1000 * FRAME / RATE_HZ
    clusters, at, cues = [], len(head), []
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    for c in range(0, len(frames), PER_CLUSTER):
        body = [_uint(TIMESTAMP, round(c * step))]
        i, lacing, end = c, 0, min(c + PER_CLUSTER, len(frames))
        while i < end:
            laced = frames[i : min(end, i + (1 if not lacing else 4))]
            block = _block(1, round(i * step) - round(c * step), laced, lacing)
            body.append(element(BLOCK_GROUP, element(BLOCK, block)) if lacing == 1 else element(SIMPLE_BLOCK, block))
            i += len(laced)
            lacing = (lacing + 1) % 4
        cluster = element(CLUSTER, b"".join(body))
        where = _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at)
        cues.append(element(CUE_POINT, _uint(CUE_TIME, round(c * step)) + element(CUE_POSITIONS, where)))
        clusters.append(cluster)
        at += len(cluster)
    header = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ, 2))
    return header + element(SEGMENT, head + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Parsed:
    """Frames as (track, timestamp in ns, block, lacing, keyframe, offset, length, cued), tracks by codec and frame duration, cue points.

    Frames of a lace follow one another by the track's default duration; where a file names none they share the block's time.
    """

    packets: list[tuple[int, int, int, int, bool, int, int, bool]] = field(default_factory=list)
    codecs: dict[int, str] = field(default_factory=dict)
    durations: dict[int, int] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    error: str | None = None


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """Value and next place; ``keep``: the marker stays, as in ids. -1 for an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("bad variable-length number")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep:
        n &= (1 << 7 * width) - 1
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, at + width


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    track, at = _vint(data, at, False)
    offset, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, offset, flags, lacing, [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        sizes = [(end - at) // count] * (count - 1)
    for k in range(count - 1 if lacing != 2 else 0):
        if lacing == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
        else:
            before = at
            n, at = _vint(data, at, False)
            sizes.append(n if not k else sizes[-1] + n - (1 << (7 * (at - before) - 1)) + 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed the block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, offset, flags, lacing, out


def parse(data: bytes) -> Parsed:
    """All frames of a file in file order. Damaged or cut-off files give what could be read, and ``error``."""
    out = Parsed()
    state: dict = {"scale": 1_000_000, "cluster": 0, "base": 0, "block": 0, "place": 0}
    try:
        _walk(data, out, state)
    except (ValueError, IndexError, struct.error) as e:
        out.error = str(e) or type(e).__name__
    places = {(t, p) for _, t, p in out.cues}
    seen: set[tuple[int, int]] = set()
    for i, (track, ts, block, lacing, key, offset, length, cluster) in enumerate(out.packets):
        first = (track, cluster) not in seen
        seen.add((track, cluster))
        out.packets[i] = (track, ts, block, lacing, key, offset, length, first and (track, cluster) in places)
    return out


def _open(ident: int, begin: int, at: int, out: Parsed, state: dict) -> None:
    if ident == SEGMENT:
        state["base"] = at
    elif ident == CLUSTER:
        state["place"] = begin - state["base"]
        out.clusters.append(begin)
    elif ident in (TRACK_ENTRY, CUE_POINT):
        state["entry"], state["positions"] = {}, []
    elif ident == CUE_POSITIONS:
        state.setdefault("positions", []).append({})


def _close(ident: int, out: Parsed, state: dict) -> None:
    """Entries count once they are whole, so their fields may stand in any order."""
    if ident == TRACK_ENTRY:
        entry = state["entry"]
        track = entry.get(TRACK_NUMBER, 0)
        if CODEC_ID in entry:
            out.codecs[track] = entry[CODEC_ID]
        if DEFAULT_DURATION in entry:
            out.durations[track] = entry[DEFAULT_DURATION]
    elif ident == CUE_POINT:
        time = state["entry"].get(CUE_TIME, 0)
        out.cues += [(time, p.get(CUE_TRACK, 0), p.get(CUE_CLUSTER, 0)) for p in state["positions"]]


def _walk(data: bytes, out: Parsed, state: dict) -> None:
    """All elements in order. Open ones are kept on a stack, ``DEEPEST`` at most; files of the format nest no deeper than 8."""
    parents: list[tuple[int, int]] = []  # (element, end)
    at, end = 0, len(data)
    while True:
        while parents and at >= parents[-1][1]:
            _close(parents.pop()[0], out, state)
        if parents:
            end = parents[-1][1]
        elif at >= len(data):
            return
        else:
            end = len(data)
        begin = at
        ident, at = _vint(data, at, True)
        size, at = _vint(data, at, False)
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError("an element exceeds its parent")
        if ident in MASTERS:
            if size < 0 and ident == CLUSTER:
                stop = _cluster_end(data, at, end)
            if len(parents) >= DEEPEST:
                raise ValueError("elements nest too deep")
            _open(ident, begin, at, out, state)
            parents.append((ident, stop))
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            track, offset, flags, lacing, frames = _frames(data, at, stop)
            ts = (state["cluster"] + offset) * state["scale"]
            key = bool(flags & 0x80) if ident == SIMPLE_BLOCK else True
            # a block's time is that of its first frame; the others follow by the track's frame duration
            step = out.durations.get(track, 0)
            for k, (a, n) in enumerate(frames):
                out.packets.append((track, ts + k * step, state["block"], lacing, key, a, n, state["place"]))
            state["block"] += 1
        elif ident == TIMESTAMP:
            state["cluster"] = int.from_bytes(data[at:stop], "big")
        elif ident == TIMESTAMP_SCALE:
            state["scale"] = int.from_bytes(data[at:stop], "big")
        elif ident in (TRACK_NUMBER, DEFAULT_DURATION, CUE_TIME) and "entry" in state:
            state["entry"][ident] = int.from_bytes(data[at:stop], "big")
        elif ident == CODEC_ID and "entry" in state:
            state["entry"][ident] = data[at:stop].rstrip(b"\0").decode("ascii", "replace")
        elif ident in (CUE_TRACK, CUE_CLUSTER) and state.get("positions"):
            state["positions"][-1][ident] = int.from_bytes(data[at:stop], "big")
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    """A cluster of unknown size ends where an element of the segment's level begins."""
    while at < end:
        ident, body = _vint(data, at, True)
        if ident in (CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS):
            return at
        size, body = _vint(data, body, False)
        at = body + size
    return end


PACKETS = "array<struct<track:long,timestamp_ns:long,block:int,lacing:string,keyframe:boolean,offset:long,length:long,cued:boolean>>"


def packets(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """The packet table: one row per frame with ``key``, frame number, track, codec, timestamp, lacing and byte range.

    A null file has no frames; a damaged one those before the damage.
    """

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                found = parse(data.as_py() or b"")
                n = len(found.packets)
                names = ("track", "timestamp_ns", "block", "lacing", "keyframe", "offset", "length", "cued")
                columns = dict(zip(names, zip(*found.packets))) if n else {c: () for c in names}
                columns["lacing"] = [LACINGS[x] for x in columns["lacing"]]
                columns["codec"] = [found.codecs.get(t) for t in columns["track"]]
                out = {"key": pa.repeat(batch.column(0)[i], n), "frame": pa.array(range(n), pa.int32())}
                types = {"track": pa.int64(), "timestamp_ns": pa.int64(), "block": pa.int32(), "lacing": pa.string(), "keyframe": pa.bool_(), "offset": pa.int64(), "length": pa.int64(), "cued": pa.bool_(), "codec": pa.string()}
                out |= {c: pa.array(columns[c], t) for c, t in types.items()}
                yield pa.RecordBatch.from_pydict(out)

    kind = files.schema[key].dataType.simpleString()
    schema = f"key {kind}, frame int, track long, timestamp_ns long, block int, lacing string, keyframe boolean, offset long, length long, cued boolean, codec string"
    return files.select(key, media).mapInArrow(rows, schema).withColumnRenamed("key", key)


def _store(held: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")}
    for key, text in zip(held["doc_id"], held["text"]):
        raw = (text or "").encode()
        payload = pad(raw)
        media = mux(payload)
        found = parse(media)
        if found.error:
            raise ValueError(found.error)
        back = b"".join(media[a : a + n] for *_, a, n, _ in found.packets)
        if back != payload:
            raise ValueError("the frames read back are not the payload")
        laced = [0, 0, 0, 0]
        for p in found.packets:
            laced[p[3]] += 1
        feature = (
            f"codec={found.codecs.get(1)};clusters={len(found.clusters)};cues={len(found.cues)};blocks={found.packets[-1][2] + 1};packets={len(found.packets)};"
            + ",".join(f"{k}={n}" for k, n in zip(LACINGS, laced))
            + f";first={found.packets[0][5]};last={found.packets[-1][5]};end_ns={found.packets[-1][1] + found.durations.get(1, 0)}"
        )
        made = (key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media)
        for c, v in zip(out, made):
            out[c].append(v)
    return out


def store_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Per row of ``docs``: the text's payload stored as a Matroska file, read back by its packets, and what they show.

    The packets' byte ranges are read in file order; ``payload_*`` describe the bytes so read, ``media_*`` the file,
    ``feature`` its structure. ``with_media`` keeps the file, ready for ``packets``. A null text is empty: one frame
    of 255. Equal texts give equal values; repeated rows each give a row.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = map_chunks(rows, ["doc_id", "text"], "text", _keep if with_media else _drop, schema + (", media binary" if with_media else ""))
    return made


def _keep(held: dict[str, list]) -> dict[str, list]:
    return _store(held)


def _drop(held: dict[str, list]) -> dict[str, list]:
    out = _store(held)
    del out["media"]
    return out
