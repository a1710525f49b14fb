"""Audio features: polyphase resampling, overlapped log-mel filterbanks, segments by energy with hysteresis, fixed-shape tensors."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES, MELS = 64, 32
#: Windows of one row, numbers that one step of the transforms holds, and the sampling rates that a header may name.
WINDOWS, WORK, RATES = 256, 2_000_000, (1_000, 768_000)
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=["frame", "mel"])
RESULT = "id bigint, part int, status string, start_s double, end_s double, n_frames int, n_windows int, tensors binary, segments array<struct<start_s:double,end_s:double>>"


@lru_cache(16)
def _bank(up: int, down: int, half: int = 8) -> np.ndarray:
    """The phases of a Hann-windowed sinc low pass: row p has the taps for outputs of phase p; each row sums to 1."""
    cut = min(1.0, up / down)
    width = int(math.ceil(half / cut))
    t = np.arange(-width + 1, width + 1)[None, :] - np.arange(up)[:, None] / up
    taps = cut * np.sinc(cut * t) * np.where(np.abs(t) < width, np.cos(np.pi * t / (2 * width)) ** 2, 0)
    return (taps / taps.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(read, length: int, rate: int, target: int) -> np.ndarray:
    """ceil(length * target / rate) samples; output n is the filter's phase (n * down) % up at sample (n * down) // up. Edges are padded by zeros.

    read(begin, end) gives the samples in between. Input and work memory are those of one block; only the result is held whole.
    """
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    bank = _bank(up, down)
    taps = bank.shape[1]
    out = np.empty(-(-length * up // down), np.float32)
    step = max(1, min(WORK // taps, WORK * up // down))
    for at in range(0, len(out), step):
        n = np.arange(at, min(at + step, len(out)))
        if up == down:
            out[n] = read(at, at + len(n))
            continue
        begin, end = int(n[0] * down // up) - taps // 2 + 1, int(n[-1] * down // up) + taps // 2 + 1
        x = np.zeros(end - begin, np.float32)
        x[max(0, -begin) : max(0, min(end, length) - begin)] = read(max(0, begin), min(end, length))
        frames = np.lib.stride_tricks.sliding_window_view(x, taps)
        out[n] = np.einsum("ij,ij->i", frames[n * down // up - taps // 2 + 1 - begin], bank[n * down % up])
    return out


@lru_cache(16)
def _filters(rate: int, n_fft: int, mels: int) -> np.ndarray:
    """Triangles, equally wide on the mel scale from 0 to half the rate."""

    def hertz(m):
        return 700 * (10 ** (m / 2595) - 1)

    points = hertz(np.linspace(0, 2595 * math.log10(1 + rate / 2 / 700), mels + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (bins[None, :] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    fall = (points[2:, None] - bins[None, :]) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def log_mel(x: np.ndarray, rate: int, mels: int = MELS, length_s: float = 0.025, hop_s: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels natural-log mel energies, energy of each frame in dB). Frames overlap; the last is padded with zeros."""
    length, hop = int(rate * length_s), int(rate * hop_s)
    n_fft = 1 << (length - 1).bit_length()
    if not len(x):
        return np.empty((0, mels), np.float32), np.empty(0, np.float32)
    count = max(1, 1 + -(-(len(x) - length) // hop))
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)).astype(np.float32)
    mel, energy = np.empty((count, mels), np.float32), np.empty(count, np.float32)
    for at in range(0, count, WORK // n_fft):
        end = min(count, at + WORK // n_fft)
        part = np.zeros((end - at - 1) * hop + length, np.float32)
        there = x[at * hop : at * hop + len(part)]
        part[: len(there)] = there
        frames = np.lib.stride_tricks.sliding_window_view(part, length)[::hop]
        energy[at:end] = 10 * np.log10(np.einsum("ij,ij->i", frames, frames) / length + 1e-10)
        power = np.abs(np.fft.rfft(frames * window, n_fft)) ** 2
        mel[at:end] = np.log(power.astype(np.float32) @ _filters(rate, n_fft, mels) + np.float32(1e-6))
    return mel, energy


def hysteresis(energy: np.ndarray, high: float, low: float) -> np.ndarray:
    """Is the frame in a segment? One opens at a frame >= high and lasts until a frame < low; frames between keep the state."""
    if not len(energy):
        return np.zeros(0, bool)
    mark = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    return np.where(last >= 0, mark[last], 0) == 1


class Clip:
    """The mono samples in [-1, 1] of a payload, read in stretches; status tells why there are none.

    A RIFF/WAVE file of PCM of 8, 16, 24 or 32 bits or of floats of 32 or 64, also in the extensible format, by its header; anything else as
    unsigned 8-bit PCM at `rate`.
    """

    def __init__(self, raw, rate: int):
        self.raw, self.rate, self.status, self.length = memoryview(raw), rate, "ok", 0
        self.channels, self.kind, self.at = 1, "u1", 0
        if bytes(self.raw[:4]) == b"RIFF" and bytes(self.raw[8:12]) == b"WAVE":
            self._header()
        else:
            self.length = len(self.raw)
        if self.status == "ok" and not self.length:
            self.status = "empty"

    def _header(self) -> None:
        raw, at, form = self.raw, 12, None
        while at + 8 <= len(raw):
            name, size = bytes(raw[at : at + 4]), struct.unpack_from("<I", raw, at + 4)[0]
            if name == b"fmt " and size >= 16 and at + 24 <= len(raw):
                form = list(struct.unpack_from("<HHIIHH", raw, at + 8))
                if form[0] == 0xFFFE and size >= 26 and at + 34 <= len(raw):
                    form[0] = struct.unpack_from("<H", raw, at + 32)[0]
            elif name == b"data" and form:
                coding, self.channels, self.rate, bits = form[0], form[1], form[2], form[5]
                self.kind = {(1, 8): "u1", (1, 16): "<i2", (1, 24): "i3", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}.get((coding, bits))
                if self.kind is None:
                    self.status = f"coding {coding} of {bits} bits"
                elif not self.channels or not RATES[0] <= self.rate <= RATES[1]:
                    self.status = f"{self.channels} channels at rate {self.rate}"
                else:
                    self.at, self.width = at + 8, bits // 8 * self.channels
                    self.length = min(size, len(raw) - self.at) // self.width
                return
            at += 8 + size + size % 2
        self.status = "no data"

    def read(self, begin: int, end: int) -> np.ndarray:
        if self.at == 0:
            return np.frombuffer(self.raw[begin:end], np.uint8).astype(np.float32) / np.float32(127.5) - 1
        body = self.raw[self.at + begin * self.width : self.at + end * self.width]
        if self.kind == "i3":
            b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 2] << 24 | b[:, 1] << 16 | b[:, 0] << 8) / 2.0**31).astype(np.float32)
        else:
            x = np.frombuffer(body, self.kind)
            x = {"u1": lambda: x.astype(np.float32) / 127.5 - 1, "<i2": lambda: x.astype(np.float32) / 32768, "<i4": lambda: (x / 2.0**31).astype(np.float32)}.get(self.kind, lambda: np.nan_to_num(x.astype(np.float32), posinf=1, neginf=-1))()
        return x.reshape(-1, self.channels).mean(axis=1, dtype=np.float32)

    def centred(self):
        """read() less the clip's mean, which carries no sound."""
        step = max(1, WORK // self.channels)
        mean = sum(float(self.read(at, min(at + step, self.length)).sum(dtype=np.float64)) for at in range(0, self.length, step)) / max(1, self.length)
        return lambda begin, end: self.read(begin, end) - np.float32(mean)


def _stored(mel: np.ndarray, at: int, hop: float) -> bytes:
    """An Arrow IPC stream of one batch: window, start_s, end_s, n_frames and the frames as fixed-shape tensors."""
    n = -(-len(mel) // FRAMES)
    tensors = np.zeros((n * FRAMES, MELS), np.float32)
    tensors[: len(mel)] = mel
    begin = at + FRAMES * np.arange(n)
    end = np.minimum(begin + FRAMES, at + len(mel))
    tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), FRAMES * MELS))
    columns = [pa.array((begin // FRAMES).astype(np.int32)), pa.array(np.round(begin * hop, 6)), pa.array(np.round(end * hop, 6)), pa.array((end - begin).astype(np.int32)), tensor]
    batch = pa.RecordBatch.from_arrays(columns, names=["window", "start_s", "end_s", "n_frames", "features"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def clip_features(raw, rate: int, target: int, high_db: float, low_db: float, floor_db: float) -> Iterator[tuple]:
    """The rows of one clip without its id; see audio_features."""
    clip = Clip(raw, rate)
    if clip.status != "ok":
        yield 0, clip.status, 0.0, 0.0, 0, 0, None, []
        return
    x = resample(clip.centred(), clip.length, clip.rate, target)
    mel, energy = log_mel(x, target)
    del x
    hop = int(target * 0.01) / target
    level = float(np.percentile(energy, 95))
    edge = np.diff(np.concatenate([[0], hysteresis(energy, max(level - high_db, floor_db), max(level - low_db, floor_db)).astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    step = FRAMES * WINDOWS
    for part, at in enumerate(range(0, len(mel), step)):
        until = min(at + step, len(mel))
        hit = (begins < until) & (ends > at)
        segments = [{"start_s": round(float(s) * hop, 6), "end_s": round(float(e) * hop, 6)} for s, e in zip(np.maximum(begins[hit], at), np.minimum(ends[hit], until), strict=True)]
        yield part, "ok", round(at * hop, 6), round(until * hop, 6), until - at, -(-(until - at) // FRAMES), _stored(mel[at:until], at, hop), segments


def audio_features(clips: DataFrame, id_col: str, payload_col: str, rate: int = 11_025, target: int = 8_000, high_db: float = 12.0, low_db: float = 18.0, floor_db: float = -60.0) -> DataFrame:
    """(id, part, status, start_s, end_s, n_frames, n_windows, tensors, segments): one row for each 256 windows of each clip, which most clips don't exceed.

    The payload is a WAVE file (see Clip) or raw 8-bit PCM at `rate`; text is taken as its UTF-8 bytes. Its mean is removed and it is resampled
    to `target`. tensors is an Arrow IPC stream with a row for each window of 64 frames (10 ms apart): window, start_s, end_s, n_frames, and
    features, the log-mel energies as Arrow fixed_shape_tensor<float>[64, 32] (a window with fewer frames ends in zeros); windows() gives these
    rows as a table. segments are the spans, in seconds and clipped to the row, in which the frames' energy rose to high_db below the clip's
    level and has not fallen to low_db below it since; the level is the 95th percentile of its frames' energies, and what is under floor_db
    is silence. A clip without samples, of another coding, or with a rate outside 1 to 768 kHz has one row, whose status is not `ok` but
    says why. A long clip is decoded and transformed in blocks. NULL payloads have no row; repeated rows give repeated results; a NULL id
    stays NULL. Other columns take no part. An empty table gives no row.
    """
    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for i, raw in zip(b.column("id").to_pylist(), b.column("payload"), strict=True):
                if raw.is_valid:
                    for row in clip_features(raw.as_buffer(), rate, target, high_db, low_db, floor_db):
                        rows.append((i, *row))
                        held += len(row[6] or b"")
                        if held > 16_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return clips.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{payload_col}`").cast("binary").alias("payload")).mapInArrow(run, RESULT)


def tensors(stored: bytes) -> pa.Table:
    """The windows of one row of audio_features, features as Arrow's fixed_shape_tensor."""
    return pa.ipc.open_stream(stored).read_all()


def windows(features: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, window, start_s, end_s, n_frames, features array<float>) of the rows of audio_features that have windows."""

    def run(batches):
        for b in batches:
            for i, raw in zip(b.column("id").to_pylist(), b.column("tensors").to_pylist(), strict=True):
                t = tensors(raw).combine_chunks()
                flat = t.column("features").chunk(0).storage.flatten()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1, dtype=np.int32) * (FRAMES * MELS)), flat)
                yield pa.RecordBatch.from_arrays([pa.array([i] * t.num_rows, pa.int64()), *(t.column(c).chunk(0) for c in ("window", "start_s", "end_s", "n_frames")), lists], names=["id", "window", "start_s", "end_s", "n_frames", "features"])

    there = features.where("tensors is not null").select(F.col(f"`{id_col}`").alias("id"), "tensors")
    return there.mapInArrow(run, "id bigint, window int, start_s double, end_s double, n_frames int, features array<float>")
