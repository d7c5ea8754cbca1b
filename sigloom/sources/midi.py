"""Standard MIDI files as notes, and notes as MIDI files."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the file format: microseconds a beat before any tempo event, and the channel of drums.
TEMPO, DRUMS = 500_000, 9
NOTES = "name string, k long, onset double, dur double, pitch long, velocity long, channel long, instrument long"


def variable_length(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and the place after it."""
    value = 0
    while True:
        byte = data[at]
        at, value = at + 1, value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def track_events(data: bytes) -> list[tuple[int, int, bytes]]:
    """(tick, status, data) of a track's channel events, and of its tempo events with status 0x51."""
    at, tick, status, out = 0, 0, 0, []
    while at < len(data):
        delta, at = variable_length(data, at)
        tick += delta
        if data[at] >= 0x80:
            status, at = data[at], at + 1
        if status == 0xFF:
            kind = data[at]
            size, at = variable_length(data, at + 1)
            if kind == 0x51:
                out.append((tick, kind, data[at : at + size]))
            at += size
        elif status in (0xF0, 0xF7):
            size, at = variable_length(data, at)
            at += size
        elif status >= 0x80:
            size = 1 if status >> 4 in (0xC, 0xD) else 2
            out.append((tick, status, data[at : at + size]))
            at += size
        else:
            raise ValueError("an event without a status")
    return out


def parse_midi(data: bytes) -> list[tuple[float, float, int, int, int, int]]:
    """(onset, dur, pitch, velocity, channel, instrument) in seconds, by onset, channel and pitch.

    A note ends at its release, a note that starts again while it sounds ends the earlier one last, and a note without
    a release ends with the file. A cut last track is read as far as it goes.
    """
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, _, _, division = struct.unpack_from(">IHHH", data, 4)
    at, events = 8 + size, []
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at + 4)[0]
        if data[at : at + 4] == b"MTrk":
            events += [(tick, n, *rest) for n, (tick, *rest) in enumerate(track_events(data[at + 8 : at + 8 + size]), len(events))]
        at += 8 + size
    events.sort()
    smpte = division & 0x8000
    per_tick = 1 / ((256 - (division >> 8)) * (division & 0xFF)) if smpte else TEMPO / 1e6 / division
    now, last, program, sounding, out = 0.0, 0, {}, {}, []
    for tick, _, status, body in events:
        now, last = now + (tick - last) * per_tick, tick
        kind, channel = status >> 4, status & 15
        if status == 0x51:
            if not smpte:
                per_tick = int.from_bytes(body, "big") / 1e6 / division
        elif kind == 0xC:
            program[channel] = body[0]
        elif kind == 9 and body[1]:
            instrument = 128 if channel == DRUMS else program.get(channel, 0)
            sounding.setdefault((channel, body[0]), []).append((now, body[1], instrument))
        elif kind in (8, 9) and sounding.get((channel, body[0])):
            start, velocity, instrument = sounding[channel, body[0]].pop(0)
            out.append((start, now - start, body[0], velocity, channel, instrument))
    for (channel, pitch), open_notes in sounding.items():
        out += [(start, now - start, pitch, velocity, channel, instrument) for start, velocity, instrument in open_notes]
    return sorted(out, key=lambda n: (n[0], n[4], n[2]))


def as_length(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(0x80 | value & 0x7F)
    return bytes(out[::-1])


def render_midi(notes, division: int = 480) -> bytes:
    """A file of one track from (onset, dur, pitch, velocity, channel, instrument), releases before starts."""
    per_second = division * 1e6 / TEMPO
    events, program = [], {}
    for onset, dur, pitch, velocity, channel, instrument in sorted(notes):
        start, end = round(onset * per_second), round((onset + dur) * per_second)
        if channel != DRUMS and program.get(channel) != instrument:
            program[channel] = instrument
            events.append((start, 1, bytes([0xC0 | channel, instrument & 0x7F])))
        events += [(start, 2, bytes([0x90 | channel, pitch, max(1, velocity)])), (max(end, start + 1), 0, bytes([0x80 | channel, pitch, 0]))]
    events.sort(key=lambda e: e[:2])
    body, last = b"", 0
    for tick, _, event in events:
        body, last = body + as_length(tick - last) + event, tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(body)) + body


def load_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, k, onset, dur, pitch, velocity, channel, instrument) of the MIDI files right in a folder, a row a note."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.midi?$"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")

    def decode(parts):
        import pandas as pd

        columns = [c.split()[0] for c in NOTES.split(", ")]
        for part in parts:
            for row in part.itertuples():
                yield pd.DataFrame([(row.name, k, *n) for k, n in enumerate(parse_midi(row.content))], columns=columns)

    return files.select(name.alias("name"), "content").mapInPandas(decode, NOTES)


def midi_bytes(notes: DataFrame) -> DataFrame:
    """(name, content): one MIDI image per name."""

    def join(pdf):
        import pandas as pd

        rows = pdf[["onset", "dur", "pitch", "velocity", "channel", "instrument"]].itertuples(index=False, name=None)
        return pd.DataFrame([{"name": pdf.name.iloc[0], "content": render_midi([(a, b, *map(int, rest)) for a, b, *rest in rows])}])

    return notes.groupBy("name").applyInPandas(join, "name string, content binary")
