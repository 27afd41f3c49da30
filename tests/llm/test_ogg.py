import random
import struct

import pytest

from tessarine.llm import ogg
from tests.llm import cases


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


def streams(seed, n=4):
    rng = random.Random(seed)
    size = lambda: rng.choice([0, 1, 254, 255, 256, 510, 511, 70_000, rng.randrange(3000)])
    return [(s * 7 + 1, [(rng.randbytes(size()), 100 * k) for k in range(rng.randrange(1, 30))]) for s in range(n)]


@pytest.mark.parametrize("segments", [255, 3, 1])
def test_round_trip(segments):
    for seed in range(6):
        own = streams(seed)
        got = {s.serial: s for s in ogg.parse(ogg.mux(own, segments))}
        for serial, packets in own:
            s = got[serial]
            assert s.packets == [p for p, _ in packets] and s.ended and not (s.bad_pages or s.lost_pages or s.broken_packets)
            marks = [(k, g) for k, g in enumerate(s.granules) if g is not None]
            assert all(g == packets[k][1] for k, g in marks) and marks[-1][0] == len(packets) - 1


def test_times():
    opus = ogg.document_container("a\nb\nc", "en/x")
    by = {s.serial: s for s in ogg.parse(opus)}
    assert (by[1].codec, by[1].rate, by[2].codec, by[2].rate) == ("opus", 48_000, "vorbis", 8_000)
    assert by[1].summary()["last_time"] == round((3 * 960 - 312) / 48_000, 6) and by[2].summary()["last_time"] == 1.0
    assert by[1].times() == [None, None, *(round((960 * k - 312) / 48_000, 6) for k in (1, 2, 3))] and by[2].times()[-1] == by[2].summary()["first_time"] == 1.0
    speex = b"Speex   " + bytes(28) + struct.pack("<I", 16_000) + bytes(40)
    flac = b"\x7fFLAC\x01\x00" + struct.pack(">H", 1) + b"fLaC" + bytes(4) + bytes(10) + ((44_100 << 4).to_bytes(3, "big")) + bytes(21)
    for head, codec, rate in ((speex, "speex", 16_000), (flac, "flac", 44_100)):
        [s] = ogg.parse(ogg.mux([(3, [(head, 0), (b"x", 0), (b"y", rate)])]))
        assert (s.codec, s.rate, s.time(rate)) == (codec, rate, 1.0)
    [s] = ogg.parse(ogg.mux([(3, [(b"no header", 0), (b"y", 5)])]))
    assert s.codec is None and s.summary()["last_time"] is None


def test_times_between_the_pages_of_a_container():
    """Many pages: even spacing between their positions, none across a loss."""
    own = [(ogg._OPUS, 0), (ogg._TAGS, 0), *((bytes(300), 960 * (k + 1)) for k in range(40))]
    whole = ogg.mux([(1, own)], 7)
    want = [round((960 * (k + 1) - 312) / 48_000, 6) for k in range(40)]
    [s] = ogg.parse(whole)
    assert s.times()[2:] == want and s.pages > 10
    parts = pages(whole)
    [s] = ogg.parse(b"".join([*parts[:4], *parts[5:]]))
    times = s.times()[2:]
    assert s.lost_pages == 1 and None in times and times[-1] == want[-1] and set(times) - {None} <= set(want)
    missing = times.index(None)
    assert times[:missing] == want[:missing]


def pages(data):
    out, at = [], 0
    while at < len(data):
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        out.append(data[at:end])
        at = end
    return out


def test_damage():
    packets = [(bytes([k]) * 600, k) for k in range(10)]
    parts = pages(ogg.mux([(1, packets)], 4))
    broken = bytearray(parts[3])
    broken[-1] ^= 1
    [s] = ogg.parse(b"junk OggS junk" + b"".join([*parts[:3], bytes(broken), *parts[4:]]) + b"OggS")
    assert s.bad_pages == 1 and s.lost_pages == 1
    assert set(s.packets) <= {p for p, _ in packets} and len(s.packets) == 8  # the page had the end of one packet and the whole next
    [s] = ogg.parse(b"".join(parts[:-1]))
    assert not s.ended and s.packets == [p for p, _ in packets[: len(s.packets)]]
    [s] = ogg.parse(b"".join([parts[0], *parts[2:]]))
    assert s.lost_pages == 1
    split = pages(ogg.mux([(1, packets)], 2))
    [s] = ogg.parse(b"".join([*split[:4], *split[5:]]))
    assert s.lost_pages == 1 and s.broken_packets >= 1 and set(s.packets) < {p for p, _ in packets}
    for cut in range(0, len(parts[0]) + 40, 7):
        ogg.parse(b"".join(parts)[:cut])
    rng = random.Random(4)
    for _ in range(200):
        data = bytearray(b"".join(parts))
        for _ in range(5):
            data[rng.randrange(len(data))] = rng.randrange(256)
        for s in ogg.parse(bytes(data)):
            assert set(s.packets) <= {p for p, _ in packets}


def test_awkward_and_empty(spark):
    docs = cases.awkward(spark)
    media = ogg.from_documents(docs)
    assert media.columns == [*docs.columns, "media"]
    taken = ogg.demux(media.withColumn("streams", media.doc_id))
    assert taken.columns[-2:] == ["streams", "streams_"]
    rows = ogg.demux(media).collect()
    for r in rows:
        if r.text is None:
            assert r.media is None and r.streams is None
        else:
            assert [s.serial for s in r.streams] == [1, 2] and r.streams[0].packets == len(r.text.split("\n")) and r.streams[0].bytes == len(r.text.replace("\n", "").encode())
    odd = spark.createDataFrame([(1, bytearray()), (2, bytearray(b"OggS")), (3, None)], "id int, media binary")
    assert {r.id: r.streams for r in ogg.demux(odd).collect()} == {1: [], 2: [], 3: None}
    assert {r.id: r.packets for r in ogg.packets(odd).collect()} == {1: [], 2: [], 3: None}
    back = ogg.packets(ogg.from_documents(docs.where("doc_id = 9"))).first().packets
    assert [bytes(p.data) for p in back if p.serial == 1][2:] == [b"zwei drei", "vier fünf sechs sieben".encode()]
    assert ogg.demux(ogg.from_documents(cases.empty(spark))).count() == 0
