"""Codec headers against a writer of single bits, and detectors over first samples."""

import random

import numpy as np
import pytest

from tidelane.functions.bits import BitRows, without_emulation
from tidelane.operators import headers


class Bits:
    """Writes fields bit by bit; the reverse of what the reader does, and nothing of it."""

    def __init__(self):
        self.text = ""

    def u(self, n, v):
        self.text += format(v, f"0{n}b") if n else ""

    def ue(self, v):
        code = format(v + 1, "b")
        self.text += "0" * (len(code) - 1) + code

    def se(self, v):
        self.ue(2 * v - 1 if v > 0 else -2 * v)

    def bytes(self):
        text = self.text + "1"
        text += "0" * (-len(text) % 8)
        raw, out, zeros = int(text, 2).to_bytes(len(text) // 8), bytearray(), 0
        for b in raw:
            if zeros >= 2 and b <= 3:
                out.append(3)
                zeros = 0
            out.append(b)
            zeros = zeros + 1 if b == 0 else 0
        return bytes(out)


def test_numbers_of_many_rows():
    rng = random.Random(1)
    rows, want = [], []
    for _ in range(50):
        w, values = Bits(), []
        for _ in range(20):
            kind = rng.choice("uesw")
            v = rng.choice([0, 1, 5, rng.randrange(1 << 16), (1 << 30) - 2])
            if kind == "u":
                w.u(31, v)
            elif kind == "w":
                w.u(3, v & 7)
            elif kind == "e":
                w.ue(v)
            else:
                w.se(v if rng.random() < 0.5 else -v)
            values.append((kind, w.text))
        rows.append(w.bytes())
        want.append(values)
    for row, values in zip(rows, want, strict=True):
        b, before = BitRows([without_emulation(row)]), 0
        for kind, text in values:
            got = {"u": lambda: b.bits(31), "w": lambda: b.bits(3), "e": b.ue, "s": b.se}[kind]()[0]
            part, before = text[before:], len(text)
            number = int(part, 2)
            assert got == (number if kind in "uw" else number - 1 if kind == "e" else (number // 2 if number % 2 == 0 else -(number // 2)))
    b = BitRows([b"\xff", b"\xff\xff", b""])
    assert b.bits(12).tolist() == [0, 0xFFF, 0] and b.bad.tolist() == [True, False, True]
    assert BitRows([b"\0\0\0\0\0\0\0\0"]).ue().tolist() == [0]


def usability(w, rng, hevc):
    f = {k: 0 for k in headers.FIELDS[7:]}
    w.u(1, shaped := rng.randrange(2))
    if shaped:
        index = rng.choice([1, 14, 16, 255])
        w.u(8, index)
        if index == 255:
            w.u(16, 7), w.u(16, 5)
        f["aspect_width"], f["aspect_height"] = (7, 5) if index == 255 else headers.ASPECTS[index - 1]
    w.u(1, over := rng.randrange(2))
    w.u(over, 0)
    w.u(1, signal := rng.randrange(2))
    f["primaries"] = f["transfer"] = f["matrix"] = 2
    if signal:
        w.u(3, 5)
        w.u(1, full := rng.randrange(2))
        f["full_range"] = full
        w.u(1, colour := rng.randrange(2))
        if colour:
            w.u(8, 9), w.u(8, 16), w.u(8, 9)
            f |= {"primaries": 9, "transfer": 16, "matrix": 9}
    w.u(1, placed := rng.randrange(2))
    for _ in range(2 * placed):
        w.ue(3)
    if hevc:
        w.u(3, 0)
        w.u(1, window := rng.randrange(2))
        for _ in range(4 * window):
            w.ue(2)
    w.u(1, timed := rng.randrange(2))
    if timed:
        w.u(32, 1001), w.u(32, 60000 if hevc else 120000)
        f["rate_ticks"], f["rate_scale"] = (1001, 60000) if hevc else (2002, 120000)
    return f


def h264(rng):
    w, f = Bits(), {k: 2 * (k in ("primaries", "transfer", "matrix")) for k in headers.FIELDS}  # 2: not told
    f["profile"], f["level"], f["bit_depth"], f["chroma"] = rng.choice([66, 77, 100, 244]), 41, 8, 1
    w.u(8, f["profile"]), w.u(8, 0), w.u(8, 41), w.ue(0)
    planes = 0
    if f["profile"] >= 100:
        f["chroma"] = rng.randrange(4)
        w.ue(f["chroma"])
        if f["chroma"] == 3:
            w.u(1, planes := rng.randrange(2))
        f["bit_depth"] = 8 + rng.randrange(3)
        w.ue(f["bit_depth"] - 8), w.ue(0), w.u(1, 0)
        w.u(1, scaled := rng.randrange(2))
        if scaled:
            for i in range(12 if f["chroma"] == 3 else 8):
                w.u(1, on := rng.randrange(2))
                if on:
                    last = 8
                    for _ in range(16 if i < 6 else 64):
                        step = rng.choice([0, 1, -last])
                        w.se(step)
                        if (last + step) % 256 == 0:
                            break
                        last = (last + step) % 256
    w.ue(4)
    w.ue(order := rng.randrange(3))
    if order == 0:
        w.ue(2)
    elif order == 1:
        w.u(1, 0), w.se(-3), w.se(4), w.ue(3)
        for v in (1, -2, 0):
            w.se(v)
    w.ue(4), w.u(1, 0)
    columns, rows, frames = rng.randrange(1, 250), rng.randrange(1, 100), rng.randrange(2)
    w.ue(columns - 1), w.ue(rows - 1), w.u(1, frames)
    if not frames:
        w.u(1, 0)
    w.u(1, 1), w.u(1, crop := rng.randrange(2))
    sides = [rng.randrange(3) for _ in range(4)] if crop else [0] * 4
    for s in sides * crop:
        w.ue(s)
    x, y = (1, 1) if planes or f["chroma"] in (0, 3) else (2, 2 if f["chroma"] == 1 else 1)
    f["width"], f["height"] = 16 * columns - x * (sides[0] + sides[1]), (2 - frames) * (16 * rows - y * (sides[2] + sides[3]))
    f["chroma"] = 0 if planes else f["chroma"]
    w.u(1, vui := rng.randrange(2))
    return b"\x67" + w.bytes(), f | (usability(w, rng, False) if vui else {}), w


def hevc(rng):
    w, f = Bits(), {k: 2 * (k in ("primaries", "transfer", "matrix")) for k in headers.FIELDS}  # 2: not told
    layers = rng.randrange(4)
    w.u(4, 0), w.u(3, layers), w.u(1, 1)
    f["tier"], f["profile"], f["level"] = rng.randrange(2), 2, 153
    w.u(2, 0), w.u(1, f["tier"]), w.u(5, 2), w.u(32, 0x20000000), w.u(48, 0), w.u(8, 153)
    told = [(rng.randrange(2), rng.randrange(2)) for _ in range(layers)]
    for a, b in told:
        w.u(1, a), w.u(1, b)
    if layers:
        w.u(2 * (8 - layers), 0)
    for a, b in told:
        w.u(88 * a, (1 << 80) * a), w.u(8 * b, 90 * b)
    w.ue(0)
    f["chroma"] = rng.randrange(4)
    w.ue(f["chroma"])
    if f["chroma"] == 3:
        w.u(1, 0)
    width, height = rng.randrange(8, 4000), rng.randrange(8, 3000)
    w.ue(width), w.ue(height), w.u(1, crop := rng.randrange(2))
    sides = [rng.randrange(4) for _ in range(4)] if crop else [0] * 4
    for s in sides * crop:
        w.ue(s)
    x, y = {0: (1, 1), 1: (2, 2), 2: (2, 1), 3: (1, 1)}[f["chroma"]]
    f["width"], f["height"], f["bit_depth"] = width - x * (sides[0] + sides[1]), height - y * (sides[2] + sides[3]), 10
    w.ue(2), w.ue(2), w.ue(4), w.u(1, each := rng.randrange(2))
    for _ in range(layers + 1 if each else 1):
        w.ue(4), w.ue(2), w.ue(0)
    for v in (0, 3, 0, 3, 2, 2):
        w.ue(v)
    w.u(1, lists := rng.randrange(2))
    if lists:
        w.u(1, data := rng.randrange(2))
        for size in range(4 if data else 0):
            for _ in range(2 if size == 3 else 6):
                w.u(1, coded := rng.randrange(2))
                if not coded:
                    w.ue(0)
                    continue
                if size > 1:
                    w.se(-4)
                for _ in range(min(64, 1 << (4 + 2 * size))):
                    w.se(rng.randrange(-3, 4))
    w.u(2, 3), w.u(1, pcm := rng.randrange(2))
    if pcm:
        w.u(8, 0x77), w.ue(0), w.ue(2), w.u(1, 0)
    w.ue(sets := rng.randrange(5))
    before = 0
    for k in range(sets):
        changed = 0
        if k:
            w.u(1, changed := rng.randrange(2))
        if changed:
            w.u(1, 0), w.ue(1)
            n = 0
            for _ in range(before + 1):
                w.u(1, used := rng.randrange(2))
                if not used:
                    w.u(1, delta := rng.randrange(2))
                n += used or delta
            before = n
        else:
            a, b = rng.randrange(3), rng.randrange(3)
            w.ue(a), w.ue(b)
            for _ in range(a + b):
                w.ue(1), w.u(1, 1)
            before = a + b
    w.u(1, long := rng.randrange(2))
    if long:
        w.ue(3)
        for _ in range(3):
            w.u(8, 9), w.u(1, 1)
    w.u(2, 3), w.u(1, vui := rng.randrange(2))
    f |= usability(w, rng, True) if vui else {}
    return b"\x42\x01" + w.bytes(), f, w


@pytest.mark.parametrize("make, read, head", [(h264, headers.h264_parameters, b"\x67"), (hevc, headers.hevc_parameters, b"\x42\x01")])
def test_parameter_sets(make, read, head):
    rng = random.Random(11)
    units, want = [], []
    for _ in range(300):
        _, f, w = make(rng)
        units.append(head + w.bytes())
        want.append(f)
    got = read(units)
    assert got["whole"].all()
    for field in headers.FIELDS:
        assert got[field].tolist() == [f[field] for f in want], field
    cut = read([u[: len(u) // 3] for u in units])
    assert not cut["whole"].any() and not cut["width"].any()
    assert read([])["whole"].tolist() == []


def test_headers_of_a_table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(20):
        _, f, w = (h264 if i % 2 else hevc)(rng)
        rows.append((i, "h264" if i % 2 else "hevc", (b"\x67" if i % 2 else b"\x42\x01") + w.bytes(), f))
    table = spark.createDataFrame([(i, c, d, 7) for i, c, d, _ in rows] + [(90, "vp9", b"x", 7), (91, "h264", None, 7), (92, None, None, 7)], "i int, codec string, data binary, width int")
    got = {r.i: r for r in headers.codec_headers(table).collect()}
    assert all((got[i].width, got[i].height, got[i].profile, got[i].rate_scale) == (f["width"], f["height"], f["profile"], f["rate_scale"]) for i, _, _, f in rows)
    assert got[90].width is None and got[92].whole is None and got[91].whole is False and headers.codec_headers(table.limit(0)).count() == 0


def test_first_samples_keep_the_least(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i % 3}", int(n), f"v{n}") for i, n in enumerate(rng.permutation(600))] + [(None, 5, "x")]
    df = spark.createDataFrame(rows, "track string, n long, v string").repartition(6)
    got = headers.first_samples(df, ["track"], "n", 7)
    want = sorted((str(t), n) for t in {r[0] for r in rows} for n in sorted(m for k, m, _ in rows if k == t)[:7])
    assert sorted((str(r.track), r.n) for r in got.collect()) == want and all(r.v == f"v{r.n}" for r in got.collect() if r.track)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "Sort [" not in plan.split("== Physical Plan ==")[1]


def test_detectors(spark):
    plus, vision = b"\0\0\1\x4e\x01\x04\x20\xb5\x00\x3c\x00\x01\x04\x01", b"\0\0\0\1\x7c\x01\x19"
    shifted = bytes.fromhex("0b5003c0001040")
    truehd = lambda info: bytes(4) + bytes.fromhex("f8726fba") + bytes(13) + bytes([info]) + bytes(10)
    rows = [("a", "hevc", i, plus if i == 47 else b"none") for i in range(60)] + [("b", "hevc", i, plus if i == 48 else vision if i == 3 else shifted) for i in range(60)]
    rows += [("c", "truehd", 0, truehd(0x80)), ("d", "truehd", 0, truehd(0x7F)), ("e", "aac", 0, plus), ("f", "hevc", 0, None)]
    got = {r.track: tuple(r)[1:] for r in headers.detect(spark.createDataFrame(rows, "track string, codec string, n long, data binary").repartition(4), ["track"], "n").collect()}
    none = (False, False, False, False)
    assert got == {"a": (True, False, False, False), "b": (False, False, True, False), "c": (False, False, False, True), "d": none, "e": none, "f": none}


def test_access_units_of_blocks(spark):
    """Leading units go; the first major sync sets rate and time; blocks hold one unit or several."""
    unit = lambda n, major=None: (0x4000 | n // 2).to_bytes(2) + b"\0\0" + (headers.MAJOR_SYNC + bytes([major << 4]) if major is not None else b"") + bytes(n - 4 - 5 * (major is not None))
    rows = [("a", 0, 0, unit(20)), ("a", 1, 1000, unit(30) + unit(40, 1) + unit(22)), ("a", 2, 1002, unit(10) + unit(12, 1)), ("b", 0, 500, unit(50, 8)), ("c", 0, 0, unit(30)), ("d", 0, 0, None)]
    df = spark.createDataFrame(rows, "track string, n long, pts long, data binary")
    got = [tuple(r) for r in headers.truehd_units(df, ["track"], "n", "pts", 1000).orderBy("track", "unit").collect()]
    start = 96_000 + 80
    assert got == [
        ("a", 0, 1, 30, 40, True, start, 80, 96_000), ("a", 1, 1, 70, 22, False, start + 80, 80, 96_000), ("a", 2, 2, 0, 10, False, start + 160, 80, 96_000),
        ("a", 3, 2, 10, 12, True, start + 240, 80, 96_000), ("b", 0, 0, 0, 50, True, 22_050, 40, 44_100),
    ]
    with pytest.raises(Exception, match="breaks off"):
        headers.truehd_units(spark.createDataFrame([("a", 0, 0, unit(20)[:-1])], df.schema), ["track"], "n", "pts", 1000).collect()
