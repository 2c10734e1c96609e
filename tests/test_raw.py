"""Embedded previews of synthetic raw files of each kind, and of broken ones."""

import random
import struct

from plumage.sources import files, raw

SMALL, LARGE = b"\xff\xd8\xff\xe0small\xff\xd9", b"\xff\xd8\xff\xe0" + b"large" * 50 + b"\xff\xd9"


def tiff(order, directories, payload, head=None):
    """A TIFF block: directories of (tag, kind, values), each with what follows it; payload after them."""
    sizes = [2 + 12 * len(tags) + 4 for tags, _ in directories]
    starts = [8 + sum(sizes[:i]) for i in range(len(sizes))]
    data_at = 8 + sum(sizes)
    body, tail = b"", b""
    for (tags, follow), _ in zip(directories, starts, strict=True):
        body += struct.pack(order + "H", len(tags))
        for tag, kind, values in sorted(tags):
            code = {3: "H", 4: "I", 7: "B"}[kind]
            values = [starts[v[1]] if isinstance(v, tuple) and v[0] == "dir" else data_at + 4096 + v[1] if isinstance(v, tuple) else v for v in values]
            packed = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(packed) > 4:
                body += struct.pack(order + "HHII", tag, kind, len(values), data_at + len(tail))
                tail += packed
            else:
                body += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        body += struct.pack(order + "I", 0 if follow is None else starts[follow])
    assert len(tail) <= 4096
    return (head or (b"II*\0" if order == "<" else b"MM\0*")) + struct.pack(order + "I", 8) + body + tail.ljust(4096, b"\0") + payload


def at(i):
    return ("data", i)


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def samples():
    out = {}
    for order in "<>":
        sub = [([(0x14A, 4, [("dir", 1), ("dir", 2)])], None), ([(0x201, 4, [at(0)]), (0x202, 4, [len(SMALL)])], None), ([(0x103, 3, [7]), (0x111, 4, [at(100)]), (0x117, 4, [len(LARGE)])], None)]
        out[f"sub{order}"] = tiff(order, sub, SMALL.ljust(100, b"\0") + LARGE)
        chain = [([(0x103, 3, [1]), (0x111, 4, [at(0)]), (0x117, 4, [9999])], 1), ([(0x201, 4, [at(0)]), (0x202, 4, [len(LARGE)])], 0)]  # the last refers back
        out[f"chain{order}"] = tiff(order, chain, LARGE)
    out["rw2"] = tiff("<", [([(0x2E, 7, list(LARGE))], None)], b"", b"IIU\0")
    mdat = box(b"mdat", b"??" + LARGE)
    head = box(b"ftyp", b"crx ")
    table = lambda place: box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsz", struct.pack(">III", 0, len(LARGE), 1)) + box(b"co64", struct.pack(">IIQ", 0, 1, place))))))
    thumb = box(b"uuid", b"u" * 16 + box(b"CNCV", b"v") + box(b"THMB", b"\0" * 16 + SMALL))
    moov = lambda place: box(b"moov", thumb + table(place))
    out["cr3"] = head + moov(len(head) + len(moov(0)) + 10) + mdat
    out["prvw"] = head + box(b"uuid", b"u" * 16 + struct.pack(">II", 0, 1) + box(b"PRVW", b"\0" * 16 + LARGE))
    out["raf"] = (raw.RAF_HEAD.ljust(84, b"\0") + struct.pack(">II", 120, len(LARGE))).ljust(120, b"\0") + LARGE
    out["jpeg"] = LARGE
    return out


def test_each_kind_gives_its_largest_jpeg():
    for name, data in samples().items():
        assert raw.preview(data) == LARGE, name


def test_broken_files_give_none_and_end():
    rng = random.Random(2)
    for name, data in samples().items():
        for _ in range(300):
            cut = bytearray(data[: rng.randint(0, len(data))])
            for _ in range(rng.randint(0, 12)):
                if cut:
                    cut[rng.randrange(len(cut))] = rng.choice((0, 255, rng.randrange(256)))
            try:
                found = raw.preview(bytes(cut))
            except struct.error:
                continue  # told as decode_error
            assert found is None or found[:3] == b"\xff\xd8\xff", name
    assert raw.preview(None) is None and raw.preview(b"") is None and raw.preview(b"text") is None
    loop = struct.pack("<4sIHHHIII", b"II*\0", 8, 1, 0x14A, 4, 1, 8, 8)
    assert raw.preview(loop) is None


def test_previews_as_rows_and_files(spark, tmp_path):
    rows = [(n, bytearray(d)) for n, d in samples().items()] + [("none", None), ("bad", bytearray(b"II*\0\xff\xff\xff\xff"))]
    got = {r.path: r for r in raw.previews(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {n for n, r in got.items() if r.error} == {"none", "bad"} and all(bytes(r.content) == LARGE for r in got.values() if not r.error)
    ok = raw.previews(spark.createDataFrame(rows, "path string, content binary")).filter("error is null").selectExpr("concat('out/', path, '.jpg') AS dest", "content")
    assert sum(r.ok for r in files.write_files(ok, str(tmp_path)).collect()) == len(samples())
    assert (tmp_path / "out/cr3.jpg").read_bytes() == LARGE
