import struct

import pytest

from cloudloom.sources import ply

HEAD = "ply\nformat {}\ncomment units: meters\nobj_info scanner 7\nelement vertex {}\n{}end_header\n"


def _file(tmp_path, form, n, props, body, name="a.ply"):
    p = tmp_path / name
    p.write_bytes(HEAD.format(form + " 1.0", n, "".join(f"property {t} {c}\n" for t, c in props)).encode() + body)
    return str(p)


XYZ = [("float", a) for a in "xyz"]
RGB = [("uchar", c) for c in ("red", "green", "blue")]


@pytest.mark.parametrize("order,form", [("<", "binary_little_endian"), (">", "binary_big_endian")])
def test_binary(spark, tmp_path, order, form):
    n = 3000
    body = b"".join(struct.pack(order + "fffBBBf", i, i + 0.5, i + 1, i % 256, (i + 1) % 256, (i + 2) % 256, i / 10) for i in range(n))
    path = _file(tmp_path, form, n, [*XYZ, *RGB, ("float", "intensity")], body)
    rows = ply.read_ply(spark, path, rangeBytes=1000).orderBy("idx").collect()
    assert len(rows) == n and [r["idx"] for r in rows] == list(range(n))
    assert rows[0]["rgb"] == 258 and (rows[-1]["x"], rows[-1]["y"], rows[-1]["z"]) == (2999.0, 2999.5, 3000.0)
    assert rows[10]["intensity"] == 1.0


def test_all_types_and_extra_properties(spark, tmp_path):
    names = list(ply.TYPES)
    props = [*[(t, f"p{i}") for i, t in enumerate(names)], ("double", "x"), ("int", "y"), ("short", "z"), ("ushort", "reflectance")]
    codes = {"i1": "b", "u1": "B", "i2": "h", "u2": "H", "i4": "i", "u4": "I", "f4": "f", "f8": "d"}
    body = b"".join(struct.pack("<" + "".join(codes[ply.TYPES[t]] for t, _ in props), *[1] * len(names), 0.25, -7, 3, 60000) for _ in range(5))
    rows = ply.read_ply(spark, _file(tmp_path, "binary_little_endian", 5, props, body)).collect()
    assert {(r["x"], r["y"], r["z"], r["intensity"], r["rgb"]) for r in rows} == {(0.25, -7.0, 3.0, 60000.0, None)} and len(rows) == 5


def test_truncated(spark, tmp_path):
    body = b"".join(struct.pack("<fff", i, i, i) for i in range(10))[:-5]
    path = _file(tmp_path, "binary_little_endian", 10, XYZ, body)
    assert ply.read_ply(spark, path).count() == 9
    with pytest.raises(Exception, match="holds 9 of 10"):
        ply.read_ply(spark, path, strict=True).count()


def test_ascii_tokens(spark, tmp_path):
    lines = ["1 2 3 10 20 30 0.5", "", "4.5abc x 6", "  7\t8 9 1 2 3 4 extra", "1e2 -1 +3 0 0 0 1\r"]
    props = [*XYZ, ("uchar", "diffuse_red"), ("uchar", "g"), ("uchar", "diffuse_blue"), ("float", "greyscale")]
    path = _file(tmp_path, "ascii", 4, props, ("\n".join(lines) + "\n").encode())
    spark.dataSource.register(ply.PlySource)
    for df in (ply.read_ply(spark, path), *(spark.read.format("ply").option("rangeBytes", size).load(path) for size in (8, 1 << 20))):
        got = [tuple(r) for r in df.orderBy("idx").collect()]
        assert got == [(0, 1.0, 2.0, 3.0, 10 << 16 | 20 << 8 | 30, 0.5), (1, 4.5, 0.0, 6.0, 0, 0.0), (2, 7.0, 8.0, 9.0, 1 << 16 | 2 << 8 | 3, 4.0), (3, 100.0, -1.0, 3.0, 0, 1.0)]


def test_ascii_without_count_reads_all(spark, tmp_path):
    path = _file(tmp_path, "ascii", 0, XYZ, b"1 2 3\n4 5 6\n")
    assert ply.read_ply(spark, path).count() == 2


def test_elements_before_vertices_are_skipped(spark, tmp_path):
    p = tmp_path / "b.ply"
    head = "ply\nformat binary_little_endian 1.0\nelement camera 2\nproperty float a\nproperty uchar b\nelement vertex 2\n" + "".join(f"property float {a}\n" for a in "xyz") + "end_header\n"
    p.write_bytes(head.encode() + struct.pack("<fBfB", 9, 9, 9, 9) + struct.pack("<ffffff", 1, 2, 3, 4, 5, 6))
    assert {tuple(r)[1:4] for r in ply.read_ply(spark, str(p)).collect()} == {(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)}


@pytest.mark.parametrize(
    "text,message",
    [
        ("plx\nend_header\n", "not a PLY"),
        ("ply\nelement vertex 1\nend_header\n", "format"),
        ("ply\nformat ascii 1.0\nend_header\n", "vertex is missing"),
        ("ply\nformat ascii 1.0\nelement vertex 1\n", "end_header"),
        ("ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int i\nend_header\n", "list"),
        ("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nend_header\n", "z"),
        ("ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty half x\nproperty float y\nproperty float z\nend_header\n", "half"),
    ],
)
def test_bad_headers(text, message):
    with pytest.raises(ply.PlyError, match=message):
        ply.parse_header(text.encode())


def test_round_trip(spark, tmp_path, sf):
    from cloudloom.operators import clouds

    p = clouds.events(spark, sf).drop("ts")
    path = str(tmp_path / "out.ply")
    n = ply.write_ply(p, path)
    back = ply.read_ply(spark, path)
    assert back.count() == n == p.count()
    off = p.alias("a").join(back.alias("b"), "idx").filter("abs(a.x - b.x) > 1e-6 or abs(a.z - b.z) > 1e-6 or a.rgb != b.rgb or abs(a.intensity - b.intensity) > 1e-6")
    assert off.count() == 0
    info = ply.header_info(spark, path).first()
    assert (info["format"], info["vertices"]) == ("ascii", n)


def test_empty_cloud_and_missing_file(spark, tmp_path):
    with pytest.raises(ply.PlyError):
        ply.write_ply(spark.createDataFrame([], "idx long, x double, y double, z double"), str(tmp_path / "x.ply"))
    with pytest.raises(ply.PlyError, match="does not exist"):
        ply.read_header(str(tmp_path / "none.ply"))
