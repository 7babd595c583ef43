"""Kernels on small inputs with known results."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest

from terraloom.kernels import meshes, payloads, texts


def grid(n):
    xyz = np.array([[c, r, 0.0] for r in range(n) for c in range(n)])
    tri = [t for r in range(n - 1) for c in range(n - 1) for a in [r * n + c] for t in ((a, a + n, a + 1), (a + 1, a + n, a + n + 1))]
    return xyz, np.array(tri)


def test_winding_follows_the_majority():
    _, tri = grid(6)
    mixed = tri.copy()
    mixed[::4] = mixed[::4, ::-1]
    assert (np.sort(meshes.consistent_winding(mixed), 1) == np.sort(tri, 1)).all()
    xyz, _ = grid(6)
    z = lambda t: np.sign(np.cross(xyz[t[:, 1]] - xyz[t[:, 0]], xyz[t[:, 2]] - xyz[t[:, 0]])[:, 2])
    assert (z(meshes.consistent_winding(mixed)) == z(tri)).all()


def test_simplify_keeps_border_and_area():
    xyz, tri = grid(10)
    out = meshes.simplified(xyz, tri, 0.3, 0.01)
    area = lambda t: np.linalg.norm(np.cross(xyz[t[:, 1]] - xyz[t[:, 0]], xyz[t[:, 2]] - xyz[t[:, 0]]), axis=1).sum() / 2
    assert len(out) < len(tri) and math.isclose(area(out), area(tri))
    rim = {r * 10 + c for r in range(10) for c in range(10) if r in (0, 9) or c in (0, 9)}
    assert rim <= set(out.ravel().tolist())
    assert meshes.simplified(xyz, tri, 0.3, 0.0) is tri


def test_simplify_keeps_a_ridge():
    xyz, tri = grid(9)
    xyz[:, 2] = np.where(xyz[:, 0] == 4, 5.0, 0.0)
    out = meshes.simplified(xyz, tri, 0.0, 0.01)
    assert {r * 9 + 4 for r in (0, 8)} <= set(out.ravel().tolist())
    assert xyz[np.unique(out)][:, 2].max() == 5


def test_batch_table():
    d = lambda v: [("k", "double", v)]
    text, binary, odd = payloads.batch_table([d(1.5), d(2.5), d(3.5)])
    assert json.loads(text) == {"k": {"byteOffset": 0, "componentType": "DOUBLE", "type": "SCALAR"}} and len(binary) == 24 and odd == 0
    text, _, _ = payloads.batch_table([[("s", "string", "x")], [], [("s", "string", "z")]])
    assert json.loads(text) == {"s": ["x", None, "z"]}
    assert payloads.batch_table([[("s", "string", "")]])[0] == b"{}"
    text, _, _ = payloads.batch_table([[("i", "int64", 1099511627776)], [("i", "int64", 7)]])
    assert json.loads(text) == {"i": [1099511627776, 7]}
    text, _, odd = payloads.batch_table([d(math.nan), d(math.inf)])
    assert json.loads(text) == {"k": [None, None]} and odd == 2


def test_b3dm_alignment():
    plain = payloads.b3dm(b"x" * 13)
    assert len(plain) % 8 == 0 and plain[28:48] == b'{"BATCH_LENGTH":0}  '
    full = payloads.b3dm(b"glTF", 2, b'{"a":1}', b"12345")
    _, total, fj, fb, bj, bb = struct.unpack("<IIIIII", full[4:28])
    assert total == len(full) and (fj, fb, bb) == (20, 0, 8) and full[48 : 48 + 7] == b'{"a":1}' and (28 + fj + bj + bb) % 8 == 0


@pytest.mark.parametrize(("rows", "component"), [(2, 5121), (300, 5123), (100_000, 5126)])
def test_batch_ladder(rows, component):
    assert payloads.batch_component(rows) == component


def test_glb():
    xyz, tri = grid(3)
    data = payloads.glb([{"positions": xyz, "indices": tri, "batch_ids": [0] * 9}, {"positions": xyz[:2], "indices": tri}])
    size = struct.unpack("<I", data[12:16])[0]
    doc = json.loads(data[20 : 20 + size])
    assert len(data) == struct.unpack("<I", data[8:12])[0] and len(doc["meshes"][0]["primitives"]) == 1
    assert payloads.glb([{"positions": xyz, "indices": []}]) == b""


def test_quantized_mesh_round_trip():
    u, v, h = [0, 32767, 0, 32767], [0, 0, 32767, 32767], [5, 0, 100, 7]
    data = payloads.quantized_mesh(u, v, h, [[0, 1, 2], [1, 3, 2]], (1, 2, 3), 0, 9, (1, 2, 3), 4, (5, 6, 7), b"nn")
    assert struct.unpack("<I", data[88:92]) == (4,)
    z = np.frombuffer(data[92 : 92 + 24], "<u2").astype(int).reshape(3, 4)
    assert np.cumsum((z >> 1) ^ -(z & 1), 1).tolist() == [u, v, h]
    at = 92 + 24
    codes = np.frombuffer(data[at + 4 : at + 16], "<u2")
    high, out = 0, []
    for c in codes.tolist():
        out.append(high - c)
        high += c == 0
    assert out == [0, 1, 2, 1, 3, 2]


def test_png_and_render():
    image = np.full((4, 4, 3), 200, np.uint8)
    tile = payloads.rendered_tile(image, np.array([[0, 0], [8, 0], [0, 8], [8, 8]], float), 8)
    assert tile[..., 3].sum() == 16 * 255 and tile[0, 0, 0] == 200
    assert payloads.rendered_tile(image, np.array([[9, 9]] * 4, float), 8) is None
    assert payloads.png(tile).startswith(b"\x89PNG")


def test_ledger():
    text = '\ufeffname,height,count,note\nWall001,3.5,120,first\n"Wall002","4.25",80,"a ""b"", \nc"\nWall001,9,9,9\n,1,2,3\nWall003\n'
    header, rows, repeated = texts.ledger(text.encode())
    assert header == ["name", "height", "count", "note"] and repeated == 1
    assert [k for k, _ in rows] == ["Wall001", "Wall002", "Wall003"]
    assert rows[1][1] == [("4.25", True), ("80", False), ('a "b", \nc', True)] and rows[2][1] == [("", False)] * 3
    with pytest.raises(ValueError):
        texts.ledger(b"")


def test_json_keeps_tokens():
    text = '{"b":1.250,"a":[1e2,-0.5,null,true],"s":"\\u00e9/"}'
    assert texts.write_json(texts.parse_json(text)) == '{"b":1.250,"a":[1e2,-0.5,null,true],"s":"é/"}'
    for bad in ("01", "[1,]", "{} x", '"\\ud800"', "", "nul", "[" * 300 + "]" * 300):
        with pytest.raises(ValueError):
            texts.parse_json(bad)


def test_geojson():
    doc = texts.parse_json('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2],[3,4,5]]},"properties":{"v":1.250}},{"type":"Feature","geometry":null,"properties":{}}]}')
    out = texts.write_json(texts.transformed_geojson(doc, lambda x, y, z: (x + 1, y + 0.5, z * 2)))
    assert '"coordinates":[[2,2.5],[4,4.5,10]]' in out and '"v":1.250' in out and '"geometry":null' in out


def test_repair():
    assert texts.repaired("é".encode()) == ("é", False)
    assert texts.repaired("钢结构".encode("gb18030")) == ("钢结构", True)
    assert texts.repaired(b"a\xff")[0] == "a\ufffd"


def test_layer_json():
    doc = json.loads(payloads.layer_json([(0, 0, 0, 1, 0), (1, 2, 0, 3, 1)], 2, (-180, -90, 180, 90)))
    assert doc["maxzoom"] == 1 and doc["available"][1] == [{"startX": 2, "startY": 0, "endX": 3, "endY": 1}]


def test_tileset():
    box = [0, 0, 0, 5, 0, 0, 0, 5, 0, 0, 0, 5]
    cells = [{"level": 0, "ix": 1, "iy": 0, "iz": 0, "box": box, "error": 1.0, "content": "a.b3dm"}, {"level": 1, "ix": 0, "iy": 0, "iz": 0, "box": box, "error": 2.0, "content": None}, {"level": 1, "ix": 5, "iy": 0, "iz": 0, "box": box, "error": 2.0, "content": None}]
    doc = json.loads(payloads.tileset(cells, 1, 9.0))
    assert len(doc["root"]["children"]) == 1 and doc["root"]["children"][0]["children"][0]["content"]["uri"] == "a.b3dm"
