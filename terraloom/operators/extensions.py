"""What can be added from outside: georeferencing kinds, attribute bindings by format, vendor layouts.

Each is a table from a name to functions over DataFrames or Columns; ``register`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import crs, geodesy, strings
from . import binding, hierarchy


@dataclass(frozen=True)
class Georeferencing:
    """``forward`` takes rows with x, y, z of the source to ECEF in the same columns."""

    forward: Callable[[DataFrame], DataFrame]

    def to_ecef(self, df: DataFrame) -> DataFrame:
        return self.forward(df)


def _identity(source: str) -> Georeferencing:
    return Georeferencing(lambda df: crs.transformed(df, source, "EPSG:4978"))


def _seven(tm: geodesy.TransverseMercator, helmert: geodesy.Helmert) -> Georeferencing:
    def forward(df: DataFrame) -> DataFrame:
        df = geodesy.with_seven_parameters(df, "x", "y", "z", tm, helmert).withColumns({"y": F.degrees("lat"), "x": F.degrees("lon"), "z": F.col("alt")})
        return crs.transformed(df.drop("lat", "lon", "alt"), "EPSG:4326", "EPSG:4978")

    return Georeferencing(forward)


def _anchor(source: str, anchor: tuple[float, float, float], ecef: tuple[float, float, float]) -> Georeferencing:
    return Georeferencing(lambda df: crs.anchored(df, source, anchor, ecef))


def _positions(matrix: list[float]) -> Georeferencing:
    """An affine fit to control points: 12 numbers, three rows of a 3x4 matrix."""
    if len(matrix) != 12:
        raise EngineError("FitFailed", "an affine fit has 12 numbers")

    def forward(df: DataFrame) -> DataFrame:
        new = [sum((F.col(c) * F.lit(matrix[4 * i + j]) for j, c in enumerate("xyz")), F.lit(matrix[4 * i + 3])) for i in range(3)]
        return df.withColumns(dict(zip("xyz", new, strict=True)))

    return Georeferencing(forward)


GEOREFERENCING: dict[str, Callable[..., Georeferencing]] = {
    "none": lambda: Georeferencing(lambda df: df),
    "identity": _identity,
    "seven_parameters": _seven,
    "anchor": _anchor,
    "multi_position": _positions,
}


def georeferencing(kind: str, **arguments) -> Georeferencing:
    if kind not in GEOREFERENCING:
        raise EngineError("GeoreferencingNotInitialized", f"no georeferencing {kind}")
    return GEOREFERENCING[kind](**arguments)


@dataclass(frozen=True)
class Binding:
    """How objects of a model format are told apart: whether nodes carry properties, and where the id comes from.

    ``object_id`` takes properties (an array of key and value), the names of the node and of
    its mesh, and the wanted id keys; it gives the id and the name of its source.
    """

    title: str
    scene_rows: bool
    object_id: Callable[[Column, Column, Column, tuple[str, ...]], tuple[Column, Column]]
    object_class: Callable[[Column, Column], Column] = lambda node, mesh: F.lit(None).cast("string")


def _by_keys(props: Column, node: Column, mesh: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    return binding.resolved_id([("metadata_key", binding.key_value(props, keys)), ("object_name", node)])


def _by_name_tail(props: Column, node: Column, mesh: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    return binding.resolved_id([("name_tail", strings.ifc_guid_tail(F.coalesce(strings.null_if_empty(node), mesh)))])


def _by_name(props: Column, node: Column, mesh: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    return binding.resolved_id([("object_name", node)])


def _by_either_name(props: Column, node: Column, mesh: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    return binding.resolved_id([("object_name", strings.object_or_mesh_name(node, mesh))])


#: Keys that hold an object's id, in order.
ID_KEYS = ("GlobalId", "ElementId", "ifcGUID", "UniqueId")

#: By the names that ``strings.normalised_format`` gives.
BINDINGS: dict[str, Binding] = {
    "ifc": Binding("IFC", True, _by_name_tail, lambda node, mesh: strings.ifc_class(F.coalesce(strings.null_if_empty(node), mesh))),
    "fbx": Binding("FBX", True, _by_keys),
    "gltf2": Binding("glTF2", True, _by_keys),
    "obj": Binding("OBJ", False, _by_name),
    "3ds": Binding("3DS", False, _by_either_name),
    "generic": Binding("Generic", True, _by_keys),
}


def bound_ids(objects: DataFrame, keys: tuple[str, ...] = ID_KEYS) -> DataFrame:
    """Adds object_id, id_source and object_class to objects (format, props, node, mesh), each by its format's binding."""
    kind = strings.normalised_format(F.col("format"))
    args = F.col("props"), F.col("node"), F.col("mesh")
    value, source, named = (F.lit(None).cast("string") for _ in range(3))
    for name, b in BINDINGS.items():
        i, s = b.object_id(*args, keys)
        value, source = F.when(kind == name, i).otherwise(value), F.when(kind == name, s).otherwise(source)
        named = F.when(kind == name, b.object_class(*args[1:])).otherwise(named)
    return objects.withColumns({"object_id": value, "id_source": source, "object_class": named})


@dataclass(frozen=True)
class Vendor:
    """A vendor's layout: its tile paths parsed, and its tiles with their parents."""

    parse: Callable[[Column], Column]
    tree: Callable[[DataFrame], DataFrame]


VENDORS: dict[str, Vendor] = {}


def register_vendor(name: str, vendor: Vendor) -> None:
    if name in VENDORS:
        raise EngineError("InvalidArgument", f"{name} is registered already")
    VENDORS[name] = vendor


VENDORS["context_capture"] = Vendor(strings.cc_tile, hierarchy.cc_parents)
VENDORS["dji"] = Vendor(strings.dji_tile, hierarchy.dji_groups)
