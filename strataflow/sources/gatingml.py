"""Gating-ML 2.0 documents as gates and back: rectangles, polygons, ellipsoids, Boolean gates and quadrants."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import numpy as np

from strataflow.operators.gates import Gate

# The name spaces of Gating-ML 2.0.
GATING = "http://www.isac-net.org/std/Gating-ML/v2.0/gating"
TYPES = "http://www.isac-net.org/std/Gating-ML/v2.0/datatypes"


def _tag(space: str, name: str) -> str:
    return f"{{{space}}}{name}"


def _dims(node: ET.Element) -> tuple[str, ...]:
    return tuple(x.get(_tag(TYPES, "name")) for x in node.iter(_tag(TYPES, "fcs-dimension")))


def read(text: str) -> list[Gate]:
    """The gates of a document. Gates of other kinds are refused."""
    out = []
    for node in ET.fromstring(text):
        kind = node.tag.partition("}")[2]
        name, parent = node.get(_tag(GATING, "id")), node.get(_tag(GATING, "parent_id"))
        if kind == "RectangleGate":
            bound = lambda d, k: float(v) if (v := d.get(_tag(GATING, k))) is not None else None
            dims = node.findall(_tag(GATING, "dimension"))
            out.append(Gate(name, "rectangle", _dims(node), {"min": [bound(d, "min") for d in dims], "max": [bound(d, "max") for d in dims]}, parent))
        elif kind == "PolygonGate":
            points = [tuple(float(c.get(_tag(TYPES, "value"))) for c in v.findall(_tag(GATING, "coordinate"))) for v in node.findall(_tag(GATING, "vertex"))]
            out.append(Gate(name, "polygon", _dims(node), {"vertices": points}, parent))
        elif kind == "EllipsoidGate":
            values = lambda tag: [float(c.get(_tag(TYPES, "value"))) for c in node.find(_tag(GATING, tag)).iter() if c.get(_tag(TYPES, "value"))]  # noqa: E731, B023
            n = len(_dims(node))
            covariance = np.array(values("covarianceMatrix")).reshape(n, n)
            square = float(node.find(_tag(GATING, "distanceSquare")).get(_tag(TYPES, "value")))
            out.append(Gate(name, "ellipsoid", _dims(node), {"center": values("mean"), "inverse": np.linalg.inv(covariance).tolist(), "distance": square**0.5}, parent))
        elif kind == "BooleanGate":
            op = next(x for x in node if x.tag.partition("}")[2] in ("and", "or", "not"))
            refs = tuple(r.get(_tag(GATING, "ref")) for r in op.findall(_tag(GATING, "gateReference")))
            out.append(Gate(name, op.tag.partition("}")[2], parent=parent, operands=refs))
        else:
            raise ValueError(f"{kind} can't be read")
    return out


def write(gates: list[Gate]) -> str:
    ET.register_namespace("gating", GATING)
    ET.register_namespace("data-type", TYPES)
    root = ET.Element(_tag(GATING, "Gating-ML"))
    kinds = {"rectangle": "RectangleGate", "polygon": "PolygonGate", "ellipse": "EllipsoidGate", "ellipsoid": "EllipsoidGate", "and": "BooleanGate", "or": "BooleanGate", "not": "BooleanGate"}
    for gate in gates:
        if gate.kind not in kinds:
            raise ValueError(f"{gate.kind} can't be written")
        node = ET.SubElement(root, _tag(GATING, kinds[gate.kind]), {_tag(GATING, "id"): gate.name} | ({_tag(GATING, "parent_id"): gate.parent} if gate.parent else {}))
        g = gate.geometry
        for k, channel in enumerate(gate.dims):
            ends = {_tag(GATING, e): repr(float(g[e][k])) for e in ("min", "max") if gate.kind == "rectangle" and g[e][k] is not None}
            ET.SubElement(ET.SubElement(node, _tag(GATING, "dimension"), ends), _tag(TYPES, "fcs-dimension"), {_tag(TYPES, "name"): channel})
        value = lambda at, tag, v: ET.SubElement(at, _tag(GATING, tag), {_tag(TYPES, "value"): repr(float(v))})
        if gate.kind == "polygon":
            for point in g["vertices"]:
                vertex = ET.SubElement(node, _tag(GATING, "vertex"))
                for c in point:
                    value(vertex, "coordinate", c)
        elif gate.kind in ("ellipse", "ellipsoid"):
            mean = ET.SubElement(node, _tag(GATING, "mean"))
            for c in g["center"]:
                value(mean, "coordinate", c)
            matrix = ET.SubElement(node, _tag(GATING, "covarianceMatrix"))
            for line in np.linalg.inv(np.array(g["inverse"], float)):
                row = ET.SubElement(matrix, _tag(GATING, "row"))
                for c in line:
                    value(row, "entry", c)
            value(node, "distanceSquare", g.get("distance", 1.0) ** 2)
        elif gate.operands or gate.kind in ("and", "or", "not"):
            op = ET.SubElement(node, _tag(GATING, gate.kind))
            for o in gate.operands:
                ET.SubElement(op, _tag(GATING, "gateReference"), {_tag(GATING, "ref"): o})
    return ET.tostring(root, encoding="unicode")
