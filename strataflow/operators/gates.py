"""Region filters on channels and the populations they define, as boolean columns of one projection.

A gate is a declaration: its kind, the channels it looks at (each with an optional scale), its geometry
and its parent. `populations` turns a tree of gates into one select that adds a flag per population, so a
whole tree costs one scan; Catalyst prunes the channels no gate uses.

Rectangles are half-open, open where a bound is None; polygons are even-odd with their edges inside;
ellipses and ellipsoids are closed. A null or NaN channel value lies in no gate. A gate with a scope
applies to the samples of that scope only; elsewhere its population is null, as are those below it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scale = Callable[[Column], Column]


@dataclass(frozen=True)
class Gate:
    """kind: rectangle, split, quadrant, polygon, ellipse, ellipsoid, category, and, or, not."""

    name: str
    kind: str
    dims: tuple[str, ...] = ()
    geometry: dict = field(default_factory=dict)
    parent: str | None = None
    operands: tuple[str, ...] = ()
    scales: tuple[Scale | None, ...] = ()
    #: Geometries that hold instead for single samples.
    overrides: dict = field(default_factory=dict)
    #: Samples the gate applies to; None for all.
    scope: tuple | None = None


def finite(c: Column) -> Column:
    """True for numbers other than NaN; false for null."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")), F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def rectangle(xs: list[Column], low: list, high: list) -> Column:
    parts = [finite(x) for x in xs]
    for x, a, b in zip(xs, low, high):
        if a is not None:
            parts.append(x >= F.lit(a))
        if b is not None:
            parts.append(x < F.lit(b))
    return _all(parts)


def polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule with the edges inside; the bounding box is tested first."""
    edges = list(zip(vertices, vertices[1:] + vertices[:1]))
    on_edge, crossings = F.lit(False), F.lit(0)
    for (ax, ay), (bx, by) in edges:
        cross = (x - F.lit(ax)) * F.lit(by - ay) - (y - F.lit(ay)) * F.lit(bx - ax)
        between = x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
        on_edge = on_edge | ((cross == 0) & between)
        if ay != by:
            meets = (F.lit(ay) > y) != (F.lit(by) > y)
            left = x < F.lit((bx - ax) / (by - ay)) * (y - F.lit(ay)) + F.lit(ax)
            crossings = crossings + F.when(meets & left, 1).otherwise(0)
    px, py = zip(*vertices)
    box = x.between(min(px), max(px)) & y.between(min(py), max(py))
    return finite(x) & finite(y) & box & (on_edge | (crossings % 2 == 1))


def ellipsoid(xs: list[Column], center: list[float], inverse: list[list[float]], distance: float) -> Column:
    """Squared Mahalanobis distance of at most distance squared; `inverse` is the inverse covariance."""
    d = [x - F.lit(c) for x, c in zip(xs, center)]
    terms = [d[i] * d[j] * F.lit(inverse[i][j]) for i in range(len(d)) for j in range(len(d)) if inverse[i][j] != 0]
    return _all([finite(x) for x in xs]) & (reduce(lambda a, b: a + b, terms) <= F.lit(distance * distance))


def _predicate(kind: str, xs: list[Column], g: dict) -> Column:
    if kind == "rectangle":
        return rectangle(xs, g["min"], g["max"])
    if kind == "split":  # the high side needs a finite value, the low side takes minus infinity
        x, at = xs[0], F.lit(g["at"])
        return finite(x) & ((x >= at) & (x < F.lit(float("inf"))) if g["side"] == "high" else x < at)
    if kind == "quadrant":
        sides = [(x >= F.lit(c)) & (x < F.lit(float("inf"))) if up == "+" else x < F.lit(c) for x, c, up in zip(xs, g["center"], g["sign"])]
        return _all([finite(x) for x in xs] + sides)
    if kind == "polygon":
        return polygon(xs[0], xs[1], g["vertices"])
    if kind in ("ellipse", "ellipsoid"):
        return ellipsoid(xs, g["center"], g["inverse"], g.get("distance", 1.0))
    if kind == "category":
        return finite(xs[0]) & F.round(xs[0]).cast("long").isin(*g["values"])
    raise ValueError(f"unknown kind of gate: {kind}")


def _own(gate: Gate, sample: Column | None) -> Column:
    scales = gate.scales or (None,) * len(gate.dims)
    xs = [s(F.col(c)) if s else F.col(c) for c, s in zip(gate.dims, scales)]
    out = _predicate(gate.kind, xs, gate.geometry)
    if gate.overrides:
        chain = None
        for key, geometry in gate.overrides.items():
            hit = _predicate(gate.kind, xs, gate.geometry | geometry)
            chain = F.when(sample == F.lit(key), hit) if chain is None else chain.when(sample == F.lit(key), hit)
        out = chain.otherwise(out)
    return out


def _order(gates: list[Gate]) -> list[Gate]:
    """Parents and operands before the gates that use them; refuses cycles and unknown names."""
    by_name = {g.name: g for g in gates}
    done: dict[str, Gate] = {}

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"gate {name} depends on itself")
        if name not in done:
            gate = by_name[name]
            for other in (gate.parent, *gate.operands):
                if other is not None:
                    visit(other, (*above, name))
            done[name] = gate

    for gate in gates:
        visit(gate.name, ())
    return list(done.values())


def expressions(gates: list[Gate], sample: str | None = None) -> dict[str, Column]:
    """The flag of each population as a column over the events."""
    out: dict[str, Column] = {}
    key = F.col(sample) if sample else None
    for gate in _order(gates):
        parent = out[gate.parent] if gate.parent else F.lit(True)
        if gate.kind in ("and", "or", "not"):
            parts = [out[o] for o in gate.operands]
            if gate.kind == "and":
                own = _all(parts) if parts else F.lit(False)
            else:
                own = reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
                own = ~own if gate.kind == "not" else own
        else:
            own = _own(gate, key)
        flag = parent & own
        out[gate.name] = F.when(key.isin(*gate.scope), flag) if gate.scope is not None else flag
    return out


def populations(events: DataFrame, gates: list[Gate], sample: str | None = None, prefix: str = "pop_") -> DataFrame:
    """The events with one flag per population."""
    return events.withColumns({prefix + name: c for name, c in expressions(gates, sample).items()})


def summary(events: DataFrame, gates: list[Gate], sample: str) -> DataFrame:
    """Per sample and population: count, percent of the parent and of all events; percent null where the base is empty.

    One aggregation with a count per population, whatever the tree's size; only its few results are unfolded.
    """
    flags = expressions(gates, sample)
    counts = events.groupBy(sample).agg(F.count("*").alias("all"), *[F.count_if(c).alias(f"n_{name}") for name, c in flags.items()])
    parent = {g.name: f"n_{g.parent}" if g.parent else "all" for g in gates}
    percent = lambda n, base: F.when(F.col(base) > 0, 100.0 * F.col(n) / F.col(base))
    rows = [F.struct(F.lit(name).alias("population"), F.col(f"n_{name}").alias("count"), percent(f"n_{name}", parent[name]).alias("percent_parent"), percent(f"n_{name}", "all").alias("percent_total")) for name in flags]
    return counts.select(sample, F.inline(F.array(*rows)))


def frequencies(events: DataFrame, gates: list[Gate], sample: str, of: str, beads: str, bead_total: float, volume: Column, dilution: Column) -> DataFrame:
    """Further frequencies of each population, from the counts of one scan.

    `percent_grandparent` (of the parent's parent, all events where there is none), `percent_of` (of the population
    `of`), `concentration` (events in the `volume` acquired, times the `dilution`; both aggregates of the sample) and
    `absolute` (events per bead of the population `beads`, times the beads added, over the volume). Null where the base is 0.
    """
    flags, by_name = expressions(gates, sample), {g.name: g for g in gates}
    counts = events.groupBy(sample).agg(F.count("*").alias("all"), volume.alias("_volume"), dilution.alias("_dilution"), *[F.count_if(c).alias(f"n_{name}") for name, c in flags.items()])
    over = lambda a, b: F.when(b > 0, a / b)

    def row(name: str) -> Column:
        parent = by_name[name].parent
        above = by_name[parent].parent if parent else None
        n = F.col(f"n_{name}")
        return F.struct(
            F.lit(name).alias("population"),
            over(100.0 * n, F.col(f"n_{above}" if above else "all")).alias("percent_grandparent"),
            over(100.0 * n, F.col(f"n_{of}")).alias("percent_of"),
            (over(n, F.col("_volume")) * F.col("_dilution")).alias("concentration"),
            (over(n * F.lit(bead_total), F.col(f"n_{beads}")) * over(F.lit(1.0), F.col("_volume"))).alias("absolute"),
        )

    return counts.select(sample, F.inline(F.array(*[row(name) for name in flags])))


def quadrants(name: str, dims: tuple[str, str], center: tuple[float, float], parent: str | None = None) -> list[Gate]:
    """Four linked gates that part their parent."""
    return [Gate(f"{name}{a}{b}", "quadrant", dims, {"center": center, "sign": (a, b)}, parent) for a in "+-" for b in "+-"]


def robustness(events: DataFrame, make: Callable[[float], Column], sample: str, offsets: tuple[float, ...] = (-0.02, -0.01, -0.005, 0.0, 0.005, 0.01, 0.02)) -> DataFrame:
    """Share of events (percent) inside a gate moved by each offset, all in one scan."""
    shares = events.groupBy(sample).agg(*[(100.0 * F.count_if(make(o)) / F.count("*")).alias(f"o{k}") for k, o in enumerate(offsets)])
    return shares.select(sample, F.inline(F.array(*[F.struct(F.lit(o).alias("offset"), F.col(f"o{k}").alias("percent")) for k, o in enumerate(offsets)])))
