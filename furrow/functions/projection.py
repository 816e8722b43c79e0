"""UTM <-> WGS-84 as columns, by the published Krueger series (order 3).

Each step that is used more than once becomes a column of its own, so that the
generated code stays in small methods, and the results are ``with_computed`` so
that filters on them do not repeat the series.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from furrow.operators.columns import with_computed

# The WGS-84 ellipsoid and the UTM grid.
_A = 6378137.0
_F = 1 / 298.257223563
K0 = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_N = _F / (2 - _F)
RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECC = 2 * math.sqrt(_N) / (1 + _N)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)

WGS84 = 4326


_CORNERS = [(i, j) for j in (0, 1) for i in (0, 1)]
_GRID_SCALE = K0 * RADIUS


def _n(value: float) -> str:
    """A double literal in SQL text."""
    return f"{value!r}D"


def _meridian(epsg: str) -> str:
    """Longitude of the zone's central meridian, in degrees."""
    return f"(({epsg} % 100) * 6.0D - 183.0D)"


def _false_northing(epsg: str) -> str:
    return f"(case when {epsg} div 100 = 327 then {_n(FALSE_NORTHING_SOUTH)} else 0.0D end)"


def _series(coef, u: str, v: str | None, trig_u: str, trig_v: str | None) -> str:
    """Sum of k_j * trig_u(2 j u) * trig_v(2 j v)."""
    terms = []
    for j, k in enumerate(coef, start=1):
        term = f"{_n(k)} * {trig_u}({_n(2.0 * j)} * {u})"
        terms.append(f"{term} * {trig_v}({_n(2.0 * j)} * {v})" if trig_v else term)
    return "(" + " + ".join(terms) + ")"


def _with_exprs(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Many arithmetic columns at once, from SQL text: one call to the driver's
    JVM per column and not one per operation."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def bounds_to_utm(df: DataFrame, x0: str, y0: str, x1: str, y1: str, epsg: str, prefix: str = "u") -> DataFrame:
    """Add ``{prefix}x0..y1``: min/max of the four projected corners.

    Rows with EPSG 4326 keep their bounds.
    """
    p = f"_{prefix}"
    lon, lat = (x0, x1), (y0, y1)
    df = _with_exprs(
        df,
        {
            **{f"{p}s{j}": f"sin(radians({lat[j]}))" for j in (0, 1)},
            **{f"{p}l{i}": f"radians({lon[i]} - {_meridian(epsg)})" for i in (0, 1)},
        },
    )
    df = _with_exprs(df, {f"{p}t{j}": f"sinh(atanh({p}s{j}) - {_n(ECC)} * atanh({_n(ECC)} * {p}s{j}))" for j in (0, 1)})
    df = _with_exprs(
        df,
        {
            **{f"{p}xi{i}{j}": f"atan({p}t{j} / cos({p}l{i}))" for i, j in _CORNERS},
            **{f"{p}eta{i}{j}": f"atanh(sin({p}l{i}) / sqrt(1.0D + {p}t{j} * {p}t{j}))" for i, j in _CORNERS},
        },
    )
    columns = {}
    for i, j in _CORNERS:
        xi, eta = f"{p}xi{i}{j}", f"{p}eta{i}{j}"
        columns[f"{p}e{i}{j}"] = f"{_n(FALSE_EASTING)} + {_n(_GRID_SCALE)} * ({eta} + {_series(ALPHA, xi, eta, 'cos', 'sinh')})"
        columns[f"{p}n{i}{j}"] = (
            f"{_false_northing(epsg)} + {_n(_GRID_SCALE)} * ({xi} + {_series(ALPHA, xi, eta, 'sin', 'cosh')})"
        )
    return _min_max(_with_exprs(df, columns), p, prefix, epsg, (x0, y0, x1, y1))


def bounds_to_wgs84(df: DataFrame, x0: str, y0: str, x1: str, y1: str, epsg: str, prefix: str = "g") -> DataFrame:
    """Add ``{prefix}x0..y1``: min/max of the four corners in degrees."""
    p = f"_{prefix}"
    east, north = (x0, x1), (y0, y1)
    df = _with_exprs(
        df,
        {
            **{f"{p}h{i}": f"({east[i]} - {_n(FALSE_EASTING)}) / {_n(_GRID_SCALE)}" for i in (0, 1)},
            **{f"{p}k{j}": f"({north[j]} - {_false_northing(epsg)}) / {_n(_GRID_SCALE)}" for j in (0, 1)},
        },
    )
    df = _with_exprs(
        df,
        {
            **{f"{p}xi{i}{j}": f"{p}k{j} - {_series(BETA, f'{p}k{j}', f'{p}h{i}', 'sin', 'cosh')}" for i, j in _CORNERS},
            **{f"{p}eta{i}{j}": f"{p}h{i} - {_series(BETA, f'{p}k{j}', f'{p}h{i}', 'cos', 'sinh')}" for i, j in _CORNERS},
        },
    )
    df = _with_exprs(df, {f"{p}chi{i}{j}": f"asin(sin({p}xi{i}{j}) / cosh({p}eta{i}{j}))" for i, j in _CORNERS})
    columns = {}
    for i, j in _CORNERS:
        xi, eta, chi = f"{p}xi{i}{j}", f"{p}eta{i}{j}", f"{p}chi{i}{j}"
        columns[f"{p}e{i}{j}"] = f"{_meridian(epsg)} + degrees(atan(sinh({eta}) / cos({xi})))"
        columns[f"{p}n{i}{j}"] = f"degrees({chi} + {_series(DELTA, chi, None, 'sin', None)})"
    return _min_max(_with_exprs(df, columns), p, prefix, epsg, (x0, y0, x1, y1))


def _min_max(df: DataFrame, p: str, prefix: str, epsg: str, plain) -> DataFrame:
    def pick(fn: str, axis: str) -> str:
        return f"{fn}({', '.join(f'{p}{axis}{i}{j}' for i, j in _CORNERS)})"

    columns = {
        f"{prefix}{name}": F.expr(f"case when {epsg} = {WGS84} then {raw} else {pick(fn, axis)} end")
        for name, raw, fn, axis in (
            ("x0", plain[0], "least", "e"),
            ("y0", plain[1], "least", "n"),
            ("x1", plain[2], "greatest", "e"),
            ("y1", plain[3], "greatest", "n"),
        )
    }
    done = with_computed(df, columns)
    return done.select(*[c for c in done.columns if not c.startswith(p)])
