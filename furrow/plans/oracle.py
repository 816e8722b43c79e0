"""DuckDB SQL each registered query is checked with.

Written in relational form on purpose: pixels are rows here and arrays in the
Spark code, joins are plain, and ranks are ordinary window functions.
"""

from __future__ import annotations

from furrow import fixtures as fx
from furrow.functions.labels import COMPOUND_LABELS
from furrow.operators.ml import LEAST_VARIANCE, NEWTON_STEPS, RIDGE
from furrow.operators.transforms import GOLDEN, MIX, SECOND_LANE
from furrow.plans import queries as q
from furrow.sources.scenes import AOI_PRESETS


# The scale of UTM, the rectifying radius and eccentricity of WGS-84,
# and the transverse Mercator series to the third order for that ellipsoid.
K0 = 0.9996
RADIUS = 6367449.145823415
ECC = 0.08181919084262149
ALPHA = (0.0008377318188192541, 7.608496958699166e-07, 1.2034877875966646e-09)
BETA = (0.000837732164082144, 5.906110863719917e-08, 1.6769911794379754e-10)
DELTA = (0.003356551448628875, 6.571913193172695e-06, 1.76774599620756e-08)


def values(rows, name: str, cols: str) -> str:
    text = ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else f"'{v}'" for v in row) + ")" for row in rows)
    return f"select * from (values {text}) as {name}({cols})"


def r(expr: str, places: int = 6) -> str:
    return f"(round(cast({expr} as double), {places}) + cast(0 as double))"


def d(value: float) -> str:
    return f"cast({value!r} as double)"


def digest(*parts) -> str:
    return f"md5(concat_ws(':', {', '.join(str(p) for p in parts)}))"


def lane(text: str, i: int = 0) -> str:
    return f"cast('0x' || substr({text}, {i * 8 + 1}, 8) as bigint)"


def uniform(*parts) -> str:
    return f"(cast({lane(digest(*parts))} as double) / {d(float(2**32))})"


def _poly(coef, u: str, v: str, a: str, b: str) -> str:
    return " + ".join(f"{d(k)} * {a}({2.0 * j} * {u}){f' * {b}({2.0 * j} * {v})' if b else ''}" for j, k in enumerate(coef, 1))


def utm(src: str, x0: str, y0: str, x1: str, y1: str, p: str) -> str:
    """``src`` with projected bounds ``{p}x0..{p}y1`` added."""
    lam = "radians((epsg % 100) * 6.0::double - 183.0::double)"
    steps = [
        f"select *, sin(radians({y0})) s0_, sin(radians({y1})) s1_, radians({x0}) - {lam} l0_, radians({x1}) - {lam} l1_ from {src}",
        f"select *, sinh(atanh(s0_) - {d(ECC)} * atanh({d(ECC)} * s0_)) t0_, sinh(atanh(s1_) - {d(ECC)} * atanh({d(ECC)} * s1_)) t1_ from (@)",
        "select *, "
        + ", ".join(
            f"atan(t{j}_ / cos(l{i}_)) xi{i}{j}_, atanh(sin(l{i}_) / sqrt(1 + t{j}_ * t{j}_)) eta{i}{j}_" for i in (0, 1) for j in (0, 1)
        )
        + " from (@)",
        "select *, "
        + ", ".join(
            f"500000 + {d(K0 * RADIUS)} * (eta{i}{j}_ + {_poly(ALPHA, f'xi{i}{j}_', f'eta{i}{j}_', 'cos', 'sinh')}) e{i}{j}_, "
            f"case when epsg // 100 = 327 then 10000000 else 0 end + {d(K0 * RADIUS)} * (xi{i}{j}_ + {_poly(ALPHA, f'xi{i}{j}_', f'eta{i}{j}_', 'sin', 'cosh')}) n{i}{j}_"
            for i in (0, 1)
            for j in (0, 1)
        )
        + " from (@)",
    ]
    return _bounds(steps, p)


def wgs(src: str, x0: str, y0: str, x1: str, y1: str, p: str) -> str:
    """``src`` with geographic bounds ``{p}x0..{p}y1`` added."""
    scale = d(K0 * RADIUS)
    north = "case when epsg // 100 = 327 then 10000000 else 0 end"
    pairs = [(i, j) for i in (0, 1) for j in (0, 1)]
    steps = [
        f"select *, ({x0} - 500000) / {scale} h0_, ({x1} - 500000) / {scale} h1_, ({y0} - {north}) / {scale} k0_, ({y1} - {north}) / {scale} k1_ from {src}",
        "select *, "
        + ", ".join(
            f"k{j}_ - ({_poly(BETA, f'k{j}_', f'h{i}_', 'sin', 'cosh')}) xi{i}{j}_, h{i}_ - ({_poly(BETA, f'k{j}_', f'h{i}_', 'cos', 'sinh')}) eta{i}{j}_"
            for i, j in pairs
        )
        + " from (@)",
        "select *, " + ", ".join(f"asin(sin(xi{i}{j}_) / cosh(eta{i}{j}_)) chi{i}{j}_" for i, j in pairs) + " from (@)",
        "select *, "
        + ", ".join(
            f"(epsg % 100) * 6.0::double - 183.0::double + degrees(atan(sinh(eta{i}{j}_) / cos(xi{i}{j}_))) e{i}{j}_, "
            f"degrees(chi{i}{j}_ + {_poly(DELTA, f'chi{i}{j}_', '', 'sin', '')}) n{i}{j}_"
            for i, j in pairs
        )
        + " from (@)",
    ]
    return _bounds(steps, p)


def _bounds(steps: list[str], p: str) -> str:
    sql = steps[0]
    for step in steps[1:]:
        sql = step.replace("@", sql)
    return (
        f"select * exclude (e00_), least(e00_, e01_, e10_, e11_) {p}x0, least(n00_, n01_, n10_, n11_) {p}y0, "
        f"greatest(e00_, e01_, e10_, e11_) {p}x1, greatest(n00_, n01_, n10_, n11_) {p}y1 from ({sql})"
    )


SERIES_DIGITS = ", ".join(f"({i})" for i in range(16))
_NAMES = ["orders", "customer", "nation", "region", "supplier"]
_BANDS = list(enumerate(fx.BANDS))

CTES: dict[str, tuple[list[str], str]] = {
    "fields": ([], fx.FIELDS_SQL.format(**{n: n for n in _NAMES})),
    "scenes": ([], fx.SCENES_SQL.format(**{n: n for n in _NAMES})),
    "footed": (["scenes"], "select * from scenes where geom_type is not null"),
    "windows": ([], values([(i, a, b) for i, a, b in fx.WINDOWS], "w", "window_idx, a, b")),
    "bands": ([], values(_BANDS, "b", "band_idx, band")),
    "assets": (
        ["scenes", "bands"],
        "select scene_id, scene_k, band_idx, band, concat(scene_id, '_', band, '.tif') as path"
        " from scenes cross join bands where has_b12 or band <> 'B12'",
    ),
    "manifest": (["assets"], "select path from assets where (scene_k + band_idx) % 5 = 0"),
    "results": (["assets"], "select path, (scene_k * 3 + band_idx) % 7 <> 0 as ok from assets"),
    "bounded": (
        ["fields"],
        "select *, list_min(xs) x0, list_min(ys) y0, list_max(xs) x1, list_max(ys) y1 from (select *,"
        " case when geom_2 like '%((%' and not (field_id % 67 = 0 and geom_2 like 'POLYGON%') then [cast(v as double) for v in regexp_extract_all(geom_2, '([0-9.]+) ([0-9.]+)', 1)] end xs,"
        " case when geom_2 like '%((%' and not (field_id % 67 = 0 and geom_2 like 'POLYGON%') then [cast(v as double) for v in regexp_extract_all(geom_2, '([0-9.]+) ([0-9.]+)', 2)] end ys"
        " from fields)",
    ),
    "normed": (
        ["bounded"],
        "select * exclude (crop_type), case trim(lower(crop_type)) "
        + " ".join(f"when '{k}' then '{v}'" for k, v in COMPOUND_LABELS.items())
        + " else trim(lower(crop_type)) end as crop_type from bounded",
    ),
    "exported": (["normed"], "select * from normed where (geom_2 like '%EMPTY' or x0 is not null) and crop_type is not null"),
    "counts": (
        ["fields"],
        "select viloyat, tuman, tuman_code, count(*) as polygons from fields where tuman_code is not null group by all",
    ),
    "top": (
        ["counts"],
        "select * from (select *, cast(row_number() over (partition by region order by viloyat asc nulls first, polygons desc, tuman_code, tuman) as int)"
        " as rank from (select *, trim(coalesce(nullif(viloyat, ''), 'unknown')) as region from counts)) where rank <= 3",
    ),
    "dated": (
        ["footed"],
        "select *, cast(acq_date as timestamp) + to_hours(cast((scene_k * 7) % 24 as int)) as datetime from footed",
    ),
    "best": (
        ["bounded", "footed"],
        "select field_id, min(struct_pack(cloud_cover := cloud_cover, scene_id := scene_id)) as b from bounded join footed"
        " on x0 <= lon_max and x1 >= lon_min and y0 <= lat_max and y1 >= lat_min where cloud_cover < 20 group by field_id",
    ),
    "obs": (
        ["fields", "windows"],
        "select f.field_id, w.window_idx, b.band_idx, b.band, b.res, h, w, cast(yy.i as int) y, cast(xx.i as int) x,"
        " cast((f.field_id * 31 + w.window_idx * 997 + b.band_idx * 131 + yy.i * 17 + xx.i * 7) % 10000 as int) as dn"
        " from (select f.*, w.window_idx, b.*, cast(ceil((1 + field_id % 6) / case when res > 0.00015 then 2 else 1 end) as int) h,"
        " cast(ceil((1 + field_id % 5) / case when res > 0.00015 then 2 else 1 end) as int) w"
        " from (select field_id from fields) f cross join windows w cross join ("
        + values(fx.OBS_BANDS, "b", "band_idx, band, res")
        + ") b) b join fields f on f.field_id = b.field_id join windows w on w.window_idx = b.window_idx"
        f" join (values {SERIES_DIGITS}) as yy(i) on yy.i < h join (values {SERIES_DIGITS}) as xx(i) on xx.i < w"
        " where (f.field_id + w.window_idx) % 4 <> 0 and (2 * f.field_id + w.window_idx) % 5 <> 0",
    ),
    "obs_keys": (["obs"], "select distinct field_id, window_idx, band_idx, band, res, h, w from obs"),
    "resized": (
        ["obs", "obs_keys"],
        "with axis as (select n, o, cast(floor(s) as int) i0, least(cast(floor(s) as int) + 1, n - 1) i1, s - floor(s) wt from"
        " (select n, o, greatest((o + 0.5::double) * n / 4 - 0.5::double, 0::double) s from range(1, 7) t(n), range(4) u(o))),"
        " cells as (select k.*, cast(ay.o as int) oy, cast(ax.o as int) ox, ay.i0 y0, ay.i1 y1, ay.wt wy, ax.i0 x0, ax.i1 x1, ax.wt wx"
        " from obs_keys k join axis ay on ay.n = k.h join axis ax on ax.n = k.w)"
        " select c.field_id, c.window_idx, c.band_idx, c.band, oy, ox,"
        " (1 - wy) * ((1 - wx) * p00.dn + wx * p01.dn) + wy * ((1 - wx) * p10.dn + wx * p11.dn) as v from cells c"
        + "".join(
            f" join obs p{a}{b} on p{a}{b}.field_id = c.field_id and p{a}{b}.window_idx = c.window_idx and p{a}{b}.band_idx = c.band_idx"
            f" and p{a}{b}.y = c.y{a} and p{a}{b}.x = c.x{b}"
            for a in (0, 1)
            for b in (0, 1)
        ),
    ),
    "drawn": (
        ["exported", "top"],
        "select *, cast(dense_rank() over (order by crop_type) - 1 as int) as class_idx from (select * from exported where tuman_code in (select tuman_code from top)"
        f" qualify row_number() over (partition by tuman_code, crop_type order by {digest('field_id', q.SEED)}, field_id) <= {q.PER_CLASS})",
    ),
    "best_windows": (
        ["bounded", "dated", "windows"],
        "select field_id, window_idx, min(struct_pack(cloud_cover := cloud_cover, scene_id := scene_id)) as b from bounded join (select * from dated join windows"
        " on cast(datetime as date) between cast(a as date) and cast(b as date) where cloud_cover < 20) s"
        " on x0 <= lon_max and x1 >= lon_min and y0 <= lat_max and y1 >= lat_min group by field_id, window_idx",
    ),
    "tiles": (
        ["scenes"],
        f"select s.scene_id, yy.i as y, xx.i as x, s.lon_min as origin_x, s.lat_max as origin_y,"
        f" cast((s.scene_k * 53 + yy.i * 19 + xx.i * 11) % 10000 as int) as dn from scenes s"
        f" cross join (values {SERIES_DIGITS}) as yy(i) cross join (values {SERIES_DIGITS}) as xx(i)",
    ),
    "chips": (
        [],
        "select vec_id as chip_id, label % 3 as class_idx, cast(pos // 16 as int) as c, cast((pos // 4) % 4 as int) as y,"
        " cast(pos % 4 as int) as x, cast(floor((cast(embedding[pos + 1] as double) + 1) * 5000) as int) as dn"
        " from embeddings, generate_series(0, 63) g(pos)",
    ),
    "chip_ids": ([], "select vec_id as chip_id, label % 3 as class_idx from embeddings"),
    "district_chips": (
        ["chips"],
        "select cast(1700200 + chip_id % 25 as int) as tuman_code, * from chips where (1700200 + chip_id % 25) % 7 <> 0",
    ),
    "predictions": (
        [],
        "select vec_id as chip_id, label % 3 as label, cast(s0 as double) / 500 as z0, cast(s1 as double) / 500 as z1, cast(s2 as double) / 500 as z2 from ("
        "select vec_id, label, "
        + ", ".join(f"cast(sum(w) filter (where i % 3 = {m}) as bigint) as s{m}" for m in range(3))
        + " from (select vec_id, label, i, cast(floor((cast(embedding[i + 1] as double) + 1) * 5000) as bigint) - 5000 as w"
        " from embeddings, unnest(range(len(embedding))) g(i)) group by vec_id, label)",
    ),
    "preds": (
        ["predictions"],
        "select *, cast(case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end as int) as pred from predictions",
    ),
    "confusion": (
        ["preds"],
        "select cast(t.i as int) as \"true\", cast(p.i as int) as pred, (select count(*) from preds where preds.label = t.i and preds.pred = p.i) as n"
        " from range(4) t(i), range(4) p(i)",
    ),
    "history": (
        [],
        "select user_id as run_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as epoch,"
        " case when event_id % 53 = 0 then 'nan'::double else cast(floor(value * 10) as double) / 5000 end as val_f1 from events",
    ),
    "series": (
        [],
        "select e.sample_id, e.t, ch.c, case when ch.c = 0 then e.a else e.b end as v from (select user_id as sample_id,"
        " cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as t,"
        " cast(floor(value * 100) as bigint) as a, event_id % 50 as b from events) e cross join (values (0),(1)) as ch(c)",
    ),
    "splits": (
        ["chip_ids"],
        "select *, case when rank < round_even(n * 0.15::double, 0) then 'test'"
        " when rank < round_even(n * 0.15::double, 0) + round_even(n * 0.15::double, 0) then 'val' else 'train' end as split from"
        f" (select chip_id, row_number() over (order by {digest('chip_id', q.SEED)}, chip_id) - 1 as rank, count(*) over () as n from chip_ids)",
    ),
    "native": (
        ["footed"],
        "select * exclude (nx0, ny0, nx1, ny1), floor(nx0 / 10) * 10 nx0, floor(ny0 / 10) * 10 ny0, ceil(nx1 / 10) * 10 nx1, ceil(ny1 / 10) * 10 ny1"
        f" from (select scene_id, epsg, lon_min, lat_min, lon_max, lat_max, cloud_cover, nx0, ny0, nx1, ny1 from ({utm('footed', 'lon_min', 'lat_min', 'lon_max', 'lat_max', 'n')}))",
    ),
    "scene_index": (
        ["native"],
        f"select scene_id, epsg, nx0, ny0, nx1, ny1, gx0 lon_min, gy0 lat_min, gx1 lon_max, gy1 lat_max from ({wgs('native', 'nx0', 'ny0', 'nx1', 'ny1', 'g')})",
    ),
    "touching": (
        ["bounded", "scene_index"],
        "select field_id, x0, y0, x1, y1, s.* from bounded join scene_index s on x0 <= lon_max and x1 >= lon_min and y0 <= lat_max and y1 >= lat_min",
    ),
    "windowed": (
        ["touching"],
        "select *, greatest(least(cast(ceil((least(px1, nx1) - nx0) / 10) as bigint), cast(round((nx1 - nx0) / 10) as bigint)), 0)"
        " - greatest(least(cast(floor((greatest(px0, nx0) - nx0) / 10) as bigint), cast(round((nx1 - nx0) / 10) as bigint)), 0) as cw,"
        " greatest(least(cast(ceil((ny1 - greatest(py0, ny0)) / 10) as bigint), cast(round((ny1 - ny0) / 10) as bigint)), 0)"
        " - greatest(least(cast(floor((ny1 - least(py1, ny1)) / 10) as bigint), cast(round((ny1 - ny0) / 10) as bigint)), 0) as ch,"
        " greatest(px0, nx0) < least(px1, nx1) and greatest(py0, ny0) < least(py1, ny1) as hit"
        f" from ({utm('touching', 'x0', 'y0', 'x1', 'y1', 'p')})",
    ),
    "first_yield": (
        ["windowed"],
        "select field_id, min(struct_pack(scene_id := scene_id, w := cast(cw as int), h := cast(ch as int)))"
        " filter (where hit and cw >= 60 and ch >= 60) as f from windowed group by field_id",
    ),
}


def cut_ctes(pairs: str, bands: list[str], key: str) -> str:
    """``cut_keys`` and ``cut_resized``: windows of drawn fields in every band of their
    scene, and their pixels resized to 4 x 4, straight from the rule that fills the rasters."""
    specs = values([(i, b, res, round(fx.SCENE_DEGREES / res)) for i, b, res in fx.RASTER_BANDS if b in bands], "b", "band_idx, band, res, side")
    edges = ", ".join(
        f"greatest(0, least(side, cast({fn}(({e}) / res) as bigint))) as {n}"
        for n, fn, e in (("c0", "floor", "x0 - lon_min"), ("c1", "ceil", "x1 - lon_min"), ("r0", "floor", "lat_max - y1"), ("r1", "ceil", "lat_max - y0"))
    )
    dn = lambda a, b: f"cast((scene_k * 53 + band_idx * 131 + (r0 + {a}) * 19 + (c0 + {b}) * 11) % 10000 as double)"
    return (
        f"cut_keys as (select * exclude (c1, r1), cast(r1 - r0 as int) as h, cast(c1 - c0 as int) as w from (select {key}, scene_k, band_idx, band, res, {edges}"
        f" from drawn f join {pairs} p using (field_id) join footed s on s.scene_id = p.b.scene_id cross join (select band_idx, band, cast(res as double) as res, side from ({specs})))"
        " where r1 > r0 and c1 > c0),"
        " axis as (select n, o, cast(floor(s) as int) i0, least(cast(floor(s) as int) + 1, n - 1) i1, s - floor(s) wt from"
        " (select n, o, greatest((o + 0.5::double) * n / 4 - 0.5::double, 0::double) s from range(1, 331) t(n), range(4) u(o))),"
        f" cut_resized as (select {key}, band_idx, band, cast(ay.o as int) oy, cast(ax.o as int) ox,"
        f" (1 - ay.wt) * ((1 - ax.wt) * {dn('ay.i0', 'ax.i0')} + ax.wt * {dn('ay.i0', 'ax.i1')}) + ay.wt * ((1 - ax.wt) * {dn('ay.i1', 'ax.i0')} + ax.wt * {dn('ay.i1', 'ax.i1')}) as v"
        " from cut_keys k join axis ay on ay.n = k.h join axis ax on ax.n = k.w), "
    )


def flips(src: str, value: str = "dn") -> str:
    return (
        f"select chip_id, c, case when {uniform('chip_id', q.SEED, chr(39) + 'vflip' + chr(39))} < 0.5 then 3 - y else y end as y,"
        f" case when {uniform('chip_id', q.SEED, chr(39) + 'hflip' + chr(39))} < 0.5 then 3 - x else x end as x, {value} from {src}"
    )


def turn(src: str, value: str = "dn") -> str:
    k = f"cast(floor({uniform('chip_id', q.SEED, chr(39) + 'rot90' + chr(39))} * 4) as int)"
    return (
        "select chip_id, c, case k when 1 then 3 - x when 2 then 3 - y when 3 then x else y end as y,"
        f" case k when 1 then y when 2 then 3 - x when 3 then 3 - y else x end as x, {value} from (select *, {k} as k from {src})"
    )


def mixed(src: str, value: str, name: str) -> str:
    """``src`` with ``name``: the 32-bit hash of the whole number ``value``."""
    full = "4294967295::ubigint"
    return (
        f"select *, xor(m2_, m2_ >> 16) as {name} from (select * exclude (m1_), (xor(m1_, m1_ >> 15) * {MIX[1]}::ubigint) & {full} as m2_ from"
        f" (select * exclude (m0_), (xor(m0_, m0_ >> 16) * {MIX[0]}::ubigint) & {full} as m1_ from (select *, ({value}) & {full} as m0_ from {src})))"
    ).replace("select *, xor(m2_", "select * exclude (m2_), xor(m2_", 1)


def key(op: str) -> str:
    return f"cast({lane(digest('chip_id', q.SEED, chr(39) + op + chr(39)))} as ubigint)"


def jitter(src: str, value: str = "dn") -> str:
    for op in ("scale", "shift"):
        src = "(" + mixed(src, f"{key(op)} + cast(c as ubigint) * {GOLDEN}::ubigint", f"{op}_") + ")"
    draw = lambda op: f"(cast({op}_ as double) / {d(float(2**32))} * 2 - 1)"
    return f"select chip_id, c, y, x, {value} * ({draw('scale')} * 0.1::double + 1) + {draw('shift')} * 0.1::double as v from {src}"


def noise(src: str, value: str = "dn") -> str:
    placed = f"(select *, cast(c * 16 + y * 4 + x as int) as i_ from {src})"
    one = "(" + mixed(placed, f"{key('noise')} + cast(i_ // 2 as ubigint) * {GOLDEN}::ubigint", "one_") + ")"
    two = "(" + mixed(one, f"xor(one_, {SECOND_LANE}::ubigint)", "two_") + ")"
    u = lambda n: f"cast({n} as double) / {d(float(2**32))}"
    angle = f"{u('two_')} * (2 * pi())"
    wave = f"case when i_ % 2 = 0 then cos({angle}) else sin({angle}) end"
    return f"select chip_id, c, y, x, {value} + sqrt(-2 * ln(1 - {u('one_')})) * 0.01::double * {wave} as v from {two}"


def normalised(src: str = "chips") -> str:
    mean = "[" + ", ".join(d(v) for v in q.MEAN) + "]"
    std = "[" + ", ".join(d(v) for v in q.STD) + "]"
    return f"select chip_id, c, y, x, (dn / {d(10000.0)} - {mean}[c + 1]) / {std}[c + 1] as v from {src}"


def tall(sql: str, value: str = "v") -> str:
    """Pixels as the transforms return them: in single precision."""
    return f"select chip_id, c, cast(y as int) as y, cast(x as int) as x, {r(f'cast({value} as float)')} as {value} from ({sql})"


def texts(order: str, value: str, group: str) -> str:
    return f"string_agg(cast(cast(floor({value} * 10000 + 0.5::double) as bigint) as varchar), ',' order by {order})"


_SEARCH = (
    f"cloud_cover < 20 and acq_date between date '{q.SEARCH_DATES[0]}' and date '{q.SEARCH_DATES[1]}'"
    f" and lon_min <= {q.SEARCH_BOX[2]} and lon_max >= {q.SEARCH_BOX[0]} and lat_min <= {q.SEARCH_BOX[3]} and lat_max >= {q.SEARCH_BOX[1]}"
)
_AOIS = values([(k, *v) for k, v in {**AOI_PRESETS, "custom": q.SEARCH_BOX}.items()], "a", "aoi, ax0, ay0, ax1, ay1")
_PLAN = (
    "select s.scene_id, b.band, concat(s.scene_id, '_', b.band, '.tif') as path, case when has_b12 or b.band <> 'B12'"
    " then concat(s.scene_id, '_', b.band, '.tif') end as href from scenes s cross join bands b"
)
_OK_PX = "min(case when res > 0.00015 then least(h, w) >= 1 else least(h, w) >= {n} end)"
_FERGANA = AOI_PRESETS["fergana"]

BODIES: dict[str, tuple[list[str], str]] = {
    "fields_scan": (["fields"], "select field_id, geom_2, crop_type from fields where geom_2 is not null and crop_type is not null"),
    "geojson_features": (
        ["exported"],
        "select field_id, crop_type, case when geom_2 like 'MULTI%' then 'MultiPolygon' else 'Polygon' end as kind, cast(i - 1 as int) as i, xs[i] as lon, ys[i] as lat from exported,"
        " unnest(case when len(coalesce(xs, [])) = 0 then [null] else range(1, len(xs) + 1) end) t(i)",
    ),
    "geojson_roundtrip": (
        ["exported"],
        "select field_id, crop_type, case when geom_2 like 'MULTI%' then 'MultiPolygon' else 'Polygon' end as kind, cast(coalesce(len(xs), 0) as int) as points, xs[1] as lon0, ys[3] as lat2 from exported",
    ),
    "fields_by_region": (
        ["fields"],
        "select field_id, viloyat, tuman from fields where regexp_matches(viloyat, 'asia|europe', 'i') and regexp_matches(tuman, 'nation_1', 'i')",
    ),
    "fields_exclude_tuman": (
        ["fields"],
        "select field_id, tuman_code from fields where tuman_code is null or tuman_code not in (1700205, 1700207)",
    ),
    "fields_limit": (
        ["fields"],
        "select field_id, geom_2, crop_type from (select * from fields order by field_id limit 500) where geom_2 is not null and crop_type is not null",
    ),
    "normalize_labels": (["normed"], "select field_id, crop_type, contains(crop_type, ',') as unmapped from normed"),
    "wkt_bounds": (["bounded"], "select field_id, x0, y0, x1, y1 from bounded"),
    "geometry_skips": (
        ["bounded"],
        "select case when geom_2 is null then 'no_geometry' when crop_type is null then 'no_label' when geom_2 like '%EMPTY' then 'exported_empty'"
        " when x0 is null then 'unparseable' else 'exported' end as reason, count(*) as n from bounded group by 1",
    ),
    "district_counts": (["counts"], "select * from counts"),
    "top_districts": (["top"], "select viloyat, tuman, tuman_code, polygons, region, rank from top"),
    "pending_districts": (
        ["top"],
        "select region, tuman, tuman_code, polygons, rank from top where tuman_code not in (select 1700200 + n_nationkey from nation where n_nationkey % 4 = 0)",
    ),
    "class_distribution": (
        ["exported"],
        f"select crop_type, count(*) as n, {r('count(*) * 100.0::double / (select count(*) from exported)')} as pct from exported group by crop_type",
    ),
    "class_index": (
        ["exported"],
        "select field_id, crop_type, cast(dense_rank() over (order by crop_type) - 1 as int) as class_idx from exported",
    ),
    "sample_per_class": (
        ["exported"],
        f"select field_id, crop_type from exported qualify row_number() over (partition by crop_type order by {digest('field_id', q.SEED)}, field_id) <= 50",
    ),
    "extent": (["bounded"], "select min(x0) as lon_min, min(y0) as lat_min, max(x1) as lon_max, max(y1) as lat_max from bounded"),
    "bbox_quality": (
        ["bounded"],
        "select field_id, case when field_id % 6 = 5 then 'missing coordinate' when field_id % 6 = 1 then 'empty in longitude'"
        " when field_id % 6 = 2 then 'empty in latitude' when field_id % 6 = 3 then 'longitude out of range'"
        " when field_id % 6 = 4 then 'latitude out of range' end as error from bounded where x0 is not null",
    ),
    "scene_footprints": (["footed"], "select scene_id, lon_min, lat_min, lon_max, lat_max from footed"),
    "bbox_ring": (
        ["footed"],
        "select scene_id, cast(i as int) as i, case when i in (1, 2) then lon_max else lon_min end as lon,"
        " case when i in (2, 3) then lat_max else lat_min end as lat from footed, range(5) t(i)",
    ),
    "scene_search": (["footed"], f"select scene_id, cloud_cover, acq_date from footed where {_SEARCH}"),
    "search_summary": (
        ["footed"],
        f"select count(*) as scenes, 4 as bands, count(*) * 4 as files, min(acq_date) as first_date, max(acq_date) as last_date from footed where {_SEARCH}",
    ),
    "rank_scenes": (["scenes"], "select scene_id, cloud_cover from scenes order by cloud_cover, scene_id limit 20"),
    "aoi_scenes": (
        ["footed"],
        f"select aoi, count(*) as scenes, min(cloud_cover) as least_cloud from footed join ({_AOIS}) a"
        " on lon_min <= ax1 and lon_max >= ax0 and lat_min <= ay1 and lat_max >= ay0 group by aoi",
    ),
    "complete_scenes": (["scenes"], "select scene_id from scenes where has_b12"),
    "missing_bands": (
        ["scenes"],
        "select scene_id, 'B09' as band from scenes union all select scene_id, 'B12' from scenes where not has_b12",
    ),
    "scene_groups": (
        ["assets"],
        "select scene_id, cast(count(*) as int) as n_files, string_agg(path, ';' order by path) as paths from assets group by scene_id",
    ),
    "download_plan": (
        ["scenes", "bands", "manifest"],
        f"select path, scene_id, band, href, case when href is null then 'missing' else 'todo' end as status from ({_PLAN})"
        " where path not in (select path from manifest)",
    ),
    "download_summary": (
        ["scenes", "bands", "manifest", "results"],
        "select count(*) as files, count(*) filter (where there) as already, count(*) filter (where not there) as remaining, count(*) filter (where href is null and not there) as missing,"
        " count(*) filter (where href is not null and not there and ok) as ok, count(*) filter (where href is not null and not there and not ok) as failed,"
        " count(*) filter (where href is not null and not there and ok is null) as unreported from"
        f" (select p.*, m.path is not null as there, r.ok from ({_PLAN}) p left join manifest m on m.path = p.path left join results r on r.path = p.path)",
    ),
    "parse_windows": (
        [],
        "with specs as (select o_orderkey k, strftime(o_orderdate, '%Y-%m-%d') a, strftime(cast(o_orderdate as date) + 30, '%Y-%m-%d') b from orders),"
        " parts as (select k, case k % 7 when 0 then [a, a || ':' || b] when 1 then [a || ':' || b, a || ':' || b || ':x']"
        " when 2 then [a || ':' || b, b || ' : ' || b] else [a || ':' || b] end p from specs)"
        " select k as spec_id, cast(i - 1 as int) as i, p[i] as pair, case when len(string_split(p[i], ':')) = 2 then cast(trim(string_split(p[i], ':')[1]) as date) end as d0,"
        " case when len(string_split(p[i], ':')) = 2 then cast(trim(string_split(p[i], ':')[2]) as date) end as d1,"
        " case when len(string_split(p[i], ':')) <> 2 then 'expected start:end' end as error from parts, unnest(range(1, len(p) + 1)) t(i)",
    ),
    "bounds_to_utm": (
        ["bounded"],
        f"select field_id, epsg, {', '.join(f'{r(c, 3)} as {c}' for c in ('ux0', 'uy0', 'ux1', 'uy1'))} from ("
        + utm("(select *, cast(32601 + floor((x0 + 180) / 6) as int) as epsg from bounded where x0 is not null)", "x0", "y0", "x1", "y1", "u")
        + ")",
    ),
    "scene_index_wgs84": (
        ["scene_index"],
        f"select scene_id, epsg, nx0, ny1, {', '.join(f'{r(c)} as {c}' for c in ('lon_min', 'lat_min', 'lon_max', 'lat_max'))} from scene_index",
    ),
    "assign_best_scene": (["best"], "select field_id, b.scene_id as scene_id, b.cloud_cover as cloud_cover from best"),
    "assign_best_scene_windows": (
        ["bounded", "dated", "windows"],
        "select field_id, window_idx, b.scene_id as scene_id, b.cloud_cover as cloud_cover from (select field_id, window_idx,"
        " min(struct_pack(cloud_cover := cloud_cover, scene_id := scene_id)) as b from bounded join (select * from dated join windows"
        " on cast(datetime as date) between cast(a as date) and cast(b as date) where cloud_cover < 20) s"
        " on x0 <= lon_max and x1 >= lon_min and y0 <= lat_max and y1 >= lat_min group by field_id, window_idx)",
    ),
    "coverage_report": (
        ["bounded", "best"],
        "select (select count(*) from best) as assigned, count(*) as total, (select count(distinct b.scene_id) from best) as scenes_used,"
        " count(*) - (select count(*) from best) as unassigned from bounded",
    ),
    "fields_by_scene": (
        ["best"],
        "with a as (select field_id, b.scene_id as scene_id from best), n as (select scene_id, count(*) as n_fields from a group by 1)"
        f" select scene_id, {lane(digest('field_id'))} % cast(ceil(n_fields / 50) as bigint) as part, n_fields,"
        " string_agg(cast(field_id as varchar), ',' order by field_id) as field_ids from a join n using (scene_id) group by all",
    ),
    "assign_first_yielding": (
        ["first_yield"],
        "select field_id, f.scene_id as scene_id, f.w as w, f.h as h from first_yield where f is not null",
    ),
    "assignment_report": (
        ["bounded", "first_yield"],
        "select case when x0 is null or crop_type is null then 'no_label' when y.f is not null then 'ok' when y.field_id is not null then 'too_small'"
        " else 'no_scene' end as reason, count(*) as n from bounded b left join first_yield y on y.field_id = b.field_id group by 1",
    ),
    "clip_bounds": (
        ["bounded", "best", "native"],
        "select field_id, scene_id, "
        + ", ".join(
            f"case when greatest(px0, nx0) < least(px1, nx1) and greatest(py0, ny0) < least(py1, ny1) then {r(e, 3)} end as {n}"
            for n, e in (("cx0", "greatest(px0, nx0)"), ("cy0", "greatest(py0, ny0)"), ("cx1", "least(px1, nx1)"), ("cy1", "least(py1, ny1)"))
        )
        + " from ("
        + utm("(select f.field_id, x0, y0, x1, y1, s.* from bounded f join best on best.field_id = f.field_id join native s on s.scene_id = best.b.scene_id)", "x0", "y0", "x1", "y1", "p")
        + ")",
    ),
    "pixel_windows": (
        ["bounded", "best", "footed"],
        "select field_id, scene_id, cast(c0 as int) as col_off, cast(r0 as int) as row_off, cast(greatest(c1 - c0, 0) as int) as width,"
        " cast(greatest(r1 - r0, 0) as int) as height from (select f.field_id, s.scene_id, "
        + ", ".join(
            f"greatest(0, least({side}, cast({fn}(({e}) / {d(q.DEGREE_RES)}) as bigint))) as {n}"
            for n, fn, e, side in (
                ("c0", "floor", "x0 - lon_min", q.DEGREE_SIDE),
                ("c1", "ceil", "x1 - lon_min", q.DEGREE_SIDE),
                ("r0", "floor", "lat_max - y1", q.DEGREE_SIDE),
                ("r1", "ceil", "lat_max - y0", q.DEGREE_SIDE),
            )
        )
        + " from bounded f join best on best.field_id = f.field_id join footed s on s.scene_id = best.b.scene_id)",
    ),
    "min_pixels": (
        ["obs_keys"],
        "select field_id, window_idx, count(*) as bands from obs_keys group by all having min(least(h, w)) >= 3",
    ),
    "min_pixels_multires": (
        ["obs_keys"],
        f"select field_id, window_idx, count(*) as bands from obs_keys group by all having {_OK_PX.format(n=3)}",
    ),
    "window_report": (
        ["obs_keys", "windows", "fields"],
        "select w.window_idx, coalesce(chips, 0) as chips, coalesce(small, 0) as too_small,"
        " (select count(*) from fields) - coalesce(chips, 0) - coalesce(small, 0) as no_scene from windows w left join"
        " (select window_idx, count(*) filter (where ok) as chips, count(*) filter (where not ok) as small from (select field_id, window_idx,"
        f" {_OK_PX.format(n=2)} and count(*) = 3 as ok from obs_keys group by all) group by 1) k on k.window_idx = w.window_idx",
    ),
    "stack_bands": (
        ["obs"],
        "select field_id, window_idx, 2 as c, max(h) as h, max(w) as w, string_agg(cast(dn as varchar), ',' order by band_idx, y, x) as px"
        " from obs where band in ('B04', 'B08') group by field_id, window_idx",
    ),
    "resize_bilinear": (
        ["resized"],
        f"select field_id, window_idx, band, {texts('oy, ox', 'v', '')} as px from resized group by all",
    ),
    "multitemporal_stack": (
        ["resized", "obs_keys", "exported"],
        "with good as (select field_id, window_idx from obs_keys group by all having "
        + _OK_PX.format(n=2)
        + " and count(*) = 3), kept as (select field_id, 3 - count(*) as missing from good group by 1 having count(*) >= 2),"
        " index as (select field_id, cast(dense_rank() over (order by crop_type) - 1 as int) as class_idx from exported),"
        " vals as (select field_id, window_idx, cast(case band when 'B04' then 0 when 'B08' then 1 else 2 end as int) as ch, oy, ox, v from resized"
        " semi join good using (field_id, window_idx)"
        " union all select field_id, window_idx, 3, oy, ox, ((n - r) / (n + r + 0.001::double) + 1) * 5000 from (select a.field_id, a.window_idx, a.oy, a.ox, a.v n, b.v r"
        " from resized a join resized b using (field_id, window_idx, oy, ox) where a.band = 'B08' and b.band = 'B04') semi join good using (field_id, window_idx)),"
        " grid as (select k.field_id, k.missing, class_idx, cast(w as int) window_idx, cast(c as int) ch, cast(y as int) oy, cast(x as int) ox from kept k"
        " join index using (field_id), range(3) a(w), range(4) b(c), range(4) e(y), range(4) f(x))"
        " select g.field_id, class_idx, cast(missing as int) as missing, 12 as c, 4 as h, 4 as w, "
        + texts("g.window_idx, g.ch, g.oy, g.ox", "coalesce(v, 0)", "")
        + " as px from grid g left join vals using (field_id, window_idx, ch, oy, ox) group by g.field_id, class_idx, missing",
    ),
    "clip_tiles": (
        ["tiles"],
        f"select scene_id, cast(y as int) as y, cast(x as int) as x, dn from tiles where"
        f" x >= greatest(floor(({d(_FERGANA[0])} - origin_x) / 0.2::double), 0) and x < least(ceil(({d(_FERGANA[2])} - origin_x) / 0.2::double), 16)"
        f" and y >= greatest(floor((origin_y - {d(_FERGANA[3])}) / 0.2::double), 0) and y < least(ceil((origin_y - {d(_FERGANA[1])}) / 0.2::double), 16)",
    ),
    "ndvi": (
        ["chips"],
        f"select n.chip_id, n.y, n.x, {r('(n.dn - r.dn) / (n.dn + r.dn + 0.001::double)')} as v from chips n join chips r"
        " on n.chip_id = r.chip_id and n.y = r.y and n.x = r.x where n.c = 3 and r.c = 2",
    ),
    "ndvi_channel": (
        ["chips"],
        f"select chip_id, c, y, x, {r('dn')} as v from chips union all select n.chip_id, 4, n.y, n.x,"
        f" {r('((n.dn - r.dn) / (n.dn + r.dn + 0.001::double) + 1) * 5000')} from chips n join chips r"
        " on n.chip_id = r.chip_id and n.y = r.y and n.x = r.x where n.c = 3 and r.c = 2",
    ),
    "field_windows": (
        ["bounded", "best", "footed", "tiles"],
        "with wins as (select field_id, scene_id, c0, r0, c1, r1 from (select f.field_id, s.scene_id, "
        + ", ".join(
            f"greatest(0, least(16, cast({fn}(({e}) / {d(fx.TILE_RES)}) as bigint))) as {n}"
            for n, fn, e in (
                ("c0", "floor", f"x0 + {d(-q.WINDOW_MARGIN)} - lon_min"),
                ("c1", "ceil", f"x1 + {d(q.WINDOW_MARGIN)} - lon_min"),
                ("r0", "floor", f"lat_max - (y1 + {d(q.WINDOW_MARGIN)})"),
                ("r1", "ceil", f"lat_max - (y0 + {d(-q.WINDOW_MARGIN)})"),
            )
        )
        + " from bounded f join best on best.field_id = f.field_id join footed s on s.scene_id = best.b.scene_id))"
        " select field_id, w.scene_id as scene_id, band, cast(r1 - r0 as int) as h, cast(c1 - c0 as int) as w,"
        " string_agg(cast(case when band = 'B04' then dn else dn * 3 % 10000 end as varchar), ',' order by y, x) as px"
        " from wins w join tiles t on t.scene_id = w.scene_id and y >= r0 and y < r1 and x >= c0 and x < c1"
        " cross join (values ('B04'), ('B08')) b(band) group by all",
    ),
    "select_task": ([], "select concat(cast(s_nationkey as varchar), '-crop') as task_id, s_suppkey from supplier where concat(cast(s_nationkey as varchar), '-crop') like '%1-c%'"
        " and s_nationkey = (select min_by(s_nationkey, concat(cast(s_nationkey as varchar), '-crop')) from supplier where concat(cast(s_nationkey as varchar), '-crop') like '%1-c%')"),
    "band_stats_sink": (
        ["chips"],
        f"select c, count(*) as pixels, {r('avg(dn / 10000.0::double)')} as mean, {r('stddev_pop(dn / 10000.0::double)')} as std from chips group by c",
    ),
    "union_chips": (
        ["chip_ids"],
        "select code as tuman_code, count(*) * case when code < 1700212 then 2 else 1 end as chips, count(*) filter (where code % 7 <> 0) * case when code < 1700212 then 2 else 1 end as labelled"
        " from (select cast(1700200 + chip_id % 25 as int) as code from chip_ids) group by code",
    ),
    "series_to_grid": (
        ["series"],
        "with len as (select sample_id, c, max(t) + 1 as n, cast(ceil(sqrt(max(t) + 1)) as int) as side from series group by all)"
        " select l.sample_id, l.c, side, cast(i // side as int) as y, cast(i % side as int) as x, coalesce(v, 0) as v"
        " from len l, unnest(range(0, side * side)) u(i) left join series s on s.sample_id = l.sample_id and s.c = l.c and s.t = u.i",
    ),
    "chips_roundtrip": (["district_chips"], "select tuman_code, chip_id, class_idx, c, y, x, dn from district_chips"),
    "synthetic_chips": (
        ["chip_ids"],
        f"select chip_id, cast(k as int) as class_idx, cast(i // 16 as int) as c, cast((i // 4) % 4 as int) as y, cast(i % 4 as int) as x,"
        f" {r(uniform('chip_id', q.SEED, 'i') + ' * 3000 + k * 3000')} as v from (select chip_id, {lane(digest('chip_id', q.SEED, chr(39) + 'label' + chr(39)))} % 3 as k from chip_ids), range(64) t(i)",
    ),
    "combine_districts": (
        ["district_chips"],
        "select tuman_code, chip_id, class_idx, cast(sum(dn) as bigint) as dn_sum from district_chips group by all",
    ),
    "combine_report": (
        ["district_chips"],
        "select tuman_code, count(distinct chip_id) as chips, 4 as channels, 4 as height, 4 as width from district_chips group by rollup(tuman_code)",
    ),
    "chip_quality": (
        ["chip_ids"],
        "select count(*) as chips, count(*) filter (where chip_id % 37 = 0) as no_image, count(*) filter (where chip_id % 41 <> 0 and chip_id % 47 = 0) as no_label,"
        " count(*) filter (where chip_id % 37 <> 0 and (chip_id % 50 = 0) <> (chip_id % 43 = 0) or chip_id % 37 <> 0 and chip_id % 50 = 0 and chip_id % 43 = 0) as bad_shape,"
        " count(*) filter (where chip_id % 41 = 0) as label_too_large, cast(0 as bigint) as label_negative, count(*) filter (where chip_id % 43 = 0) as channel_mismatch from chip_ids",
    ),
    "band_stats": (
        ["chips"],
        f"select c, count(*) as pixels, {r('avg(dn / 10000.0::double)')} as mean, {r('stddev_pop(dn / 10000.0::double)')} as std from chips group by c",
    ),
    "band_stats_sampled": (
        ["chips", "chip_ids"],
        f"select c, count(*) as pixels, {r('avg(dn / 10000.0::double)')} as mean, {r('stddev_pop(dn / 10000.0::double)')} as std from chips"
        f" where chip_id in (select chip_id from chip_ids order by {digest('chip_id', q.SEED)}, chip_id limit 200) group by c",
    ),
    "chip_features": (
        ["chips"],
        f"select chip_id, class_idx, c as i, {r('avg(dn)')} as v from chips group by all union all"
        f" select chip_id, class_idx, c + 4, {r('stddev_pop(dn)')} from chips group by all",
    ),
    "val_transform": (["chips"], tall(normalised())),
    "train_transform": (["chips"], tall(noise("(" + jitter("(" + turn("(" + flips(f"({normalised()})", "v") + ")", "v") + ")", "v") + ")", "v"))),
    "augment_flips": (["chips"], tall(flips("chips"), "dn")),
    "augment_rot90": (["chips"], tall(turn("chips"), "dn")),
    "augment_jitter": (["chips"], tall(jitter("chips"))),
    "augment_noise": (["chips"], tall(noise("chips"))),
    "custom_transform": (["chips"], f"select chip_id, c, y, x, {r('dn * 2')} as v from chips"),
    "split_assign": (["splits"], "select chip_id, rank, split from splits"),
    "split_external": (
        ["chip_ids"],
        "select chip_id, rank, case when rank < round_even(n * 0.15::double, 0) then 'val' else 'train' end as split, 'main' as source from"
        f" (select chip_id, row_number() over (order by {digest('chip_id', q.SEED)}, chip_id) - 1 as rank, count(*) over () as n from chip_ids where chip_id % 25 < 20)"
        " union all select chip_id, null, 'test', 'external' from chip_ids where chip_id % 25 >= 20",
    ),
    "batch_plan": (
        ["splits"],
        "select chip_id, split, r // 32 as batch, r % 32 as slot from (select chip_id, split, row_number() over (partition by split order by case when split = 'train'"
        f" then {digest('chip_id', q.SEED, chr(39) + 'epoch' + chr(39), 0)} end, rank) - 1 as r, count(*) over (partition by split) as m from splits)"
        " where split <> 'train' or (r // 32 + 1) * 32 <= m",
    ),
    "predict_argmax": (["preds"], "select chip_id, label, pred from preds"),
    "confusion_matrix": (["confusion"], "select * from confusion where \"true\" < 3 and pred < 3"),
    "confusion_pct": (
        ["confusion"],
        f"select \"true\", pred, {r('n / nullif(sum(n) over (partition by ' + chr(34) + 'true' + chr(34) + '), 0)')} as share from confusion",
    ),
    "accuracy": (["preds"], f"select {r('avg(case when pred = label then 1.0::double else 0.0::double end)')} as accuracy from preds"),
    "macro_scores": (
        ["confusion"],
        f"select {r('avg(tp / greatest(tp + fn, 1))')} as macro_accuracy, {r('avg(2 * tp / (2 * tp + fp + fn))')} as macro_f1 from"
        " (select k.i, sum(n) filter (where \"true\" = k.i and pred = k.i) as tp, sum(n) filter (where \"true\" <> k.i and pred = k.i) as fp,"
        " sum(n) filter (where \"true\" = k.i and pred <> k.i) as fn from confusion, range(4) k(i) group by 1) where tp + fp + fn > 0",
    ),
    "ce_loss": (
        ["predictions"],
        "with lp as (select label, z0 - m - l as a, z1 - m - l as b, z2 - m - l as c from (select *, ln(exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) as l"
        " from (select *, greatest(z0, z1, z2) as m from predictions))),"
        " w as (select [0.5::double, 1.0::double, 2.0::double][label + 1] as w, [a, b, c][label + 1] as hit, 0.5::double * a + b + 2 * c as spread from lp)"
        f" select {r('-0.9::double * sum(w * hit) / sum(w) - 0.1::double / 3 * sum(spread) / sum(w)')} as loss from w",
    ),
    "class_weights": (
        ["chip_ids"],
        f"select class_idx, count(*) as n, {r('(select count(*) from chip_ids) / (3.0::double * count(*))')} as weight from chip_ids group by class_idx",
    ),
    "best_epoch": (["history"], "select run_id, arg_min(epoch, (-val_f1, epoch)) as epoch, max(val_f1) as val_f1 from history where not isnan(val_f1) group by run_id"),
    "early_stop": (
        ["history"],
        "with h as (select run_id, epoch, case when not isnan(val_f1) then val_f1 end as val_f1 from history),"
        " b as (select *, max(val_f1) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding) as best from h),"
        " m as (select *, max(case when val_f1 is not null and (best is null or val_f1 > best) then epoch end) over (partition by run_id order by epoch) as last from b)"
        " select run_id, min(case when epoch - last >= 10 then epoch end) as stop_epoch from m group by run_id",
    ),
    "stream_intake": (["scenes"], "select scene_id, cloud_cover from scenes where cloud_cover < 20 and scene_k % 5 <> 0"),
}


_FEATURES = (
    "select chip_id, class_idx, c as i, avg(cast(dn as double)) as v from chips group by all union all"
    " select chip_id, class_idx, c + 4, stddev_pop(cast(dn as double)) from chips group by all"
)


def _linear() -> str:
    weights, bias = q.LINEAR
    logits = ", ".join(
        f"sum(case i {' '.join(f'when {i} then {d(w)}' for i, w in enumerate(row))} end * v) + {d(b)} as z{c}" for c, (row, b) in enumerate(zip(weights, bias))
    )
    return f"select chip_id, class_idx as label, {logits} from ({_FEATURES}) group by all"


BODIES["predict_linear"] = (
    ["chips"],
    "select chip_id, label, cast(case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end as int) as pred, "
    + ", ".join(f"{r(f'z{c}', 5)} as z{c}" for c in range(3))
    + f" from ({_linear()})",
)
# Scores of a table of logits ``chip_id, label, k, z`` of the test split.
_SCORES = (
    " wide as (select chip_id, label, max(z) as top, arg_min(k, (-z, k)) as pred, max(z) filter (where k = label) as own from logits group by all),"
    " loss as (select avg(own_lp) as v from (select w.chip_id, -(own - top - ln(sum(exp(z - top)))) as own_lp from wide w join logits l using (chip_id) group by w.chip_id, own, top)),"
    " per as (select c.i as k, count(*) filter (where label = c.i and pred = c.i) as tp, count(*) filter (where label <> c.i and pred = c.i) as fp,"
    " count(*) filter (where label = c.i and pred <> c.i) as fn from wide, range(3) c(i) group by 1)"
    f" select 'accuracy' as name, {r('avg(case when label = pred then 1.0::double else 0.0::double end)', 5)} as value from wide"
    f" union all select 'macro_accuracy', {r('avg(tp / greatest(tp + fn, 1))', 5)} from per where tp + fp + fn > 0"
    f" union all select 'macro_f1', {r('avg(2 * tp / (2 * tp + fp + fn))', 5)} from per where tp + fp + fn > 0"
    f" union all select 'loss', {r('v', 5)} from loss"
)
BODIES["normal_eval"] = (
    ["chips", "splits"],
    f"with feats as ({_FEATURES}), moments as (select class_idx, i, avg(v) as m, greatest(var_pop(v), 1e-6::double) as s from feats join splits using (chip_id)"
    " where split = 'train' group by all), logits as (select f.chip_id, f.class_idx as label, g.class_idx as k, -0.5::double * sum((v - m) * (v - m) / s + ln(s)) as z"
    " from feats f join splits using (chip_id) join moments g on g.i = f.i where split = 'test' group by all)," + _SCORES,
)


def _newton(steps: int, n: int, ridge: float) -> str:
    """Newton steps of a weighted logistic regression per class as CTEs ``w0`` .. ``w{steps}``
    (``k, i, w``) over scaled features ``xs``; each system is solved by Gauss-Jordan elimination."""
    ctes = [f"w0 as materialized (select cast(k.i as int) as k, cast(i.i as int) as i, 0.0::double as w from range({q.K}) k(i), range({n}) i(i))"]
    for t in range(steps):
        ctes.append(
            f"p{t} as materialized (select x.chip_id, x.class_idx, k, any_value(c.weight) as c, 1 / (1 + exp(-sum(w * v))) as p"
            f" from xs x join w{t} using (i) join balance c on c.class_idx = x.class_idx where split = 'train' group by x.chip_id, x.class_idx, k)"
        )
        ctes.append(
            f"m{t}_0 as materialized (select k, a.i as i, b.i as j, sum(c * p * (1 - p) * a.v * b.v) + case when a.i = b.i then {d(ridge)} else 0 end as v"
            f" from p{t} join xs a using (chip_id) join xs b using (chip_id) group by k, a.i, b.i union all"
            f" select g.k, g.i, {n}, g.v - {d(ridge)} * w from (select k, i, sum(c * (case when p{t}.class_idx = k then 1 else 0 end - p) * v) as v from p{t} join xs using (chip_id)"
            f" group by k, i) g join w{t} on w{t}.k = g.k and w{t}.i = g.i)"
        )
        for s in range(n):
            m = f"m{t}_{s}"
            ctes.append(
                f"m{t}_{s + 1} as materialized (select a.k, a.i, a.j, case when a.i = {s} then a.v / p.v else a.v - c.v * r.v / p.v end as v from {m} a"
                f" join {m} p on p.k = a.k and p.i = {s} and p.j = {s} join {m} r on r.k = a.k and r.i = {s} and r.j = a.j join {m} c on c.k = a.k and c.i = a.i and c.j = {s})"
            )
        ctes.append(f"w{t + 1} as materialized (select o.k, o.i, o.w + m.v as w from w{t} o join m{t}_{n} m on m.k = o.k and m.i = o.i and m.j = {n})")
    return ", ".join(ctes)


BODIES["baseline_eval"] = (
    ["chips", "splits"],
    f"with feats as materialized (select f.*, split from ({_FEATURES}) f join splits using (chip_id)),"
    f" scale as (select i, avg(v) as m, sqrt(greatest(var_pop(v), {d(LEAST_VARIANCE)})) as s from feats where split = 'train' group by i),"
    " xs as materialized (select chip_id, class_idx, split, cast(i as int) as i, (v - m) / s as v from feats join scale using (i)"
    " union all select distinct chip_id, class_idx, split, 8, 1.0::double from feats),"
    f" balance as (select class_idx, (select count(distinct chip_id) from xs where split = 'train') / ({d(float(q.K))} * count(distinct chip_id)) as weight from xs where split = 'train' group by class_idx), "
    + _newton(NEWTON_STEPS, 9, RIDGE)
    + f", logits as (select chip_id, class_idx as label, k, sum(w * v) as z from xs join w{NEWTON_STEPS} using (i) where split = 'test' group by all)," + _SCORES,
)


BODIES["geojson_collection"] = BODIES["geojson_roundtrip"]

# The stack over windows cut from the rasters instead of ready-made ones.
_STACK = BODIES["multitemporal_stack"][1]
BODIES["build_chips_windows"] = (
    ["drawn", "best_windows", "footed"],
    "with " + cut_ctes("best_windows", q.WINDOW_BANDS, "field_id, window_idx")
    + _STACK.removeprefix("with ")
    .replace("0.00015", str(q.BUILD_COARSE))
    .replace("from resized", "from cut_resized").replace("join resized", "join cut_resized").replace("from obs_keys", "from cut_keys")
    .replace("having count(*) >= 2)", "having count(*) >= 1)")
    .replace(" index as (select field_id, cast(dense_rank() over (order by crop_type) - 1 as int) as class_idx from exported),", "")
    .replace("select k.field_id, k.missing, class_idx,", "select k.field_id, k.missing, class_idx, tuman_code,")
    .replace("join index using", "join drawn using")
    .replace(" select g.field_id, class_idx,", " select g.field_id as chip_id, tuman_code, class_idx,")
    .replace("group by g.field_id, class_idx, missing", "group by g.field_id, tuman_code, class_idx, missing"),
)
BODIES["build_chips_single"] = (
    ["drawn", "best", "footed"],
    "with " + cut_ctes("(select best.* from best join footed on footed.scene_id = best.b.scene_id where has_b12)", q.SINGLE_BANDS, "field_id")
    + "good as (select field_id from cut_keys group by 1 having count(*) = 3 and min(least(h, w)) >= 2)"
    " select field_id as chip_id, tuman_code, class_idx, 3 as c, 4 as h, 4 as w, " + texts("band_idx, oy, ox", "v", "")
    + " as px from cut_resized semi join good using (field_id) join drawn using (field_id) group by field_id, tuman_code, class_idx",
)


BODIES["build_resumed"] = BODIES["build_chips_single"]
BODIES["band_stats_merged"] = BODIES["band_stats"]

# The three score queries stacked as name and value.
_LOSS = BODIES["ce_loss"][1]
BODIES["metrics_sink"] = (
    ["preds", "confusion", "predictions"],
    "select 'accuracy' as name, accuracy as value from (" + BODIES["accuracy"][1] + ") union all select 'macro_accuracy', macro_accuracy from ("
    + BODIES["macro_scores"][1] + ") union all select 'macro_f1', macro_f1 from (" + BODIES["macro_scores"][1] + ") union all select 'loss', loss from ("
    + _LOSS.replace("[0.5::double, 1.0::double, 2.0::double]", "[1.0::double, 1.0::double, 1.0::double]").replace("0.5::double * a + b + 2 * c", "a + b + c")
    .replace("-0.9::double * sum", "-1.0::double * sum").replace("- 0.1::double / 3 * sum(spread) / sum(w)", "") + ")",
)


def _closure(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _closure(CTES[name][0], seen)
            seen.append(name)
    return seen


def _render(deps: list[str], body: str) -> str:
    ctes = [f"{name} as ({CTES[name][1]})" for name in _closure(deps, [])]
    if not ctes:
        return body
    if body.startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body


def oracle_sql() -> dict[str, str]:
    return {name: _render(deps, body) for name, (deps, body) in BODIES.items()}
