"""Registered queries of the raster engine and their SQL equivalents.

Queries run on the events raster (r1: one Rgb8 picture of width 100), on the embeddings raster (r2: 8
by 8 float pictures) and on generated pictures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelry.functions import colour, layouts
from pixelry.functions import samples as S
from pixelry.operators import compose, frames, generate, geometry, palette, planes, point, resample, window
from pixelry.plans import shared
from pixelry.plans.raster import Raster, embeddings_raster, events_raster, from_table, with_alpha
from pixelry.sources import formats, headers, metadata, pictures, profiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

R1 = """r1 AS (SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, 100 AS w, CAST((SELECT max(event_id) + 1 FROM events) // 100 AS INT) AS h,
  CAST(((floor(value) % 256) + 256) % 256 AS INT) AS r, CAST(user_id % 256 AS INT) AS g, CAST((event_id * 13) % 256 AS INT) AS b FROM events),
ra AS (SELECT *, (x * 7 + y * 3) % 256 AS a FROM r1)"""
R2 = "r2 AS (SELECT vec_id, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))"
_HALF = "CAST(floor(round({0}, 6) + 0.5) AS INT)"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _out(r: Raster) -> DataFrame:
    return r.pixels.select("x", "y", *r.names)


def _r1(name: str, f: Callable[[Raster], Raster], select: str, tail: str = "FROM r1") -> None:
    """A query on r1; select: SQL of x, y and the channels."""
    _add(name, lambda spark, d: _out(f(events_raster(spark, d))), f"WITH {R1} SELECT {select} {tail}")


def _ra(name: str, f: Callable[[Raster], Raster], select: str, tail: str = "FROM ra") -> None:
    _add(name, lambda spark, d: _out(f(with_alpha(events_raster(spark, d)))), f"WITH {R1} SELECT {select} {tail}")


_LUMA = "CAST((2126 * r + 7152 * g + 722 * b + 5000) // 10000 AS INT)"
_RGB = "r AS c0, g AS c1, b AS c2"


def _each(template: str, channels: str = "rgb") -> str:
    return ", ".join(f"{template.replace('@', c)} AS c{i}" for i, c in enumerate(channels))


# --- point operators
_r1("luma", point.grayscale, f"x, y, {_LUMA} AS c0")
_ra("grayscale_alpha", point.grayscale_alpha, f"x, y, {_LUMA} AS c0, a AS c1")
_r1("invert", point.invert, f"x, y, {_each('255 - @')}")
_ra("invert_alpha", point.invert, f"x, y, {_each('255 - @')}, a AS c3")
_r1("brighten", lambda r: point.brighten(r, 60), f"x, y, {_each('least(255, @ + 60)')}")
_r1("darken", lambda r: point.brighten(r, -40), f"x, y, {_each('greatest(0, @ - 40)')}")
_CONTRAST = "CAST(floor(round(greatest(0.0, least(255.0, (((CAST(@ AS DOUBLE) / 255 - 0.5) * 1.5625) + 0.5) * 255)), 6)) AS INT)"
_ra("contrast", lambda r: point.contrast(r, 25.0), f"x, y, {_each(_CONTRAST, 'rgba')}")
# hue rotation by 75 degrees: base, cosine and sine parts, summed in SQL
_HUE = [[(0.213, 0.787, -0.213), (0.715, -0.715, -0.715), (0.072, -0.072, 0.928)], [(0.213, -0.213, 0.143), (0.715, 0.285, 0.140), (0.072, -0.072, -0.283)], [(0.213, -0.213, -0.787), (0.715, -0.715, 0.715), (0.072, 0.928, 0.072)]]
_TURN = lambda v: f"({v[0]}::DOUBLE + cos(radians(75)) * {v[1]} + sin(radians(75)) * {v[2]})"
_r1("huerotate", lambda r: point.huerotate(r, 75), "x, y, " + ", ".join(f"CAST(floor(round(greatest(0.0, least(255.0, {' + '.join(f'{c}::DOUBLE * {_TURN(v)}' for c, v in zip('rgb', row, strict=True))})), 6)) AS INT) AS c{i}" for i, row in enumerate(_HUE)))
_r1("convert_u8_u16", lambda r: point.convert(r, kind="u16"), f"x, y, {_each('@ * 257')}")
_r1("convert_u16_u8", lambda r: point.convert(Raster(r.select([c * 251 for c in r.channels]).pixels, "Rgb", "u16"), kind="u8"), f"x, y, {_each('CAST((@ * 251 + 128) // 257 AS INT)')}")
_r1("convert_f32_u8", lambda r: point.convert(point.convert(r, kind="f32"), kind="u8"), f"x, y, {_RGB}")
_r1("convert_grey_rgba", lambda r: point.convert(point.grayscale(r), layout="Rgba"), f"x, y, {_LUMA} AS c0, {_LUMA} AS c1, {_LUMA} AS c2, 255 AS c3")
_r1("luma_u16", lambda r: point.grayscale(point.convert(r, kind="u16")), "x, y, CAST((2126 * r * 257 + 7152 * g * 257 + 722 * b * 257) // 10000 AS INT) AS c0")
_ra("drop_alpha", lambda r: point.convert(r, layout="Rgb"), f"x, y, {_RGB}")
_ra("alpha_mask", point.to_alpha_mask, "x, y, a AS c0")
_ra("bgra_swizzle", point.swap_red_blue, "x, y, b AS c0, g AS c1, r AS c2, a AS c3")
_r1("posterize_map", lambda r: point.map_channels(r, lambda c: (F.floor(c / 16) * 16).cast("int")), f"x, y, {_each('CAST(@ // 16 * 16 AS INT)')}")
_ra("map_with_alpha", lambda r: point.map_with_alpha(r, lambda c: F.greatest(c - 10, F.lit(0)), lambda a: (a * 0 + 128)), f"x, y, {_each('greatest(@ - 10, 0)')}, 128 AS c3")
_r1("index_bilevel", point.index_bilevel, f"x, y, CASE WHEN {_LUMA} > 127 THEN 1 ELSE 0 END AS c0")
_r1("bilevel_lookup", lambda r: point.lookup_bilevel(point.index_bilevel(r)), f"x, y, CASE WHEN {_LUMA} > 127 THEN 255 ELSE 0 END AS c0")
_PALETTE = [(0, 0, 0), (255, 255, 255), (200, 30, 30), (30, 200, 30), (30, 30, 200), (128, 128, 128)]
_r1("index_colors", lambda r: point.index_colors(r, _PALETTE), "x, y, CAST(list_position(d, list_min(d)) - 1 AS INT) AS c0", "FROM (SELECT *, [" + ", ".join(f"(r - {p[0]}) * (r - {p[0]}) + (g - {p[1]}) * (g - {p[1]}) + (b - {p[2]}) * (b - {p[2]})" for p in _PALETTE) + "] AS d FROM r1)")
_ra("premultiply", point.premultiply, f"x, y, {_each('CAST(floor(round(CAST(@ AS DOUBLE) * a / 255, 6) + 0.5) AS INT)')}, a AS c3")
_r1("cmyk_to_rgb", lambda r: r.select(S.cmyk_to_rgb(*r.channels, F.col("x"))), f"x, y, {_each('CAST((255 - @) * (255 - x) // 255 AS INT)')}")
_YCC = [("r + 1.402::DOUBLE * (b - 128)"), "r - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128)", "r + 1.772::DOUBLE * (g - 128)"]
_r1("ycbcr_to_rgb", lambda r: r.select(S.ycbcr_to_rgb(*r.channels)), "x, y, " + ", ".join(f"greatest(0, least(255, {_HALF.format(e)})) AS c{i}" for i, e in enumerate(_YCC)))
_LIN = "CASE WHEN @ / 255.0::DOUBLE <= 0.04045 THEN @ / 255.0::DOUBLE / 12.92 ELSE pow((@ / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_r1("srgb_to_linear", lambda r: point.convert_color_space(r, ("srgb", "srgb"), ("srgb", "linear")), "x, y, " + _each(_HALF.format(f"({_LIN}) * 255")))
# linear sRGB to Display P3, from the chromaticities in exact fractions
_P3 = [[0.82246196871436228, 0.17753803128563775, 0.0], [0.033194198850961622, 0.96680580114903836, 0.0], [0.017082630721120033, 0.072397440663963475, 0.91051992861491649]]
_P3_SQL = [" + ".join(f"l{c} * CAST({m[j]!r} AS DOUBLE)" for j, c in enumerate("rgb")) for m in _P3]
_GAMMA = "CASE WHEN v{0} <= 0.0031308 THEN v{0} * 12.92 ELSE 1.055 * pow(v{0}, 1 / 2.4::DOUBLE) - 0.055 END"
_r1("srgb_to_display_p3", lambda r: point.convert_color_space(r, ("srgb", "srgb"), ("display-p3", "srgb")), "x, y, " + ", ".join(_HALF.format(f"({_GAMMA.format(i)}) * 255") + f" AS c{i}" for i in range(3)),
    "FROM (SELECT x, y, " + ", ".join(f"greatest(0.0, least(1.0, {e})) AS v{i}" for i, e in enumerate(_P3_SQL)) + " FROM (SELECT x, y, " + ", ".join(f"{_LIN.replace('@', c)} AS l{c}" for c in "rgb") + " FROM r1))")


# --- colour spaces: every transfer function there and back, and primaries by matrices in exact fractions
_TRANSFERS = {  # to linear light, and back, of a value v
    "bt709": ("CASE WHEN v < 0.081 THEN v / 4.5 ELSE pow((v + 0.099) / 1.099, 1 / 0.45::DOUBLE) END", "CASE WHEN v < 0.018 THEN v * 4.5 ELSE 1.099 * pow(v, 0.45) - 0.099 END"),
    "gamma22": ("pow(v, 2.2)", "pow(v, 1 / 2.2::DOUBLE)"),
    "gamma28": ("pow(v, 2.8)", "pow(v, 1 / 2.8::DOUBLE)"),
    "smpte240m": ("CASE WHEN v < 0.0912 THEN v / 4 ELSE pow((v + 0.1115) / 1.1115, 1 / 0.45::DOUBLE) END", "CASE WHEN v < 0.0228 THEN v * 4 ELSE 1.1115 * pow(v, 0.45) - 0.1115 END"),
    "linear": ("v", "v"),
    "log100": ("CASE WHEN v <= 0 THEN 0.005 ELSE pow(10, 2 * (v - 1)) END", "CASE WHEN v < 0.01 THEN 0 ELSE 1 + log10(v) / 2 END"),
    "log316": ("CASE WHEN v <= 0 THEN pow(10, -2.5) / 2 ELSE pow(10, 2.5 * (v - 1)) END", "CASE WHEN v < pow(10, -2.5) THEN 0 ELSE 1 + log10(v) / 2.5 END"),
    "smpte428": ("pow(v, 2.6) * 52.37 / 48", "pow(v * 48 / 52.37, 1 / 2.6::DOUBLE)"),
    "hlg": ("CASE WHEN v <= 0.5 THEN v * v / 3 ELSE (exp((v - 0.55991073) / 0.17883277) + 0.28466892) / 12 END", "CASE WHEN v <= 1 / 12::DOUBLE THEN sqrt(3 * v) ELSE 0.17883277 * ln(12 * v - 0.28466892) + 0.55991073 END"),
}
for _t, (_there, _back) in _TRANSFERS.items():
    _r1(f"transfer_{_t}", lambda r, t=_t: r.select([S.round_to(colour.to_linear(r.channels[0].cast("double") / 255, t) * 65535, "u16"), S.round_to(colour.from_linear(r.channels[1].cast("double") / 255, t) * 65535, "u16"), r.channels[2]]),
        f"x, y, CAST(greatest(0, least(65535, floor(round(({_there.replace('v', '(r / 255::DOUBLE)').replace('pow(10, -2.5) / 2', '0.0015811388300841897::DOUBLE')}) * 65535, 6) + 0.5))) AS INT) AS c0, CAST(greatest(0, least(65535, floor(round(({_back.replace('v', '(g / 255::DOUBLE)')}) * 65535, 6) + 0.5))) AS INT) AS c1, b AS c2")
# matrices between linear primaries, row by row
_MATRICES = {
    "rec2020": [[0.627403895934699, 0.3292830383778837, 0.043313065687417225], [0.06909728935823208, 0.9195403950754587, 0.011362315566309178], [0.01639143887515028, 0.08801330787722575, 0.895595253247624]],
    "bt470bg": [[0.9578147643764428, 0.04218523562355722, 0.0], [0.0, 1.0, 0.0], [0.0, -0.01193412189803612, 1.0119341218980362]],
    "bt601": [[1.065379033769955, -0.05540087282452723, -0.009978160945427632], [-0.0196325498731453, 1.0363630945786033, -0.016730544705458057], [0.0016320510640102004, 0.0044123731575076075, 0.9939555757784821]],
    "ebu3213": [[0.9748495052755005, 0.027295350214464904, -0.0021448554899654486], [-0.020000287401169076, 1.0542090446840986, -0.03420875728292956], [0.0016907496530498647, 0.0015637868386342844, 0.9967454635083158]],
    "bt470m": [[0.6783564046655348, 0.2884793690460443, 0.03316422628842088], [0.016513159521436147, 1.0520089101921741, -0.06852206971361036], [0.01791784093535546, 0.0506311652730081, 0.9314509937916364]],
    "film": [[0.7514173604314807, 0.23960166258705654, 0.008980976981462767], [0.03367298543734918, 0.9497106666910587, 0.016616347871592083], [0.016938513534489365, 0.05856136314390116, 0.9245001233216095]],
    "dci-p3": [[0.8685797397161324, 0.12891913846084704, 0.0025011218230205435], [0.03454041025431944, 0.96181138636192, 0.0036482033837605824], [0.01677142904145027, 0.07103999778688584, 0.9121885731716639]],
    "xyz": [[0.4384487842192455, 0.39217592919722744, 0.16937528658352713], [0.2228276920549055, 0.7086912980969594, 0.0684810098481351], [0.017313736192152755, 0.11044502648170916, 0.8722412373261381]],
}
for _p, _rows in _MATRICES.items():
    _r1(f"primaries_{_p.replace('-', '_')}", lambda r, p=_p: point.convert_color_space(r, ("srgb", "linear"), (p, "linear")), "x, y, " + ", ".join(f"CAST(greatest(0, least(255, floor(round(greatest(0.0, least(1.0, ({' + '.join(f'{c} / 255::DOUBLE * {v!r}::DOUBLE' for c, v in zip('rgb', row, strict=True))}))) * 255, 6) + 0.5))) AS INT) AS c{i}" for i, row in enumerate(_rows)))
_r1("luma_rec2020", lambda r: point.to_luma(r, "rec2020"), "x, y, CAST(floor(round(r * 0.26270021201126703::DOUBLE + g * 0.677998071518871::DOUBLE + b * 0.05930171646986194::DOUBLE, 6) + 0.5) AS INT) AS c0")
_r1("yuv_limited_bt709", lambda r: r.select(colour.yuv_to_rgb(*r.channels, "bt709", False)), "x, y, " + ", ".join(f"CAST(greatest(0, least(255, floor(round({e}, 6) + 0.5))) AS INT) AS c{i}" for i, e in enumerate(("yy + 1.5748 * vv", "(yy - 0.2126 * (yy + 1.5748 * vv) - 0.0722 * (yy + 1.8556 * uu)) / 0.7152", "yy + 1.8556 * uu"))), "FROM (SELECT x, y, (r - 16) * 255 / 219::DOUBLE AS yy, (g - 128) * 255 / 224::DOUBLE AS uu, (b - 128) * 255 / 224::DOUBLE AS vv FROM r1)")
_r1("ycgco", lambda r: r.select(colour.ycgco_to_rgb(*r.channels)), f"x, y, {', '.join(f'CAST(greatest(0, least(255, {e})) AS INT) AS c{i}' for i, e in enumerate(('r - (g - 128) + (b - 128)', 'r + (g - 128)', 'r - (g - 128) - (b - 128)')))}")
_r1("expand_bits", lambda r: r.select([colour.expand_bits(c % 2**n, n) for c, n in zip(r.channels, (1, 2, 4), strict=True)]), "x, y, r % 2 * 255 AS c0, g % 4 * 85 AS c1, b % 16 * 17 AS c2")
_add("nearest_color", lambda spark, d: _out(point.nearest_color(events_raster(spark, d), spark.range(300).selectExpr("cast(id as int) as idx", "cast(id * 7 % 256 as int) as c0", "cast(id * 13 % 256 as int) as c1", "cast(id * 29 % 256 as int) as c2"))),
     f"WITH {R1}, p AS (SELECT CAST(i AS INT) AS idx, i * 7 % 256 AS pr, i * 13 % 256 AS pg, i * 29 % 256 AS pb FROM range(300) t(i)) SELECT x, y, arg_min(idx, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 1000 + idx) AS c0 FROM r1, p GROUP BY x, y")


def _palette(spark: SparkSession, d: str) -> DataFrame:
    """Parts 1 to 200 as colours."""
    part = spark.read.parquet(f"{d}/part.parquet").where("p_partkey between 1 and 200")
    return part.select(F.col("p_partkey").cast("int").alias("idx"), (F.col("p_size") * 5).cast("int").alias("c0"), (F.col("p_partkey") % 256).cast("int").alias("c1"), (F.floor("p_retailprice") % 256).cast("int").alias("c2"))


_add(
    "expand_palette",
    lambda spark, d: _out(point.expand_palette(point.grayscale(events_raster(spark, d)), _palette(spark, d), 17)),
    f"WITH {R1}, l AS (SELECT x, y, {_LUMA} AS i FROM r1), p AS (SELECT p_partkey AS k, CAST(p_size * 5 AS INT) AS c0, CAST(p_partkey % 256 AS INT) AS c1, CAST(floor(p_retailprice) % 256 AS INT) AS c2 FROM part WHERE p_partkey BETWEEN 1 AND 200) "
    "SELECT x, y, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, CASE WHEN k IS NULL OR k = 17 THEN 0 ELSE 255 END AS c3 FROM l LEFT JOIN p ON l.i = p.k",
)

# --- geometry
_r1("crop", lambda r: geometry.crop(r, 10, 20, 50, 500), f"x - 10 AS x, y - 20 AS y, {_RGB}", "FROM r1 WHERE x BETWEEN 10 AND 59 AND y BETWEEN 20 AND 519")
_r1("view", lambda r: geometry.view(r, 5, 1, 40, 8), f"x - 5 AS x, y - 1 AS y, {_RGB}", "FROM r1 WHERE x BETWEEN 5 AND 44 AND y BETWEEN 1 AND 8")
_r1("rotate90", geometry.rotate90, f"h - 1 - y AS x, x AS y, {_RGB}")
_r1("rotate180", geometry.rotate180, f"w - 1 - x AS x, h - 1 - y AS y, {_RGB}")
_r1("rotate270", geometry.rotate270, f"y AS x, w - 1 - x AS y, {_RGB}")
_r1("flip_horizontal", geometry.flip_horizontal, f"w - 1 - x AS x, y, {_RGB}")
_r1("flip_vertical", geometry.flip_vertical, f"x, h - 1 - y AS y, {_RGB}")
for _o, _place in {1: "x, y", 2: "w - 1 - x AS x, y", 3: "w - 1 - x AS x, h - 1 - y AS y", 4: "x, h - 1 - y AS y", 5: "y AS x, x AS y", 6: "h - 1 - y AS x, x AS y", 7: "h - 1 - y AS x, w - 1 - x AS y", 8: "y AS x, w - 1 - x AS y"}.items():
    _r1(f"orientation_{_o}", lambda r, o=_o: geometry.orient(r, F.lit(o)), f"{_place}, {_RGB}")
_add("rotate90_corpus", lambda spark, d: (lambda r: r.pixels.select("picture_id", "x", "y", "c0"))(geometry.rotate90(embeddings_raster(spark, d))), f"WITH {R2} SELECT CAST(vec_id AS VARCHAR) AS picture_id, 7 - y AS x, x AS y, v AS c0 FROM r2")
_r1("get_pixel", lambda r: geometry.get_pixel(r, 42, 3), f"x, y, {_RGB}", "FROM r1 WHERE x = 42 AND y = 3")
_r1("put_pixel", lambda r: geometry.put_pixel(r, 1, 2, [9, 8, 7]), f"x, y, {', '.join(f'CASE WHEN x = 1 AND y = 2 THEN {v} ELSE {c} END AS c{i}' for i, (c, v) in enumerate(zip('rgb', (9, 8, 7), strict=True)))}")
_add(
    "resize_dimensions",
    lambda spark, d: embeddings_raster(spark, d).pixels.select("picture_id", "w", "h").distinct().select("picture_id", *(c.alias(n) for n, c in zip(("fit_w", "fit_h", "fill_w", "fill_h"), (*geometry.resize_dimensions(F.col("w") * 3, F.col("h"), 100, 77), *geometry.resize_dimensions(F.col("w") * 3, F.col("h"), 100, 77, True)), strict=True))),
    "SELECT CAST(vec_id AS VARCHAR) AS picture_id, 100 AS fit_w, 33 AS fit_h, 231 AS fill_w, 77 AS fill_h FROM embeddings",
)

# --- two pictures
_BLUE = lambda r: Raster(r.where((F.col("x") < 40) & (F.col("y") < 6)).select([(F.col("x") * 5).cast("int"), (F.col("y") * 20).cast("int"), F.lit(200), ((F.col("x") * 11 + F.col("y") * 50) % 256).cast("int")], layout="Rgba").pixels, "Rgba")
_TOP = "t AS (SELECT x AS tx, y AS ty, x * 5 AS tr, y * 20 AS tg, 200 AS tb, (x * 11 + y * 50) % 256 AS ta FROM r1 WHERE x < 40 AND y < 6)"
_ON = "FROM ra LEFT JOIN t ON x = tx + 30 AND y = ty + 2"


def _mixed(u: str, o: str) -> str:
    f = f"floor(round((CAST({o} AS DOUBLE) / 255 * (ta / 255.0::DOUBLE) + CAST({u} AS DOUBLE) / 255 * (a / 255.0::DOUBLE) * (1 - ta / 255.0::DOUBLE)) / nullif(a / 255.0::DOUBLE + ta / 255.0::DOUBLE - a / 255.0::DOUBLE * (ta / 255.0::DOUBLE), 0) * 255, 6) + 0.5)"
    return f"CASE WHEN ta IS NULL OR ta = 0 THEN {u} WHEN ta = 255 THEN {o} ELSE coalesce(CAST(greatest(0, least(255, {f})) AS INT), {u}) END"


_OVER_ALPHA = "CASE WHEN ta IS NULL OR ta = 0 THEN a WHEN ta = 255 THEN ta ELSE CAST(floor(round((a / 255.0::DOUBLE + ta / 255.0::DOUBLE - a / 255.0::DOUBLE * (ta / 255.0::DOUBLE)) * 255, 6) + 0.5) AS INT) END"
_add("overlay", lambda spark, d: (lambda r: _out(compose.overlay(with_alpha(r), _BLUE(r), 30, 2)))(events_raster(spark, d)), f"WITH {R1}, {_TOP} SELECT x, y, {_mixed('r', 'tr')} AS c0, {_mixed('g', 'tg')} AS c1, {_mixed('b', 'tb')} AS c2, {_OVER_ALPHA} AS c3 {_ON}")
_add("replace", lambda spark, d: (lambda r: _out(compose.replace(with_alpha(r), _BLUE(r), 30, 2)))(events_raster(spark, d)), f"WITH {R1}, {_TOP} SELECT x, y, coalesce(tr, r) AS c0, coalesce(tg, g) AS c1, coalesce(tb, b) AS c2, coalesce(ta, a) AS c3 {_ON}")
_r1("tile", lambda r: compose.tile(r, geometry.crop(r, 3, 1, 7, 4), 7, 4), "p.x, p.y, t.r AS c0, t.g AS c1, t.b AS c2", "FROM r1 p JOIN r1 t ON t.x = p.x % 7 + 3 AND t.y = p.y % 4 + 1")
_r1("copy_within", lambda r: compose.copy_within(r, 0, 0, 30, 5, 10, 3), "p.x, p.y, coalesce(s.r, p.r) AS c0, coalesce(s.g, p.g) AS c1, coalesce(s.b, p.b) AS c2", "FROM r1 p LEFT JOIN (SELECT * FROM r1 WHERE x < 30 AND y < 5) s ON p.x = s.x + 10 AND p.y = s.y + 3")
_r1("copy_from", lambda r: compose.copy_from(r, geometry.crop(point.invert(r), 0, 0, 20, 4), 50, 5), "p.x, p.y, coalesce(255 - s.r, p.r) AS c0, coalesce(255 - s.g, p.g) AS c1, coalesce(255 - s.b, p.b) AS c2", "FROM r1 p LEFT JOIN (SELECT * FROM r1 WHERE x < 20 AND y < 4) s ON p.x = s.x + 50 AND p.y = s.y + 5")
_add("set_alpha", lambda spark, d: (lambda r: _out(compose.set_alpha_channel(with_alpha(r), point.grayscale(r))))(events_raster(spark, d)), f"WITH {R1} SELECT x, y, {_RGB}, {_LUMA} AS c3 FROM ra")
_r1("combine_difference", lambda r: compose.combine(r, geometry.flip_horizontal(r), lambda a, b: F.abs(a - b)), "p.x, p.y, abs(p.r - q.r) AS c0, abs(p.g - q.g) AS c1, abs(p.b - q.b) AS c2", "FROM r1 p JOIN r1 q ON q.x = p.w - 1 - p.x AND q.y = p.y")
_add("beside", lambda spark, d: (lambda r: _out(compose.beside(r, point.invert(r))))(events_raster(spark, d)), f"WITH {R1} SELECT x, y, {_RGB} FROM r1 UNION ALL SELECT x + 100, y, 255 - r, 255 - g, 255 - b FROM r1")

# --- generators
_SIZES = lambda spark, d: spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("vec_id").cast("string").alias("picture_id"), (F.col("vec_id") % 9 + 1).cast("int").alias("w"), (F.col("vec_id") % 5 + 1).cast("int").alias("h"))
_GRID = "grid AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS picture_id, CAST(vec_id % 9 + 1 AS INT) AS w, CAST(vec_id % 5 + 1 AS INT) AS h, CAST(i % (vec_id % 9 + 1) AS INT) AS x, CAST(i // (vec_id % 9 + 1) AS INT) AS y FROM (SELECT vec_id, unnest(range((vec_id % 9 + 1) * (vec_id % 5 + 1))) AS i FROM embeddings))"
_SHADE = lambda at, size: f"CAST(floor(round(255 * (CASE WHEN {size} > 1 THEN CAST({at} AS DOUBLE) / ({size} - 1) ELSE 0 END), 6)) AS INT) AS c0, CAST(floor(round(200 - 180 * (CASE WHEN {size} > 1 THEN CAST({at} AS DOUBLE) / ({size} - 1) ELSE 0 END), 6)) AS INT) AS c1, 10 AS c2"
for _name, _at, _size in (("vertical", "y", "h"), ("horizontal", "x", "w")):
    _add(f"gradient_{_name}", lambda spark, d, v=_name == "vertical": generate.gradient_over(_SIZES(spark, d), [0, 200, 10], [255, 20, 10], v).pixels.select("picture_id", "x", "y", "c0", "c1", "c2"), f"WITH {_GRID} SELECT picture_id, x, y, {_SHADE(_at, _size)} FROM grid")
_add("from_fn", lambda spark, d: generate.over(_SIZES(spark, d), lambda x, y, w, h: [(x * y) % 256, F.abs(x - y), w * h - x]).pixels.select("picture_id", "w", "h", "x", "y", "c0", "c1", "c2"), f"WITH {_GRID} SELECT picture_id, w, h, x, y, x * y % 256 AS c0, abs(x - y) AS c1, w * h - x AS c2 FROM grid")
_add("from_raw", lambda spark, d: (lambda r: r.pixels.select("picture_id", "x", "y", "c0", "c1", "c2", "c3"))(generate.from_raw(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("picture_id"), F.lit(4).alias("w"), F.lit(4).alias("h"), "embedding"), "embedding", "Rgba", "f32")),
     "SELECT CAST(vec_id AS VARCHAR) AS picture_id, CAST(p % 4 AS INT) AS x, CAST(p // 4 AS INT) AS y, embedding[4 * p + 1] AS c0, embedding[4 * p + 2] AS c1, embedding[4 * p + 3] AS c2, embedding[4 * p + 4] AS c3 FROM (SELECT vec_id, embedding, unnest(generate_series(0, 15)) AS p FROM embeddings)")
_add("into_raw", lambda spark, d: generate.into_raw(embeddings_raster(spark, d)).select("picture_id", F.col("samples")[9].alias("s9"), F.col("samples")[63].alias("s63"), F.size("samples").alias("n")), "SELECT CAST(vec_id AS VARCHAR) AS picture_id, embedding[10] AS s9, embedding[64] AS s63, CAST(len(embedding) AS INT) AS n FROM embeddings")
_add("rows", lambda spark, d: generate.rows(point.grayscale(events_raster(spark, d))).select("y", F.aggregate("samples", F.lit(0), lambda a, v: a + v).cast("bigint").alias("total"), F.col("samples")[0].alias("c0")), f"WITH {R1} SELECT y, CAST(sum({_LUMA}) AS BIGINT) AS total, arg_min({_LUMA}, x) AS c0 FROM r1 GROUP BY y")

# --- aggregation and resampling
_r1("thumbnail", lambda r: resample.thumbnail_exact(r, 10, 10), "x, y, " + _each("CAST((sum(@) + count(*) // 2) // count(*) AS INT)"), "FROM (SELECT CAST(x * 10 // w AS INT) AS x, CAST(y * 10 // h AS INT) AS y, r, g, b FROM r1) GROUP BY 1, 2")
_r1("thumbnail_odd", lambda r: resample.thumbnail_exact(r, 7, 3), "x, y, " + _each("CAST((sum(@) + count(*) // 2) // count(*) AS INT)"), "FROM (SELECT CAST(x * 7 // w AS INT) AS x, CAST(y * 3 // h AS INT) AS y, r, g, b FROM r1) GROUP BY 1, 2")
_ra("constant_alpha", lambda r: Raster(resample.has_constant_alpha(r).select(F.lit(0).alias("x"), F.lit(0).alias("y"), *[F.col("constant").cast("int").alias(f"c{i}") for i in range(4)]), "Rgba"), "0 AS x, 0 AS y, " + ", ".join(f"CAST(min(a) = max(a) AS INT) AS c{i}" for i in range(4)))


_PI = "3.141592653589793::DOUBLE"
#: Kernels in SQL of the distance t, and their supports.
_KERNELS = {
    "triangle": ("greatest(0.0, 1 - abs(t))", 1),
    "catmull_rom": ("CASE WHEN abs(t) < 1 THEN 1.5 * pow(abs(t), 3) - 2.5 * t * t + 1 WHEN abs(t) < 2 THEN -0.5 * pow(abs(t), 3) + 2.5 * t * t - 4 * abs(t) + 2 ELSE 0 END", 2),
    "gaussian": ("exp(-2 * t * t)", 3),
    "lanczos3": (f"CASE WHEN t = 0 THEN 1 WHEN abs(t) < 3 THEN 3 * sin({_PI} * t) * sin({_PI} * t / 3) / ({_PI} * {_PI} * t * t) ELSE 0 END", 3),
}


def _weights_sql(name: str, size: str, new_size: str, filter_name: str) -> str:
    """A table of (o, i, k): normal weights of all taps of an axis."""
    kernel, support = _KERNELS[filter_name]
    low, high = f"greatest(0, least(n - 1, floor(centre - {support} * greatest(ratio, 1))))", f"least(n, ceil(centre + {support} * greatest(ratio, 1)))"
    places = f"SELECT o, (o + 0.5::DOUBLE) * n / m AS centre, n / m::DOUBLE AS ratio, n FROM (SELECT unnest(range(m)) AS o, n, m FROM (SELECT {size} AS n, {new_size} AS m FROM (SELECT max(w) AS w, max(h) AS h FROM r1)))"
    taps = f"SELECT o, i, (i + 0.5::DOUBLE - centre) / greatest(ratio, 1) AS t FROM (SELECT *, unnest(range(CAST({low} AS BIGINT), CAST(greatest({low} + 1, {high}) AS BIGINT))) AS i FROM ({places}))"
    return f"{name} AS (SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS k FROM (SELECT o, i, {kernel} AS k FROM ({taps})))"


def _resize(name: str, filter_name: str, new_w: int, new_h: tuple[int, int]) -> None:
    """The whole events raster to a width and a share of its height; and with an alpha channel, premultiplied meanwhile."""
    height = f"greatest(1, h * {new_h[0]} // {new_h[1]})"
    passes = lambda source, channels: f"{_weights_sql('wy', 'h', height, filter_name)}, {_weights_sql('wx', 'w', str(new_w), filter_name)}, v AS (SELECT x, o AS y, {(sums := ', '.join(f'sum({c} * k) AS {c}' for c in channels))} FROM {source} JOIN wy ON y = i GROUP BY x, o), z AS (SELECT o AS x, y, {sums} FROM v JOIN wx ON x = i GROUP BY o, y)"
    cut = f"greatest(0, least(255, {_HALF.format('@')}))"
    tall = lambda: F.greatest(F.lit(1), F.expr(f"cast(h * {new_h[0]} div {new_h[1]} as int)"))
    _add(name, lambda spark, d: _out(resample.resize_exact(events_raster(spark, d), new_w, tall(), filter_name)), f"WITH {R1}, {passes('r1', 'rgb')} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, {_each(cut)} FROM z")
    held = ", ".join(f"{_HALF.format(f'CAST({c} AS DOUBLE) * a / 255')} AS {c}" for c in "rgb")
    whole = ", ".join(f"{cut.replace('@', c)} AS {c}" for c in "rgba")
    again = _each(f"coalesce({cut.replace('@', 'CAST(@ AS DOUBLE) * 255 / nullif(a, 0)')}, 0)")
    _add(f"{name}_whole", lambda spark, d: _out(resample.resize_to(with_alpha(events_raster(spark, d)), new_w, tall(), filter_name)), f"WITH {R1}, pm AS (SELECT x, y, w, h, a, {held} FROM ra), {passes('pm', 'rgba')} SELECT x, y, {again}, a AS c3 FROM (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, {whole} FROM z)")


for _f in ("triangle", "catmull_rom", "gaussian", "lanczos3"):
    _resize(f"resize_{_f}", _f, 40, (6, 10))
_resize("enlarge_triangle", "triangle", 150, (17, 10))
_NEAREST = f"WITH {R1} SELECT CAST(ox AS INT) AS x, CAST(oy AS INT) AS y, {_RGB} FROM (SELECT unnest(range(30)) AS ox), (SELECT unnest(range(h * 25 // 10)) AS oy, h AS tall FROM (SELECT max(h) AS h FROM r1)) JOIN r1 ON r1.x = CAST(floor((ox + 0.5) * 100 / 30) AS INT) AND r1.y = CAST(floor((oy + 0.5) * tall / (tall * 25 // 10)) AS INT)"
_add("resize_nearest", lambda spark, d: _out(resample.resize_exact(events_raster(spark, d), 30, F.expr("cast(h * 25 div 10 as int)"), "nearest")), _NEAREST)
_add("resize_nearest_whole", lambda spark, d: _out(resample.resize_to(with_alpha(events_raster(spark, d)), 30, F.expr("cast(h * 25 div 10 as int)"), "nearest")), _NEAREST.replace("b AS c2 FROM", "b AS c2, a AS c3 FROM").replace("JOIN r1 ON r1.x", "JOIN ra r1 ON r1.x"))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """A place for every event."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.lit("events").alias("picture_id"), F.col("event_id").alias("probe"), ((F.col("event_id") * 37 % 1001) / 1000.0).alias("u"), ((F.col("event_id") * 91 % 1003) / 1000.0).alias("v"))


_PROBES = "pr AS (SELECT event_id AS probe, (event_id * 37 % 1001) / 1000.0::DOUBLE AS u, (event_id * 91 % 1003) / 1000.0::DOUBLE AS v FROM events), pl AS (SELECT probe, CASE WHEN v <= 1 THEN greatest(0.0, least(w - 1.0, u * w - 0.5)) END AS qx, CASE WHEN v <= 1 THEN greatest(0.0, least(h - 1.0, v * h - 0.5)) END AS qy FROM pr, (SELECT max(w) AS w, max(h) AS h FROM r1))"
_NEAREST = f"WITH {R1}, {_PROBES} SELECT probe, r AS c0, g AS c1, b AS c2 FROM pl LEFT JOIN r1 ON x = CAST(floor(qx + 0.5) AS INT) AND y = CAST(floor(qy + 0.5) AS INT)"
_BILINEAR = (
    f"WITH {R1}, {_PROBES}, s AS (SELECT probe, sum(k * r) AS r, sum(k * g) AS g, sum(k * b) AS b FROM (SELECT probe, dx, dy, qx, qy, (CASE WHEN dx = 1 THEN qx - floor(qx) ELSE 1 - (qx - floor(qx)) END) * (CASE WHEN dy = 1 THEN qy - floor(qy) ELSE 1 - (qy - floor(qy)) END) AS k FROM pl, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dx, dy)) q JOIN r1 ON r1.x = CAST(floor(qx) AS INT) + dx AND r1.y = CAST(floor(qy) AS INT) + dy WHERE k > 0 GROUP BY probe) "
    f"SELECT pr.probe, {_each(_HALF.format('@'))} FROM pr LEFT JOIN s ON pr.probe = s.probe"
)
_add("sample_nearest", lambda spark, d: resample.sample_nearest(_probes(spark, d), events_raster(spark, d), F.col("u"), F.col("v")).select("probe", "c0", "c1", "c2"), _NEAREST)
_add("sample_bilinear", lambda spark, d: resample.sample_bilinear(_probes(spark, d), events_raster(spark, d), F.col("u"), F.col("v")).select("probe", "c0", "c1", "c2"), _BILINEAR)
# the same probes on the picture with alpha
_add("sample_nearest_whole", lambda spark, d: resample.sample_nearest(_probes(spark, d), with_alpha(events_raster(spark, d)), F.col("u"), F.col("v")).select("probe", "c0", "c1", "c2", "c3"), _NEAREST.replace("b AS c2 FROM", "b AS c2, a AS c3 FROM").replace("LEFT JOIN r1 ON", "LEFT JOIN ra ON"))
_add("sample_bilinear_whole", lambda spark, d: resample.sample_bilinear(_probes(spark, d), with_alpha(events_raster(spark, d)), F.col("u"), F.col("v")).select("probe", "c0", "c1", "c2", "c3"), _BILINEAR.replace("sum(k * b) AS b FROM", "sum(k * b) AS b, sum(k * a) AS a FROM").replace("q JOIN r1 ON r1.x", "q JOIN ra r1 ON r1.x").replace(_each(_HALF.format("@")), _each(_HALF.format("@"), "rgba")))

# pictures of mixed sizes
_MIXED = "mx AS (SELECT picture_id, wd AS w, CAST(c // wd AS INT) AS h, n % wd AS x, n // wd AS y, v FROM (SELECT user_id AS picture_id, CAST(user_id % 8 + 2 AS INT) AS wd, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS n, count(*) OVER (PARTITION BY user_id) AS c, CAST((event_id * 13) % 256 AS INT) AS v FROM events) WHERE n < c // wd * wd)"


def _mixed_sizes(spark: SparkSession, d: str) -> Raster:
    """A grey picture of each user's events in their order, of width user_id % 8 + 2 and as many full lines as they make."""
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id")
    own = Window.partitionBy("user_id")
    rows = events.select("user_id", "event_id", (F.col("user_id") % 8 + 2).alias("wd"), (F.row_number().over(own.orderBy("event_id")) - 1).alias("n"), F.count("*").over(own).alias("c"))
    rows = rows.withColumn("h", F.expr("c div wd")).where("n < h * wd")
    return from_table(rows, F.col("user_id"), F.col("wd"), F.col("h"), F.col("n") % F.col("wd"), F.floor(F.col("n") / F.col("wd")), [(F.col("event_id") * 13) % 256], "L")


_FIT = "greatest(1, CAST(floor({0} * {1}(5 / w::DOUBLE, 4 / h::DOUBLE) + 0.5) AS INT))"
_FIT_W, _FIT_H = _FIT.format("w", "least"), _FIT.format("h", "least")


def _mixed_out(r: Raster) -> DataFrame:
    return r.pixels.select("picture_id", "w", "h", "x", "y", "c0")


def _mixed_triangle(fit: str, cut: str) -> str:
    """Both passes for each picture, from taps of all its places; fit: least or greatest."""
    wide, tall = _FIT.format("w", fit), _FIT.format("h", fit)
    axis = lambda n, m, at: f"SELECT picture_id, o, i, k / sum(k) OVER (PARTITION BY picture_id, o) AS k FROM (SELECT picture_id, o, i, CASE WHEN n = m THEN CAST(i = o AS INT) ELSE greatest(0.0, 1 - abs((i + 0.5::DOUBLE - c) / greatest(n / m::DOUBLE, 1))) END AS k FROM (SELECT *, unnest(range(CAST(greatest(0, least(n - 1, floor(c - greatest(n / m::DOUBLE, 1)))) AS BIGINT), CAST(least(n, greatest(greatest(0, least(n - 1, floor(c - greatest(n / m::DOUBLE, 1)))) + 1, ceil(c + greatest(n / m::DOUBLE, 1)))) AS BIGINT))) AS i FROM (SELECT *, (o + 0.5::DOUBLE) * n / m AS c FROM (SELECT picture_id, {n} AS n, {m} AS m, unnest(range({m})) AS o FROM sz))))"
    return f"""WITH {_MIXED}, sz AS (SELECT DISTINCT picture_id, w, h FROM mx), wy AS ({axis('h', tall, 'y')}), wx AS ({axis('w', wide, 'x')}),
v AS (SELECT p.picture_id, p.x, o AS y, sum(v * k) / sum(k) AS v FROM mx p JOIN wy ON wy.picture_id = p.picture_id AND p.y = i GROUP BY ALL),
z AS (SELECT p.picture_id, o AS x, p.y, sum(v * k) / sum(k) AS v FROM v p JOIN wx ON wx.picture_id = p.picture_id AND p.x = i GROUP BY ALL), q AS (SELECT z.*, {wide} AS nw, {tall} AS nh FROM z JOIN sz ON sz.picture_id = z.picture_id)
{cut}"""


_V = f"greatest(0, least(255, {_HALF.format('v')}))"
_add("resize_mixed", lambda spark, d: _mixed_out(resample.resize(_mixed_sizes(spark, d), 5, 4)), _mixed_triangle("least", f"SELECT CAST(picture_id AS VARCHAR) AS picture_id, nw AS w, nh AS h, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {_V} AS c0 FROM q"))
_add("resize_to_fill_mixed", lambda spark, d: _mixed_out(resample.resize_to_fill(_mixed_sizes(spark, d), 5, 4)), _mixed_triangle("greatest", f"SELECT CAST(picture_id AS VARCHAR) AS picture_id, least(nw, 5) AS w, least(nh, 4) AS h, CAST(x - (nw - 5) // 2 AS INT) AS x, CAST(y - (nh - 4) // 2 AS INT) AS y, {_V} AS c0 FROM q WHERE x - (nw - 5) // 2 BETWEEN 0 AND 4 AND y - (nh - 4) // 2 BETWEEN 0 AND 3"))
_add("thumbnail_mixed", lambda spark, d: _mixed_out(resample.thumbnail_exact(_mixed_sizes(spark, d), 2, 1)), f"WITH {_MIXED} SELECT CAST(picture_id AS VARCHAR) AS picture_id, 2 AS w, 1 AS h, CAST(x * 2 // w AS INT) AS x, 0 AS y, CAST((sum(v) + count(*) // 2) // count(*) AS INT) AS c0 FROM mx GROUP BY picture_id, w, h, x * 2 // w")

# --- neighbourhoods
_SHARPEN = [0.0, -1.0, 0.0, -1.0, 5.0, -1.0, 0.0, -1.0, 0.0]
_CROSS = [(1, 0), (-1, 0), (0, 1), (0, -1)]
_r1("filter3x3", lambda r: window.filter3x3(r, _SHARPEN), "p.x, p.y, " + ", ".join(f"CASE WHEN p.x > 0 AND p.y > 0 AND p.x < p.w - 1 AND p.y < p.h - 1 THEN greatest(0, least(255, 5 * p.{c} - n0.{c} - n1.{c} - n2.{c} - n3.{c})) ELSE 0 END AS c{i}" for i, c in enumerate("rgb")),
    "FROM r1 p " + " ".join(f"LEFT JOIN r1 n{k} ON n{k}.x = p.x + {dx} AND n{k}.y = p.y + {dy}" for k, (dx, dy) in enumerate(_CROSS)))


def _taps_sql(source: str, axis: str, taps: list[tuple[int, int | str]], finish: str, size: str) -> str:
    """One convolution pass with repeated edges: joins of each pixel with its taps."""
    other = "y" if axis == "x" else "x"
    values = ", ".join(f"({k}, {t})" for k, t in taps)
    sums = ", ".join(finish.replace("@", f"sum(q.{c} * t.k)") + f" AS {c}" for c in "rgb")
    return f"(SELECT p.x, p.y, p.w, p.h, {sums} FROM {source} p, (VALUES {values}) t(d, k) JOIN {source} q ON q.{other} = p.{other} AND q.{axis} = greatest(0, least(p.{size} - 1, p.{axis} + t.d)) GROUP BY p.x, p.y, p.w, p.h)"


def _chain(passes: list[tuple[str, list[tuple[int, int]], str]]) -> str:
    steps, last = [], "r1"
    for n, (axis, taps, finish) in enumerate(passes):
        steps.append(f"p{n} AS {_taps_sql(last, axis, taps, finish, 'w' if axis == 'x' else 'h')}")
        last = f"p{n}"
    return f"WITH {R1}, {', '.join(steps)} SELECT x, y, {_RGB} FROM {last}"


def _box(axis: str, radius: int) -> tuple[str, list[tuple[int, int]], str]:
    n = 2 * radius + 1
    return axis, [(d, 1) for d in range(-radius, radius + 1)], f"CAST((@ + {n // 2}) // {n} AS INT)"


def _gauss(axis: str) -> tuple[str, list[tuple[int, str]], str]:
    """Sigma 1.2: five taps in 15-bit fixed point, made in SQL."""
    raw = lambda d: f"exp(-0.5 * {d * d} / (1.2::DOUBLE * 1.2))"
    total = "(" + " + ".join(raw(d) for d in range(-2, 3)) + ")"
    return axis, [(d, f"CAST(floor({raw(d)} / {total} * 32768) AS INT)") for d in range(-2, 3)], "CAST(least(255, (@ + 16384) // 32768) AS INT)"


_add("box_blur", lambda spark, d: _out(window.box_pass(window.box_pass(events_raster(spark, d), "x", 2), "y", 2)), _chain([_box("x", 2), _box("y", 2)]))
_add("fast_blur", lambda spark, d: _out(window.fast_blur(events_raster(spark, d), 1.5)), _chain([_box(a, 1) for _ in range(3) for a in "xy"]))
_add("gaussian_blur", lambda spark, d: _out(window.gaussian_blur(events_raster(spark, d), 1.2)), _chain([_gauss("x"), _gauss("y")]))
_add(
    "unsharpen",
    lambda spark, d: _out(window.unsharpen(events_raster(spark, d), 1.2, 5)),
    f"WITH s AS ({_chain([_gauss('x'), _gauss('y')])}), {R1} SELECT p.x, p.y, " + ", ".join(f"CASE WHEN abs(p.{c} - s.c{i}) > 5 THEN greatest(0, least(255, 2 * p.{c} - s.c{i})) ELSE p.{c} END AS c{i}" for i, c in enumerate("rgb")) + " FROM r1 p JOIN s ON p.x = s.x AND p.y = s.y",
)
_add("dither", lambda spark, d: _out(window.dither_bilevel(point.grayscale(events_raster(spark, d)))))

# --- error diffusion over many small pictures: in SQL one pixel after the other, the picture being a list
_PART = "CAST(trunc((v[i + 1] - CASE WHEN v[i + 1] > 127 THEN 255 ELSE 0 END) * {0} / 16.0) AS INT)"
_MOVED = "CASE " + " ".join(f"WHEN j = i + {at} AND {ok} THEN greatest(0, least(255, v[j + 1] + {_PART.format(part)}))" for at, ok, part in ((1, "i % 8 < 7", 7), (7, "i % 8 > 0", 3), (8, "true", 5), (9, "i % 8 < 7", 1))) + " ELSE v[j + 1] END"
_add("dither_corpus", lambda spark, d: window.dither_bilevel(_coded(spark, d, "L", "u8")).pixels.select("picture_id", "x", "y", "c0"),
     f"""WITH RECURSIVE p AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(abs(e) * 1000) % 256 AS INT)) AS v FROM embeddings),
st AS (SELECT vec_id, 0 AS i, v, 0 AS c0 FROM p UNION ALL SELECT vec_id, i + 1, list_transform(range(64), lambda j: {_MOVED}), CASE WHEN v[i + 1] > 127 THEN 255 ELSE 0 END FROM st WHERE i < 64)
SELECT CAST(vec_id AS VARCHAR) AS picture_id, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y, c0 FROM st WHERE i > 0""")  # fmt: skip
_BLUR = [f"exp(-0.5 * {d * d} / (0.8::DOUBLE * 0.8))" for d in (-1, 0, 1)]
_add("blur", lambda spark, d: _out(window.blur(events_raster(spark, d), 1.0)), _chain([(a, [(k - 1, f"CAST(floor({t} / ({' + '.join(_BLUR)}) * 32768) AS INT)") for k, t in enumerate(_BLUR)], "CAST(least(255, (@ + 16384) // 32768) AS INT)") for a in "xy"]))

#: A level of an embedding's value.  Like the SQL's, the product is a float: a whole number would make it a double, which may lie below the next level.
_LEVEL = "floor(abs(v) * 1000F) % 256"

# --- animations: five frames of 8 by 8 of each picture, on a canvas of 12 by 9
_SHAPES = "fr AS (SELECT vec_id // 5 AS p, vec_id % 5 AS f, vec_id % 5 AS l, ['keep', 'background', 'previous'][CAST(vec_id % 3 + 1 AS INT)] AS dispose, ['source', 'over'][CAST(vec_id // 2 % 2 + 1 AS INT)] AS blend, embedding, vec_id FROM embeddings)"
_DRAWN = """fp AS (SELECT p, f, dispose, blend, CAST(i % 8 + l AS INT) AS x, CAST(i // 8 + 1 AS INT) AS y, {'c0': CAST(floor(abs(embedding[i + 1]) * 1000) % 256 AS INT), 'c1': CAST((vec_id * 7 + i) % 256 AS INT), 'c2': CAST(i * 4 AS INT), 'c3': CAST([0, 128, 255][CAST((vec_id + i) % 3 + 1 AS INT)] AS INT)} AS c
  FROM (SELECT *, unnest(range(64)) AS i FROM fr))"""
_NONE = "{'c0': 0, 'c1': 0, 'c2': 0, 'c3': 0}"
_START = f"SELECT p, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(-1 AS BIGINT) AS f, {_NONE} AS now, {_NONE} AS before, {_NONE} AS shown, false AS region, 'background' AS dispose FROM (SELECT DISTINCT p FROM fr), (SELECT unnest(range(12)) AS x), (SELECT unnest(range(9)) AS y)"
_STEP = "FROM st JOIN fr g ON g.p = st.p AND g.f = st.f + 1 LEFT JOIN fp ON fp.p = st.p AND fp.f = st.f + 1 AND fp.x = st.x AND fp.y = st.y"
_FRAMES_OUT = "SELECT CAST(p AS VARCHAR) AS picture_id, CAST(f AS INT) AS frame_no, x, y, shown.c0 AS c0, shown.c1 AS c1, shown.c2 AS c2, shown.c3 AS c3 FROM st WHERE f >= 0"


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", F.expr("cast(vec_id div 5 as string)").alias("picture_id"), F.expr("cast(vec_id % 5 as int)").alias("frame_no"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({by} + 1 as int)"))
    shapes = rows.select("picture_id", "frame_no", F.lit(12).alias("w"), F.lit(9).alias("h"), F.col("frame_no").alias("left"), F.lit(1).alias("top"), F.lit(8).alias("width"), F.lit(8).alias("height"), pick(("keep", "background", "previous"), "vec_id % 3").alias("dispose"), pick(("source", "over"), "vec_id div 2 % 2").alias("blend"))
    drawn = rows.select("*", F.posexplode("embedding").alias("i", "v"))
    colours = [F.expr(f"cast({_LEVEL} as int)"), F.expr("cast((vec_id * 7 + i) % 256 as int)"), F.expr("i * 4"), pick((0, 128, 255), "(vec_id + i) % 3")]
    return shapes, drawn.select("picture_id", "frame_no", F.expr("i % 8").alias("x"), F.expr("cast(i div 8 as int)").alias("y"), *(c.alias(f"c{k}") for k, c in enumerate(colours)))


def _composed(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], step: str) -> None:
    _add(name, lambda spark, d: f(*_frames(spark, d)).select("picture_id", "frame_no", "x", "y", "c0", "c1", "c2", "c3"), f"WITH RECURSIVE {_SHAPES}, {_DRAWN}, st AS ({_START} UNION ALL {step}) {_FRAMES_OUT}")


_SEEN = "CASE WHEN fp.p IS NOT NULL AND fp.c.c3 > 0 THEN fp.c ELSE st.now END"
_composed("frames_transparent", frames.compose_transparent, f"SELECT st.p, st.x, st.y, g.f, CASE WHEN fp.p IS NULL OR g.dispose = 'previous' THEN st.now WHEN g.dispose = 'background' THEN {_NONE} ELSE {_SEEN} END, st.now, {_SEEN}, false, g.dispose {_STEP}")
_BACK = f"CASE WHEN st.region AND st.dispose = 'previous' THEN st.before WHEN st.region AND st.dispose = 'background' THEN {_NONE} ELSE st.now END"
_OVER = lambda c: f"CAST(coalesce(greatest(0, least(255, floor(round((cc.{c} / 255::DOUBLE * (cc.c3 / 255::DOUBLE) + u.{c} / 255::DOUBLE * (u.c3 / 255::DOUBLE) * (1 - cc.c3 / 255::DOUBLE)) / nullif(cc.c3 / 255::DOUBLE + u.c3 / 255::DOUBLE - cc.c3 / 255::DOUBLE * (u.c3 / 255::DOUBLE), 0) * 255, 6) + 0.5))), u.{c}) AS INT)"
_ALPHA = "CAST(floor(round((cc.c3 / 255::DOUBLE + u.c3 / 255::DOUBLE - cc.c3 / 255::DOUBLE * (u.c3 / 255::DOUBLE)) * 255, 6) + 0.5) AS INT)"
_BLENDED = f"CASE WHEN NOT inside THEN u WHEN blend = 'source' OR cc.c3 = 255 THEN cc WHEN cc.c3 = 0 THEN u ELSE {{'c0': {_OVER('c0')}, 'c1': {_OVER('c1')}, 'c2': {_OVER('c2')}, 'c3': {_ALPHA}}} END"
_composed("frames_blended", frames.compose_blended, f"SELECT p, x, y, f, {_BLENDED}, before, {_BLENDED}, inside, dispose FROM (SELECT st.p, st.x, st.y, g.f, {_BACK} AS u, CASE WHEN st.dispose = 'previous' THEN st.before ELSE st.now END AS before, fp.p IS NOT NULL AS inside, fp.c AS cc, g.blend, g.dispose {_STEP})")
_add("frame_delays", lambda spark, d: _frames(spark, d)[0].where("frame_no > 0").select("picture_id", "frame_no", frames.hundredths(frames.delay(F.col("frame_no") * 12345, F.lit(7))).alias("hundredths"), frames.apng_delay(F.col("frame_no"), F.col("frame_no") % 2)["denom"].alias("denom"), frames.saturating_delay(F.col("frame_no").cast("long") * 1_234_567)["numer"].alias("numer")),
     "SELECT CAST(vec_id // 5 AS VARCHAR) AS picture_id, CAST(vec_id % 5 AS INT) AS frame_no, CAST(least(65535, vec_id % 5 * 12345 // 7 // 10) AS INT) AS hundredths, CASE WHEN vec_id % 5 % 2 = 0 THEN 100 ELSE 1 END AS denom, [1234567, 1234567, 3703701, 1234567][CAST(vec_id % 5 AS INT)] AS numer FROM embeddings WHERE vec_id % 5 > 0")
_add("frames_collected", lambda spark, d: frames.collect(frames.skip(_frames(spark, d)[0], 2)).select("picture_id", F.size("frames").alias("n"), F.element_at("frames", 1)["left"].alias("left")), "SELECT CAST(vec_id // 5 AS VARCHAR) AS picture_id, CAST(count(*) AS INT) AS n, CAST(min(vec_id % 5) AS INT) AS \"left\" FROM embeddings WHERE vec_id % 5 >= 2 GROUP BY 1")

# --- codecs: every embedding as a picture of 8 by 8, encoded, its header read, and decoded
_CODED = "SELECT CAST(vec_id AS VARCHAR) AS picture_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, {0} FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)"
_SAMPLES = {"c0": "CAST(floor(abs(embedding[i + 1]) * 1000) % 256 AS INT)", "c1": "CAST((vec_id * 7 + i // 3) % 256 AS INT)", "c2": "CAST(i // 8 * 30 AS INT)", "c3": "CAST((vec_id + i) % 256 AS INT)"}


def _coded(spark: SparkSession, d: str, layout: str, kind: str) -> Raster:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    channels = [F.expr(e) for e in (_LEVEL, "(vec_id * 7 + i div 3) % 256", "i div 8 * 30", "(vec_id + i) % 256")][: {"L": 1, "Rgb": 3, "Rgba": 4}[layout]]
    return from_table(rows, F.col("vec_id"), 8, 8, F.expr("i % 8"), F.expr("i div 8"), [c * 257 for c in channels] if kind == "u16" else channels, layout, kind)


def _codec(fmt: str, layout: str, kind: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        files = pictures.encode(_coded(spark, d, layout, kind), fmt).select(F.col("picture_id").alias("path"), "content", F.lit(fmt).alias("format"))
        return pictures.rasters(pictures.decode(files), layout, kind).pixels.select("picture_id", "x", "y", *(f"c{i}" for i in range(len(channels))))

    channels = list(_SAMPLES)[: {"L": 1, "Rgb": 3, "Rgba": 4}[layout]]
    _add(f"codec_{fmt}_{layout.lower()}_{kind}", run, _CODED.format(", ".join(f"{_SAMPLES[c]}{' * 257' if kind == 'u16' else ''} AS {c}" for c in channels)))


for _f, _layout, _kind in (("bmp", "Rgb", "u8"), ("bmp", "Rgba", "u8"), ("farbfeld", "Rgba", "u16"), ("ico", "Rgba", "u8"), ("png", "L", "u16"), ("png", "Rgba", "u8"), ("pnm", "Rgb", "u8"), ("pnm", "Rgba", "u16"), ("qoi", "Rgb", "u8"), ("qoi", "Rgba", "u8"), ("tga", "L", "u8"), ("tga", "Rgba", "u8")):
    _codec(_f, _layout, _kind)


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """What the headers of the pictures tell in each format, and the format that their first bytes tell."""
    out = None
    for fmt, layout, kind in (("bmp", "Rgb", "u8"), ("farbfeld", "Rgba", "u16"), ("png", "Rgb", "u8"), ("pnm", "Rgb", "u8"), ("qoi", "Rgb", "u8")):
        r = resample.resize_exact(_coded(spark, d, layout, kind), F.col("picture_id").cast("int") % 3 + 1, 2, "nearest")
        files, size = pictures.encode(r, fmt), metadata.dimensions(F.col("content"))
        rows = files.select("picture_id", F.lit(fmt).alias("format"), formats.guess_format(F.col("content")).alias("guessed"), formats.to_mime_type(F.lit(fmt)).alias("mime"), size["w"].alias("w"), size["h"].alias("h"))
        out = rows if out is None else out.unionByName(rows)
    return out


_add("headers", _headers, "SELECT CAST(vec_id AS VARCHAR) AS picture_id, format, format AS guessed, mime, vec_id % 3 + 1 AS w, CAST(2 AS BIGINT) AS h FROM embeddings, (VALUES ('bmp', 'image/bmp'), ('farbfeld', 'application/octet-stream'), ('png', 'image/png'), ('pnm', 'image/x-portable-anymap'), ('qoi', 'image/x-qoi')) t(format, mime)")
_add("mime_types", lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", formats.from_mime_type(F.element_at(F.array(*map(F.lit, ("image/x-ms-bmp", "image/vnd.radiance", "image/apng", "text/html"))), F.expr("cast(page_id % 4 + 1 as int)"))).alias("format")), "SELECT page_id, ['bmp', 'hdr', 'png', NULL][CAST(page_id % 4 + 1 AS INT)] AS format FROM pages")
# an EXIF block of two entries, its second one the orientation, in either order of bytes


def _exif_blocks(spark: SparkSession, d: str) -> DataFrame:
    v = F.lpad(F.hex(F.expr("vec_id % 10")), 2, "0")
    little = F.concat(F.lit("49492A00" "08000000" "0200" "0001" "0300" "01000000" "05000000" "1201" "0300" "01000000"), v, F.lit("000000"))
    big = F.concat(F.lit("4D4D002A" "00000008" "0002" "0100" "0003" "00000001" "00050000" "0112" "0003" "00000001" "00"), v, F.lit("0000"))
    block = F.unhex(F.when(F.col("vec_id") % 2 == 0, little).otherwise(big))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", block.alias("exif"))


def _exif(spark: SparkSession, d: str) -> DataFrame:
    rows = _exif_blocks(spark, d)
    return rows.select("vec_id", metadata.orientation(F.col("exif")).alias("orientation"), metadata.orientation(metadata.without_orientation(F.col("exif"))).alias("cleared"), metadata.to_exif(metadata.orientation(F.col("exif"))).alias("code"))


_add("exif_orientation", _exif, "SELECT vec_id, CAST(nullif(CASE WHEN vec_id % 10 < 9 THEN vec_id % 10 ELSE 0 END, 0) AS INT) AS orientation, CASE WHEN vec_id % 10 BETWEEN 1 AND 8 THEN 1 END AS cleared, CAST(nullif(CASE WHEN vec_id % 10 < 9 THEN vec_id % 10 ELSE 0 END, 0) AS INT) AS code FROM embeddings")

# --- embedded profiles: none, Display P3 with a gamma, Rec. 2020 with the curve of sRGB, and BT.601 with a table
_PROFILES = [None, profiles.encode(profiles.to_pcs("display-p3"), [{"parameters": profiles.CURVES["gamma22"], "table": None}] * 3), profiles.of_space(("rec2020", "srgb")), profiles.encode(profiles.to_pcs("bt601"), [{"parameters": None, "table": (0.0, 0.25, 1.0)}] * 3)]


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """A profile and an EXIF block for every embedding."""
    icc = F.lit(None).cast("binary")
    for k, raw in enumerate(_PROFILES):
        icc = icc if raw is None else F.when(F.col("vec_id") % 4 == k, F.unhex(F.lit(raw.hex()))).otherwise(icc)
    return _exif_blocks(spark, d).select(F.col("vec_id").cast("string").alias("path"), icc.alias("icc"), "exif")


# matrices to linear sRGB: chromaticities adapted to the profile's white by cone responses, in steps of 1/65536, and back
_TO_SRGB = [
    [[1.224939473660301, -0.22494839430085395, -9.374403308640596e-06], [-0.04204725979332885, 1.0420607933552946, 1.306501635964121e-05], [-0.01964222605237716, -0.07862764437339391, 1.098274168329764]],
    [[1.6604919658088355, -0.5876526458062452, -0.07284859823709874], [-0.12455745989165351, 1.1328952952950015, -0.008355288111163296], [-0.018155972389355624, -0.10057710870170317, 1.1187218191513966]],
    [[0.9395352194146765, 0.050167073674707297, 0.010263752025732176], [0.01777970601570418, 0.9657919860577605, 0.016440093043682925], [-0.0016290173037386948, -0.004372025214609139, 1.005986286409474]],
]
_STEP_OF = lambda v: f"(round({v} * 65536) / 65536::DOUBLE)"
_CURVED = f"CASE k WHEN 1 THEN pow(v, {_STEP_OF('2.2::DOUBLE')}) WHEN 2 THEN CASE WHEN v >= {_STEP_OF('0.04045::DOUBLE')} THEN pow({_STEP_OF('(1 / 1.055::DOUBLE)')} * v + {_STEP_OF('(0.055 / 1.055::DOUBLE)')}, {_STEP_OF('2.4::DOUBLE')}) ELSE {_STEP_OF('(1 / 12.92::DOUBLE)')} * v END ELSE CASE WHEN 2 * v < 1 THEN 2 * v * (16384 / 65535::DOUBLE) ELSE 16384 / 65535::DOUBLE + (2 * v - 1) * (1 - 16384 / 65535::DOUBLE) END END"
_TURNED = {2: "7 - x, y", 3: "7 - x, 7 - y", 4: "x, 7 - y", 5: "y, x", 6: "7 - y, x", 7: "7 - y, 7 - x", 8: "y, 7 - x"}


def _profiled_sql() -> str:
    place = lambda i, own: "CASE o " + " ".join(f"WHEN {o} THEN {p.split(', ')[i]}" for o, p in _TURNED.items()) + f" ELSE {own} END"
    linear = ", ".join(f"{_CURVED.replace('v ', f'({c} / 255::DOUBLE) ').replace('(v,', f'({c} / 255::DOUBLE,').replace('v)', f'({c} / 255::DOUBLE))')} AS l{i}" for i, c in enumerate(("c0", "c1", "c2")))
    mixed = ", ".join("CASE k " + " ".join(f"WHEN {k} THEN {' + '.join(f'l{j} * {m[i][j]!r}::DOUBLE' for j in range(3))}" for k, m in enumerate(_TO_SRGB, 1)) + f" END AS m{i}" for i in range(3))
    coded = ", ".join(f"CASE WHEN k = 0 THEN c{i} ELSE CAST(floor(round((CASE WHEN v{i} <= 0.0031308 THEN v{i} * 12.92 ELSE 1.055 * pow(v{i}, 1 / 2.4::DOUBLE) - 0.055 END) * 255, 6) + 0.5) AS INT) END AS c{i}" for i in range(3))
    cut = ", ".join(f"greatest(0.0, least(1.0, m{i})) AS v{i}" for i in range(3))
    pixels = _CODED.format(", ".join(f"{_SAMPLES[c]} AS {c}" for c in ("c0", "c1", "c2")))
    return f"WITH p AS ({pixels}), q AS (SELECT *, CAST(picture_id AS BIGINT) % 4 AS k, CAST(picture_id AS BIGINT) % 10 AS o FROM p), l AS (SELECT *, {linear} FROM q), m AS (SELECT *, {mixed} FROM l), z AS (SELECT *, {cut} FROM m) SELECT picture_id, CAST({place(0, 'x')} AS INT) AS x, CAST({place(1, 'y')} AS INT) AS y, {coded} FROM z"


_add("embedded_profiles", lambda spark, d: profiles.corrected(_coded(spark, d, "Rgb", "u8"), profiles.spaces(_blocks(spark, d))).pixels.select("picture_id", "x", "y", "c0", "c1", "c2"), _profiled_sql())
_add("profile_labels", lambda spark, d: profiles.spaces(_blocks(spark, d)).select("picture_id", "profile.primaries", "profile.transfer", "orientation"), "SELECT CAST(vec_id AS VARCHAR) AS picture_id, [NULL, 'display-p3', 'rec2020', 'bt601'][CAST(vec_id % 4 + 1 AS INT)] AS primaries, [NULL, 'gamma22', 'srgb', 'unspecified'][CAST(vec_id % 4 + 1 AS INT)] AS transfer, CAST(CASE WHEN vec_id % 10 BETWEEN 1 AND 8 THEN vec_id % 10 ELSE 1 END AS INT) AS orientation FROM embeddings")

# --- palettes of each picture: those of its first line, and trained ones
_add("palette_of_each", lambda spark, d: (lambda r: palette.index_of(r, r.pixels.where("y = 0").select("picture_id", F.col("x").alias("idx"), "c0", "c1", "c2")).pixels.select("picture_id", "x", "y", "c0"))(_coded(spark, d, "Rgb", "u8")),
     f"WITH p AS ({_CODED.format(', '.join(f'{_SAMPLES[c]} AS {c}' for c in ('c0', 'c1', 'c2')))}) SELECT p.picture_id, p.x, p.y, CAST(arg_min(q.x, ((p.c0 - q.c0) * (p.c0 - q.c0) + (p.c1 - q.c1) * (p.c1 - q.c1) + (p.c2 - q.c2) * (p.c2 - q.c2)) * 8 + q.x) AS INT) AS c0 FROM p JOIN p q ON q.picture_id = p.picture_id AND q.y = 0 GROUP BY p.picture_id, p.x, p.y")
_add("palette_trained", lambda spark, d: palette.train(events_raster(spark, d), 64))
_add("reduced_colors", lambda spark, d: palette.reduce_colors(_coded(spark, d, "Rgb", "u8"), 64).pixels.select("picture_id", "x", "y", "c0", "c1", "c2"), _CODED.format(", ".join(f"{_SAMPLES[c]} AS {c}" for c in ("c0", "c1", "c2"))))  # 64 pixels have 64 colours at most

# --- budgets over frames: canvases of a picture, then each frame's region
_add("frame_budget", lambda spark, d: frames.within_budget(_frames(spark, d)[0], 1400).select("picture_id", "frame_no", F.col("reserved").cast("long").alias("reserved"), "fits", "error"),
     "SELECT CAST(vec_id // 5 AS VARCHAR) AS picture_id, CAST(vec_id % 5 AS INT) AS frame_no, CAST(864 + 256 * n AS BIGINT) AS reserved, 864 + 256 * n <= 1400 AS fits, CASE WHEN n = 3 THEN 'limits' END AS error FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS n FROM embeddings)")

# --- layouts: one array seen as packed, planar and transposed pictures of 5 by 4, and what each layout is
_LAYOUTS = lambda: [layouts.row_major_packed(3, 5, 4), layouts.planar(3, 5, 4), layouts.transposed(layouts.row_major_packed(3, 4, 5)), layouts.shrink_to(layouts.row_major_packed(4, 4, 4), 3, 5, 4)]
_AT = lambda: F.element_at(F.array(*_LAYOUTS()), F.expr("cast(vec_id % 4 + 1 as int)"))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("vec_id").cast("string").alias("picture_id"), "embedding")


_add("strided_views", lambda spark, d: layouts.from_samples(_embedded(spark, d), "embedding", _AT(), "Rgb", "f32").pixels.select("picture_id", "x", "y", "c0", "c1", "c2"),
     "SELECT CAST(vec_id AS VARCHAR) AS picture_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, embedding[a + 1] AS c0, embedding[a + s + 1] AS c1, embedding[a + 2 * s + 1] AS c2 FROM (SELECT vec_id, embedding, x, y, CASE vec_id % 4 WHEN 0 THEN 3 * x + 15 * y WHEN 1 THEN x + 5 * y WHEN 2 THEN 12 * x + 3 * y ELSE 4 * x + 16 * y END AS a, CASE WHEN vec_id % 4 = 1 THEN 20 ELSE 1 END AS s FROM embeddings, (SELECT unnest(range(5)) AS x), (SELECT unnest(range(4)) AS y) WHERE vec_id % 4 < 3 OR x < 4)")
_add("layout_forms", lambda spark, d: _embedded(spark, d).withColumn("at", _AT()).select("vec_id", layouts.min_length(F.col("at")).alias("least"), layouts.fits(F.col("at"), F.size("embedding") - F.col("vec_id").cast("int") % 7).alias("fits"), layouts.index(F.col("at"), 2, F.col("vec_id") % 6, 3).alias("place"), layouts.has_aliased_samples(F.col("at")).alias("aliased"), *(layouts.is_normal(F.col("at"), f).alias(f) for f in layouts.FORMS)),
     "SELECT vec_id, CAST([60, 60, 60, 63][k + 1] AS BIGINT) AS least, [60, 60, 60, 63][k + 1] <= 64 - vec_id % 7 AS fits, CAST(CASE WHEN vec_id % 6 < [5, 5, 5, 4][k + 1] THEN [2 + 3 * x + 45, 40 + x + 15, 2 + 12 * x + 9, 2 + 4 * x + 48][k + 1] END AS BIGINT) AS place, false AS aliased, true AS unaliased, k <> 1 AS pixel_packed, k < 3 AS image_packed, k = 0 AS row_major_packed, k = 2 AS column_major_packed FROM (SELECT vec_id, CAST(vec_id % 4 AS INT) AS k, vec_id % 6 AS x FROM embeddings)")

# --- luma of every pixel, chroma of each block's first pixel
_CHROMA = "greatest(0, least(255, floor(round({0}, 6) + 0.5)))"
for _sub, (_sx, _sy) in {"4:4:4": (1, 1), "4:2:2": (2, 1), "4:2:0": (2, 2), "4:0:0": (0, 0)}.items():
    def _planes(spark: SparkSession, d: str, sub=_sub, sx=_sx, sy=_sy) -> DataFrame:
        r = events_raster(spark, d)
        own = lambda i: r.select([r.channels[i]], layout="L")
        few = lambda i: own(i).where((F.col("x") % sx == 0) & (F.col("y") % sy == 0)).select(x=F.floor(F.col("x") / sx), y=F.floor(F.col("y") / sy), w=F.ceil(F.col("w") / sx), h=F.ceil(F.col("h") / sy))
        return _out(planes.to_rgb(own(0), few(1), few(2), sub) if sx else planes.to_rgb(own(0), subsampling=sub))

    _uv = f"(SELECT p.x, p.y, p.r AS yy, q.g - 128 AS uu, q.b - 128 AS vv FROM r1 p JOIN r1 q ON q.x = p.x // {_sx} * {_sx} AND q.y = p.y // {_sy} * {_sy})" if _sx else "(SELECT x, y, r AS yy, 0 AS uu, 0 AS vv FROM r1)"
    _add(f"chroma_{_sub.replace(':', '')}", _planes, f"WITH {R1} SELECT x, y, " + ", ".join(f"CAST({_CHROMA.format(e)} AS INT) AS c{i}" for i, e in enumerate(("yy + 1.402::DOUBLE * vv", "(yy - 0.299::DOUBLE * (yy + 1.402::DOUBLE * vv) - 0.114::DOUBLE * (yy + 1.772::DOUBLE * uu)) / 0.587::DOUBLE", "yy + 1.772::DOUBLE * uu"))) + f" FROM {_uv}")


def _saved_headers(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding saved as a picture file, and what ranged reads of the files' headers tell."""
    folder = shared.path(spark, "pictures")
    for k, (fmt, layout) in enumerate((("png", "Rgb"), ("bmp", "Rgba"), ("qoi", "Rgb"))):
        r = _coded(spark, d, layout, "u8").where(f"picture_id % 3 = {k}")
        pictures.save(pictures.encode(resample.resize_exact(r, F.col("picture_id").cast("int") % 5 + 1, 2, "nearest"), fmt), f"{folder}/{fmt}", fmt)
    return headers.read(spark, folder).select(F.regexp_extract("path", r"/(\d+)\.\w+$", 1).alias("picture_id"), "format", "w", "h", "layout", "kind")


_add("saved_headers", _saved_headers, "SELECT CAST(vec_id AS VARCHAR) AS picture_id, ['png', 'bmp', 'qoi'][CAST(vec_id % 3 + 1 AS INT)] AS format, vec_id % 5 + 1 AS w, CAST(2 AS BIGINT) AS h, ['Rgb', 'Rgba', 'Rgb'][CAST(vec_id % 3 + 1 AS INT)] AS layout, 'u8' AS kind FROM embeddings")

# --- formats and limits
_add(
    "formats",
    lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.element_at(F.array(*(F.lit(f[0]) for f in formats.FORMATS)), F.expr(f"cast(page_id % {len(formats.FORMATS)} + 1 as int)")).alias("format")).join(F.broadcast(formats.formats(spark)), "format").select("page_id", "format", "mime", F.array_join("extensions", ",").alias("extensions"), "can_read", "can_write"),
    # fixed values: MIME types and extensions of the formats' standards
    "SELECT page_id, format, mime, extensions, can_read, can_write FROM pages JOIN (VALUES ('avif', 'image/avif', 'avif', false, false), ('bmp', 'image/bmp', 'bmp', true, true), ('farbfeld', 'application/octet-stream', 'ff', true, true), ('gif', 'image/gif', 'gif', true, false), ('hdr', 'image/vnd.radiance', 'hdr', true, true), ('ico', 'image/x-icon', 'ico', true, true), ('jpeg', 'image/jpeg', 'jpg,jpeg,jfif', false, false), ('exr', 'image/x-exr', 'exr', false, false), ('png', 'image/png', 'png,apng', true, true), ('pnm', 'image/x-portable-anymap', 'pbm,pgm,ppm,pam,pnm', true, true), ('qoi', 'image/x-qoi', 'qoi', true, true), ('tga', 'image/x-targa', 'tga', true, true), ('tiff', 'image/tiff', 'tif,tiff', false, false), ('webp', 'image/webp', 'webp', false, false)) t(format, mime, extensions, can_read, can_write) ON format = ['avif', 'bmp', 'farbfeld', 'gif', 'hdr', 'ico', 'jpeg', 'exr', 'png', 'pnm', 'qoi', 'tga', 'tiff', 'webp'][CAST(page_id % 14 + 1 AS INT)]",
)
_add(
    "format_from_path",
    lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", formats.from_path(F.concat(F.regexp_extract("url", "([^/]*)/?$", 1), F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".webp", ".txt", ""))), (F.col("page_id") % 5 + 1).cast("int")))).alias("format")),
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' END AS format FROM pages",
)
_add(
    "limits",
    lambda spark, d: embeddings_raster(spark, d).pixels.select("picture_id", "w", "h").distinct().select("picture_id", formats.within_limits(F.col("w") * F.col("picture_id").cast("int"), F.col("h"), F.lit(4), max_width=2000, max_alloc=100_000).alias("ok")),
    "SELECT CAST(vec_id AS VARCHAR) AS picture_id, (8 * vec_id <= 2000 AND 8 * vec_id * 8 * 4 <= 100000) AS ok FROM embeddings",
)
