"""DuckDB oracle SQL for the raster keys (F3 pixel grids from ``embeddings``)."""

from __future__ import annotations

from terrascope.plans.oracle_sql import rnd


def _ch(shift: int) -> str:
    return (f"CAST(least(255, greatest(0, floor(128.0 + 240.0 * CAST(embedding[(p + {shift}) % 64 + 1] AS DOUBLE)))) "
            f"AS INTEGER)")


F3 = f"""
SELECT vec_id AS image_id, label AS grp, CAST(floor(p / 8) AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
       8 AS height, 8 AS width, {_ch(0)} AS b, {_ch(1)} AS g, {_ch(2)} AS r
FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS p FROM embeddings) e
"""

TRUTH = f"SELECT *, CASE WHEN 2 * g > b + r THEN 1 ELSE 0 END AS label FROM ({F3}) f3"

MASKS = f"SELECT image_id, y, x, height, width, label * 255 AS v FROM ({TRUTH}) t"

HSV = f"""
SELECT image_id, y, x,
       CAST(floor((CASE WHEN h0 < 0 THEN h0 + 360.0 ELSE h0 END) / 2.0 + 0.5) AS INTEGER) AS h,
       CAST(floor(CASE WHEN v > 0 THEN 255.0 * (v - mn) / v ELSE 0.0 END + 0.5) AS INTEGER) AS s,
       CAST(v AS INTEGER) AS v
FROM (SELECT *, CASE WHEN v - mn = 0 THEN 0.0
                     WHEN v = R THEN 60.0 * (G - B) / (v - mn)
                     WHEN v = G THEN 120.0 + 60.0 * (B - R) / (v - mn)
                     ELSE 240.0 + 60.0 * (R - G) / (v - mn) END AS h0
      FROM (SELECT image_id, y, x, CAST(b AS DOUBLE) AS B, CAST(g AS DOUBLE) AS G, CAST(r AS DOUBLE) AS R,
                   greatest(CAST(b AS DOUBLE), CAST(g AS DOUBLE), CAST(r AS DOUBLE)) AS v,
                   least(CAST(b AS DOUBLE), CAST(g AS DOUBLE), CAST(r AS DOUBLE)) AS mn
            FROM ({F3}) f3) a) b
"""


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


def _f(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0 / 3.0) ELSE 7.787 * {t} + 16.0 / 116.0 END)"


def _r8(e: str) -> str:
    return f"CAST(greatest(0, least(255, floor({e} + 0.5))) AS INTEGER)"


LAB = f"""
SELECT image_id, y, x,
       {_r8("(CASE WHEN ly > 0.008856 THEN 116.0 * pow(ly, 1.0 / 3.0) - 16.0 ELSE 903.3 * ly END) * (255.0 / 100.0)")} AS l,
       {_r8(f"500.0 * ({_f('lx')} - {_f('ly')}) + 128.0")} AS a,
       {_r8(f"200.0 * ({_f('ly')} - {_f('lz')}) + 128.0")} AS lab_b
FROM (SELECT image_id, y, x,
             (0.412453 * rl + 0.357580 * gl + 0.180423 * bl) / 0.950456 AS lx,
             0.212671 * rl + 0.715160 * gl + 0.072169 * bl AS ly,
             (0.019334 * rl + 0.119193 * gl + 0.950227 * bl) / 1.088754 AS lz
      FROM (SELECT image_id, y, x, {_lin('CAST(r AS DOUBLE)')} AS rl, {_lin('CAST(g AS DOUBLE)')} AS gl,
                   {_lin('CAST(b AS DOUBLE)')} AS bl FROM ({F3}) f3) s) t
"""

FOCAL_STATS = f"""
SELECT t.image_id, t.y, t.x,
       avg(s.b) AS b_mean, stddev_pop(s.b) AS b_std, avg(s.g) AS g_mean, stddev_pop(s.g) AS g_std,
       avg(s.r) AS r_mean, stddev_pop(s.r) AS r_std
FROM ({F3}) t JOIN ({F3}) s
  ON s.image_id = t.image_id AND s.y BETWEEN t.y - 1 AND t.y + 1 AND s.x BETWEEN t.x - 1 AND t.x + 1
GROUP BY t.image_id, t.y, t.x
"""

# The 5 x 5 elliptical structuring element, by rows.
_ELLIPSE = ("..x..",
            "xxxxx",
            "xxxxx",
            "xxxxx",
            "..x..")
_K = ", ".join(f"({i - 2}, {j - 2})" for i, row in enumerate(_ELLIPSE) for j, c in enumerate(row) if c == "x")


def _morph(src: str, op: str) -> str:
    return f"""
SELECT t.image_id, t.y, t.x, t.height, t.width, {op}(s.label) AS label
FROM ({src}) t, (VALUES {_K}) k(dy, dx), ({src}) s
WHERE s.image_id = t.image_id AND s.y = t.y + k.dy AND s.x = t.x + k.dx
GROUP BY t.image_id, t.y, t.x, t.height, t.width
"""


CLOSE = f"SELECT image_id, y, x, label FROM ({_morph(_morph(TRUTH, 'max'), 'min')}) c"

# Gaussian of sigma 0.5 at offsets -1, 0, 1: exp(-2), 1, exp(-2), divided by their sum.
_W = {d: f"({'1.0' if d == 0 else 'exp(-2.0)'} / (1.0 + 2.0 * exp(-2.0)))" for d in (-1, 0, 1)}
_GK = ", ".join(f"({dy}, {dx}, {_W[dy]} * {_W[dx]})" for dy in (-1, 0, 1) for dx in (-1, 0, 1))


def _refl(c: str, n: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= {n} THEN 2 * ({n} - 1) - ({c}) ELSE {c} END)"


SMOOTH = f"""
SELECT t.image_id, t.y, t.x,
       CAST(floor(sum(k.w * s.b) + 0.5) AS INTEGER) AS b,
       CAST(floor(sum(k.w * s.g) + 0.5) AS INTEGER) AS g,
       CAST(floor(sum(k.w * s.r) + 0.5) AS INTEGER) AS r
FROM ({F3}) t, (VALUES {_GK}) k(dy, dx, w), ({F3}) s
WHERE s.image_id = t.image_id AND s.y = {_refl('t.y + k.dy', 't.height')} AND s.x = {_refl('t.x + k.dx', 't.width')}
GROUP BY t.image_id, t.y, t.x
"""


def _axis(t: str, n: str, o: int) -> tuple[str, str, str]:
    f = f"(({t} + 0.5) * {n} / {float(o)!r} - 0.5)"
    s0 = f"floor({f})"
    s0c = f"CAST(CASE WHEN {s0} < 0 THEN 0 WHEN {s0} >= {n} - 1 THEN {n} - 1 ELSE {s0} END AS INTEGER)"
    frac = f"(CASE WHEN {s0} < 0 THEN 0.0 WHEN {s0} >= {n} - 1 THEN 0.0 ELSE {f} - {s0} END)"
    return s0c, f"least({s0c} + 1, {n} - 1)", frac


def _bilinear(o: int) -> str:
    y0, y1, fy = _axis("ty", "height", o)
    x0, x1, fx = _axis("tx", "width", o)
    corners = f"""
SELECT image_id, ty, tx, {y0} AS sy, {x0} AS sx, (1.0 - {fy}) * (1.0 - {fx}) AS w FROM g
UNION ALL SELECT image_id, ty, tx, {y0}, {x1}, (1.0 - {fy}) * {fx} FROM g
UNION ALL SELECT image_id, ty, tx, {y1}, {x0}, {fy} * (1.0 - {fx}) FROM g
UNION ALL SELECT image_id, ty, tx, {y1}, {x1}, {fy} * {fx} FROM g
"""
    return f"""
WITH px AS ({F3}),
     dims AS (SELECT image_id, max(height) AS height, max(width) AS width FROM px GROUP BY image_id),
     g AS (SELECT image_id, height, width, CAST(a AS INTEGER) AS ty, CAST(b AS INTEGER) AS tx
           FROM dims, range({o}) r1(a), range({o}) r2(b)),
     c AS ({corners})
SELECT c.image_id, c.ty AS y, c.tx AS x,
       CAST(greatest(0, least(255, floor(sum(c.w * p.b) + 0.5))) AS INTEGER) AS b,
       CAST(greatest(0, least(255, floor(sum(c.w * p.g) + 0.5))) AS INTEGER) AS g,
       CAST(greatest(0, least(255, floor(sum(c.w * p.r) + 0.5))) AS INTEGER) AS r
FROM c JOIN px p ON p.image_id = c.image_id AND p.y = c.sy AND p.x = c.sx
WHERE c.w > 0
GROUP BY c.image_id, c.ty, c.tx
"""


def _nearest(src: str, o: int, cols: str) -> str:
    return f"""
SELECT p.image_id, {o} AS height, {o} AS width, CAST(t.a AS INTEGER) AS y, CAST(u.b AS INTEGER) AS x, {cols}
FROM ({src}) p, range({o}) t(a), range({o}) u(b)
WHERE p.y = CAST(floor(t.a * p.height / {o}) AS INTEGER) AND p.x = CAST(floor(u.b * p.width / {o}) AS INTEGER)
"""


NEAREST = (f"{_nearest(F3, 16, 'p.b, p.g, p.r')} UNION ALL {_nearest(F3, 4, 'p.b, p.g, p.r')}")

_MB = "CASE WHEN label = 1 THEN 0 WHEN label = 0 THEN 0 ELSE 0 END"
COLOR = f"""
SELECT image_id, y, x, label, {_MB} AS mb,
       CASE WHEN label = 1 THEN 255 ELSE 0 END AS mg,
       CASE WHEN label = 0 THEN 255 ELSE 0 END AS mr
FROM ({TRUTH}) t
"""

OVERLAY = f"""
SELECT image_id, y, x,
       CAST(greatest(0, least(255, round_even(0.7::DOUBLE * b + 0.3::DOUBLE * mb, 0))) AS INTEGER) AS ob,
       CAST(greatest(0, least(255, round_even(0.7::DOUBLE * g + 0.3::DOUBLE * mg, 0))) AS INTEGER) AS og,
       CAST(greatest(0, least(255, round_even(0.7::DOUBLE * r + 0.3::DOUBLE * mr, 0))) AS INTEGER) AS "or"
FROM (SELECT t.*, c.mb, c.mg, c.mr FROM ({TRUTH}) t JOIN ({COLOR}) c USING (image_id, y, x)) z
"""

GRID = f"""
SELECT image_id, list(vals ORDER BY y) AS grid
FROM (SELECT image_id, y, list(label ORDER BY x) AS vals FROM ({TRUTH}) t GROUP BY image_id, y) r
GROUP BY image_id
"""

IDS = f"SELECT DISTINCT image_id FROM ({F3}) f"
IMAGES = f"SELECT image_id, 'satellite_' || lpad(CAST(image_id AS VARCHAR), 4, '0') || '.jpg' AS image_name FROM ({IDS}) i"
MASKNAMES = (f"SELECT image_id, 'mask_' || lpad(CAST(image_id AS VARCHAR), 4, '0') || '.jpg' AS mask_name "
             f"FROM ({IDS}) i WHERE image_id % 50 <> 0")
_ID = r"CAST(regexp_extract({c}, '_(\d+)\.', 1) AS BIGINT)"

PAIR = f"""
SELECT a.image_id, a.image_name, b.mask_name
FROM (SELECT {_ID.format(c='image_name')} AS image_id, image_name FROM ({IMAGES}) i) a
JOIN (SELECT {_ID.format(c='mask_name')} AS image_id, mask_name FROM ({MASKNAMES}) m) b USING (image_id)
"""

UNMATCHED = f"""
WITH a AS (SELECT {_ID.format(c='image_name')} AS image_id, image_name AS name FROM ({IMAGES}) i),
     b AS (SELECT {_ID.format(c='mask_name')} AS image_id, mask_name AS name FROM ({MASKNAMES}) m)
SELECT image_id, name, 'mask' AS missing FROM a WHERE image_id NOT IN (SELECT image_id FROM b)
UNION ALL
SELECT image_id, name, 'image' AS missing FROM b WHERE image_id NOT IN (SELECT image_id FROM a)
"""

_PATCHES = "(2.0, 2.0, 2.0, 1.0), (5.0, 5.0, 1.0, 2.0)"
ELLIPSE = f"""
SELECT p.image_id, p.y, p.x,
       max(CASE WHEN ((p.x - cx) / w) * ((p.x - cx) / w) + ((p.y - cy) / h) * ((p.y - cy) / h) <= 1 THEN 1 ELSE 0 END) AS label
FROM ({F3}) p, (VALUES {_PATCHES}) e(cx, cy, w, h)
GROUP BY p.image_id, p.y, p.x
"""

_PXCOLS = "image_id, y, x, height, width, b, g, r"
UNION_PX = (f"SELECT 'original' AS source, {_PXCOLS} FROM ({F3}) f UNION ALL "
            f"SELECT 'small' AS source, image_id, y, x, height, width, b, g, r FROM ({_nearest(F3, 4, 'p.b, p.g, p.r')}) n")

COVERAGE = f"""
SELECT image_id, count(*) AS total_pixels,
       round_even(CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / count(*) * 100.0 * 100.0, 0) / 100.0 AS forest_percentage,
       round_even(CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*) * 100.0 * 100.0, 0) / 100.0 AS deforested_percentage
FROM ({_nearest(TRUTH, 16, 'p.label')}) n GROUP BY image_id
"""

_PRED = f"SELECT label, CAST(g > r AS INTEGER) AS prediction FROM ({TRUTH}) t"
REPORT = f"""
WITH p AS ({_PRED}),
     c AS (SELECT name, cls,
                  (SELECT count(*) FROM p WHERE label = cls AND prediction = cls) AS tp,
                  (SELECT count(*) FROM p WHERE prediction = cls) AS pp,
                  (SELECT count(*) FROM p WHERE label = cls) AS support
           FROM (VALUES ('Deforested', 0), ('Forest', 1)) v(name, cls)),
     m AS (SELECT name, tp, support,
                  CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
                  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM c),
     f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM m)
SELECT name AS class, precision, recall, f1_score, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f
"""

_MD5 = "md5(concat_ws(':', '42', CAST(image_id AS VARCHAR), CAST(y AS VARCHAR), CAST(x AS VARCHAR)))"
SAMPLE_MD5 = f"""
SELECT image_id, y, x, label FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws(':', '42', CAST(image_id AS VARCHAR),
         CAST(y AS VARCHAR), CAST(x AS VARCHAR))), y, x) AS rn
  FROM ({TRUTH}) t) s
WHERE rn <= 32
"""
SPLIT_MD5 = f"""
SELECT image_id, y, x, label,
       row_number() OVER (PARTITION BY label ORDER BY {_MD5}, image_id, y, x)
         <= CAST(round(0.8 * count(*) OVER (PARTITION BY label)) AS BIGINT) AS is_train
FROM ({TRUTH}) t
"""

SQL = {
    "pixel_features": rnd(f"SELECT image_id, y, x, b, g, r, y / height AS yn, x / width AS xn FROM ({F3}) f", ["yn", "xn"]),
    "pixel_hsv": HSV,
    "pixel_lab": LAB,
    "focal_stats": rnd(FOCAL_STATS, ["b_mean", "b_std", "g_mean", "g_std", "r_mean", "r_std"]),
    "focal_close": CLOSE,
    "focal_smooth": SMOOTH,
    "resample_bilinear": _bilinear(16),
    "resample_nearest": NEAREST,
    "mask_labels": f"SELECT image_id, y, x, v, CAST(v > 127 AS INTEGER) AS label FROM ({MASKS}) m",
    "color_mask": COLOR,
    "overlay_pixels": OVERLAY,
    "grid_pack": GRID,
    "explode_nested_image": f"SELECT {_PXCOLS} FROM ({F3}) f",
    "image_ext_filter": """
        SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file_name,
               CASE WHEN contains(regexp_extract(url, '([^/]*)$', 1), '.')
                    THEN lower(string_split(regexp_extract(url, '([^/]*)$', 1), '.')[-1]) END AS ext,
               coalesce(CASE WHEN contains(regexp_extract(url, '([^/]*)$', 1), '.')
                    THEN lower(string_split(regexp_extract(url, '([^/]*)$', 1), '.')[-1]) END
                    IN ('png', 'jpg', 'jpeg', 'tif', 'tiff'), false) AS allowed
        FROM pages""",
    "pair_by_id": PAIR,
    "pair_unmatched": UNMATCHED,
    "pixel_label_join": f"SELECT {_PXCOLS}, CAST(v > 127 AS INTEGER) AS label FROM ({F3}) f JOIN ({MASKS}) m USING (image_id, y, x, height, width)",
    "ellipse_label": ELLIPSE,
    "union_pixels": UNION_PX,
    "class_balance": rnd(f"SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM ({TRUTH}) a) AS share "
                         f"FROM ({TRUTH}) t GROUP BY label", ["share"]),
    "forest_coverage": COVERAGE,
    "classification_report": rnd(REPORT, ["precision", "recall", "f1_score"]),
    "sample_per_image_md5": SAMPLE_MD5,
    "stratified_split_md5": SPLIT_MD5,
}
