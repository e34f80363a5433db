"""SQL for DuckDB that states the queries anew: plain joins, windows and recursive queries over the same fixtures."""

from __future__ import annotations

from ..functions.coords import _A, _ALPHA, _E
from .fixtures import with_clause

_N = "(select cast(event_id as bigint) as n from events)"


def _positions(axis: str, limit: str) -> str:
    return f"select distinct sample_id, least(576*n, greatest({limit} - 768, 0)) as {axis}0 from fx_raster cross join {_N} where n = 0 or 576*(n-1) < {limit} - 768"


TILES = f"""px as ({_positions('x', 'width')}), py as ({_positions('y', 'height')}),
tiles as (select *, case when x0 <= 0 then x0 else least(x1, x0 + 96) end as keep_x0, case when y0 <= 0 then y0 else least(y1, y0 + 96) end as keep_y0,
   case when x1 >= width then x1 else greatest(x0, x1 - 96) end as keep_x1, case when y1 >= height then y1 else greatest(y0, y1 - 96) end as keep_y1
 from (select r.sample_id, cast(width as bigint) as width, cast(height as bigint) as height, row_number() over (partition by r.sample_id order by y0, x0) - 1 as candidate_index, x0, y0,
   least(cast(width as bigint), x0 + 768) as x1, least(cast(height as bigint), y0 + 768) as y1 from fx_raster r join px using (sample_id) join py using (sample_id)))"""

STATS = TILES + """, stats as (select t.sample_id, t.candidate_index, t.x0, t.y0, t.x1, t.y1,
   cast(coalesce(sum(greatest(0, least(t.x1, m.x1) - greatest(t.x0, m.x0)) * greatest(0, least(t.y1, m.y1) - greatest(t.y0, m.y0))), 0) as bigint) as mask_pixels
 from tiles t left join fx_mask m on t.sample_id = m.sample_id and m.x0 < t.x1 and m.x1 > t.x0 and m.y0 < t.y1 and m.y1 > t.y0 group by all),
ratio as (select *, mask_pixels / ((x1 - x0) * (y1 - y0)) as mask_ratio from stats)"""

SCAN = TILES + """, scan as (select *, row_number() over (partition by sample_id order by y0, x0) - 1 as tile_index, count(*) over (partition by sample_id) as tile_count,
   exists (select 1 from tiles o where o.sample_id = t.sample_id and o.y0 = t.y0 and o.x0 < t.x0) as has_left,
   exists (select 1 from tiles o where o.sample_id = t.sample_id and o.x0 = t.x0 and o.y0 < t.y0) as has_top from tiles t)"""

ENV = "env as (select sample_id, feature_id, min(px) as rx0, min(py) as ry0, max(px) as rx1, max(py) as ry1 from fx_point group by all)"
HIT = "not (rx1 < x0 or rx0 >= x1 or ry1 < y0 or ry0 >= y1)"

HITS = """hits as (select p.*, coalesce(exists (select 1 from fx_mask m where m.sample_id = p.sample_id and least(greatest(p.px, 0), r.width - 1) >= m.x0 and least(greatest(p.px, 0), r.width - 1) < m.x1
   and least(greatest(p.py, 0), r.height - 1) >= m.y0 and least(greatest(p.py, 0), r.height - 1) < m.y1), false) as inside from fx_point p join fx_raster r using (sample_id))"""

MOD = """long_enough as (select sample_id, feature_id, count(*) as n, min(pt) as lo, max(pt) as hi from fx_point group by all having count(*) >= 2),
mod_pt as (select p.sample_id, p.feature_id, p.pt, n, lo, hi, cast(((px % 256) + 256) % 256 as double) as x, cast(((py % 256) + 256) % 256 as double) as y from fx_point p join long_enough using (sample_id, feature_id)),
sided as (select *, case when least(abs(x), abs(y), abs(255 - x), abs(255 - y)) > 1.5 then 'none' when abs(x) <= least(abs(y), abs(255 - x), abs(255 - y)) then 'left'
   when abs(y) <= least(abs(255 - x), abs(255 - y)) then 'top' when abs(255 - x) <= abs(255 - y) then 'right' else 'bottom' end as side from mod_pt),
ranked as (select *, case side when 'left' then 0 when 'top' then 1 when 'none' then 2 when 'right' then 3 else 4 end as rk from sided),
ends as (select a.sample_id, a.feature_id, (b.rk, b.x, b.y) < (a.rk, a.x, a.y) as turned from ranked a join ranked b using (sample_id, feature_id) where a.pt = a.lo and b.pt = b.hi),
canon as (select sample_id, feature_id, n, case when turned then hi - pt else pt - lo end as i, x, y, side from ranked join ends using (sample_id, feature_id))"""

# Liang-Barsky on neighbouring vertices, as intervals of the parameter.
CLIP = """seg as (select *, lead(px) over w - px as dx, lead(py) over w - py as dy, pt - min(pt) over (partition by sample_id, feature_id) as i from fx_point window w as (partition by sample_id, feature_id order by pt)),
par as (select *, case when dx > 0 then (200.0 - px) / dx when dx < 0 then (1000.0 - px) / dx when px between 200 and 1000 then 0 else 2 end as ax, case when dx > 0 then (1000.0 - px) / dx when dx < 0 then (200.0 - px) / dx else 1 end as bx,
   case when dy > 0 then (150.0 - py) / dy when dy < 0 then (800.0 - py) / dy when py between 150 and 800 then 0 else 2 end as ay, case when dy > 0 then (800.0 - py) / dy when dy < 0 then (150.0 - py) / dy else 1 end as byy from seg where dx is not null),
cutseg as (select *, greatest(0, ax, ay) as t0, least(1, bx, byy) as t1 from par where greatest(0, ax, ay) < least(1, bx, byy)),
runs as (select *, sum(new) over (partition by sample_id, feature_id order by i) - 1 as piece from (select *, case when lag(i) over w = i - 1 and lag(t1) over w = 1 and t0 = 0 then 0 else 1 end as new from cutseg window w as (partition by sample_id, feature_id order by i)))"""

PAIRSEG = """seg_gt as (select sample_id, feature_id, px as ax, py as ay, lead(px) over w as bx, lead(py) over w as byy from fx_point window w as (partition by sample_id, feature_id order by pt)),
seg_pr as (select sample_id, feature_id, px as ax, py as ay, lead(px) over w as bx, lead(py) over w as byy from fx_pred window w as (partition by sample_id, feature_id order by pt))"""


def _directed(points: str, segs: str, pid: str, sid: str) -> str:
    """Distance of each vertex to the other line's nearest segment, greatest over the vertices."""
    return f"""select sample_id, pred, gt, max(d) as d from (select c.sample_id, pred, gt, p.pt, min(sqrt(pow(s.ax + t*(s.bx - s.ax) - p.px, 2) + pow(s.ay + t*(s.byy - s.ay) - p.py, 2))) as d
 from cand c join {points} p on p.sample_id = c.sample_id and p.feature_id = c.{pid} join {segs} s on s.sample_id = c.sample_id and s.feature_id = c.{sid} and s.bx is not null
 cross join lateral (select case when pow(s.bx - s.ax, 2) + pow(s.byy - s.ay, 2) > 0 then least(1.0, greatest(0.0, ((p.px - s.ax)*(s.bx - s.ax) + (p.py - s.ay)*(s.byy - s.ay)) / nullif(pow(s.bx - s.ax, 2) + pow(s.byy - s.ay, 2), 0))) else 0.0 end as t) q
 group by all) group by all"""


ENDS = """, pe as (select sample_id, feature_id, arg_min(px, pt) as ax, arg_min(py, pt) as ay, arg_max(px, pt) as zx, arg_max(py, pt) as zy from fx_pred group by all having count(*) >= 2),
ge as (select sample_id, feature_id, arg_min(px, pt) as ax, arg_min(py, pt) as ay, arg_max(px, pt) as zx, arg_max(py, pt) as zy from fx_point group by all having count(*) >= 2)"""
ERR = "least((sqrt(pow(p.ax-g.ax,2)+pow(p.ay-g.ay,2)) + sqrt(pow(p.zx-g.zx,2)+pow(p.zy-g.zy,2)))/2, (sqrt(pow(p.ax-g.zx,2)+pow(p.ay-g.zy,2)) + sqrt(pow(p.zx-g.ax,2)+pow(p.zy-g.ay,2)))/2)"
DIST = PAIRSEG + ENDS + """, cand as (select p.sample_id, p.feature_id as pred, g.feature_id as gt, {err} as endpoint_error from pe p join ge g on p.sample_id = g.sample_id {where}),
both_ways as ({one} union all {two}), dist as (select sample_id, pred, gt, max(d) as distance, any_value(endpoint_error) as endpoint_error from both_ways join cand using (sample_id, pred, gt) group by all)"""


def _dist(where: str) -> str:
    return DIST.format(err=ERR, where=where, one=_directed("fx_pred", "seg_gt", "pred", "gt"), two=_directed("fx_point", "seg_pr", "gt", "pred"))


def _greedy(pairs: str, order: str) -> str:
    """Rounds over each sample's ranked pairs: a pair that is the first of both its sides is taken, and pairs of taken sides go."""
    least = "min(k) over (partition by sample_id, pred) as kp, min(k) over (partition by sample_id, gt) as kg"
    return f"""ord as (select *, row_number() over (partition by sample_id order by {order}, pred, gt) as k from {pairs}),
fold as (select sample_id, pred, gt, k, kp = k and kg = k as taken from (select *, {least} from ord)
 union all select sample_id, pred, gt, k, kp = k and kg = k from (select *, {least} from (select *, max(taken) over (partition by sample_id, pred) as tp, max(taken) over (partition by sample_id, gt) as tg from fold) where not tp and not tg)),
matched as (select o.* from fold f join ord o using (sample_id, k) where f.taken)"""


# lines within the threshold have first vertices near the other line's extent; the full test is the distance itself
NEAR = """and exists (select 1 from (select min(px) a, max(px) b, min(py) c, max(py) d from fx_point x where x.sample_id = g.sample_id and x.feature_id = g.feature_id) e where p.ax between e.a - 6 and e.b + 6 and p.ay between e.c - 6 and e.d + 6)"""
MATCH = _dist(NEAR) + ", close_pairs as (select * from dist where distance <= 6), " + _greedy("close_pairs", "round(distance, 9), round(endpoint_error, 9)")

BOXES = """gtb as (select sample_id, cast(feature_id as bigint) as id, cast(x0 as bigint) as x0, cast(y0 as bigint) as y0, cast(x1 as bigint) as x1, cast(y1 as bigint) as y1 from fx_box),
prb as (select sample_id, id, x0 + id % 7 as x0, y0, x1 + id % 7 as x1, y1 from gtb)"""


def utm_sql(table: str, middle: str) -> str:
    """Table ``utm``: the rows of a table with lon and lat, and their easting and northing about a middle meridian, north of the equator."""
    series = lambda f, g: " + ".join(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))
    return f"""utm_t as (select *, radians(lon - {middle}) as lam, sinh(atanh(sin(radians(lat))) - {_E!r} * atanh({_E!r} * sin(radians(lat)))) as t from {table}),
 utm_x as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t*t)) as eta from utm_t),
 utm as (select *, 500000 + cast(0.9996 as double) * {_A!r} * (eta + {series('cos', 'sinh')}) as east, cast(0.9996 as double) * {_A!r} * (xi + {series('sin', 'cosh')}) as north from utm_x)"""


def _iou(a: str, b: str, extra: str, least: float) -> str:
    w = "least(p.x1, g.x1) - greatest(p.x0, g.x0)"
    h = "least(p.y1, g.y1) - greatest(p.y0, g.y0)"
    return f"""iou as (select * from (select p.sample_id, p.id as pred, g.id as gt, ({w})*({h}) / ((p.x1-p.x0)*(p.y1-p.y0) + (g.x1-g.x0)*(g.y1-g.y0) - ({w})*({h})) as iou
 from {a} p join {b} g on p.sample_id = g.sample_id and {w} > 0 and {h} > 0 {extra}) where iou >= {least})"""


W = with_clause
IOU_SQL = f"{W('fx_box')}, {BOXES}, {_iou('prb', 'gtb', '', 0.3)} select sample_id, pred, gt, round(iou, 6) + 0.0 as iou from iou"

SQL: dict[str, str] = {
    "tile_windows": f"{W('fx_raster')}, {TILES} select * from tiles",
    "mask_bbox": f"{W('fx_mask')} select sample_id, cast(min(x0) as bigint) as x0, cast(min(y0) as bigint) as y0, cast(max(x1) as bigint) as x1, cast(max(y1) as bigint) as y1 from fx_mask group by 1",
    "tile_mask_stats": f"{W('fx_mask')}, {STATS} select sample_id, candidate_index, mask_pixels, round(mask_ratio, 6) + 0.0 as mask_ratio from ratio",
    "tile_select_audit": f"""{W('fx_mask')}, {STATS}, pass as (select *, mask_ratio >= 0.3 or mask_pixels >= 200000 as ok from ratio), st as (select *, ok or not bool_or(ok) over (partition by sample_id) as stands from pass),
 pl as (select *, case when stands then row_number() over (partition by sample_id, stands order by mask_ratio desc, mask_pixels desc, candidate_index) end as place from st)
 select sample_id, candidate_index, x0, y0, x1, y1, mask_pixels, round(mask_ratio, 6) + 0.0 as mask_ratio, coalesce(place <= 4, false) as selected,
 case when place <= 4 then 'selected' when not stands then 'below_mask_threshold' else 'truncated_by_max_tiles' end as reason from pl""",
    "tile_neighbors": f"{W('fx_raster')}, {SCAN} select sample_id, x0, y0, tile_index, tile_count, has_left, has_top from scan",
    "tile_state_regions": f"""{W('fx_raster')}, {SCAN} select sample_id, tile_index, 0 as strip, x0 as sx0, y0 as sy0, least(x1, x0 + 128) as sx1, y1 as sy1 from scan where has_left
 union all select sample_id, tile_index, 1, x0, y0, x1, least(y1, y0 + 128) from scan where has_top""",
    "feature_envelope_join": f"{W('fx_raster', 'fx_point')}, {TILES}, {ENV} select t.sample_id, candidate_index, feature_id from tiles t join env e on t.sample_id = e.sample_id and {HIT}",
    "empty_tile_filter": f"{W('fx_raster', 'fx_point')}, {TILES}, {ENV} select sample_id, candidate_index, x0, y0 from tiles t where exists (select 1 from env e where e.sample_id = t.sample_id and {HIT})",
    "work_items": f"""{W('fx_raster', 'fx_point', 'fx_box')}, {SCAN}, lab as (select distinct sample_id, 'lane' as task, 0 as task_order from fx_point union all select distinct sample_id, 'intersection', 1 from fx_box)
 select cast(sample_id as bigint) as sample_id, task, task_order, tile_index, tile_count from scan join lab using (sample_id)""",
    "keep_center_filter": f"""{W('fx_raster', 'fx_point')}, {TILES}, {ENV}, mid as (select sample_id, feature_id, avg(px) as mx, avg(py) as my from fx_point group by all having count(*) >= 2)
 select t.sample_id, candidate_index, feature_id from tiles t join env e on t.sample_id = e.sample_id and {HIT} join mid using (sample_id, feature_id) where mx >= keep_x0 and mx < keep_x1 and my >= keep_y0 and my < keep_y1""".replace("join mid using (sample_id, feature_id)", "join mid m on m.sample_id = t.sample_id and m.feature_id = e.feature_id").replace("candidate_index, feature_id from tiles", "candidate_index, e.feature_id from tiles"),
    "mask_inside_ratio": f"{W('fx_mask', 'fx_point')}, {HITS}, g as (select sample_id, feature_id, count(*) as n_points, count(*) filter (where inside) as n_inside from hits group by all) select *, round(n_inside / n_points, 6) + 0.0 as ratio, n_inside / n_points >= 0.5 as ok, n_inside / n_points < 0.999 as partial from g",
    "line_mask_islands": f"""{W('fx_mask', 'fx_point')}, {HITS}, num as (select *, row_number() over (partition by sample_id, feature_id order by pt) - 1 as i, count(*) over (partition by sample_id, feature_id) as n from hits),
 isl as (select *, i - row_number() over (partition by sample_id, feature_id order by pt) as g from num where inside)
 select sample_id, feature_id, min(i) as first_pt, max(i) as last_pt, count(*) as n_points, min(i) > 0 as cut_start, max(i) < max(n) - 1 as cut_end from isl group by sample_id, feature_id, g having count(*) >= 2""",
    "affine_world": f"{W('fx_raster', 'fx_point')} select p.sample_id, feature_id, pt, round(a*px + c, 6) + 0.0 as wx, round(e*py + f, 6) + 0.0 as wy, round(cast(px as double), 4) + 0.0 as bx, round(cast(py as double), 4) + 0.0 as by from fx_point p join fx_raster r using (sample_id)".replace("select p.sample_id", "select sample_id"),
    "letterbox_uv": f"""{W('fx_raster')}, {TILES}, s as (select *, least(256 / (x1 - x0), 256 / (y1 - y0)) as sc from tiles), b as (select *, cast(greatest(1, round_even((x1 - x0) * sc, 0)) as int) as resized_w, cast(greatest(1, round_even((y1 - y0) * sc, 0)) as int) as resized_h from s),
 c as (select *, cast(floor((256 - resized_w) / 2) as int) as pad_x, cast(floor((256 - resized_h) / 2) as int) as pad_y from b)
 select sample_id, candidate_index, resized_w, resized_h, pad_x, pad_y, round(17 * (resized_w / (x1 - x0)) + pad_x, 6) + 0.0 as u, round(33 * (resized_h / (y1 - y0)) + pad_y, 6) + 0.0 as v, round(cast(x0 + 17 as double), 6) + 0.0 as x, round(cast(y0 + 33 as double), 6) + 0.0 as y from c""",
    "quantise_bins": f"{W('fx_point')}, q as (select *, cast(round_even(least(greatest(px * cast(0.17 as double), 0), 255) / 255 * 639, 0) as int) as q from fx_point) select sample_id, feature_id, pt, q, round(q / 639 * 255, 6) + 0.0 as u from q",
    "boundary_side": f"{W('fx_point')}, m as (select sample_id, feature_id, pt, ((px % 256) + 256) % 256 as x, ((py % 256) + 256) % 256 as y from fx_point) select sample_id, feature_id, pt, case when least(x, y, 255 - x, 255 - y) > 1.5 then 'none' when x <= least(y, 255 - x, 255 - y) then 'left' when y <= least(255 - x, 255 - y) then 'top' when 255 - x <= 255 - y then 'right' else 'bottom' end as side from m",
    "canonical_line": f"{W('fx_point')}, {MOD} select sample_id, feature_id, i, x, y from canon",
    "canonical_ring": f"{W('fx_point')}, {MOD}, st as (select sample_id, feature_id, arg_min(pt - lo, (x, y, pt)) as s from mod_pt group by all) select sample_id, feature_id, ((pt - lo) - s + n) % n as i, x, y from mod_pt join st using (sample_id, feature_id)",
    "anchors": f"""{W('fx_point')}, {MOD}, touched as (select distinct sample_id, feature_id, side from ranked where side in ('left', 'top')), k as (select unnest([0, 1, 2]) as j)
 select t.sample_id, t.feature_id, t.side, cast(i2 as bigint) as i, x, y from touched t join (select sample_id, feature_id, i, n, x, y, i as i2 from canon where n <= 3 union all
 select sample_id, feature_id, i, n, x, y, j from canon join k on i = cast(floor(j * (n - 1) / 2) as bigint) where n > 3) c on c.sample_id = t.sample_id and c.feature_id = t.feature_id""",
    "target_items": f"""{W('fx_point')}, {MOD}, e as (select sample_id, feature_id, max(case when i = 0 then side end) as a, max(case when i = n - 1 then side end) as z from canon group by all),
 t as (select sample_id, feature_id, case when a <> 'none' then a when feature_id % 3 = 0 then 'internal' else 'none' end as cut_in, case when z <> 'none' then z when feature_id % 2 = 0 then 'internal' else 'none' end as cut_out from e) select *, case when cut_in in ('left', 'top') then 'state' else 'local' end as source from t""",
    "line_clip_bbox": f"{W('fx_point')}, {CLIP} select sample_id, feature_id, cast(piece as bigint) as piece, count(*) + 1 as n_points, round(sum((t1 - t0) * sqrt(dx*dx + dy*dy)), 4) + 0.0 as length from runs group by all",
    "cut_flags": f"""{W('fx_point')}, {CLIP}, last_seg as (select sample_id, feature_id, max(i) as li from par group by all), fe as (select sample_id, feature_id, arg_min(px, pt) as fx, arg_min(py, pt) as fy, arg_max(px, pt) as lx, arg_max(py, pt) as ly from fx_point group by all),
 pe as (select sample_id, feature_id, piece, arg_min(px + t0*dx, i) as sx, arg_min(py + t0*dy, i) as sy, arg_max(px + t1*dx, i) as ex, arg_max(py + t1*dy, i) as ey from runs group by all)
 select sample_id, feature_id, cast(piece as bigint) as piece, not (abs(sx - fx) <= 1e-3 + 1e-5*abs(fx) and abs(sy - fy) <= 1e-3 + 1e-5*abs(fy)) as cut_start, not (abs(ex - lx) <= 1e-3 + 1e-5*abs(lx) and abs(ey - ly) <= 1e-3 + 1e-5*abs(ly)) as cut_end from pe join fe using (sample_id, feature_id)""",
    "resample_polyline": f"""{W('fx_point')}, s as (select sample_id, feature_id, pt, cast(px as double) as px, cast(py as double) as py, sqrt(pow(px - lag(px) over w, 2) + pow(py - lag(py) over w, 2)) as step from fx_point window w as (partition by sample_id, feature_id order by pt)),
 c as (select *, sum(coalesce(step, 0)) over (partition by sample_id, feature_id order by pt) as cum from s), tot as (select sample_id, feature_id, max(cum) as total, count(*) as m from c group by all having count(*) >= 2),
 nn as (select *, cast(least(greatest(floor(total / 30) + 1, 2), greatest(4, 2*m)) as bigint) as n from tot where total >= 1e-6), tg as (select sample_id, feature_id, n, total, k.n as i, case when k.n = nn.n - 1 then total else k.n * (total / (nn.n - 1)) end as t from nn join {_N} k on k.n < nn.n),
 sg as (select *, lead(cum) over w as cum2, lead(px) over w as qx, lead(py) over w as qy from c window w as (partition by sample_id, feature_id order by pt)),
 spot as (select g.sample_id, g.feature_id, g.i, g.t, max(s.pt) as pt from tg g join sg s on s.sample_id = g.sample_id and s.feature_id = g.feature_id and s.cum <= g.t and s.cum2 is not null group by all)
 select a.sample_id, a.feature_id, a.i, round(px + (qx - px) * (case when cum2 > cum then (t - cum) / (cum2 - cum) else 0 end), 5) + 0.0 as x, round(py + (qy - py) * (case when cum2 > cum then (t - cum) / (cum2 - cum) else 0 end), 5) + 0.0 as y
 from spot a join sg s on s.sample_id = a.sample_id and s.feature_id = a.feature_id and s.pt = a.pt
 union all select sample_id, feature_id, 0, px, py from c join tot using (sample_id, feature_id) where total < 1e-6 and pt % 10 = 0""".replace("select sample_id, feature_id, n, total, k.n as i", "select nn.sample_id, nn.feature_id, nn.n, total, k.n as i"),
    "hausdorff_pairs": f"{W('fx_pred')}, {_dist('and p.feature_id = g.feature_id')} select sample_id, pred as feature_id, round(distance, 6) + 0.0 as distance, round(endpoint_error, 6) + 0.0 as endpoint_error from dist",
    "greedy_match": f"{W('fx_pred').replace('with ', 'with recursive ', 1)}, {MATCH} select sample_id, pred, gt, round(distance, 6) + 0.0 as distance from matched",
    "lane_metrics": f"""{W('fx_pred', 'fx_raster').replace('with ', 'with recursive ', 1)}, {MATCH}, ch as (select sample_id, feature_id, max(prop_changed) as c from fx_pred group by all),
 m as (select x.sample_id, count(*) as k, avg(distance) as md, avg(endpoint_error) as me, avg(case when c = 0 and pred = gt then 1.0 else 0.0 end) as acc from matched x join ch on ch.sample_id = x.sample_id and ch.feature_id = x.pred group by 1),
 n as (select r.sample_id, (select count(*) from pe where pe.sample_id = r.sample_id) as pc, (select count(*) from ge where ge.sample_id = r.sample_id) as gc, coalesce(k, 0) as k, md, me, acc from fx_raster r left join m using (sample_id)),
 v as (select *, k / greatest(pc, 1) as p, k / greatest(gc, 1) as r from n)
 select sample_id, round(p, 6) + 0.0 as precision, round(r, 6) + 0.0 as recall, round(case when p + r <= 1e-9 then 0 else 2*p*r/(p+r) end, 6) + 0.0 as f1, round(coalesce(md, -1.0), 6) + 0.0 as mean_hausdorff, round(coalesce(me, -1.0), 6) + 0.0 as mean_endpoint_error, round(coalesce(acc, 0.0), 6) + 0.0 as property_acc,
 pc as pred_count, gc as gt_count, pc - k as unmatched_pred, gc - k as unmatched_gt from v""".replace("select r.sample_id, (select", "select sample_id, (select").replace("pe.sample_id = r.sample_id", "pe.sample_id = r.sample_id"),
    "polygon_iou": IOU_SQL,
    "polygon_iou_kernel": IOU_SQL,
    "polygon_clip": f"{W('fx_box')}, {BOXES} select sample_id, id, cast(0 as bigint) as piece, round(cast((least(x1, 1000) - greatest(x0, 200)) * (least(y1, 800) - greatest(y0, 150)) as double), 6) + 0.0 as area from gtb where x0 < 1000 and x1 > 200 and y0 < 800 and y1 > 150",
    "polygon_metrics": f"""{W('fx_box').replace('with ', 'with recursive ', 1)}, {BOXES}, {_iou('prb', 'gtb', '', 0.3)}, {_greedy('iou', '-round(iou, 9)')}, m as (select sample_id, count(*) as k, avg(iou) as mi, avg(case when pred = gt then 1.0 else 0.0 end) as acc from matched group by 1),
 n as (select sample_id, (select count(*) from prb where prb.sample_id = r.sample_id) as pc, (select count(*) from gtb where gtb.sample_id = r.sample_id) as gc, coalesce(k, 0) as k, mi, acc from fx_raster r left join m using (sample_id)), v as (select *, k / greatest(pc, 1) as p, k / greatest(gc, 1) as r from n)
 select sample_id, round(p, 6) + 0.0 as precision, round(r, 6) + 0.0 as recall, round(case when p + r <= 1e-9 then 0 else 2*p*r/(p+r) end, 6) + 0.0 as f1, round(coalesce(mi, 0.0), 6) + 0.0 as mean_iou, round(coalesce(acc, 0.0), 6) + 0.0 as property_acc, pc as pred_count, gc as gt_count from v""",
    "dedup_nms": f"""{W('fx_box').replace('with ', 'with recursive ', 1)}, {BOXES}, {_iou('gtb', 'gtb', 'and p.id <> g.id', 0.5)}, sz as (select sample_id, id, row_number() over (partition by sample_id order by (x1-x0)*(y1-y0) desc, id desc) as k from gtb),
 foe as (select i.sample_id, a.id, a.k, b.k as other from iou i join sz a on a.sample_id = i.sample_id and a.id = i.pred join sz b on b.sample_id = i.sample_id and b.id = i.gt),
 -- a row for each side of a conflict; a side whose number is below all its foes' stays, and its foes go
 fold as (select sample_id, k, other, false as out from foe union all select sample_id, k, other, out from (
   select *, sum(cast(out as int)) over (partition by sample_id, least(k, other), greatest(k, other)) > cast(out as int) as other_out from (
    select *, max(led) over (partition by sample_id, k) as out from (
     select *, max(first) over (partition by sample_id, least(k, other), greatest(k, other)) and not first as led from (
      select sample_id, k, other, k < min(other) over (partition by sample_id, k) as first from fold where not out)))) where out or not other_out),
 gone as (select distinct sample_id, k from fold where out)
 select sample_id, id from sz anti join gone using (sample_id, k)""",
    "finite_mean": f"{W('fx_point')} select 'a' as name, round(avg(cast(px as double)) filter (where feature_id % 5 <> 0), 4) + 0.0 as mean from fx_point union all select 'b', round(avg(cast(py as double)) filter (where feature_id % 3 <> 0), 4) + 0.0 from fx_point",
    "parse_rate": f"{W('fx_point')} select sample_id, count(*) as tile_count, count(*) filter (where feature_id % 4 <> 0) as decoded_ok_count, count(*) filter (where feature_id % 3 > 0) as non_empty_tiles, round(count(*) filter (where feature_id % 4 <> 0) / count(*), 6) + 0.0 as rate from fx_point group by 1",
    "parse_success_rate": f"{W('fx_point')} select round(avg(r), 6) + 0.0 as parse_success_rate from (select count(*) filter (where feature_id % 4 <> 0) / count(*) as r from fx_point group by sample_id)",
    "batch_plan": f"{W('fx_point')}, n as (select sample_id, feature_id * 100 + pt as idx, row_number() over (partition by sample_id order by feature_id % 50, grp % 2, feature_id * 100 + pt) - 1 as n from fx_point) select sample_id, idx, n // 8 as batch, n % 8 as place from n",
    "batch_counts": f"{W('fx_point')} select sample_id, cast(greatest(1, ceil(count(*) / 8)) as bigint) as n_batches from fx_point group by 1",
    "lr_schedule": "select event_id as step, round(case when event_id < 500 then 0.001 * (event_id / 500) else 0.0005 * (1 + cos(pi() * least(1, greatest(0, (event_id - 500) / 7500)))) end, 9) + 0.0 as lr from events",
    "shift_accuracy": f"""{W('fx_point')}, t as (select user_id, grp * 10 + pt as pos, px % 5 as predicted, case when py % 7 = 0 then -100 else px % 5 end as label from fx_point), s as (select user_id, predicted, lead(label) over (partition by user_id order by pos) as nxt from t)
 select user_id, count(*) as n_valid, count(*) filter (where predicted = nxt) as n_correct, round(count(*) filter (where predicted = nxt) / count(*), 6) + 0.0 as accuracy from s where nxt <> -100 group by 1""",
    "running_best": f"{W('fx_point')}, t as (select user_id, grp * 10 + pt as pos, (px * 31 + py * 17) % 1009 as loss from fx_point), b as (select *, min(loss) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding) as prior from t) select user_id, pos, prior is null or loss < prior as improved, least(loss, coalesce(prior, loss)) as best from b",
    "weighted_loss": f"{W('fx_point')} select sample_id, round(cast(sum(px * (pt + 1)) as double) / cast(sum(pt + 1) as double), 6) + 0.0 as mean_loss from fx_point group by 1",
    "export_cap": f"{W('fx_point')} select distinct sample_id, feature_id from fx_point p where (select count(distinct feature_id) from fx_point q where q.sample_id = p.sample_id and q.feature_id < p.feature_id) < 7",
    "capped_pieces": f"{W('fx_point')}, {ENV}, n as (select sample_id, feature_id, row_number() over (partition by sample_id order by ry0, feature_id) as n from env) select sample_id, feature_id from n where n <= 11",
    "cache_key": f"{W('fx_raster')}, {SCAN} select sample_id, tile_index, substr(sha1(concat_ws('|', 'ns1', 'train', 'val', sample_id, 'lane', tile_index, concat_ws('_', x0, y0, x1, y1), '256', '768', '192', '96', '6.0', '127', '1', cast(has_left as int), cast(has_top as int), '128', '32')), 1, 16) as key from scan",
    "prompt_meta": f"{W('fx_raster')} select sample_id, printf('GeoMeta crs=EPSG:32650 origin=%.3f,%.3f pixel_size=%.6f,%.6f patch_px=0,0,256,256 patch_world=%.1f,%.1f', c, f, a, e, c, f) as meta from fx_raster",
    "json_recover": "select event_id, replace(replace(props, ': ', ':'), ', ', ',') as found from events",
    "canonical_props": """select event_id, '{"a":"' || event_type || '","m":[1,null],"z":' || user_id || '}' as props from events""",
    "props_equal": "select event_id, event_id % 4 = user_id % 4 as same from events",
    "utm_roundtrip": f"""{W('fx_point')}, g as (select sample_id, feature_id, pt, px * cast(0.001 as double) + 116 as lon, py * cast(0.001 as double) + 39 as lat from fx_point), {utm_sql('g', '117')}
 select sample_id, feature_id, pt, round(east, 4) + 0.0 as east, round(north, 4) + 0.0 as north, round(lon, 7) + 0.0 as lon, round(lat, 7) + 0.0 as lat from utm""",
    "augment_square": f"""{W('fx_point')}, {MOD}, t as (select sample_id, feature_id, pt - lo as i, case feature_id % 4 when 1 then y when 2 then 255 - x when 3 then 255 - y else x end as tx, case feature_id % 4 when 1 then 255 - x when 2 then 255 - y when 3 then x else y end as ty from mod_pt)
 select sample_id, feature_id, i, case when feature_id % 3 = 0 then 255 - tx else tx end as x, case when feature_id % 5 = 0 then 255 - ty else ty end as y from t""",
    "feature_replicas": f"""{W('fx_point')}, f as (select sample_id, feature_id, row_number() over (partition by sample_id order by feature_id) - 1 as i, count(*) over (partition by sample_id) as n from (select distinct sample_id, feature_id from fx_point))
 select sample_id, feature_id, k.n as copy from f join {_N} k on k.n < 300 and k.n % f.n = f.i""",
    "round_robin": f"{W('fx_raster')}, o as (select sample_id, row_number() over (order by sample_id) - 1 as k, count(*) over () as n from fx_raster) select event_id + 1 as epoch, sample_id from events join o on event_id % n = k",
}
