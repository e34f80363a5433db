"""SQL for DuckDB that states the further queries anew."""

from __future__ import annotations

from .fixtures import with_clause as W
from .oracle import BOXES, ENV, HIT, MOD, SCAN, STATS, TILES, _dist, _greedy, NEAR, utm_sql  # noqa: I001

_LINES = "ln as (select sample_id, feature_id, count(*) as n, min(pt) as lo, max(pt) as hi from fx_point group by all having count(*) >= 2)"


def _turns(*values: str) -> str:
    return "case " + " ".join(f"when event_id % {len(values)} = {i} then {v}" for i, v in enumerate(values)) + " end"


_CRS = '{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}}'
_EVENT = "(select *, cast(user_id as varchar) as u from events)"

#: What is meant by each spoilt text, and the two forms that stay text.
_SPOILT = """with f as (select event_id, event_id % 6 as turn, '{"n":[' || event_id % 10 || '],"t":"' || event_type || '","u":' || user_id || '}' as right_form,
 '"u": ' || user_id || ', "t": "' || event_type || '", "n": [' || event_id % 10 || ']' as inner_text, '{"u": ' || user_id || ', "t": "' || event_type || '", "n":' as cut from events)"""

#: Tiles along one axis of a region.
_REGION = """m as (select * from fx_review), bx as (select sample_id, min(x0) as b0, min(y0) as b1, max(x1) as b2, max(y1) as b3 from m group by 1),
reg as (select r.sample_id, cast(width as bigint) as width, cast(height as bigint) as height, coalesce(greatest(0, b0 - 32), 0) as rx0, coalesce(greatest(0, b1 - 32), 0) as ry0, coalesce(least(width, b2 + 32), width) as rx1, coalesce(least(height, b3 + 32), height) as ry1 from fx_raster r left join bx using (sample_id)),
k as (select cast(event_id as bigint) as n from events where event_id < 20),
xs as (select distinct sample_id, width, height, case when rx1 - rx0 <= 768 then least(rx0, greatest(width - 768, 0)) else least(rx0 + 576 * n, rx1 - 768) end as x0 from reg cross join k where n = 0 or rx0 + 576 * (n - 1) < rx1 - 768),
ys as (select distinct sample_id, case when ry1 - ry0 <= 768 then least(ry0, greatest(height - 768, 0)) else least(ry0 + 576 * n, ry1 - 768) end as y0 from reg cross join k where n = 0 or ry0 + 576 * (n - 1) < ry1 - 768),
t as (select *, least(width, x0 + 768) as x1, least(height, y0 + 768) as y1 from xs join ys using (sample_id)),
st as (select t.sample_id, t.x0, t.y0, t.x1, t.y1, cast(coalesce(sum(greatest(0, least(t.x1, m.x1) - greatest(t.x0, m.x0)) * greatest(0, least(t.y1, m.y1) - greatest(t.y0, m.y0))), 0) as bigint) as mask_pixels
 from t left join m on m.sample_id = t.sample_id group by all),
sel as (select *, row_number() over (partition by sample_id order by mask_pixels / ((x1 - x0) * (y1 - y0)) desc, mask_pixels desc, y0, x0) as place from st where mask_pixels / ((x1 - x0) * (y1 - y0)) >= 0.02 or mask_pixels >= 150000)"""

_KEPT = f"""{SCAN}, {ENV}, mid as (select sample_id, feature_id, avg(px) as mx, avg(py) as my from fx_point group by all having count(*) >= 2),
said as (select s.sample_id, s.tile_index, m.feature_id, mx >= keep_x0 and mx < keep_x1 and my >= keep_y0 and my < keep_y1 as kept from scan s join env e on e.sample_id = s.sample_id and {HIT} join mid m on m.sample_id = e.sample_id and m.feature_id = e.feature_id)"""

#: Labels (even ids) and moved copies (odd ids) of one Id: copies are as long, so within the threshold the copy stays.
_DEDUP = _dist("and p.feature_id = g.feature_id") + f""", near as (select sample_id, gt from dist where distance * 0.2 <= 1.1), {_LINES}, lp as (select sample_id, feature_id from fx_pred group by all having count(*) >= 2),
every as (select sample_id, 2 * feature_id as id from ln union all select sample_id, 2 * feature_id + 1 from lp), stay as (select * from every e where not exists (select 1 from near n where n.sample_id = e.sample_id and 2 * n.gt = e.id))"""

_MATCHED = _dist(NEAR) + ", close_pairs as (select * from dist where distance <= 6), " + _greedy("close_pairs", "round(distance * 0.2, 6), round(endpoint_error * 0.2, 6)")
_EVAL = f"""{W('fx_pred', 'fx_raster').replace('with ', 'with recursive ', 1)}, {_MATCHED}, ch as (select sample_id, feature_id, max(prop_changed) as c from fx_pred group by all),
 m as (select x.sample_id, count(*) as k, 0.2 * avg(distance) as md, 0.2 * avg(endpoint_error) as me, avg(case when c = 0 and pred = gt then 1.0 else 0.0 end) as acc from matched x join ch on ch.sample_id = x.sample_id and ch.feature_id = x.pred group by 1),
 pr as (select sample_id, count(*) filter (where feature_id % 4 <> 0) / count(*) as rate from fx_point group by 1),
 n as (select g.sample_id, gc, coalesce(pc, 0) as pc, coalesce(k, 0) as k, md, me, acc, rate from (select sample_id, count(*) as gc from ge group by 1) g left join (select sample_id, count(*) as pc from pe group by 1) q on q.sample_id = g.sample_id left join m on m.sample_id = g.sample_id left join pr on pr.sample_id = g.sample_id),
 v as (select *, k / greatest(pc, 1) as p, k / greatest(gc, 1) as r from n), w as (select *, case when p + r <= 1e-9 then 0 else 2 * p * r / (p + r) end as f from v)"""

#: Ribbons lie between a line that goes right and itself higher up, so two of them overlap, over a stretch in which both lines are straight, by the integral of a trapezoid over their distance.
_RIBBON = """rg as (select sample_id, feature_id as id, pt, px + pt as x, py as y, 15 + feature_id % 40 as h, lead(px + pt) over w as x1, lead(py) over w as y1 from fx_point window w as (partition by sample_id, feature_id order by pt)),
rp as (select sample_id, feature_id as id, pt, px + pt as x, py as y, 15 + feature_id % 40 as h, lead(px + pt) over w as x1, lead(py) over w as y1 from fx_pred window w as (partition by sample_id, feature_id order by pt)),
ag as (select sample_id, id, sum((x1 - x) * h) as size from rg where x1 is not null group by all), ap as (select sample_id, id, sum((x1 - x) * h) as size from rp where x1 is not null group by all),
st as (select p.sample_id, p.id as pred, g.id as gt, greatest(p.x, g.x) as lo, least(p.x1, g.x1) as hi, p.h as hp, g.h as hg, p.x as px, p.y as py, (p.y1 - p.y) / (p.x1 - p.x) as ps, g.x as gx, g.y as gy, (g.y1 - g.y) / (g.x1 - g.x) as gs
 from rp p join rg g on p.sample_id = g.sample_id {extra} and p.x < g.x1 and g.x < p.x1 where p.x1 is not null and g.x1 is not null),
dd as (select *, (gy + gs * (lo - gx)) - (py + ps * (lo - px)) as d0, (gy + gs * (hi - gx)) - (py + ps * (hi - px)) as d1, -hg as a, least(0, hp - hg) as b, greatest(0, hp - hg) as c, hp as e, least(hp, hg) as m from st),
gg as (select *, pow(least(greatest(d0, a), b) - a, 2) / 2 + m * (least(greatest(d0, b), c) - b) + (pow(e - c, 2) - pow(e - least(greatest(d0, c), e), 2)) / 2 as g0,
 pow(least(greatest(d1, a), b) - a, 2) / 2 + m * (least(greatest(d1, b), c) - b) + (pow(e - c, 2) - pow(e - least(greatest(d1, c), e), 2)) / 2 as g1 from dd),
ov as (select sample_id, pred, gt, sum((hi - lo) * case when abs(d1 - d0) < 1e-9 then greatest(0, least(hp, d0 + hg) - greatest(0, d0)) else (g1 - g0) / (d1 - d0) end) as shared from gg group by all),
riou as (select sample_id, pred, gt, shared / (ap.size + ag.size - shared) as iou from ov join ap using (sample_id) join ag using (sample_id) where ap.id = pred and ag.id = gt)"""

_RINGS = f"""{W('fx_pred', 'fx_raster').replace('with ', 'with recursive ', 1)}, {_RIBBON.format(extra='')}, ok_iou as (select * from riou where iou >= 0.3), {_greedy('ok_iou', '-round(iou, 9)')}, ch as (select sample_id, feature_id, max(prop_changed) as c from fx_pred group by all),
 m as (select x.sample_id, count(*) as k, avg(iou) as mi, avg(case when c = 0 and pred = gt then 1.0 else 0.0 end) as acc from matched x join ch on ch.sample_id = x.sample_id and ch.feature_id = x.pred group by 1),
 pr as (select sample_id, count(*) filter (where feature_id % 4 <> 0) / count(*) as rate from fx_point group by 1),
 n as (select g.sample_id, gc, coalesce(pc, 0) as pc, coalesce(k, 0) as k, mi, acc, rate from (select sample_id, count(*) as gc from ag group by 1) g left join (select sample_id, count(*) as pc from ap group by 1) q on q.sample_id = g.sample_id left join m on m.sample_id = g.sample_id left join pr on pr.sample_id = g.sample_id),
 v as (select *, k / greatest(pc, 1) as p, k / greatest(gc, 1) as r from n), w as (select *, case when p + r <= 1e-9 then 0 else 2 * p * r / (p + r) end as f from v)"""

SQL = {
    "ring_iou": f"{W('fx_pred')}, {_RIBBON.format(extra='')} select sample_id, pred, gt, round(iou, 6) + 0.0 as iou from riou where iou >= 0.3",
    "ring_metrics": f"""{_RINGS} select sample_id, round(p, 5) + 0.0 as precision, round(r, 5) + 0.0 as recall, round(f, 5) + 0.0 as f1, round(coalesce(mi, 0.0), 5) + 0.0 as mean_iou, round(coalesce(acc, 0.0), 5) + 0.0 as property_acc, round(coalesce(rate, 0.0), 5) + 0.0 as parse_ok_rate, pc as pred_count, gc as gt_count from w""",
    "ring_report": f"""{_RINGS}, u as (select 'precision' as name, p as v from w union all select 'recall', r from w union all select 'f1', f from w union all select 'mean_iou', coalesce(mi, 0.0) from w union all select 'property_acc', coalesce(acc, 0.0) from w
 union all select 'pred_count', pc from w union all select 'gt_count', gc from w union all select 'parse_success_rate', coalesce(rate, 0.0) from w) select name, round(avg(cast(v as double)), 4) + 0.0 as mean from u group by 1""",
    "ring_dedup": f"""{W('fx_pred')}, {_RIBBON.format(extra='and p.id = g.id')}, every as (select sample_id, 2 * id as id from ag union all select sample_id, 2 * id + 1 from ap)
 select sample_id, id from every e where not exists (select 1 from riou i where i.sample_id = e.sample_id and 2 * i.gt = e.id and iou >= 0.69)""",
    "predict_areas": f"""{W('fx_raster', 'fx_point')}, {SCAN}, env as (select sample_id, feature_id, min(px + pt) as rx0, min(py) as ry0, max(px + pt) as rx1, max(py + 15 + feature_id % 40) as ry1, avg(px + pt) as mx, avg(py + (15 + feature_id % 40) / 2) as my from fx_point group by all having count(*) >= 2),
 said as (select s.sample_id, s.tile_index, e.feature_id, mx >= keep_x0 and mx < keep_x1 and my >= keep_y0 and my < keep_y1 as kept from scan s join env e on e.sample_id = s.sample_id and {HIT}),
 a as (select s.sample_id, s.tile_index, s.tile_index % 5 <> 3 as ok, count(d.feature_id) filter (where s.tile_index % 5 <> 3) as n, count(*) filter (where d.kept and s.tile_index % 5 <> 3) as k from scan s left join said d on d.sample_id = s.sample_id and d.tile_index = s.tile_index group by all)
 select sample_id, count(*) filter (where ok) as decoded_ok_count, cast(sum(n) as bigint) as n_pred, cast(sum(k) as bigint) as n_kept, (select count(distinct feature_id) from said d where d.sample_id = a.sample_id and kept and tile_index % 5 <> 3) as n_final from a group by 1""",
    "clamped_points": f"{W('fx_point')} select sample_id, feature_id, pt, round(least(greatest(px * 0.3::double - 20, 0), 255), 6) + 0.0 as u, round(least(greatest(py * 0.3::double - 20, 0), 255), 6) + 0.0 as v from fx_point",
    "canonical_line_lex": f"{W('fx_point')}, {MOD}, e as (select a.sample_id, a.feature_id, (b.y, b.x) < (a.y, a.x) as turned from mod_pt a join mod_pt b using (sample_id, feature_id) where a.pt = a.lo and b.pt = b.hi) select sample_id, feature_id, case when turned then hi - pt else pt - lo end as i, x, y from mod_pt join e using (sample_id, feature_id)",
    "sorted_features": f"""{W('fx_point')}, {_LINES}, e as (select l.sample_id, l.feature_id, n, a.py as ay, a.px as ax, z.py as zy, z.px as zx, '{{"Id":"L' || l.feature_id || '"}}' as p from ln l join fx_point a on a.sample_id = l.sample_id and a.feature_id = l.feature_id and a.pt = lo join fx_point z on z.sample_id = l.sample_id and z.feature_id = l.feature_id and z.pt = hi)
 select sample_id, feature_id, row_number() over (partition by sample_id order by ay, ax, zy, zx, n, p, feature_id) as place from e""",
    "expanded_boxes": f"{W('fx_raster')}, {TILES} select sample_id, candidate_index, case when candidate_index % 3 > 0 then greatest(0, x0 - 50) else 0 end as ex0, case when candidate_index % 3 > 0 then greatest(0, y0 - 50) else 0 end as ey0, case when candidate_index % 3 > 0 then least(width, x1 + 50) else width end as ex1, case when candidate_index % 3 > 0 then least(height, y1 + 50) else height end as ey1 from tiles",
    "rings_equal": f"{W('fx_box')}, {BOXES} select sample_id, id, abs((x0 + (id % 9) * 0.01::double) - x0) <= 1e-3 + 1e-5 * abs(x0) and abs((x1 + (id % 9) * 0.01::double) - x1) <= 1e-3 + 1e-5 * abs(x1) as same from gtb",
    "world_geometries": f"{W('fx_raster', 'fx_point')}, {_LINES} select sample_id, feature_id, pt - lo as i, round(a * px + c, 4) + 0.0 as x, round(e * py + f, 4) + 0.0 as y from fx_point join ln using (sample_id, feature_id) join fx_raster using (sample_id)",
    "mixed_crs": f"""{W('fx_point', 'fx_raster')}, {_LINES}, g as (select sample_id, feature_id, pt - lo as i, px * cast(0.001 as double) + 116 as lon, py * cast(0.001 as double) + 39 as lat, case when sample_id % 2 = 0 then 117 else 123 end as middle from fx_point join ln using (sample_id, feature_id)),
 {utm_sql('g', 'middle')} select sample_id, feature_id, i, round((east - c) / a, 2) + 0.0 as x, round((north - f) / e, 2) + 0.0 as y from utm join fx_raster using (sample_id)""",
    "shifted_lines": f"{W('fx_raster', 'fx_point')}, {_LINES} select sample_id, feature_id, pt - lo as i, cast(least(greatest(px + 300, 0), width - 1) as double) as x, cast(least(greatest(py - 200, 0), height - 1) as double) as y from fx_point join ln using (sample_id, feature_id) join fx_raster using (sample_id)",
    "grid_offsets": f"{W('fx_raster', 'fx_point')}, f as (select distinct sample_id, feature_id from fx_point) select sample_id, feature_id, round((feature_id % 30 % 6) * (width / 6) + 0.35::double * (width / 6), 4) + 0.0 as dx, round((feature_id % 30 // 6) * (height / 5) + 0.35::double * (height / 5), 4) + 0.0 as dy from f join fx_raster using (sample_id)",
    "any_vertex_inside": f"{W('fx_point')}, {_LINES} select sample_id, feature_id, bool_or(px >= 200 and px < 1000 and py >= 150 and py < 800) as inside from fx_point join ln using (sample_id, feature_id) group by all",
    "stage_tiles": f"{W('fx_raster', 'fx_review')}, {_REGION} select sample_id, row_number() over (partition by sample_id order by y0, x0) - 1 as tile_index, x0, y0, x1, y1, mask_pixels from sel where place <= 3",
    "prediction_tiles": f"{W('fx_raster')}, {SCAN} select sample_id, tile_index, x0, y0, x1, y1 from scan where sample_id % 2 = 0 union all select sample_id, 0, 0, 0, width, height from fx_raster where sample_id % 2 = 1",
    "feature_strip_join": f"""{W('fx_raster', 'fx_point')}, {SCAN}, {ENV}, {_LINES}, strips as (select sample_id, tile_index, 0 as strip, x0, y0, least(x1, x0 + 128) as x1, y1 from scan where has_left union all select sample_id, tile_index, 1, x0, y0, x1, least(y1, y0 + 128) from scan where has_top)
 select s.sample_id, tile_index, strip, e.feature_id from strips s join env e on e.sample_id = s.sample_id and {HIT} join ln on ln.sample_id = e.sample_id and ln.feature_id = e.feature_id""",
    "prepare_polygons": f"""{W('fx_box')}, {BOXES}, {SCAN} select b.sample_id, tile_index, b.id as feature_id, not (b.x0 >= s.x0 and b.y0 >= s.y0 and b.x1 <= s.x1 and b.y1 <= s.y1) as clipped,
 round(cast((least(b.x1, s.x1) - greatest(b.x0, s.x0)) * (least(b.y1, s.y1) - greatest(b.y0, s.y0)) as double), 4) + 0.0 as area from gtb b join scan s on s.sample_id = b.sample_id and b.x0 < s.x1 and b.x1 > s.x0 and b.y0 < s.y1 and b.y1 > s.y0""",
    "ring_targets": f"{W('fx_box')}, {BOXES} select sample_id, id, case when id % 2 = 0 then 'internal' else 'none' end as cut_in, case when id % 2 = 0 then 'internal' else 'none' end as cut_out, 'local' as source, cast(x0 as double) as x, cast(y0 as double) as y, cast(x1 as double) as x2 from gtb",
    "items_from_uv": f"""{W('fx_raster', 'fx_point')}, {TILES}, {ENV}, {_LINES} select t.sample_id, candidate_index, e.feature_id, '{{"Id":' || e.feature_id || '}}' as props, cast(a.px as double) as x, cast(z.py as double) as y from tiles t join env e on t.sample_id = e.sample_id and {HIT}
 join ln on ln.sample_id = e.sample_id and ln.feature_id = e.feature_id join fx_point a on a.sample_id = ln.sample_id and a.feature_id = ln.feature_id and a.pt = lo join fx_point z on z.sample_id = ln.sample_id and z.feature_id = ln.feature_id and z.pt = hi""",
    "dedup_lines": f"{W('fx_pred', 'fx_raster')}, {_DEDUP} select sample_id, id from stay",
    "stitched_counts": f"{W('fx_pred', 'fx_raster')}, {_DEDUP} select sample_id, count(*) as n_patch, count(s.id) as n_stitched from every left join stay s using (sample_id, id) group by 1",
    "predict_replay": f"""{W('fx_raster', 'fx_point')}, {_KEPT}, a as (select s.sample_id, s.tile_index, s.tile_index % 5 <> 3 as ok, count(d.feature_id) filter (where s.tile_index % 5 <> 3) as n, count(*) filter (where d.kept and s.tile_index % 5 <> 3) as k from scan s left join said d on d.sample_id = s.sample_id and d.tile_index = s.tile_index group by all)
 select sample_id, count(*) as tile_count, count(*) filter (where ok) as decoded_ok_count, count(*) filter (where n > 0) as non_empty_tiles, cast(sum(n) as bigint) as n_pred, cast(sum(k) as bigint) as n_kept, (select count(distinct feature_id) from said d where d.sample_id = a.sample_id and kept and tile_index % 5 <> 3) as n_final from a group by 1""",
    "evaluate": f"""{_EVAL} select sample_id, round(p, 5) + 0.0 as precision, round(r, 5) + 0.0 as recall, round(f, 5) + 0.0 as f1, round(coalesce(md, -1.0), 5) + 0.0 as mean_hausdorff, round(coalesce(me, -1.0), 5) + 0.0 as mean_endpoint_error, round(coalesce(acc, 0.0), 5) + 0.0 as property_acc, round(coalesce(rate, 0.0), 5) + 0.0 as parse_ok_rate,
 pc as pred_count, gc as gt_count, pc - k as unmatched_pred, gc - k as unmatched_gt from w""",
    "evaluate_report": f"""{_EVAL}, u as (select 'precision' as name, p as v from w union all select 'recall', r from w union all select 'f1', f from w union all select 'mean_hausdorff', md from w union all select 'mean_endpoint_error', me from w union all select 'property_acc', coalesce(acc, 0.0) from w
 union all select 'pred_count', pc from w union all select 'gt_count', gc from w union all select 'unmatched_pred', pc - k from w union all select 'unmatched_gt', gc - k from w union all select 'parse_success_rate', coalesce(rate, 0.0) from w)
 select name, round(avg(cast(v as double)), 4) + 0.0 as mean from u where v is not null group by 1""",
    "feature_collections": f"""select event_id, {_turns(f"""'{{"name":"Lane","crs":{_CRS},"features":[{{"k":' || u || '}}],"type":"FeatureCollection"}}'""", f"""'{{"type":"FeatureCollection","name":"Lane","crs":{_CRS},"features":[{{"properties":{{"k":' || u || '}},"type":"Feature"}}]}}'""", f"""'{{"type":"FeatureCollection","name":"N","crs":{_CRS},"features":[' || u || ']}}'""", "null", "null")} as found from {_EVENT}""",
    "parsed_props": f"""{_SPOILT} select event_id, case turn when 4 then '{{"_raw_text":' || cast(to_json(inner_text) as varchar) || '}}' when 5 then '{{"_raw_text":' || cast(to_json(cut) as varchar) || '}}' else right_form end as props from f""",
    "relaxed_props": f"""{_SPOILT} select event_id, case when turn = 5 then '{{"_raw_text":' || cast(to_json(cut) as varchar) || '}}' else right_form end as props from f""",
    "truth_flags": """with w as (select event_id, list_extract(['yes', 'no', 'on', 'off', 'true', 'false', '1', '0', ''], event_id % 9 + 1) as word, user_id % 4 as k, event_id % 3 as n from events),
 v as (select event_id, case when k < 2 then case when word in ('yes', 'on', 'true', '1') then true else false end when k = 3 then case n when 1 then true when 0 then false end end as v from w) select event_id, coalesce(v, false) as a, coalesce(v, true) as b from v""",
    "task_prompts": f"{W('fx_raster')}, {SCAN} select sample_id, tile_index, 'GeoMeta ' || x0 || ' Find lanes. Write JSON.' || case when has_left or has_top then ' Continue the features in the state.' else '' end as prompt from scan",
    "state_texts": f"""{W('fx_point')}, {ENV} select sample_id, feature_id, case when feature_id % 3 = 0 then 'State none' else 'State anchors=1' || chr(10) || 'idx=000 side=' || case when feature_id % 2 = 0 then 'left' else 'top' end || ' points=' || rx0 || '.0,' || ry0 || '.0;' || rx1 || '.0,' || ry1 || '.0' || chr(10) || 'StateGeoJSON {{}}' end as text from env""",
    "target_texts": f"""{W('fx_point')}, {MOD}, e as (select sample_id, feature_id, max(case when i = 0 then side end) as a, max(case when i = n - 1 then side end) as z from canon group by all),
 t as (select sample_id, feature_id, case when a <> 'none' then a when feature_id % 3 = 0 then 'internal' else 'none' end as cut_in, case when z <> 'none' then z when feature_id % 2 = 0 then 'internal' else 'none' end as cut_out from e)
 select sample_id, feature_id, 'Targets features=1' || chr(10) || 'idx=000 cut_in=' || cut_in || ' cut_out=' || cut_out || chr(10) || '{{}}' as text from t""",
    "cut_counts": f"""{W('fx_point')}, {MOD}, e as (select sample_id, feature_id, max(case when i = 0 then side end) as a, max(case when i = n - 1 then side end) as z from canon group by all)
 select sample_id, count(*) as n, count(*) filter (where a <> 'none' or feature_id % 3 = 0) as n_in, count(*) filter (where z <> 'none' or feature_id % 2 = 0) as n_out from e group by 1""",
    "raw_dumps": f"{W('fx_raster')}, {SCAN} select sample_id, string_agg(printf('[tile %04d]', tile_index) || chr(10) || case when tile_index % 4 > 0 then 't' || x0 else '' end, chr(10) order by tile_index) as dump from scan group by 1",
    "memory_risks": """with r as (select p_partkey, p_partkey % 3 as mode, p_size * 10 as image, p_partkey % 4 * 512 as target, p_size % 3 * 400 as state, p_partkey % 2 * 128 as prompt, p_partkey % 5 * 30 as lane, p_size % 4 * 15 as crossing, p_partkey % 7 * 4 as memory, p_size % 4 as batch, p_partkey % 2 = 0 as amp, p_retailprice > 1400 as ckpt from part),
 x as (select *, [
  case mode when 0 then {'p': 5, 'r': 'llm_train_mode=full', 'a': 'switch to LoRA if possible'} when 1 then {'p': 1, 'r': 'llm_train_mode=lora', 'a': null} end,
  case when image >= 448 then {'p': 3, 'r': 'image_size=' || image, 'a': 'reduce image_size to 336 or 288'} when image >= 384 then {'p': 2, 'r': 'image_size=' || image, 'a': null} when image >= 336 then {'p': 1, 'r': 'image_size=' || image, 'a': null} end,
  case when target = 0 then {'p': 3, 'r': 'target_max_tokens=unlimited', 'a': 'set target_max_tokens to 1024 or lower'} when target > 1024 then {'p': 2, 'r': 'target_max_tokens=' || target, 'a': null} end,
  case when state = 0 then {'p': 2, 'r': 'state_max_tokens=unlimited', 'a': 'set state_max_tokens to 512 or lower'} when state > 512 then {'p': 1, 'r': 'state_max_tokens=' || state, 'a': null} end,
  case when prompt = 0 then {'p': 1, 'r': 'prompt_max_tokens=unlimited', 'a': null} end,
  case when lane = 0 then {'p': 1, 'r': 'lane.max_features=unlimited', 'a': 'cap lane.max_features'} when lane > 64 then {'p': 1, 'r': 'lane.max_features=' || lane, 'a': null} end,
  case when crossing = 0 then {'p': 1, 'r': 'intersection.max_features=unlimited', 'a': 'cap intersection.max_features'} when crossing > 32 then {'p': 1, 'r': 'intersection.max_features=' || crossing, 'a': null} end,
  case when memory > 16 then {'p': 1, 'r': 'state_update.max_features=' || memory, 'a': null} end, case when batch > 1 then {'p': greatest(2, batch), 'r': 'batch_size=' || batch, 'a': 'keep batch_size at 1'} end,
  case when not amp then {'p': 2, 'r': 'amp=false', 'a': 'enable amp'} end, case when not ckpt then {'p': 2, 'r': 'gradient_checkpointing=false', 'a': 'enable gradient checkpointing'} end] as rules from r),
 y as (select p_partkey, list_filter(rules, lambda v: v is not null) as rules from x), z as (select p_partkey, rules, cast(coalesce(list_sum(list_transform(rules, lambda v: v.p)), 0) as bigint) as score from y)
 select p_partkey, score, case when score >= 10 then 'high' when score >= 6 then 'medium' else 'low' end as level, array_to_string(list_transform(rules, lambda v: v.r), ';') as reasons, array_to_string(list_filter(list_transform(rules, lambda v: v.a), lambda v: v is not null), ';') as suggestions from z""",
    "subset_batches": f"{W('fx_point')}, n as (select sample_id, feature_id as idx, row_number() over (partition by sample_id order by feature_id % 50, feature_id) - 1 as n from (select distinct sample_id, feature_id from fx_point)) select sample_id, idx, n // 16 as batch, n % 16 as place from n where n // 16 in (1, 3)",
    "configured_prompts": f"""{W('fx_raster')}, {SCAN} select sample_id, tile_index, 'Place ' || x0 || ' Write down the reviewed Lane features of this image patch as one GeoJSON feature collection. ' || case when has_left or has_top then 'Go on.' else 'No earlier patch has cut features of this one.' end as lane,
 'Write down the reviewed Intersection features of this image patch as one GeoJSON feature collection. ' || case when has_left or has_top then 'Anchors of features that earlier patches cut follow; write down only what goes on here.' else 'No earlier patch has cut features of this one.' end as crossing from scan""",
    "parameter_summary": "with t as (select cast(sum(p_size) as bigint) as total, cast(sum(p_size) filter (where p_partkey % 3 = 0) as bigint) as n_trainable from part) select *, round(n_trainable / total, 6) as share from t",
    "grouped_indices": f"{W('fx_point')}, f as (select distinct sample_id, feature_id from fx_point) select sample_id, string_agg(cast(feature_id as varchar), ',' order by feature_id % 5, feature_id) as indices from f group by 1",
    "best_tokens": f"{W('fx_point')} select user_id, grp, arg_min(pt, (-((px * 7919 + py * 104729) % 1000), pt)) as token from fx_point group by all",
    "truncated_tokens": "select event_id, least(strlen(event_type) + 1, 6) as n, strlen(event_type) < 6 as ends from events",
    "prediction_audit": f"""{W('fx_raster', 'fx_mask')}, {STATS}, g as (select *, mask_ratio >= 0.3 or mask_pixels >= 200000 as ok from ratio), h as (select *, bool_or(ok) over (partition by sample_id) as any_ok from g),
 q as (select *, ok or not any_ok as stands from h), o as (select *, row_number() over (partition by sample_id order by stands desc, mask_ratio desc, mask_pixels desc, candidate_index) as place, row_number() over (partition by sample_id order by y0, x0) - 1 as tile_index from q)
 select sample_id, tile_index, stands and place <= 4 as selected, case when stands and place <= 4 then 'selected' when not stands then 'below_mask_threshold' else 'truncated_by_max_tiles' end as reason from o""",
    "sample_dirs": f"{W('fx_point')} select distinct on (sample_id, feature_id) feature_id, '/data/train/s' || feature_id as sample_dir from fx_point",
    "tiled_replay_predict": f"""{W('fx_raster', 'fx_point')}, {_KEPT}, k as (select sample_id, feature_id, count(*) as n_parts from said where kept group by all), {_LINES}
 select sample_id, '{{"Id":"L' || feature_id || '"}}' as props, n + (n_parts - 1) * (n - 1) as n_points, n_parts from k join ln using (sample_id, feature_id)""",
    "geojson_roundtrip": f"""{W('fx_point')}, g as (select sample_id, feature_id, pt, sqrt(pow(px - lag(px) over w, 2) + pow(py - lag(py) over w, 2)) as d from fx_point window w as (partition by sample_id, feature_id order by pt))
 select sample_id, 'L' || feature_id as id, count(*) as n_points, round(sum(coalesce(d, 0)), 3) + 0.0 as length from g group by sample_id, feature_id having count(*) >= 2""",
    "grammar_mask": f"""{W('fx_point')}, {_LINES} select sample_id, feature_id, case feature_id % 6 when 5 then 'invalid:start' when 2 then 'invalid:geometry' when 3 then 'invalid:point_y'
 else case when n < 6 then 'invalid:point' when feature_id % 6 = 0 then 'end' when feature_id % 6 = 1 then 'map' else 'invalid:closing' end end as state from ln""",
    "chosen_tokens": f"""{W('fx_point')}, r as (select user_id, grp, pt as token, ((px * 7919 + py * 104729) % 1000 - 500)::double as score, px % 3 > 0 as ok from fx_point), q as (select *, case when token % 2 = 1 then score when score > 0 then score / 2 else score * 2 end as s, bool_or(ok) over (partition by user_id, grp) as any_ok from r)
 select user_id, grp, arg_min(token, (-s, token)) as token from q where ok or not any_ok group by all""",
    "token_limits": "with t as (select event_id, case when event_id % 3 = 0 then greatest(1, 4096 - user_id * 40 - 1) else event_id % 3 * 256 end as most, greatest(event_id % 11 - 2, 0) as l from events) select event_id, most, least(l, most) as least from t",
    "token_codec_roundtrip": f"""{W('fx_point')}, {MOD}, it as (select sample_id, feature_id, n, max(case when i = 0 then y end) as ay, max(case when i = 0 then x end) as ax, max(case when i = n - 1 then y end) as zy, max(case when i = n - 1 then x end) as zx, '{{"Id":"L' || feature_id || '"}}' as p from canon group by all)
 select sample_id, count(*) as n_items, true as saw_object, arg_min(p, (ay, ax, zy, zx, n, p)) as first_props from it group by 1""",
}
