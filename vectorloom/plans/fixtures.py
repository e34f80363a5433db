"""Representative vector-map tables derived from the driver's relational ones, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "part", "orders", "events", "lineitem", "customer")

VIEWS = {
    "fx_raster": """select r_regionkey as sample_id, 2048 + 256*r_regionkey as width, 1536 + 128*r_regionkey as height,
       cast(0.2 as double) as a, cast(468000 + 1000*r_regionkey as double) as c, cast(-0.2 as double) as e, cast(4438000 + 500*r_regionkey as double) as f
from region""",
    "fx_mask": """select distinct sample_id, 64*cx as x0, 64*cy as y0, least(64*cx+64, width) as x1, least(64*cy+64, height) as y1
from (select r.sample_id, r.width, r.height,
             cast((cast(floor(p_partkey/5) as bigint)*7 + p_size) % cast(ceil(r.width/64) as bigint) as bigint) as cx,
             cast((p_size*3 + cast(floor(p_partkey/25) as bigint)) % cast(ceil(r.height/64) as bigint) as bigint) as cy
      from part join fx_raster r on p_partkey % 5 = r.sample_id) t""",
    "fx_review": """select distinct sample_id, 64*cx as x0, 64*cy as y0, least(64*cx+64, width) as x1, least(64*cy+64, height) as y1
from (select r.sample_id, r.width, r.height,
             10 + cast((cast(floor(p_partkey/5) as bigint)*7 + p_size) % (cast(ceil(r.width/64) as bigint) - 10) as bigint) as cx,
             7 + cast((p_size*3 + cast(floor(p_partkey/25) as bigint)) % (cast(ceil(r.height/64) as bigint) - 7) as bigint) as cy
      from part join fx_raster r on p_partkey % 5 = r.sample_id) t""",
    "fx_point": """select sample_id, user_id*100 + grp as feature_id, user_id, grp, seq - 10*grp as pt,
       (user_id*97 + 13*grp) % 1500 + cast(sum(event_id*7 % 41) over (partition by user_id, grp order by seq rows unbounded preceding) as bigint) as px,
       (user_id*61 + 29*grp) % 1200 + cast(sum(event_id*13 % 41 - 20) over (partition by user_id, grp order by seq rows unbounded preceding) as bigint) as py
from (select user_id % 5 as sample_id, user_id, event_id, seq, cast(floor(seq/10) as bigint) as grp
      from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events) a) b""",
    "fx_pred": """select sample_id, feature_id, pt, px + (feature_id % 5 - 2)*4 as px, py + (feature_id % 3 - 1)*3 as py,
       case when feature_id % 7 = 0 then 1 else 0 end as prop_changed
from fx_point where feature_id % 11 <> 0""",
    "fx_box": """select r.sample_id, o_orderkey as feature_id,
       (o_orderkey*37) % (r.width - 200) as x0, (o_orderkey*53) % (r.height - 200) as y0,
       (o_orderkey*37) % (r.width - 200) + 20 + o_orderkey % 150 as x1, (o_orderkey*53) % (r.height - 200) + 20 + o_orderkey % 90 as y1
from orders join fx_raster r on o_orderkey % 5 = r.sample_id""",
}
_NEEDS = {"fx_raster": (), "fx_mask": ("fx_raster",), "fx_review": ("fx_raster",), "fx_point": (), "fx_pred": ("fx_point",), "fx_box": ("fx_raster",)}


def closure(*names: str) -> list[str]:
    """The views and those that they need, in order."""
    out: list[str] = []
    for n in names:
        out += [x for x in (*closure(*_NEEDS[n]), n) if x not in out]
    return out


def with_clause(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in closure(*names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; tables are read by path, so nothing is registered in the catalog."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in VIEWS[name]}
    frames |= {n: view(spark, sf_dir, n) for n in _NEEDS[name]}
    sql = VIEWS[name]
    for t in sorted(frames, key=len, reverse=True):
        for word in ("from", "join"):
            sql = sql.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t})", f"{word} {{{t}}})")
            if sql.endswith(f"{word} {t}"):
                sql = sql[: -len(t)] + f"{{{t}}}"
    return spark.sql(sql, **frames)
