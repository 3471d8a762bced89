"""Inputs of the fusion queries, derived from the given tables by integer arithmetic.

Each is SQL that Spark and DuckDB read alike; ``{us}``, ``{s}`` and ``{f:name}``
stand for an event's microseconds, the string type and another fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

N_CONCEPTS = 180

FIXTURES = {
    "fx_pixel": f"""select cast(floor(o_orderkey/192) as int)%4 scene_id, cast(floor(o_orderkey/192) as int) frame_id, cast(o_orderkey%16 as int) px,
      cast(floor((o_orderkey%192)/16) as int) py, cast(o_orderkey as bigint) k, cast(o_custkey%{N_CONCEPTS} as int) concept, cast(o_custkey as bigint) ck from orders""",
    "fx_model": """select * from (values (0,'ade20k','internimage',false),(1,'ade20k','internimage',true),(2,'nyu40id','cmx',false),
      (3,'wn199','ovseg',false),(4,'wn199','groundedsam',false),(5,'id','mask3d',false)) v(model_no,label_space,model,flip)""",
    "fx_pred": f"""select scene_id,frame_id,px,py,model_no,label_space,model,flip,k,case when model_no=3 and k%13=0 then 0 when label_space='ade20k' then c
      when label_space='nyu40id' then cast(floor(c/2) as int)+1 when label_space='wn199' then c+1 else c*3+1 end label
      from (select *, cast(case when (k*(7+2*model_no)+model_no)%4=0 then (concept+k+model_no)%{N_CONCEPTS} else concept end as int) c
        from {{f:fx_pixel}} p cross join {{f:fx_model}} m) q""",
    "fx_vocab": """select c row_idx, c*3+1 id, p_name category, p_size cnt,
      case when c%11=10 then null else concat('syn ',cast(cast(floor(c/2) as int) as {s}),'.n.01') end wnsynsetkey,
      case when c%11=10 then null else cast(c+1 as {s}) end wn199, case when c%11=10 then null else cast(c-c%2+1 as {s}) end wn_merged,
      cast(cast(floor(c/2) as int)+1 as {s}) nyu40id,
      case when c%7=3 then null when c%5=4 then concat(cast(c as {s}),',',cast(c+1 as {s})) else cast(c as {s}) end ade20k,
      concat(cast(c%32*8 as {s}),'-',cast(255-c%32*8 as {s}),'-',cast(p_size as {s})) color
      from (select cast(p_partkey as int) c,p_name,cast(p_size as int) p_size from part) q""",
    "fx_gt": "select scene_id,frame_id,px,py,k,case when k%17=0 then 0 else concept-concept%2+1 end label from {f:fx_pixel} p",
    "fx_depth": """select scene_id,frame_id,px,py,k,mono, case when k%3=0 then 0 when scene_id=1 then mono*3+cast(k%7 as int)*10
      else cast(floor(mono*6/5) as int)+cast(k%7 as int)*10 end depth_mm from (select *, cast(500+(ck*37)%2500 as int) mono from {f:fx_pixel} p) q""",
    "fx_pose": """select scene_id,frame_id, case when frame_id%2=1 then 0.6e0 else 1e0 end c, case when frame_id%2=1 then 0.8e0 else 0e0 end s,
      0.1e0*(frame_id%5) tx, 0.05e0*(frame_id%3) ty, 0e0 tz from (select distinct scene_id,frame_id from {f:fx_pixel} p) q""",
    "fx_point": """select cast(p_partkey%4 as int) scene_id, cast(p_partkey as int) vertex_id, (p_partkey%50)*0.04e0-1.0e0 x,
      floor((p_partkey%2000)/50)*0.05e0-1.0e0 y, case when p_partkey%7=0 then 2.05e0 when p_partkey%7=1 then 2.2e0 else 2.0e0 end z from part""",
    "fx_sensor": "select cast(user_id%4 as int) scene_id, event_type kind, event_id, {us} us from events where event_type<>'signup'",
    "fx_traj": """select cast(user_id%4 as int) scene_id, {us} us, (event_id*13%200)/100e0-1e0 rx, (event_id*29%150)/100e0-0.75e0 ry, (event_id%157)/100e0 rz, value tx, (event_id%10)/10e0 ty, 0e0 tz
      from events where event_type='view'""",
    "fx_box": """select cast(floor(event_id/25) as int) frame_id, cast(event_id as int) box_id, ((event_id*37)%100)/100e0 cx, ((event_id*53)%100)/100e0 cy,
      (5+(event_id*11)%30)/100e0 w, (5+(event_id*17)%30)/100e0 h, ((event_id*7919)%1000)/1000e0 score from events""",
    "fx_inst": """select distinct cast(l_suppkey%4 as int) scene_id, cast(l_suppkey as int) inst_id, cast(l_partkey as int) vertex_id,
      ((l_suppkey*613)%1000)/1000e0 score, cast(l_suppkey%20 as int) class_idx from lineitem""",
    "fx_score": """select scene_id,frame_id,px,py,c class_idx, cast((k*31+c*c*97+ck)%1000 as int)/1000e0 score from {f:fx_pixel} p
      cross join (select * from (values (0),(1),(2),(3),(4)) v(c)) q""",
    "fx_hit": """select scene_id,frame_id,px,py,i inst_idx, ((k*17+i*29+ck)%40)/100e0+0.5e0 t from {f:fx_pixel} p
      cross join (select * from (values (0),(1),(2),(3),(4),(5)) v(i)) q where (k+i*3)%4<>0""",
}
SPARK = {"us": "unix_micros(cast(ts as timestamp))", "s": "string"}
DUCK = {"us": "epoch_us(ts)", "s": "varchar"}


def _resolved(name: str, dialect: dict[str, str]) -> str:
    text = FIXTURES[name]
    for key, value in dialect.items():
        text = text.replace("{" + key + "}", value)
    return re.sub(r"\{f:(\w+)\}", r"\1", text)


def _needs(text: str) -> list[str]:
    """Fixtures that a text names, and what these need, in order of use."""
    found: list[str] = []
    for name in FIXTURES:
        if re.search(rf"\b{name}\b", text):
            found += [x for x in _needs(FIXTURES[name]) if x not in found]
            found += [name] if name not in found else []
    return found


def duck(body: str) -> str:
    """body, which may begin with its own common tables, over the fixtures it names."""
    own = body.strip()
    with_ = [f"{n} as ({_resolved(n, DUCK)})" for n in _needs(own)]
    head = "with recursive " if own.lower().startswith("with recursive") else "with "
    for word in ("with recursive ", "with "):
        if own.lower().startswith(word):
            return head + ", ".join(with_) + (", " if with_ else "") + own[len(word) :]
    return (head + ", ".join(with_) + " " if with_ else "") + own


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; tables and other fixtures are parameters of its SQL."""
    text = _resolved(name, SPARK)
    inner = {n: fixture(spark, sf_dir, n) for n in _needs(FIXTURES[name])}
    tables = re.findall(r"\b(?:from|join)\s+(orders|part|events|lineitem|supplier|nation)\b", text)
    inner |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for n in inner:
        text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **inner)


class Inputs:
    """The fixtures and tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in FIXTURES:
            return fixture(self.spark, self.sf_dir, f"fx_{name}")
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
