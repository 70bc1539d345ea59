"""Inputs of the registered queries: frames, pixels, packets, jobs and geometry as projections of the test tables.

Each is SQL in both dialects; {name} stands for a table or another of these.
Operators take DataFrames with such columns, wherever they come from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.geometry import PRESETS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

#: name: (Spark SQL, DuckDB SQL)
VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, spark: str, duck: str | None = None) -> None:
    VIEWS[name] = (spark, duck or spark)


class Inputs:
    """Tables and views over the Parquet tables of a folder; the session's own views are left alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                text = VIEWS[name][0]
                self.made[name] = self.spark.sql(text, **{n: self(n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text))})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.made[name]


def duck(sql: str) -> str:
    """A DuckDB statement with the views that it uses."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in used:
                visit(VIEWS[name][1])
                used.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ", ".join(f"{n} as ({plain(VIEWS[n][1])})" for n in used)
    return (f"with {head} " if head else "") + plain(sql)


# one row a frame with its plane of 8 x 8, then each pixel once
view(
    "planes",
    "select vec_id as frame_no, transform(embedding, v -> cast(least(255, greatest(0, floor((cast(v as double) * 2 + 1) * 127.5))) as int)) as l from {embeddings}",
    "select vec_id as frame_no, list_transform(embedding, lambda v: least(255, greatest(0, floor((v::double * 2 + 1) * 127.5)))::int) as l from {embeddings}",
)
view(
    "px_luma",
    "select frame_no, inline(transform(l, (v, i) -> named_struct('y', cast(i div 8 as int), 'x', cast(i % 8 as int), 'luma', v))) from {planes}",
    "select frame_no, (i // 8)::int as y, (i % 8)::int as x, l[i + 1] as luma from (select frame_no, l, unnest(range(64)) as i from {planes})",
)
_RGB = "'y', cast(i div 8 as int), 'x', cast(i % 8 as int), 'r', v, 'g', l[cast((i div 8 + 3) % 8 * 8 + i % 8 as int)], 'b', l[cast(i div 8 * 8 + (i % 8 + 5) % 8 as int)]"
# DuckDB waits for ever on several scans of an unnested plane under a limit, so its pixels come from places of the list too
_DUCK_RGB = "(i // 8)::int as y, (i % 8)::int as x, l[i + 1] as r, l[(i // 8 + 3) % 8 * 8 + i % 8 + 1] as g, l[i // 8 * 8 + (i % 8 + 5) % 8 + 1] as b"
view(
    "px_rgb",
    f"select frame_no, inline(transform(l, (v, i) -> named_struct({_RGB}))) from {{planes}}",
    f"select frame_no, {_DUCK_RGB} from (select frame_no, l, unnest(range(64)) as i from {{planes}})",
)
view(
    "px_rgba",
    f"""select frame_no, inline(transform(l, (v, i) -> named_struct({_RGB}, 'a', alpha[i])))
       from (select p.*, n.l as alpha from {{planes}} p join {{planes}} n on n.frame_no = (p.frame_no + 1) % (select count(*) from {{embeddings}}))""",
    f"""select frame_no, {_DUCK_RGB}, alpha[i + 1] as a from (select p.frame_no, p.l, n.l as alpha, unnest(range(64)) as i
       from {{planes}} p join {{planes}} n on n.frame_no = (p.frame_no + 1) % (select count(*) from {{embeddings}}))""",
)
# each frame beside the next
view(
    "px_pairs",
    "select frame_no, inline(transform(l, (v, i) -> named_struct('y', cast(i div 8 as int), 'x', cast(i % 8 as int), 'a', v, 'b', next[i]))) from (select p.*, n.l as next from {planes} p join {planes} n on n.frame_no = p.frame_no + 1)",
    "select p.frame_no, p.y, p.x, p.luma as a, n.luma as b from {px_luma} p join {px_luma} n on n.frame_no = p.frame_no + 1 and n.y = p.y and n.x = p.x",
)
view("packets_meta", "select user_id as source_id, row_number() over (partition by user_id order by event_id) - 1 as frame_no, 100 + (event_id * 37) % 900 as size, event_id, ts from {events}")
view(
    "jobs",
    """select o_orderkey as job_id, case o_orderstatus when 'F' then 'done' when 'P' then 'encoding' else case when o_orderkey % 5 = 0 then 'failed' else 'queued' end end as status,
              o_orderpriority as priority, (o_orderkey * 13) % 300 as written, case when o_orderkey % 11 = 0 then 0 else 240 + o_orderkey % 60 end as total from {orders}""",
)
view("presets", "select * from (values " + ", ".join(f"('{n}', {w}, {h})" for n, w, h in PRESETS) + ") as t(name, dst_w, dst_h)")
view("geom", "select p_partkey as geom_id, case when p_partkey % 40 = 0 then dst_w * 2 else 16 + (p_partkey * 37) % 4000 end as src_w, case when p_partkey % 40 = 0 then dst_h * 2 else 16 + (p_partkey * 91) % 2200 end as src_h, name, dst_w, dst_h from {part} cross join {presets}")
view(
    "streams",
    "select event_id as stream_id, case event_id % 17 when 0 then 'DXT1' when 1 then 'DXT5' when 2 then 'YCG6' when 3 then 'YG10' when 4 then 'DXD3' when 5 then 'Hap1' when 6 then 'Hap5' when 7 then 'HapY' when 8 then 'HapM' when 9 then 'HapA' when 10 then 'DXDI' when 11 then 'avc1' when 12 then 'ap4h' when 13 then 'apcn' when 14 then 'été1' when 15 then 'abc' end as fourcc from {events}",
)
