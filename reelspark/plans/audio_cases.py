"""Registered queries of sound."""

from pyspark.sql import functions as F

from ..operators import audio as a
from .fixtures import view
from .registry import case

_V = "(event_id * 7919 * ({c} + 3) % 65536 - 32768) * 65536 + event_id"
view("sound", "select source_id, channel, frame_no as n, " + _V.format(c="channel") + " as v from (select *, explode(array(0, 1)) as channel from {packets_meta})", "select source_id, channel, frame_no as n, " + _V.format(c="channel") + " as v from (select *, unnest([0, 1]) as channel from {packets_meta})")
_RATES, _SIZE = (44_100, 48_000), 256

# 147 samples stand for 160 outputs; weights lie within eight samples
_WEIGHTS = """(with d as (select phase, k, k - phase / 160.0::double as d from (select unnest(range(160)) as phase), (select unnest(range(-7, 9)) as k)),
    r as (select phase, k, if(abs(d) < 8, if(d = 0, 1.0, sin(pi() * d) / (pi() * d)) * pow(cos(pi() * d / 16), 2), 0.0) as raw from d),
    f as (select phase, k, floor(65536 * raw / sum(raw) over (partition by phase order by k rows between unbounded preceding and unbounded following) + 0.5)::bigint as w from r)
    select phase, k, w + if(k = (2 * phase > 160)::int, 65536 - sum(w) over (partition by phase), 0) as w from f)"""
_OUTPUTS = f"""(select source_id, channel, m, floor((sum(v * w) + 32768) / 65536.0)::bigint as v
    from (select o.source_id, o.channel, m, s.v, x.w from (select source_id, channel, unnest(range((count(*) * 160 + 146) // 147)) as m from {{sound}} group by source_id, channel) o
          join {_WEIGHTS} x on x.phase = m * 147 % 160 join {{sound}} s on s.source_id = o.source_id and s.channel = o.channel and s.n = m * 147 // 160 + k) group by all)"""


def _resampled(t):
    return a.resample(a.blocks(t("sound"), _SIZE), *_RATES, _SIZE)


case(
    "audio_resample",
    "source_id long, channel long, m long, v long",
    lambda t: _resampled(t).select("source_id", "channel", "first", F.posexplode("v").alias("i", "v")).withColumn("m", F.col("first") + F.col("i")),
    f"select * from {_OUTPUTS}",
)
case(
    "audio_pcm",
    "source_id long, bytes long, digest string",
    # a source's blocks one behind another
    lambda t: a.interleave(_resampled(t)).groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", F.hex("pcm").alias("pcm")))).getField("pcm"), "").alias("pcm")).select("source_id", (F.length("pcm") / 2).alias("bytes"), F.md5(F.unhex("pcm")).alias("digest")),
    f"""select source_id, count(*) * 4 as bytes, md5(unhex(string_agg(printf('%02x%02x%02x%02x', u % 256, u // 256 % 256, u // 65536 % 256, u // 16777216), '' order by m, channel))) as digest
        from (select *, greatest(-2147483648, least(2147483647, v)) + if(v < 0, 4294967296, 0) as u from {_OUTPUTS}) group by source_id""",
)
