"""Voice profiles and clustering over the given embeddings."""

from pyspark.sql import functions as F

from ..operators import voices as VO
from .registry import query

_U = """SELECT meeting_id, burst_idx, label, dur_s, least(dur_s, 8.0::DOUBLE) AS w, unnest(range(1, 65)) AS dim, unnest(e) / sqrt(list_inner_product(e, e)) AS x
    FROM (SELECT *, embedding::DOUBLE[] AS e FROM v_voices)"""
UNITS = {"v_units": _U}


@query("ag12_recording_mean", "SELECT meeting_id, dim - 1 AS dim, round(sum(x * w) / sum(w), 6) AS mean FROM v_units WHERE dur_s >= 1 GROUP BY meeting_id, dim", UNITS)
def ag12(t):
    m = VO.recording_mean(t.voices)
    return m.select("meeting_id", F.posexplode("mean").alias("dim", "mean")).select(
        "meeting_id", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("ag13_voice_profiles", """SELECT meeting_id, label, dim - 1 AS dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY meeting_id, label)), 6) AS profile FROM
    (SELECT meeting_id, label, dim, sum(x * w) AS s FROM v_units GROUP BY meeting_id, label, dim)""", UNITS)
def ag13(t):
    from ..functions import vectors

    rows = t.voices.withColumn("raw", vectors.unit(F.col("embedding")))
    p = VO.profiles(rows, "label", "raw")
    return p.select("meeting_id", "label", F.posexplode("profile").alias("dim", "profile")).select(
        "meeting_id", "label", F.col("dim").cast("long").alias("dim"), F.round("profile", 6).alias("profile"))


@query("ag14_separation", """SELECT p.meeting_id, p.a, p.b, round(((wa + wb) / 2 - across) / greatest(1 - across, 1e-6), 6) AS separation FROM
    (SELECT x.meeting_id, x.label AS a, y.label AS b, avg(c) AS across FROM v_sim s JOIN v_voices x ON x.burst_idx = s.i JOIN v_voices y ON y.burst_idx = s.j
     WHERE x.label < y.label AND x.meeting_id = y.meeting_id GROUP BY ALL) p
    JOIN (SELECT x.meeting_id, x.label, avg(c) AS wa FROM v_sim s JOIN v_voices x ON x.burst_idx = s.i JOIN v_voices y ON y.burst_idx = s.j
     WHERE x.label = y.label AND s.i < s.j AND x.meeting_id = y.meeting_id GROUP BY ALL) m ON m.meeting_id = p.meeting_id AND m.label = p.a
    JOIN (SELECT x.meeting_id, x.label, avg(c) AS wb FROM v_sim s JOIN v_voices x ON x.burst_idx = s.i JOIN v_voices y ON y.burst_idx = s.j
     WHERE x.label = y.label AND s.i < s.j AND x.meeting_id = y.meeting_id GROUP BY ALL) n ON n.meeting_id = p.meeting_id AND n.label = p.b""",
       {"v_sim": "SELECT x.burst_idx AS i, y.burst_idx AS j, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM v_voices x JOIN v_voices y USING (meeting_id)"})
def ag14(t):
    return VO.separation(VO.group_sums(t.voices, "label"), "label").withColumn("separation", F.round("separation", 6))


@query("ag15_smallest_cluster", """SELECT meeting_id, arg_min(label, (s, label)) AS label, round(min(s), 6) AS speech_s, min(s) < least(3, greatest(0.5, sum(s) * 0.08)) AS too_small
    FROM (SELECT meeting_id, label, sum(dur_s) AS s FROM v_voices GROUP BY ALL) GROUP BY meeting_id""")
def ag15(t):
    return VO.smallest_cluster(t.voices, "label").select("meeting_id", "label", F.round("speech_s", 6).alias("speech_s"), "too_small")


@query("jb15_cluster_voices")
def jb15(t):
    return VO.cluster_voices(t.voices)
