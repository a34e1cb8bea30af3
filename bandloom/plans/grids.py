"""Queries on grids, tracks and series: parts play directions and frequencies, events altitude series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import freq, grids, matrices, order, stats
from ..sources import sinks, tables
from .registry import query, table

#: A grid of 7 x 24 cells whose values are means of parts.
_GRID = "g as (select (p_partkey % 7)::int ti, ((p_partkey // 7) % 24)::int pi, avg(p_retailprice) / 100 v from part group by all)"


def _grid(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").groupBy((k % 7).cast("int").alias("ti"), (F.floor(k / 7) % 24).cast("int").alias("pi")).agg((F.avg("p_retailprice") / 100).alias("v"))


@query(f"""with {_GRID}, p as (select c_custkey, (c_custkey * 7 % 900) / 10.0::double th, (c_custkey * 13 % 3600) / 10.0::double ph from customer),
c as (select *, least(floor(th / 15), 5)::int ti, floor(ph / 15)::int % 24 pj, th / 15 - least(floor(th / 15), 5) a, ph / 15 - floor(ph / 15) b from p),
w as (select c_custkey, ti + i tt, (pj + j) % 24 pp, case when i = 1 then a else 1 - a end * case when j = 1 then b else 1 - b end w from c, range(2) x(i), range(2) y(j))
select c_custkey, round(sum(w * v), 6) v from w join g on g.ti = tt and g.pi = pp group by 1""")
def bilinear_sampling(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", ((k * 7 % 900) / 10.0).alias("theta_deg"), ((k * 13 % 3600) / 10.0).alias("phi_deg"))
    got = grids.bilinear(points, _grid(spark, sf_dir), 0.0, 15.0, 7, 15.0, ["v"])
    return got.select("c_custkey", F.round("v", 6).alias("v"))


@query("""with g as (select pow(p_partkey % 7, 2) * 2.5 th, pow((p_partkey // 7) % 19, 2)::double ph, avg(p_retailprice) / 100 v from part group by all),
p as (select l_orderkey, l_linenumber, l_quantity * 2.0 th, ((floor(l_extendedprice)::bigint * 13) % 3600) / 10.0::double ph from lineitem),
t as (select a.th t0, b.th t1 from (select th, lead(th) over (order by th) nx from (select distinct th from g)) a join (select distinct th from g) b on b.th = a.nx),
f as (select p0, case when nx is null then 0 else nx end p1, coalesce(nx, 360) hi from (select ph p0, lead(ph) over (order by ph) nx from (select distinct ph from g))),
c as (select q.*, t0, t1, p0, p1, (th - t0) / (t1 - t0) a, (ph - p0) / (hi - p0) b from (select distinct th, ph from p) q join t on th >= t0 and (th < t1 or (th = t1 and t1 = 90)) join f on ph >= p0 and ph < hi),
w as (select c.th, c.ph, (1 - a) * (1 - b) * x00.v + (1 - a) * b * x01.v + a * (1 - b) * x10.v + a * b * x11.v v from c join g x00 on x00.th = t0 and x00.ph = p0 join g x01 on x01.th = t0 and x01.ph = p1 join g x10 on x10.th = t1 and x10.ph = p0 join g x11 on x11.th = t1 and x11.ph = p1)
select l_orderkey, l_linenumber, round(w.v, 6) v from p left join w using (th, ph)""")
def irregular_sampling(spark, sf_dir):
    """Line items as places on a grid whose axes are squares, phi closing the circle; some lie beyond theta's last."""
    k = F.col("p_partkey")
    grid = table(spark, sf_dir, "part").groupBy((F.pow(k % 7, F.lit(2)) * 2.5).alias("theta_deg"), F.pow(F.floor(k / 7) % 19, F.lit(2)).alias("phi_deg")).agg((F.avg("p_retailprice") / 100).alias("v"))
    phi = (F.floor("l_extendedprice") * 13 % 3600) / 10.0
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2.0).alias("theta_deg"), phi.alias("phi_deg"))
    return grids.bilinear_axes(points, grid, ["v"]).select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"))


@query("""with t as (select user_id, event_id t, (value - 50) / 100 alt, (event_id * 37 % 360) * pi() / 180 az from events), f as (select *, alt > 0 up, max(t) over (partition by user_id) last from t),
r as (select *, sum(case when up and not coalesce(was, false) then 1 else 0 end) over (partition by user_id order by t) k from (select *, lag(up) over (partition by user_id order by t) was from f)),
p as (select user_id, k, max(t) e from r where up group by user_id, k, last having max(t) < last)
select distinct r.user_id, floor(sin(alt) * 10)::int mu_bin, floor(az / (2 * pi()) * 10)::int phi_bin from r join p on r.user_id = p.user_id and r.k = p.k where up and t < e""")
def track_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("t"), ((F.col("value") - 50) / 100).alias("alt"), F.radians((F.col("event_id") * 37 % 360).cast("double")).alias("az"))
    return grids.coverage(e, order.passes(e, ["user_id"], "t", F.col("alt") > 0), ["user_id"])


@query("""with e as (select user_id, event_id, value v, max(value) over (partition by user_id) top from events), w as (select *, lag(v) over o p, lead(v) over o n from e window o as (partition by user_id order by event_id)),
p as (select user_id, event_id, v, top from w where v > p and v > n),
l as (select p.user_id, p.event_id, p.v, p.top, max(x.event_id) filter (x.v > p.v and x.event_id < p.event_id) lb, min(x.event_id) filter (x.v > p.v and x.event_id > p.event_id) rb from p join e x using (user_id) group by all),
m as (select l.user_id, l.event_id, l.v, l.top, min(x.v) filter (x.event_id <= l.event_id and x.event_id >= coalesce(lb, -1)) le, min(x.v) filter (x.event_id >= l.event_id and x.event_id <= coalesce(rb, 1000000000)) ri from l join e x using (user_id) group by all)
select user_id, event_id, round((v - greatest(le, ri)) / top, 6) prominence from m where (v - greatest(le, ri)) / top >= 0.01""")
def prominent_peaks(spark, sf_dir):
    """Peaks of each user's values that stand out by a hundredth of their maximum."""
    got = grids.prominent_peaks(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 0.01)
    return got.select("user_id", "event_id", F.round("prominence", 6).alias("prominence"))


@query("""with e as (select event_id, value v, max(value) over () top from events), w as (select *, lag(v) over (order by event_id) p, lead(v) over (order by event_id) n from e),
p as (select * from w where v > p and v > n), l as (select p.event_id, p.v, p.top, max(x.event_id) filter (x.event_id < p.event_id) lb, min(x.event_id) filter (x.event_id > p.event_id) rb from p left join e x on x.v > p.v group by all),
m as (select l.event_id, l.v, l.top, min(x.v) filter (x.event_id <= l.event_id) le, min(x.v) filter (x.event_id >= l.event_id) ri from l join e x on x.event_id between coalesce(lb, -1) and coalesce(rb, 1000000000) group by all)
select event_id, round((v - greatest(le, ri)) / top, 6) prominence from m where (v - greatest(le, ri)) / top >= 0.2""")
def peaks_of_one_series(spark, sf_dir):
    """All values as one series, cut into buckets of two hundred."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.floor(F.col("event_id") / 200).alias("part"))
    got = grids.prominent_peaks(e, [], "event_id", "value", 0.2, bucket="part")
    return got.select("event_id", F.round("prominence", 6).alias("prominence"))



@query("""with c as (select c_custkey, radians(c_custkey % 90) alt, radians(c_custkey * 7 % 360) az from customer) select c_custkey, round(sin(az) * (1 - alt / (pi() / 2)), 6) + 0.0 x, round(cos(az) * (1 - alt / (pi() / 2)), 6) + 0.0 y, round(sin(az) * cos(alt), 6) + 0.0 ox, round(cos(az) * cos(alt), 6) + 0.0 oy from c""")
def plane_projection(spark, sf_dir):
    k = F.col("c_custkey")
    alt, az = F.radians((k % 90).cast("double")), F.radians((k * 7 % 360).cast("double"))
    (x, y), (ox, oy) = grids.plane(alt, az), grids.plane(alt, az, linear=False)
    return table(spark, sf_dir, "customer").select("c_custkey", *[(F.round(c, 6) + 0.0).alias(n) for n, c in (("x", x), ("y", y), ("ox", ox), ("oy", oy))])


@query("""with f as (select p_partkey, p_size * 2 * pi() * 1e6 w, p_size f, p_retailprice / 20 zre from part), k as (select *, w * (1e5 * 35e-12) k from f), z as (select *, 50 + 1e5 / (1 + k * k) re, w * 5e-9 - 1e5 * k / (1 + k * k) im, -1 / (w * 35e-12) cap from k)
select p_partkey, round(re, 6) re, round(im, 5) im, round(cap, 5) cap, round(sqrt(re * re + im * im) / sqrt((zre + re) ** 2 + (im - 40) ** 2), 6) gamma from z""")
def load_impedance(spark, sf_dir):
    f = F.col("p_size").cast("double")
    re, im = grids.preamp_load(f, 35.0, 5.0, 1e5, 50.0)
    _, cap = grids.capacitor_load(f, 35.0)
    gamma = grids.coupling(re, im, F.col("p_retailprice") / 20, F.lit(-40.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(re, 6).alias("re"), F.round(im, 5).alias("im"), F.round(cap, 5).alias("cap"), F.round(gamma, 6).alias("gamma"))


@query("""with v as (select vec_id, k::int k, [embedding[3 * k + 1], embedding[3 * k + 2], embedding[3 * k + 3]] e, radians((vec_id + k) % 90) th, radians((vec_id + k) % 360) ph from embeddings, range(21) r(k))
select vec_id, k, round(e[1]::double * cos(th) * cos(ph) + e[2]::double * cos(th) * sin(ph) - e[3]::double * sin(th), 6) e_theta, round(-e[1]::double * sin(ph) + e[2]::double * cos(ph), 6) e_phi from v""")
def spherical_parts(spark, sf_dir):
    """Triples of a vector's components as fields in directions of their own."""
    fields = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    x = [F.get("embedding", F.col("k") * 3 + i).cast("double") for i in range(3)]
    th, ph = (F.radians(((F.col("vec_id") + F.col("k")) % n).cast("double")) for n in (90, 360))
    a, b = grids.spherical_parts(*x, th, ph)
    return fields.select("vec_id", "k", F.round(a, 6).alias("e_theta"), F.round(b, 6).alias("e_phi"))


@query("""select l_orderkey, l_linenumber, round(l_extendedprice * 1e-3 / sqrt(2.0), 9) rms, (l_suppkey % 96 + 32) % 64 zoom from lineitem""")
def phasors_and_zoom(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(grids.to_si_rms(F.col("l_extendedprice"), "mV", "peak"), 9).alias("rms"), grids.zoom_bin(F.col("l_suppkey") % 96 - 32).alias("zoom"))


@query("""with g as (select p_size f, p_partkey % 13 * 15.0 th, p_partkey % 4 * 90.0 ph, p_retailprice r from part) select count(*) filter (th <= 90) points, count(distinct f) n_freq, count(distinct th) filter (th <= 90) n_theta, count(distinct ph) n_phi, round(max(r) filter (th > 90), 6) below from g""")
def grid_checks(spark, sf_dir):
    k, r = F.col("p_partkey"), F.col("p_retailprice")
    g = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("freq_mhz"), (k % 13 * 15.0).alias("theta_deg"), (k % 4 * 90.0).alias("phi_deg"), r.alias("theta_re"), F.lit(0.0).alias("theta_im"), F.lit(0.0).alias("phi_re"), F.lit(0.0).alias("phi_im"))
    return tables.grid_report(g).select("points", "n_freq", "n_theta", "n_phi", F.round("below", 6).alias("below"))


@query("""select user_id session_id, event_id unique_packet_id, value raw_seconds, coalesce((json_extract_string(props, '$.k'))::double, 0) as time from events where event_type = 'click'""")
def housekeeping(spark, sf_dir):
    fields = F.map_filter(F.from_json("props", "map<string,double>"), lambda k, v: k.isNotNull())
    fields = F.transform_keys(fields, lambda k, v: F.when(k == "k", "time").otherwise(k))
    hk = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("unique_packet_id"), F.lit(1).alias("version"), F.lit(0).alias("errors"), F.col("value").alias("raw_seconds"), F.when(F.col("event_type") == "click", 0).otherwise(100).alias("type"), fields.alias("fields"))
    return sinks.housekeeping_table(hk, 0).select("session_id", "unique_packet_id", "raw_seconds", "time")


@query("""with f as (select event_type, row_number() over (order by min({'u': user_id, 'e': event_id}))::int place from events group by 1)
select user_id session_id, event_id unique_packet_id, place, event_type channel, value from events join f using (event_type)""")
def housekeeping_channels(spark, sf_dir):
    """Dynamic channels found in all rows, as columns in the order in which they were first seen."""
    fields = F.create_map(F.concat(F.lit("telemetry_"), "event_type"), "value", F.lit("ok"), F.lit(1.0))
    hk = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("unique_packet_id"), F.lit(1).alias("version"), F.lit(0).alias("errors"), F.col("event_id").alias("raw_seconds"), F.lit(2).alias("type"), fields.alias("fields"))
    names = sinks.telemetry_channels(hk)
    long = sinks.housekeeping_table(hk, 2, names).unpivot(["session_id", "unique_packet_id"], names, "name", "value").filter("value is not null")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name")).cast("int")
    return long.select("session_id", "unique_packet_id", place.alias("place"), F.substring_index("name", "_", -1).alias("channel"), "value")


@query("""with a as (select vec_id, generate_subscripts(embedding, 1) - 1 ch, unnest(embedding)::double v, label from embeddings) select label, ch::int ch, round(min(v), 6) lo, round(max(v), 6) hi, round(avg(v), 6) mean, round(sqrt(avg(v * v)), 6) rms from a group by all""")
def adc_stats(spark, sf_dir):
    got = stats.channel_stats(table(spark, sf_dir, "embeddings"), ["label"], "embedding", "ch")
    return got.select("label", "ch", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean", "rms")])


@query("""with p as (select p_partkey, p_size * 1.0 x, p_retailprice % 40 y from part), c as (select i * 2.0 x, (i % 7) * 0.01 - 0.02 y from range(26) r(i)),
m as (select p_partkey, 16.4 + (x - 20.0) * (14.0 / 10.0) z from p)
select p_partkey, round(case when z < 0 or z > 50 then 0 else (a.y + (b.y - a.y) * (z - a.x) / 2.0) * 2 end, 9) + 0.0 signal from m left join c a on a.x = least(floor(z / 2.0) * 2, 48) left join c b on b.x = a.x + 2""")
def rescaled_signal(spark, sf_dir):
    """A tabulated trough moved to 20 MHz, made narrower and twice as deep."""
    curve = spark.range(26).select((F.col("id") * 2.0).alias("x"), ((F.col("id") % 7) * 0.01 - 0.02).alias("y"))
    got = freq.rescaled_curve(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x")), curve, "x", place=20.0, width=10.0, depth=0.08)
    return got.select("p_partkey", (F.round("signal", 9) + 0.0).alias("signal"))


@query("select p_partkey, round(case when p_size < 10 then 3.0 * pow(p_size / 10.0, ln(1.5 / 3.0) / ln(20.0 / 10.0)) else p_retailprice end, 6) z from part")
def power_law_extension(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return freq.power_law_below(p, "p_size", "p_retailprice", (10.0, 3.0), (20.0, 1.5), "z").select("p_partkey", F.round("z", 6).alias("z"))


@query("select p_partkey, round(1 - pow(atan((radians(p_size * 3.6) - pi() / 2) / 0.2) / pi() + 0.5, 2), 6) taper, round(exp(-(pow(p_size - 25, 2) + pow(p_retailprice % 50 - 20, 2)) / (2 * 100.0)), 9) beam, round(4 * 1.380649e-23 * p_retailprice * pow(p_size / 50.0, 2) * 1e21, 6) v2 from part")
def beam_shapes(spark, sf_dir):
    """Horizon taper, Gaussian beam, and temperature to squared voltage."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    return p.select("p_partkey", F.round(matrices.horizon_taper(F.radians(size * 3.6), 0.2), 6).alias("taper"), F.round(matrices.gaussian_beam(size, F.col("p_retailprice") % 50, 25.0, 20.0, 10.0), 9).alias("beam"), F.round(grids.temperature_to_v2(F.col("p_retailprice"), size / 50.0) * 1e21, 6).alias("v2"))


@query("""with g as (select p_partkey % 3 freq, p_partkey % 4 port, (p_partkey * 30 % 360) * 1.0 phi, p_retailprice v from part) select freq, ((phi - 90 * port + 360) % 360)::double phi_deg, round(avg(v), 6) v from g group by all""")
def four_ports(spark, sf_dir):
    """Mean over four ports, each turned back by its quarter turns."""
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select((k % 3).alias("freq"), (k % 4).alias("port"), (k * 30 % 360).cast("double").alias("phi_deg"), F.col("p_retailprice").alias("v"))
    return matrices.c4_mean(g, ["freq"], ["v"]).select("freq", "phi_deg", F.round("v", 6).alias("v"))


@query("""with f as (select l_orderkey, l_linenumber, l_suppkey % 4 port, l_quantity freq, l_extendedprice * 1e-3 / sqrt(2.0) re, l_tax * 1e-3 / sqrt(2.0) im from lineitem), c as (select *, (1.0 + port) ir, 0.5 ii from f),
q as (select *, (re * ir + im * ii) / (ir * ir + ii * ii) qr, (im * ir - re * ii) / (ir * ir + ii * ii) qi, 4 * pi() / ((2 * pi() * freq * 1e6 / 299792458.0::double) * 376.730313668::double) s from c)
select l_orderkey, l_linenumber, round(-qi * s, 6) + 0.0 h_re, round(qr * s, 6) + 0.0 h_im from q""")
def effective_lengths(spark, sf_dir):
    """Far fields in millivolts, peak, to effective lengths by their port's current."""
    li = table(spark, sf_dir, "lineitem")
    rms = lambda c: grids.to_si_rms(F.col(c), "mV", "peak")
    fields = li.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 4).alias("port"), F.col("l_quantity").alias("freq"), rms("l_extendedprice").alias("e_re"), rms("l_tax").alias("e_im"))
    currents = spark.range(4).select(F.col("id").alias("port"), (F.col("id") + 1.0).alias("i_re"), F.lit(0.5).alias("i_im"))
    got = grids.per_current(fields, currents, ["port"], ["e"])
    h_re, h_im = grids.effective_length(F.col("e_re"), F.col("e_im"), F.col("freq"))
    return got.select("l_orderkey", "l_linenumber", (F.round(h_re, 6) + 0.0).alias("h_re"), (F.round(h_im, 6) + 0.0).alias("h_im"))
