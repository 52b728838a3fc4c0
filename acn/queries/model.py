"""Queries of ordered operators, model expressions, fits, calls and figure tables; registered beside those of core."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import stats
from ..operators import aggregates, calls, fit, intervals, loci, phasing, pseudonormal, regression, segmentation, tables, windows
from ..plans import lifecycle
from ..sources import sinks
from ..storage import materialise, new_path
from .core import _JOINED, _TOTAL, query, r6, rounded

# --- windows ------------------------------------------------------------------------------------------------------------------

_W = "over (partition by sample_id, chrom order by pos)"


@query("inter_het_distance", "v_tracks",
    f"select sample_id, chrom, pos, gap, round(gap / max(gap) over (partition by sample_id, chrom), 6) as scaled_gap from (select sample_id, chrom, pos, coalesce(lead(pos) "
    f"{_W} - pos, pos - lag(pos) {_W}) as gap from v_tracks) t")
def _(spark, t):
    return rounded(windows.inter_het_distance(t).select("sample_id", "chrom", "pos", "gap", "scaled_gap"), "scaled_gap")


_SPLIT = (
    f"(select sample_id, chrom, pos, cast(sum(far) over (partition by sample_id, chrom order by pos rows unbounded preceding) as bigint) as piece from (select *, "
    f"coalesce(cast(pos - lag(pos) {_W} >= 150000 as int), 0) as far from v_tracks) t) s"
)


@query("big_gap_split", "v_tracks", f"select * from {_SPLIT}")
def _(spark, t):
    return windows.big_gap_split(t, 150_000).select("sample_id", "chrom", "pos", "piece")


@query("presegment", "v_tracks v_breakpoints", f"select s.sample_id, s.chrom, s.pos, s.piece + (select count(*) from v_breakpoints b where b.chrom = s.chrom and b.pos < s.pos) as piece from {_SPLIT}")
def _(spark, t, b):
    return windows.presegment(t, b, 150_000).select("sample_id", "chrom", "pos", "piece")


@query("genome_chunks", "v_tracks")
def _(spark, t):
    return windows.genome_chunks(t, 150_000, 20)


def _median_sql(source, value, k, out="running_median"):
    """source (sample_id, chrom, pos, ...) with the running median of k values and Tukey's ends."""
    wing = k // 2
    middle = f"""(select *, case when n < 3 or half < 1 then {value} else list_aggregate(list_slice(span, cast(place - h as bigint), cast(place + h as bigint)), 'median') end as m from (
      select *, least(i, {wing + 1}) as place, least(half, i - 1, n - i) as h from (select *, row_number() over w as i, count(*) over (partition by sample_id, chrom) as n,
      list({value}) over (partition by sample_id, chrom order by pos rows between {wing} preceding and {wing} following) as span from {source} src window w as (partition by sample_id, chrom order by pos)) a
      cross join lateral (select least({wing}, (case when n % 2 = 1 then n else n - 1 end - 1) // 2) as half) b) c) d"""
    lagged = f"(select *, lead(m, 1) {_W} as m1, lead(m, 2) {_W} as m2, lag(m, 1) {_W} as b1, lag(m, 2) {_W} as b2 from {middle}) e"
    return f"""(select * exclude (span, m, m1, m2, b1, b2, place, h, half), case when n < 3 or half < 1 then {value} when i = 1 then list_aggregate([{value}, m1, 3 * m1 - 2 * m2], 'median')
      when i = n then list_aggregate([{value}, b1, 3 * b1 - 2 * b2], 'median') else m end as {out} from {lagged}) rm"""


_MEDIAN = _median_sql("v_tracks", "logr", 21)


@query("running_median", "v_tracks", f"select sample_id, chrom, pos, round(running_median, 6) as running_median from {_MEDIAN}")
def _(spark, t):
    return rounded(windows.running_median(t, "logr", 21).select("sample_id", "chrom", "pos", "running_median"), "running_median")


@query("mad_sd", "v_tracks",
    f"select sample_id, chrom, round(1.4826 * median(abs(d - c)), 6) as sd from (select *, median(d) over (partition by sample_id, chrom) as c from (select *, logr - "
    f"running_median as d from {_median_sql('(select * from v_tracks where logr <> 0)', 'logr', 21)}) x) y group by sample_id, chrom")
def _(spark, t):
    return rounded(windows.mad_sd(t, "logr", 10), "sd")


@query("winsorise", "v_tracks",
    f"select sample_id, chrom, pos, round(least(greatest(logr, running_median - s), running_median + s), 6) as winsorised from (select *, 2.5 * 1.4826 * median(abs(logr - "
    f"running_median)) over (partition by sample_id, chrom) as s from {_MEDIAN}) x")
def _(spark, t):
    return rounded(windows.winsorise(t, "logr", 10).select("sample_id", "chrom", "pos", "winsorised"), "winsorised")


_LAGS = "(select range as lag from range(1, 101)) l"
_SWITCH = (
    f"(select p.sample_id, p.chrom, p.pos, l.lag, abs(p.bit - q.bit) as switch, case when p.open_after - q.open_before = 0 and p.ps = q.ps then 1.0 else 0.25 end as e from "
    f"numbered p cross join {_LAGS} join numbered q on q.sample_id = p.sample_id and q.chrom = p.chrom and q.i = p.i - l.lag) s"
)
_NUMBERED = (
    "numbered as (select *, row_number() over w as i, sum(case when phased then 0 else 1 end) over (partition by sample_id, chrom order by pos rows unbounded preceding) "
    "as open_after, sum(case when phased then 0 else 1 end) over (partition by sample_id, chrom order by pos rows unbounded preceding) - case when phased then 0 else 1 "
    "end as open_before from v_phased window w as (partition by sample_id, chrom order by pos))"
)


@query("phase_switches", "v_phased", f"select sample_id, chrom, pos, lag, switch from {_SWITCH}", _NUMBERED)
def _(spark, p):
    return windows.phase_switches(p, 100)


@query("phase_evidence", "v_phased", f"select sample_id, chrom, pos, lag, round(e / sum(e) over (partition by chrom, pos, lag), 6) as evidence from {_SWITCH}", _NUMBERED)
def _(spark, p):
    return rounded(windows.phase_evidence(p, 100), "evidence")


_SETS = (
    "sets as (select sample_id, chrom, pos, min(pos) over (partition by sample_id, chrom, run) as ps from (select *, sum(case when prev is null or prev <> baf_seg then 1 "
    "else 0 end) over (partition by sample_id, chrom order by pos rows unbounded preceding) as run from (select *, lag(baf_seg) over (partition by sample_id, chrom order "
    "by pos) as prev from v_baf_segmented where greatest(baf_seg, 1 - baf_seg) > 0.6) a) b)"
)
_PS = (
    "(select v.sample_id, v.chrom, v.pos, v.baf_seg, coalesce(case when b.pos is null or (a.pos is not null and a.pos - v.pos < v.pos - b.pos) then a.ps else b.ps end, "
    "min(v.pos) over (partition by v.sample_id, v.chrom)) as ps from v_baf_segmented v asof left join sets b on v.sample_id = b.sample_id and v.chrom = b.chrom and v.pos "
    ">= b.pos asof left join sets a on v.sample_id = a.sample_id and v.chrom = a.chrom and v.pos <= a.pos) z"
)


@query("phase_set_ids", "v_baf_segmented", f"select chrom, pos, ps from {_PS}", _SETS)
def _(spark, s):
    return windows.phase_set_ids(s.select("sample_id", "chrom", "pos", "baf_seg"), 0.6).select("chrom", "pos", "ps")


_TOP = (
    "(select *, row_number() over (partition by sample_id order by end_pos - start_pos desc, chrom, start_pos) as rank from v_profile where frac1 = 1 and not (nMaj1 = 1 "
    "and nMin1 = 1) and end_pos - start_pos > 2000000) t"
)


@query("top_segments", "v_profile", f"select sample_id, chrom, start_pos, end_pos, rank from {_TOP} where rank <= 5")
def _(spark, p):
    return windows.top_segments(p).select("sample_id", "chrom", "start_pos", "end_pos", "rank")


_RHO = "((2 * baf - 1) / nullif(2 * baf - baf * ({M} + {m}) - 1 + {M}, 0))"


def _refit(maj, mnr):
    rho = _RHO.replace("{M}", maj).replace("{m}", mnr)
    psi = f"(({rho} * ({maj} + {mnr}) + 2 - 2 * {rho}) / pow(2, logr))"
    return rho, psi, f"(({psi} - 2 * (1 - {rho})) / nullif({rho}, 0))"


_R, _P, _T = _refit("nMaj1", "nMin1")


_CHOSEN = """(select *, row_number() over (partition by sample_id order by end_pos - start_pos desc, chrom, start_pos) as rank from v_profile where nMaj1 <> nMin1 and not (frac1 < 1)) t
  where rank <= 5 and sample_id in (select sample_id from v_profile where nMaj1 <> nMin1 and end_pos - start_pos > 2000000)"""


@query("refit_suggestions", "v_profile v_fit", f"""
  select sample_id, rank, chrom, ceil((start_pos + (end_pos - start_pos) / 2) / 1e6) as pos_mb, nMaj1, nMin1, round({_R}, 6) as rho, round({_T}, 6) as psi_t,
    round(abs(0.73::double - {_R}), 6) as rho_diff, round(abs(2.15::double - {_T}), 6) as psi_t_diff, false as outside_purity from {_CHOSEN}""")
def _(spark, p, f):
    found = windows.refit_suggestions(p, f.select("sample_id", "rho", F.col("psi").alias("psi_t"))).drop("baf", "logr")
    return rounded(found, "rho", "psi_t", "rho_diff", "psi_t_diff")


_R3, _P3, _T3 = _refit("3.0", "1.0")


@query("suggest_refit", "v_profile",
    f"select sample_id, chrom, start_pos, end_pos, round({_R3}, 6) as rho, round({_P3}, 6) as psi, round({_T3}, 6) as psi_t from v_profile where chrom = '7' and start_pos "
    f"<= 20000000 and end_pos >= 20000000")
def _(spark, p):
    return rounded(calls.suggest_refit(p, "7", 20_000_000, 3, 1), "rho", "psi", "psi_t")


@query("thin_rows", "v_tracks", "select sample_id, chrom, pos from (select *, row_number() over (partition by sample_id, chrom order by pos) as n from v_tracks) t where n % 100 = 1")
def _(spark, t):
    return windows.thin_rows(t).select("sample_id", "chrom", "pos")


_XSEG = "(select sample_id, chrom, case when start_pos < 20000000 then 'p' else 'q' end as arm, start_pos, end_pos, n, logr, cast(1 + n % 2 as double) as cn from v_segments) x"


@query("adjacent_equal_merge_x", "v_segments",
    f"select sample_id, chrom, arm, min(start_pos) as start_pos, max(end_pos) as end_pos, cast(sum(n) as bigint) as n, round(sum(logr * n) / sum(n), 6) as logr, "
    f"round(sum(cn * n) / sum(n), 6) as cn from (select *, sum(new) over (partition by sample_id, chrom, arm order by start_pos rows unbounded preceding) as run from "
    f"(select *, coalesce(cast(abs(cn - lag(cn) over (partition by sample_id, chrom, arm order by start_pos)) > 0.01 as int), 0) as new from {_XSEG}) a) b group by "
    f"sample_id, chrom, arm, run")
def _(spark, s):
    segs = s.select("sample_id", "chrom", F.when(F.col("start_pos") < 20_000_000, "p").otherwise("q").alias("arm"), "start_pos", "end_pos", "n", "logr",
        (1 + F.col("n") % 2).cast("double").alias("cn"))
    return rounded(windows.adjacent_equal_merge_x(segs), "logr", "cn")


# --- sorts and sets -----------------------------------------------------------------------------------------------------------


@query("genome_order", "v_track", "select chrom, pos from v_track order by cast(chrom as int), pos")
def _(spark, t):
    return loci.genome_order(t).select("chrom", "pos")


@query("best_by_score", "v_segments", "select sample_id, min(logr) as score from v_segments group by sample_id")
def _(spark, s):
    scored = s.select("sample_id", F.col("logr").alias("score"), F.col("start_pos").alias("i"), F.col("chrom").cast("int").alias("j"))
    return aggregates.best_by_score(scored).select("sample_id", "score")


_END = "regexp_extract(alt, '[\\[\\]](?:chr)?([^:\\[\\]]+):([0-9]+)[\\[\\]]', {})"


@query("sv_end_from_alt", "v_svs", f"select chrom, pos, {_END.format(1)} as end_chrom, cast({_END.format(2)} as bigint) as end_pos from v_svs")
def _(spark, s):
    c, p = sc.sv_end_from_alt("alt")
    return s.select("chrom", "pos", c.alias("end_chrom"), p.alias("end_pos"))


@query("sv_end_from_info", "v_svs", "select chrom, pos, regexp_extract(info, 'CHR2=([^;]+)', 1) as end_chrom, cast(regexp_extract(info, 'END=([0-9]+)', 1) as bigint) as end_pos from v_svs")
def _(spark, s):
    c, p = sc.sv_end_from_info("info")
    return s.select("chrom", "pos", c.alias("end_chrom"), p.alias("end_pos"))


@query("sv_support_filter", "v_svs", "select chrom, pos from v_svs where info like '%TRDS=r%'")
def _(spark, s):
    return loci.sv_support_filter(s).select("chrom", "pos")


@query("union_breakpoints", "v_svs", f"select chrom, pos from v_svs union select {_END.format(1)}, cast({_END.format(2)} as bigint) from v_svs")
def _(spark, s):
    return loci.union_breakpoints(s)


@query("replace_chrom_rows", "v_profile", "select chrom, start_pos, nMaj1, nMaj2 from v_profile where chrom <> '22' union all select '22', start_pos, 9.0, null from v_profile where chrom = '21'")
def _(spark, p):
    new = p.filter("chrom = '21'").select("sample_id", F.lit("22").alias("chrom"), "start_pos", F.lit(9.0).alias("nMaj1"))
    return loci.replace_chrom_rows(p, new, "22").select("chrom", "start_pos", "nMaj1", "nMaj2")


@query("count_reconciliation", "v_counts v_alleles",
    "select sample_id, chrom, pos, 'missing' as fault from v_counts c where not exists (select 1 from v_alleles a where a.chrom = c.chrom and a.pos = c.pos)")
def _(spark, c, a):
    return loci.count_reconciliation(loci.keep_listed_loci(c, a), c)


@query("rank_matching_x", "v_segments", "select chrom, start_pos, cast(greatest(ceil((pow(2, logr) - (1 - 0.73::double)) / 0.73::double) - 1, 1) + 1 as int) as cn from v_segments")
def _(spark, s):
    return calls.rank_matching_x(s.withColumn("purity", F.lit(0.73))).select("chrom", "start_pos", "cn")


# --- expressions --------------------------------------------------------------------------------------------------------------

_COPIES = "(pow(2, logr) * ((1 - 0.73::double) * 2 + 0.73::double * 2.15::double))"
_NA, _NB = f"((0.73::double - 1 - (baf - 1) * {_COPIES}) / 0.73::double)", f"((0.73::double - 1 + baf * {_COPIES}) / 0.73::double)"


@query("cn_alleles", "v_segments", f"select chrom, start_pos, round({_NA}, 6) as n_a, round({_NB}, 6) as n_b from v_segments")
def _(spark, s):
    a, b = sc.cn_alleles("baf", "logr", 0.73, 2.15)
    return s.select("chrom", "start_pos", r6(a).alias("n_a"), r6(b).alias("n_b"))


for _name, _f in (("cn_total", sc.cn_total), ("cn_total_major", sc.cn_total_major), ("cn_total_minor", sc.cn_total_minor)):
    _expr = {"cn_total": _TOTAL, "cn_total_major": "case when frac1 < 1 then nMaj1 * frac1 + nMaj2 * frac2 else nMaj1 end",
        "cn_total_minor": "case when frac1 < 1 then nMin1 * frac1 + nMin2 * frac2 else nMin1 end"}[_name]

    @query(_name, "v_profile", f"select chrom, start_pos, round({_expr}, 6) as v from v_profile")
    def _(spark, p, f=_f):
        return p.select("chrom", "start_pos", r6(f()).alias("v"))


@query("average_states", "v_profile",
    "select chrom, start_pos, round(case when frac1 < 1 then nMaj1 * frac1 + nMaj2 * frac2 else nMaj1 end, 6) as avg_major, round(case when frac1 < 1 then nMin1 * frac1 + "
    "nMin2 * frac2 else nMin1 end, 6) as avg_minor from v_profile")
def _(spark, p):
    return rounded(calls.average_states(p).select("chrom", "start_pos", "avg_major", "avg_minor"), "avg_major", "avg_minor")


@query("psi_conversions", "v_segments",
    "select chrom, start_pos, round(baf * 2.15::double + 2 * (1 - baf), 6) as psi, round((2.15::double - 2 * (1 - baf)) / baf, 6) as psi_t, round((2.15::double * pow(2, "
    "logr) - 2 * (1 - baf)) / baf, 6) as cn from v_segments")
def _(spark, s):
    return s.select("chrom", "start_pos", r6(sc.psi_from_psit("baf", 2.15)).alias("psi"), r6(sc.psit_from_psi("baf", 2.15)).alias("psi_t"), r6(sc.logr_to_cn("baf", 2.15, "logr")).alias("cn"))


def _level(maj, mnr, rho="0.73::double"):
    return f"(case when {maj} = 0 and {mnr} = 0 then 0.5 else (1 - {rho} + {rho} * {maj}) / (2 - 2 * {rho} + {rho} * ({maj} + {mnr})) end)"


@query("expected_levels", "v_profile",
    f"select chrom, start_pos, round({_level('nMaj1', 'nMin1')}, 6) as baf, round(log2((2 - 2 * 0.73::double + 0.73::double * (nMaj1 + nMin1)) / (2 - 2 * 0.73::double + "
    f"0.73::double * 2.15::double)), 6) as logr from v_profile")
def _(spark, p):
    return p.select("chrom", "start_pos", r6(sc.expected_baf(0.73, "nMaj1", "nMin1")).alias("baf"), r6(sc.expected_logr(0.73, 2.15, "nMaj1", "nMin1")).alias("logr"))


@query("rho_psi_from_segment", "v_profile", f"select chrom, start_pos, round({_R}, 6) as rho, round({_P}, 6) as psi, round({_T}, 6) as psi_t from v_profile")
def _(spark, p):
    r, s, t = sc.rho_psi_from_segment("baf", "logr", "nMaj1", "nMin1")
    return p.select("chrom", "start_pos", r6(r).alias("rho"), r6(s).alias("psi"), r6(t).alias("psi_t"))


@query("psi_t_from_cn", "v_profile",
    "select chrom, start_pos, round(((0.73::double * (nMaj1 + nMin1) + 2 - 2 * 0.73::double) / pow(2, logr) - 2 * (1 - 0.73::double)) / 0.73::double, 6) as psi_t from "
    "v_profile")
def _(spark, p):
    return p.select("chrom", "start_pos", r6(sc.psi_t_from_cn(F.col("nMaj1") + F.col("nMin1"), "logr", 0.73)).alias("psi_t"))


# the square of a segment: major x and minor y, rescued where the minor is negative
_AT = f"""sq as (select *, case when y0 < 0 then case when baf = 1 or x0 + baf * (0.01 - y0) / (1 - baf) < 0 then 1000.0 else x0 + baf * (0.01 - y0) / (1 - baf) end else x0 end as x, case when y0 < 0 then 0.01 else y0 end as y
  from (select *, greatest({_NA}, {_NB}) as x0, least({_NA}, {_NB}) as y0 from v_segments) a),
  lv as (select *, {_level('ceil(x)', 'ceil(y)')} as l2, {_level('floor(x)', 'floor(y)')} as l3, x + y < floor(x) + floor(y) + 1 as low from sq)"""


@query("rescue_negative_minor", "v_segments", "select chrom, start_pos, round(x, 6) as x, round(y, 6) as y from sq", _AT)
def _(spark, s):
    rows = _square(s)
    return rounded(rows.select("chrom", "start_pos", "x", "y"), "x", "y")


def _square(s):
    a, b = sc.cn_alleles("baf", "logr", 0.73, 2.15)
    x, y = sc.rescue_negative_minor(F.greatest(a, b), F.least(a, b), "baf")
    return s.withColumns({"x": x, "y": y})


_NEAREST = (
    "select chrom, start_pos, floor(x) + m1 as m1, floor(y) + n1 as n1, floor(x) + m2 as m2, floor(y) + n2 as n2 from (select *, case when baf > l3 then case when low "
    "then [0, 0, 1, 0] else [1, 0, 1, 1] end when baf > l2 then case when low then [0, 0, 0, 1] else [1, 0, 1, 1] end else case when low then [0, 0, 0, 1] else [0, 1, 1, "
    "1] end end as o, o[1] as m1, o[2] as n1, o[3] as m2, o[4] as n2 from lv) t"
)


@query("nearest_edge", "v_segments", _NEAREST, _AT)
def _(spark, s):
    return _square(s).withColumn("e", sc.nearest_edge(0.73, "baf", "x", "y")).select("chrom", "start_pos", "e.*")


def _edges_sql():
    def arr(rows):
        return "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in rows) + "]"

    def pick(case):
        return f"case when low then {arr(sc.EDGES[case, 'low'])} else {arr(sc.EDGES[case, 'high'])} end"

    return f"case when baf > l3 then {pick('above level 3')} when baf > l2 then {pick('above level 2')} else {pick('below')} end"


_EDGES = f"""opt as (select chrom, start_pos, baf, k, floor(x) + e[1] as m1, floor(y) + e[2] as n1, floor(x) + e[3] as m2, floor(y) + e[4] as n2 from (select *, unnest(es) as e, generate_subscripts(es, 1) - 1 as k from (select *, {_edges_sql()} as es from lv) a) b),
  good as (select *, least(m1, n1, m2, n2) >= 0 as ok from opt)"""


def _opened(s):
    rows = _square(s)
    up, down = (lambda c: F.ceil(c).cast("double")), (lambda c: F.floor(c).cast("double"))
    edges = sc.candidate_edges(sc.expected_baf(0.73, up("x"), up("y")), sc.expected_baf(0.73, down("x"), down("y")), "baf", F.col("x") + F.col("y"), down("y"), down("x"))
    return rows.select("chrom", "start_pos", "baf", F.posexplode(edges).alias("k", "e")).select("chrom", "start_pos", "baf", "k", "e.*")


@query("candidate_edges", "v_segments", "select chrom, start_pos, k, case when ok then m1 end as m1, case when ok then n1 end as n1, case when ok then m2 end as m2, case when ok then n2 end as n2 from good", f"{_AT}, {_EDGES}")
def _(spark, s):
    return _opened(s).drop("baf")


_TAU = (
    "(1 - 0.73::double + 0.73::double * m2 - 2 * baf * (1 - 0.73::double) - baf * 0.73::double * (n2 + m2)) / nullif(baf * 0.73::double * (n1 + m1) - baf * 0.73::double * "
    "(n2 + m2) - 0.73::double * m1 + 0.73::double * m2, 0)"
)


@query("two_state_fraction", "v_segments",
    f"select chrom, start_pos, k, round({_TAU}, 4) as tau from good where ok and abs(baf * 0.73 * (n1 + m1) - baf * 0.73 * (n2 + m2) - 0.73 * m1 + 0.73 * m2) > 1e-3", f"{_AT}, {_EDGES}")
def _(spark, s):
    rows = _opened(s).filter("m1 is not null and abs(baf * 0.73 * (n1 + m1) - baf * 0.73 * (n2 + m2) - 0.73 * m1 + 0.73 * m2) > 1e-3")
    return rows.select("chrom", "start_pos", "k", F.round(sc.two_state_fraction("baf", 0.73, "m1", "n1", "m2", "n2"), 4).alias("tau"))


@query("one_sample_t", "v_seg6", "select seg_id, round((m - 0.6::double) * sqrt(size) / nullif(sd, 0), 4) as t from (select *, mean as m from v_seg6) a")
def _(spark, s):
    return s.select("seg_id", F.round(sc.t_statistic("size", "mean", "sd", 0.6), 4).alias("t"))


def _t_tails(t, df):
    """Two-tailed p of Student's t for whole degrees of freedom: a finite series in the cosine of atan(t / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) / sqrt(pi()) * list_sum(list_transform(range(0, cast({df} as bigint) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) * pow(cos({angle}), 2 * j)))"
    odd = (
        f"coalesce(sin({angle}) * sqrt(pi()) / 2 * list_sum(list_transform(range(0, (cast({df} as bigint) - 1) // 2), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * "
        f"pow(cos({angle}), 2 * j + 1))), 0)"
    )
    return f"(1 - case when cast({df} as bigint) % 2 = 0 then {even} else 2 / pi() * ({angle} + {odd}) end)"


@query("one_sample_t_pvalue", "v_seg6", f"""
  select seg_id, abs(round(case when abs(mean - 0.6) < 0.01 then 1 when sd is null or sd = 0 then 0 when size > 1 then {_t_tails("(mean - 0.6::double) * sqrt(size) / sd", "(size - 1)")} end, 6)) as pval from v_seg6""")
def _(spark, s):
    return s.select("seg_id", r6(stats.one_sample_t("size", "mean", "sd", F.lit(0.6))).alias("pval"))


@query("welch_t", "v_seg6",
    "select seg_id, round((a.mean - nm) / sqrt(a.sd * a.sd / a.size + ns * ns / nn), 4) as t, round(pow(a.sd * a.sd / a.size + ns * ns / nn, 2) / (pow(a.sd * a.sd / "
    "a.size, 2) / (a.size - 1) + pow(ns * ns / nn, 2) / (nn - 1)), 4) as df from (select *, lead(mean) over w as nm, lead(sd) over w as ns, lead(size) over w as nn from "
    "v_seg6 window w as (partition by sample_id order by seg_id)) a where nn is not null")
def _(spark, s):
    w = windows.ordered(["sample_id"], "seg_id")
    rows = s.withColumns({"nm": F.lead("mean").over(w), "ns": F.lead("sd").over(w), "nn": F.lead("size").over(w)}).filter("nn is not null")
    t, df = sc.welch_statistic("size", "mean", "sd", "nn", "nm", "ns")
    return rows.select("seg_id", F.round(t, 4).alias("t"), F.round(df, 4).alias("df"))


def _log_pmf(k, n, p):
    return f"lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0) + case when {k} = 0 then 0 else {k} * ln({p}) end + case when {k} = {n} then 0 else ({n} - {k}) * ln(1 - {p}) end"


@query("binomial_tests", "v_hap_counts", f"""
  select chrom, pos, round(2 * least(low, 1 - low) + 1e-9, 6) as pval, round(exp({_log_pmf("k", "n", "0.5::double")}) + 1e-11, 8) as pmf
  from (select chrom, pos, k, n, case when k >= n then 1 else list_sum(list_transform(range(0, k + 1), lambda x: exp({_log_pmf("x", "n", "0.5::double")}))) end as low
    from (select chrom, pos, cast(count_a as bigint) as k, cast(count_a + count_c as bigint) as n from v_hap_counts) c) t""")
def _(spark, c):
    n = (F.col("count_a") + F.col("count_c")).cast("double")
    k = F.col("count_a").cast("double")
    return c.select("chrom", "pos", r6(stats.binomial_two_tailed(k, n, F.lit(0.5)) + 1e-9).alias("pval"), F.round(stats.binomial_pmf(k, n, F.lit(0.5)) + 1e-11, 8).alias("pmf"))


@query("logr_pvalue", "v_segments", "select chrom, start_pos, case when abs(logr - 0) < 0.05 then 1.0 else 0.0 end as p from v_segments")
def _(spark, s):
    return s.select("chrom", "start_pos", sc.logr_pvalue("logr", 0.0, 0.05).alias("p"))


@query("allele_letter_to_index", "v_haplotypes", "select chrom, pos, strpos('ACGT', ref) as i from v_haplotypes")
def _(spark, h):
    return h.select("chrom", "pos", sc.allele_letter_to_index("ref").alias("i"))


_BACK = f"(select *, greatest(round_even({_NA}, 0), 0) as a, greatest(round_even({_NB}, 0), 0) as b2 from v_segments) t"
_BB = "((1 - 0.73::double + 0.73::double * b2) / (2 - 2 * 0.73::double + 0.73::double * (a + b2)))"
_BR = "log2((0.73::double * (a + b2) + (1 - 0.73::double) * 2) / ((1 - 0.73::double) * 2 + 0.73::double * 2.15::double))"


@query("reliability", "v_segments", f"select chrom, start_pos, a as nA, b2 as nB, round({_BB}, 6) as back_baf, round({_BR}, 6) as back_logr from {_BACK}")
def _(spark, s):
    r = sc.reliability("baf", "logr", 0.73, 2.15)
    return s.select("chrom", "start_pos", r["nA"].alias("nA"), r["nB"].alias("nB"), r6(r["back_baf"]).alias("back_baf"), r6(r["back_logr"]).alias("back_logr"))


@query("refit_position", "v_segments", "select chrom, start_pos, ceil((start_pos + (end_pos - start_pos) / 2) / 1e6) as mb from v_segments")
def _(spark, s):
    return s.select("chrom", "start_pos", sc.refit_position("start_pos", "end_pos").alias("mb"))


# --- segmentation -------------------------------------------------------------------------------------------------------------


@query("pcf_exact", "v_track")
def _(spark, t):
    return segmentation.pcf_exact(t.select("sample_id", "chrom", "pos", "logr"), "logr", 0.05, 5)


@query("pcf_fast", "v_track")
def _(spark, t):
    return segmentation.pcf_fast(t.select("sample_id", "chrom", "pos", "logr"), "logr", 5, 0.05)


@query("pcf_candidates", "v_track")
def _(spark, t):
    return segmentation.pcf_candidates(t.select("sample_id", "chrom", "pos", "logr"), "logr", 5)


@query("pcf_compact", "v_track",
    "select sample_id, chrom, cast(cell as bigint) as cell, count(*) as n, round(sum(logr), 6) as total, round(sum(logr * logr), 6) as squares from (select *, sum(mark) "
    "over (partition by sample_id, chrom order by pos rows unbounded preceding) - mark as cell from (select *, cast(pos % 35000 = 0 as int) as mark from v_track) a) b "
    "group by sample_id, chrom, cell")
def _(spark, t):
    return rounded(segmentation.pcf_compact(t.withColumn("mark", F.col("pos") % 35000 == 0), "logr", "mark"), "total", "squares")


@query("segment_phased_baf", "v_track v_breakpoints")
def _(spark, t, b):
    return segmentation.segment_phased_baf(t.select("sample_id", "chrom", "pos", "baf"), b)


@query("segment_phased_baf_legacy", "v_track")
def _(spark, t):
    return segmentation.segment_phased_baf_legacy(t.select("sample_id", "chrom", "pos", "baf"))


@query("segment_phased_baf_multisample", "v_tracks")
def _(spark, t):
    return segmentation.segment_phased_baf_multisample(t.select(F.lit("p1").alias("patient_id"), "sample_id", "chrom", "pos", "baf"), gamma=5)


@query("segment_logr", "v_track v_geometry")
def _(spark, t, g):
    return segmentation.segment_logr(pseudonormal.with_arm(t, g).select("sample_id", "chrom", "arm", "pos", "logr"), "logr", 100, 5)


@query("flip_phased", "v_baf_segmented", "select chrom, pos, round(case when baf_seg > 0.6 then baf else 1 - baf end, 6) as b from v_baf_segmented")
def _(spark, s):
    return s.withColumn("level", F.col("baf_seg") - 0.1).select("chrom", "pos", r6(segmentation.flip_phased("baf", "level")).alias("b"))


# --- fit ----------------------------------------------------------------------------------------------------------------------


def _segs(s):
    return s.select("sample_id", F.col("baf").alias("b"), F.col("logr").alias("r"), F.col("n").alias("length"))


_GRID = (
    "grid as (select i.range as i, j.range as j, round(1.0 + (i.range - 1) * 0.05::double, 6) as psi, round(0.07 + (j.range - 1) * 0.01::double, 6) as rho from range(1, "
    "90) i cross join range(1, 98) j)"
)
_POINT = (
    "pts as (select s.sample_id, g.i, g.j, g.psi, g.rho, s.baf as b, s.n as len, (g.rho - 1 - (s.baf - 1) * pow(2, s.logr) * ((1 - g.rho) * 2 + g.rho * g.psi)) / g.rho as "
    "na, (g.rho - 1 + s.baf * pow(2, s.logr) * ((1 - g.rho) * 2 + g.rho * g.psi)) / g.rho as nb from v_segments s cross join grid g), off as (select *, abs(na - "
    "greatest(round_even(na, 0), 0)) as oa, abs(nb - greatest(round_even(nb, 0), 0)) as ob, na < 0.5 and nb < 0.5 and na >= 0 and nb >= 0 as gone from pts)"
)
_TERMS = {
    0: ("oa * oa * len * case when b <= 0.51 then 0.05 else 1 end", "ob * ob * len * case when b <= 0.51 then 0.05 else 1 end"),
    1: ("pow(0.5 - oa, 2) * len", "pow(0.5 - ob, 2) * len"),
    2: ("0.5 * (pow(0.5 - oa, 2) + pow(0.5 - ob, 2)) * len",) * 2,
    3: ("0.5 * (pow(0.5 - oa, 2) + pow(0.5 - ob, 2)) * len * case when gone then 8 else 1 end",) * 2,
}


def _score_sql(metric):
    a, b = _TERMS[metric]
    return f"(select sample_id, i, j, psi, rho, case when sum(na) < sum(nb) then sum({a}) else sum({b}) end as score from off group by sample_id, i, j, psi, rho)"


@query("rho_psi_grid", "v_tracks", "select t.sample_id, i, j, psi, rho from grid cross join (select distinct sample_id from v_tracks) t", _GRID)
def _(spark, t):
    return t.select("sample_id").distinct().join(F.broadcast(fit.rho_psi_grid(spark)), how="cross")


for _m in range(4):
    @query(f"score_grid_ascat_{_m}", "v_segments", f"select sample_id, i, j, psi, rho, round(score, 4) as score from {_score_sql(_m)} t", f"{_GRID}, {_POINT}")
    def _(spark, s, m=_m):
        return fit.score_grid_ascat(fit.rho_psi_grid(spark), _segs(s), m).withColumn("score", F.round("score", 4))


_MINIMA = "scored as (select *, -score as m from " + _score_sql(1) + (
    " t), minima as (select c.* from scored c where c.i between 4 and 86 and c.j between 4 and 94 and not exists (select 1 from scored o where o.sample_id = c.sample_id "
    "and abs(o.i - c.i) <= 3 and abs(o.j - c.j) <= 3 and not (o.i = c.i and o.j = c.j) and o.m <= c.m))"
)


@query("local_minima", "v_segments", "select sample_id, i, j, psi, rho, round(m, 4) as score from minima", f"{_GRID}, {_POINT}, {_MINIMA}")
def _(spark, s):
    scored = fit.score_grid_ascat(fit.rho_psi_grid(spark), _segs(s), 1).withColumn("score", -F.col("score"))
    return fit.local_minima(scored).withColumn("score", F.round("score", 4))


_STATS = (
    "stats as (select sample_id, i, j, psi, rho, sum((na + nb) * len) / sum(len) as ploidy, sum((cast(round_even(na, 0) = 0 as int) + cast(round_even(nb, 0) = 0 as int)) "
    "* len) / sum(len) as percent_zero, coalesce(sum((cast(round_even(na, 0) = 0 as int) + cast(round_even(nb, 0) = 0 as int)) * len * case when b = 0.5 then 0 else 1 "
    "end) / nullif(sum(len * case when b = 0.5 then 0 else 1 end), 0), 0) as percent_zero_odd, 0.25 * sum(len) as most from off group by sample_id, i, j, psi, rho)"
)


@query("grid_point_stats", "v_segments",
    "select sample_id, i, j, psi, rho, round(ploidy, 6) as ploidy, round(percent_zero, 6) as percent_zero, round(percent_zero_odd, 6) as percent_zero_odd, round(most, 4) "
    "as most from stats", f"{_GRID}, {_POINT}, {_STATS}")
def _(spark, s):
    return rounded(fit.grid_point_stats(fit.rho_psi_grid(spark), _segs(s)), "ploidy", "percent_zero", "percent_zero_odd", "most")


_SECOND = "turned as (select sample_id, i, j, psi, rho, case when rho > 1 then 1e20 else m end as m from scored), minima2 as (select c.* from turned c where " + _MINIMA.split("from scored c where ")[1].replace("from scored o", "from turned o")
_GOOD = "m.rho >= 0.1 and -100 * m.m / st.most >= 63"
_TURNS = f"""turns as (select 1 as turn, m.*, st.ploidy, -100 * m.m / st.most as goodness from (select sample_id, i, j, psi, rho, m from minima) m join stats st on st.sample_id = m.sample_id and st.i = m.i and st.j = m.j
    where st.ploidy between 1.6 and 4.8 and (st.percent_zero > 0.01 or st.percent_zero_odd > 0.1) and {_GOOD}
  union all select 2, m.*, st.ploidy, -100 * m.m / st.most from minima2 m join stats st on st.sample_id = m.sample_id and st.i = m.i and st.j = m.j where st.ploidy > 1.6 and st.ploidy < 4.8 and {_GOOD})"""
_CHOICE = """select s.sample_id, b.psi, b.rho, round(b.ploidy, 6) as ploidy, round(b.goodness, 4) as goodness from (select distinct sample_id from v_segments) s left join (
  select sample_id, arg_min(psi, o) as psi, arg_min(least(rho, 1.0), o) as rho, arg_min(ploidy, o) as ploidy, arg_min(goodness, o) as goodness from (select *, (turn, m, -i, -j) as o from turns) t
  group by sample_id) b on b.sample_id = s.sample_id"""


@query("select_ascat_optimum", "v_segments v_model_segments", _CHOICE,
    f"{_GRID}, {_POINT.replace('s.baf', 's.b').replace('s.logr', 's.r').replace('s.n as len', 's.length as len').replace('from v_segments', 'from v_model_segments')}, "
    f"{_MINIMA}, {_STATS}, {_SECOND}, {_TURNS}")
def _(spark, s, segs):
    best = fit.select_ascat_optimum(fit.score_grid_ascat(fit.rho_psi_grid(spark), segs, 1), segs, 1)
    return best.select("sample_id", "psi", "rho", r6("ploidy").alias("ploidy"), F.round("goodness", 4).alias("goodness"))


_OPTIMA = (
    "(select concat(chrom, '-', cast(start_pos as string)) as sample_id, round(1 + (n % 45) / cast(10 as double), 6) as psi, round(least(0.1 + n / cast(157 as double), "
    "1), 2) as rho from v_segments)"
)
_LOWER = "case when {0} - {1} / 2 < {2} then {2} when {0} + {1} / 2 > {3} then {3} - {1} else {0} - {1} / 2 end"
_PSI_LOW, _RHO_LOW = _LOWER.format("psi", "0.44", "1.0", "5.4"), _LOWER.format("rho", "(0.1 * rho)", "0.1", "1.0")


@query("refine_bounds", "v_segments",
    f"select sample_id, round({_PSI_LOW}, 6) as psi_min, round({_PSI_LOW} + 0.44, 6) as psi_max, round({_RHO_LOW}, 6) as rho_min, round({_RHO_LOW} + 0.1 * rho, 6) as "
    f"rho_max from {_OPTIMA} o")
def _(spark, s):
    spark.sql(f"select * from {_OPTIMA} o").createOrReplaceTempView("v_optima")
    return rounded(fit.refine_bounds(spark.table("v_optima")), "psi_min", "psi_max", "rho_min", "rho_max")


def _fit6(f):
    return f.select("sample_id", "rho", "psi")


_T_LEVEL = f"""lvl as (select q.*, o.m1, o.n1, o.m2, o.n2, {_level('o.m1', 'o.n1')} as e1, {_level('o.m2', 'o.n2')} as e2 from lv q join good o on o.chrom = q.chrom and o.start_pos = q.start_pos and o.k = 0)"""


@query("segment_is_clonal", "v_segments",
    "select chrom, start_pos, round((baf - case when abs(e1 - baf) <= abs(e2 - baf) then e1 else e2 end) * sqrt(n) / 0.05, 4) as t from lvl where least(m1, n1, m2, n2) >= "
    "0", f"{_AT}, {_EDGES}, {_T_LEVEL}")
def _(spark, s):
    rows = s.select("chrom", "start_pos", F.col("baf").alias("b"), F.col("logr").alias("r"), F.col("n").alias("size"), F.col("n").alias("length"),
        F.lit(0.05).alias("sd"), F.lit(0.73).alias("rho"), F.lit(2.15).alias("psi"))
    return fit.segment_is_clonal(rows).filter("edge.m1 is not null").select("chrom", "start_pos", F.round("t", 4).alias("t"))


def _edge_sql(source, first, second):
    """source (b, rho, ...) with the nearest edge's states m1, n1, m2, n2 and their BAF l1 and l2, from these copies of both alleles."""
    level = lambda a, c: f"(case when {a} = 0 and {c} = 0 then 0.5 else (1 - rho + rho * {a}) / nullif(2 - 2 * rho + rho * ({a} + {c}), 0) end)"
    lift = "x0 + b * (0.01 - y0) / nullif(1 - b, 0)"
    rescued = f"""(select *, case when y0 < 0 then case when b = 1 or {lift} < 0 then 1000.0::double else {lift} end else x0 end as x, case when y0 < 0 then 0.01::double else y0 end as y
      from (select *, {first} as x0, {second} as y0 from {source} s0) s1) s2"""
    corners = (
        f"(select *, floor(x) as fx, floor(y) as fy, b > {level('floor(x)', 'floor(y)')} as over3, b > {level('ceil(x)', 'ceil(y)')} as over2, x + y < floor(x) + floor(y) + 1 "
        f"as low from {rescued}) s3"
    )
    edges = f"""(select *, fx + case when not low and (over3 or over2) then 1 else 0 end as m1, fy + case when not low and not (over3 or over2) then 1 else 0 end as n1,
      fx + case when not low or over3 then 1 else 0 end as m2, fy + case when not low or not over3 then 1 else 0 end as n2 from {corners}) s4"""
    return f"(select *, {level('m1', 'n1')} as l1, {level('m2', 'n2')} as l2 from {edges}) s5"


_NA6, _NB6 = ("(rho - 1 - (b - 1) * pow(2, r) * ((1 - rho) * 2 + rho * psi)) / rho", "(rho - 1 + b * pow(2, r) * ((1 - rho) * 2 + rho * psi)) / rho")
_ALL_A, _ALL_B = "(rho - 1 + b * psi * pow(2, r)) / rho", "(rho - 1 + (1 - b) * psi * pow(2, r)) / rho"


def _closest(source):
    """source (b, r, size, sd, rho, psi, ...) with level, n_maj and n_min of the closest state, and whether it explains the BAF."""
    lifted = _edge_sql(source, f"greatest({_NA6}, {_NB6})", f"least({_NA6}, {_NB6})")
    chosen = f"(select *, case when abs(l1 - b) <= abs(l2 - b) or l2 is null then l1 else l2 end as level, abs(l1 - b) <= abs(l2 - b) or l2 is null as one from {lifted}) c1"
    tail = _t_tails("(b - level) * sqrt(size) / sd", "(size - 1)")
    return f"""(select *, case when one then m1 else m2 end as n_maj, case when one then n1 else n2 end as n_min,
      coalesce(case when sd = 0 then false when abs(b - level) < 0.01 then true when sd is null or size < 2 then false else {tail} > 0.05 end and x - x0 < 1, false) as clonal from {chosen}) c2"""


def _t_error(source):
    """source with t_error: the t of the mean against the closest corner; null without spread."""
    lifted = lambda v: f"(case when {v} < 0 or {v} is null then 0.01::double else {v} end)"
    level = lambda a, c: f"((1 - rho + rho * {a}) / nullif(2 - 2 * rho + rho * ({a} + {c}), 0))"
    corners = [level(a, c) for a, c in (("floor(x)", "ceil(y)"), ("ceil(x)", "ceil(y)"), ("floor(x)", "floor(y)"), ("ceil(x)", "floor(y)"))]
    best = "case when d1 <= least(d2, d3, d4) then k1 when d2 <= least(d3, d4) then k2 when d3 <= d4 then k3 else k4 end"
    near = ", ".join(f"coalesce(abs(k{n} - b), 1e9) as d{n}" for n in range(1, 5))
    inner = f"(select *, {', '.join(f'{c} as k{n}' for n, c in enumerate(corners, 1))} from (select *, {lifted(_ALL_A)} as x, {lifted(_ALL_B)} as y from {source} e0) e1) e2"
    return f"(select *, case when size > 0 and sd <> 0 then (mean - {best}) * sqrt(size) / sd end as t_error from (select *, {near} from {inner}) e3) e4"


def _ln_ratio(source):
    """source with ln_ratio: the log of the likelier of the nearest edge's levels over the other."""
    reads = (
        f"(select *, floor(size * 30.0 + 0.5) as n, greatest(0, least(floor(size * 30.0 + 0.5), floor(mean * size * 30 + 0.5))) as k, least(greatest(coalesce(l1, 0), 0), 1) as "
        f"p1, least(greatest(coalesce(l2, 0), 0), 1) as p2 from {_edge_sql(source, _ALL_A, _ALL_B)}) r1"
    )
    log = lambda p: f"(case when {p} = 0 then case when k = 0 then 0 end when {p} = 1 then case when k = n then 0 end else {_log_pmf('k', 'n', p)} end)"
    return (
        f"(select *, case when l1 is not null and l2 is not null and g1 > -745.13 and g2 > -745.13 then abs(g1 - g2) else 0 end as ln_ratio from (select *, {log('p1')} as g1, "
        f"{log('p2')} as g2 from {reads}) r2) r3"
    )


_SEG_FIT = "(select s.*, f.rho, f.psi from v_seg6 s join v_fit f on f.sample_id = s.sample_id)"
_SEG_GRID = "(select s.*, g.i, g.j, g.rho, g.psi from v_seg6 s cross join grid g where s.b > 0.51)"
_BY_POINT = "group by sample_id, i, j, psi, rho"


@query("segment_standardised_error", "v_seg6 v_fit", f"select sample_id, seg_id, round(t_error, 5) as t_error from {_t_error(_SEG_FIT)}")
def _(spark, s, f):
    return fit.segment_standardised_error(s, _fit6(f)).select("sample_id", "seg_id", F.round("t_error", 5).alias("t_error"))


@query("segment_ln_likelihood_ratio", "v_seg6 v_fit", f"select sample_id, seg_id, round(ln_ratio, 4) as ln_ratio from {_ln_ratio(_SEG_FIT)}")
def _(spark, s, f):
    return fit.segment_ln_likelihood_ratio(s, _fit6(f)).select("sample_id", "seg_id", F.round("ln_ratio", 4).alias("ln_ratio"))


_CLONAL_SQL = {
    0: f"select sample_id, i, j, psi, rho, round(sum(case when clonal then length else 0 end) / sum(length), 8) as score from {_closest(_SEG_GRID)} {_BY_POINT}",
    1: f"select sample_id, i, j, psi, rho, round(coalesce(sum(t_error * t_error) / nullif(count(t_error), 0), 0), 4) as score from {_t_error(_SEG_GRID)} {_BY_POINT}",
    4: f"select sample_id, i, j, psi, rho, round(sum(ln_ratio), 3) as score from {_ln_ratio(_SEG_GRID)} {_BY_POINT}",
}


for _m, _sql in ((2, "avg(pow(s.b - s.mean, 2))"), (3, "sum(s.length * pow(s.b - s.mean, 2)) / sum(s.length)")):
    @query(f"score_grid_clonal_{_m}", "v_seg6",
        f"select s.sample_id, g.i, g.j, g.psi, g.rho, round({_sql}, 8) as score from v_seg6 s cross join grid g where s.b > 0.51 group by s.sample_id, g.i, g.j, g.psi, g.rho", _GRID)
    def _(spark, s, m=_m):
        return fit.score_grid_clonal(fit.rho_psi_grid(spark), s, m).drop("ref").withColumn("score", F.round("score", 8))


for _m, _digits in ((0, 8), (1, 4), (4, 3)):
    @query(f"score_grid_clonal_{_m}", "v_seg6", _CLONAL_SQL[_m], _GRID)
    def _(spark, s, m=_m, digits=_digits):
        return fit.score_grid_clonal(fit.rho_psi_grid(spark), s, m).drop("ref").withColumn("score", F.round("score", digits))


_TIED = "tied as (select s.* from (select sample_id, i, j, psi, rho, round(score, 1) as score from " + _score_sql(1) + " t) s join (select sample_id, max(round(score, 1)) as best from " + _score_sql(1) + (
    " t group by sample_id) b on b.sample_id = s.sample_id and b.best = s.score), centre as (select sample_id, quantile_cont(i, 0.5) as ci, quantile_cont(j, 0.5) as cj, "
    "count(*) as n_best from tied group by sample_id)"
)


@query("centroid_optimum", "v_segments",
    "select t.sample_id, arg_min(t.psi, (pow(t.i - c.ci, 2) + pow(t.j - c.cj, 2), -t.i, -t.j)) as psi, arg_min(t.rho, (pow(t.i - c.ci, 2) + pow(t.j - c.cj, 2), -t.i, "
    "-t.j)) as rho, max(c.n_best) as n_best from tied t join centre c on c.sample_id = t.sample_id group by t.sample_id", f"{_GRID}, {_POINT}, {_TIED}")
def _(spark, s):
    scored = fit.score_grid_ascat(fit.rho_psi_grid(spark), _segs(s), 1).withColumn("score", F.round("score", 1))
    return fit.centroid_optimum(scored).select("sample_id", "psi", "rho", "n_best")


_REFERENCE = f"""own as materialized (select * from {_closest(_SEG_GRID)}),
  pts as materialized (select sample_id, i, j, psi, rho, sum(case when clonal then length else 0 end) / sum(length) as score,
    arg_max([b, r, n_maj, n_min], (length, -seg_id)) filter (where clonal and n_maj <> n_min) as ref from own {_BY_POINT}),
  tied as (select p.* from pts p join (select sample_id, max(score) as best from pts group by sample_id) m on m.sample_id = p.sample_id and m.best = p.score),
  centre as (select sample_id, quantile_cont(i, 0.5) as ci, quantile_cont(j, 0.5) as cj from tied group by sample_id),
  nearest as (select t.sample_id, t.score, t.ref, row_number() over (partition by t.sample_id order by pow(t.i - c.ci, 2) + pow(t.j - c.cj, 2), -t.i, -t.j) as place from tied t join centre c on c.sample_id = t.sample_id),
  solved as (select *, (2 * ref[1] - 1) / nullif(2 * ref[1] - ref[1] * (ref[3] + ref[4]) - 1 + ref[3], 0) as own_rho from nearest where place = 1)"""


_AT_REFERENCE = f"""point as (select sample_id, score, ref is not null as has_reference, case when ref is null then 1 when own_rho > 0 then own_rho end as rho,
    case when ref is null then 2 when own_rho > 0 then ((own_rho * (ref[3] + ref[4]) + 2 - 2 * own_rho) / pow(2, ref[2]) - 2 * (1 - own_rho)) / own_rho end as psi from solved),
  at_ref as materialized (select s.*, p.rho, p.psi from v_seg6 s join point p on p.sample_id = s.sample_id where p.has_reference and p.rho is not null),
  at_ploidy as (select sample_id, sum(({_NA6} + {_NB6}) * length) / sum(length) as ploidy from at_ref group by sample_id),
  at_share as (select sample_id, sum(case when clonal then length else 0 end) / sum(length) as share from {_closest('(select * from at_ref where b > 0.51)')} group by sample_id),
  rated as (select p.*, case when has_reference then ploidy else 2 end as ploidy, case when not has_reference then 1 when rho is null then 'inf'::double else coalesce(share, 0) end as distance
    from point p left join at_ploidy y on y.sample_id = p.sample_id left join at_share h on h.sample_id = p.sample_id)"""


@query("reference_segment_solution", "v_seg6", """
  select sample_id, round(rho, 6) as rho, has_reference, round(psi, 6) as psi, round(ploidy, 6) as ploidy, round(distance, 8) as distance,
    coalesce(psi between 1.6 and 4.8 and rho between 0.1 and 1 and distance > score, false) as is_better from rated""", f"{_GRID}, {_REFERENCE}, {_AT_REFERENCE}")
def _(spark, s):
    s = materialise(s, "reference-segments")  # read for the grid and for the reference's point
    found = fit.reference_segment_solution(fit.centroid_optimum(fit.score_grid_clonal(fit.rho_psi_grid(spark), s, 0)), segments=s)
    return rounded(found, "rho", "psi", "ploidy").withColumn("distance", F.round("distance", 8))


_OWN_PSI = "((rho * (n_maj + n_min) + 2 - 2 * rho) / pow(2, r) - 2 * (1 - rho)) / rho"


@query("recalc_psi_t", "v_seg6 v_fit", f"""
  select sample_id, max(rho) as rho, round(coalesce(sum({_OWN_PSI} * length) filter (where clonal) / sum(length) filter (where clonal), max(psi)), 6) as psi_t from own where length > 1 group by sample_id""",
       f"own as materialized (select * from {_closest(_SEG_FIT)})")
def _(spark, s, f):
    return rounded(fit.recalc_psi_t(s, _fit6(f)), "psi_t")


@query("fit_copy_number", "v_seg6")
def _(spark, s):
    return fit.fit_copy_number(s, metric=1)


@query("fit_copy_number_planted", "v_model_segments", "select distinct sample_id, 0.7::double as rho, 2.4::double as psi, true as is_best from v_model_segments")
def _(spark, s):
    """Segments of purity 0.7 and tumour ploidy 2.4: the fit finds both, to one digit."""
    number = F.row_number().over(windows.ordered(["sample_id"], "length"))
    segs = s.select("sample_id", number.alias("seg_id"), "b", "r", "length", F.col("length").alias("size"), F.col("b").alias("mean"), F.lit(0.02).alias("sd"))
    return fit.fit_copy_number(segs).filter("method = 'FRAC_GENOME'").select("sample_id", F.round("rho", 1).alias("rho"), F.round("psi", 1).alias("psi"), "is_best")


@query("fit_copy_number_preset", "v_seg6 v_fit")
def _(spark, s, f):
    return fit.fit_copy_number(s, preset=_fit6(f))


# --- calls --------------------------------------------------------------------------------------------------------------------


def _rho_psi_t(f):
    return f.select("sample_id", "rho", F.col("psi").alias("psi_t"))


_SEGLOGR = (
    f"(select s.sample_id, s.chrom, s.start_pos, s.end_pos, coalesce(avg(t.logr), 0) as logr from v_segments s left join v_track t on t.sample_id = s.sample_id and t.chrom "
    f"= s.chrom and t.pos between s.start_pos and s.end_pos group by s.sample_id, s.chrom, s.start_pos, s.end_pos) x"
)


@query("segment_logr_mean", "v_segments v_track", f"select chrom, start_pos, round(logr, 4) as logr from {_SEGLOGR}")
def _(spark, s, t):
    return calls.segment_logr_mean(s, t).select("chrom", "start_pos", F.round("logr", 4).alias("logr"))


_CALLED_PSI = "(0.73::double * 2.15::double + 2 * (1 - 0.73::double))"
_TAU_HERE = (
    "(1 - 0.73::double + 0.73::double * m2 - 2 * baf * (1 - 0.73::double) - baf * 0.73::double * (n2 + m2)) / nullif(baf * 0.73::double * (n1 + m1) - baf * 0.73::double * "
    "(n2 + m2) - 0.73::double * m1 + 0.73::double * m2, 0)"
)
_LIFT = "x0 + baf * (0.01 - y0) / nullif(1 - baf, 0)"
_CALLS = f"""runs as (select *, sum(new) over (partition by sample_id, chrom order by pos rows unbounded preceding) as run from (
    select *, case when lag(baf_seg) {_W} = baf_seg then 0 else 1 end as new from v_baf_segmented) a),
  seg as (select sample_id, chrom, min(pos) as start_pos, max(pos) as end_pos, greatest(min(baf_seg), 1 - min(baf_seg)) as baf, count(baf_phased) as n, avg(baf_phased) as mean, stddev_samp(baf_phased) as sd, avg(logr) as logr
    from runs group by sample_id, chrom, run),
  sq as materialized (select *, case when y0 < 0 then case when baf = 1 or {_LIFT} < 0 then 1000.0 else {_LIFT} end else x0 end as x, case when y0 < 0 then 0.01 else y0 end as y
    from (select *, (0.73::double - 1 + baf * {_CALLED_PSI} * pow(2, logr)) / 0.73::double as x0, (0.73::double - 1 + (1 - baf) * {_CALLED_PSI} * pow(2, logr)) / 0.73::double as y0 from seg) b),
  lv as materialized (select *, {_level('ceil(x)', 'ceil(y)')} as l2, {_level('floor(x)', 'floor(y)')} as l3, x + y < floor(x) + floor(y) + 1 as low from sq),
  {_EDGES.replace("select chrom, start_pos, baf, k,", "select sample_id, chrom, start_pos, baf, k,")},
  tested as materialized (select lv.*, g.m1, g.n1, g.m2, g.n2, {_level('g.m1', 'g.n1')} as e1, {_level('g.m2', 'g.n2')} as e2 from lv left join good g on g.sample_id = lv.sample_id and g.chrom = lv.chrom and g.start_pos = lv.start_pos and g.k = 0 and g.ok),
  levels as materialized (select *, case when m1 is null then null when abs(e1 - baf) <= abs(e2 - baf) then e1 else e2 end as level, abs(e1 - baf) <= abs(e2 - baf) as one from tested),
  judged as materialized (select *, case when abs(baf - level) < 0.01 then 1 when sd is null or sd = 0 then 0 when level is not null then {_t_tails("(mean - level) * sqrt(n) / sd", "(n - 1)")} end as pval from levels),
  opened as (select sample_id, chrom, start_pos, arg_min([m1, n1, {_TAU_HERE}, m2, n2], k) as o from good where ok group by sample_id, chrom, start_pos)"""


def _tau_at(level):
    return _TAU_HERE.replace("baf", level)


_SOLVED = f"""solved as (select g.sample_id, g.chrom, g.start_pos, row_number() over (partition by g.sample_id, g.chrom, g.start_pos order by not ok, k) as place,
    case when ok then m1 end as m1, case when ok then n1 end as n1, case when ok then m2 end as m2, case when ok then n2 end as n2, case when ok then {_TAU_HERE} end as tau,
    case when ok then (abs({_tau_at("(baf + se)")} - {_TAU_HERE}) + abs({_tau_at("(baf - se)")} - {_TAU_HERE})) / 2 end as spread
  from (select g.*, j.sd / sqrt(j.n) as se, j.pval from good g join judged j on j.sample_id = g.sample_id and j.chrom = g.chrom and j.start_pos = g.start_pos) g where pval <= 0.05
  union all select sample_id, chrom, start_pos, 1, case when one then m1 else m2 end, case when one then n1 else n2 end, null, null, 1, null from judged where pval is null or pval > 0.05)"""


def _solution_sql(k, letter):
    value = lambda c: f"max(case when s.place = {k} then {c} end)"
    own = {"nMaj1": value("s.m1"), "nMin1": value("s.n1"), "frac1": value("s.tau"), "nMaj2": value("s.m2"), "nMin2": value("s.n2"), "frac2": value("case when s.m2 is not null then 1 - s.tau end"), "SDfrac": value("s.spread")}
    empty = [f'cast(null as double) as "{c}"' for c in (f"SDfrac_{letter}_BS", f"frac1_{letter}_0.025", f"frac1_{letter}_0.975")]
    return ", ".join([*(f'round(cast({v} as double), 6) as "{c}_{letter}"' for c, v in own.items()), *empty])


@query("write_profile_extended", "v_baf_segmented v_fit", f"""
  select j.sample_id, j.chrom as chr, j.start_pos as startpos, j.end_pos as endpos, round(any_value(j.baf), 6) as BAF, abs(round(any_value(j.pval), 6)) as pval, round(any_value(j.logr), 6) as LogR,
    round(any_value(j.x + j.y), 6) as ntot, {", ".join(_solution_sql(k, letter) for k, letter in enumerate("ABCDEF", 1))}
  from judged j join solved s on s.sample_id = j.sample_id and s.chrom = j.chrom and s.start_pos = j.start_pos group by j.sample_id, j.chrom, j.start_pos, j.end_pos""", f"{_CALLS}, {_SOLVED}")
def _(spark, s, f):
    """Written as text, and read back."""
    table = sinks.profile_extended_table(calls.call_subclones(s, s, _rho_psi_t(f)))
    path = new_path(spark, "profile-extended")
    table.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    back = spark.read.schema(table.schema).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    return back.select(*(F.round(f"`{c.name}`", 6).alias(c.name) if c.dataType.typeName() == "double" else F.col(f"`{c.name}`") for c in table.schema))


@query("call_subclones", "v_baf_segmented v_fit", """
  select j.sample_id, j.chrom, j.start_pos, j.end_pos, round(j.baf, 6) as baf, round(j.logr, 6) as logr, round(x + y, 6) as ntot, abs(round(pval, 6)) as pval,
    cast(case when pval <= 0.05 then o[1] when one then m1 else m2 end as double) as nMaj1, cast(case when pval <= 0.05 then o[2] when one then n1 else n2 end as double) as nMin1, round(case when pval <= 0.05 then o[3] else 1 end, 6) as frac1,
    cast(case when pval <= 0.05 then o[4] end as double) as nMaj2, cast(case when pval <= 0.05 then o[5] end as double) as nMin2, round(case when pval <= 0.05 then 1 - o[3] end, 6) as frac2
  from judged j left join opened p on p.sample_id = j.sample_id and p.chrom = j.chrom and p.start_pos = j.start_pos""", _CALLS)
def _(spark, s, f):
    found = calls.call_subclones(s, s, _rho_psi_t(f)).select("sample_id", "chrom", "start_pos", "end_pos", "baf", "logr", "ntot", "pval", "nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2")
    return rounded(found, "baf", "logr", "ntot", "pval", "frac1", "frac2")


@query("bootstrap_fraction_ci", "v_baf_segmented v_fit")
def _(spark, s, f):
    return calls.bootstrap_fraction_ci(s, calls.call_subclones(s, s, _rho_psi_t(f)), _rho_psi_t(f))


@query("merge_segments", "v_baf_segmented v_fit")
def _(spark, s, f):
    return calls.merge_segments(calls.call_subclones(s, s, _rho_psi_t(f)), s, s, _rho_psi_t(f))


@query("call_profile", "v_baf_segmented v_fit")
def _(spark, s, f):
    return calls.call_profile(s, s, _rho_psi_t(f)).select("sample_id", "chrom", "start_pos", "end_pos", "baf", "logr", "nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2", "masked")


_IS = {k: f"nMaj1 = {k[0]} and nMin1 = {k[1]} and frac1 = 1" for k in ("11", "22", "21", "31", "41", "20", "10")} | {"no": "nMin1 = 0 and frac1 = 1"}
_COUNTED = ", ".join([f"count(*) filter (where {c}) as n{k}, stddev_samp(logr) filter (where {c}) as s{k}" for k,
    c in _IS.items()] + [f"avg(logr) filter (where {_IS[k]}) as m{k}" for k in ("11", "20")])
_CAL = f"""states as (select sample_id, {_COUNTED} from v_profile group by sample_id),
  spread as (select s.*, case when n11 > 1 then -m11 when n20 > 0 then -m20 else -log2(2 / f.ploidy) end as shift,
    greatest(coalesce(case when n11 > 1 then s11 else s22 end, 0), coalesce(s21, 0), coalesce(s31, 0), coalesce(s41, 0), 0.05) as sd_max from states s join v_fit f on f.sample_id = s.sample_id),
  cal as (select *, case when n10 > 1 then s10 when nno > 1 then sno else sd_max end as sd_loss from spread)"""


@query("logr_calibration_x", "v_profile v_fit", "select sample_id, round(shift, 6) as shift, round(sd_max, 6) as sd_max, round(sd_loss, 6) as sd_loss from cal", _CAL)
def _(spark, p, f):
    return rounded(calls.logr_calibration_x(p, f), "shift", "sd_max", "sd_loss")


_X_CALLED = """x as (select s.chrom, s.start_pos, s.logr as raw, s.logr + c.shift as v, c.sd_max as sd, c.sd_loss, f.rho as p, greatest(ceil((pow(2, s.logr + c.shift) - (1 - f.rho)) / f.rho) - 1, 1) + 1 as c
    from v_segments s join cal c on c.sample_id = s.sample_id join v_fit f on f.sample_id = s.sample_id),
  levels as (select *, case when raw >= 0 and v > 1.96 * sd then 'gain' when raw < 0 and v < -1.96 * sd then 'loss' else 'none' end as kind,
    log2(p * (c - 1) + 1 - p) as low, log2(p * c + 1 - p) as high, greatest(log2(1 - p), log2(0.01)) as gone, (1 - pow(2, v)) / p as lost from x),
  judged as (select *, abs(v - low) < abs(v - high) as down, case when c = 2 then round(high - v, 2) <= round(sd / high, 2) when c >= 6 then true
    when abs(v - low) < abs(v - high) then round(v - low, 2) <= round(sd / low, 2) else round(high - v, 2) < round(sd / high, 2) end as sure_gain,
    round(abs(gone - v), 2) < round(abs(sd_loss / gone), 2) or lost >= 0.95 as sure_loss from levels),
  copies as (select *, case when kind = 'gain' then case when c > 2 and down and sure_gain then c - 1 else c end when kind = 'loss' then 0 else 1 end as cn,
    case when kind = 'gain' then sure_gain when kind = 'loss' then sure_loss end as is_clonal from judged),
  shares as (select *, case when is_clonal or kind = 'none' then 1 when kind = 'gain' then (pow(2, v) - (p * (cn - 1) + 1 - p)) / p else lost end as ccf, case when kind = 'gain' then cn - 1 else 1 end as other from copies)"""


@query("call_x_segments", "v_profile v_fit v_segments", f"""
  select chrom, start_pos, kind, cast(cn as double) as cn, is_clonal, round(ccf, 6) as ccf, cast(case when not coalesce(is_clonal, true) and ccf <= 0.5 then other else cn end as double) as nMaj1,
    round(case when not coalesce(is_clonal, true) and ccf <= 0.5 then 1 - ccf else ccf end, 6) as frac1, cast(case when coalesce(is_clonal, true) then 0 when ccf <= 0.5 then cn else other end as double) as nMaj2
  from shares""", f"{_CAL}, {_X_CALLED}")
def _(spark, p, f, s):
    called = calls.call_x_segments(s, calls.logr_calibration_x(p, f), f.select("sample_id", F.col("rho").alias("purity")))
    return rounded(called.select("chrom", "start_pos", "kind", "cn", "is_clonal", "ccf", "nMaj1", "frac1", "nMaj2"), "ccf", "frac1")


@query("male_x", "v_profile v_fit v_track v_breakpoints")
def _(spark, p, f, t, b):
    """Chromosome 1's loci stand for X, three times as far apart."""
    x = t.filter("chrom = '1'").withColumns({"chrom": F.lit("X"), "pos": F.col("pos") * 3})
    cuts = b.filter("chrom = '1'").select(F.lit("X").alias("chrom"), (F.col("pos") * 3).alias("pos"))
    out = calls.male_x(p, x, f, f, f.select("sample_id"), cuts)
    return rounded(out.select("sample_id", "chrom", "start_pos", "end_pos", "logr", "nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2"), "logr", "frac1", "frac2")


@query("locus_overlay", "v_segments v_breakpoints",
    "select s.chrom, s.start_pos, b.pos as b_start_pos from v_segments s join v_breakpoints b on b.chrom = s.chrom and s.start_pos <= b.pos + 100000 and b.pos <= "
    "s.end_pos")
def _(spark, s, b):
    spots = b.select("chrom", F.col("pos").alias("start_pos"), (F.col("pos") + 100_000).alias("end_pos"))
    return calls.locus_overlay(s, spots).select("chrom", "start_pos", "b_start_pos")


# --- phasing, several samples, no normal ---------------------------------------------------------------------------------------


@query("phasing_regions", "v_spans", """
  select chrom, start_pos + n * 5000000 + 1 as start_pos, least(end_pos, start_pos + (n + 1) * 5000000) as end_pos
  from (select s.*, unnest(range(0, cast(ceil((end_pos - start_pos) / 5000000) as bigint))) as n from v_spans s) t""")
def _(spark, g):
    return phasing.phasing_regions(g)


_HAP = (
    "(select h.sample_id, h.chrom, h.pos, case when hap1 = 1 then a else r end as on1, a + r as depth from (select h.*, [c.count_a, c.count_c, c.count_g, "
    "c.count_t][strpos('ACGT', h.ref)] as r, [c.count_a, c.count_c, c.count_g, c.count_t][strpos('ACGT', h.alt)] as a from v_haplotypes h join v_hap_counts c on "
    "c.sample_id = h.sample_id and c.chrom = h.chrom and c.pos = h.pos where hap1 <> hap2) h) x"
)


@query("haplotype_baf", "v_haplotypes v_hap_counts", f"select chrom, pos, round(on1 / depth, 6) as baf from {_HAP} where depth >= 5")
def _(spark, h, c):
    return rounded(phasing.haplotype_baf(c, h, 5).select("chrom", "pos", "baf"), "baf")


@query("haplotype_baf_array", "v_track v_haplotypes",
    "select t.chrom, t.pos, round(case when h.hap1 = 1 then 1 - t.baf else t.baf end, 6) as baf from v_track t join v_haplotypes h on h.chrom = t.chrom and h.pos = t.pos "
    "where h.hap1 <> h.hap2")
def _(spark, t, h):
    return rounded(phasing.haplotype_baf_array(t, h).select("chrom", "pos", "baf"), "baf")


_EXTERNAL = """ext as (select sample_id, chrom, pos, cast(floor(pos / 5000) % 2 as int) as e1, cast(floor(pos / 1000000) as int) as ps from v_haplotypes where hap1 <> hap2 and pos % 3 = 0),
  known as (select h.chrom, h.pos, cast(h.hap1 <> e.e1 as int) as off, e.ps from v_haplotypes h join ext e on e.sample_id = h.sample_id and e.chrom = h.chrom and e.pos = h.pos),
  near as (select p.chrom, p.pos, case when a.pos is null or p.pos - b.pos <= a.pos - p.pos then b.off else a.off end as off, case when a.pos is null or p.pos - b.pos <= a.pos - p.pos then b.ps else a.ps end as ps
    from (select * from v_haplotypes where hap1 <> hap2) p asof left join known b on p.chrom = b.chrom and p.pos >= b.pos asof left join known a on p.chrom = a.chrom and p.pos <= a.pos),
  jumps as (select *, case when ps <> lag(ps) over w and off <> lag(off) over w then 1 else 0 end as jump from near window w as (partition by chrom order by pos)),
  flips as (select *, (sum(jump) over (partition by chrom order by pos rows unbounded preceding) + off) % 2 as flip from jumps)"""


@query("apply_external_haplotypes", "v_haplotypes",
    "select h.chrom, h.pos, cast(case when flip = 1 then hap2 else hap1 end as int) as hap1, cast(case when flip = 1 then hap1 else hap2 end as int) as hap2 from "
    "v_haplotypes h left join flips f on f.chrom = h.chrom and f.pos = h.pos", _EXTERNAL)
def _(spark, h):
    ext = h.filter("hap1 <> hap2 and pos % 3 = 0").select("sample_id", "chrom", "pos", (F.floor(F.col("pos") / 5000) % 2).cast("int").alias("hap1"),
        F.floor(F.col("pos") / 1_000_000).cast("int").alias("ps"))
    return phasing.apply_external_haplotypes(h, ext).select("chrom", "pos", "hap1", "hap2")


_SEGMENTED = f"""seg as (select z.chrom, z.pos, z.ps, z.baf_seg, case when z.baf_seg > 0.6 then x.on1 / x.depth else 1 - x.on1 / x.depth end as phased
    from {_PS} left join {_HAP} on x.chrom = z.chrom and x.pos = z.pos and x.depth > 0),
  own as (select h.*, [c.count_a, c.count_c, c.count_g, c.count_t][strpos('ACGT', h.ref)] as ad_ref, [c.count_a, c.count_c, c.count_g, c.count_t][strpos('ACGT', h.alt)] as ad_alt
    from v_haplotypes h join v_hap_counts c on c.chrom = h.chrom and c.pos = h.pos where h.hap1 <> h.hap2),
  bits as (select own.*, seg.ps, seg.baf_seg, seg.phased, cast(abs(phased - ad_alt / (ad_ref + ad_alt)) < 1e-5 as int) as bit from own join seg on seg.chrom = own.chrom and seg.pos = own.pos)"""


@query("phased_genotypes", "v_haplotypes v_hap_counts v_baf_segmented", """
  select chrom, pos, case when phased is null then hap1 || '|' || hap2 else bit || case when greatest(baf_seg, 1 - baf_seg) > 0.525 then '|' else '/' end || (1 - bit) end as gt,
    ps, ad_ref, ad_alt from bits""",
       _SETS.replace("> 0.6", "> 0.525") + ", " + _SEGMENTED)
def _(spark, h, c, s):
    level = s.select("sample_id", "chrom", "pos", "baf_seg")
    rows = level.join(phasing.haplotype_baf(c, h), ["sample_id", "chrom", "pos"], "left").withColumn("baf_phased", F.when(F.col("baf_seg") > 0.6, F.col("baf")).otherwise(1 - F.col("baf")))
    return phasing.phased_genotypes(c, h, rows).select("chrom", "pos", "gt", "ps", "ad_ref", "ad_alt")


@query("multisample_phasing", "v_phased")
def _(spark, p):
    return phasing.multisample_phasing(p)


def _three(p, samples):
    """The profile as three samples' of two patients; the second patient's segments begin 7 bases later."""
    own = p.drop("sample_id").join(samples, how="cross").withColumns({"nMaj1": F.col("nMaj1") + F.col("k") % 2, "start_pos": F.col("start_pos") + F.col("k") * 10})
    both = own.withColumn("o", F.explode(F.array(F.lit(0), F.lit(7))))
    return both.withColumns({"patient_id": F.concat(F.lit("p"), F.col("o").cast("string")), "start_pos": F.col("start_pos") + F.col("o")})


_ODD = """(select 'p' || o.o as patient_id, s.sample_id, p.chrom, p.start_pos + s.k * 10 + o.o as start_pos, p.end_pos from v_profile p cross join v_samples s cross join (values (0), (7)) as o(o)
  where p.nMaj1 + s.k % 2 <> p.nMin1 or p.nMaj2 <> p.nMin2)"""


@query("imbalanced_regions", "v_profile v_samples", f"""
  select patient_id, chrom, edge_at as start_pos, nxt - 1 as end_pos, cast(depth as integer) as n from (
    select patient_id, chrom, edge_at, sum(d) over (partition by patient_id, chrom order by edge_at) as depth, lead(edge_at) over (partition by patient_id, chrom order by edge_at) as nxt from (
      select patient_id, chrom, edge_at, sum(d) as d from (
        select patient_id, chrom, start_pos as edge_at, 1 as d from {_ODD} a union all select patient_id, chrom, end_pos + 1, -1 from {_ODD} b) e
      group by patient_id, chrom, edge_at) p) q
  where depth > 1 and nxt is not null""")
def _(spark, p, s):
    return phasing.imbalanced_regions(_three(p, s)).select("patient_id", "chrom", "start_pos", "end_pos", F.size("samples").alias("n"))


def _two_patients(p):
    """The phased loci as two patients'; the second's bits are turned on every locus of an odd phase set."""
    both = p.withColumn("o", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.withColumns({"patient_id": F.concat(F.lit("p"), F.col("o").cast("string")), "bit": F.when((F.col("o") == 1) & (F.col("ps") % 2 == 1), 1 - F.col("bit")).otherwise(F.col("bit"))})


_PATIENTS = """pat as (select 'p' || o.o as patient_id, p.sample_id, p.chrom, p.pos, case when o.o = 1 and p.ps % 2 = 1 then 1 - p.bit else p.bit end as bit, p.ps, p.phased
  from v_phased p cross join (values (0), (1)) as o(o))"""
_AGREE = """(select p.patient_id, r.chrom, r.start_pos, r.end_pos, p.sample_id, avg(cast(p.bit = q.bit as int)) as agree
  from (select distinct chrom, start_pos, end_pos from v_segments) r join pat p on p.chrom = r.chrom and p.pos between r.start_pos and r.end_pos
  join (select patient_id, chrom, pos, bit from pat where sample_id = 's1') q on q.patient_id = p.patient_id and q.chrom = p.chrom and q.pos = p.pos
  group by p.patient_id, r.chrom, r.start_pos, r.end_pos, p.sample_id) a"""


@query("mirrored_imbalance", "v_segments v_phased", f"""
  select patient_id, chrom, start_pos, end_pos, round(max(agree) - min(agree), 6) as spread, max(agree) - min(agree) > 0.9 as mirrored from {_AGREE}
  group by patient_id, chrom, start_pos, end_pos""", _PATIENTS)
def _(spark, s, p):
    bits = _two_patients(p)
    regions = s.select("chrom", "start_pos", "end_pos", F.array(*map(F.lit, ("s1", "s2", "s3"))).alias("samples")).join(bits.select("patient_id").distinct(), how="cross")
    found = phasing.mirrored_imbalance(regions, bits, bits.filter("sample_id = 's1'"))
    return rounded(found.select("patient_id", "chrom", "start_pos", "end_pos", "spread", "mirrored"), "spread")


@query("loh_by_het_gaps", "v_lost v_geometry")
def _(spark, t, g):
    return pseudonormal.loh_by_het_gaps(t.filter("is_het").select("sample_id", "chrom", "pos"), g)


_LOH = "(select v.sample_id, v.chrom, v.start_pos, v.end_pos from v_intervals v) i"


@query("loh_noise_filter", "v_intervals v_geometry",
    f"select i.* from {_LOH} join v_geometry g on g.chrom = i.chrom where not (i.start_pos <= cen_right and i.end_pos >= cen_left and i.end_pos - i.start_pos < 1000000) "
    f"and not (i.chrom in ('1', '9', '16') and i.start_pos > cen_left and i.start_pos < cen_right + 100000 and i.end_pos - i.start_pos > 1000000) and not (i.chrom in "
    f"('13', '14', '15', '21', '22') and i.end_pos <= cen_left)")
def _(spark, i, g):
    return pseudonormal.loh_noise_filter(i.select("sample_id", "chrom", "start_pos", "end_pos"), g)


@query("loh_by_logr_windows", "v_lost v_geometry")
def _(spark, t, g):
    hets = t.filter("is_het").select("sample_id", "chrom", "pos")
    found = pseudonormal.loh_by_het_gaps(hets, g)
    return pseudonormal.loh_by_logr_windows(hets, t, found.select("sample_id", "chrom", "arm", "start_pos", "end_pos"), g)


_SPIKE = """reg as (select sample_id, chrom, min(pos) as s, min(pos) + (max(pos) - min(pos)) // 3 as e from v_counts group by sample_id, chrom),
  ins as (select c.sample_id, c.chrom, c.pos, row_number() over (partition by c.sample_id, c.chrom order by c.pos) as n from v_counts c join reg r on r.sample_id = c.sample_id and r.chrom = c.chrom and c.pos between r.s and r.e),
  dep as (select c.*, a.a0, a.a1, c.count_a + c.count_c + c.count_g + c.count_t as d, coalesce(i.n % 10 = 1, false) and a.a0 is not null as spike from v_counts c left join v_alleles a on a.chrom = c.chrom and a.pos = c.pos left join ins i on i.sample_id = c.sample_id and i.chrom = c.chrom and i.pos = c.pos)"""


def _new(i, c):
    return f"cast(case when spike then case when a0 = {i} then ceil(d / 2) when a1 = {i} then floor(d / 2) else 0 end else {c} end as int) as {c}"


@query("pseudo_normal_counts", "v_counts v_alleles",
    f"select sample_id, chrom, pos, {_new(1, 'count_a')}, {_new(2, 'count_c')}, {_new(3, 'count_g')}, {_new(4, 'count_t')}, spike as spiked from dep", _SPIKE)
def _(spark, c, a):
    third = (F.min("pos") + F.floor((F.max("pos") - F.min("pos")) / 3)).cast("long")
    loh = c.groupBy("sample_id", "chrom").agg(F.min("pos").alias("start_pos"), third.alias("end_pos"))
    return pseudonormal.pseudo_normal_counts(c, a, loh)


# --- regression and figure tables ---------------------------------------------------------------------------------------------


@query("gc_replication_correct", "v_track v_covariates")
def _(spark, t, c):
    return rounded(regression.gc_replication_correct(loci.match_covariates(t, c), "gc_1kb", "gc_100kb", "rt_01").select("sample_id", "chrom", "pos", "residual"), "residual")


@query("linear_correct", "v_track v_covariates", f"select chrom, pos, round(logr - regr_intercept(logr, gc_1kb) over () - regr_slope(logr, gc_1kb) over () * gc_1kb, 5) as residual from {_JOINED}")
def _(spark, t, c):
    return regression.linear_correct(loci.match_covariates(t, c), "gc_1kb").select("chrom", "pos", F.round("residual", 5).alias("residual"))


_REPORT = " union all ".join(
    f"select sample_id, '{c}' as covariate, abs(corr({c}, logr)) as before, abs(corr({c}, logr - s * gc_1kb)) as after from (select *, regr_slope(logr, gc_1kb) over () as "
    f"s from {_JOINED}) t group by sample_id" for c in ("gc_25bp", "rt_02"))


@query("correlations_report", "v_track v_covariates", f"select sample_id, covariate, round(before, 5) as before, round(after, 5) as after from ({_REPORT}) t")
def _(spark, t, c):
    rows = loci.match_covariates(t, c)
    out = regression.correlations_report(rows, regression.linear_correct(rows, "gc_1kb"), ["gc_25bp", "rt_02"])
    return out.select("sample_id", "covariate", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"))


_SEQ = "(select chrom, row_number() over (partition by chrom order by pos) as pos, ref in ('G', 'C') as gc from v_haplotypes) s"


@query("gc_window_content", "v_haplotypes",
    f"select chrom, pos, round(avg(cast(gc as int)) over (partition by chrom order by pos rows between 5 preceding and 5 following), 6) as gc_10, round(avg(cast(gc as "
    f"int)) over (partition by chrom order by pos rows between 25 preceding and 25 following), 6) as gc_50 from {_SEQ}")
def _(spark, h):
    seq = h.select("chrom", F.row_number().over(windows.ordered(["chrom"])).cast("long").alias("pos"), F.col("ref").alias("base"))
    return rounded(regression.gc_window_content(seq.select("chrom", "pos"), seq, {"10": 10, "50": 50}), "gc_10", "gc_50").select("chrom", "pos", "gc_10", "gc_50")


_DEPTHS = """(select sample_id, chrom, pos, t / median(t) over (partition by sample_id) as tumour, n / median(n) over (partition by sample_id) as normal from (
  select c.sample_id, c.chrom, c.pos, [c.count_a, c.count_c, c.count_g, c.count_t][a.a0] + [c.count_a, c.count_c, c.count_g, c.count_t][a.a1] as t,
    [m.count_a, m.count_c, m.count_g, m.count_t][a.a0] + [m.count_a, m.count_c, m.count_g, m.count_t][a.a1] as n
  from v_counts c join v_normal_counts m on m.sample_id = c.sample_id and m.chrom = c.chrom and m.pos = c.pos join v_alleles a on a.chrom = c.chrom and a.pos = c.pos) d)"""
_BOTH_SMOOTH = _median_sql("(select * exclude (i, n) from " + _median_sql(_DEPTHS, "tumour", 101, "tumour_smooth") + ")", "normal", 101, "normal_smooth")


@query("coverage_track", "v_counts v_normal_counts v_alleles", f"""
  select sample_id, chrom, pos, round(tumour, 6) as tumour, round(normal, 6) as normal, round(tumour_smooth, 6) as tumour_smooth, round(normal_smooth, 6) as normal_smooth from {_BOTH_SMOOTH} where i % 100 = 1""")
def _(spark, t, n, a):
    return rounded(tables.coverage_track(loci.match_counts(t, n, a)), "tumour", "normal", "tumour_smooth", "normal_smooth")


_ALL_PSI = "(f.rho * f.psi + 2 * (1 - f.rho))"
_SMOOTH_LOGR = _median_sql("(select sample_id, chrom, pos, logr from v_track)", "logr", 21, "smooth")


@query("total_cn_track", "v_profile v_track v_fit", f"""
  select m.sample_id, m.chrom, m.pos, round(m.smooth, 6) as smooth, round(({_ALL_PSI} * pow(2, m.smooth) - 2 * (1 - f.rho)) / f.rho, 6) as cn, round({_TOTAL}, 6) as state_cn
  from (select sample_id, chrom, pos, smooth from {_SMOOTH_LOGR}) m join v_fit f on f.sample_id = m.sample_id
  join v_profile p on p.sample_id = m.sample_id and p.chrom = m.chrom and m.pos between p.start_pos and p.end_pos""")
def _(spark, p, t, f):
    return rounded(tables.total_cn_track(p, t, f, 21), "smooth", "cn", "state_cn")


_RATIOS = (
    "(select sample_id, chrom, pos, baf_seg * pow(2, level) as major_ratio, (1 - baf_seg) * pow(2, level) as minor_ratio, exp(logr) as ratio from (select *, avg(logr) "
    "over (partition by sample_id, chrom, baf_seg) as level from v_baf_segmented) x)"
)


@query("allele_ratio_track", "v_baf_segmented", f"""
  select chrom, pos, round(major_ratio, 6) as major_ratio, round(minor_ratio, 6) as minor_ratio, round(ratio, 6) as ratio, round(ratio_smooth, 6) as ratio_smooth from {_median_sql(_RATIOS, "ratio", 101, "ratio_smooth")} where i % 100 = 1""")
def _(spark, s):
    seg = s.groupBy("sample_id", "chrom", "baf_seg").agg(F.avg("logr").alias("logr_seg"))
    found = rounded(tables.allele_ratio_track(s, s.join(seg, ["sample_id", "chrom", "baf_seg"])), "major_ratio", "minor_ratio", "ratio", "ratio_smooth")
    return found.select("chrom", "pos", "major_ratio", "minor_ratio", "ratio", "ratio_smooth")


_PSI = "(0.73::double * 2.15::double + 2 * (1 - 0.73::double))"


_AT7 = "seg as (select * from v_profile where chrom = '7' and start_pos <= 20000000 and end_pos >= 20000000)"


@query("square_plot_points", "v_profile v_fit",
    f"""select sample_id, 'exact' as kind, round((0.73::double - 1 + baf * {_PSI} * pow(2, logr)) / 0.73::double, 6) as n_maj, round((0.73::double - 1 + (1 - baf) * {_PSI} * pow(2, logr)) / 0.73::double, 6) as n_min, 1.0 as share from seg
  union all select sample_id, 'state 1', nMaj1, nMin1, frac1 from seg union all select sample_id, 'state 2', nMaj2, nMin2, frac2 from seg where nMaj2 is not null""", _AT7)
def _(spark, p, f):
    return rounded(tables.square_plot_points(p, f, "7", 20_000_000), "n_maj", "n_min", "share")


@query("score_surface", "v_segments", f"select i, j, round(ln(score), 5) as height, score = max(score) over (partition by sample_id) as is_best from {_score_sql(1)} t", f"{_GRID}, {_POINT}")
def _(spark, s):
    return tables.score_surface(fit.score_grid_ascat(fit.rho_psi_grid(spark), _segs(s), 1)).select("i", "j", F.round("height", 5).alias("height"), "is_best")


_LINES = "num as (select *, row_number() over (partition by sample_id order by cast(chrom as int), pos) as locus from v_track)"


@query("profile_lines", "v_profile v_track",
    f"select p.chrom, p.start_pos, min(n.locus) as first_locus, max(n.locus) as last_locus, round(max({_TOTAL}), 6) as total_cn from v_profile p join num n on n.sample_id "
    f"= p.sample_id and n.chrom = p.chrom and n.pos > p.start_pos and n.pos <= p.end_pos group by p.chrom, p.start_pos", _LINES)
def _(spark, p, t):
    return rounded(tables.profile_lines(p, t).select("chrom", "start_pos", "first_locus", "last_locus", "total_cn"), "total_cn")


@query("haplotype_band_points", "v_track", "select sample_id, chrom, pos, baf, round(1 - baf, 6) as mirror, baf > 0.5 as upper from v_track")
def _(spark, t):
    return rounded(tables.haplotype_band_points(t), "mirror")


@query("segment_band_points", "v_baf_segmented", "select sample_id, chrom, pos, baf_phased, round(1 - baf_phased, 6) as mirror, baf_seg, round(1 - baf_seg, 6) as seg_mirror from v_baf_segmented")
def _(spark, s):
    return rounded(tables.segment_band_points(s), "mirror", "seg_mirror")


# --- whole runs ---------------------------------------------------------------------------------------------------------------


def _cohort(c):
    """Tumour and normal counts, alleles and haplotypes of the planted cohort: A is the reference allele, C the other. The cohort is written
    first: each table would compute it again, and filters on counts grew to conditions of the view's cross join, too large to be compiled."""
    c = materialise(c, "cohort")
    locus = ["sample_id", "chrom", "pos"]
    counts = lambda a, alt: c.select(*locus, a.alias("count_a"), alt.alias("count_c"), F.lit(0).alias("count_g"), F.lit(0).alias("count_t"))
    tumour, normal = counts(F.col("depth") - F.col("alt"), F.col("alt")), counts(F.lit(50) + F.col("pos") % 3, F.lit(50) - F.col("pos") % 3)
    alleles = c.select("chrom", "pos", F.lit(1).alias("a0"), F.lit(2).alias("a1")).distinct()
    return tumour, normal, alleles, c.select(*locus, F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.col("hap1").cast("int").alias("hap1"), F.col("hap2").cast("int").alias("hap2"))


#: What was planted: copies by chromosome; samples s1 and s2 have the larger number on opposite haplotypes of every fifth.
_PLANTED = """planted as (select distinct sample_id, k, chrom, cast(case when cast(chrom as int) % 3 = 0 then 2 when cast(chrom as int) % 5 = 0 then 2 else 1 end as double) as nMaj1,
  cast(case when cast(chrom as int) % 3 = 0 then cast(chrom as int) % 2 else 1 end as double) as nMin1 from v_cohort)"""


@query("paired_run", "v_cohort", "select sample_id, chrom, nMaj1, nMin1 from planted", _PLANTED)
def _(spark, c):
    """The state of most of each chromosome, which has to be what was planted."""
    tumour, normal, alleles, haps = _cohort(c)
    preset = c.select("sample_id").distinct().select("sample_id", F.lit(0.7).alias("rho"), F.lit(2.1).alias("psi"))
    profile = lifecycle.paired(tumour, normal, alleles, haps, preset=preset)["profile"]
    state = F.max_by(F.struct("nMaj1", "nMin1"), F.col("end_pos") - F.col("start_pos"))
    return profile.groupBy("sample_id", "chrom").agg(state.alias("s")).select("sample_id", "chrom", "s.nMaj1", "s.nMin1")


@query("multisample_run", "v_cohort", "select 'p' as patient_id, chrom, bool_or(cast(chrom as int) % 5 = 0) as mirrored from planted where k < 2 and nMaj1 <> nMin1 group by chrom", _PLANTED)
def _(spark, c):
    """Samples s1 and s2 are one patient's, s3 another's: chromosomes with imbalance in both samples, and whether it is mirrored."""
    tumour, normal, alleles, haps = _cohort(c)
    patients = c.select(F.when(F.col("k") < 2, "p").otherwise("q").alias("patient_id"), "sample_id").distinct()
    preset = patients.select("sample_id", F.lit(0.7).alias("rho"), F.lit(2.1).alias("psi"))
    found = lifecycle.multisample(tumour, normal, alleles, haps, patients, preset=preset)["mirrored"]
    return found.groupBy("patient_id", "chrom").agg(F.bool_or("mirrored").alias("mirrored"))


@query("segment_phased_baf_planted", "v_cohort", """
  select sample_id, chrom, cast(1 as bigint) as n_segments, cast(round(20 * (0.3 + 0.7 * nMaj1) / (0.6 + 0.7 * (nMaj1 + nMin1))) as int) as level from planted""", _PLANTED)
def _(spark, c):
    """One segment a chromosome, in spite of switched phase, at the BAF of what was planted (in twentieths)."""
    tumour, _, _, haps = _cohort(c)
    found = segmentation.segment_phased_baf(phasing.haplotype_baf(tumour, haps, 10))
    return found.groupBy("sample_id", "chrom").agg(F.count_distinct("baf_seg").alias("n_segments"), F.round(20 * F.avg("baf_seg")).cast("int").alias("level"))


@query("merge_segments_planted", "v_cohort", "select sample_id, chrom, min(pos) as start_pos, max(pos) as end_pos from v_cohort group by sample_id, chrom")
def _(spark, c):
    """Chromosomes cut in halves of one state become whole again."""
    own = Window.partitionBy("sample_id", "chrom")
    rows = c.withColumn("v", F.when(F.col("bit") == 1, F.col("alt") / F.col("depth")).otherwise(1 - F.col("alt") / F.col("depth")))
    rows = rows.withColumns({"up": F.avg("v").over(own) >= 0.5, "half": F.col("pos") < (F.min("pos").over(own) + F.max("pos").over(own)) / 2})
    rows = rows.withColumn("baf_phased", F.when(F.col("up"), F.col("v")).otherwise(1 - F.col("v")))
    depth = c.groupBy("sample_id").agg(F.avg("depth").alias("mean_depth"))
    rows = rows.withColumn("baf_seg", F.avg("baf_phased").over(Window.partitionBy("sample_id", "chrom", "half")) + F.when(F.col("half"), 0.001).otherwise(0.0))
    rows = rows.join(depth, "sample_id").select("sample_id", "chrom", "pos", "baf_phased", "baf_seg", F.log2(F.col("depth") / F.col("mean_depth")).alias("logr"))
    rows = materialise(rows, "halves")
    fit_ = c.select("sample_id").distinct().select("sample_id", F.lit(0.7).alias("rho"), F.lit(2.32).alias("psi_t"))
    called = materialise(calls.call_subclones(rows, rows, fit_), "halves-called")
    return calls.merge_segments(called, rows, rows, fit_).select("sample_id", "chrom", "start_pos", "end_pos")
