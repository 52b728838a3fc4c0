"""Genomic-shaped views of the driver's tables. Each is one SQL text that Spark and DuckDB both run (but see spark_text)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables or views it reads, SQL).
VIEWS: dict[str, tuple[list[str], str]] = {
    "v_track": (["events"], """
        select 's1' as sample_id, cast(user_id % 22 + 1 as string) as chrom, event_id * 5000 as pos,
          round(0.5 + (case when event_id % 2 = 0 then 1 else -1 end)
            * (case when cast(floor(event_id / 2500) as int) % 2 = 1 then 0.2 else 0.0 end) + (value - 50) / 1000, 6) as baf,
          round((case when cast(floor(event_id / 2500) as int) % 2 = 1 then -0.4 else 0.0 end) + (value - 50) / 500, 6) as logr
        from events"""),
    "v_samples": ([], "select * from (values ('s1', 0), ('s2', 1), ('s3', 2)) as t(sample_id, k)"),
    "v_tracks": (["v_track", "v_samples"], """
        select s.sample_id, t.chrom, t.pos, round(t.baf + s.k * 0.01, 6) as baf, round(t.logr - s.k * 0.05, 6) as logr
        from v_track t cross join v_samples s where s.k = 0 or (cast(t.pos / 5000 as bigint)) % (s.k + 7) <> 0"""),
    "v_counts": (["lineitem"], """
        select 's1' as sample_id, cast(chrom_n as string) as chrom, pos, cast(sum(q) as int) as count_a, cast(sum(pk % 37) as int) as count_c,
          cast(sum(sk % 29) as int) as count_g, cast(sum(ln * 3) as int) as count_t
        from (select l_suppkey % 22 + 1 as chrom_n, l_orderkey * 10 + l_linenumber as pos, cast(l_quantity as int) as q,
          l_partkey as pk, l_suppkey as sk, l_linenumber as ln from lineitem) t group by chrom_n, pos"""),
    "v_normal_counts": (["lineitem"], """
        select 's1' as sample_id, cast(chrom_n as string) as chrom, pos, cast(sum(q % 23) as int) as count_a, cast(sum(pk % 19) as int) as count_c,
          cast(sum(sk % 17) as int) as count_g, cast(sum(ln * 2) as int) as count_t
        from (select l_suppkey % 22 + 1 as chrom_n, l_orderkey * 10 + l_linenumber as pos, cast(l_quantity as int) as q,
          l_partkey as pk, l_suppkey as sk, l_linenumber as ln from lineitem) t where pos % 11 <> 0 group by chrom_n, pos"""),
    "v_alleles": (["v_counts"], "select chrom, pos, cast(1 + pos % 4 as int) as a0, cast(1 + (pos + 1) % 4 as int) as a1 from v_counts where pos % 13 <> 0"),
    "v_segments": (["v_track"], """
        select sample_id, chrom, min(pos) as start_pos, max(pos) as end_pos, count(*) as n,
          round(avg(case when baf < 0.5 then 1 - baf else baf end), 6) as baf, round(avg(logr), 6) as logr
        from v_track group by sample_id, chrom, cast(floor(pos / 12500000) as int)"""),
    "v_baf_segmented": (["v_track"], """
        select sample_id, chrom, pos, baf, baf_phased, round(avg(baf_phased) over (partition by sample_id, chrom, cast(floor(pos / 12500000) as int)), 6) as baf_seg, logr
        from (select sample_id, chrom, pos, baf, case when baf < 0.5 then 1 - baf else baf end as baf_phased, logr from v_track) t"""),
    "v_haplotypes": (["events"], """
        select 's1' as sample_id, cast(user_id % 22 + 1 as string) as chrom, event_id * 5000 as pos, substr('ACGT', cast(event_id % 4 + 1 as int), 1) as ref,
          substr('ACGT', cast((event_id + 1) % 4 + 1 as int), 1) as alt, cast(event_id % 2 as int) as hap1,
          cast(case when event_id % 3 = 0 then event_id % 2 else 1 - event_id % 2 end as int) as hap2
        from events"""),
    "v_hap_counts": (["events"], """
        select 's1' as sample_id, cast(user_id % 22 + 1 as string) as chrom, event_id * 5000 as pos, cast(event_id % 41 as int) as count_a,
          cast(event_id % 37 as int) as count_c, cast(event_id % 31 as int) as count_g, cast(event_id % 29 as int) as count_t
        from events where event_id % 17 <> 0"""),
    "v_breakpoints": (["v_track"], "select chrom, pos + 1 as pos from v_track where (cast(pos / 5000 as bigint)) % 1000 = 7"),
    "v_covariates": (["v_track"], """
        select chrom, pos, round(cast(0.4 as double) + cast(0.1 as double) * ((cast(pos / 5000 as bigint)) % 7) / cast(7 as double) + logr / 20, 6) as gc_25bp, round(cast(0.4 as double) + cast(0.1 as double) * ((cast(pos / 5000 as bigint)) % 11) / cast(11 as double) + logr / 10, 6) as gc_1kb,
          round(cast(0.4 as double) + cast(0.1 as double) * ((cast(pos / 5000 as bigint)) % 13) / cast(13 as double) - logr / 15, 6) as gc_2kb, round(cast(0.4 as double) + cast(0.1 as double) * ((cast(pos / 5000 as bigint)) % 17) / cast(17 as double) + logr / 25, 6) as gc_5kb,
          round(cast(0.4 as double) + cast(0.1 as double) * ((cast(pos / 5000 as bigint)) % 19) / cast(19 as double) + logr / 12, 6) as gc_100kb, round(((cast(pos / 5000 as bigint)) % 23) / cast(23 as double) - logr / 9, 6) as rt_01,
          round(((cast(pos / 5000 as bigint)) % 29) / cast(29 as double) + logr / 30, 6) as rt_02 from v_track"""),
    "v_geometry": ([], """
        select cast(g as string) as chrom, 1 as start_pos, 20000000 + g * 100000 as cen_left, 22000000 + g * 100000 as cen_right, 60000000 as end_pos
        from (select unnest_g as g from (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16),(17),(18),(19),(20),(21),(22)) as v(unnest_g)) t"""),
    "v_intervals": (["v_tracks"], """
        select sample_id, chrom, pos as start_pos, pos + 20000 * (1 + (cast(pos / 5000 as bigint)) % 9) as end_pos, (cast(pos / 5000 as bigint)) % 5 as tag from v_tracks"""),
    "v_hets": (["v_tracks"], "select * from v_tracks where baf between 0.3 and 0.7"),
    "v_profile": (["v_segments"], """
        select sample_id, chrom, start_pos, end_pos, baf, logr, cast(case when n % 3 = 0 then 0.01 else 1.0 end as double) as pval, cast(1 + n % 4 as double) as nMaj1, cast(n % 2 as double) as nMin1,
          case when n % 3 = 0 then round(cast(0.3 as double) + (n % 5) / cast(10 as double), 6) else cast(1 as double) end as frac1, case when n % 3 = 0 then cast(2 + n % 4 as double) end as nMaj2,
          case when n % 3 = 0 then cast(n % 2 as double) end as nMin2, case when n % 3 = 0 then round(cast(0.7 as double) - (n % 5) / cast(10 as double), 6) end as frac2
        from v_segments"""),
    "v_seg6": (["v_baf_segmented"], """
        select sample_id, row_number() over (partition by sample_id order by chrom, seg) as seg_id, r, b, length, length as size, m as mean, s as sd
        from (select sample_id, chrom, cast(floor(pos / 12500000) as int) as seg, round(avg(logr), 6) as r, min(baf_seg) as b, count(*) as length,
          round(avg(baf_phased), 6) as m, round(stddev_samp(baf_phased), 6) as s from v_baf_segmented group by sample_id, chrom, cast(floor(pos / 12500000) as int)) t"""),
    "v_fit": (["v_segments"], """
        select sample_id, 'FRAC_GENOME' as method, cast(0.73 as double) as rho, cast(2.15 as double) as psi, round(2 + avg(logr), 6) as ploidy,
          round(avg(case when baf > 0.6 then 1.0 else 0.5 end), 6) as distance, true as is_best from v_segments group by sample_id"""),
    "v_fits": (["v_segments"], """
        select concat(chrom, '-', cast(start_pos as string)) as sample_id, m.method, round(cast(0.2 as double) + (n % 7) / cast(10 as double) + m.k / cast(50 as double), 6) as rho,
          round(cast(1.6 as double) + logr * logr + m.k / cast(9 as double), 6) as psi, round(2 + logr, 6) as ploidy, case when m.k > 0 then round(baf, 6) end as distance, case when m.k > 0 then (n + m.k) % 2 = 0 end as is_best
        from v_segments cross join (select * from (values ('ASCAT', 0), ('FRAC_GENOME', 1), ('REF_SEG', 2)) as t(method, k)) m"""),
    "v_spans": (["v_track"], """
        select chrom, cast(floor(pos / 12000000) as int) as part, min(pos) as start_pos, max(pos) as end_pos from v_track group by chrom, cast(floor(pos / 12000000) as int)"""),
    "v_model_segments": (["v_segments"], """
        select sample_id, b, r + (length % 7 - 3) / cast(400 as double) as r, length from (
          select sample_id, n as length, round((1 - 0.7 + cast(0.7 as double) * maj) / (2 - 2 * 0.7 + cast(0.7 as double) * (maj + mnr)), 6) as b,
            round(log2((2 - 2 * 0.7 + cast(0.7 as double) * (maj + mnr)) / (2 - 2 * 0.7 + cast(0.7 as double) * 2.4)), 6) as r
          from (select sample_id, n, 1 + n % 3 as maj, case when n % 5 < 3 then 1 else 0 end as mnr from v_segments) s) t"""),
    "v_lost": (["events"], """
        select 's1' as sample_id, cast(user_id % 22 + 1 as string) as chrom, 25000000 + 5 * least(event_id, 4000) + 25000 * greatest(0, least(event_id, 5200) - 4000)
            + 5 * greatest(0, least(event_id, 7000) - 5200) + 51 * greatest(0, least(event_id, 9000) - 7000) + 5 * greatest(0, event_id - 9000) as pos,
          not (event_id between 7000 and 9000) as is_het, round(case when event_id between 7000 and 9000 then -1.5 else 0.0 end + (value - 50) / 5000, 6) as logr
        from events"""),
    "v_vcf": (["v_haplotypes"], """
        select sample_id, chrom, pos, ref, alt, concat(cast(hap1 as string), case when (cast(pos / 5000 as bigint)) % 5 = 0 then '/' else '|' end, cast(hap2 as string)) as gt,
          cast(floor(pos / 1000000) as int) as ps, cast((cast(pos / 5000 as bigint)) % 43 as int) as ad_ref, cast((cast(pos / 5000 as bigint)) % 47 as int) as ad_alt from v_haplotypes"""),
    "v_phased": (["v_vcf", "v_samples"], """
        select s.sample_id, v.chrom, v.pos, v.ref, v.alt, cast((cast(v.pos / 5000 as bigint) + s.k * cast(floor(cast(v.pos / 5000 as bigint) / 50) as bigint)) % 2 as int) as bit,
          v.ps + s.k as ps, (cast(v.pos / 5000 as bigint)) % (9 + s.k) <> 0 as phased from v_vcf v cross join v_samples s where substr(v.gt, 1, 1) <> substr(v.gt, 3, 1)"""),
    "v_cohort": (["events", "v_samples"], """
        select sample_id, k, chrom, pos, depth, least(depth, greatest(0, cast(round(depth * case when bit = 1 then up else 1 - up end) as int) + jitter)) as alt, guess as hap1, 1 - guess as hap2, bit
        from (
          select sample_id, k, chrom, pos, bit, jitter, guess, cast(round(45 * (cast(0.6 as double) + cast(0.7 as double) * (maj + mnr))) as int) + jitter as depth,
            case when side = 1 then 1 - (cast(0.3 as double) + cast(0.7 as double) * maj) / (cast(0.6 as double) + cast(0.7 as double) * (maj + mnr))
              else (cast(0.3 as double) + cast(0.7 as double) * maj) / (cast(0.6 as double) + cast(0.7 as double) * (maj + mnr)) end as up
          from (
            select s.sample_id, s.k, cast(e.c as string) as chrom, event_id * 5000 as pos, (event_id * 7 % 11) % 2 as bit, cast(event_id % 5 as int) - 2 as jitter,
              ((event_id * 7 % 11) % 2 + cast(floor(event_id / 900) as bigint)) % 2 as guess, case when e.c % 5 = 0 and s.k = 1 then 1 else 0 end as side,
              case when e.c % 3 = 0 then 2 else 1 + cast(e.c % 5 = 0 as int) end as maj, case when e.c % 3 = 0 then e.c % 2 else 1 end as mnr
            from (select event_id, user_id % 22 + 1 as c from events) e cross join v_samples s) t) u"""),
    "v_svs": (["events"], """
        select cast(user_id % 22 + 1 as string) as chrom, event_id * 5000 as pos,
          case when event_id % 2 = 0 then concat('N[', cast((user_id + 3) % 22 + 1 as string), ':', cast(event_id * 4000 as string), '[')
            else concat(']', cast((user_id + 5) % 22 + 1 as string), ':', cast(event_id * 3000 as string), ']N') end as alt,
          concat('CHR2=', cast((user_id + 7) % 22 + 1 as string), ';END=', cast(event_id * 2000 as string), case when event_id % 3 = 0 then ';TRDS=' when event_id % 3 = 1 then ';TRDS=r1' else ';TRDS=r1,r2' end) as info
        from events"""),
    "v_array": (["v_track"], """
        select sample_id, concat(case when (cast(pos / 5000 as bigint)) % 3 = 0 then 'CN_' else 'SNP_' end, cast(pos as string)) as probe_id, chrom, pos,
          round(baf - 0.02, 6) as normal_baf, baf as tumour_baf, logr as tumour_lrr, round(logr / 2, 6) as normal_lrr,
          substr('ACGT', cast((cast(pos / 5000 as bigint)) % 4 + 1 as int), 1) as allele_a, substr('ACGT', cast((cast(pos / 5000 as bigint) + 2) % 4 + 1 as int), 1) as allele_b,
          case when (cast(pos / 5000 as bigint)) % 4 = 1 then '-' else '+' end as strand from v_track"""),
    "v_panel": (["v_track"], """
        select chrom, concat('rs', cast(pos as string)) as snp_id, pos, substr('ACGT', cast((cast(pos / 5000 as bigint)) % 4 + 1 as int), 1) as a0,
          substr('ACGT', cast((cast(pos / 5000 as bigint) + 1 + (cast(pos / 5000 as bigint)) % 2) % 4 + 1 as int), 1) as a1 from v_track where (cast(pos / 5000 as bigint)) % 9 <> 4"""),
    "v_bases": (["lineitem"], """
        select 's1' as sample_id, cast(l_suppkey % 22 + 1 as string) as chrom, l_orderkey as pos, substr('ACGT', cast(l_partkey % 4 + 1 as int), 1) as base,
          cast(l_quantity as int) as base_qual, cast(20 + l_linenumber * 5 as int) as map_qual from lineitem"""),
}
def needed(names: list[str]) -> list[str]:
    """The views that these need, in an order in which each can be made."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for x in VIEWS[name][0]:
                add(x)
            out.append(name)

    for n in names:
        add(n)
    return out


#: Views whose rounded means are of doubles.
MEANS = {"v_segments", "v_baf_segmented", "v_seg6"}


def spark_text(name: str) -> str:
    """The view's SQL for Spark. DuckDB rounds the product of a double with 10^6, Spark the double's shortest decimal form, so that means halfway
    between two numbers of six digits came out apart by one in the last: rounded means are written as that product."""
    sql = VIEWS[name][1]
    for start in [m.start() for m in re.finditer(r"round\((avg|stddev_samp)\(", sql)][::-1] if name in MEANS else []:
        depth, end = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, digits = sql[start + len("round(") : end - 1].rsplit(",", 1)
        sql = f"{sql[:start]}round(({inner}) * 1e{int(digits)}D) / 1e{int(digits)}D{sql[end:]}"
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables in sf_dir; temporary views are bound when they are read, so several folders can be used in turn."""
    for table in ("events", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for v in needed([name]):
        spark.sql(spark_text(v)).createOrReplaceTempView(v)
    return spark.table(name)


def with_views(sql: str, names: list[str], more: str = "") -> str:
    """The oracle's text: the views as common table expressions, then any of its own, before sql."""
    parts = [f"{v} as ({VIEWS[v][1]})" for v in needed(names)] + ([more] if more else [])
    return f"with {', '.join(parts)} {sql}" if parts else sql
