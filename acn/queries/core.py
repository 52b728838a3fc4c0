"""name -> query, and name -> SQL, for every operator over the views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import stats
from ..operators import aggregates, calls, fit, intervals, loci, phasing, pseudonormal, regression, segmentation, tables, windows
from ..sources import readers, sinks
from ..sources import schemas as S
from ..sources.views import view, with_views
from ..storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, views: str, sql: str | None = None, more: str = ""):
    """Registers a function of (spark, the views named) under name, and its SQL over the same views and more
    common table expressions."""

    def add(f):
        names = views.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, *(view(spark, sf_dir, v) for v in names))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_views(sql, names, more)
        return f

    return add


def r6(c) -> F.col:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def text_table(spark, df: DataFrame, name: str, sep: str = "\t", header: bool = False) -> str:
    path = new_path(spark, name)
    df.write.options(sep=sep, header=header).csv(path)
    return path


# --- sources: a view is written in the file's form and read back -----------------------------------------------------------


@query("read_allele_counts", "v_counts", "select sample_id, chrom, pos, count_a, count_c, count_g, count_t, count_a + count_c + count_g + count_t as good_depth from v_counts")
def _(spark, counts):
    rows = counts.select(F.concat(F.lit("chr"), "chrom").alias("c"), "pos", *loci.COUNTS, sum((F.col(c) for c in loci.COUNTS[1:]), F.col("count_a")))
    return readers.read_allele_counts(spark, text_table(spark, rows, "counts"), "s1")


@query("read_track", "v_track", "select sample_id, chrom, pos, logr from v_track")
def _(spark, track):
    return readers.read_track(spark, text_table(spark, track.select("chrom", "pos", "logr"), "track", header=True), "s1")


@query("read_gc_covariates", "v_covariates", "select chrom, pos, " + ", ".join(f"round(gc_1kb + {i}, 6) as {c}" for i, c in enumerate(S.GC_COLUMNS)) + " from v_covariates")
def _(spark, cov):
    rows = cov.select(F.concat_ws("_", "chrom", F.col("pos").cast("string")), "chrom", "pos", *((F.col("gc_1kb") + i).alias(c) for i, c in enumerate(S.GC_COLUMNS)),
        *(F.lit(0.0).alias(f"x{i}") for i in range(6)))
    return rounded(readers.read_gc_covariates(spark, text_table(spark, rows, "gc", header=True)), *S.GC_COLUMNS)


@query("read_replication", "v_covariates", "select chrom, pos, " + ", ".join(f"round(rt_01 + {i}, 6) as {c}" for i, c in enumerate(S.REPLICATION_COLUMNS)) + " from v_covariates")
def _(spark, cov):
    rows = cov.select("chrom", "pos", *((F.col("rt_01") + i).alias(c) for i, c in enumerate(S.REPLICATION_COLUMNS)))
    return rounded(readers.read_replication(spark, text_table(spark, rows, "rt", header=True)), *S.REPLICATION_COLUMNS)


@query("read_baf_segmented", "v_baf_segmented", "select sample_id, chrom, pos, baf, baf_phased, baf_seg from v_baf_segmented")
def _(spark, seg):
    return readers.read_baf_segmented(spark, text_table(spark, seg.select("chrom", "pos", "baf", "baf_phased", "baf_seg"), "seg", header=True), "s1")


@query("read_haplotypes", "v_haplotypes", "select 'snp' || pos as snpidx, 'rs' || pos as rsidx, pos, ref, alt, hap1, hap2 from v_haplotypes")
def _(spark, haps):
    rows = haps.select(F.concat(F.lit("snp"), F.col("pos").cast("string")).alias("a"), F.concat(F.lit("rs"), F.col("pos").cast("string")).alias("b"), "pos", "ref", "alt", "hap1", "hap2")
    return readers.read_haplotypes(spark, text_table(spark, rows, "haps", sep=" "))


@query("read_genotype_input", "v_panel", "select snp_id as snp, snp_id as id, pos, a0, a1, cast(pos % 2 as int) as is_hom_ref, cast(1 - pos % 2 as int) as is_het, 0 as is_hom_alt from v_panel")
def _(spark, panel):
    rows = panel.select("snp_id", F.col("snp_id").alias("id"), "pos", "a0", "a1", (F.col("pos") % 2).alias("g0"), (1 - F.col("pos") % 2).alias("g1"), F.lit(0).alias("g2"))
    return readers.read_genotype_input(spark, text_table(spark, rows, "genotypes", sep=" "))


@query("read_phased_vcf", "v_vcf", "select chrom, pos, ref, alt, gt, ps, ad_ref, ad_alt from v_vcf")
def _(spark, vcf):
    path = new_path(spark, "vcf")
    sinks.phased_vcf_lines(vcf).select("value").write.text(path)
    return readers.read_phased_vcf(spark, path).select("chrom", "pos", "ref", "alt", "gt", "ps", F.get("ad", F.lit(0)).alias("ad_ref"), F.get("ad", F.lit(1)).alias("ad_alt"))


QUERIES["write_phased_vcf"] = lambda spark, d: _written_vcf(spark, view(spark, d, "v_vcf"))
ORACLE_SQL["write_phased_vcf"] = with_views(
    "select sample_id, chrom, chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || "
    "'GT:PS:AD' || chr(9) || gt || ':' || ps || ':' || ad_ref || ',' || ad_alt as value from v_vcf", ["v_vcf"])


def _written_vcf(spark, vcf):
    path = new_path(spark, "vcf-out")
    sinks.write_phased_vcf(vcf, path)
    return spark.read.schema("value string, sample_id string, chrom string").text(path).select("sample_id", "chrom", "value")


@query("read_generic_table", "v_track", "select chrom as \"my.chrom\", cast(pos as int) as pos, baf from v_track")
def _(spark, track):
    return readers.read_generic_table(spark, text_table(spark, track.select(F.col("chrom").alias("my chrom"), "pos", "baf"), "generic", header=True))


_MANIFEST = (
    "select chrom, 'l' || chrom as impute_legend, 'm' || chrom as genetic_map, 'h' || chrom as impute_hap, cast(start_pos as int) as start, cast(end_pos as int) as "
    "\"end\", cast(cast(chrom as int) % 2 as int) as is_par from v_spans"
)


def _manifest(spark, geometry):
    rows = geometry.select("chrom", F.concat(F.lit("l"), "chrom").alias("a"), F.concat(F.lit("m"), "chrom").alias("b"), F.concat(F.lit("h"), "chrom").alias("c"),
        "start_pos", "end_pos", (F.col("chrom").cast("int") % 2).alias("p"))
    return text_table(spark, rows, "manifest")


@query("read_region_manifest", "v_spans", f"select * from ({_MANIFEST}) t where is_par = 1")
def _(spark, spans):
    return readers.read_region_manifest(spark, _manifest(spark, spans), True)


@query("chromosome_list", "v_track", "select distinct chrom from v_track where chrom not in ('X', 'Y')")
def _(spark, track):
    return readers.chromosome_list(track, "cell_line")


@query("union_chromosome_files", "v_track", "select chrom, cast(pos as int) as pos, baf from v_track")
def _(spark, track):
    path = new_path(spark, "by-chrom")
    track.select("chrom", "pos", "baf").withColumn("c", F.concat(F.lit("chr"), "chrom")).drop("chrom").write.partitionBy("c").option("sep", "\t").csv(path)
    return readers.union_chromosome_files(spark, f"{path}/*", "pos bigint, baf double", r"c=chr([^/]+)/").select("chrom", "pos", "baf")


@query("union_region_files", "v_haplotypes", "select 'snp' || pos as snpidx, 'rs' || pos as rsidx, pos, ref, alt, hap1, hap2 from v_haplotypes")
def _(spark, haps):
    path = new_path(spark, "by-region")
    rows = haps.select(F.concat(F.lit("snp"), F.col("pos").cast("string")).alias("a"), F.concat(F.lit("rs"), F.col("pos").cast("string")).alias("b"), "pos", "ref",
        "alt", "hap1", "hap2", (F.col("pos") / 5e6).cast("int").alias("region"))
    rows.repartition("region").write.partitionBy("region").option("sep", " ").csv(path)  # one file a region, however many tasks hold its loci
    return readers.union_region_files(spark, f"{path}/*")


@query("read_snp_array_lrr_baf", "v_array", "select probe_id, normal_lrr, normal_baf, tumour_lrr, tumour_baf, chrom, pos from v_array")
def _(spark, array):
    rows = array.select("probe_id", F.lit("n").alias("name"), "normal_lrr", "normal_baf", "tumour_lrr", "tumour_baf")
    return readers.read_snp_array_lrr_baf(spark, text_table(spark, rows, "array", header=True), array.select("probe_id", "chrom", "pos"))


@query("read_breakpoints", "v_breakpoints", "select chrom, pos from v_breakpoints")
def _(spark, points):
    return readers.read_breakpoints(spark, text_table(spark, points.select(F.col("chrom").alias("chromosome"), F.col("pos").alias("position")), "breakpoints", header=True))


# --- sinks -------------------------------------------------------------------------------------------------------------------


def _parquet_back(spark, write, df, columns):
    path = new_path(spark, "out")
    write(df, path)
    return spark.read.option("basePath", path).parquet(path).select(*(F.col(c).cast("string").alias(c) if c == "chrom" else c for c in columns))


@query("write_tracks", "v_track", "select sample_id, chrom, pos, baf, logr from v_track")
def _(spark, track):
    return _parquet_back(spark, sinks.write_tracks, track, ["sample_id", "chrom", "pos", "baf", "logr"])


@query("write_logr_segmented", "v_baf_segmented", "select sample_id, chrom, pos, round(avg(logr) over (partition by sample_id, chrom, baf_seg), 4) as logr_seg from v_baf_segmented")
def _(spark, seg):
    means = seg.groupBy("sample_id", "chrom", "baf_seg").agg(F.round(F.avg("logr"), 4).alias("logr_seg"))
    return _parquet_back(spark, sinks.write_logr_segmented, seg.join(means, ["sample_id", "chrom", "baf_seg"]), ["sample_id", "chrom", "pos", "logr_seg"])


@query("write_baf_segmented", "v_baf_segmented", "select sample_id, chrom, pos, baf, baf_phased, baf_seg from v_baf_segmented")
def _(spark, seg):
    return _parquet_back(spark, sinks.write_baf_segmented, seg, ["sample_id", "chrom", "pos", "baf", "baf_phased", "baf_seg"])


_PROFILE = (
    "sample_id, chrom as chr, start_pos as startpos, end_pos as endpos, nMaj1 as \"nMaj1_A\", nMin1 as \"nMin1_A\", frac1 as \"frac1_A\", nMaj2 as \"nMaj2_A\", nMin2 as "
    "\"nMin2_A\", frac2 as \"frac2_A\""
)


def _text_back(spark, write, df, schema):
    path = new_path(spark, "text-out")
    write(df, path)
    return spark.read.options(sep="\t", header=True, nullValue="NA").schema(schema).csv(path)


@query("write_profile", "v_profile", f"select {_PROFILE} from v_profile")
def _(spark, profile):
    return _text_back(spark, sinks.write_profile, profile, sinks.profile_table(profile).schema)


@query("write_rho_psi", "v_fits", "select sample_id, method, rho, psi, ploidy, distance, is_best from v_fits")
def _(spark, rho_psi):
    return _text_back(spark, sinks.write_rho_psi, rho_psi, rho_psi.schema)


@query("load_rho_psi", "v_fits", "select sample_id, rho, psi as psi_t, distance as goodness from v_fits where method = 'FRAC_GENOME'")
def _(spark, rho_psi):
    return readers.load_rho_psi(rho_psi)


_TOTAL = "(case when frac1 < 1 then nMaj1 * frac1 + nMaj2 * frac2 else nMaj1 end + case when frac1 < 1 then nMin1 * frac1 + nMin2 * frac2 else nMin1 end)"


@query("write_purity_ploidy", "v_fit v_profile",
    f"select f.sample_id, f.rho as purity, round(p.ploidy, 6) as ploidy, round(f.rho * f.psi + 2 * (1 - f.rho), 6) as psi from v_fit f join (select sample_id, sum({_TOTAL} "
    f"* (end_pos - start_pos)) / sum(end_pos - start_pos) as ploidy from v_profile group by sample_id) p on f.sample_id = p.sample_id")
def _(spark, rho_psi, profile):
    t = rounded(sinks.purity_ploidy_table(readers.load_rho_psi(rho_psi), aggregates.ploidy_weighted(profile)), "ploidy", "psi")
    return _text_back(spark, sinks.write_purity_ploidy, t, t.schema)


@query("write_masking_details", "v_profile",
    "select sample_id, count(*) filter (where nMaj1 > 3 or nMin1 > 3) as n_masked, cast(sum(case when nMaj1 > 3 or nMin1 > 3 then end_pos - start_pos else 0 end) as "
    "bigint) as bases_masked from v_profile group by sample_id")
def _(spark, profile):
    t = aggregates.masking_details(aggregates.mask_high_states(profile, 3))
    return _text_back(spark, sinks.write_masking_details, t, t.schema)


@query("split_vcf_by_chrom", "v_vcf", "select sample_id, chrom, pos, gt from v_vcf")
def _(spark, vcf):
    return _parquet_back(spark, sinks.split_vcf_by_chrom, vcf, ["sample_id", "chrom", "pos", "gt"])


# --- filters -------------------------------------------------------------------------------------------------------------------

_MATCH = """(select t.sample_id, t.chrom, t.pos, [t.count_a, t.count_c, t.count_g, t.count_t][a.a0] t1, [t.count_a, t.count_c, t.count_g, t.count_t][a.a1] t2,
  [n.count_a, n.count_c, n.count_g, n.count_t][a.a0] n1, [n.count_a, n.count_c, n.count_g, n.count_t][a.a1] n2
  from v_counts t join v_normal_counts n on t.sample_id = n.sample_id and t.chrom = n.chrom and t.pos = n.pos join v_alleles a on t.chrom = a.chrom and t.pos = a.pos) m"""


@query("normalise_chrom", "v_track", "select case when c = '23' then 'X' else c end as chrom, pos from (select case when pos % 3 = 0 then '23' else chrom end as c, pos from v_track) t")
def _(spark, track):
    raw = track.select(F.when(F.col("pos") % 3 == 0, "chr23").otherwise(F.concat(F.lit("chr"), "chrom")).alias("chrom"), "pos")
    return loci.with_normal_chrom(raw)


@query("match_counts", "v_counts v_normal_counts v_alleles", f"select * from {_MATCH}")
def _(spark, t, n, a):
    return loci.match_counts(t, n, a)


@query("min_depth_filter", "v_counts v_normal_counts v_alleles", f"select * from {_MATCH} where n1 + n2 >= 20 and t1 + t2 >= 1")
def _(spark, t, n, a):
    return loci.min_depth_filter(loci.match_counts(t, n, a), 20)


_PICK = (
    "(select c.sample_id, c.chrom, c.pos, [c.count_a, c.count_c, c.count_g, c.count_t][a.a0] as ref, [c.count_a, c.count_c, c.count_g, c.count_t][a.a1] as alt from "
    "v_counts c join v_alleles a on c.chrom = a.chrom and c.pos = a.pos) p"
)


@query("pick_allele_counts", "v_counts v_alleles", f"select *, ref + alt as depth from {_PICK}")
def _(spark, c, a):
    return loci.pick_allele_counts(c, a)


_UNPAIRED = f"(select sample_id, chrom, pos, ref + alt as depth, alt / (ref + alt) as baf, log2((ref + alt) / avg(ref + alt) over (partition by sample_id)) as logr from {_PICK} where ref + alt > 0) u"


@query("baf_logr_unpaired", "v_counts v_alleles", f"select sample_id, chrom, pos, depth, round(baf, 6) as baf, round(logr, 6) as logr from {_UNPAIRED}")
def _(spark, c, a):
    return rounded(aggregates.baf_logr_unpaired(c, a), "baf", "logr")


@query("het_snp_filter_counts", "v_counts v_alleles",
    f"select sample_id, chrom, pos, depth, round(baf, 6) as baf, round(logr, 6) as logr from {_UNPAIRED} where baf between 0.1 and 0.9 and depth > 10")
def _(spark, c, a):
    return rounded(loci.het_snp_filter_counts(aggregates.baf_logr_unpaired(c, a)), "baf", "logr")


@query("het_snp_filter_haplotype", "v_haplotypes", "select * from v_haplotypes where hap1 <> hap2")
def _(spark, h):
    return loci.het_snp_filter_haplotype(h)


@query("het_snp_filter_array", "v_array", "select probe_id, normal_baf from v_array where normal_baf between 0.3 and 0.7")
def _(spark, a):
    return loci.het_snp_filter_array(a).select("probe_id", "normal_baf")


@query("drop_problem_loci", "v_counts v_alleles", "select * from v_counts c where not exists (select 1 from v_alleles a where a.chrom = c.chrom and a.pos = c.pos)")
def _(spark, c, a):
    return loci.drop_problem_loci(c, a)


@query("keep_listed_loci", "v_counts v_alleles", "select * from v_counts c where exists (select 1 from v_alleles a where a.chrom = c.chrom and a.pos = c.pos)")
def _(spark, c, a):
    return loci.keep_listed_loci(c, a)


@query("finite_logr", "v_track",
    "select * from (select chrom, pos, case when pos % 7 = 0 then null when pos % 11 = 0 then cast('inf' as double) else logr end as logr from v_track) t where logr is "
    "not null and not isinf(logr)")
def _(spark, t):
    return loci.finite_logr(t.select("chrom", "pos", F.when(F.col("pos") % 7 == 0, None).when(F.col("pos") % 11 == 0, float("inf")).otherwise(F.col("logr")).alias("logr")))


@query("dedupe_first", "v_bases", "select chrom, pos, min(base_qual) as base_qual from v_bases group by chrom, pos")
def _(spark, b):
    return loci.dedupe_first(b, ["chrom", "pos"], ["base_qual", "base"]).select("chrom", "pos", "base_qual")


@query("nonpar_x_filter", "v_track", "select 'X' as chrom, pos, logr from v_track where pos > 2781479 and pos < 155701383")
def _(spark, t):
    return loci.nonpar_x_filter(t.select(F.lit("X").alias("chrom"), "pos", "logr"), "hg38")


@query("biallelic_snv_filter", "v_vcf", "select chrom, pos, gt from v_vcf where gt in ('0|1', '1|0') and length(ref) = 1 and length(alt) = 1")
def _(spark, v):
    return loci.biallelic_snv_filter(v).select("chrom", "pos", "gt")


@query("drop_singleton_segments", "v_seg6", "select * from v_seg6 where length > 1")
def _(spark, s):
    return loci.drop_singleton_segments(s)


@query("strand_flip_alleles", "v_array",
    "select probe_id, case when strand = '-' then translate(allele_a, 'ACGT', 'TGCA') else allele_a end as allele_a, case when strand = '-' then translate(allele_b, "
    "'ACGT', 'TGCA') else allele_b end as allele_b from v_array")
def _(spark, a):
    return loci.strand_flip_alleles(a).select("probe_id", "allele_a", "allele_b")


# --- joins and intervals -----------------------------------------------------------------------------------------------------


@query("match_covariates", "v_track v_covariates", "select t.chrom, t.pos, t.logr, c.gc_1kb from v_track t join v_covariates c on t.chrom = c.chrom and t.pos = c.pos")
def _(spark, t, c):
    return loci.match_covariates(t, c.select("chrom", "pos", "gc_1kb")).select("chrom", "pos", "logr", "gc_1kb")


_GENO = (
    "(select c.sample_id, p.chrom, p.pos, p.snp_id, p.a0 as ref_allele, p.a1 as alt_allele, [c.count_a, c.count_c, c.count_g, c.count_t][strpos('ACGT', p.a0)] as ref, "
    "[c.count_a, c.count_c, c.count_g, c.count_t][strpos('ACGT', p.a1)] as alt from v_panel p join v_hap_counts c on p.chrom = c.chrom and p.pos = c.pos) g"
)


@query("join_genotype_counts", "v_panel v_hap_counts", f"select * from {_GENO}")
def _(spark, p, c):
    return loci.join_genotype_counts(p, c)


@query("genotype_from_normal", "v_panel v_hap_counts",
    f"select sample_id, chrom, pos, snp_id, ref_allele, alt_allele, cast(b <= 0.1 as int) as g0, cast(b > 0.1 and b < 0.9 as int) as g1, cast(b >= 0.9 as int) as g2 from "
    f"(select *, case when ref + alt = 0 then 0 else alt / (ref + alt) end as b from {_GENO}) t")
def _(spark, p, c):
    return phasing.genotype_from_normal(p, c)


@query("genotypes_to_vcf_rows", "v_panel v_hap_counts",
    f"select sample_id, chrom, pos, snp_id as id, ref_allele as ref, alt_allele as alt, case when b <= 0.1 then '0/0' when b < 0.9 then '0/1' else '1/1' end as gt from "
    f"(select *, case when ref + alt = 0 then 0 else alt / (ref + alt) end as b from {_GENO}) t")
def _(spark, p, c):
    return phasing.genotypes_to_vcf_rows(phasing.genotype_from_normal(p, c))


@query("genotype_from_array", "v_array", "select sample_id, chrom, pos, 0 as g0, 1 as g1, 0 as g2 from v_array where normal_baf between 0.3 and 0.7")
def _(spark, a):
    return phasing.genotype_from_array(a)


@query("vcf_rows_to_haplotypes", "v_vcf",
    "select sample_id, chrom, 'snp' || row_number() over w as snpidx, 'rs' || row_number() over w as rsidx, pos, ref, alt, cast(substr(gt, 1, 1) as int) as hap1, "
    "cast(substr(gt, 3, 1) as int) as hap2 from v_vcf where gt like '%|%' window w as (partition by sample_id, chrom order by pos)")
def _(spark, v):
    return phasing.vcf_rows_to_haplotypes(v)


@query("orient_array_alleles", "v_array v_panel",
    "select probe_id, round(case when allele_a = a0 then tumour_baf else 1 - tumour_baf end, 6) as baf from v_array a join v_panel p on a.chrom = p.chrom and a.pos = "
    "p.pos where (allele_a = a0 and allele_b = a1) or (allele_a = a1 and allele_b = a0)")
def _(spark, a, p):
    return rounded(loci.orient_array_alleles(a.withColumnRenamed("tumour_baf", "baf").join(p, ["chrom", "pos"])), "baf").select("probe_id", "baf")


@query("sync_segments_with_logr", "v_baf_segmented v_tracks",
    "select s.chrom, s.pos, s.baf_seg, t.logr from v_baf_segmented s join v_tracks t on s.sample_id = t.sample_id and s.chrom = t.chrom and s.pos = t.pos")
def _(spark, s, t):
    return loci.sync_segments_with_logr(s, t).select("chrom", "pos", "baf_seg", "logr")


@query("natural_join_samples", "v_tracks",
    "select chrom, pos, max(baf) filter (where sample_id = 's1') as v1, max(baf) filter (where sample_id = 's2') as v2, max(baf) filter (where sample_id = 's3') as v3 "
    "from v_tracks group by chrom, pos having count(*) = 3")
def _(spark, t):
    return loci.natural_join_samples(t, 3).select("chrom", "pos", *(F.get("values", F.lit(i)).alias(f"v{i + 1}") for i in range(3)))


@query("common_loci", "v_phased", "select chrom, pos, ref, alt from v_phased group by chrom, pos, ref, alt having count(distinct sample_id) = 3")
def _(spark, p):
    return loci.common_loci(p, 3)


_INSIDE = "select p.sample_id, p.chrom, p.pos, s.start_pos, s.end_pos from v_tracks p join v_segments s on p.sample_id = s.sample_id and p.chrom = s.chrom and p.pos "


@query("assign_points_to_intervals", "v_tracks v_segments", _INSIDE + ">= s.start_pos and p.pos <= s.end_pos")
def _(spark, p, s):
    return intervals.assign_points_to_intervals(p, s, strategy="bins").select("sample_id", "chrom", "pos", "start_pos", "end_pos")


@query("assign_points_half_open", "v_tracks v_segments", _INSIDE + "> s.start_pos and p.pos <= s.end_pos")
def _(spark, p, s):
    return intervals.assign_points_to_intervals(p, s, closed="right").select("sample_id", "chrom", "pos", "start_pos", "end_pos")


_OVERLAP = "a.chrom = b.chrom and a.start_pos <= b.end_pos and b.start_pos <= a.end_pos"


@query("interval_overlap", "v_intervals", f"""
  select a.chrom, a.sample_id, a.start_pos, a.end_pos, b.sample_id as b_sample_id, b.start_pos as b_start_pos, b.end_pos as b_end_pos from v_intervals a join v_intervals b on {_OVERLAP}""")
def _(spark, i):
    own = i.select("chrom", "sample_id", "start_pos", "end_pos")
    return intervals.interval_overlap(own, own)


_PIECES = """edges as (select chrom, start_pos as edge_at, 1 as d from v_intervals union all select chrom, end_pos + 1, -1 from v_intervals),
  points as (select chrom, edge_at, sum(d) as d from edges group by chrom, edge_at), swept as (select chrom, edge_at, sum(d) over (partition by chrom order by edge_at) as depth, lead(edge_at) over (partition by chrom order by edge_at) as nxt from points)"""


@query("interval_disjoin", "v_intervals", "select chrom, edge_at as start_pos, nxt - 1 as end_pos, cast(depth as bigint) as depth from swept where depth > 0 and nxt is not null", _PIECES)
def _(spark, i):
    return intervals.interval_disjoin(i)


@query("interval_count_overlaps", "v_intervals",
    "select a.chrom, a.start_pos, a.end_pos, count(*) as n from (select distinct chrom, start_pos, end_pos from v_intervals) a join v_intervals b on a.chrom = b.chrom and "
    "a.start_pos <= b.end_pos and b.start_pos <= a.end_pos group by a.chrom, a.start_pos, a.end_pos having count(*) > 1")
def _(spark, i):
    return intervals.interval_count_overlaps(i, i, least=2)


@query("interval_distance", "v_segments",
    "select chrom, start_pos, greatest(0, nxt - end_pos - 1) as gap from (select chrom, start_pos, end_pos, lead(start_pos) over (partition by sample_id, chrom order by "
    "start_pos) as nxt from v_segments) t where nxt is not null")
def _(spark, s):
    nxt = F.lead("start_pos").over(windows.ordered(order="start_pos"))
    return s.withColumn("nxt", nxt).filter("nxt is not null").select("chrom", "start_pos", sc.interval_distance("start_pos", "end_pos", "nxt", "nxt").alias("gap"))


@query("nearest_join", "v_track v_hets", """select p.chrom, p.pos, case when b.pos is null or (a.pos is not null and a.pos - p.pos < p.pos - b.pos) then a.pos else b.pos end as near_pos
  from v_track p asof left join (select * from v_hets where sample_id = 's1') b on p.chrom = b.chrom and p.pos >= b.pos asof left join (select * from v_hets where sample_id = 's1') a on p.chrom = a.chrom and p.pos <= a.pos""")
def _(spark, p, t):
    return intervals.nearest_join(p.select("sample_id", "chrom", "pos"), t.filter("sample_id = 's1'"), ["logr"]).select("chrom", "pos", "near_pos")


@query("segment_at_position", "v_segments", "select * from v_segments where chrom = '7' and start_pos <= 20000000 and end_pos >= 20000000")
def _(spark, s):
    return intervals.segment_at_position(s, "7", 20_000_000)


@query("centromere_exclusion", "v_track v_geometry",
    "select t.* from v_track t join v_geometry g on t.chrom = g.chrom where pos between start_pos and end_pos and (pos < cen_left - 500000 or pos > cen_right + 500000)")
def _(spark, t, g):
    return intervals.centromere_exclusion(t, g)


_ARMED = """armed as (select i.sample_id, i.chrom, i.arm, greatest(i.start_pos, i.s) as start_pos, least(i.end_pos, i.e) as end_pos from
  (select v.*, x.arm, x.s, x.e from v_intervals v join (select chrom, 'p' as arm, start_pos as s, cen_left as e from v_geometry union all select chrom, 'q', cen_right, end_pos from v_geometry) x on v.chrom = x.chrom) i where greatest(i.start_pos, i.s) <= least(i.end_pos, i.e)),
  marked as (select *, max(end_pos) over (partition by sample_id, chrom, arm order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from armed),
  runs as (select *, sum(case when reach is null or start_pos > reach + 1 then 1 else 0 end) over (partition by sample_id, chrom, arm order by start_pos, end_pos rows unbounded preceding) as run from marked),
  merged as (select sample_id, chrom, arm, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n from runs group by sample_id, chrom, arm, run)"""


_COMPLEMENT = """arms as (select s.sample_id, x.* from (select distinct sample_id from merged) s cross join (select chrom, 'p' as arm, start_pos as s, cen_left as e from v_geometry union all select chrom, 'q', cen_right, end_pos from v_geometry) x),
  cuts as (select sample_id, chrom, arm, start_pos, end_pos from merged union all select sample_id, chrom, arm, s - 1, s - 1 from arms),
  gaps as (select c.sample_id, c.chrom, c.arm, c.end_pos + 1 as start_pos, coalesce(lead(c.start_pos) over (partition by c.sample_id, c.chrom, c.arm order by c.start_pos) - 1, a.e) as end_pos from cuts c join arms a on a.sample_id = c.sample_id and a.chrom = c.chrom and a.arm = c.arm)"""


@query("interval_merge_adjacent", "v_intervals v_geometry", "select sample_id, chrom, arm, start_pos, end_pos, n from merged", _ARMED)
def _(spark, i, g):
    return intervals.interval_merge_adjacent(intervals.split_by_arm(i, g))


@query("complement_intervals", "v_intervals v_geometry", "select sample_id, chrom, arm, start_pos, end_pos from gaps where start_pos <= end_pos", f"{_ARMED}, {_COMPLEMENT}")
def _(spark, i, g):
    return intervals.complement_intervals(intervals.interval_merge_adjacent(intervals.split_by_arm(i, g)), g)


# --- aggregates ---------------------------------------------------------------------------------------------------------------

_BAF_LOGR = f"""(select sample_id, chrom, pos, case when t1 + t2 > 0 then case when pick = 1 then t1 else t2 end / (t1 + t2) end as baf, case when pick = 1 then n1 else n2 end / (n1 + n2) as normal_baf,
  (t1 + t2) / (n1 + n2) as ratio from (select *, strpos('0123456789abcdef', substr(md5(sample_id || '|' || chrom || '|' || pos), 1, 1)) % 2 as pick from {_MATCH} where n1 + n2 >= 10 and t1 + t2 >= 1) t) b"""


@query("baf_logr", "v_counts v_normal_counts v_alleles",
    f"select sample_id, chrom, pos, round(baf, 6) as baf, round(normal_baf, 6) as normal_baf, round(log2(ratio / avg(ratio) over (partition by sample_id)), 6) as logr from "
    f"{_BAF_LOGR}")
def _(spark, t, n, a):
    return rounded(aggregates.baf_logr(t, n, a), "baf", "normal_baf", "logr")


_COVS = ["gc_25bp", "gc_1kb", "gc_2kb", "gc_5kb", "gc_100kb", "rt_01", "rt_02"]
_JOINED = "(select t.sample_id, t.logr, c.* from v_track t join v_covariates c on t.chrom = c.chrom and t.pos = c.pos) j"
_CORR = " union all ".join(f"select sample_id, '{c}' as covariate, abs(corr({c}, logr)) as r from {_JOINED} group by sample_id" for c in _COVS)


@query("covariate_correlations", "v_track v_covariates", f"select sample_id, covariate, round(r, 6) as r from ({_CORR}) t")
def _(spark, t, c):
    return rounded(aggregates.covariate_correlations(loci.match_covariates(t, c), _COVS), "r")


@query("pick_covariates", "v_track v_covariates",
    f"select sample_id, max_by(covariate, r) filter (where covariate in ('gc_25bp', 'gc_1kb')) as short, max_by(covariate, r) filter (where covariate in ('gc_5kb', "
    f"'gc_100kb')) as long, max_by(covariate, r) filter (where covariate in ('rt_01', 'rt_02')) as replication from ({_CORR}) t group by sample_id")
def _(spark, t, c):
    corrs = aggregates.covariate_correlations(loci.match_covariates(t, c), _COVS)
    return aggregates.pick_covariates(corrs, ["gc_25bp", "gc_1kb"], ["gc_5kb", "gc_100kb"], ["rt_01", "rt_02"])


_RUNS = (
    "(select *, sum(case when prev is null or prev <> baf_seg then 1 else 0 end) over (partition by sample_id, chrom order by pos rows unbounded preceding) as run_id from "
    "(select *, lag(baf_seg) over (partition by sample_id, chrom order by pos) as prev from v_baf_segmented) t) r"
)


@query("run_islands", "v_baf_segmented", f"select sample_id, chrom, pos, cast(run_id as bigint) as run_id from {_RUNS}")
def _(spark, s):
    return windows.run_islands(s, "baf_seg").select("sample_id", "chrom", "pos", "run_id")


@query("segment_means", "v_baf_segmented",
    f"select sample_id, chrom, cast(run_id as bigint) as run_id, min(pos) as start_pos, max(pos) as end_pos, count(*) as n, round(avg(logr), 6) as mean_value from {_RUNS} "
    f"group by sample_id, chrom, run_id")
def _(spark, s):
    return rounded(aggregates.segment_means(s), "mean_value")


for _option, _sql in ((1, "median(baf_phased)"), (2, "avg(baf_phased)"), (3, "case when median(baf_phased) in (0.0, 1.0) then avg(baf_phased) else median(baf_phased) end")):
    @query(f"segment_baf_summary_{_option}", "v_baf_segmented",
        f"select sample_id, chrom, cast(run_id as bigint) as run_id, min(pos) as start_pos, max(pos) as end_pos, round({_sql}, 6) as baf from {_RUNS} group by sample_id, "
        f"chrom, run_id")
    def _(spark, s, option=_option):
        return rounded(aggregates.segment_baf_summary(s, option), "baf")


@query("segments_collapse", "v_baf_segmented", f"select sample_id, chrom, min(pos) as start_pos, max(pos) as end_pos, min(baf_seg) as baf_seg from {_RUNS} group by sample_id, chrom, run_id")
def _(spark, s):
    return aggregates.segments_collapse(s)


@query("segment_switchpoints", "v_baf_segmented",
    f"select sample_id, chrom, cast(run_id as bigint) as run_id, min(pos) as start_pos, max(pos) as end_pos, count(*) as n, round(avg(baf_phased), 6) as mean, "
    f"round(stddev_samp(baf_phased), 6) as sd, greatest(min(baf_seg), 1 - min(baf_seg)) as baf from {_RUNS} group by sample_id, chrom, run_id")
def _(spark, s):
    return rounded(calls.segment_switchpoints(s), "mean", "sd")


@query("segment_info", "v_baf_segmented",
    f"""select r.sample_id, r.chrom, cast(r.run_id as bigint) as run_id, r.b, r.n as length, r.start_pos, r.end_pos, p.size, round(p.mean, 6) as mean, round(p.sd, 6) as sd
  from (select sample_id, chrom, run_id, min(baf_seg) as b, count(*) as n, min(pos) as start_pos, max(pos) as end_pos from {_RUNS} group by sample_id, chrom, run_id) r
  join (select sample_id, baf_seg, count(*) as size, avg(baf_phased) as mean, stddev_samp(baf_phased) as sd from v_baf_segmented group by sample_id, baf_seg) p on p.sample_id = r.sample_id and p.baf_seg = r.b""")
def _(spark, s):
    info = aggregates.segment_info(s.withColumn("logr_seg", F.col("baf_seg") * 2))
    # BAF has six digits, so a mean may lie halfway between two numbers of six digits: the last bits of its sum mustn't decide
    return rounded(info.drop("r").withColumn("mean", F.round("mean", 12)), "mean", "sd")


_LEN = "(end_pos - start_pos)"


@query("ploidy_weighted", "v_profile", f"select sample_id, round(sum({_TOTAL} * {_LEN}) / sum({_LEN}), 6) as ploidy from v_profile group by sample_id")
def _(spark, p):
    return rounded(aggregates.ploidy_weighted(p), "ploidy")


@query("pga_is_clonal", "v_profile",
    f"select sample_id, round(1 - sum(case when frac1 < 1 then {_LEN} else 0 end) / sum(case when nMaj1 = 1 and nMin1 = 1 and frac1 = 1 then 0 else {_LEN} end), 6) as "
    f"clonal_share from v_profile group by sample_id")
def _(spark, p):
    return rounded(aggregates.pga_is_clonal(p), "clonal_share")


@query("mask_high_states", "v_profile", "select chrom, start_pos, case when nMaj1 > 3 or nMin1 > 3 then null else nMaj1 end as nMaj1, nMaj1 > 3 or nMin1 > 3 as masked from v_profile")
def _(spark, p):
    return aggregates.mask_high_states(p, 3).select("chrom", "start_pos", "nMaj1", "masked")


_COV = f"(select sample_id, chrom, pos, (t1 + t2) / median(t1 + t2) over (partition by sample_id) as tumour, (n1 + n2) / median(n1 + n2) over (partition by sample_id) as normal from {_MATCH}) c"


@query("coverage_normalised", "v_counts v_normal_counts v_alleles", f"select sample_id, chrom, pos, round(tumour, 6) as tumour, round(normal, 6) as normal from {_COV}")
def _(spark, t, n, a):
    return rounded(aggregates.coverage_normalised(loci.match_counts(t, n, a)), "tumour", "normal")


@query("array_probe_centering", "v_array",
    "select probe_id, probe_class, round(tumour_lrr - avg(tumour_lrr) over (partition by sample_id, probe_class), 4) as logr, case when tumour_baf <> 2 then tumour_baf "
    "end as baf from (select *, case when probe_id like 'CN%' then 'cn' else 'snp' end as probe_class from v_array) t")
def _(spark, a):
    return aggregates.array_probe_centering(a).select("probe_id", "probe_class", "logr", "baf")


@query("snp_density", "v_track", "select sample_id, chrom, round(1e6 * count(*) / (max(pos) - min(pos)), 6) as density from v_track group by sample_id, chrom")
def _(spark, t):
    return aggregates.snp_density(t).withColumn("density", r6(F.col("density") * 1e6))


@query("profile_summary", "v_profile",
    f"select sample_id, round(sum(case when (nMaj1 = 0 and nMin1 = 0) or (nMaj2 = 0 and nMin2 = 0) then {_LEN} else 0 end) / 1e6, 6) as hom_del_mb, round(sum(case when "
    f"frac1 < 1 then {_LEN} else 0 end) / sum({_LEN}), 6) as subclonal_share, count(*) filter (where frac1 between 0.48 and 0.52) as n_even from v_profile group by "
    f"sample_id")
def _(spark, p):
    return rounded(aggregates.profile_summary(p), "hom_del_mb", "subclonal_share")


@query("pileup_allele_counts", "v_bases",
    "select sample_id, chrom, pos, count(*) filter (where base = 'A') as count_a, count(*) filter (where base = 'C') as count_c, count(*) filter (where base = 'G') as "
    "count_g, count(*) filter (where base = 'T') as count_t, count(*) as good_depth from v_bases where base_qual >= 20 and map_qual >= 35 group by sample_id, chrom, pos")
def _(spark, b):
    return loci.pileup_allele_counts(b)


@query("panel_build", "v_panel", "select chrom, pos, snp_id, a0, a1, strpos('ACGT', a0) as i0, strpos('ACGT', a1) as i1 from v_panel where a0 <> a1")
def _(spark, p):
    return loci.panel_build(p)
