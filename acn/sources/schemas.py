"""Schemas of the tables, and fixed values of two genome builds."""

from __future__ import annotations


ALLELE_COUNTS = "chrom string, pos bigint, count_a int, count_c int, count_g int, count_t int, good_depth int"
ALLELES = "pos bigint, a0 int, a1 int"
TRACK = "chrom string, pos bigint, value double"
BAF_SEGMENTED = "chrom string, pos bigint, baf double, baf_phased double, baf_seg double"
HAPLOTYPES = "snpidx string, rsidx string, pos bigint, ref string, alt string, hap1 int, hap2 int"
GENOTYPES = "snp string, id string, pos bigint, a0 string, a1 string, is_hom_ref int, is_het int, is_hom_alt int"
VCF = "chrom string, pos bigint, id string, ref string, alt string, qual string, filter string, info string, format string, sample string"
REGIONS = "chrom string, impute_legend string, genetic_map string, impute_hap string, start bigint, end bigint, is_par int"
RHO_PSI = "method string, rho double, psi double, ploidy double, distance double, is_best boolean"
GC_WINDOWS = ["25bp", "50bp", "100bp", "200bp", "500bp", "1kb", "2kb", "5kb", "10kb", "20kb", "50kb", "100kb"]
GC_COLUMNS = [f"gc_{w}" for w in GC_WINDOWS]
REPLICATION_COLUMNS = [f"rt_{i:02d}" for i in range(1, 16)]
#: Six solutions of a segment, and the fields of each, in the order of the extended profile.
SOLUTIONS = "ABCDEF"
SOLUTION_FIELDS = ["nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2", "SDfrac", "SDfrac_BS", "frac1_0.025", "frac1_0.975"]

# Chromosome, first base covered, centromere left and right, end, of builds hg19 and hg38 (public genome geometry).
# Only the rows that the operators' rules mention by number are told apart elsewhere: 13, 14, 15, 21 and 22 are acrocentric.
ACROCENTRIC = ["13", "14", "15", "21", "22"]
#: Pseudo-autosomal bounds of X: loci strictly between them aren't shared with Y.
NONPAR_X = {"hg19": (2699520, 154931044), "hg38": (2781479, 155701383)}
#: What a male X is segmented over, and its centromere.
MALE_X = {"hg19": (2699520, 155260560), "hg38": (2781479, 156030895)}
X_CENTROMERE = {"hg19": (58632012, 61632012), "hg38": (58605580, 62412542)}
