"""Column expressions of the copy-number model.

b: BAF of a segment, r: its LogR, rho: purity, psi_t: tumour ploidy, psi: ploidy of all cells, gamma: platform factor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def div(a, b) -> Column:
    """Null where b is 0."""
    return F.try_divide(col(a), col(b))


def normalise_chrom(chrom) -> Column:
    """Without a chr prefix, and X for 23."""
    plain = F.regexp_replace(col(chrom), "^chr", "")
    return F.when(plain == "23", "X").otherwise(plain)


def cn_alleles(b, r, rho, psi_t, gamma=1.0) -> tuple[Column, Column]:
    """(nA, nB): copies of either allele that explain b and r."""
    b, r, rho, psi_t = map(col, (b, r, rho, psi_t))
    all_copies = F.pow(F.lit(2.0), r / gamma) * ((1 - rho) * 2 + rho * psi_t)
    return (rho - 1 - (b - 1) * all_copies) / rho, (rho - 1 + b * all_copies) / rho


def cn_major_minor(b, r, rho, psi, gamma=1.0) -> tuple[Column, Column]:
    """(nMajor, nMinor) with psi of all cells and b at least 0.5."""
    b, r, rho, psi = map(col, (b, r, rho, psi))
    all_copies = psi * F.pow(F.lit(2.0), r / gamma)
    return (rho - 1 + b * all_copies) / rho, (rho - 1 + (1 - b) * all_copies) / rho


def _weighted(first, second) -> Column:
    two = F.col("frac1") < 1
    return F.when(two, F.col(first) * F.col("frac1") + F.col(second) * F.col("frac2")).otherwise(F.col(first))


def cn_total_major() -> Column:
    """Major copies over both populations of columns nMaj1, frac1, nMaj2, frac2."""
    return _weighted("nMaj1", "nMaj2")


def cn_total_minor() -> Column:
    return _weighted("nMin1", "nMin2")


def cn_total() -> Column:
    return cn_total_major() + cn_total_minor()


def psi_from_psit(rho, psi_t) -> Column:
    return col(rho) * col(psi_t) + 2 * (1 - col(rho))


def psit_from_psi(rho, psi) -> Column:
    return (col(psi) - 2 * (1 - col(rho))) / col(rho)


def logr_to_cn(purity, ploidy, logr) -> Column:
    return (col(ploidy) * F.pow(F.lit(2.0), col(logr)) - 2 * (1 - col(purity))) / col(purity)


def expected_baf(rho, n_maj, n_min) -> Column:
    """BAF of a state; 0.5 where no copy is left."""
    rho, n_maj, n_min = map(col, (rho, n_maj, n_min))
    return F.when((n_maj == 0) & (n_min == 0), 0.5).otherwise(div(1 - rho + rho * n_maj, 2 - 2 * rho + rho * (n_maj + n_min)))


def expected_logr(rho, psi, n_maj, n_min, gamma=1.0) -> Column:
    """LogR of a state under a tumour ploidy psi; null where no copy is left in a pure sample."""
    rho, psi, n_maj, n_min = map(col, (rho, psi, n_maj, n_min))
    ratio = div(2 - 2 * rho + rho * (n_maj + n_min), 2 - 2 * rho + rho * psi)
    return gamma * F.when(ratio > 0, F.log2(ratio))


def rho_psi_from_segment(b, r, n_maj, n_min, gamma=1.0) -> tuple[Column, Column, Column]:
    """(rho, psi of all cells, psi_t) if a segment of this b and r has this state."""
    b, r, n_maj, n_min = map(col, (b, r, n_maj, n_min))
    rho = div(2 * b - 1, 2 * b - b * (n_maj + n_min) - 1 + n_maj)
    psi = (rho * (n_maj + n_min) + 2 - 2 * rho) / F.pow(F.lit(2.0), r / gamma)
    return rho, psi, div(psi - 2 * (1 - rho), rho)


def psi_t_from_cn(total_cn, r, rho, gamma=1.0) -> Column:
    """Tumour ploidy under which a segment of this LogR has this total copy number."""
    total_cn, r, rho = map(col, (total_cn, r, rho))
    psi = (rho * total_cn + 2 - 2 * rho) / F.pow(F.lit(2.0), r / gamma)
    return (psi - 2 * (1 - rho)) / rho


# For each case of the segment's BAF l against the corner levels, and of its total against the square's
# diagonal, six pairs of states in order of preference, as offsets (major 1, minor 1, major 2, minor 2) from the floors.
EDGES = {
    ("above level 3", "low"): [(0, 0, 1, 0), (-1, 0, 1, 0), (0, 0, 2, 0), (1, 0, 1, 1), (1, -1, 1, 1), (1, 0, 1, 2)],
    ("above level 3", "high"): [(1, 0, 1, 1), (1, -1, 1, 1), (1, 0, 1, 2), (0, 0, 1, 0), (-1, 0, 1, 0), (0, 0, 2, 0)],
    ("above level 2", "low"): [(0, 0, 0, 1), (0, -1, 0, 1), (0, 0, 0, 2), (1, 0, 1, 1), (1, -1, 1, 1), (1, 0, 1, 2)],
    ("above level 2", "high"): [(1, 0, 1, 1), (1, -1, 1, 1), (1, 0, 1, 2), (0, 0, 0, 1), (0, -1, 0, 1), (0, 0, 0, 2)],
    ("below", "low"): [(0, 0, 0, 1), (0, -1, 0, 1), (0, 0, 0, 2), (0, 1, 1, 1), (-1, 1, 1, 1), (0, 1, 2, 1)],
    ("below", "high"): [(0, 1, 1, 1), (-1, 1, 1, 1), (0, 1, 2, 1), (0, 0, 0, 1), (0, -1, 0, 1), (0, 0, 0, 2)],
}


def _offsets(level2, level3, l, ntot, x, y) -> Column:
    literal = lambda rows: F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(r, ("m1", "n1", "m2", "n2"), strict=True))) for r in rows))
    low = ntot < x + y + 1
    pick = lambda case: F.when(low, literal(EDGES[case, "low"])).otherwise(literal(EDGES[case, "high"]))
    return F.when(l > level3, pick("above level 3")).when(l > level2, pick("above level 2")).otherwise(pick("below"))


def candidate_edges(level2, level3, l, ntot, x, y) -> Column:
    """Six structs (m1, n1, m2, n2): pairs of states in order of preference; all null where one is negative. Levels are the corners' BAF in
    ascending order: 2 is (ceiling major, ceiling minor), 3 (floor, floor); x and y are the floors of minor and major."""
    level2, level3, l, ntot, x, y = map(col, (level2, level3, l, ntot, x, y))

    def shifted(e: Column) -> Column:
        values = {"m1": y + e["m1"], "n1": x + e["n1"], "m2": y + e["m2"], "n2": x + e["n2"]}
        good = F.least(*values.values()) >= 0
        return F.struct(*(F.when(good, v).alias(k) for k, v in values.items()))

    return F.transform(_offsets(level2, level3, l, ntot, x, y), shifted)


def nearest_edge(rho, b, n_major, n_minor) -> Column:
    """The pair of states of first preference, whatever its sign."""
    rho, b, n_major, n_minor = map(col, (rho, b, n_major, n_minor))
    x, y = F.floor(n_minor).cast("double"), F.floor(n_major).cast("double")
    level2, level3 = expected_baf(rho, F.ceil(n_major), F.ceil(n_minor)), expected_baf(rho, y, x)
    low = n_major + n_minor < x + y + 1
    pair = lambda a, c: F.struct((y + a[0]).alias("m1"), (x + a[1]).alias("n1"), (y + c[0]).alias("m2"), (x + c[1]).alias("n2"))
    high = pair((1, 0), (1, 1))
    return (
        F.when(b > level3, F.when(low, pair((0, 0), (1, 0))).otherwise(high))
        .when(b > level2, F.when(low, pair((0, 0), (0, 1))).otherwise(high))
        .otherwise(F.when(low, pair((0, 0), (0, 1))).otherwise(pair((0, 1), (1, 1))))
    )


def rescue_negative_minor(n_major, n_minor, l, cap=1000.0) -> tuple[Column, Column]:
    """Lifts a negative minor to 0.01, and the major in proportion along the line of equal BAF; cap where l is 1 or the major is negative."""
    n_major, n_minor, l = map(col, (n_major, n_minor, l))
    lifted = n_major + div(l * (0.01 - n_minor), 1 - l)
    major = F.when(n_minor < 0, F.when((l == 1) | (lifted < 0), F.lit(float(cap))).otherwise(lifted)).otherwise(n_major)
    return major, F.when(n_minor < 0, 0.01).otherwise(n_minor)


def two_state_fraction(l, rho, m1, n1, m2, n2) -> Column:
    """The share of the first of two states that gives BAF l; null where both give the same."""
    l, rho, m1, n1, m2, n2 = map(col, (l, rho, m1, n1, m2, n2))
    top = 1 - rho + rho * m2 - 2 * l * (1 - rho) - l * rho * (n2 + m2)
    return div(top, l * rho * (n1 + m1) - l * rho * (n2 + m2) - rho * m1 + rho * m2)


def t_statistic(n, mean, sd, mu) -> Column:
    """Null where sd is 0."""
    return div((col(mean) - col(mu)) * F.sqrt(col(n)), sd)


def welch_statistic(n1, m1, s1, n2, m2, s2) -> tuple[Column, Column]:
    """(t, degrees of freedom) of two samples with unequal variances."""
    v1, v2 = col(s1) * col(s1) / col(n1), col(s2) * col(s2) / col(n2)
    return div(col(m1) - col(m2), F.sqrt(v1 + v2)), div((v1 + v2) * (v1 + v2), v1 * v1 / (col(n1) - 1) + v2 * v2 / (col(n2) - 1))


def logr_pvalue(r, level, max_dist) -> Column:
    return F.when(F.abs(col(r) - col(level)) < max_dist, 1.0).otherwise(0.0)


def interval_distance(a_start, a_end, b_start, b_end) -> Column:
    """Bases between two closed intervals; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), col(b_start) - col(a_end) - 1, col(a_start) - col(b_end) - 1)


def sv_end_from_alt(alt) -> tuple[Column, Column]:
    """(chrom, pos) of the other end, from a breakend such as N[5:1234[ or ]5:1234]N; null if alt isn't one."""
    find = lambda i: F.nullif(F.regexp_extract(col(alt), r"[\[\]](?:chr)?([^:\[\]]+):(\d+)[\[\]]", i), F.lit(""))
    return find(1), find(2).cast("bigint")


def sv_end_from_info(info) -> tuple[Column, Column]:
    """(chrom, pos) from CHR2= and END= entries."""
    find = lambda key, kind: F.nullif(F.regexp_extract(col(info), rf"(?:^|;){key}=({kind})", 1), F.lit(""))
    return F.regexp_replace(find("CHR2", "[^;]+"), "^chr", ""), find("END", r"\d+").cast("bigint")


def sv_support(info) -> Column:
    """The number of comma-separated read ids in the TRDS= entry."""
    ids = F.regexp_extract(col(info), "TRDS=([^;]*)", 1)
    return F.when(ids == "", 0).otherwise(F.size(F.split(ids, ",")))


def allele_letter_to_index(a) -> Column:
    """1 to 4 for A, C, G, T, else 0."""
    return F.call_function("instr", F.lit("ACGT"), F.upper(col(a)))


def reliability(b, r, rho, psi, gamma=1.0) -> dict[str, Column]:
    """States rounded from b and r, what they give back, and how well, from 0 to 100."""
    b, r, rho, psi = map(col, (b, r, rho, psi))
    a_full, b_full = cn_alleles(b, r, rho, psi, gamma)
    n_a, n_b = F.greatest(F.bround(a_full), F.lit(0.0)), F.greatest(F.bround(b_full), F.lit(0.0))
    total = rho * (n_a + n_b) + (1 - rho) * 2
    back_r = gamma * F.when(total > 0, F.log2(total / ((1 - rho) * 2 + rho * psi)))
    back_b = div(1 - rho + rho * n_b, 2 - 2 * rho + rho * (n_a + n_b))
    bounded = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    conf_r = F.when(F.abs(back_r) > 0.15, bounded(100 * (1 - div(F.abs(back_r - r), F.abs(r)))))
    conf_b = F.when(back_b != 0.5, bounded(F.when(b == 0.5, 100.0).otherwise(100 * (1 - div(F.abs(back_b - b), F.abs(b - 0.5))))))
    return {"nA": n_a, "nB": n_b, "back_baf": back_b, "back_logr": back_r, "conf_baf": conf_b, "conf_logr": conf_r,
        "confidence": F.when(conf_r.isNull(), conf_b).when(conf_b.isNull(), conf_r).otherwise((conf_r + conf_b) / 2)}


def refit_position(start, end) -> Column:
    """The middle of a segment in Mb, rounded up."""
    return F.ceil((col(start) + (col(end) - col(start)) / 2) / 1e6).cast("double")
