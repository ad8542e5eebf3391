"""Metal sites: first-shell geometry, filters, verdicts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.scratch import stored

from . import atoms as A
from . import clusters as C
from . import neighbors as N
from .atoms import STRUCTURE

CENTER = [*STRUCTURE, "c_line_no"]


def coord_string(shell: DataFrame, by: list[str] = CENTER) -> DataFrame:
    """Element histogram of each shell as sorted ``<n><El>`` parts."""
    n = shell.groupBy(*by, A.symbol(F.col("element")).alias("el")).agg(F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.concat(F.col("n").cast("string"), F.col("el"))))
    return n.groupBy(*by).agg(F.array_join(parts, "").alias("coord_string"))


def distances(shell: DataFrame, by: list[str] = CENTER) -> DataFrame:
    """CN, population deviation and range of the distances."""
    return shell.groupBy(*by).agg(F.count("*").alias("CN"), F.stddev_pop("d").alias("sigma_d"), (F.max("d") - F.min("d")).alias("delta_d"))


def angles(shell: DataFrame, by: list[str] = CENTER) -> DataFrame:
    """Array of the angles of all neighbour pairs at each centre, in line order.

    A shell is a few atoms, gathered per centre: no self-join and no second shuffle."""
    v = F.struct("line_no", *[(F.col(k) - F.col("c_" + k)).alias(k) for k in ("x", "y", "z")])
    s = shell.groupBy(*by).agg(F.sort_array(F.collect_list(v)).alias("_v"))
    pair = F.flatten(F.transform("_v", lambda a, i: F.transform(F.filter("_v", lambda b: b["line_no"] > a["line_no"]), lambda b: G.angle(G.of(a), G.of(b), 0.0))))
    return s.select(*by, pair.alias("angles"))


def plane(shell: DataFrame, by: list[str] = CENTER) -> DataFrame:
    """RMS distance of the neighbours from their best plane: the root of the smallest
    eigenvalue of their covariance. Three or fewer points are always in a plane."""
    cov = {a + b: F.covar_pop(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    s = shell.groupBy(*by).agg(F.count("*").alias("_n"), *[c.alias("_" + k) for k, c in cov.items()])
    low = G.smallest_eigenvalue(*[F.col("_" + k) for k in cov])
    return s.select(*by, F.when(F.col("_n") <= 3, 0.0).otherwise(F.sqrt(F.greatest(low, F.lit(0.0)))).alias("RMS_plane"))


def _mean(array: str, k: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v[k]) / F.size(array)


def geometry(shell: DataFrame, by: list[str] = CENTER) -> DataFrame:
    """All metrics and the label of each shell, distorted labels ending in ``_d``."""
    v = F.struct("line_no", *[(F.col(k) - F.col("c_" + k)).alias(k) for k in ("x", "y", "z")])
    cov = {a + b: F.covar_pop(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    s = shell.groupBy(*by).agg(
        F.count("*").alias("CN"), F.stddev_pop("d").alias("sigma_d"), (F.max("d") - F.min("d")).alias("delta_d"),
        F.sort_array(F.collect_list(v)).alias("_v"), *[c.alias("_" + k) for k, c in cov.items()],
    )
    low = G.smallest_eigenvalue(*[F.col("_" + k) for k in cov])
    pair = F.flatten(F.transform("_v", lambda a, i: F.transform(F.filter("_v", lambda b: b["line_no"] > a["line_no"]), lambda b: G.angle(G.of(a), G.of(b), 0.0))))
    s = s.withColumn("_low", low).withColumn("RMS_plane", F.when(F.col("CN") <= 3, 0.0).otherwise(F.sqrt(F.greatest("_low", F.lit(0.0))))).withColumn("_a", pair)
    s = s.withColumn("_n", G.plane_normal(*[F.col("_" + k) for k in cov], F.col("_low")))
    mean = {k: _mean("_v", k) for k in ("x", "y", "z")}
    s = s.withColumn("_m", F.struct(*[c.alias(k) for k, c in mean.items()]))
    off = F.array_max(F.transform("_v", lambda v: F.abs(G.dot(G.minus(G.of(v), G.of(F.col("_m"))), G.of(F.col("_n"))))))
    s = s.withColumn("h_max", F.when((F.col("CN") <= 3) | F.col("_n").isNull(), 0.0).otherwise(off))

    def rms(ideal: Column | float) -> Column:
        total = F.aggregate("_a", F.lit(0.0), lambda acc, a: acc + (a - ideal) * (a - ideal))
        return F.when(F.size("_a") > 0, F.sqrt(total / F.size("_a"))).otherwise(0.0)

    planar, axial = F.col("RMS_plane") <= 0.35, F.exists("_a", lambda a: a >= 160)
    s = s.withColumns({
        "RMS_theta": rms(F.lit(109.47)),
        "MAX_angle_dev": F.coalesce(F.array_max(F.transform("_a", lambda a: F.abs(a - 109.47))), F.lit(0.0)),
        "planar": planar, "axial": axial, "_base": G.label(F.col("CN"), planar, axial, F.array_max("_a")),
    })
    picked = G.ideal_angle(F.col("_base"))
    bad = picked.isNotNull() & ((rms(picked) > 20) | (F.col("sigma_d") > 0.15) | ((F.col("RMS_plane") > 0.35) & F.col("_base").isin("SQP", "TP")))
    s = s.withColumn("distorted", bad).withColumn("JT", (F.col("CN") == 6) & (F.col("delta_d") >= 0.2))
    label = F.when(F.col("distorted"), F.concat("_base", F.lit("_d"))).otherwise(F.col("_base"))
    return s.select(*by, "CN", label.alias("label"), "sigma_d", "delta_d", "RMS_theta", "MAX_angle_dev", "RMS_plane", "h_max", "planar", "axial", "distorted", "JT")


def coordination_summary(shell: DataFrame, by: list[str] = CENTER) -> DataFrame:
    """Per centre and element: count, nearest and farthest, any water, residue labels."""
    return shell.groupBy(*by, A.symbol(F.col("element")).alias("element")).agg(
        F.count("*").alias("count"), F.bround(F.min("d"), 3).alias("rmin"), F.bround(F.max("d"), 3).alias("rmax"),
        F.bool_or(F.upper("resname").isin("HOH", "WAT")).alias("is_water"), F.sort_array(F.collect_set(A.residue_label())).alias("residues"),
    )


# -- filters ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MustHave:
    """``min_counts`` must all hold; then any or all of the bare elements."""

    mode: str = "any"
    elements: tuple[str, ...] = ()
    min_counts: tuple[tuple[str, int], ...] = ()

    def condition(self, element: Column) -> Column:
        """Aggregate condition over a shell's element column."""
        up = F.upper(element)
        n = lambda e: F.coalesce(F.sum((up == e).cast("int")), F.lit(0))
        out = F.lit(True)
        for e, k in self.min_counts:
            out = out & (n(e) >= k)
        if self.elements:
            parts = [n(e) > 0 for e in self.elements]
            joined = parts[0]
            for p in parts[1:]:
                joined = (joined & p) if self.mode == "all" else (joined | p)
            out = out & joined
        return out

    def __str__(self) -> str:
        prefix = "ALL:" if self.mode == "all" and not self.min_counts else ""
        bare = prefix + ",".join(sorted(self.elements)) if self.elements else ""
        return " ".join([*(f"{e}>={k}" for e, k in sorted(self.min_counts)), *filter(None, [bare])]) or "none"


#: An optional mode, then terms: an element, or an element with its least count. A term is whole words.
_MODE = re.compile(r"\s*(?:(?P<mode>any|all)\s*:)?(?P<terms>.*)", re.I | re.S)
_TERM = re.compile(r"(?:^|(?<=[,\s]))(?P<element>[A-Za-z]{1,2})(?:>=(?P<count>\d+))?(?=[,\s]|$)")


def parse_must_have(text: str | None) -> MustHave:
    """``N,S`` any of; ``ALL:N,S`` all of; ``S>=2`` counts. Other terms ask for nothing, and so do null, blank
    and ``none``."""
    m = _MODE.match(text or "")
    terms = [] if m["terms"].strip().lower() == "none" and not m["mode"] else list(_TERM.finditer(m["terms"]))
    counts = tuple((t["element"].upper(), int(t["count"])) for t in terms if t["count"])
    return MustHave((m["mode"] or "any").lower() if counts or terms else "any", tuple(t["element"].upper() for t in terms if not t["count"]), counts)


@dataclass(frozen=True)
class LigandRequirement:
    """Exactly ``count`` shell atoms of these residues and atom names (all names if none)."""

    resnames: tuple[str, ...]
    count: int
    atom_names: tuple[str, ...] = field(default=())

    def hits(self) -> Column:
        hit = F.upper("resname").isin(*[r.upper() for r in self.resnames]) if self.resnames else F.lit(False)
        if self.atom_names:
            hit = hit & F.upper("atom_name").isin(*[a.upper() for a in self.atom_names])
        return F.coalesce(F.sum(hit.cast("int")), F.lit(0))

    def condition(self) -> Column:
        return (self.hits() == self.count) if self.resnames else F.lit(False)


def ligand_diagnostics(shell: DataFrame, req: LigandRequirement, by: list[str] = CENTER) -> DataFrame:
    """Counts with and without the atom names, and whether only the naming is off."""
    any_name = LigandRequirement(req.resnames, req.count)
    out = shell.groupBy(*by).agg(req.hits().alias("count_allowed"), any_name.hits().alias("count_any_resname"))
    missing = F.col("count_allowed") != req.count
    return out.withColumns({"missing": missing, "naming_mismatch": missing & (F.col("count_any_resname") == req.count)})


def cluster_selection(labelled: DataFrame, atoms: DataFrame, radius: float) -> DataFrame:
    """``structure, root`` and the atoms of the residues that have an atom within ``radius``
    of any metal of the cluster."""
    key = [*STRUCTURE, "_r", "chain", "resseq"]
    near = N.within(labelled.select(*STRUCTURE, "root", "x", "y", "z"), atoms, radius)
    near = near.select(*STRUCTURE, F.col("c_root").alias("root"), F.upper("resname").alias("_r"), "chain", "resseq").distinct()
    return atoms.withColumn("_r", F.upper("resname")).join(near, key).drop("_r")


def around(centers: DataFrame, selection: DataFrame) -> DataFrame:
    """Centre keys and the atoms of their cluster's selection but the centre (by serial)."""
    c = centers.select(*STRUCTURE, "root", F.col("line_no").alias("c_line_no"), F.col("serial").alias("c_serial"))
    return c.join(selection, [*STRUCTURE, "root"]).where("serial <> c_serial").drop("c_serial")


def verdicts(centers: DataFrame, shell: DataFrame, must_have: MustHave | None = None, ligands: tuple[LigandRequirement, ...] = (), coord: tuple[str, ...] = (), selection: DataFrame | None = None) -> DataFrame:
    """Per centre the first reason to reject it, in order must_have, ligand_requirements,
    coord_string; null if it is kept. Centres without a shell count as empty shells.

    Must-have elements may be anywhere in ``selection`` (as ``around`` has it); only ligand
    requirements and coordination strings look at the shell."""
    must_have = must_have or MustHave()
    asked = bool(must_have.elements or must_have.min_counts)
    if asked and selection is None:
        raise ValueError("must-have elements need the selection around each centre")
    ok_ligand = F.lit(True)
    for r in ligands:
        ok_ligand = ok_ligand & r.condition()
    keys = centers.select(*STRUCTURE, F.col("line_no").alias("c_line_no"))
    tests = keys.join(shell, CENTER, "left").groupBy(*CENTER).agg(ok_ligand.alias("_l"))
    if asked:
        has = keys.join(selection.select(*CENTER, "element"), CENTER, "left").groupBy(*CENTER).agg(must_have.condition(F.col("element")).alias("_m"))
        tests = tests.join(has, CENTER)
    else:
        tests = tests.withColumn("_m", F.lit(True))
    tests = tests.join(coord_string(shell), CENTER, "left")
    ok_coord = F.coalesce("coord_string", F.lit("")).isin(*coord) if coord else F.lit(True)
    reason = F.when(~F.col("_m"), "must_have").when(~F.col("_l"), "ligand_requirements").when(~ok_coord, "coord_string")
    return tests.select(*CENTER, F.coalesce("coord_string", F.lit("")).alias("coord_string"), reason.alias("reason"))


def rejections(verdict: DataFrame) -> DataFrame:
    """Reason counts, most frequent first."""
    return verdict.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


# -- the whole path -----------------------------------------------------------------------------


@dataclass(frozen=True)
class SiteConfig:
    target: str = "ZN"
    cutoff: float = 5.0
    radius: float = 6.0
    low: float = 2.0
    high: float = 2.8
    include_waters: bool = True
    excluded: tuple[str, ...] = ()
    must_have: MustHave = MustHave()
    ligands: tuple[LigandRequirement, ...] = ()
    coord: tuple[str, ...] = ()


def labelled_metals(atoms: DataFrame, config: SiteConfig) -> DataFrame:
    """Metals of collapsed atoms with the root of their cluster, written once: numbers, targets, selections and
    reports all start from them."""
    return stored(C.components(A.metals(atoms, config.excluded), config.cutoff), "metals")


def sites(raw: DataFrame, config: SiteConfig = SiteConfig()) -> DataFrame:
    """One row per kept target atom: cluster, shell, geometry, siblings. A centre without a
    shell has CN 0 and label ``UNK``, and counts as planar."""
    atoms = stored(A.collapse_altloc(raw), "atoms")
    return _sites(atoms, labelled_metals(atoms, config), config)


def _sites(atoms: DataFrame, labelled: DataFrame, config: SiteConfig) -> DataFrame:
    table = C.cluster_table(labelled, config.target).select(*STRUCTURE, "root", "cluster_number", "cluster_type")
    centers = C.targets(labelled, config.target).join(table, [*STRUCTURE, "root"])
    wet = A.water_toggle(atoms, config.include_waters)
    shell = N.coordination(centers.select(*STRUCTURE, "line_no", "serial", "x", "y", "z"), wet, config.low, config.high)
    selection = around(centers, cluster_selection(labelled, wet, config.radius))
    verdict = verdicts(centers, shell, config.must_have, config.ligands, config.coord, selection).where("reason is null")
    out = centers.select(*STRUCTURE, F.col("line_no").alias("c_line_no"), "serial", "chain", "resseq", "resname", "root", "cluster_number", "cluster_type", "siblings")
    out = out.join(verdict.drop("reason"), CENTER).join(geometry(shell), CENTER, "left")
    zero = {k: F.coalesce(k, F.lit(0.0)) for k in ("sigma_d", "delta_d", "RMS_theta", "MAX_angle_dev", "RMS_plane", "h_max")}
    flag = {k: F.coalesce(k, F.lit(k == "planar")) for k in ("planar", "axial", "distorted", "JT")}
    return out.withColumns({"CN": F.coalesce("CN", F.lit(0)), "label": F.coalesce("label", F.lit("UNK")), **zero, **flag})


def cluster_rows(raw: DataFrame, config: SiteConfig = SiteConfig(cutoff=3.0, radius=3.0)) -> DataFrame:
    """The batch report: one row per centre of homo and multi_homo clusters, one on the
    first target of multi_hetero clusters, with the other metals of the cluster and the centre's own columns."""
    atoms = stored(A.collapse_altloc(raw), "atoms")
    labelled = labelled_metals(atoms, config)
    s = _sites(atoms, labelled, config)
    first = F.row_number().over(Window.partitionBy(*STRUCTURE, "cluster_number").orderBy("c_line_no"))
    s = s.withColumn("_k", first).where("cluster_type <> 'multi_hetero' or _k = 1").drop("_k")
    others = C.other_metals(labelled).withColumnRenamed("line_no", "c_line_no")
    center = labelled.select(*STRUCTURE, F.col("line_no").alias("c_line_no"), "element", "atom_name", "icode", "altloc", "occ")
    return s.join(others, CENTER, "left").withColumn("other_metals", F.coalesce("other_metals", F.lit(""))).join(center, CENTER)
