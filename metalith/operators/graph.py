"""Graph and assignment operators: rings, donor classes, shells, hydrogens, matching."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G

from .atoms import STRUCTURE

#: Valences that hydrogens fill up.
VALENCE = {"H": 1, "C": 4, "N": 3, "O": 2, "F": 1, "P": 3, "S": 2, "CL": 1, "BR": 1, "I": 1}


def both_ways(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    ways = F.array(F.struct(F.col(a).alias("i"), F.col(b).alias("j")), F.struct(F.col(b).alias("i"), F.col(a).alias("j")))
    return edges.select(*STRUCTURE, F.explode(ways).alias("_e")).select(*STRUCTURE, "_e.i", "_e.j")


def rings(edges: DataFrame, size: int = 5) -> DataFrame:
    """Cycles of ``size`` nodes, each once: begun at its smallest node, towards the smaller
    of its two neighbours. ``edges``: (i, j), one row per bond."""
    e = both_ways(edges)
    path = e.where("i < j").select(*STRUCTURE, F.array("i", "j").alias("p"))
    for _ in range(size - 2):
        step = e.select(*STRUCTURE, F.col("i").alias("_t"), F.col("j").alias("_n"))
        path = path.withColumn("_t", F.element_at("p", -1)).join(step, [*STRUCTURE, "_t"])
        path = path.where((F.col("_n") > F.col("p")[0]) & ~F.array_contains("p", F.col("_n"))).select(*STRUCTURE, F.concat("p", F.array("_n")).alias("p"))
    close = e.select(*STRUCTURE, F.col("i").alias("_t"), F.col("j").alias("_h"))
    path = path.withColumns({"_t": F.element_at("p", -1), "_h": F.col("p")[0]}).join(close, [*STRUCTURE, "_t", "_h"], "left_semi")
    return path.where(F.col("p")[1] < F.element_at("p", -1)).select(*STRUCTURE, F.col("p").alias("ring"))


def ring_nitrogens(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nitrogens in pairs that share carbons: of each its best partner (most shared carbons,
    then nearest), and whether it is the one with a carbon that reaches outside the ring.

    ``nodes``: line_no, element, x, y, z. A nitrogen next to such a carbon is ND, the other NE."""
    e = both_ways(edges)
    el = nodes.select(*STRUCTURE, "line_no", "element", "x", "y", "z")
    c = e.join(el.where("element = 'C'").select(*STRUCTURE, F.col("line_no").alias("j")), [*STRUCTURE, "j"])
    at = el.where("element = 'N'").select(*STRUCTURE, F.col("line_no").alias("i"), "x", "y", "z")
    degree = c.groupBy(*STRUCTURE, "i").agg(F.count("*").alias("deg"))
    outside = e.join(degree.where("deg >= 2").select(*STRUCTURE, F.col("i").alias("j")), [*STRUCTURE, "j"], "left_semi").groupBy(*STRUCTURE, "i").agg(F.count("*").alias("outer"))
    carbon = c.join(at.select(*STRUCTURE, "i"), [*STRUCTURE, "i"], "left_semi").distinct()
    n = at.join(outside, [*STRUCTURE, "i"], "left").withColumn("outer", F.coalesce("outer", F.lit(0)))
    side = lambda p: n.select(*STRUCTURE, *[F.col(k).alias(p + k) for k in ("i", "x", "y", "z", "outer")])
    # partners are found by the carbons themselves, not among all nitrogens of a structure
    both = carbon.select(*STRUCTURE, "j", F.col("i").alias("a_i")).join(carbon.select(*STRUCTURE, "j", F.col("i").alias("b_i")), [*STRUCTURE, "j"]).where("a_i <> b_i")
    shared = both.groupBy(*STRUCTURE, "a_i", "b_i").agg(F.count("*").cast("int").alias("shared"))
    pair = shared.join(side("a_"), [*STRUCTURE, "a_i"]).join(side("b_"), [*STRUCTURE, "b_i"])
    best = pair.groupBy(*STRUCTURE, F.col("a_i").alias("n")).agg(
        F.max_by(F.struct("b_i", "shared", "a_outer", "b_outer"), F.struct("shared", (-G.d2(G.at("a_"), G.at("b_"))).alias("q"), (-F.col("b_i")).alias("t"))).alias("m")
    )
    kind = F.when(F.col("m.a_outer") > F.col("m.b_outer"), "ND").when(F.col("m.a_outer") < F.col("m.b_outer"), "NE").otherwise(F.when(F.col("n") < F.col("m.b_i"), "ND").otherwise("NE"))
    return best.select(*STRUCTURE, "n", F.col("m.b_i").alias("partner"), F.col("m.shared").alias("shared"), kind.alias("kind"))


def _nearest(nodes: DataFrame, center: DataFrame, k: int) -> DataFrame:
    """``structure, c_line_no, line_no, element, q, rank``: the k nodes nearest to each centre, by distance, then line.

    A structure's nodes are one row that its centres meet, so a task holds one centre's candidates, not all pairs to be sorted."""
    whole = nodes.groupBy(*STRUCTURE).agg(F.collect_list(F.struct("line_no", "element", "x", "y", "z")).alias("_all"))
    c = center.select(*STRUCTURE, F.struct("line_no", "x", "y", "z").alias("c"))
    far = F.transform(F.filter("_all", lambda a: a["line_no"] != F.col("c.line_no")), lambda a: F.struct(G.d2(G.of(F.col("c")), G.of(a)).alias("q"), a["line_no"].alias("line_no"), a["element"].alias("element")))
    near = c.join(whole, STRUCTURE).select(*STRUCTURE, F.col("c.line_no").alias("c_line_no"), F.posexplode(F.slice(F.sort_array(far), 1, k)).alias("_p", "a"))
    return near.select(*STRUCTURE, "c_line_no", "a.line_no", "a.element", "a.q", (F.col("_p") + 1).alias("rank"))


def imidazole_ring(nodes: DataFrame, center: DataFrame) -> DataFrame:
    """The four atoms nearest to each nitrogen: two adjacent, two opposite."""
    return _nearest(nodes, center, 4).select(*STRUCTURE, "c_line_no", "line_no", F.when(F.col("rank") <= 2, "adjacent").otherwise("opposite").alias("place"))


def closest(nodes: DataFrame, center: DataFrame, k: int = 4) -> DataFrame:
    """The k nearest S and N of each centre."""
    return _nearest(nodes.where(F.upper("element").isin("S", "N")), center, k).select(*STRUCTURE, "c_line_no", "line_no", "element", "rank", F.sqrt("q").alias("d"))


def reachable(edges: DataFrame, start: DataFrame, goal: DataFrame, depth: int = 4) -> DataFrame:
    """First goal atom on the bonds from each start, at most ``depth`` bonds away: the
    nearest by bonds, the smallest on ties. A frontier of bounded depth, not a closure."""
    e = both_ways(edges)
    front = start.select(*STRUCTURE, F.col("line_no").alias("s"), F.col("line_no").alias("i"), F.lit(0).alias("hops"))
    seen = front
    for k in range(1, depth + 1):
        front = front.join(e, [*STRUCTURE, "i"]).select(*STRUCTURE, "s", F.col("j").alias("i"), F.lit(k).alias("hops")).distinct()
        front = front.join(seen.select(*STRUCTURE, "s", "i"), [*STRUCTURE, "s", "i"], "left_anti")
        seen = seen.unionByName(front)
    hit = seen.join(goal.select(*STRUCTURE, F.col("line_no").alias("i")), [*STRUCTURE, "i"], "left_semi").where("hops > 0")
    return hit.groupBy(*STRUCTURE, "s").agg(F.min(F.struct("hops", "i")).alias("m")).select(*STRUCTURE, F.col("s").alias("start"), F.col("m.i").alias("goal"), F.col("m.hops").alias("hops"))


def hydrogens(nodes: DataFrame, edges: DataFrame, coordinated: Column | None = None) -> DataFrame:
    """Hydrogens that each atom lacks by its valence and bonds; a histidine's ND1 and NE2 have
    one unless coordinated, a coordinated cysteine SG none."""
    valence = F.create_map(*[F.lit(v) for kv in VALENCE.items() for v in kv])
    degree = both_ways(edges).groupBy(*STRUCTURE, F.col("i").alias("line_no")).agg(F.count("*").alias("deg"))
    out = nodes.join(degree, [*STRUCTURE, "line_no"], "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    need = F.greatest(F.coalesce(F.element_at(valence, F.upper("element")), F.lit(0)) - F.col("deg"), F.lit(0))
    held = F.coalesce(coordinated if coordinated is not None else F.lit(False), F.lit(False))
    his = (F.upper("resname") == "HIS") & (F.col("element") == "N") & F.col("atom_name").isin("ND1", "NE2")
    cys = (F.upper("resname") == "CYS") & (F.col("element") == "S") & (F.col("atom_name") == "SG")
    return out.withColumn("n_h", F.when(his, F.when(held, 0).otherwise(1)).when(cys & held, 0).otherwise(need).cast("long"))


def assignment(costs: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of the k! one-to-one assignments the one with the least total; the first in order on
    ties. ``costs``: by, i, j (0..k-1), cost. For k up to 4."""
    cell = F.map_from_entries(F.collect_list(F.struct((F.col("i") * k + F.col("j")).cast("int").alias("key"), F.col("cost").alias("value"))))
    grid = costs.groupBy(*by).agg(cell.alias("m"), F.count("*").alias("n")).where(F.col("n") == k * k)
    options = F.array(*[F.array(*map(F.lit, p)) for p in permutations(range(k))])
    total = lambda p: F.aggregate(F.transform(p, lambda j, i: F.element_at("m", i * k + j)), F.lit(0.0), lambda a, v: a + v)
    best = F.array_min(F.transform(options, lambda p: F.struct(total(p).alias("total"), p.alias("perm"))))
    return grid.select(*by, best.alias("b")).select(*by, F.col("b.perm").alias("perm"), F.col("b.total").alias("total"))


def greedy_match(a: DataFrame, b: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Each a in row order takes the nearest b still free within the tolerance, the smallest id on ties.

    Pairs within the tolerance are found by blocks of four tolerances in each group (null keys are one group). The order makes the choice
    sequential, but only over those pairs: a task reads its groups one pair after the other and keeps the ids taken in one group.

    ``a``: by, a_id, a_x, a_y, a_z; ``b`` likewise; ids occur once in a group."""
    import pyarrow as pa

    reach = tolerance * (1 + 1e-9) + 1e-9
    block = lambda k, off=0.0: F.floor((F.col(k) + off) / (4 * reach))
    keys = [f"_g{n}" for n in range(len(by))]
    side = lambda t, p: t.select(*[F.col(c).alias(g if p == "a_" else "_" + g) for c, g in zip(by, keys, strict=True)], *[F.col(p + k) for k in ("id", "x", "y", "z")])
    left, right = side(a, "a_"), side(b, "b_").withColumns({f"_b{k}": block(f"b_{k}") for k in "xyz"})
    for k in "xyz":
        left = left.withColumn(f"_a{k}", F.explode(F.sequence(block(f"a_{k}", -reach), block(f"a_{k}", reach))))
    on = G.d2(G.at("a_"), G.at("b_")) <= tolerance * tolerance
    for k in "xyz":
        on = on & (F.col(f"_a{k}") == F.col(f"_b{k}"))
    for g in keys:
        on = on & F.col(g).eqNullSafe(F.col("_" + g))
    pairs = left.join(right, on).select(*keys, "a_id", "b_id", G.d2(G.at("a_"), G.at("b_")).alias("q"))
    ordered = pairs.repartition(*keys).sortWithinPartitions(*keys, "a_id", "q", "b_id")

    def chosen(batches):
        group, last, taken = None, None, set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "a_id", "b_id")]
            keep = []
            for row in zip(*columns, strict=True):
                if row[:-2] != group:
                    group, last, taken = row[:-2], None, set()
                if row[-2] != last and row[-1] not in taken:
                    last = row[-2]
                    taken.add(row[-1])
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    out = ordered.mapInArrow(chosen, ordered.schema)
    return out.select(*[F.col(g).alias(c) for g, c in zip(keys, by, strict=True)], "a_id", "b_id", F.sqrt("q").alias("d"))


def rotations(points: DataFrame, alphas: list[float], betas: list[float], gammas: list[float]) -> DataFrame:
    """Points turned by each triple of angles about y, x, z in turn."""
    grid = [F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"), F.lit(float(c)).alias("gamma")) for a in alphas for b in betas for c in gammas]
    out = points.withColumn("_g", F.explode(F.array(*grid))).select(*points.columns, "_g.alpha", "_g.beta", "_g.gamma")
    one = tuple(F.lit(float(i == 0)) for i in range(3)), tuple(F.lit(float(i == 1)) for i in range(3)), tuple(F.lit(float(i == 2)) for i in range(3))
    for axis, angle in ((one[1], "alpha"), (one[0], "beta"), (one[2], "gamma")):
        v = G.rotated(G.at(), axis, F.col(angle))
        out = out.withColumns(dict(zip("xyz", v, strict=True)))
    return out


# -- turns of a ring about its nitrogen ------------------------------------------------------------


def ring_frames(rings: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, ux, uy, uz``: the nitrogen that coordinates and an orthonormal frame of each ring.

    ``rings``: by, ``m`` (the metal's place), ``n`` (the nitrogen's), ``ring`` (places of all ring atoms), structs of x, y, z. y
    goes from metal to nitrogen; z is the ring's normal without its part along y; x is z cross y. The normal's sign, which the
    ring leaves open, is such that its first component that is not 0 is positive. A ring whose normal lies along y has no
    frame of its own and gets one from the direction to the ring's mean."""
    r = rings.select(*by, "m", "n", "ring", F.struct(*[_mean_of("ring", k).alias(k) for k in "xyz"]).alias("_m"))
    r = r.withColumns({"_" + a + b: _moment("ring", a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")})
    cov = [F.col("_" + k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")]
    r = r.withColumn("_low", G.smallest_eigenvalue(*cov)).withColumn("_n", G.plane_normal(*cov, F.col("_low")))
    unit = lambda v: tuple(c / G.norm(v) for c in v)
    st = lambda v: F.struct(*[c.alias(k) for k, c in zip("xyz", v, strict=True)])
    r = r.withColumn("uy", st(unit(G.minus(G.of(F.col("n")), G.of(F.col("m"))))))
    y, raw = G.of(F.col("uy")), G.of(F.col("_n"))
    sign = F.when(raw[0] != 0, F.signum(raw[0])).when(raw[1] != 0, F.signum(raw[1])).otherwise(F.signum(raw[2]))
    flat = tuple(sign * (a - G.dot(raw, y) * b) for a, b in zip(raw, y, strict=True))
    side = G.minus(G.of(F.col("_m")), G.of(F.col("n")))
    spare = G.cross(y, tuple(a - G.dot(side, y) * b for a, b in zip(side, y, strict=True)))
    r = r.withColumns({"_flat": st(flat), "_spare": st(spare)})
    z = F.when(G.norm(G.of(F.col("_flat"))) > 1e-8, F.col("_flat")).otherwise(F.col("_spare"))
    r = r.withColumn("_z", z).withColumn("uz", st(unit(G.of(F.col("_z")))))
    return r.withColumn("ux", st(unit(G.cross(G.of(F.col("uz")), y)))).select(*by, "n", "ux", "uy", "uz")


def _mean_of(array: str, k: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v[k]) / F.size(array)


def _moment(array: str, a: str, b: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda t, v: t + (v[a] - F.col(f"_m.{a}")) * (v[b] - F.col(f"_m.{b}"))) / F.size(array)


def angle_sets(alphas: list[float], betas: list[float], gammas: list[float]) -> list[tuple[float, float, float]]:
    """Lists of angles side by side; a list of one goes with all of the others."""
    n = max(len(alphas), len(betas), len(gammas))
    if not all(len(v) in (1, n) for v in (alphas, betas, gammas)):
        raise ValueError("lists of angles must have one entry or as many as the longest")
    return [tuple(float(v[i % len(v)]) for v in (alphas, betas, gammas)) for i in range(n)]


def turned(atoms: DataFrame, frames: DataFrame, by: list[str], sets: list[tuple[float, float, float]]) -> DataFrame:
    """``atoms`` (by, x, y, z) once per set of angles (``nth, alpha, beta, gamma``), turned about the nitrogen of their
    frame: alpha about its y, then beta about x, then gamma about z, all of the frame before any turn."""
    grid = F.array(*[F.struct(F.lit(i).alias("nth"), *[F.lit(v).alias(k) for k, v in zip(("alpha", "beta", "gamma"), s, strict=True)]) for i, s in enumerate(sets)])
    out = atoms.join(frames, by).withColumn("_g", F.explode(grid)).select(*atoms.columns, "_g.*", "n", "ux", "uy", "uz")
    out = out.withColumns({k: F.col(k) - F.col(f"n.{k}") for k in "xyz"})
    for axis, angle in (("uy", "alpha"), ("ux", "beta"), ("uz", "gamma")):
        out = out.withColumns(dict(zip("xyz", G.rotated(G.at(), G.of(F.col(axis)), F.col(angle)), strict=True)))
    return out.withColumns({k: F.col(k) + F.col(f"n.{k}") for k in "xyz"}).drop("n", "ux", "uy", "uz")


# -- alignment of residue paths --------------------------------------------------------------------

#: Atoms that a histidine's frame may use beside its donor, in this order.
FRAME_ATOMS = ("CB", "CG", "CD2", "NE2", "CE1", "ND1", "CA")


def _places(names, places, rows, donors):
    """Dense places of atoms: ``(at, has, donor)`` of len(donors) residues. ``names`` and ``places`` (n x 3) are those of all atoms, ``rows`` tells whose."""
    import numpy as np

    known = {n: i for i, n in enumerate(dict.fromkeys([*FRAME_ATOMS, *donors, *names]))}
    at, has = np.zeros((len(donors), len(known), 3)), np.zeros((len(donors), len(known)), dtype=bool)
    column = np.array([known[n] for n in names], dtype=np.int64)
    at[rows, column], has[rows, column] = places, True
    return at, has, np.array([known[n] for n in donors], dtype=np.int64)


def _frames(at, has, donor):
    """``(frames, found)``: orthonormal columns of each residue, towards the donor, then towards the first other atom of FRAME_ATOMS (the first
    columns of ``at``) that is not in line."""
    import numpy as np

    length = lambda v: np.sqrt((v * v).sum(-1))
    rows = np.arange(len(at))
    seed = at[rows, donor]
    with np.errstate(all="ignore"):
        first = seed / length(seed)[:, None]
        second, found = np.zeros_like(first), np.zeros(len(at), dtype=bool)
        for k in range(len(FRAME_ATOMS)):
            flat = at[:, k] - (at[:, k] * first).sum(-1)[:, None] * first
            far = length(flat)
            take = ~found & has[:, k] & (donor != k) & (far != 0)
            second[take], found = flat[take] / far[take, None], found | take
        return np.stack([first, second, np.cross(first, second)], axis=-1), found & (length(seed) != 0)


def _seeds(cys, his):
    """Residues (rows x places) that may stand for the reference's seed: the odd one out, else cysteines, or all where all are alike."""
    import numpy as np

    nc, nh = cys.sum(1)[:, None], his.sum(1)[:, None]
    return np.where(nc == 1, cys, np.where(nh == 1, his, np.where((nc == 4) | (nh == 4), True, np.where(nc > 0, cys, his))))


def coordinating(atoms: DataFrame) -> DataFrame:
    """``source, rank, chain, resseq, kind, donor, names, places``: of each source the four CYS and HIS whose donor (SG; the
    nearer of ND1 and NE2) is nearest to the origin, with the atoms that alignment looks at."""
    r = atoms.where(F.col("resname").isin("CYS", "HIS")).groupBy("source", "chain", "resseq").agg(F.min_by("resname", "line_no").alias("kind"), F.map_from_entries(F.collect_list(F.struct("atom_name", F.struct("x", "y", "z")))).alias("m"))
    q = lambda name: F.when(F.try_element_at("m", F.lit(name)).isNotNull(), G.dot(*[G.of(F.try_element_at("m", F.lit(name)))] * 2))
    his = F.when(q("ND1").isNull() | (q("NE2") < q("ND1")), "NE2").otherwise("ND1")
    r = r.withColumn("donor", F.when(F.col("kind") == "CYS", "SG").otherwise(his)).where(F.array_contains(F.map_keys("m"), F.col("donor")))
    r = r.withColumn("q", F.element_at("m", F.col("donor"))).withColumn("q", G.dot(G.of(F.col("q")), G.of(F.col("q"))))
    w = Window.partitionBy("source").orderBy("q", "chain", "resseq")
    r = r.withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    used = F.map_filter("m", lambda k, v: F.when(F.col("kind") == "CYS", k.isin("SG", "CB", "CA")).otherwise(k.isin(*FRAME_ATOMS)))
    return r.select("source", "rank", "chain", "resseq", "kind", "donor", F.map_keys(used).alias("names"), F.transform(F.map_values(used), lambda v: F.array(v["x"], v["y"], v["z"])).alias("places"))


def aligned_paths(residues: DataFrame, reference: str) -> DataFrame:
    """Each source's residues (as ``coordinating`` gives them) laid over those of the source ``reference``: ``source,
    resseq, chain, against`` (the reference's residue it stands for, from 0), ``seed, total, names, places`` turned.

    The reference's seed is its only CYS or only HIS, else its nearest CYS, else its nearest residue; it comes first. A source tries
    each residue that may be the seed: its frame is turned onto the reference's, and of all orders of the others the
    one with the least sum of squared distances of atoms of one name counts, the first on ties. A source without a frame stays as it is.
    The reference is four residues; a source is one small row, and a task tries the orders of many sources at a time."""
    import numpy as np
    import pyarrow as pa

    cols = ("rank", "chain", "resseq", "kind", "donor", "names", "places")
    ref = sorted(residues.where(F.col("source") == reference).select(*cols).collect(), key=lambda r: r["rank"])  # four rows at most
    if not ref:
        raise ValueError("the reference has no coordinating residue")
    cys, his = ([r for r in ref if r["kind"] == k] for k in ("CYS", "HIS"))
    lead = cys[0] if len(cys) == 1 else his[0] if len(his) == 1 else (cys or ref)[0]
    ref = [lead, *(r for r in ref if r is not lead)]
    ref = [(r["chain"], r["resseq"], r["donor"], list(r["names"]), [[math.nan if v is None else v for v in p] for p in r["places"]]) for r in ref]
    own = [n for r in ref for n in r[3]], np.array([p for r in ref for p in r[4]]), np.repeat(range(len(ref)), [len(r[3]) for r in ref])
    at, has, donor = _places(*own, [r[2] for r in ref])
    base, found = _frames(at, has, donor)
    if not found[0]:
        raise ValueError("the reference's seed has no frame")
    base = base[0]

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, size = batch.column(0), np.asarray(batch.column(1).value_lengths())
        flat = batch.column(1).flatten()
        chain, resseq, names, places = (flat.field(c) for c in ("chain", "resseq", "names", "places"))
        first = np.cumsum(size) - size
        atoms = np.asarray(names.value_lengths())
        xyz = places.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        of = np.repeat(np.arange(len(flat)), atoms)
        # the reference's atoms stand behind the others, so that columns are shared
        at, has, donor = _places(names.flatten().to_pylist() + own[0], np.concatenate([xyz, own[1]]), np.concatenate([of, len(flat) + own[2]]), flat.field("donor").to_pylist() + [r[2] for r in ref])
        goal, known = at[len(flat) :], has[len(flat) :]
        frame, found = _frames(at, has, donor)
        kind = np.array(flat.field("kind").to_pylist(), dtype=object)
        cys, his = kind == "CYS", kind == "HIS"

        turn = np.tile(np.eye(3), (len(size), 1, 1))
        total, seed = np.full(len(size), np.nan), np.full(len(size), -1)
        order = np.tile(np.arange(len(ref)), (len(size), 1))
        held = np.minimum(size, len(ref))
        same = np.array([s == reference for s in source.to_pylist()])
        for n in set(held[~same].tolist()):
            s = np.flatnonzero(~same & (held == n))
            r = first[s][:, None] + np.arange(n)
            may, chosen = _seeds(cys[r], his[r]) & found[r], np.zeros(len(s), dtype=bool)
            for k in range(n):
                spin = base @ frame[r[:, k]].transpose(0, 2, 1)
                laid = np.einsum("sij,snaj->snai", spin, at[r])
                both = known[None, :n, None] & has[r][:, None]
                gap = np.where(both[..., None], goal[None, :n, None] - laid[:, None], 0.0)
                cost = (gap * gap).sum((-1, -2))
                for rest in permutations([i for i in range(n) if i != k]):
                    path = (k, *rest)
                    sums = sum(cost[:, a, i] for a, i in enumerate(path))
                    take = may[:, k] & (~chosen | (sums < total[s]))
                    t = s[take]
                    total[t], turn[t], seed[t], order[t, :n] = sums[take], spin[take], k, path
                    chosen |= take
        for s in np.flatnonzero(same):
            at_ = [(c, q) for c, q in zip(chain.slice(first[s], size[s]).to_pylist(), resseq.slice(first[s], size[s]).to_pylist(), strict=True)]
            order[s], total[s] = [at_.index(r[:2]) for r in ref], 0.0

        against = np.concatenate([np.arange(n) for n in held])
        whose = np.repeat(np.arange(len(size)), held)
        row = pa.array(first[whose] + order[whose, against])
        spun = np.einsum("mij,mj->mi", turn[np.repeat(np.arange(len(size)), size)][of], xyz)
        ends = pa.array(np.concatenate([[0], np.cumsum(atoms)]).astype(np.int32))
        triple = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(xyz) + 1, 3, dtype=np.int32)), pa.array(spun.reshape(-1)))
        out = [
            source.take(pa.array(whose)), chain.take(row), resseq.take(row), pa.array(against.astype(np.int32)), pa.array(seed[whose].astype(np.int32)),
            pa.array(total[whose], from_pandas=True), names.take(row), pa.ListArray.from_arrays(ends, triple).take(row),
        ]
        return pa.RecordBatch.from_arrays(out, ["source", "chain", "resseq", "against", "seed", "total", "names", "places"])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                yield some(batch.slice(k, 1024))

    ddl = "source string, chain string, resseq string, against int, seed int, total double, names array<string>, places array<array<double>>"
    whole = residues.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_r"))
    return whole.mapInArrow(run, ddl)
