"""Range joins in three dimensions.

All are equi-joins on the structure with the distance as a residual predicate; the small
side (metals, centres) is left to the planner, which broadcasts it only by its measured
size. For structures of tens of thousands of atoms ``cell`` adds grid cells to the key:
the small side is copied to the 27 cells around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.schema import DONORS

from .atoms import STRUCTURE


def prefixed(df: DataFrame, prefix: str, keys: list[str] = STRUCTURE) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def within(centers: DataFrame, atoms: DataFrame, radius: float | Column, how: str = "inner", cell: float | None = None, extra: Column | None = None) -> DataFrame:
    """``centers`` (prefixed c_) with ``atoms`` at d² <= r² in the same structure."""
    c = prefixed(centers, "c_")
    near = G.d2(G.at("c_"), G.at()) <= (radius * radius if isinstance(radius, Column) else F.lit(radius * radius))
    near = near if extra is None else near & extra
    keys = list(STRUCTURE)
    if cell:
        if not isinstance(radius, Column) and radius > cell:
            raise ValueError("a cell must be as wide as the radius")
        boxes = [F.floor(F.col(k) / cell) for k in ("c_x", "c_y", "c_z")]
        shifts = F.explode(F.array(*[F.struct((boxes[0] + i).alias("i"), (boxes[1] + j).alias("j"), (boxes[2] + k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
        c = c.withColumn("_cell", shifts)
        atoms = atoms.withColumn("_cell", F.struct(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"), F.floor(F.col("z") / cell).alias("k")))
        keys.append("_cell")
    left, right = (atoms, c) if how in ("left_semi", "left_anti") else (c, atoms)
    on = near
    for k in keys:
        on = on & (left[k] == right[k])
    out = left.join(right, on, how)
    for k in keys if how == "inner" else []:
        out = out.drop(right[k])
    return out.drop("_cell") if cell else out


#: Width of a block in radii: wider ones need fewer copies, narrower ones fewer candidates.
BLOCK = 4


def _block(k: str, radius: float, by: float = 0.0) -> Column:
    return F.floor((F.col(k) + by) / (BLOCK * radius))


def _copies(atoms: DataFrame, radius: float) -> DataFrame:
    """``atoms`` (columns c_) in the block ``_i, _j, _k`` where each is at home (``_home``) and in those behind it, in order of
    x, y and z, that it reaches with the radius: about two in all."""
    axes, reach = dict(zip("xyz", ("_i", "_j", "_k"), strict=True)), radius + 1e-6
    out = atoms
    for k, i in axes.items():
        out = out.withColumn(i, F.explode(F.sequence(_block(k, radius, -reach), _block(k, radius, reach))))
    at, home = F.struct(*axes.values()), F.struct(*[_block(k, radius).alias(i) for k, i in axes.items()])
    rest = [F.col(c).alias("c_" + c) for c in atoms.columns if c not in STRUCTURE]
    return out.where(at >= home).select(*STRUCTURE, *axes.values(), (at == home).alias("_home"), *rest)


def _pairs(atoms: DataFrame, radius: float) -> DataFrame:
    """Pairs a < b (columns a_, b_) within the radius. A pair meets once: in the block of the one that is behind, or in the
    block of both."""
    rest = [c for c in atoms.columns if c not in STRUCTURE]
    home = atoms.withColumns({i: _block(k, radius) for k, i in zip("xyz", ("_i", "_j", "_k"), strict=True)})
    before = F.col("c_line_no") < F.col("line_no")
    near = (G.d2(G.at("c_"), G.at()) <= F.lit(radius * radius)) & (before | (~F.col("_home") & (F.col("c_line_no") > F.col("line_no"))))
    found = _copies(atoms, radius).join(home, [*STRUCTURE, "_i", "_j", "_k"]).where(near)
    pick = lambda c, first: F.when(before, F.col("c_" + c if first else c)).otherwise(F.col(c if first else "c_" + c))
    return found.select(*STRUCTURE, *[pick(c, True).alias("a_" + c) for c in rest], *[pick(c, False).alias("b_" + c) for c in rest])


def metal_pairs(metals: DataFrame, cutoff: float) -> DataFrame:
    """Pairs a < b of metals of one structure within the cutoff."""
    return _pairs(metals, cutoff)


def union_selection(atoms: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """Atoms within the radius of any centre."""
    return within(centers, atoms, radius, "left_semi")


def neighbors_of(centers: DataFrame, atoms: DataFrame, radius: float) -> DataFrame:
    """Centre-atom pairs within the radius, the centre itself included."""
    return within(centers, atoms, radius).withColumn("d", G.distance(G.at("c_"), G.at()))


def coordination(centers: DataFrame, atoms: DataFrame, low: float = 2.0, high: float = 2.8) -> DataFrame:
    """First shell: donor elements (or an empty one) with low <= d <= high, other serial."""
    d = G.distance(G.at("c_"), G.at())
    donor = F.upper("element").isin(*DONORS) | (F.col("element") == "")
    other = F.col("serial") != F.col("c_serial")
    return within(centers, atoms.where(donor), high + 1e-6, extra=other & (d >= low) & (d <= high)).withColumn("d", d)


def expand_by_residue(atoms: DataFrame, selection: DataFrame) -> DataFrame:
    """All atoms of the residues (name, chain, number) that the selection touches."""
    key = [*STRUCTURE, "resname", "chain", "resseq"]
    touched = selection.select(*[F.upper(k).alias(k) if k == "resname" else F.col(k) for k in key]).distinct()
    return atoms.withColumn("_r", F.upper("resname")).join(touched.withColumnRenamed("resname", "_r"), [*STRUCTURE, "_r", "chain", "resseq"], "left_semi").drop("_r")


def pocket(atoms: DataFrame, centroids: DataFrame, radius: float = 10.0) -> DataFrame:
    """Non-hydrogen atoms within the radius of each centroid."""
    return within(centroids, atoms.where(F.upper("element") != "H"), radius)


def drop_near(atoms: DataFrame, element: str, target: str, radius: float) -> DataFrame:
    """Atoms without those of ``element`` within ``radius`` of a ``target`` atom."""
    close = within(atoms.where(F.col("element") == target), atoms.where(F.col("element") == element), radius, "left_semi")
    return atoms.join(close.select(*STRUCTURE, "line_no"), [*STRUCTURE, "line_no"], "left_anti")


def backbone_filtered(atoms: DataFrame, target: str, cutoff: float = 3.0) -> DataFrame:
    """Without backbone N, C, O, OXT of the standard amino acids, except residues of which
    a backbone atom lies within the cutoff of another atom of the target element."""
    from metalith.schema import AMINO_ACIDS, BACKBONE, BACKBONE_ANCHORS

    standard = F.upper("resname").isin(*AMINO_ACIDS)
    anchors = atoms.where(standard & F.upper("atom_name").isin(*BACKBONE_ANCHORS))
    absorbers = atoms.where(F.upper("element") == target.upper())
    key = [*STRUCTURE, "resname", "chain", "resseq", "icode"]
    full = within(absorbers, anchors, cutoff, "left_semi", extra=F.col("serial") != F.col("c_serial")).select(*key).distinct()
    plain = atoms.where(~(standard & F.upper("atom_name").isin(*BACKBONE)))
    kept = atoms.where(standard & F.upper("atom_name").isin(*BACKBONE)).join(full, key, "left_semi")
    return plain.unionByName(kept)


def bonds(atoms: DataFrame, radii: dict[str, float], slack: float = 0.45, least: float = 0.6, skip: tuple[str, ...] = ("H", "ZN")) -> DataFrame:
    """Pairs a < b with least <= d <= r_a + r_b + slack; elements without a radius have no bonds.

    Pairs come from blocks of a few bonds' width, not from all pairs of a structure."""
    table = F.create_map(*[F.lit(v) for kv in radii.items() for v in kv])
    n = atoms.where(~F.upper("element").isin(*skip)).withColumn("radius", F.try_element_at(table, F.upper("element"))).where("radius is not null")
    n = n.select(*STRUCTURE, "line_no", "element", "x", "y", "z", "radius")
    d = G.distance(G.at("a_"), G.at("b_"))
    found = _pairs(n, 2 * max(radii.values()) + slack + 1e-6)
    return found.where((d >= least) & (d <= F.col("a_radius") + F.col("b_radius") + slack)).withColumn("d", d)


def bonds_by_pair(atoms: DataFrame, limits: dict[tuple[str, str], float]) -> DataFrame:
    """Pairs a < b no farther apart than the limit of their two elements, in either order; pairs of elements without a
    limit have no bonds. ``limits``: two upper-case symbols in order of the alphabet, and the distance."""
    table = F.create_map(*[F.lit(v) for (a, b), limit in limits.items() for v in (f"{a}-{b}", float(limit))])
    known = sorted({e for pair in limits for e in pair})
    n = atoms.where(F.upper("element").isin(*known)).select(*STRUCTURE, "line_no", F.upper("element").alias("element"), "x", "y", "z")
    found = _pairs(n, max(limits.values()) + 1e-6)
    limit = F.try_element_at(table, F.concat_ws("-", F.least("a_element", "b_element"), F.greatest("a_element", "b_element")))
    return found.withColumn("d", G.distance(G.at("a_"), G.at("b_"))).where(G.d2(G.at("a_"), G.at("b_")) <= limit * limit)
