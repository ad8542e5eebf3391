"""Fixed values and schemas of macromolecular structure data."""

from __future__ import annotations

from pyspark.sql import types as T

# Element and residue sets of the structure formats and of the extraction rules.
METALS = (
    "LI", "NA", "K", "RB", "CS",
    "MG", "CA", "SR", "BA",
    "SC", "Y", "TI", "ZR", "HF", "V", "NB", "TA", "CR", "MO", "W", "MN", "TC", "RE",
    "FE", "CO", "NI", "CU", "ZN", "RU", "RH", "PD", "AG", "OS", "IR", "PT", "AU", "CD", "HG",
    "AL", "GA", "IN", "SN", "SB", "PB",
    "LA", "CE", "PR", "ND", "SM", "EU", "GD", "TB", "DY", "HO", "ER", "TM", "YB", "LU",
    "U", "TH",
)
DONORS = ("N", "O", "S", "P", "SE", "F", "CL", "BR", "I")
WATERS = ("HOH", "WAT")
AMINO_ACIDS = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE",
    "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL",
)
BACKBONE = ("N", "C", "O", "OXT")
BACKBONE_ANCHORS = ("N", "CA", "C", "O", "OXT")
ATOMIC_NUMBERS = {
    "H": 1, "HE": 2, "LI": 3, "BE": 4, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "NE": 10,
    "NA": 11, "MG": 12, "AL": 13, "SI": 14, "P": 15, "S": 16, "CL": 17, "AR": 18,
    "K": 19, "CA": 20, "SC": 21, "TI": 22, "V": 23, "CR": 24, "MN": 25,
    "FE": 26, "CO": 27, "NI": 28, "CU": 29, "ZN": 30,
    "SE": 34, "BR": 35, "MO": 42, "CD": 48, "I": 53, "HG": 80,
}
COVALENT_RADII = {"C": 0.76, "N": 0.71, "O": 0.66, "S": 1.05, "P": 1.07, "SE": 1.20, "FE": 1.32, "NI": 1.24, "CU": 1.32}
#: Longest bonds of two elements, for structures with hydrogens.
BOND_LIMITS = {("C", "C"): 1.75, ("C", "N"): 1.62, ("C", "S"): 1.90, ("C", "H"): 1.20, ("H", "N"): 1.15}
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
#: Columns of the cluster report, in order.
CLUSTER_FIELDS = (
    "PDB", "CLUSTER", "CLUSTER_TYPE", "CENTER_IDX", "CENTER_ELEM", "CENTER_ATOMNAME", "CHAIN", "RESSEQ", "ICODE", "RESNAME",
    "ALTLOC", "OCC", "CN", "GEOM", "COORD", "RMS_theta", "MAX_angle_dev", "sigma_d", "delta_d", "RMS_plane", "h_max",
    "planar", "axial", "distorted", "JT", "OTHER_METALS", "ALTLOC_CASE", "ALTLOC_LABEL", "XYZ_PATH", "RESOLUTION_A",
)
# Fixed-width atom record: name, first column (from 0), end column.
PDB_COLUMNS = (
    ("record", 0, 6), ("serial", 6, 11), ("atom_name", 12, 16), ("altloc", 16, 17), ("resname", 17, 20), ("chain", 21, 22),
    ("resseq", 22, 26), ("icode", 26, 27), ("x", 30, 38), ("y", 38, 46), ("z", 46, 54), ("occ", 54, 60), ("bfac", 60, 66),
    ("element", 76, 78), ("charge", 78, 80),
)

ATOM = T.StructType([
    T.StructField("structure_id", T.StringType()), T.StructField("model", T.IntegerType()), T.StructField("line_no", T.LongType()),
    T.StructField("record", T.StringType()), T.StructField("serial", T.IntegerType()), T.StructField("atom_name", T.StringType()),
    T.StructField("altloc", T.StringType()), T.StructField("resname", T.StringType()), T.StructField("chain", T.StringType()),
    T.StructField("resseq", T.StringType()), T.StructField("icode", T.StringType()), T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()), T.StructField("occ", T.DoubleType()),
    T.StructField("bfac", T.DoubleType()), T.StructField("element", T.StringType()), T.StructField("charge", T.StringType()),
    T.StructField("raw_line", T.StringType()),
])
