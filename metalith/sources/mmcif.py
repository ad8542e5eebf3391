"""mmCIF ``_atom_site`` loops as atom rows.

The tokenizer (quotes, text fields, loops) is sequential, so each file is one Python call."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metalith.schema import ATOM

_TOKEN = re.compile(r"""'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|"((?:[^"\n]|"(?=\S))*)"(?=\s|$)|(\#[^\n]*)|(\S+)""")


def tokens(text: str) -> Iterator[tuple[bool, str]]:
    """``(quoted, value)`` of a CIF text; semicolon text fields count as quoted."""
    plain, at = [], 0
    for m in re.finditer(r"(?m)^;(.*(?:\n(?!;).*)*)\n;", text):
        plain += [(text[at : m.start()], None), ("", m[1])]
        at = m.end()
    plain.append((text[at:], None))
    for part, field in plain:
        if field is not None:
            yield True, field
        for m in _TOKEN.finditer(part):
            if m[1] is not None or m[2] is not None:
                yield True, m[1] if m[1] is not None else m[2]
            elif m[4] is not None:
                yield False, m[4]


def loops(text: str) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Each loop's names and rows; single items come as loops of one row per category."""
    names, values, in_loop, heads, single = [], [], False, False, {}

    def done():
        n = len(names)
        if n:
            yield list(names), [values[k : k + n] for k in range(0, len(values) - n + 1, n)]

    key = None
    for quoted, t in tokens(text):
        low = t.lower()
        if not quoted and (low == "loop_" or low.startswith("data_")):
            yield from done()
            names, values, in_loop, heads, key = [], [], low == "loop_", low == "loop_", None
        elif not quoted and t.startswith("_"):
            if in_loop and heads:
                names.append(t)
            else:
                if in_loop:
                    yield from done()
                    names, values, in_loop = [], [], False
                key = t
        elif in_loop:
            heads = False
            values.append(t)
        elif key:
            single[key], key = t, None
    yield from done()
    by: dict[str, dict[str, str]] = {}
    for k, v in single.items():
        by.setdefault(k.split(".")[0], {})[k] = v
    for items in by.values():
        yield list(items), [list(items.values())]


def atom_rows(structure_id: str, text: str, auth_ids: bool = False) -> list[dict]:
    """Atoms of a text; a row without coordinates is dropped, an unreadable text has none.
    ``label_`` columns name residues unless ``auth_ids`` asks for ``auth_`` ones."""
    try:
        found = next(((n, r) for n, r in loops(text) if any(x.startswith("_atom_site.") for x in n)), None)
    except (ValueError, IndexError):
        return []
    if not found:
        return []
    names, rows = [n.removeprefix("_atom_site.") for n in found[0]], found[1]
    out = []
    for k, row in enumerate(rows):
        v = dict(zip(names, row, strict=True))
        try:
            x, y, z = (float(v["Cartn_" + c]) for c in "xyz")
        except (KeyError, ValueError):
            continue

        def number(name, default, kind, v=v):
            try:
                return kind(v.get(name, default))
            except ValueError:
                return default

        pick = lambda a, b, v=v: (v.get(b) if auth_ids and v.get(b, ".") not in ("", ".", "?") else None) or v.get(a, "")
        alt = v.get("label_alt_id", "")
        out.append({
            "structure_id": structure_id, "model": number("pdbx_PDB_model_num", 1, int), "line_no": k, "record": v.get("group_PDB", "ATOM"),
            "serial": number("id", 0, int), "atom_name": v.get("label_atom_id", ""), "altloc": "" if alt == "." else alt,
            "resname": v.get("label_comp_id", ""), "chain": pick("label_asym_id", "auth_asym_id"), "resseq": pick("label_seq_id", "auth_seq_id"),
            "icode": "" if v.get("pdbx_PDB_ins_code", "?") == "?" else v["pdbx_PDB_ins_code"], "x": x, "y": y, "z": z,
            "occ": number("occupancy", 1.0, float), "bfac": number("B_iso_or_equiv", 0.0, float), "element": v.get("type_symbol", "").upper(),
            "charge": v.get("pdbx_formal_charge", ""), "raw_line": "",
        })
    return out


def mmcif_atoms(files: DataFrame, auth_ids: bool = False) -> DataFrame:
    """Atoms of ``(structure_id, value)`` texts, a file at a time."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for s, t in zip(batch["structure_id"], batch["value"], strict=True):
                yield pd.DataFrame(atom_rows(s, t, auth_ids), columns=ATOM.fieldNames())

    return files.mapInPandas(parse, ATOM)


def read_mmcif(spark: SparkSession, paths: str | list[str], auth_ids: bool = False) -> DataFrame:
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[A-Za-z]+)?(\.gz)?$", 1).alias("structure_id"), "value")
    return mmcif_atoms(files, auth_ids)
