"""Chemistry plug-ins: pandas UDFs that need rdkit and selfies on the executors.

Without the libraries a factory raises ``Unavailable``; nothing is approximated. Any failure on a row
gives null (false for tests, 0 for counts)."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


class Unavailable(RuntimeError):
    """A library that the plug-in needs is not installed."""


def available() -> dict[str, bool]:
    return {n: importlib.util.find_spec(n) is not None for n in ("rdkit", "selfies")}


def _need(*names: str) -> None:
    missing = [n for n in names if not available()[n]]
    if missing:
        raise Unavailable(f"{', '.join(missing)} not installed")


def _at(s: str) -> str:
    return re.sub(r"\[\d*\*(?::\d+)?\]", "[At]", s).replace("*", "[At]")


def _guarded(f: Callable, otherwise=None) -> Callable:
    def g(s):
        if not isinstance(s, str) or not s.strip():
            return otherwise
        try:
            out = f(s)
        except Exception:  # a row that the library rejects is data, not an error
            return otherwise
        return otherwise if out is None or (isinstance(out, str) and not out) else out

    return g


def _mol(s: str):
    from rdkit import Chem

    return Chem.MolFromSmiles(_at(s))


def _encode(s: str) -> str:
    import selfies

    return selfies.encoder(_at(s))


def _decode(s: str) -> str:
    import selfies

    return selfies.decoder(s)


def _canonical(s: str) -> str | None:
    from rdkit import Chem

    mol = _mol(s)
    return None if mol is None else Chem.MolToSmiles(mol, canonical=True)


def _udf(kind: str, f: Callable, otherwise=None):
    safe = _guarded(f, otherwise)

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return v.map(safe)

    return run


def psmiles_to_pselfies():
    _need("selfies")
    return _udf("string", _encode)


def pselfies_to_psmiles():
    _need("selfies")
    return _udf("string", _decode)


def smiles_to_selfies():
    """As ``psmiles_to_pselfies`` without touching end markers."""
    _need("selfies")
    import selfies

    return _udf("string", selfies.encoder)


def selfies_to_smiles():
    _need("selfies")
    return _udf("string", _decode)


def _ring(s: str):
    """The molecule with its two ends joined: the ends' neighbours are bonded and the ends removed.
    None without exactly two ends of one bond each, or where the neighbours are bonded already."""
    from rdkit import Chem

    mol = _mol(s)
    ends = [a for a in mol.GetAtoms() if a.GetSymbol() == "At"]
    if len(ends) != 2 or any(a.GetDegree() != 1 for a in ends):
        return None
    i, j = (a.GetNeighbors()[0].GetIdx() for a in ends)
    if i == j or mol.GetBondBetweenAtoms(i, j) is not None:
        return None
    ring = Chem.RWMol(mol)
    ring.AddBond(i, j, Chem.BondType.SINGLE)
    for k in sorted((a.GetIdx() for a in ends), reverse=True):
        ring.RemoveAtom(k)
    out = ring.GetMol()
    Chem.SanitizeMol(out)
    return out


def _broken(ring) -> str | None:
    """A ring molecule cut at the single ring bond of the lowest canonical ranks, capped with ends."""
    from rdkit import Chem

    rank = list(Chem.CanonicalRankAtoms(ring))
    bonds = [b for b in ring.GetBonds() if b.IsInRing() and b.GetBondType() == Chem.BondType.SINGLE and not b.GetIsAromatic()]
    bonds = [b for b in bonds if ring.GetRingInfo().NumBondRings(b.GetIdx()) == 1]
    if not bonds:
        return None
    cut = min(bonds, key=lambda b: sorted((rank[b.GetBeginAtomIdx()], rank[b.GetEndAtomIdx()])))
    i, j = cut.GetBeginAtomIdx(), cut.GetEndAtomIdx()
    chain = Chem.RWMol(ring)
    chain.RemoveBond(i, j)
    for k in (i, j):
        chain.AddBond(k, chain.AddAtom(Chem.Atom("At")), Chem.BondType.SINGLE)
    out = chain.GetMol()
    Chem.SanitizeMol(out)
    return Chem.MolToSmiles(out)


def loop_break():
    """PSELFIES by way of the ring: ends joined, canonical bond cut and capped; where there is no ring
    to make or no bond to cut, the direct encoding."""
    _need("rdkit", "selfies")

    def f(s: str) -> str:
        try:
            ring = _ring(s)
            chain = _broken(ring) if ring is not None else None
        except Exception:  # an unusual ring falls back like a missing one
            chain = None
        return _encode(chain or s)

    return _udf("string", f)


def sa_score():
    """Synthetic accessibility of the molecule with hydrogen in place of its ends."""
    _need("rdkit")
    import importlib
    import os
    import sys

    from rdkit.Chem import RDConfig

    folder = os.path.join(RDConfig.RDContribDir, "SA_Score")
    if not os.path.isdir(folder):
        raise Unavailable("rdkit's SA_Score is not installed")

    def f(s: str) -> float:
        from rdkit import Chem

        if folder not in sys.path:
            sys.path.append(folder)
        mol = Chem.MolFromSmiles(_at(s).replace("[At]", "[H]"))
        return float(importlib.import_module("sascorer").calculateScore(Chem.RemoveHs(mol)))

    return _udf("double", f)


def canonical_psmiles():
    _need("rdkit")
    return _udf("string", _canonical)


def canonical_pselfies():
    _need("rdkit", "selfies")
    return _udf("string", lambda s: _encode(_canonical(_decode(s))))


def is_same_polymer(a, b):
    """Column: both have a canonical form, and it is one."""
    c = canonical_psmiles()
    return F.coalesce(c(a) == c(b), F.lit(False))


def count_termini():
    _need("rdkit")
    return _udf("long", lambda s: sum(x.GetSymbol() == "At" for x in _mol(s).GetAtoms()), 0)


def reproducible(strict: bool = True):
    """Encoding the decoded string gives the string again; lenient: the same canonical molecule."""
    _need("selfies", *([] if strict else ["rdkit"]))
    import selfies

    def test(s: str) -> bool:
        smiles = _decode(s)
        if strict:
            return selfies.encoder(smiles) == s
        one = _canonical(smiles)
        return one is not None and one == _canonical(_decode(_encode(smiles)))

    return _udf("boolean", test, False)


def structural_validity(ends: int = 2):
    """As many terminal atoms as wanted, each neutral, with one bond, no hydrogen, valence one."""
    _need("rdkit")

    def test(s: str) -> bool:
        at = [x for x in _mol(s).GetAtoms() if x.GetSymbol() == "At"]
        return len(at) == ends and all((x.GetFormalCharge(), x.GetDegree(), x.GetTotalNumHs(), x.GetTotalValence()) == (0, 1, 0, 1) for x in at)

    return _udf("boolean", test, False)


def enumerate_writings(n: int, seed: int = 0, oversample: int = 6):
    """Up to n distinct writings, the canonical one first."""
    _need("rdkit", "selfies")

    def writings(s: str) -> list[str]:
        from rdkit import Chem

        base = _canonical(s)
        tries = [base, *Chem.MolToRandomSmilesVect(_mol(s), n * oversample, randomSeed=seed + 1)]
        same = (_encode(t) for t in tries if _canonical(t) == base)
        return list(dict.fromkeys(x for x in same if x))[:n]

    return _udf("array<string>", writings, [])


def morgan_bits(radius: int = 3, bits: int = 2048, ring: bool = True):
    """On-bits of the Morgan fingerprint, by default of the molecule with its ends joined, for
    ``metrics.tanimoto``."""
    _need("rdkit")

    def on(s: str) -> list[int]:
        from rdkit.Chem import rdMolDescriptors

        return list(rdMolDescriptors.GetMorganFingerprintAsBitVect(_ring(s) if ring else _mol(s), radius, nBits=bits).GetOnBits())

    return _udf("array<int>", on)
