"""Symbol strings: bracketed symbols, greedy two-character tokens, characters."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Special symbols and their ids.
PAD, SOS, EOS = "<pad>", "<sos>", "<eos>"
PAD_ID, SOS_ID, EOS_ID = 0, 1, 2

# The line-notation character set (start, end, blank, structure, digits, elements).
NOTATION = (
    ["^", "$", " "]
    + "( ) [ ] . = # + - @ @@ / \\ % *".split()
    + "0 1 2 3 4 5 6 7 8 9".split()
    + "B C N O P S F Cl Br I b c n o p s".split()
    + "H Li Be Ne Na Mg Al Si Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Kr".split()
    + "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb".split()
    + "Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr".split()
    + "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og".split()
)


def split_symbols(col: str | Column) -> Column:
    """'[C][=O]N' to ['[C]', '[=O]', 'N']."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\]|.)"), F.lit(1))


def bracketed(col: str | Column) -> Column:
    """Every character of a text as its own bracketed symbol."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"(.)", "[$1]")


def greedy_split(col: str | Column) -> Column:
    """Two-character symbols of the notation first, then single characters."""
    c = F.col(col) if isinstance(col, str) else col
    wide = "|".join(re.escape(s) for s in NOTATION if len(s) == 2)
    text = F.concat(F.lit("^"), c, F.lit("$"))
    return F.regexp_extract_all(text, F.lit(f"({wide}|.)"), F.lit(1))


def notation_ids() -> dict[str, int]:
    return {s: i for i, s in enumerate(NOTATION)}
