"""Chemical symbols, atomic numbers and masses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols by atomic number; X is the dummy atom.
SYMBOLS = (
    "X H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

#: Standard atomic weights by atomic number (IUPAC 2016); 1 for the dummy atom.
MASSES = (
    1.0, 1.008, 4.002602, 6.94, 9.0121831, 10.81, 12.011, 14.007, 15.999, 18.998403163, 20.1797, 22.98976928, 24.305, 26.9815385, 28.085, 30.973761998, 32.06, 35.45,
    39.948, 39.0983, 40.078, 44.955908, 47.867, 50.9415, 51.9961, 54.938044, 55.845, 58.933194, 58.6934, 63.546, 65.38, 69.723, 72.63, 74.921595, 78.971, 79.904,
    83.798, 85.4678, 87.62, 88.90584, 91.224, 92.90637, 95.95, 97.90721, 101.07, 102.9055, 106.42, 107.8682, 112.414, 114.818, 118.71, 121.76, 127.6, 126.90447,
    131.293, 132.90545196, 137.327, 138.90547, 140.116, 140.90766, 144.242, 144.91276, 150.36, 151.964, 157.25, 158.92535, 162.5, 164.93033, 167.259, 168.93422, 173.054, 174.9668,
    178.49, 180.94788, 183.84, 186.207, 190.23, 192.217, 195.084, 196.966569, 200.592, 204.38, 207.2, 208.9804, 208.98243, 209.98715, 222.01758, 223.01974, 226.02541, 227.02775,
    232.0377, 231.03588, 238.02891, 237.04817, 244.06421, 243.06138, 247.07035, 247.07031, 251.07959, 252.083, 257.09511, 258.09843, 259.101, 262.11, 267.122, 268.126, 271.134, 270.133,
    269.1338, 278.156, 281.165, 281.166, 285.177, 286.182, 289.19, 289.194, 293.204, 293.208, 294.214,
)


def table(spark: SparkSession) -> DataFrame:
    """The dimension table (z, symbol, mass), one row for each element: fixed in size, so that joins may broadcast it."""
    rows = [F.struct(F.lit(z).alias("z"), F.lit(s).alias("symbol"), F.lit(m).alias("mass")) for z, (s, m) in enumerate(zip(SYMBOLS, MASSES, strict=True))]
    return spark.range(1).select(F.inline(F.array(*rows)))


def canonical(symbol: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(symbol, 1, 1)), F.lower(F.substring(symbol, 2, 1_000)))


def _lookup(values: list, keys: list) -> Column:
    return F.create_map(*(F.lit(x) for pair in zip(keys, values, strict=True) for x in pair))


def number_of(symbol: Column) -> Column:
    """The atomic number of a symbol in any case, null where unknown."""
    return F.try_element_at(_lookup(list(range(len(SYMBOLS))), SYMBOLS), canonical(symbol))


def numbers_of(symbols: Column) -> Column:
    """Atomic numbers of an array of symbols."""
    known = _lookup(list(range(len(SYMBOLS))), SYMBOLS)
    return F.transform(symbols, lambda s: F.try_element_at(known, canonical(s)))


def masses_of(numbers: Column) -> Column:
    """Masses of an array of atomic numbers."""
    known = _lookup(list(MASSES), list(range(len(SYMBOLS))))
    return F.transform(numbers, lambda z: F.try_element_at(known, z.cast("int")))


def unknown(symbols: Column) -> Column:
    """The sorted distinct symbols that are no element."""
    return F.array_sort(F.array_distinct(F.filter(symbols, lambda s: number_of(s).isNull())))
