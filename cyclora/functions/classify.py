"""Classifiers of feature names by lists, keywords and patterns, all as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accessions, names and patterns of mobile-element features.
MOBILE_ACCESSIONS = [
    "PF00665", "PF01527", "PF01609", "PF01610", "PF02003", "PF02022", "PF02316", "PF02371", "PF00239", "PF07508", "PF01764", "PF04754", "PF05699",
    "PF10551", "PF12761", "PF13385", "PF13586", "PF13840", "PF00872", "PF01398", "PF02914", "PF03050", "PF03184", "PF04827", "PF07592", "PF09184",
    "PF09811", "PF10407", "PF12728", "PF13843", "PF14815", "PF15706", "PF17921", "PF00589", "PF09424", "PF02899", "PF13102", "PF02902", "PF07022",
    "PF01371", "PF13612", "PF03108", "PF01797", "PF06276", "PF00078", "PF00552", "PF07727", "PF00075", "PF05986", "PF03354", "PF04364", "PF04589",
    "PF07195", "PF09068", "PF05135", "PF10145", "PF06143", "PF01424", "PF03389", "PF08751", "PF03004", "PF13009",
]
MOBILE_NAMES = [
    "Transposase_1", "Transposase_2", "Transposase_IS200_or_IS605", "Transposase_mut", "Transposase_21", "DDE_Tnp_IS1", "DDE_Tnp_IS240", "DDE_Tnp_1",
    "DDE_Tnp_4", "DDE_Tnp_ISAZ013", "DDE_3", "IS1_InsA", "IS1_InsB_1", "IS3_IS911", "IS30_Tnp", "IS66", "IS66_Orf2", "IS66_Orf3", "IS200_IS605",
    "IS701", "InsB", "IS3_transposase", "IS481", "ISTron", "Resolvase", "Recombinase", "Phage_integrase", "Integrase_recombinase_phage", "Integrase",
    "Int_C", "Int_AP2", "Integrase_Zn", "rve", "rve_2", "rve_3", "RVT_1", "RVT_2", "RVT_3", "RVT_N", "RVT_thumb", "RNase_H", "RNase_H2",
    "Phage_terminase_1", "Phage_terminase_2", "Terminase_6", "Phage_cap_E", "Phage_pRha", "Phage_Mu_Gam", "Phage_GPA", "GPW_gp25", "Relaxase",
    "MobA_MobL", "MobA", "MOB_NHLP", "Xis", "RDF", "Tn3_res", "TnpR", "HTH_Tnp_IS630", "HTH_Tnp_Tc3_2", "HTH_Tnp_1", "HTH_Tnp_Mu_2", "HTH_Tnp_Mu_1",
    "Tnp_zf-ribbon_2", "MULE", "FLINT", "Zn_Tnp_IS1",
]
MOBILE_PATTERNS = [
    r"transpos", r"\bIS\d", r"\bTn\d", r"\bICE\b", r"integrase", r"resolvase", r"invertase(?!.*sugar)", r"recombinas", r"retrotranspos",
    r"retroelem", r"retrovir", r"reverse.transcriptas", r"RVT", r"RNase_H", r"DDE.tnp", r"DDE_Tnp", r"Tnp[AB_]", r"phage.*integras",
    r"phage.*capsid", r"phage.*terminase", r"phage.*portal", r"phage.*tail", r"phage.*baseplate", r"phage.*sheath", r"mob[A-Z_]",
    r"relaxase", r"mobilisa", r"\bXis\b", r"recombination.directionality", r"RDF\b", r"insertion.seq", r"insertion.element", r"Tn3_res",
    r"MULE", r"HTH_Tnp", r"Zn_Tnp", r"INE\d", r"ISCR", r"IS_Mu",
]
#: Categories of features and the parts of names that tell them, the first that fits counts.
CATEGORIES = {
    "Transposon/MGE": [
        "transpos", "tnp", "integrase", "integron", "resolvase", "recombinase", "insertion", "is200", "is110", "is3", "is4", "is630", "merr", "hin",
        "xerc", "xerd", "rci", "tniq", "tnib", "tnic", "mobilisa", "mobiliz", "mob", "relaxase", "nickase",
    ],
    "Conjugation/T4SS": [
        "tra_", "trbp", "trbc", "trbe", "trbf", "trbg", "trbh", "trbi", "trbj", "trbk", "trbl", "virb", "vird", "type_iv", "t4ss", "conjugat",
        "mating", "pilin", "pilus",
    ],
    "Replication/Stability": [
        "rep_", "repa", "repb", "replication", "replic", "replicon", "plasmid_stab", "par_", "sop", "segs", "ccd", "toxin", "antitoxin", "vapb",
        "vapa", "mazf", "maze", "hig", "phd",
    ],
    "Resistance (non-BL)": [
        "efflux", "resistance", "tetracycl", "aminoglyc", "chloramphenicol", "trimethoprim", "sulfonamide", "qnr", "aac", "aph", "ant(", "mcr", "dfr",
        "cat_", "tetm", "tetr", "teta",
    ],
}
OTHER = "Other/Unknown"


def contains_any(column: Column, parts: list[str], ignore_case: bool = False) -> Column:
    """True if the column holds any of the parts; false for null."""
    c = F.lower(column) if ignore_case else column
    hits = [c.contains(p.lower() if ignore_case else p) for p in parts]
    return F.coalesce(reduce(Column.__or__, hits, F.lit(False)), F.lit(False))


def matches_any(column: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """True if any pattern is found; one combined pattern, so a name is scanned once. False for null."""
    return F.coalesce(column.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def literal_pattern(names: list[str]) -> str:
    """A pattern for any of the names as they stand, the longest first."""
    return "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))


def is_mobile(name: Column, accession: Column) -> Column:
    """A mobile element: by accession without its version, by exact name, or by pattern."""
    base = F.split(accession, r"\.")[0]
    return F.coalesce(base.isin(MOBILE_ACCESSIONS), F.lit(False)) | F.coalesce(name.isin(MOBILE_NAMES), F.lit(False)) | matches_any(name, MOBILE_PATTERNS)


def category(name: Column, first: Column | None = None, first_label: str = "", categories: dict[str, list[str]] | None = None, other: str = OTHER) -> Column:
    """The first category one of whose parts the lower-cased name holds; `first`, if given, comes before all."""
    out = F.when(first, first_label) if first is not None else None
    for label, parts in (categories or CATEGORIES).items():
        hit = contains_any(name, parts, True)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def in_list_or_contains(name: Column, exact: list[str], parts: list[str]) -> Column:
    """The name is listed or holds one of the parts, case counting."""
    return F.coalesce(name.isin(exact), F.lit(False)) | contains_any(name, parts)
