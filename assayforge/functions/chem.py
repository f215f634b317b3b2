"""The chemistry kernel over columns: Arrow-batched pandas functions.

Each returns nulls where the kernel cannot say; a failed computation never looks
like a negative answer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.functions import diagnose as dx
from assayforge.functions import smarts, smiles, standardize
from assayforge.functions.text import has_inner_space, is_empty_structure
from assayforge.sources.policy import Policy


def over(kind: str):
    """A pandas function as one of columns; Spark sees it when it is used, not before."""
    return lambda f: lambda *columns: F.pandas_udf(f, kind)(*columns)


KERNEL = (
    "canonical string, exact string, parent string, tautomer string, nostereo string, skeleton string, formula string, n_fragments int, had_charge boolean, has_stereo boolean, "
    "n_organic int, charge int, has_isotope boolean, n_stereo int, n_assigned int, elements array<string>, scaffold string, exact_mass double, mw double, logp double, hbd int, hba int, "
    "tpsa double, rotatable_bonds int, heavy_atoms int, rings int, fraction_csp3 double, standardized string, std_changed boolean, std_error string"
)
NAMES = [c.split()[0] for c in KERNEL.split(", ")]


def describe(text: str | None, least_organic: int = 6, steps: tuple[str, ...] = ("fragment", "neutralize")) -> dict | None:
    """All kernel columns of one structure; None if it cannot be read. Keys, components, isotopes
    and elements are of the structure as given, the rest of what the steps make of it."""
    mol = smiles.parse(text)
    if mol is None:
        return None
    keys = smiles.identity(mol)
    parts = [mol.part(f) for f in mol.fragments()]
    parent, error = standardize.steps_of(mol, steps)
    n, assigned = smiles.centres(parent)
    given, made = smiles.write(mol), smiles.write(parent)
    mass = smiles.mass(mol, smiles.EXACT)
    return {
        **keys, "canonical": given, "standardized": made, "std_changed": made != given, "std_error": error, "charge": sum(a.charge for a in parent.atoms), "has_isotope": any(a.isotope for a in mol.atoms),
        "n_organic": sum(any(a.symbol == "C" for a in p.atoms) and len(p.atoms) >= least_organic for p in parts),
        "n_stereo": n, "n_assigned": assigned, "elements": sorted({a.symbol for a in mol.atoms}), "scaffold": smiles.scaffold(parent),
        "exact_mass": None if mass is None else round(mass, 4), **smiles.descriptors(parent),
    }


def kernel(least_organic: int = 6, steps: tuple[str, ...] = ("fragment", "neutralize")):
    def made(structure: pd.Series) -> pd.DataFrame:
        rows = [describe(s, least_organic, steps) or dict.fromkeys(NAMES) for s in structure]
        return pd.DataFrame(rows, columns=NAMES).astype(object).where(lambda d: d.notna(), None)

    return over(KERNEL)(made)


def annotated(records: DataFrame, structure: str = "structure", policy: Policy | None = None) -> DataFrame:
    """Records with status and the kernel's columns, each structure parsed once and
    standardised as the policy says."""
    s, policy = F.col(structure), policy or Policy()
    wide = records.withColumn("_k", kernel(policy.organic_component_min_heavy_atoms, policy.steps)(F.when(~is_empty_structure(s) & ~has_inner_space(s), s)))
    status = F.when(is_empty_structure(s), "empty").when(F.col("_k.canonical").isNull(), "invalid").otherwise("ok")
    kept = [c for c in records.columns if c not in (*NAMES, "status")]
    return wide.select(*kept, status.alias("status"), F.coalesce(has_inner_space(s), F.lit(False)).alias("inner_space"), *(F.col(f"_k.{n}").alias(n) for n in NAMES))


@over("string")
def canonical(structure: pd.Series) -> pd.Series:
    return structure.map(lambda s: None if (m := smiles.parse(s)) is None else smiles.write(m))


@over("status string, problems array<struct<category:string,message:string,at:int>>, repair string")
def diagnosis(structure: pd.Series) -> pd.DataFrame:
    rows = [dx.diagnose(s) for s in structure]
    return pd.DataFrame({
        "status": [r["status"] for r in rows], "problems": [[{"category": c, "message": m, "at": at} for c, m, at in r["problems"]] for r in rows],
        "repair": [r["repairs"][0][1] if r["repairs"] else None for r in rows],
    })


def fingerprints(structure: Column, kind: str = "ecfp4", n_bits: int = 2048) -> Column:
    """Array of 64-bit words; null for structures that cannot be read."""
    if kind not in smiles.FINGERPRINTS:
        raise ValueError(f"{kind} is not one of {sorted(smiles.FINGERPRINTS)}; MACCS keys are not built in")

    @F.pandas_udf("array<long>")
    def made(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (m := smiles.parse(x)) is None else smiles.words(smiles.FINGERPRINTS[kind](m, n_bits), n_bits))

    return made(structure)


def matched(structure: Column, pattern: str, preparation: str = "implicit-h") -> Column:
    """Atoms of the first match; empty if there is none, null if the structure cannot be read or prepared."""
    smarts.compile_(pattern)

    @F.pandas_udf("array<int>")
    def found(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                mol = smarts.PREPARATIONS[preparation](smiles.checked(x))
            except smiles.Problem:
                return None
            return list(smarts.match(mol, pattern) or ())

        return s.map(one)

    return found(structure)


def pattern_hits(items: DataFrame, patterns: list[tuple[int, str]], preparations: tuple[str, ...] = ("implicit-h",), structure: str = "structure") -> DataFrame:
    """(pattern_id, item_id, preparation) of items (item_id, structure); each molecule is prepared once."""

    @F.pandas_udf("array<struct<pattern_id:int,preparation:string>>")
    def found(s: pd.Series) -> pd.Series:
        def one(x):
            out = []
            for name in preparations:
                try:
                    context = smarts.Context(smarts.PREPARATIONS[name](smiles.checked(x)))
                except smiles.Problem:
                    continue
                out += [{"pattern_id": i, "preparation": name} for i, p in patterns if smarts.match(context.mol, p, context) is not None]
            return out

        return s.map(one)

    return items.select("item_id", F.explode(found(F.col(structure))).alias("h")).select("h.pattern_id", "item_id", "h.preparation")


def fragments(records: DataFrame, structure: str = "structure", most: int = 13) -> DataFrame:
    """(id, core, core_size, rest, rest_size) of the single cuts of records (id, structure)."""

    @F.pandas_udf("array<struct<core:string,rest:string,rest_size:int,core_size:int>>")
    def made(s: pd.Series) -> pd.Series:
        def one(x):
            m = smiles.parse(x)
            return [] if m is None else [dict(zip(("core", "rest", "rest_size", "core_size"), c, strict=True)) for c in smiles.cuts(smiles.largest_fragment(m), most)]

        return s.map(one)

    return records.select("id", F.explode(made(F.col(structure))).alias("f")).select("id", "f.core", "f.core_size", "f.rest", "f.rest_size")


@over("status string, result string, steps array<struct<step:string,before:string,after:string,changed:boolean>>, error string")
def standardized(structure: pd.Series) -> pd.DataFrame:
    rows = [standardize.standardize(s or "") for s in structure]
    for r in rows:
        r["steps"] = [dict(zip(("step", "before", "after", "changed"), x, strict=True)) for x in r["steps"]]
    return pd.DataFrame(rows, columns=["status", "result", "steps", "error"])


@over("array<string>")
def tautomers(structure: pd.Series) -> pd.Series:
    return structure.map(lambda s: None if (m := smiles.parse(s)) is None else standardize.tautomers(m))


def r_groups(structure: Column, core: str) -> Column:
    """Map of the core and what hangs on it; null without a match."""
    smarts.compile_(core)

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def made(s: pd.Series) -> pd.Series:
        def one(x):
            m = smiles.parse(x)
            d = None if m is None else smarts.decompose(m, core)
            return None if d is None else [{"key": k, "value": v} for k, v in d.items()]

        return s.map(one)

    return F.map_from_entries(made(structure))


def augmented(structure: Column, n: int = 5, seed: int = 0) -> Column:
    """Up to n other spellings."""

    @F.pandas_udf("array<string>")
    def made(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if smiles.parse(x) is None else smiles.spellings(x, n, seed))

    return made(structure)


@over("string")
def atom_mapped(structure: pd.Series) -> pd.Series:
    return structure.map(lambda s: None if smiles.parse(s) is None else smiles.atom_mapped(s))


@over("reactants int, agents int, products int")
def reaction_counts(reaction: pd.Series) -> pd.DataFrame:
    rows = [smiles.reaction_counts(r) or (None, None, None) for r in reaction]
    return pd.DataFrame(rows, columns=["reactants", "agents", "products"]).astype(object).where(lambda d: d.notna(), None)


#: What the kernel does not compute, and why; such columns are null.
UNSUPPORTED = {
    "inchi": "needs the InChI software", "inchikey": "needs the InChI software", "iupac_name": "needs a naming service", "conformers": "needs a force field", "depiction": "needs a drawing toolkit",
    "qed": "parameters not built in", "pains": "pattern texts not built in", "maccs": "key definitions not built in", "logp": "contributions not built in", "built-in catalogues": "pattern texts not built in",
}


def spaced(items: DataFrame, n: int, most: int = 2500) -> DataFrame:
    """At most ``most`` of the n items (item_id 0 to n - 1), evenly spaced: a probe's sample."""
    step = max(1, -(-n // most))
    return items.where(F.col("item_id") % step == 0)


def atom_hits(items: DataFrame, pattern: str, preparations: tuple[str, ...] = ("implicit-h",), structure: str = "structure") -> DataFrame:
    """(atom, preparation, n_hits): items that have an atom which each single atom of the pattern allows."""
    compiled = smarts.compile_(pattern)

    @F.pandas_udf("array<struct<atom:int,preparation:string>>")
    def found(s: pd.Series) -> pd.Series:
        def one(x):
            out = []
            for name in preparations:
                try:
                    c = smarts.Context(smarts.PREPARATIONS[name](smiles.checked(x)))
                except smiles.Problem:
                    continue
                out += [{"atom": k, "preparation": name} for k, test in enumerate(compiled.atoms) if any(test(c, i) for i in range(len(c.mol.atoms)))]
            return out

        return s.map(one)

    rows = items.select(F.explode(found(F.col(structure))).alias("h"))
    return rows.groupBy("h.atom", "h.preparation").agg(F.count("*").alias("n_hits"))


def explain(items: DataFrame, pattern: str, preparations: tuple[str, ...] = ("implicit-h", "explicit-h", "kekule")) -> DataFrame:
    """(preparation, atom, n_hits, n_pattern, verdict) for each atom of a pattern.

    verdict: fires if the whole pattern has hits there; atom if this atom alone never
    matches; combination if each atom does but the whole does not.
    """
    spark = items.sparkSession
    n = len(smarts.compile_(pattern).atoms)
    every = spark.createDataFrame([(p, k) for p in preparations for k in range(n)], "preparation string, atom int")
    whole = pattern_hits(items, [(0, pattern)], preparations).groupBy("preparation").agg(F.count("*").alias("n_pattern"))
    wide = every.join(atom_hits(items, pattern, preparations), ["preparation", "atom"], "left").join(whole, "preparation", "left").fillna(0, ["n_hits", "n_pattern"])
    verdict = F.when(F.col("n_pattern") > 0, "fires").when(F.col("n_hits") == 0, "atom").otherwise("combination")
    return wide.select("preparation", "atom", "n_hits", "n_pattern", verdict.alias("verdict"))


def panel_elements(items: DataFrame, structure: str = "structure", top: int = 12) -> DataFrame:
    """(element, n): the elements that most structures of a panel have."""
    wide = items.select(F.explode(kernel()(F.col(structure))["elements"]).alias("element"))
    return wide.groupBy("element").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element").limit(top)


def evaluated(items: DataFrame, preparations: tuple[str, ...], structure: str = "structure") -> DataFrame:
    """(item_id, preparation) of every preparation that could be made."""

    @F.pandas_udf("array<string>")
    def made(s: pd.Series) -> pd.Series:
        def one(x):
            out = []
            for name in preparations:
                try:
                    smarts.PREPARATIONS[name](smiles.checked(x))
                    out.append(name)
                except smiles.Problem:
                    pass
            return out

        return s.map(one)

    return items.select("item_id", F.explode(made(F.col(structure))).alias("preparation"))
