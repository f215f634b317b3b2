"""Answers of public compound databases, from payloads that were saved beforehand.

A payload table has (query, payload). Each reader yields rows of one common form,
ready for ``operators.merge``; rows whose payload holds no compound are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "smiles", "inchi", "inchikey", "formula")
NUMBERS = ("molecular_weight", "monoisotopic_mass", "charge", "xlogp", "tpsa", "hbd", "hba", "rotatable_bonds")
#: Source order of consensus and merge.
PRIORITY = {"pubchem": 0, "chembl": 1, "chebi": 2, "kegg": 3}
#: Where each database keeps a field, as JSON paths.
PATHS = {
    "pubchem": {
        "root": "$.PropertyTable.Properties[0]", "source_id": "CID", "name": "Title", "inchi": "InChI", "inchikey": "InChIKey", "formula": "MolecularFormula",
        "smiles": ("IsomericSMILES", "SMILES", "CanonicalSMILES"), "molecular_weight": "MolecularWeight", "monoisotopic_mass": "MonoisotopicMass", "charge": "Charge",
        "xlogp": "XLogP", "tpsa": "TPSA", "hbd": "HBondDonorCount", "hba": "HBondAcceptorCount", "rotatable_bonds": "RotatableBondCount", "synonyms": "IUPACName",
    },
    "chembl": {
        "root": "$", "source_id": "molecule_chembl_id", "name": "pref_name", "smiles": "molecule_structures.canonical_smiles", "inchi": "molecule_structures.standard_inchi",
        "inchikey": "molecule_structures.standard_inchi_key", "formula": "molecule_properties.full_molformula", "molecular_weight": "molecule_properties.full_mwt",
        "monoisotopic_mass": "molecule_properties.mw_monoisotopic", "xlogp": "molecule_properties.alogp", "tpsa": "molecule_properties.psa", "hbd": "molecule_properties.hbd",
        "hba": "molecule_properties.hba", "rotatable_bonds": "molecule_properties.rtb",
    },
    "chebi": {
        "root": "$", "source_id": "chebi_accession", "name": ("name", "ascii_name"), "smiles": "default_structure.smiles", "inchi": "default_structure.standard_inchi",
        "inchikey": "default_structure.standard_inchi_key", "formula": "chemical_data.formula", "molecular_weight": "chemical_data.mass",
        "monoisotopic_mass": "chemical_data.monoisotopic_mass", "charge": "chemical_data.charge",
    },
}


def _path(payload: Column, root: str, paths) -> Column:
    found = [F.get_json_object(payload, f"{root}.{p}") for p in ((paths,) if isinstance(paths, str) else paths)]
    return F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in found))


def from_json(payloads: DataFrame, source: str) -> DataFrame:
    """Rows of pubchem, chembl or chebi payloads."""
    paths = PATHS[source]
    get = lambda k: _path(F.col("payload"), paths["root"], paths[k]) if k in paths else F.lit(None).cast("string")
    columns = [get(k).alias(k) for k in FIELDS] + [get(k).try_cast("double").alias(k) for k in NUMBERS]
    synonyms = F.array_compact(F.array(get("synonyms")))
    out = payloads.select("query", F.lit(source).alias("source"), F.lit(PRIORITY[source]).alias("priority"), get("source_id").alias("source_id"), *columns, synonyms.alias("synonyms"))
    return out.where("source_id is not null")


def flat_fields(payload: Column) -> Column:
    """Fields of the flat format with names in the first 12 columns, as name -> lines joined by newlines."""
    lines = F.split(F.regexp_replace(payload, "\r", ""), "\n")
    until = F.slice(lines, 1, F.when(F.array_position(lines, "///") > 0, F.array_position(lines, "///") - 1).otherwise(F.size(lines)).cast("int"))
    start = F.create_map().cast("map<string,string>")
    state = F.struct(F.lit("").alias("at"), start.alias("m"))

    def step(s: Column, line: Column) -> Column:
        name = F.trim(F.substring(line, 1, 12))
        at = F.when(name != "", name).otherwise(s["at"])
        value = F.trim(F.substring(line, 13, 1_000_000))
        old = F.element_at(s["m"], at)
        new = F.when(value == "", old).otherwise(F.concat_ws("\n", old, value))
        m = F.when(at == "", s["m"]).otherwise(F.map_concat(F.map_filter(s["m"], lambda k, v: k != at), F.create_map(at, F.coalesce(new, F.lit("")))))
        return F.struct(at.alias("at"), m.alias("m"))

    return F.aggregate(until, state, step)["m"]


#: Pharmacopoeias and naming bodies that qualify a name; an edition follows the Japanese one.
QUALIFIERS = ("BAN", "DCF", "INN", "JAN", "JP[0-9]+", "NF", "TN", "USAN", "USP")
#: One or more of them, in brackets and parted by slashes, at the end of a name.
QUALIFIER = r"\s*\(({0})(/({0}))*\)\s*$".format("|".join(QUALIFIERS))


def without_qualifier(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), QUALIFIER, "")


def from_kegg(payloads: DataFrame) -> DataFrame:
    """Rows of flat payloads; the database publishes neither SMILES nor InChIKey in them."""
    f = payloads.withColumn("_f", flat_fields(F.col("payload")))
    names = F.transform(F.split(F.element_at("_f", "NAME"), "\n"), lambda n: without_qualifier(F.regexp_replace(n, ";$", "")))
    number = lambda k: F.element_at("_f", k).try_cast("double")
    none = F.lit(None)
    return f.select(
        "query", F.lit("kegg").alias("source"), F.lit(PRIORITY["kegg"]).alias("priority"), F.regexp_extract(F.element_at("_f", "ENTRY"), r"^(\S+)", 1).alias("source_id"),
        F.get(names, F.lit(0)).alias("name"), *(none.cast("string").alias(k) for k in ("smiles", "inchi", "inchikey")), F.element_at("_f", "FORMULA").alias("formula"),
        number("MOL_WEIGHT").alias("molecular_weight"), number("EXACT_MASS").alias("monoisotopic_mass"), *(none.cast("double").alias(k) for k in NUMBERS[2:]), names.alias("synonyms"),
    ).where("source_id != ''")


def unichem_references(payloads: DataFrame, names: DataFrame) -> DataFrame:
    """(query, database, id) of saved cross-reference lists; names: (src_id, database); the first of a database stays."""
    rows = payloads.select("query", F.posexplode(F.from_json("payload", "array<struct<src_id:string,src_compound_id:string>>")).alias("at", "r"))
    rows = rows.where("r.src_id is not null and r.src_compound_id is not null").join(F.broadcast(names), F.col("r.src_id") == F.col("src_id"), "left")
    database = F.coalesce("database", F.concat(F.lit("unichem_src_"), F.col("r.src_id")))
    return rows.groupBy("query", database.alias("database")).agg(F.min_by("r.src_compound_id", "at").alias("id"))


def best_hit(hits: DataFrame, term: str = "query") -> DataFrame:
    """Of search hits (query, name, synonyms, stars, position): one whose name is the term, else one
    that lists it as synonym, else the one with most stars."""
    t = F.lower(F.trim(term))
    rank = F.when(F.lower("name") == t, 0).when(F.exists("synonyms", lambda s: F.lower(s) == t), 1).otherwise(2)
    order = F.struct(rank.alias("k"), (-F.coalesce("stars", F.lit(0))).alias("s"), "position")
    return hits.groupBy("query").agg(F.min_by("source_id", order).alias("source_id"))
