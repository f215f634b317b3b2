"""Standardisation in named steps, and tautomers of a limited kind."""

from __future__ import annotations

from assayforge.functions.smiles import Mol, Problem, centres, checked, chemistry, largest_fragment, neutralized, read, write

STEPS = ("fragment", "neutralize", "isotopes", "stereo", "tautomer")


def _without_isotopes(mol: Mol) -> Mol:
    out = mol.part(list(range(len(mol.atoms))))
    for a in out.atoms:
        a.isotope = 0
    return out


def _without_stereo(mol: Mol) -> Mol:
    out = mol.part(list(range(len(mol.atoms))))
    for a in out.atoms:
        a.chiral = ""
    out.directions = {}
    return out


#: Tautomers that are looked at.
TAUTOMERS = 1000


def tautomers(mol: Mol, most: int = TAUTOMERS) -> list[str]:
    """Spellings that 1,3 hydrogen shifts reach (H-X-Y=Z to X=Y-Z-H, an end being N, O or S),
    at most ``most``; longer conjugated and ring shifts that need more steps are reached one by one."""
    start = write(_without_stereo(mol))
    found, todo = {start}, [start]
    while todo and len(found) < most:
        m = checked(todo.pop())
        plain = _kekule(m)
        for y in range(len(plain.atoms)):
            for z in plain.near[y]:
                if plain.bond(y, z) != 2:
                    continue
                for x in plain.near[y]:
                    a, b = plain.atoms[x], plain.atoms[z]
                    if x == z or plain.bond(x, y) != 1 or not a.h or a.charge or b.charge or not {a.symbol, b.symbol} & {"N", "O", "S"}:
                        continue
                    new = plain.part(list(range(len(plain.atoms))))
                    new.bonds[min(x, y), max(x, y)], new.bonds[min(y, z), max(y, z)] = 2, 1
                    new.atoms[x].h -= 1
                    new.atoms[z].h += 1
                    try:
                        spelled = write(chemistry(read(write(new))))
                    except Problem:
                        continue
                    if spelled not in found and len(found) < most:
                        found.add(spelled)
                        todo.append(spelled)
    return sorted(found)


def _kekule(mol: Mol) -> Mol:
    from assayforge.functions.smarts import kekule_form

    return kekule_form(mol)


def canonical_tautomer(mol: Mol) -> Mol:
    """The tautomer with most C=O and aromatic atoms, then the first by spelling; an error
    beyond ``TAUTOMERS``, where the choice would depend on the form given."""
    found = tautomers(mol, TAUTOMERS + 1)
    if len(found) > TAUTOMERS:
        raise ValueError(f"more than {TAUTOMERS} tautomers")
    score = lambda s: (sum(m.bonds[b] == 2 and {m.atoms[b[0]].symbol, m.atoms[b[1]].symbol} == {"C", "O"} for b in m.bonds) + sum(a.aromatic for a in m.atoms)) if (m := checked(s)) else 0
    return checked(min(found, key=lambda s: (-score(s), s)))


FUNCTIONS = {"fragment": largest_fragment, "neutralize": neutralized, "isotopes": _without_isotopes, "stereo": _without_stereo, "tautomer": canonical_tautomer}


def steps_of(mol: Mol, steps: tuple[str, ...]) -> tuple[Mol, str | None]:
    """The molecule after the steps, in fixed order, and the errors; a step that fails changes nothing."""
    errors = []
    for step in STEPS:
        if step in steps:
            try:
                mol = FUNCTIONS[step](mol)
            except (Problem, ValueError) as e:
                errors.append(f"{step}: {e}")
    return mol, "; ".join(errors) or None


def standardize(text: str, steps: tuple[str, ...] = ("fragment", "neutralize")) -> dict:
    """Result and provenance: (step, before, after, changed), in fixed order; stops at an error."""
    try:
        mol = checked(text)
    except Problem as e:
        return {"status": "invalid", "result": None, "steps": [], "error": e.message}
    done = []
    for step in STEPS:
        if step in steps:
            before = write(mol)
            try:
                mol = FUNCTIONS[step](mol)
            except (Problem, ValueError) as e:
                return {"status": "error", "result": before, "steps": done, "error": f"{step}: {e}"}
            done.append((step, before, write(mol), write(mol) != before))
    return {"status": "ok", "result": write(mol), "steps": done, "error": None}


def stereo_summary(mol: Mol) -> tuple[int, int]:
    return centres(mol)
