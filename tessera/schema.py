"""The base relations that describe source code, and their closed vocabularies."""

from __future__ import annotations

#: name: ((column, type), ...)
RELATIONS: dict[str, tuple[tuple[str, str], ...]] = {
    name: tuple(tuple(c.split(":")) for c in columns.split())
    for name, columns in {
        "file": "f:str lang:str",
        "def": "s:str f:str kind:str name:str",
        "def_span": "s:str l1:int l2:int b1:int b2:int",
        "def_name": "s:str line:int col:int",
        "def_sig": "s:str sig:str",
        "def_doc": "s:str doc:str",
        "parent": "child:str parent:str",
        "visibility": "s:str vis:str",
        "resolved": "s:str",
        "import": "f:str module:str alias:str",
        "scip_ref": "s:str f:str line:int col:int fr:str role:str",
        "name_ref": "name:str f:str line:int col:int fr:str",
        "scip_impl": "s:str t:str",
        "name_impl": "f:str type:str trait:str line:int",
        "extern": "s:str manager:str package:str version:str",
        "name_export": "f:str name:str",
    }.items()
}
SCIP_ONLY = frozenset({"resolved", "scip_ref", "scip_impl", "extern"})
KINDS = "class constant constructor enum field function interface macro method module property struct trait type union variable".split()
ROLES = "definition forward import read test unknown write".split()
VISIBILITIES = "inherited public restricted".split()
PROVENANCES = ("exact", "name")


def ddl(name: str) -> str:
    return ", ".join(f"{c} {'bigint' if t == 'int' else 'string'}" for c, t in RELATIONS[name])


def types_of(name: str) -> list[str]:
    return [t for _, t in RELATIONS[name]]
