"""Decoding of one document, from XML or its JSON twin, to a plain nested row.

A small tree (tag, text, children) is built by expat with entity declarations
refused, or from JSON in the order that its ordering lists give. Numbers keep
the text they were written in; beside it stands a double where one exists.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation
from xml.parsers import expat

from kelvinlake.errors import ParseError, ReferenceIntegrityError, ValidationError

# fixed values of the document format
NAMESPACE = "http://www.iupac.org/namespaces/ThermoML"
ROOT = "DataReport"
ORDER_KEY, MD5_KEY = "tml_elements", "THERMOML_MD5_CHECKSUM"
LEXICAL_WARNING = "Numbers come from JSON, so their spelling in the XML may differ."


class Node:
    __slots__ = ("children", "namespace", "tag", "text")

    def __init__(self, tag: str, namespace: str | None = NAMESPACE):
        self.tag, self.namespace, self.text, self.children = tag, namespace, "", []

    def all(self, *tags: str) -> list[Node]:
        return [c for c in self.children if c.tag in tags]

    def one(self, *tags: str) -> Node | None:
        return next((c for c in self.children if c.tag in tags), None)

    def value(self) -> str | None:
        return self.text.strip() or None

    def texts(self, *tags: str) -> list[str]:
        return [v for c in self.all(*tags) if (v := c.value())]

    def get(self, *tags: str) -> str | None:
        """Text of the first child named by the first of ``tags`` that has one."""
        for tag in tags:
            child = self.one(tag)
            if child is not None and (v := child.value()):
                return v
        return None

    def below(self) -> Iterator[Node]:
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def deep(self, *tags: str) -> str | None:
        """First non-empty text among the named descendants, in document order."""
        return next((v for n in self.below() if n.tag in tags and (v := n.value())), None)


def _refuse(*_args):
    raise ParseError("Entity declarations are not accepted.")


def xml_tree(data: bytes) -> Node:
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.EntityDeclHandler = parser.ExternalEntityRefHandler = parser.UnparsedEntityDeclHandler = _refuse
    top = Node("", None)
    stack = [top]

    def start(name: str, _attributes) -> None:
        space, _, tag = name.rpartition("}")
        node = Node(tag, space or None)
        stack[-1].children.append(node)
        stack.append(node)

    def text(chunk: str) -> None:
        if not stack[-1].children:  # text after a child is that child's tail
            stack[-1].text += chunk

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _name: stack.pop()
    parser.CharacterDataHandler = text
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise ParseError(f"Malformed XML: {e}") from e
    return top.children[0]


def _constant(x: str):
    raise ValueError(f"non-finite number {x}")


def json_tree(data: bytes) -> tuple[Node, str]:
    """(tree, MD5 of the XML twin)."""
    try:
        top = json.loads(data.decode("utf-8-sig"), parse_float=Decimal, parse_constant=_constant)
    except (ValueError, UnicodeDecodeError) as e:
        raise ParseError(f"Malformed JSON: {e}") from e
    if not isinstance(top, dict):
        raise ParseError("A JSON document must be an object.")
    if set(top) == {ROOT} and isinstance(top[ROOT], dict):
        top = top[ROOT]
    md5 = top.get(MD5_KEY)
    if not isinstance(md5, str) or not re.fullmatch(r"[0-9a-fA-F]{32}", md5):
        raise ParseError("A JSON document must name its XML twin's MD5.")
    root = Node(ROOT)
    todo = [(root, top, ROOT)]
    while todo:
        parent, fields, where = todo.pop()
        order = fields.get(ORDER_KEY)
        if not isinstance(order, list) or not all(isinstance(x, str) for x in order):
            raise ParseError(f"{where} lacks a list of its elements' order.")
        for name in order:
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", name):
                raise ParseError(f"{name!r} is no element name.")
            if name not in fields:
                continue
            values = fields[name]
            for v in values if isinstance(values, list) else [values]:
                child = Node(name)
                parent.children.append(child)
                if isinstance(v, dict):
                    todo.append((child, v, f"{where}.{name}"))
                elif isinstance(v, list):
                    raise ParseError(f"{where}.{name} nests a list in a list.")
                elif isinstance(v, bool):
                    child.text = "true" if v else "false"
                elif v is not None:
                    child.text = str(v)
    return root, md5.lower()


def whole(text: str | None, what: str, required: bool = False) -> int | None:
    if text is None:
        if required:
            raise ParseError(f"{what} is missing.")
        return None
    try:
        return int(text)
    except ValueError as e:
        raise ParseError(f"{what} is no integer: {text!r}.") from e


def number(text: str | None, what: str, required: bool = False) -> str | None:
    """The text itself, checked to be a decimal number."""
    if text is None:
        if required:
            raise ParseError(f"{what} is missing.")
        return None
    try:
        signalling = Decimal(text).is_snan()
    except InvalidOperation as e:
        raise ParseError(f"{what} is no number: {text!r}.") from e
    if signalling:
        raise ParseError(f"{what} is no number: {text!r}.")
    return text


def _double(text: str) -> float | None:
    return None if "_" in text else float(Decimal(text))


def component(node: Node | None) -> int | None:
    return None if node is None else whole(node.deep("nCompIndex", "nOrgNum"), "component reference")


def fields(node: Node, spec: dict[str, tuple[Callable, tuple[str, ...]]], how: Callable) -> dict:
    """{field: convert(text found under the field's tags)}."""
    return {
        name: (convert(how(node)(*tags), name) if convert else how(node)(*tags)) for name, (convert, tags) in spec.items()
    }


_CHILD, _DEEP = (lambda n: n.get), (lambda n: n.deep)
_UNCERTAINTY = {
    "assessment_number": (whole, ("nCombUncertAssessNum", "nUncertAssessNum")),
    "evaluator": (None, ("sCombUncertEvaluator", "sUncertEvaluator")),
    "method": (None, ("eCombUncertEvalMethod", "sCombUncertEvalMethod", "sUncertEvalMethod")),
    "standard_value": (number, ("nCombStdUncertValue", "nStdUncertValue")),
    "expanded_value": (number, ("nCombExpandUncertValue", "nExpandUncertValue")),
    "coverage_factor": (number, ("nCombCoverageFactor", "nCoverageFactor")),
    "confidence_level": (number, ("nCombUncertLevOfConfid", "nUncertLevOfConfid")),
}
_REPEATABILITY = {
    "evaluator": (None, ("sRepeatEvaluator",)),
    "method": (None, ("eRepeatMethod", "sRepeatMethod")),
    "standard_value": (number, ("nRepeatValue", "nStdDevValue")),
}
_DEVICE = {
    "evaluator": (None, ("sDeviceSpecEvaluator",)),
    "method": (None, ("eDeviceSpecMethod",)),
    "description": (None, ("sDeviceSpecMethod",)),
    "value": (number, ("nDeviceSpecValue",)),
    "confidence_level": (number, ("nDeviceSpecLevOfConfid",)),
}
_PURITY = {
    "step": (whole, ("nStep",)),
    "mole_percent": (number, ("nPurityMol",)),
    "mole_percent_digits": (whole, ("nPurityMolDigits",)),
    "mass_percent": (number, ("nPurityMass",)),
    "mass_percent_digits": (whole, ("nPurityMassDigits",)),
    "volume_percent": (number, ("nPurityVol",)),
    "volume_percent_digits": (whole, ("nPurityVolDigits",)),
    "unspecified_percent": (number, ("nUnknownPerCent",)),
}
_CITATION = {
    "title": (None, ("sTitle",)),
    "publication_name": (None, ("sPubName",)),
    "year": (whole, ("yrPubYr",)),
    "date": (None, ("dateCit",)),
    "volume": (None, ("sVol",)),
    "pages": (None, ("sPage",)),
    "doi": (None, ("sDOI",)),
    "url": (None, ("urlCit",)),
    "document_type": (None, ("eType",)),
    "source_type": (None, ("eSourceType",)),
    "document_origin": (None, ("sDocumentOrigin",)),
    "abstract": (None, ("sAbstract",)),
    "language": (None, ("eLanguage",)),
}
_COMPOUND = {
    "iupac_name": (None, ("sIUPACName",)),
    "cas_name": (None, ("sCASName",)),
    "formula": (None, ("sFormulaMolec",)),
    "standard_inchi": (None, ("sStandardInChI", "sInChI")),
    "standard_inchi_key": (None, ("sStandardInChIKey", "sInChIKey")),
    "cas_registry_number": (None, ("sCAS", "sCASRegistryNumber")),
}
_DATASET = {
    "purpose": (None, ("eExpPurpose",)),
    "compiler": (None, ("sCompiler",)),
    "contributor": (None, ("sContributor",)),
    "date_added": (None, ("dateDateAdded",)),
}
_KINDS = {"CombinedUncertainty": "combined", "PropUncertainty": "prop", "VarUncertainty": "var", "ConstrUncertainty": "constr"}
_SIDES = {
    "standard": ("AsymCombStdUncert", "AsymStdUncert"),
    "expanded": ("AsymCombExpandUncert", "AsymExpandUncert"),
}


def uncertainties(node: Node) -> list[dict]:
    out = []
    for child in node.all(*_KINDS):
        row = {"kind": _KINDS[child.tag]} | fields(child, _UNCERTAINTY, _DEEP)
        for side, tags in _SIDES.items():
            at = child.one(*tags)
            row[f"positive_{side}_value"] = None if at is None else number(at.get("nPositiveValue"), "positive uncertainty")
            row[f"negative_{side}_value"] = None if at is None else number(at.get("nNegativeValue"), "negative uncertainty")
        out.append(row)
    return out


def inherit(rows: list[dict], definitions: list[dict]) -> list[dict]:
    """Empty fields of a value's uncertainty come from the first definition with its
    kind and assessment number."""
    out = []
    for row in rows:
        same = (d for d in definitions if (d["kind"], d["assessment_number"]) == (row["kind"], row["assessment_number"]))
        base = next(same, {})
        out.append({k: base.get(k) if v is None else v for k, v in row.items()})
    return out


def _named(node: Node, suffix: str, spec: dict) -> list[dict]:
    return [fields(c, spec, _DEEP) for c in node.children if c.tag.endswith(suffix)]


def _phase(node: Node, container: str) -> str | None:
    at = node.one(container)
    return None if at is None else at.deep("ePropPhase", "eVarPhase", "eConstraintPhase", "eRefPhase", "ePhase")


def _name(node: Node, what: str) -> str:
    found = next((v for n in node.below() if n.tag[:1] in ("e", "s") and (v := n.value())), None)
    if found is None:
        raise ParseError(f"{what} has no name.")
    return found


def _need(node: Node, tag: str, what: str) -> Node:
    child = node.one(tag)
    if child is None:
        raise ParseError(f"{what} has no {tag}.")
    return child


def _quantity(node: Node, number_: int, name: str, phase: str, target: int | None) -> dict:
    solvents = [c for n in node.below() if n.tag == "Solvent" and (c := component(n)) is not None]
    return {
        "number": number_,
        "name": name,
        "phase": _phase(node, phase),
        "component_id": target,
        "solvent_component_ids": list(dict.fromkeys(solvents)),
        "uncertainties": uncertainties(node),
        "repeatability": _named(node, "Repeatability", _REPEATABILITY),
        "device_specifications": _named(node, "DeviceSpec", _DEVICE),
    }


def _property(node: Node) -> dict:
    n = whole(node.get("nPropNumber"), "property number", True)
    method = _need(node, "Property-MethodID", f"Property {n}")
    group = method.one("PropertyGroup")
    if group is None or not group.children:
        raise ParseError(f"Property {n} has no PropertyGroup.")
    group = group.children[0]
    target = component(method)
    if target is None:
        target = component(node.one("PropPhaseID"))
    name = group.deep("ePropName", "sPropName") or _name(group, f"Property {n}")
    return _quantity(node, n, name, "PropPhaseID", target) | {
        "group": group.tag,
        "method": group.deep("eMethodName", "sMethodName"),
        "presentation": node.get("ePresentation"),
        "reference_phase": _phase(node, "RefPhaseID"),
        "standard_state": node.get("eStandardState"),
    }


def _variable(node: Node) -> dict:
    n = whole(node.get("nVarNumber"), "variable number", True)
    at = _need(node, "VariableID", f"Variable {n}")
    kind = _need(at, "VariableType", f"Variable {n}")
    return _quantity(node, n, _name(kind, f"Variable {n}"), "VarPhaseID", component(at))


def _constraint(node: Node, ordinal: int) -> dict:
    n = whole(node.get("nConstraintNumber"), "constraint number") or ordinal
    at = _need(node, "ConstraintID", f"Constraint {n}")
    kind = _need(at, "ConstraintType", f"Constraint {n}")
    return _quantity(node, n, _name(kind, f"Constraint {n}"), "ConstraintPhaseID", component(at)) | {
        "value": number(node.get("nConstraintValue"), f"constraint {n} value", True),
        "significant_digits": whole(node.get("nConstrDigits"), f"constraint {n} digits"),
    }


def _measured(node: Node, kind: str, definitions: dict[int, list[dict]]) -> dict:
    n = whole(node.get(f"n{kind}Number"), f"{kind} value number", True)
    value = number(node.get(f"n{kind}Value"), f"{kind} value", True)
    return {
        "number": n,
        "value": value,
        "value_double": _double(value),
        "significant_digits": whole(node.get(f"n{kind}Digits"), f"{kind} digits"),
        "uncertainties": inherit(uncertainties(node), definitions.get(n, [])),
        "repeatability": _named(node, "Repeatability", _REPEATABILITY),
    }


def _dataset(node: Node, ordinal: int) -> dict:
    n = whole(node.get("nPureOrMixtureDataNumber"), "dataset number") or ordinal
    members = []
    for c in node.all("Component"):
        if (at := component(c)) is None:
            raise ParseError(f"Dataset {n} has a component without a reference.")
        members.append({"component_id": at, "sample": whole(c.get("nSampleNm"), "sample reference")})
    properties = [_property(x) for x in node.all("Property")]
    variables = [_variable(x) for x in node.all("Variable")]
    for what, rows in (("property", properties), ("variable", variables)):
        numbers = [r["number"] for r in rows]
        if len(set(numbers)) < len(numbers):
            raise ValidationError(f"Dataset {n} repeats {what} numbers: {numbers}.")
    of_property = {r["number"]: r["uncertainties"] for r in properties}
    of_variable = {r["number"]: r["uncertainties"] for r in variables}
    points = [
        {
            "index": i,
            "variable_values": [_measured(v, "Var", of_variable) for v in p.all("VariableValue")],
            "property_values": [_measured(v, "Prop", of_property) for v in p.all("PropertyValue")],
        }
        for i, p in enumerate(node.all("NumValues"), 1)
    ]
    return {
        "number": n,
        "component_ids": [m["component_id"] for m in members],
        "component_samples": members,
        "phases": [v for p in node.all("PhaseID") if (v := p.deep("ePhase"))],
        "properties": properties,
        "variables": variables,
        "constraints": [_constraint(x, i) for i, x in enumerate(node.all("Constraint"), 1)],
        "points": points,
    } | fields(node, _DATASET, _CHILD)


def _compound(node: Node) -> dict:
    local = component(node.one("RegNum"))
    if local is None:
        raise ParseError("A compound has no document-local identifier.")
    samples = []
    for s in node.all("Sample"):
        purity = [
            fields(p, _PURITY, _CHILD)
            | {"purification_methods": p.texts("ePurifMethod", "sPurifMethod"), "analysis_methods": p.texts("eAnalMeth")}
            for p in s.all("purity")
        ]
        number_ = whole(s.get("nSampleNm"), "sample number", True)
        samples.append({"number": number_, "source": s.get("eSource"), "status": s.get("eStatus"), "purity": purity})
    return {"local_id": local, "common_names": node.texts("sCommonName"), "samples": samples} | fields(node, _COMPOUND, _CHILD)


def _citation(node: Node) -> dict:
    trc = node.one("TRCRefID")
    return fields(node, _CITATION, _CHILD) | {
        "authors": node.texts("sAuthor"),
        "keywords": node.texts("sKeyword"),
        "trc_reference_id": None if trc is None else "-".join(v for c in trc.children if (v := c.value())),
    }


def _check_references(compounds: list[dict], datasets: list[dict]) -> None:
    known = {c["local_id"] for c in compounds}
    if len(known) < len(compounds):
        raise ValidationError("Compound identifiers are not unique.")
    for ds in datasets:
        quantities = [*ds["properties"], *ds["variables"], *ds["constraints"]]
        asked = [*ds["component_ids"], *(q["component_id"] for q in quantities), *(s for q in quantities for s in q["solvent_component_ids"])]
        missing = sorted({c for c in asked if c is not None} - known)
        if missing:
            raise ReferenceIntegrityError(f"Dataset {ds['number']} references missing components {missing}.")
        for kind in ("property", "variable"):
            defined = {q["number"] for q in ds["properties" if kind == "property" else "variables"]}
            for p in ds["points"]:
                lost = sorted({v["number"] for v in p[f"{kind}_values"]} - defined)
                if lost:
                    raise ReferenceIntegrityError(f"Dataset {ds['number']}, point {p['index']}: unresolved {kind} numbers {lost}.")


def document(root: Node, md5: str | None = None, warnings: tuple[str, ...] = ()) -> dict:
    if root.tag != ROOT:
        raise ParseError(f"The root is {root.tag!r}, not {ROOT!r}.")
    if root.namespace not in (None, NAMESPACE):
        raise ParseError(f"Unexpected namespace {root.namespace!r}.")
    version, citation = root.one("Version"), root.one("Citation")
    if version is None or citation is None:
        raise ParseError("Version and Citation are required.")
    compounds = [_compound(c) for c in root.all("Compound")]
    datasets = [_dataset(x, i) for i, x in enumerate(root.all("PureOrMixtureData"), 1)]
    out = {
        "version_major": whole(version.get("nVersionMajor"), "major version", True),
        "version_minor": whole(version.get("nVersionMinor"), "minor version", True),
        "citation": _citation(citation),
        "compounds": compounds,
        "datasets": datasets,
        "related_xml_md5": md5,
        "reaction_dataset_count": len(root.all("ReactionData")),
    }
    _check_references(compounds, datasets)
    more = [f"{out['reaction_dataset_count']} ReactionData entries are counted, not decoded."] if out["reaction_dataset_count"] else []
    return out | {"warnings": [*warnings, *more]}


def from_xml(data: bytes) -> dict:
    return document(xml_tree(data))


def from_json(data: bytes) -> dict:
    root, md5 = json_tree(data)
    return document(root, md5, (LEXICAL_WARNING,))
