"""Delivery requirements as XML documents, read strictly into the list that the requirement check takes."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the public requirement format.
NAMESPACE = "http://standards.buildingsmart.org/IDS"
XSD = "http://www.w3.org/2001/XMLSchema"
SCHEMAS = ("IFC2X3", "IFC4", "IFC4X3_ADD2")
CARDINALITIES = ("required", "optional", "prohibited")
BOUNDS = ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive")
#: Marks of documents that would pull in or define anything else.
ACTIVE = ("<!doctype", "<!entity", "<?xml-stylesheet", "xinclude")
MAX_DEPTH, MAX_SPECIFICATIONS, MAX_FACETS, MAX_BYTES = 32, 1000, 10_000, 1 << 20


class RequirementError(ValueError):
    """The document can't be read; the message is a code."""


@dataclass(frozen=True)
class Requirements:
    """Requirements for the check, and (code, subject) of what a document asks for beyond them."""

    entries: tuple[dict, ...]
    unsupported: tuple[tuple[str, str], ...]


def _tag(element: ET.Element, name: str, space: str = NAMESPACE) -> bool:
    return element.tag == f"{{{space}}}{name}"


def _child(element: ET.Element | None, name: str) -> ET.Element | None:
    return None if element is None else element.find(f"{{{NAMESPACE}}}{name}")


def _depth(root: ET.Element) -> int:
    deepest, waiting = 0, [(root, 1)]
    while waiting:
        element, depth = waiting.pop()
        deepest = max(deepest, depth)
        waiting += [(child, depth + 1) for child in element]
    return deepest


def _number(text: str) -> float:
    value = float(text)
    if not abs(value) < float("inf"):
        raise ValueError(text)
    return value


def _condition(holder: ET.Element | None) -> dict:
    """What a value must be: {} for anything, one value, one of some, a pattern, or bounds; ValueError for other restrictions."""
    if holder is None:
        return {}
    simple = _child(holder, "simpleValue")
    if simple is not None:
        return {"value": (simple.text or "").strip()}
    rule = holder.find(f"{{{XSD}}}restriction")
    if rule is None or not len(rule):
        raise ValueError("restriction")
    given = [(part.tag.removeprefix(f"{{{XSD}}}"), part.attrib.get("value", "")) for part in rule]
    names = {name for name, _ in given}
    if names == {"enumeration"}:
        return {"values": [text for _, text in given]}
    if names == {"pattern"} and len(given) == 1:
        re.compile(given[0][1])
        return {"pattern": given[0][1]}
    if names <= set(BOUNDS) and len(names) == len(given):
        return {name: _number(text) for name, text in given}
    raise ValueError("restriction")


def _facets(specification: ET.Element, name: str) -> Iterator[ET.Element]:
    yield from _child(specification, name) if _child(specification, name) is not None else ()


def read_requirements(text: str) -> Requirements:
    """Property requirements of the specifications of a document, each for one entity class.

    RequirementError for documents that aren't plain, aren't of the format, or are above the limits. Facets, cardinalities and
    restrictions that the check doesn't know are told as unsupported, and their requirement is left out with them.
    """
    if len(text.encode()) > MAX_BYTES:
        raise RequirementError("REQUIREMENTS_TOO_LARGE")
    if any(mark in text.lower() for mark in ACTIVE):
        raise RequirementError("REQUIREMENTS_ACTIVE_CONTENT")
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, RecursionError, ValueError) as problem:
        raise RequirementError("REQUIREMENTS_INVALID") from problem
    if not _tag(root, "ids"):
        raise RequirementError("REQUIREMENTS_NAMESPACE")
    found = list(root.iter(f"{{{NAMESPACE}}}specification"))
    facets = sum(len(part) for s in found for part in s if part.tag.startswith(f"{{{NAMESPACE}}}"))
    if _depth(root) > MAX_DEPTH or len(found) > MAX_SPECIFICATIONS or facets > MAX_FACETS:
        raise RequirementError("REQUIREMENTS_TOO_LARGE")
    if not found:
        raise RequirementError("REQUIREMENTS_INVALID")

    entries: list[dict] = []
    odd: list[tuple[str, str]] = []
    for n, specification in enumerate(found):
        here = f"specification:{n:04d}"
        versions = specification.attrib.get("ifcVersion", "").split()
        if not versions or not set(versions) <= set(SCHEMAS):
            odd.append(("REQUIREMENT_VERSION_UNSUPPORTED", here))
        chosen = list(_facets(specification, "applicability"))
        entity = _child(_child(chosen[0], "name"), "simpleValue") if len(chosen) == 1 and _tag(chosen[0], "entity") else None
        if entity is None:
            odd.append(("REQUIREMENT_FACET_UNSUPPORTED", f"{here}/applicability"))
            continue
        for k, facet in enumerate(_facets(specification, "requirements")):
            at = f"{here}/requirement:{k:04d}"
            cardinality = facet.attrib.get("cardinality", "required")
            named = _child(_child(facet, "baseName"), "simpleValue")
            if not _tag(facet, "property") or named is None:
                odd.append(("REQUIREMENT_FACET_UNSUPPORTED", at))
            elif cardinality not in CARDINALITIES:
                odd.append(("REQUIREMENT_CARDINALITY_UNSUPPORTED", at))
            else:
                try:
                    condition = _condition(_child(facet, "value"))
                except (ValueError, re.error):
                    odd.append(("REQUIREMENT_RESTRICTION_UNSUPPORTED", at))
                    continue
                name = specification.attrib.get("name", here)
                entries.append({"name": f"{name}/{k}", "entity": (entity.text or "").strip(), "property": (named.text or "").strip(), "cardinality": cardinality} | condition)
    return Requirements(tuple(entries), tuple(sorted(odd)))
