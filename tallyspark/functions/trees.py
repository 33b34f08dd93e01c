"""JSON of any depth: small recursive helpers behind Arrow-batched functions, where SQL's fixed depth cannot follow.

Text that is no JSON gives null. Everything else over JSON uses variants.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# Allowed values of some fields, and the fields of typed sections.
ENUMS = {"kind": "fact calculation inference assumption forecast risk unknown opinion", "severity": "low medium high critical", "mode": "synthesized staged-fallback deterministic-only"}
SECTIONS = {
    "executive_summary": "summary text analysis conclusion",
    "claims": "text conclusion argument kind confidence title",
    "counterarguments": "title counterargument argument text severity confidence",
    "invalidation_conditions": "title condition text trigger confidence",
    "leading_indicators": "title indicator metric text confidence",
    "unresolved_questions": "title question text confidence",
}
#: Ids that are not for readers.
INTERNAL = re.compile(r"(?i)(?:fact|evidence|filing|artifact|run):[A-Za-z0-9_.:/-]+|\b[0-9a-f]{8}-[0-9a-f-]{27,}\b")
GONE = object()


def over_json(kind: str, step: Callable) -> Callable[[Column], Column]:
    """A column function that reads JSON text and returns what step makes of it."""

    def one(text: str | None):
        try:
            tree = json.loads(text) if text is not None else GONE
        except ValueError:
            tree = GONE
        return None if tree is GONE else step(tree)

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in batch], dtype="object")

    return lambda column: pandas_udf(run, kind)(column)


def _sorted(pairs: list[tuple]) -> dict:
    return dict(sorted(dict(pairs).items())) if len(pairs) > 1 else dict(pairs)


_reader = json.JSONDecoder(object_pairs_hook=_sorted)
# One writer for all trees: json.dumps would make one for each, which costs more than small trees do.
_writer = json.encoder.c_make_encoder(None, None, json.encoder.encode_basestring, None, ":", ",", True, False, True)


def read(text: str | None, otherwise):
    """The tree of a text, its keys in the order of the canonical form."""
    try:
        return _reader.decode(text) if text is not None else otherwise
    except ValueError:
        return otherwise


def told(tree) -> str:
    return "".join(_writer(tree, 0))


def nodes(tree, path: str = "") -> Iterator[tuple[str, str, object]]:
    """(path, key, value) of every member of every object, parents first; list places as [i]."""
    members = [(f"{path}.{k}" if path else k, k, v) for k, v in tree.items()] if isinstance(tree, dict) else []
    inside = [(p, v) for p, _, v in members] if members else [(f"{path}[{i}]", v) for i, v in enumerate(tree)] if isinstance(tree, list) else []
    for n, (where, child) in enumerate(inside):
        if members:
            yield members[n]
        yield from nodes(child, where)


def objects(tree) -> Iterator[dict]:
    """Every object, parents first."""
    if isinstance(tree, dict):
        yield tree
    for child in tree.values() if isinstance(tree, dict) else tree if isinstance(tree, list) else ():
        yield from objects(child)


def without(tree, drop: Callable[[str], bool]):
    """The tree without the members whose key is dropped."""
    if isinstance(tree, dict):
        return {k: without(v, drop) if isinstance(v, (dict, list)) else v for k, v in tree.items() if not drop(k)}
    return [without(v, drop) for v in tree] if isinstance(tree, list) else tree


def private(key: str) -> bool:
    return key.startswith("_")


def hidden(key: str) -> bool:
    return key.startswith("_") or key == "structured_output_valid"


def hidden_or_claims(key: str) -> bool:
    return key.startswith("_") or key == "structured_output_valid" or key == "claims"


#: JSON with sorted keys and no blanks, for comparison and hashing.
canonical = over_json("string", told)


def objects_with(*keys: str) -> Callable[[Column], Column]:
    """The objects of a tree that have one of the keys, as JSON."""
    return over_json("array<string>", lambda tree: [told(o) for o in objects(tree) if any(k in o for k in keys)])


def unknown_paths(known: set[str]) -> Callable[[Column], Column]:
    """Paths of members whose key is not known and not internal."""
    return over_json("array<string>", lambda tree: [p for p, k, _ in nodes(tree) if k not in known and not k.startswith("_")])


def presentation(remove_claims: bool = True) -> Callable[[Column], Column]:
    """The tree for readers: no private members, no validity mark and, if wanted, no claims."""
    return over_json("string", lambda tree: told(without(tree, hidden_or_claims if remove_claims else hidden)))


def projected(known: set[str], section: str | None = None) -> Callable[[Column], Column]:
    """Known members only, those of a typed section by its list; values outside an enumeration and texts that are empty without internal ids vanish."""
    enums, sections = {k: set(v.split()) for k, v in ENUMS.items()}, {k: set(v.split()) for k, v in SECTIONS.items()}

    def of(tree, key: str | None):
        if isinstance(tree, str):
            text = INTERNAL.sub("", tree).strip()
            return text if text and (key not in enums or tree.casefold().strip() in enums[key]) else GONE
        if isinstance(tree, list):
            return [x for x in (of(v, key) for v in tree) if x is not GONE]
        if not isinstance(tree, dict):
            return tree
        wanted = known & sections[key] if key in sections else known
        parts = {k: of(v, k) for k, v in tree.items() if k in wanted and not k.startswith("_")}
        return {k: v for k, v in parts.items() if v is not GONE}

    return over_json("string", lambda tree: None if (out := of(tree, section)) is GONE else told(out))


def _visit_claims(tree, first: dict[str, dict]) -> None:
    if isinstance(tree, dict):
        if isinstance(found := tree.get("claims"), list):
            for claim in found:
                if isinstance(claim, dict):
                    text = _claimed(claim)
                    if text and text not in first:
                        first[text] = without(claim, hidden)
        for key, child in tree.items():
            if isinstance(child, (dict, list)) and not key.startswith("_"):
                _visit_claims(child, first)
    else:
        for child in tree:
            if isinstance(child, (dict, list)):
                _visit_claims(child, first)


def _claimed(claim: dict) -> str:
    for key in ("text", "conclusion", "argument"):
        if text := claim.get(key):
            if isinstance(text, str):
                return text.strip()
            if text := without(text, private):
                return str(text).strip()
    return ""


def claims_of(tree) -> list[dict]:
    """The claims in a tree outside its private members, the first of each text."""
    first: dict[str, dict] = {}
    if isinstance(tree, (dict, list)):
        _visit_claims(tree, first)
    return list(first.values())


#: The claims of all stages of a tree, the first of each text, as JSON.
stage_claims = over_json("array<string>", lambda tree: [told(c) for c in claims_of(tree)])


def _visit_strings(tree, keys: Sequence[str], found: dict[str, None]) -> None:
    if isinstance(tree, str):
        # Every internal id has a colon or a hyphen.
        text = INTERNAL.sub("", tree).strip() if ":" in tree or "-" in tree else tree.strip()
        if text:
            found[text] = None
    elif isinstance(tree, dict):
        for key in keys:
            if key in tree:
                _visit_strings(tree[key], keys, found)
        for key, child in tree.items():
            if isinstance(child, (dict, list)) and key not in keys:
                _visit_strings(child, keys, found)
    elif isinstance(tree, list):
        for child in tree:
            _visit_strings(child, keys, found)


def strings_of(tree, keys: Sequence[str]) -> list[str]:
    """Distinct texts that stand under one of the keys, or in lists, without internal ids."""
    found: dict[str, None] = {}
    _visit_strings(tree, keys, found)
    return list(found)


def strings_under(*keys: str) -> Callable[[Column], Column]:
    """Distinct texts that stand under one of the keys, or in lists, without internal ids."""
    return over_json("array<string>", lambda tree: strings_of(tree, keys))
