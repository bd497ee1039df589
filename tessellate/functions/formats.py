"""Model output and prompt formats: fences, JSON and YAML, examples, schemas, in plain Python."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..types import ATTRIBUTE_SUFFIX, WRAPPER_KEY, FormatError, PromptTemplateError
from .text import FENCE

THINKING = re.compile(r"<think>.*?</think>", re.DOTALL | re.IGNORECASE)
# Old parameter names and what they are now (fixed values).
OLD_NAMES = {
    "fence_output": "fences", "format_type": "kind", "strict_fences": "strict_fences", "require_extractions_key": "wrapper",
    "extraction_attributes_suffix": "attribute_suffix", "attribute_suffix": "attribute_suffix", "extraction_index_suffix": "index_suffix",
}
TAGS = {"json": ("json",), "yaml": ("yaml", "yml")}


def fenced(output: str) -> list[tuple[str, str]]:
    """Tag and body of the fenced blocks of an output; the rules are those of ``text.fence_bodies``."""
    out = []
    between = output.split(FENCE)
    for block in between[1:-1:2]:
        size = 0
        while size < len(block) and block[size].isascii() and (block[size].isalnum() or block[size] in "-+_"):
            size += 1
        out.append((block[:size].lower(), block[size:].strip()))
    return out


@dataclass
class Extraction:
    extraction_class: str
    extraction_text: str
    attributes: dict | None = None
    extraction_index: int | None = None
    group_index: int | None = None
    description: str | None = None


@dataclass
class Example:
    text: str
    extractions: list[Extraction] = field(default_factory=list)


@dataclass(frozen=True)
class Format:
    """How model output is written and read."""

    kind: str = "json"
    fences: bool = True
    strict_fences: bool = False
    wrapper: bool = True
    wrapper_key: str = WRAPPER_KEY
    allow_list: bool = True
    attribute_suffix: str = ATTRIBUTE_SUFFIX
    index_suffix: str | None = None

    @classmethod
    def of(cls, parameters: dict, **defaults) -> tuple[Format, dict]:
        """A format by parameters under their old names (with a warning), and the parameters that are none of a format's."""
        rest, known = dict(parameters), dict(defaults)
        old = [k for k in OLD_NAMES if rest.get(k) is not None]
        for name in OLD_NAMES:
            value = rest.pop(name, None)
            if value is not None:
                known[OLD_NAMES[name]] = getattr(value, "value", value)
        if old:
            warnings.warn(f"old names of format parameters: {', '.join(old)}", DeprecationWarning, stacklevel=2)
        return cls(**known), rest

    # -- writing -------------------------------------------------------------------

    def dump(self, value) -> str:
        if self.kind == "yaml":
            import yaml

            text = yaml.safe_dump(value, sort_keys=False, default_flow_style=False).strip()
        else:
            text = json.dumps(value, indent=2, ensure_ascii=False)
        return f"```{self.kind}\n{text}\n```" if self.fences else text

    def example(self, extractions: Iterable[Extraction]) -> str:
        items = [{e.extraction_class: e.extraction_text, e.extraction_class + self.attribute_suffix: e.attributes or {}} for e in extractions]
        return self.dump({self.wrapper_key: items} if self.wrapper else items)

    # -- reading -------------------------------------------------------------------

    def body(self, output: str) -> str:
        """What stands in the one fenced block of this format; without fences the whole output."""
        if not self.fences:
            return output.strip()
        blocks = fenced(output)
        fitting = [body for tag, body in blocks if tag in ("", *TAGS[self.kind])]
        if len(fitting) > 1:
            raise FormatError("more than one fenced block")
        if fitting:
            return fitting[0]
        if self.strict_fences or len(blocks) > 1:
            raise FormatError(f"no fenced {self.kind} block")
        return (blocks[0][1] if blocks else output).strip()

    def load(self, text: str):
        if self.kind == "yaml":
            import yaml

            try:
                return yaml.safe_load(text)
            except yaml.YAMLError as e:
                raise FormatError(f"not YAML: {str(e)[:200]}") from e
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            raise FormatError(f"not JSON: {str(e)[:200]}") from e

    def parse(self, output: str | None, strict: bool = False) -> list[dict]:
        """The list of extraction mappings in an output.

        Not strict: reasoning in ``<think>`` tags is dropped if the output can't be read with it.
        """
        if not output:
            raise FormatError("empty output")
        body = self.body(output)
        try:
            value = self.load(body)
        except FormatError:
            if strict or not THINKING.search(body):
                raise
            value = self.load(THINKING.sub("", body).strip())
        need_wrapper = bool(self.wrapper_key) and (self.wrapper or strict)
        if isinstance(value, dict):
            keys = [self.wrapper_key] if need_wrapper else [WRAPPER_KEY, self.wrapper_key]
            key = next((k for k in keys if k and k in value), None)
            if key is None and need_wrapper:
                raise FormatError(f"no {self.wrapper_key!r} key")
            items = value[key] if key is not None else [value]
        elif isinstance(value, list):
            if not self.allow_list or (strict and need_wrapper):
                raise FormatError("a list at the top isn't allowed")
            items = value
        else:
            raise FormatError(f"neither a mapping nor a list: {type(value).__name__}")
        if not isinstance(items, list) or not all(isinstance(x, dict) and all(isinstance(k, str) for k in x) for x in items):
            raise FormatError("extractions are a list of mappings with text keys")
        return items

    def ordered(self, items: list[dict]) -> list[Extraction]:
        """Extractions of parsed mappings, in the order of their indexes (stable) or as they come."""
        out = []
        for group, item in enumerate(items):
            for key, value in item.items():
                if self.index_suffix and key.endswith(self.index_suffix):
                    if not isinstance(value, int):
                        raise FormatError(f"index {key!r} is no whole number")
                elif self.attribute_suffix and key.endswith(self.attribute_suffix):
                    if value is not None and not isinstance(value, dict):
                        raise FormatError(f"attributes {key!r} are no mapping")
                elif not isinstance(value, (str, int, float)):
                    raise FormatError(f"value of {key!r} is neither text nor number")
                else:
                    index = item.get(key + self.index_suffix) if self.index_suffix else len(out) + 1
                    if index is not None:
                        out.append(Extraction(key, str(value), item.get(key + self.attribute_suffix), index, group))
        return sorted(out, key=lambda e: e.extraction_index)


@dataclass
class Template:
    """Task description and worked examples of a prompt."""

    description: str
    examples: list[Example] = field(default_factory=list)

    @classmethod
    def read(cls, path: str, kind: str = "yaml") -> Template:
        """From a YAML or JSON file with ``description`` and ``examples``."""
        try:
            with open(path, encoding="utf-8") as f:
                value = Format(kind, fences=False).load(f.read())
            examples = [Example(x["text"], [Extraction(e["extraction_class"], e["extraction_text"], e.get("attributes")) for e in x.get("extractions", [])]) for x in value.get("examples", [])]
            return cls(value["description"], examples)
        except (OSError, FormatError, KeyError, TypeError, AttributeError) as e:
            raise PromptTemplateError(f"{path}: {e}") from e

    def prompt_parts(self, fmt: Format, question: str = "Q: ", answer: str = "A: ", heading: str = "Examples") -> tuple[str, str]:
        """What stands before the context of a prompt, and between it and the question."""
        shown = [f"{question}{x.text}\n{answer}{fmt.example(x.extractions)}\n" for x in self.examples]
        return self.description + "\n", "\n".join([heading, *shown]) if shown else ""

    def render(self, fmt: Format, text: str, context: str | None = None) -> str:
        before, examples = self.prompt_parts(fmt)
        return "\n".join([before, *([context + "\n"] if context else []), *([examples] if examples else []), f"Q: {text}", "A: "])


def _attributes(examples: Iterable[Example]) -> dict[str, dict[str, list]]:
    seen: dict[str, dict[str, list]] = {}
    for e in (e for x in examples for e in x.extractions):
        of_class = seen.setdefault(e.extraction_class, {})
        for name, value in (e.attributes or {}).items():
            of_class.setdefault(name, []).append(value)
    return seen


def nullable_schema(examples: Iterable[Example], suffix: str = ATTRIBUTE_SUFFIX) -> dict:
    """A response schema with one nullable attribute object per class (classes have string texts)."""
    properties = {}
    for name, attributes in _attributes(examples).items():
        lists = {a: any(isinstance(v, list) for v in values) for a, values in attributes.items()}
        made = {a: {"type": "array", "items": {"type": "string"}} if is_list else {"type": "string"} for a, is_list in lists.items()}
        properties[name] = {"type": "string"}
        properties[name + suffix] = {"type": "object", "properties": made or {"_unused": {"type": "string"}}, "nullable": True}
    item = {"type": "object", "properties": properties}
    return {"type": "object", "properties": {WRAPPER_KEY: {"type": "array", "items": item}}, "required": [WRAPPER_KEY]}


def strict_schema(examples: Iterable[Example], suffix: str = ATTRIBUTE_SUFFIX) -> dict:
    """A strict schema with one alternative per class; attributes list the types seen, and null."""
    kinds = (("array", list), ("boolean", bool), ("integer", int), ("number", float), ("string", str))

    def typed(values: list) -> dict:
        found = [k for k, t in kinds if any(type(v) is t for v in values)] or ["string"]
        options = [{"type": "array", "items": {"type": "string"}} if k == "array" else {"type": k} for k in found]
        return {"anyOf": [*options, {"type": "null"}]}

    def closed(properties: dict) -> dict:
        return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}

    options = [closed({c: {"type": "string"}, c + suffix: closed({a: typed(v) for a, v in attributes.items()})}) for c, attributes in _attributes(examples).items()]
    items = {"anyOf": options} if options else closed({})
    return closed({WRAPPER_KEY: {"type": "array", "items": items}})


def format_warnings(fmt: Format, raw_output: bool) -> list[str]:
    """Settings that don't go together with a schema-bound provider."""
    out = []
    if raw_output and fmt.fences:
        out.append("the provider returns bare JSON: fences won't be found")
    if raw_output and not fmt.wrapper:
        out.append("the schema asks for a wrapper object")
    return out
