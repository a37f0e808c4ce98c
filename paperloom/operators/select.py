"""Finding elements in node arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import strip

# Elements whose text does not count as text of what is around them.
TEXT_CONTAINERS = ("rp", "rt", "script", "style", "template")


@dataclass(frozen=True)
class Rule:
    """What an element must look like.

    ``class_attr`` must equal the whole class attribute, its white space
    squeezed; each of ``classes`` must be among the classes; ``attrs`` must have
    exactly these values.
    """

    tag: str | None = None
    class_attr: str | None = None
    classes: tuple[str, ...] = ()
    attrs: Mapping[str, str] = field(default_factory=dict)

    def matches(self, node: Column) -> Column:
        tests = [node["tag"].isNotNull()]
        if self.tag is not None:
            tests.append(node["tag"] == self.tag)
        if self.class_attr is not None:
            tests.append(node["class_attr"] == self.class_attr)
        tests += [F.array_contains(node["classes"], name) for name in self.classes]
        tests += [
            F.coalesce(F.try_element_at(node["attrs"], F.lit(name)) == value, F.lit(False))
            for name, value in self.attrs.items()
        ]
        test = tests[0]
        for other in tests[1:]:
            test = test & other
        return test

    def may_match(self, tag: str, classes: Sequence[str], attrs: Mapping[str, str]) -> bool:
        """Coarse test used while parsing; never false for a match."""
        return (
            self.tag in (None, tag)
            and self.class_attr in (None, " ".join(classes))
            and all(name in classes for name in self.classes)
            and all(name in attrs for name in self.attrs)
        )


def inside(nodes: Column, element: Column) -> Column:
    """Everything within an element, the element itself left out."""
    return F.slice(nodes, element["pos"] + 2, element["end_pos"] - element["pos"])


def find_all(nodes: Column, rule: Rule) -> Column:
    return F.filter(nodes, rule.matches)


def find(nodes: Column, rule: Rule) -> Column:
    """First matching element, NULL if there is none."""
    return F.get(find_all(nodes, rule), F.lit(0))


def find_by_priority(nodes: Column, rules: Sequence[Rule]) -> Column:
    """First match of the first rule that matches anything, empty or not."""
    return F.coalesce(*[find(nodes, rule) for rule in rules])


def find_nested(nodes: Column, outer: Rule, steps: Sequence[Rule]) -> Column:
    """For each ``outer`` element the first match of ``steps[0]`` inside it, in
    that the first match of ``steps[1]``, and so on. Outer elements in which a
    step finds nothing are left out."""
    def narrow(found: Column, step: Rule) -> Column:
        inner = F.transform(found, lambda element: find(inside(nodes, element), step))
        return F.filter(inner, lambda element: element.isNotNull())

    return reduce(narrow, steps, find_all(nodes, outer))


def text_of(nodes: Column, element: Column, sep: str = "") -> Column:
    """Stripped texts inside an element, empty ones dropped, joined by ``sep``;
    the empty string without an element.

    Script, style, template and ruby texts belong to their own element only.
    """
    own = F.when(element["tag"].isin(*TEXT_CONTAINERS), element["tag"]).otherwise("")
    texts = F.filter(
        inside(nodes, element), lambda node: node["text"].isNotNull() & (node["container"] == own)
    )
    stripped = F.filter(F.transform(texts, lambda node: strip(node["text"])), lambda text: text != "")
    return F.coalesce(F.array_join(stripped, sep), F.lit(""))


def attribute(element: Column, name: str) -> Column:
    return F.try_element_at(element["attrs"], F.lit(name))
