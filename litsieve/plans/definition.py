"""Pipeline definitions in Python, and their YAML form."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .pipeline import STEPS, parse_step, validate


@dataclass
class Definition:
    """A project, its templates and steps; every call returns the definition, so that calls
    chain. The YAML of a definition reads back as the same definition."""

    name: str
    project: dict[str, Any] = field(default_factory=dict)
    templates: dict[str, list[dict[str, Any]]] = field(default_factory=dict)
    steps: list[dict[str, Any]] = field(default_factory=list)

    def step(self, builtin: str, label: str | None = None, enabled: bool = True, template: str | None = None, **parameters: Any) -> Definition:
        """Adds a step, to a template if one is named."""
        if builtin not in STEPS:
            raise ValueError(f"unknown step {builtin}")
        entry: dict[str, Any] = {"step": label or builtin, f"builtin.{builtin}": parameters}
        if not enabled:
            entry["enabled"] = False
        (self.steps if template is None else self.templates.setdefault(template, [])).append(entry)
        return self

    def run_template(self, template: str, label: str | None = None) -> Definition:
        self.steps.append({"step": label or template, "builtin.run-template": {"template": template}})
        return self

    def as_mapping(self) -> dict[str, Any]:
        out: dict[str, Any] = {"project": {"name": self.name, **self.project}}
        if self.templates:
            out["templates"] = [{"template": k, "steps": v} for k, v in self.templates.items()]
        return out | {"steps": self.steps}

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.as_mapping(), sort_keys=False)

    @classmethod
    def from_mapping(cls, raw: dict[str, Any]) -> Definition:
        if wrong := validate(raw):
            raise ValueError("; ".join(wrong))
        project = dict(raw["project"])
        return cls(project.pop("name"), project, {t["template"]: t["steps"] for t in raw.get("templates", [])}, list(raw.get("steps", [])))

    @classmethod
    def from_yaml(cls, text: str) -> Definition:
        import yaml

        return cls.from_mapping(yaml.safe_load(text))

    def describe(self) -> list[str]:
        """A line a step: its place, label, builtin, and whether it is enabled."""
        lines = []
        for k, entry in enumerate(self.steps):
            label, name, _, enabled = parse_step(entry)
            lines.append(f"{k + 1}. {label} ({name}){'' if enabled else ', disabled'}")
        return lines
