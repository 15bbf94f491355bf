"""What a run is asked to do."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions.policy import DEFAULT, PII_TYPES, Policy
from ..functions.surrogates import SALT

TRUTHY = frozenset({"1", "true", "yes", "on"})


@dataclass(frozen=True)
class RedactionConfig:
    """types: None for all. scope: the column within which names are shared; None for the row alone."""

    types: tuple[str, ...] | None = None
    use_ner: bool = False
    #: A model's name, or a function (see operators.ner.Model).
    ner_model: object = "en_core_web_lg"
    salt: str = SALT
    scrub_metadata: bool = True
    emit_mapping: bool = False
    policy: Policy = field(default=DEFAULT)


def truthy(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.strip().lower() in TRUTHY


def parse_types(value: str | None) -> tuple[str, ...] | None:
    """Known types of a comma-separated list; none known means all, so a misspelt request never leaks."""
    found = tuple(t for t in (x.strip().upper() for x in (value or "").split(",")) if t in PII_TYPES)
    return found or None


def parse_options(options: Mapping[str, str]) -> RedactionConfig:
    return RedactionConfig(
        types=parse_types(options.get("types")),
        use_ner=truthy(options.get("ner")),
        salt=options.get("salt") or SALT,
        scrub_metadata=truthy(options.get("scrub_metadata"), True),
        emit_mapping=truthy(options.get("mapping")),
    )
